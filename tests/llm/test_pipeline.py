"""The pipeline against its stages done plainly on a small table."""

import pytest

import corpus_pipeline
from harbor.llm import queries
from tests.compare import connect, duck_rows, spark_rows
from tests.llm.tables import AWKWARD, documents
from tests.llm.test_near_dedup import classes, corpus

import __spark_entry__ as contract

ITEM = "of the ships of the harbour that came late only seven were found to carry the lamp oil that the town had paid for"
ROWS = AWKWARD + [(200 + i, text, lang) for i, text, lang in corpus(7, 60)] + [(500, "so " * 9 + ITEM + " indeed", "en")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    documents(spark, ROWS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def plainly(rows):
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    last = {}
    for n, (doc_id, text, _) in enumerate(rows):
        key = (doc_id is not None, doc_id or 0, n)
        if text not in last or key > last[text][0]:
            last[text] = (key, rows[n])
    rows = [row for _, row in last.values()]
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    firsts, seen = [], set()
    for row, name in zip(rows, classes(rows), strict=True):
        if name not in seen or name is None:
            seen.add(name)
            firsts.append(row)
    return sorted((repr(i), t) for i, t, _ in firsts if ITEM not in t)


def test_stages_and_run(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "near_dedup", "decontamination", "sentencepiece",
    ]
    found = corpus_pipeline.run(spark, folder).collect()
    assert sorted((repr(r.doc_id), r.text) for r in found) == plainly(ROWS)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.schema.simpleString() == docs.schema.simpleString()
        empty = stage(spark, docs.limit(0), folder)
        assert empty.columns == docs.columns and empty.count() == 0


def test_registered(spark):
    names = set(contract.queries())
    assert {"pipeline", *queries.queries()} <= names
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(contract.oracle_sql()) <= names


def test_exact_dedup_sql(spark):
    expected = duck_rows(connect("sf0.01"), contract.oracle_sql()["op2_exact_dedup"])
    assert spark_rows(queries.op2_exact_dedup(spark, "/root/testdata/sf0.01")) == expected


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_cover_their_table(spark, name):
    found = queries.queries()[name](spark, "/root/testdata/sf0.001")
    rows = found.count()
    assert rows == {"op5_page_text": 50}.get(name, rows if name == "op8_decontamination" else 200)
