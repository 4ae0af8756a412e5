"""Results do not hang on how a scan cuts the files."""

import pytest

import corpus_pipeline
from harbor.llm import common, decontamination, exact_dedup, near_dedup, queries
from harbor.llm.common import ROW
from tests.llm.tables import documents, rows_of
from tests.llm.test_decontamination import DOCS, ITEM, benchmark
from tests.llm.test_near_dedup import corpus

SPLIT = "spark.sql.files.maxPartitionBytes"
ROWS = [*corpus(3, 60), *((300 + i, text, lang) for i, text, lang in DOCS)]


@pytest.fixture
def recut(spark, monkeypatch):
    """The files are cut in other places in every pass that follows a written table."""
    sizes = iter([2_000, 64_000, 9_000, 700, 30_000] * 100)
    before = spark.conf.get(SPLIT)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")

    def written(df, name, **options):
        out = materialize(df, name, **options)
        spark.conf.set(SPLIT, str(next(sizes)))
        return out

    materialize = common.materialize
    for module in (common, near_dedup, exact_dedup, decontamination):
        monkeypatch.setattr(module, "materialize", written)
    yield
    spark.conf.set(SPLIT, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_stages_on_files_cut_anew(spark, tmp_path, recut):
    folder = str(tmp_path)
    documents(spark, ROWS).coalesce(1).write.option("parquet.block.size", 1024).parquet(f"{folder}/documents.parquet")
    benchmark(spark, [ITEM]).write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    classes = queries.op6_near_dedup(spark, folder)
    kept = rows_of(classes.filter("kept"), "doc_id")
    assert len(rows_of(classes)) == len(ROWS)
    assert rows_of(corpus_pipeline.near_dedup(spark, docs, folder), "doc_id") == kept
    last = exact_dedup.exact_duplicates(docs).filter("kept")
    assert rows_of(corpus_pipeline.exact_dedup(spark, docs, folder), "doc_id") == rows_of(last, "doc_id")
    found = {i for (i,) in rows_of(queries.op8_decontamination(spark, folder), "doc_id")}
    assert {301, 302, 306} <= found
    left = rows_of(corpus_pipeline.decontaminate(spark, docs, folder), "doc_id")
    assert left == sorted(((i,) for i, *_ in ROWS if i not in found), key=repr)


def test_numbers_come_from_written_tables(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    documents(spark, ROWS).write.parquet(path)
    rows = common.numbered(spark.read.parquet(path))
    assert not any(file.startswith(f"file:{path}") for file in rows.inputFiles())
    assert "monotonically_increasing_id" not in rows._jdf.queryExecution().toString()


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_duplicates, near_dedup.drop_near_duplicates])
def test_a_column_of_that_name_is_refused(spark, drop):
    """Two equal rows that claim one number would both stay."""
    docs = documents(spark, [(1, "same text", "en"), (2, "same text", "en")])
    with pytest.raises(ValueError, match=ROW):
        drop(docs.selectExpr("*", f"7L AS {ROW}"))
    assert drop(docs).count() == 1


def test_columns_of_any_name_pass_the_language_stage(spark):
    docs = documents(spark, [(1, "some words in a text", "en"), (2, "12 34", "en")]).selectExpr("*", "1 AS language", "2 AS certainty", "3 AS language_")
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns and rows_of(kept, "doc_id", "language", "certainty", "language_") == [(1, 1, 2, 3)]


def test_workers_let_go_of_what_other_operators_kept():
    from harbor.llm import sentencepieces, words

    encoder = sentencepieces.word_ids(queries.PIECE_BPE)
    list(common.trimmed(iter(()), "pieces"))
    assert sentencepieces.word_ids(queries.PIECE_BPE) is encoder
    words.powers(10)
    list(common.trimmed(iter(()), "words"))
    assert sentencepieces.word_ids(queries.PIECE_BPE) is not encoder and words._kept_powers.cache_info().currsize == 1
    list(common.trimmed(iter(()), "pieces"))
    assert words._kept_powers.cache_info().currsize == 0
