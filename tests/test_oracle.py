"""Every query with SQL against DuckDB on the given tables."""

import pytest

import __spark_entry__ as contract
from tests.compare import connect, duck_rows, spark_rows

QUERIES = contract.queries()
SQL = contract.oracle_sql()


def test_every_text_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith("op")))
def test_same_rows(spark, name, sf):
    expected = duck_rows(connect(sf), SQL[name])
    assert spark_rows(QUERIES[name](spark, f"/root/testdata/{sf}")) == expected


TEXT = {name for name in QUERIES if name == "pipeline" or name.startswith("op")}


def test_every_query_has_sql():
    assert set(QUERIES) - TEXT == set(SQL) - TEXT


def test_entry(spark):
    rows = [tuple(r) for r in contract.entry(spark).collect()]
    assert len(rows) == 2 and all(r[2] == 2 for r in rows)
