"""Every registered query against its SQL counterpart, and the driver contract."""

import pytest

import __spark_entry__ as entry
from workload.check import compare, sql_rows

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES)
    rows = entry.entry(spark).collect()
    assert [r["policy"] for r in rows] and all(r["status"] == "ok" for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert compare(df.columns, df.collect(), *sql_rows(sf_dir, ORACLES[name])) is None


@pytest.mark.parametrize("name", ["stratified_split", "stratified_kfold"])
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
