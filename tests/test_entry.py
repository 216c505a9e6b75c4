"""The driver contract at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["normalize_edges", "contract_stars", "cc_forward", "tidemark_estimate", "hash_pair_shift64", "compare_labels"])
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = con.execute(f"select {', '.join(names)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want)
