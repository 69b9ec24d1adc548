"""Every registered query that has SQL gives what DuckDB gives for it."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def same(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return tuple(map(same, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_matches_sql(spark, name):
    got = entry_module.queries()[name](spark, DATA)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(entry_module.oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(same(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(same(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0
