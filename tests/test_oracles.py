"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = [f[:-8] for f in os.listdir(SF) if f.endswith(".parquet")]


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (int, bool)):
        return round(float(value), 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    frame = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(want.columns)
    got, expected = rows_of(frame.columns, frame.collect()), rows_of(want.columns, want.fetchall())
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a == b


def test_queries_without_sql_run(spark):
    for name in sorted(set(entry.queries()) - set(entry.oracle_sql())):
        if not name.startswith("op") and name != "pipeline":
            assert entry.queries()[name](spark, SF).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
