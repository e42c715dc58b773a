"""The registered queries against their SQL on the smallest tables, where these are at hand."""

import glob
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def test_registry():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and all(callable(f) for f in q.values())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_core_queries_equal_their_sql(spark):
    import importlib

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    plain = lambda v: None if v is None or v != v else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    for m in entry._MODULES:
        module = importlib.import_module(m)
        for name, sql in module.SQL.items():
            got = module.QUERIES[name](spark, FOLDER)
            cols = sorted(got.columns)
            want = con.execute(sql)
            order = [x[0] for x in want.description]
            assert sorted(order) == cols, name
            a = sorted([tuple(plain(r[c]) for c in cols) for r in got.collect()], key=str)
            b = sorted([tuple(plain(r[order.index(c)]) for c in cols) for r in want.fetchall()], key=str)
            assert a == b, name
