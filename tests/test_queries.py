"""Every registered query runs on the smallest tables, and gives what its SQL gives."""

import glob
import importlib.util
import os

import pytest

import __spark_entry__ as entry_points
from colophon.plans import registry


def rows(df):
    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if v is None or v != v or str(v) in ("<NA>", "NaT"):
            return None
        return round(v, 5) + 0.0 if isinstance(v, float) else int(v) if isinstance(v, int) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False)), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck(tiny):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in glob.glob(f"{tiny}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, tiny, duck, name):
    got = registry.QUERIES[name](spark, tiny).toPandas()
    if name in registry.SQL:
        want = duck.execute(registry.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark, tiny):
    assert entry_points.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]


def test_names_and_sql_belong_together():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_nothing_else_imports_the_optional_subpackage():
    root = os.path.dirname(importlib.util.find_spec("colophon").origin)
    for path in glob.glob(f"{root}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert "colophon.llm" not in open(path).read(), path
