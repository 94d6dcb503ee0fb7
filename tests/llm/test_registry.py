"""The registered queries on the smallest tables; where there is SQL, against it."""

import glob
import os

import pytest

from colophon.llm import registry


@pytest.fixture(scope="module")
def duck(tiny):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in glob.glob(f"{tiny}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


COLUMNS = {
    "p1_found": ["chunk_id", "kind", "value"], "p2_found": ["id_a", "id_b"], "p3_found": ["chunk_id"], "p4_found": ["field_name", "value_a", "value_b"],
    "p5_found": ["conversation_id", "turn_no", "message_id"], "p6_found": ["table_name", "id_a", "id_b"], "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, tiny, duck, name):
    got = registry.QUERIES[name](spark, tiny)
    assert got.columns == COLUMNS.get(name, got.columns)
    rows = [tuple(r) for r in got.collect()]
    if name in COLUMNS and name != "p9_found":
        assert len(rows) == len(set(rows))
    if name in registry.SQL:
        want = duck.execute(registry.SQL[name]).df()[got.columns]
        plain = lambda rows: {tuple(None if v != v else v for v in r) for r in rows}
        assert plain(rows) == plain(map(tuple, want.itertuples(index=False)))
    if name in ("p2_found", "p6_found"):
        assert all(r[-2] < r[-1] for r in rows)


def test_each_query_reads_its_whole_tables(spark, tiny):
    """As many classes of chunks come out of the pass-through operators as went in."""
    n = spark.read.parquet(f"{tiny}/chunk_result.parquet").select("chunk_id").distinct().count()
    assert registry.p1_texts(spark, tiny).count() == n
    assert registry.p3_pieces(spark, tiny).select("chunk_id").distinct().count() == n
    assert registry.p9_scores(spark, tiny).count() == spark.read.parquet(f"{tiny}/documents.parquet").count()
