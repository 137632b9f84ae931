"""Every query of the subpackage runs on the smallest tables; where SQL exists, it must agree."""

from pathlib import Path

import duckdb
import pytest

from folioquarry.llm.queries import ORACLE, QUERIES

COLUMNS = {
    "p1_found": {"chunk_id"}, "p2_found": {"chunk_id", "lang"}, "p3_found": {"item_table", "id_a", "id_b"}, "p4_found": {"request_id", "chunk_id"},
    "p5_found": {"chunk_id", "boundary"}, "p6_found": {"doc_id", "item_id"}, "p7_found": {"source"}, "p8_found": {"doc_id_a", "doc_id_b"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    df = QUERIES[name](spark, small)
    rows = df.collect()
    if name in COLUMNS:
        assert set(df.columns) == COLUMNS[name] and len(set(rows)) == len(rows)
    if name not in ORACLE:
        return
    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(cur.fetchall())
