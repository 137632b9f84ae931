"""Every query of the catalogue against its SQL, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from folioquarry.plans.catalogue import ORACLE, QUERIES


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v if v is None or isinstance(v, (int, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    df = QUERIES[name](spark, small)
    rows = df.collect()
    if name not in ORACLE:
        return
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=repr)
    assert got == want
