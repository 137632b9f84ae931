import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from folioquarry.llm import packing

SCHEMA = "id long, content string, token_count int, fill int, ids string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, -1, 5, "x") for i, t in texts], SCHEMA)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit(sizes):
    bins = packing.best_fit(np.array(sizes, np.int64), 64)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    fills = [sum(sizes[i] for i in b) for b in bins]
    assert all(f <= 64 for f in fills)
    assert sum(f <= 32 for f in fills) <= 1  # two half-empty bins would have been one


def test_cases(spark):
    texts = [(1, "a" * 4096), (2, "b" * 4100), (3, None), (4, ""), (5, "c" * 10), (5, "c" * 10), (6, "d" * 40_000), (7, " ")]
    req = packing.pack_requests(frame(spark, texts), "id", "content")
    rows = req.collect()
    assert len({r["request_id"] for r in rows}) == len(rows) and all(r["fill"] == sum(r["costs"]) <= 1024 for r in rows)
    got = packing.assignments(req).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r["chunk_id"], []).append((r["piece"], r["tokens"]))
    assert {k: sum(t for _, t in v) for k, v in pieces.items()} == {1: 1024, 2: 1025, 4: 1, 5: 4, 6: 10_000, 7: 1}
    assert sorted(pieces[2]) == [(1, 1024), (2, 1)] and len(pieces[6]) == 10 and len(pieces[1]) == 1


def test_empty(spark):
    assert packing.pack_requests(frame(spark, []), "id", "content").collect() == []


def test_rounds_merge_what_partitions_leave(spark):
    rng = np.random.default_rng(0)
    sizes = rng.integers(100, 520, 3000)
    df = frame(spark, [(i, "x" * int(n * 4)) for i, n in enumerate(sizes)]).repartition(40)
    for per_task in (20_000, 10):
        req = packing.pack_requests(df, "id", "content", open_per_task=per_task)
        assert sorted(r["chunk_id"] for r in packing.assignments(req).collect()) == list(range(3000))
        if per_task > 10:
            assert req.count() <= np.ceil(sizes.sum() / 1024) * 1.03


def test_nothing_merges(spark):
    df = frame(spark, [(i, "x" * 2400) for i in range(200)]).repartition(8)
    assert packing.pack_requests(df, "id", "content", open_per_task=10).count() == 200


def test_the_tree_has_one_root(spark):
    """Halves and thirds that lie in different partitions meet in the end, whatever the fan-in."""
    texts = [(i, "x" * (4 * (340 if i % 3 else 684))) for i in range(120)]
    df = frame(spark, texts).repartition(40, "id")
    for fan_in in (2, 5, 64):
        req = packing.pack_requests(df, "id", "content", fan_in=fan_in)
        assert sorted(r["chunk_id"] for r in packing.assignments(req).collect()) == list(range(120))
        assert req.count() <= 68  # 40 large ones with a small one each, the other 40 small ones by three
