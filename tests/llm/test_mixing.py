import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioquarry.llm import mixing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(0, 1), max_size=30), st.integers(0, 99))
def test_pivot_keeps_the_sum(ps, seed):
    decided, held = mixing.pivot(list(enumerate(ps)), random.Random(seed))
    assert sorted([i for i, _ in decided] + ([held[0]] if held else [])) == list(range(len(ps)))
    assert sum(x for _, x in decided) + (held[1] if held else 0) == pytest.approx(sum(ps), abs=1e-6)


def test_pivot_is_fair():
    n, hits = 4000, [0, 0, 0]
    for s in range(n):
        decided, held = mixing.pivot([(0, 0.2), (1, 0.5), (2, 0.3)], random.Random(s))
        for i, x in decided:
            hits[i] += x
        if held:
            hits[held[0]] += held[1]
    assert hits[0] / n == pytest.approx(0.2, abs=0.03) and hits[1] / n == pytest.approx(0.5, abs=0.03)


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_mix(spark):
    rows = [(i, "big" if i % 3 else "hot", 10 + i % 7) for i in range(3000)] + [(9001, "tiny", 5), (9002, "other", 50), (9003, None, 50), (9004, "big", 0)]
    sizes = spark.createDataFrame(rows, "id long, source string, tokens long").repartition(11)
    t = targets(spark, [("Big ", 0.5, 2), ("hot", 0.4, 3), ("tiny", 0.09, 2), ("absent", 0.01, 2)])
    copies, report = mixing.mix(sizes, t)
    got = {r["id"]: r for r in copies.collect()}
    assert len(got) == len(rows)
    rep = {r["source"]: r for r in report.collect()}
    assert {s for s, r in rep.items() if not r["reachable"]} == {"tiny", "absent"}
    for s, cap in (("big", 2), ("hot", 3)):
        mine = [r for r in got.values() if r["source"] == s and r["tokens"]]
        due = rep[s]["copies_due"]
        assert {r["copies"] for r in mine} <= {int(due), int(due) + 1} and max(r["copies"] for r in mine) <= cap
        assert abs(sum(r["copies"] for r in mine) - due * len(mine)) <= 1
        assert rep[s]["used_tokens"] == sum(r["tokens"] * r["copies"] for r in mine)
    assert got[9001]["copies"] == 2 and got[9002]["copies"] == got[9003]["copies"] == got[9004]["copies"] == 0
    total = sum(r["tokens"] for r in got.values())
    assert rep["big"]["used_tokens"] == pytest.approx(0.5 * total, rel=0.01)
    again, _ = mixing.mix(sizes, t)
    assert {r["id"]: r["copies"] for r in again.collect()} == {i: r["copies"] for i, r in got.items()}


def test_empty(spark):
    sizes = spark.createDataFrame([], "id long, source string, tokens long")
    copies, report = mixing.mix(sizes, targets(spark, [("a", 1.0, 1)]))
    assert copies.collect() == [] and report.first()["used_tokens"] == 0


def test_count_tokens(spark):
    df = spark.createDataFrame([(1, " A ", "one two", 7), (2, "b", None, 7), (3, "b", "", 7), (4, None, "x " * 200_000, 7)], "doc_id long, source string, text string, tokens int")
    got = {r["id"]: (r["source"], r["tokens"]) for r in mixing.count_tokens(df, "doc_id", "text", "source").collect()}
    assert got[1] == ("a", 2) and got[2] == ("b", 0) and got[3][1] == 0 and got[4][1] >= 200_000


def test_spans_keep_the_tokens():
    enc = mixing._encoder(mixing.TOKENIZER)
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice(["word", "it's", " ", "  ", "\n", "\n\n", "\r\n", "\t", "42", "...", "ä", "、", "\u00a0"]) for _ in range(300))
        whole = enc.encode_ordinary(text)
        assert [t for s in mixing.spans(text, 40) for t in enc.encode_ordinary(s)] == whole and "".join(mixing.spans(text, 40)) == text
    assert list(mixing.spans("x" * 900, 100)) == ["x" * 900] and list(mixing.spans("")) == [""]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 1), st.just(0.0) | st.floats(0.01, 50)), min_size=1, max_size=9), st.floats(1, 100), st.sampled_from([0.0, 0.02, 0.3]))
def test_mixture_size(sources, most, over):
    whole = sum(s for s, _ in sources)
    sources = [(s / whole, c) for s, c in sources]
    given_ = sum(s for s, c in sources if c > 0)

    def above(size):  # how far an unexhausted source stands above its share among those that give anything
        return given_ * size / sum(min(c, s * size) for s, c in sources) - 1

    size = mixing.mixture_size(sources, most, over)
    if given_:
        assert 0 < size <= most and above(size) <= over + 1e-6
        assert size == most or above(size * 1.01) > over - 1e-6
    else:
        assert size == most


def test_shares_are_met(spark):
    rows = [(i, f"s{i % 4}", 20 + i % 9) for i in range(4000)] + [(8000 + i, "tiny", 20) for i in range(40)]
    sizes = spark.createDataFrame(rows, "id long, source string, tokens long")
    t = targets(spark, [(f"s{k}", 0.225, 2) for k in range(4)] + [("tiny", 0.1, 2)])
    copies, report = mixing.mix(sizes, t, over=0.02, per_block=150)
    for r in report.collect():
        assert r["share_reached"] / r["target_share"] < 1.03 and (r["share_reached"] / r["target_share"] > 0.98 or r["source"] == "tiny")
    again, _ = mixing.mix(sizes.repartition(7), t, over=0.02, per_block=150)
    assert sorted(map(tuple, copies.collect())) == sorted(map(tuple, again.collect()))  # however the rows lie


def test_short_sources_come_from_the_copies(spark):
    rows = [(i, "big" if i % 3 else "hot", 10 + i % 7) for i in range(3000)] + [(9001, "tiny", 5), (9001, "tiny", 5), (9002, None, 7)]
    sizes = spark.createDataFrame(rows, "id long, source string, tokens long")
    t = targets(spark, [("Big ", 0.5, 2), ("hot", 0.4, 3), ("tiny", 0.09, 2), ("absent", 0.01, 2), ("none", 0.0, None)])
    copies, _ = mixing.mix(sizes, t)
    assert {r["source"] for r in mixing.short_sources(copies, t).collect()} == {"tiny", "absent"}
    broken = copies.withColumn("copies", copies["copies"] * 0)
    assert {r["source"] for r in mixing.short_sources(broken, t).collect()} == {"absent"}
