"""Problem 4: one ranking from differently scaled scores (outranking net flow).

Per group (request) and arm the values become percentiles, so no scale or
outlier counts.  The preference of i over j in one arm rises from 0 at a
percentile lead of ``q`` to 1 at ``p``.  An item's flow is its summed preference
over all others minus theirs over it; the arms' flows are added by weight.  The
sums over all pairs come from sorted prefix sums, never from pairs.

A second, stricter flow with the step preference (any lead counts whole) finds
clear winners: who beats every other in ``need`` of the arms has a step flow of at
least ``2 need / arms - 1``, and at most two thirds of a group (for three arms
of four) can have that much.  The same bound holds among those left, so a few
rounds of flow leave one candidate per group, which is then checked.

Groups up to ``hot`` rows use range frames of one sort.  A larger group would be
one task there, so its distinct values are counted first, sorted across tasks
by range, and its prefix sums completed with per-task offsets; both ways give
the same numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch

FLOW_SCALE = 1_000_000_000


def wide_scores(scores: DataFrame, arms: list[tuple[str, bool]], group: str = "request_id", item: str = "chunk_id",
                arm: str = "arm", score: str = "raw_score") -> DataFrame:
    """``(g, item, v0, v1, ...)``: per arm the item's best value, larger is better, null where it has none.

    ``arms`` is ``[(name, low_is_better)]``.  Repeated rows count once (the
    best of differing repeats); NaN counts as missing; rows of other arms or
    without group or item are left out.
    """
    s = F.when(~F.isnan(score), F.col(score))
    values = [F.max(F.when(F.col(arm) == name, -s if low else s)).alias(f"v{i}") for i, (name, low) in enumerate(arms)]
    known = F.col(arm).isin([name for name, _ in arms]) & F.col(group).isNotNull() & F.col(item).isNotNull()
    return scores.where(known).groupBy(F.col(group).alias("g"), F.col(item).alias("item")).agg(*values)


def _flow(x: Column, q: float, p: float, below: tuple, mid: tuple, above: tuple, mid_up: tuple) -> Column:
    """Preference over the lower items minus that of the higher ones, from (count, sum) of four percentile ranges."""
    width = p - q
    plus = below[0] + ((x - q) * mid[0] - mid[1]) / width
    minus = above[0] + (mid_up[1] - (x + q) * mid_up[0]) / width
    return plus - minus


def _small(long: DataFrame, q: float, p: float) -> DataFrame:
    by = Window.partitionBy("g", "arm")
    sort = by.orderBy(F.col("v").asc_nulls_first())
    ranked = long.withColumn("n", F.count(F.lit(1)).over(by)).withColumn("lo", F.rank().over(sort))
    ranked = ranked.withColumn("ties", F.count(F.lit(1)).over(Window.partitionBy("g", "arm", "v")))
    # twice the mid-rank keeps the range frames on whole numbers
    ranked = ranked.withColumn("t", (2 * F.col("lo") + F.col("ties") - 1).cast("long"))
    ranked = ranked.withColumn("x", F.col("t") / (2 * F.col("n")))
    step = (2 * (F.col("lo") - 1) + F.col("ties") - F.col("n")) / F.greatest(F.col("n") - 1, F.lit(1))
    # frames need constant offsets: percentiles on a fixed grid of whole steps
    ranked = ranked.withColumn("xi", F.round(F.col("x") * FLOW_SCALE).cast("long"))
    qi, pi = round(q * FLOW_SCALE), round(p * FLOW_SCALE)
    at = by.orderBy("xi")

    def span(a: int, b: int) -> tuple[Column, Column]:
        w = at.rangeBetween(a, b)
        return F.count(F.lit(1)).over(w), F.coalesce(F.sum("xi").over(w), F.lit(0)) / FLOW_SCALE

    lo, hi = Window.unboundedPreceding, Window.unboundedFollowing
    x = F.col("xi") / FLOW_SCALE
    flow = _flow(x, q, p, span(lo, -pi), span(-pi + 1, -qi - 1), span(pi, hi), span(qi + 1, pi - 1))
    return ranked.select("g", "item", "arm", "w", "n", (flow / F.greatest(F.col("n") - 1, F.lit(1))).alias("flow"), step.alias("step"))


def _running(df: DataFrame, keys: list[str], order: list, sums: list[str], scratch: Scratch, partitions: int) -> DataFrame:
    """Adds ``c_<sum>``: exclusive running sums within ``keys`` in ``order``, over tasks sorted by range.

    A group of any size spans many tasks; what one task holds of it is summed
    there and completed by the total of the tasks before.
    """
    cut = scratch.keep(df.repartitionByRange(partitions, *keys, *order).withColumn("pid", F.spark_partition_id()))
    local = Window.partitionBy("pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy("pid", *keys).agg(*[F.sum(s).alias(s) for s in sums])
    before = Window.partitionBy(*keys).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = parts.select("pid", *keys, *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias("o_" + s) for s in sums])
    out = cut.withColumns({"l_" + s: F.coalesce(F.sum(s).over(local), F.lit(0)) for s in sums}).join(offs, ["pid", *keys])
    return out.withColumns({"c_" + s: F.col("l_" + s) + F.col("o_" + s) for s in sums}).drop("pid", *["l_" + s for s in sums], *["o_" + s for s in sums])


def _hot(long: DataFrame, q: float, p: float, scratch: Scratch, partitions: int) -> DataFrame:
    qi, pi = round(q * FLOW_SCALE), round(p * FLOW_SCALE)

    # one row per distinct value: a tie of any size is one row from here on
    values = scratch.keep(long.groupBy("g", "arm", "v").agg(F.count(F.lit(1)).alias("m")))
    totals = values.groupBy("g", "arm").agg(F.sum("m").alias("n"))
    ranked = _running(values, ["g", "arm"], [F.col("v").asc_nulls_first()], ["m"], scratch, partitions).join(totals, ["g", "arm"])
    ranked = ranked.withColumn("xi", F.round((2 * F.col("c_m") + F.col("m") + 1) / (2 * F.col("n")) * FLOW_SCALE).cast("long"))
    step = (2 * F.col("c_m") + F.col("m") - F.col("n")) / F.greatest(F.col("n") - 1, F.lit(1))
    ranked = scratch.keep(ranked.select("g", "arm", "v", "m", "n", "xi", step.alias("step")))
    # probes stand before the value they ask about, so their running sums are those of all smaller values
    probes = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("xi") + d).alias("at"), F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("s"))
                       for k, d in (("a", -pi + 1), ("b", -qi), ("c", qi + 1), ("d", pi))],
                     F.struct(F.lit("v").alias("k"), F.col("xi").alias("at"), F.col("m").alias("m"), (F.col("xi") * F.col("m")).alias("s")))
    events = ranked.select("g", "arm", "v", "xi", F.explode(probes).alias("e")).select("g", "arm", "v", "xi", "e.k", "e.at", "e.m", "e.s")
    events = events.withColumn("later", (F.col("k") == "v").cast("int"))
    summed = _running(events, ["g", "arm"], ["at", "later", "k", "xi"], ["m", "s"], scratch, partitions)
    keys = ["g", "arm", "xi"]
    wide = summed.where("k <> 'v'").groupBy(*keys).agg(*[F.max(F.when(F.col("k") == k, F.col(c))).alias(c + k) for k in "abcd" for c in ("c_m", "c_s")])
    total_s = ranked.groupBy("g", "arm").agg(F.sum("m").alias("n"), F.sum(F.col("xi") * F.col("m")).alias("total"))
    got = wide.join(ranked.select("g", "arm", "v", "xi", "step"), keys).join(total_s, ["g", "arm"])
    c = F.col
    flow = _flow(c("xi") / FLOW_SCALE, q, p, (c("c_ma"), None), (c("c_mb") - c("c_ma"), (c("c_sb") - c("c_sa")) / FLOW_SCALE),
                 (c("n") - c("c_md"), None), (c("c_md") - c("c_mc"), (c("c_sd") - c("c_sc")) / FLOW_SCALE))
    per_value = got.select(c("g").alias("g2"), c("arm").alias("arm2"), c("v").alias("v2"), "n", (flow / F.greatest(c("n") - 1, F.lit(1))).alias("flow"), "step")
    # back to the items: the value is in the key, ties of one value are spread by AQE's skew join
    return (long.join(per_value, (c("g") == c("g2")) & (c("arm") == c("arm2")) & c("v").eqNullSafe(c("v2")))
            .select("g", "item", "arm", "w", "n", "flow", "step"))


def _crowded(wide: DataFrame, hot: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """The groups above ``hot`` items (at most items / ``hot`` of them) and how many items they hold."""
    big = scratch.keep(wide.groupBy("g").count().where(F.col("count") > hot))
    return big, big.agg(F.sum("count")).first()[0] or 0


def flows(wide: DataFrame, n_arms: int, weights: list[float] | None = None, q: float = 0.02, p: float = 0.3, hot: int = 100_000) -> DataFrame:
    """``(g, item, n, flow, step)``: size of the group, weighted net flow, and unweighted net flow with the step preference, both in [-1, 1].

    ``wide`` is ``wide_scores``' result.  A missing value is worse than any
    number, equal values are equally good (mid-rank percentiles).  Groups of one
    item have flow 0; an empty table gives an empty result.  ``hot`` only chooses
    the way, not the result.
    """
    weights = weights or [1.0] * n_arms
    whole = sum(weights)
    scratch = Scratch(wide.sparkSession, "outranking")
    stack = F.explode(F.array(*[F.struct(F.lit(i).alias("arm"), F.col(f"v{i}").alias("v"), F.lit(weights[i] / whole).alias("w")) for i in range(n_arms)])).alias("s")
    long = wide.select("g", "item", stack).select("g", "item", "s.arm", "s.v", "s.w")
    big, n_big = _crowded(wide, hot, scratch)
    if n_big:
        parts = max(8, n_big * n_arms // 1_000_000)
        found = _small(long.join(big.select("g"), "g", "left_anti"), q, p).unionByName(_hot(long.join(big.select("g"), "g", "left_semi"), q, p, scratch, parts))
    else:
        found = _small(long, q, p)
    return found.groupBy("g", "item").agg(F.first("n").alias("n"), F.sum(F.col("w") * F.col("flow")).alias("flow"), (F.sum("step") / n_arms).alias("step"))


def net_flow(wide: DataFrame, n_arms: int, **options) -> DataFrame:
    """``(g, item, flow)``: the weighted net flow alone."""
    return flows(wide, n_arms, **options).select("g", "item", "flow")


def clear_winners(wide: DataFrame, found: DataFrame, n_arms: int, need: int, hot: int = 100_000) -> DataFrame:
    """``(g, item)``: the item that beats every other of its group in at least ``need`` arms, where there is one.

    ``found`` is ``flows`` of ``wide``.  Against each other item a winner is
    better in ``need`` arms and worse in at most the rest, so its step flow is at
    least t = 2 need / arms - 1, in its group and in any part of it.  Flows add
    up to 0 and none is below -1: of n items at most n / (1 + t) reach t.  So the
    candidates of each group shrink with every round of flow among them, down to
    one, which is held against all others.  ``need`` must be more than half of
    the arms, else everybody could be a candidate.  An item alone in its group
    has nobody to lose to and wins.
    """
    if 2 * need <= n_arms:
        raise ValueError("a clear winner needs more than half of the arms")
    least = 2 * need / n_arms - 1 - 1e-9
    scratch = Scratch(wide.sparkSession, "winners")
    values = [f"v{i}" for i in range(n_arms)]
    reach = (F.col("step") >= least) | (F.col("n") == 1)
    cand = scratch.keep(found.where(reach).select("g", "item"))
    while True:
        several = cand.groupBy("g").count().where("count > 1").select("g")
        if not several.head(1):
            break
        again = cand.join(several, "g", "left_semi").join(wide, ["g", "item"])
        left = flows(scratch.keep(again), n_arms, hot=hot).where(reach).select("g", "item")
        cand = scratch.keep(cand.join(several, "g", "left_anti").unionByName(left))
    best = cand.join(wide, ["g", "item"]).select("g", F.col("item").alias("w"), *[F.col(v).alias(f"w{i}") for i, v in enumerate(values)])
    against = wide.join(best, "g")
    won = reduce(lambda s, t: s + t, [(F.col(f"w{i}").isNotNull() & (F.col(v).isNull() | (F.col(f"w{i}") > F.col(v)))).cast("int") for i, v in enumerate(values)])
    return against.groupBy("g", "w").agg(F.sum(((F.col("item") != F.col("w")) & (won < need)).cast("int")).alias("bad")).where("bad = 0").select("g", F.col("w").alias("item"))


def rank_items(wide: DataFrame, n_arms: int, need: int = 3, hot: int = 100_000, **options) -> DataFrame:
    """``(g, item, flow, clear, position)``: one order per group, any clear winner first, then by net flow, then by item.

    Net flow alone does not promise the first place to an item that beats all
    others in ``need`` arms and is last in another.
    """
    scratch = Scratch(wide.sparkSession, "ranking")
    wide = scratch.keep(wide)
    found = scratch.keep(flows(wide, n_arms, hot=hot, **options))
    win = clear_winners(wide, found, n_arms, need, hot).withColumn("clear", F.lit(True))
    rows = found.select("g", "item", "flow").join(win, ["g", "item"], "left").withColumn("clear", F.coalesce("clear", F.lit(False)))
    order = [F.col("clear").desc(), F.col("flow").desc(), F.col("item")]

    def small(df: DataFrame) -> DataFrame:
        return df.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("long"))

    big, n_big = _crowded(wide, hot, scratch)
    if not n_big:
        return small(rows)
    large = rows.join(big.select("g"), "g", "left_semi").withColumn("one", F.lit(1).cast("long"))
    large = _running(large, ["g"], order, ["one"], scratch, max(8, n_big // 1_000_000))
    large = large.select(*rows.columns, (F.col("c_one") + 1).alias("position"))
    return small(rows.join(big.select("g"), "g", "left_anti")).unionByName(large)
