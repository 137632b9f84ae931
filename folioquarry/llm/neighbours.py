"""Problem 3: the k most similar vectors of every vector (NN-descent over Spark joins).

Vectors are scaled to unit length; 8-bit codes with one scale each stand for
them where candidates are sought, after a rotation that spreads an outlying
component.  What is found is scored again on the unit vectors themselves.
Equal vectors are one node of the graph; its copies are listed beside it.  A
cross-polytope hash gives every node starting neighbours: the best of those it
shares a bucket with.  Then NN-descent: every node sends its vector to the
nodes it is a neighbour of, in either direction; those compare all they
received with each other (neighbours of neighbours) and return what beats a
node's worst neighbour.  Pairs of which both were there in the round before are
not compared again, and nodes around which nothing is new get no mail.  Rounds
end when few lists change.  Queries search the graph greedily, forwards and
backwards, from the bucket mates of the query; that a query may be a node itself
is not made use of.

Several collections may share one run: ``kind`` keeps them apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch

LISTS = "node long, near array<long>, sims array<float>"


def _rotations(dim: int, tables: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(2 * tables)]).astype(np.float32)


def _codes(x: np.ndarray, rotations: np.ndarray, sub: int) -> np.ndarray:
    """Bucket codes (rows, tables * 2): the nearest and second nearest signed axis of each rotation, refined by ``sub`` sectors."""
    out = []
    for t in range(len(rotations) // 2):
        y = x @ rotations[2 * t]
        a = np.abs(y)
        first = a.argmax(1)
        rows = np.arange(len(x))
        a[rows, first] = -1
        second = a.argmax(1)
        fine = 0
        if sub > 1:
            z = x @ rotations[2 * t + 1][:, : max(1, (sub + 1) // 2)]
            best = np.abs(z).argmax(1)
            fine = 2 * best + (z[rows, best] > 0)
        for axis in (first, second):
            side = 2 * axis + (y[rows, axis] > 0)
            out.append((t * 2 * x.shape[1] + side) * (sub + 2) + fine)
    return np.stack(out, 1)


def _bytes(batch, name: str) -> tuple[np.ndarray, int]:
    q = batch.column(name).combine_chunks() if isinstance(batch, pa.Table) else batch.column(name)
    if isinstance(q, pa.ChunkedArray):
        q = q.chunk(0) if q.num_chunks == 1 else pa.concat_arrays(q.chunks)
    size = len(q[0].as_py())
    first = np.frombuffer(q.buffers()[1], np.int32)[q.offset]
    return np.frombuffer(q.buffers()[2], np.int8)[first : first + size * len(q)].reshape(len(q), size), len(q)


def _unpack(batch) -> np.ndarray:
    """The vectors as their codes give them."""
    return _bytes(batch, "q")[0].astype(np.float32) * batch.column("scale").to_numpy()[:, None]


def _exact(batch, name: str = "u") -> np.ndarray:
    """The unit vectors themselves."""
    raw, n = _bytes(batch, name)
    return np.frombuffer(raw.tobytes(), np.float32).reshape(n, -1)


def _packed(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def encode(vectors: DataFrame, dim: int, seed: int = 5) -> DataFrame:
    """``(kind, id, q, scale, u)`` of the usable vectors; null, all-zero, non-finite and other-length vectors are left out.

    ``u`` is the vector at unit length (floats), ``q`` its 8-bit code after a
    fixed rotation, which changes no cosine.
    """
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v")
            x = np.nan_to_num(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64), nan=np.inf).reshape(len(v), dim)
            with np.errstate(all="ignore"):
                top = np.abs(x).max(1)
                ok = np.isfinite(top) & (top > 0)
                x = x[ok] / top[ok, None]
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                u = x.astype(np.float32) + np.float32(0)  # no negative zeros: equal vectors have equal bytes
                y = x @ turn
                codes = np.rint(y / np.abs(y).max(1, keepdims=True) * 127).astype(np.int8)
            scale = (1 / np.linalg.norm(codes.astype(np.float32), axis=1)).astype(np.float32)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column("kind").filter(keep), b.column("id").filter(keep), _packed(codes), pa.array(scale), _packed(u)], names=["kind", "id", "q", "scale", "u"])

    usable = vectors.where(F.col("v").isNotNull() & (F.size("v") == dim) & ~F.exists("v", lambda e: e.isNull()))
    return usable.select(F.col("kind").cast("int"), F.col("id").cast("long"), F.col("v").cast("array<float>").alias("v")).mapInArrow(run, "kind int, id long, q binary, scale float, u binary")


def _top(node: np.ndarray, near: np.ndarray, sims: np.ndarray, k: int) -> pa.RecordBatch:
    """Lists of the k best distinct neighbours per node, from edges in any order."""
    order = np.lexsort((near, node))
    node, near, sims = node[order], near[order], sims[order]
    fresh = np.ones(len(node), bool)
    fresh[1:] = (node[1:] != node[:-1]) | (near[1:] != near[:-1])
    node, near, sims = node[fresh], near[fresh], sims[fresh]
    order = np.lexsort((near, -sims, node))
    node, near, sims = node[order], near[order], sims[order]
    heads = np.nonzero(np.concatenate([[True], node[1:] != node[:-1]]))[0] if len(node) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, len(node)))
    keep = np.arange(len(node)) - np.repeat(heads, sizes) < k
    offsets = np.concatenate([[0], np.cumsum(np.minimum(sizes, k))]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(node[heads], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(near[keep], pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(sims[keep], pa.float32()))], names=["node", "near", "sims"])


def _flat(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    near = pa.concat_arrays(t["near"].chunks)
    n = np.diff(near.offsets.to_numpy())
    return np.repeat(t["node"].to_numpy(), n), near.flatten().to_numpy(), pa.concat_arrays(t["sims"].chunks).flatten().to_numpy()


def _merge(lists: DataFrame, k: int, parts: int) -> DataFrame:
    """One list per node: the k best of all lists it has, merged task by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            out = _top(*_flat(pa.Table.from_batches(held)), k)
            for lo in range(0, out.num_rows, 10_000):
                yield out.slice(lo, 10_000)

    return lists.repartition(parts, "node").mapInArrow(run, LISTS)


def _placed(nodes: DataFrame, sub: int, rotations: np.ndarray) -> DataFrame:
    """``(node, q, scale, key)``: each node in two buckets of every table; the low six bits of a key hold the kind."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = _codes(_unpack(b), rotations, sub)
                key = c.astype(np.int64) * 64 + (b.column("node").to_numpy() & 63)[:, None]
                offsets = np.arange(0, key.size + 1, key.shape[1]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, pa.array(key.ravel()))], names=[*b.schema.names, "keys"])

    return nodes.select("node", "q", "scale").mapInArrow(code, "node long, q binary, scale float, keys array<long>").select("node", "q", "scale", F.explode("keys").alias("key"))


def _sectors(n: int, dim: int, bucket: int) -> int:
    return max(1, round(2 * n / (2 * dim * bucket)))


def _lists(ids: np.ndarray, near: np.ndarray, sims: np.ndarray) -> pa.Table:
    m = near.shape[1] if near.ndim == 2 else 0
    offsets = (np.arange(len(ids) + 1) * m).astype(np.int32)
    return pa.table({"node": pa.array(ids, pa.int64()), "near": pa.ListArray.from_arrays(offsets, pa.array(near.ravel(), pa.int64())), "sims": pa.ListArray.from_arrays(offsets, pa.array(sims.ravel(), pa.float32()))})


_NONE = (np.zeros(0, np.int64), np.zeros((0, 1), np.int64), np.zeros((0, 1), np.float32))


def _split_crowded(placed: DataFrame, dim: int, sub: int, tables: int, bucket: int, seed: int, scratch: Scratch, levels: int = 3) -> DataFrame:
    """``placed`` with a ``block``: a crowded bucket falls into parts by the direction in which its members leave its mean.

    Each table cuts by a rotation of its own, each member stands in the two parts
    nearest to it, so that what one cut parts another leaves together, and parts
    still crowded are cut again.  What is crowded after
    ``levels`` of this has no directions to tell apart; it is cut at random, each
    bucket differently, and the descent joins what that parts.
    """
    placed = placed.withColumn("block", F.lit(0).cast("long"))
    for level in range(levels):
        sizes = placed.groupBy("key", "block").count().where(F.col("count") > 4 * bucket)
        crowded = scratch.keep(sizes.select("key", "block", "count"))
        if not crowded.head(1):
            return placed
        turns = _rotations(dim, tables, seed + 100 + level)
        inside = scratch.keep(placed.join(crowded, ["key", "block"]))
        sums = scratch.keep(_means(inside, dim))

        def part(batches: Iterator[pa.RecordBatch], turns=turns) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    off = _unpack(b) - _exact(b, "mean")
                    codes = np.empty((b.num_rows, 2), np.int64)
                    each = np.stack([b.column("count").to_numpy(), (b.column("key").to_numpy() >> 6) // (2 * dim * (sub + 2))], 1)
                    for size, t in np.unique(each, axis=0).tolist():
                        at = (each == (size, t)).all(1)
                        codes[at] = _codes(off[at], turns[2 * t : 2 * t + 2], max(1, round(2 * size / (2 * dim * bucket))))
                    # parts keep the bucket they come from
                    block = (b.column("block").to_numpy()[:, None] * 1_000_003 + codes + 1) & ((1 << 62) - 1)
                    offsets = np.arange(0, codes.size + 1, 2).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "q", "scale", "key")), pa.ListArray.from_arrays(offsets, pa.array(block.ravel()))], names=["node", "q", "scale", "key", "blocks"])

        cut = inside.join(sums, ["key", "block"]).mapInArrow(part, "node long, q binary, scale float, key long, blocks array<long>").select("node", "q", "scale", "key", F.explode("blocks").alias("block"))
        placed = scratch.keep(placed.join(crowded.select("key", "block"), ["key", "block"], "left_anti").select("node", "q", "scale", "key", "block").unionByName(cut))
    sizes = placed.groupBy("key", "block").count().where(F.col("count") > 4 * bucket).select("key", "block", F.ceil(F.col("count") / (2 * bucket)).cast("long").alias("parts"))
    at = F.when(F.col("parts").isNull(), F.col("block")).otherwise(F.xxhash64("key", "block", F.pmod(F.xxhash64("node", "key", "block"), F.col("parts"))))
    return placed.join(scratch.keep(sizes), ["key", "block"], "left").select("node", "q", "scale", "key", at.alias("block"))


def _means(inside: DataFrame, dim: int) -> DataFrame:
    """``(key, block, mean)``: the mean vector of each part; tasks add up what they hold, so a crowded part is no task of its own."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                x = np.concatenate([_unpack(b).astype(np.float64), np.ones((b.num_rows, 1))], 1)
                pairs, which = np.unique(np.stack([b.column("key").to_numpy(), b.column("block").to_numpy()], 1), axis=0, return_inverse=True)
                sums = np.zeros((len(pairs), dim + 1))
                np.add.at(sums, which.ravel(), x)
                for pair, row in zip(map(tuple, pairs.tolist()), sums):
                    total[pair] = total.get(pair, 0) + row
        keys = np.array(list(total), np.int64).reshape(-1, 2)
        rows = [r.tolist() for r in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(rows, pa.list_(pa.float64()))], names=["key", "block", "s"])

    def close(t: pa.Table) -> pa.Table:
        s = np.array(t["s"].to_pylist()).sum(0)
        return pa.table({"key": t["key"][:1], "block": t["block"][:1], "mean": _packed((s[:dim] / s[dim])[None].astype(np.float32))})

    return inside.mapInArrow(add, "key long, block long, s array<double>").groupBy("key", "block").applyInArrow(close, "key long, block long, mean binary")


def _start(nodes: DataFrame, n: int, dim: int, k: int, tables: int, bucket: int, seed: int, scratch: Scratch, parts: int) -> DataFrame:
    sub = _sectors(n, dim, bucket)
    placed = _split_crowded(_placed(nodes, sub, _rotations(dim, tables, seed)), dim, sub, tables, bucket, seed, scratch)

    most = max(1, k // 2)  # of each bucket; a node meets its mates in many

    def mates(t: pa.Table) -> pa.Table:
        if t.num_rows < 2:
            return _lists(*_NONE)
        x, ids = _unpack(t), t["node"].to_numpy()
        m = min(most, len(ids) - 1)
        near, sims = [], []
        for lo in range(0, len(ids), 512):
            s = x[lo : lo + 512] @ x.T
            s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
            at = np.argpartition(s, len(ids) - m, axis=1)[:, -m:]
            near.append(ids[at])
            sims.append(np.take_along_axis(s, at, 1))
        return _lists(ids, np.concatenate(near), np.concatenate(sims))

    first = placed.groupBy("key", "block").applyInArrow(mates, LISTS)
    return scratch.keep(_merge(first, k, parts))


def _local_join(sent: DataFrame, parts: int) -> DataFrame:
    """All pairs of vectors that met at a node, one of them new there, kept where they beat the worst neighbour of their receiver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def pairs(t: pa.Table, heads: np.ndarray) -> Iterator[pa.RecordBatch]:
            sizes = np.diff(heads)
            x, node, worst, new = _unpack(t), t["node"].to_numpy(), t["worst"].to_numpy(), t["new"].to_numpy(zero_copy_only=False)
            for m in np.unique(sizes):
                if m < 2:
                    continue
                at = heads[:-1][sizes == m]
                for lo in range(0, len(at), max(1, 400_000 // (m * m))):
                    rows = at[lo : lo + max(1, 400_000 // (m * m)), None] + np.arange(m)
                    g = x[rows]
                    s = g @ g.transpose(0, 2, 1)
                    s[:, np.arange(m), np.arange(m)] = -np.inf
                    b, i, j = np.nonzero((s > worst[rows][:, :, None]) & (new[rows][:, :, None] | new[rows][:, None, :]))
                    if len(b):
                        yield _top(node[rows[b, i]], node[rows[b, j]], s[b, i, j].astype(np.float32), 1 << 30)

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
            at = t["at"].to_numpy()
            heads = np.nonzero(np.concatenate([[True], at[1:] != at[:-1]]))[0]
            yield from pairs(t.slice(0, heads[-1]).combine_chunks(), heads) if heads[-1] else ()
            rest = t.slice(heads[-1])
        if rest is not None:
            yield from pairs(rest.combine_chunks(), np.array([0, rest.num_rows]))

    return sent.repartition(parts, "at").sortWithinPartitions("at").mapInArrow(run, LISTS)


def _listed_by(edges: DataFrame, order: Column, most: int) -> DataFrame:
    """``(to, from)`` of ``(to, node, ...)``: the first ``most`` nodes in ``order`` that list a node, as structs; a much-listed node is thinned in 64 shares first."""
    few = F.slice(F.array_sort(F.collect_list("from")), 1, most).alias("from")
    marked = edges.select("to", F.struct(order.alias("o"), *[F.col(c) for c in edges.columns if c != "to"]).alias("from"))
    thin = marked.groupBy("to", F.pmod(F.xxhash64("from.node"), F.lit(64)).alias("share")).agg(few).select("to", F.explode("from").alias("from"))
    return thin.groupBy("to").agg(few)


_NO_IDS = "CAST(array() AS array<long>)"


def descend(nodes: DataFrame, n: int, dim: int, k: int, width: int, rounds: int, least: float, tables: int, bucket: int, seed: int, scratch: Scratch) -> DataFrame:
    """``(node, near, sims)``: the neighbour graph over ``(node, q, scale)``."""
    spark = nodes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 100_000)
    start = _start(nodes, n, dim, k, tables, bucket, seed, scratch, parts)
    graph = start.withColumn("fresh", F.transform("near", lambda x: F.lit(True)))
    changed = n * k
    for round_no in range(rounds):
        lists = graph.select("node", F.explode(F.slice(F.arrays_zip("near", "fresh"), 1, width)).alias("e")).select("node", F.col("e.near").alias("to"), F.col("e.fresh").alias("fresh"))
        # who lists me: the reverse neighbours, of which NN-descent takes a random few per round
        back = _listed_by(lists, F.xxhash64("node", F.lit(round_no)), width).select(
            F.col("to").alias("node"), F.col("from.node").alias("back"), F.transform(F.filter("from", lambda f: f["fresh"]), lambda f: f["node"]).alias("back_new"))
        mail = nodes.join(graph, "node").join(back, "node", "left")
        near, flags = F.slice("near", 1, width), F.slice("fresh", 1, width)
        none = F.expr(_NO_IDS)
        news = F.concat(F.filter(near, lambda x, i: F.get(flags, i)), F.coalesce("back_new", none))
        to = F.transform(F.array_distinct(F.concat(near, F.coalesce("back", none))), lambda a: F.struct(a.alias("at"), F.array_contains("news", a).alias("new")))
        worst = F.when(F.size("near") < k, F.lit(-2.0)).otherwise(F.element_at("sims", -1)).cast("float")
        sent = mail.withColumn("news", news).select("node", "q", "scale", worst.alias("worst"), F.explode(to).alias("t")).select("node", "q", "scale", "worst", "t.at", "t.new")
        if changed < 0.2 * n * k:  # nodes around which nothing is new get no mail
            touched = lists.where("fresh")
            awake = scratch.keep(touched.select(F.col("node").alias("at")).unionByName(touched.select(F.col("to").alias("at"))).distinct())
            sent = sent.join(F.broadcast(awake) if awake.count() <= 500_000 else awake, "at", "left_semi").select("node", "q", "scale", "worst", "at", "new")
        better = _local_join(sent, parts)
        merged = _merge(graph.select("node", "near", "sims").unionByName(better), k, parts)
        old = graph.select("node", F.col("near").alias("old"))
        new = scratch.keep(merged.join(old, "node").select("node", "near", "sims", F.transform("near", lambda x: ~F.array_contains("old", x)).alias("fresh")))
        changed = new.agg(F.sum(F.size(F.filter("fresh", lambda f: f)))).first()[0] or 0
        scratch.drop(start if round_no == 0 else graph)
        graph = new
        if changed < least * n * k:
            break
    return graph.select("node", "near", "sims")


def rescored(lists: DataFrame, nodes: DataFrame, askers: DataFrame, k: int) -> DataFrame:
    """``lists`` with every similarity taken from the unit vectors ``u`` of ``askers`` and ``nodes``, best first."""

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                one = np.einsum("ij,ij->i", _exact(b, "au"), _exact(b)).astype(np.float32)
                yield from _lists(b.column("asker").to_numpy(), b.column("node").to_numpy()[:, None], one[:, None]).to_batches()

    pairs = lists.select(F.col("node").alias("asker"), F.explode("near").alias("node")).where("asker <> node")
    both = askers.select(F.col("node").alias("asker"), F.col("u").alias("au"))
    met = pairs.join(nodes.select("node", "u"), "node").join(both, "asker").select("asker", "node", "au", "u")
    return _merge(met.mapInArrow(dots, LISTS), k, int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def tables_for(n: int) -> int:
    """Start tables: nine up to 200,000 vectors, and nine more for each tenfold of that, as a bucket's share of the whole falls."""
    return max(9, round(9 * (1 + np.log10(max(n, 1) / 200_000))))


def nodes_of(vectors: DataFrame, dim: int = 64) -> tuple[DataFrame, DataFrame]:
    """``(members, nodes)`` of ``vectors`` = ``(kind, id, v)``, kind 0..63.

    ``members``: ``(node, kind, id)``, one row per usable vector; rows with equal
    vectors share a node (copies need not be compared).  Null, all-zero,
    non-finite and wrong-length vectors are in neither.  Length does not matter.
    """
    scratch = Scratch(vectors.sparkSession, "nodes")
    coded = scratch.keep(encode(vectors, dim))
    keyed = F.shiftleft(F.min("id"), 6) + F.col("kind")
    nodes = scratch.keep(coded.groupBy("kind", "u").agg(keyed.alias("node"), F.first("q").alias("q"), F.first("scale").alias("scale"), F.count(F.lit(1)).alias("copies")))
    several = nodes.where("copies > 1").select("kind", "u", F.col("node").alias("shared"))
    own = F.shiftleft("id", 6) + F.col("kind")
    members = scratch.keep(coded.join(several, ["kind", "u"], "left").select(F.coalesce("shared", own).alias("node"), "kind", "id"))
    scratch.drop(coded)
    return members, nodes.select("node", "q", "scale", "u")


def graph_of(nodes: DataFrame, dim: int = 64, k: int = 16, width: int = 16, rounds: int = 10, least: float = 0.02, tables: int | None = None, bucket: int = 2048, seed: int = 5) -> DataFrame:
    """``(node, near, sims)``: the ``k`` nearest nodes of each by cosine, best first.

    A list somewhat longer than wanted makes the descent surer.  ``sims`` are
    cosines of the vectors themselves, not of codes.  A list that stayed shorter
    than there are nodes of its kind is made by comparing with all of them.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "neighbours")
    kind = F.col("node").bitwiseAND(63)
    sizes = {r["kind"]: r["n"] for r in nodes.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 64
    n = sum(sizes.values())
    if n < 2:
        return spark.createDataFrame([], LISTS)
    graph = descend(nodes.select("node", "q", "scale"), n, dim, k, width, rounds, least, tables or tables_for(n), bucket, seed, scratch)
    spark.sparkContext._jvm.System.gc()  # the shuffle files of the descent go before those of the scores come
    exact = scratch.keep(rescored(graph, nodes, nodes, k))
    scratch.drop(graph)
    full = F.least(F.lit(k), F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[kind] - 1)
    have = exact.select("node", F.size("near").alias("have"))
    short = scratch.keep(nodes.join(have, "node", "left").where(F.coalesce("have", F.lit(0)) < full).select("node", "u"))
    if not short.head(1):
        return exact
    return exact.join(short, "node", "left_anti").unionByName(exact_search(nodes, short, k))


def neighbour_graph(vectors: DataFrame, dim: int = 64, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(graph, members, nodes)``, see ``graph_of`` and ``nodes_of``.  Empty input gives empty results."""
    members, nodes = nodes_of(vectors, dim)
    return graph_of(nodes, dim, **options), members, nodes


def graph_search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, dim: int = 64, k: int = 10, beam: int = 80, width: int = 32, hops: int = 3, tables: int | None = None, bucket: int = 4096, seed: int = 5) -> DataFrame:
    """``(node, near, sims)`` per query ``(node, q, scale, u)``: the ``k`` most similar nodes, found by greedy search of the graph.

    The search starts from the best bucket mates in ``tables`` tables (two fifths of
    those of the graph).  In each hop the ``width`` best nodes of the beam that
    were not opened yet are opened: those they list, and the best of those that
    list them, are compared with the query, and the ``beam`` best stay.  A query
    need not be a node; one that is does not find itself, and its own list is
    not looked at.  Queries without a mate find nothing.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "search")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = nodes.count()
    sub, rotations = _sectors(n, dim, bucket), _rotations(dim, tables or max(4, round(0.4 * tables_for(n))), seed)
    askers = scratch.keep(queries.select("node", "q", "scale", "u"))
    queries = askers.select("node", "q", "scale")
    edges = graph.select("node", F.explode(F.arrays_zip("near", "sims")).alias("e")).select("node", F.col("e.near").alias("to"), F.col("e.sims").alias("sim"))
    back = _listed_by(edges, -F.col("sim"), 12).select(F.col("to").alias("node"), F.transform("from", lambda f: f["node"]).alias("back"))
    linked = scratch.keep(graph.select("node", "near").join(back, "node", "left").select("node", F.array_union("near", F.coalesce("back", F.expr(_NO_IDS))).alias("near")))

    def score(asked: pa.Table, there: pa.Table) -> pa.Table:
        if not asked.num_rows or not there.num_rows:
            return _lists(*_NONE)
        x, ids, y, mine = _unpack(asked), asked["node"].to_numpy(), _unpack(there), there["node"].to_numpy()
        m = min(beam + 1, len(mine))
        near, sims = [], []
        for lo in range(0, len(ids), 512):
            s = x[lo : lo + 512] @ y.T
            s[ids[lo : lo + 512, None] == mine[None, :]] = -2
            at = np.argpartition(s, len(mine) - m, axis=1)[:, -m:]
            near.append(mine[at])
            sims.append(np.take_along_axis(s, at, 1))
        return _lists(ids, np.concatenate(near), np.concatenate(sims))

    placed, asked = _placed(nodes, sub, rotations), _placed(queries, sub, rotations)
    crowded = scratch.keep(placed.groupBy("key").count().where(F.col("count") > 4 * bucket).select("key", F.ceil(F.col("count") / (4 * bucket)).cast("int").alias("blocks")))
    if crowded.head(1):  # a crowded bucket is compared in blocks, all of them with every query
        blocks = F.coalesce("blocks", F.lit(1))
        asked = asked.join(crowded, "key", "left").select("node", "q", "scale", "key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
        placed = placed.join(crowded, "key", "left").select("node", "q", "scale", "key", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    else:
        placed, asked = placed.withColumn("block", F.lit(0)), asked.withColumn("block", F.lit(0))
    mates = asked.groupBy("key", "block").cogroup(placed.groupBy("key", "block")).applyInArrow(score, LISTS)
    found = scratch.keep(_merge(mates, beam, parts))
    opened = None

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = _unpack(b)
                x = _unpack(b.select(["aq", "ascale"]).rename_columns(["q", "scale"]))
                one = np.einsum("ij,ij->i", x, y).astype(np.float32)
                good = one > b.column("worst").to_numpy()  # the rest would fall off the beam
                if good.any():
                    yield _top(b.column("asker").to_numpy()[good], b.column("node").to_numpy()[good], one[good], 1 << 30)

    ask = queries.select(F.col("node").alias("asker"), F.col("q").alias("aq"), F.col("scale").alias("ascale"))
    for _ in range(hops):
        worst = F.when(F.size("near") < beam, F.lit(-2.0)).otherwise(F.element_at("sims", -1)).cast("float").alias("worst")
        beamed = found.select(F.col("node").alias("asker"), worst, F.posexplode("near").alias("pos", "node"))
        if opened is not None:
            beamed = beamed.join(opened, ["asker", "node"], "left_anti")
        best = beamed.groupBy("asker", "worst").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "node"))), 1, width).alias("b"))  # lists of at most the beam
        front = scratch.keep(best.select("asker", "worst", F.explode("b.node").alias("node")))
        seen = front.select("asker", "node")
        opened = seen if opened is None else opened.unionByName(seen)
        reach = front.join(linked, "node").select("asker", "worst", F.explode("near").alias("node")).where("asker <> node")
        pairs = reach.join(nodes.select("node", "q", "scale"), "node").join(ask, "asker").select("asker", "worst", "node", "q", "scale", "aq", "ascale")
        last = found
        found = scratch.keep(_merge(last.unionByName(pairs.mapInArrow(compare, LISTS)), beam, parts))
        scratch.drop(last)
        spark.sparkContext._jvm.System.gc()  # a hop's shuffle files go before those of the next come
    # codes are nearly exact: the better half of the beam is scored on the vectors themselves before it is cut
    half = F.lit(max(k, beam // 2))
    return rescored(found.select("node", F.slice("near", F.lit(1), half).alias("near"), F.slice("sims", F.lit(1), half).alias("sims")), nodes, askers, k)


def exact_search(nodes: DataFrame, queries: DataFrame, k: int = 10, block: int = 2048) -> DataFrame:
    """``(node, near, sims)`` by comparing the unit vector of every query ``(node, u)`` with all nodes of its kind, in blocks: the measure for recall.

    Queries are salted into blocks and nodes into as many shares as keep a pair
    of blocks small; every query meets every share once.
    """
    spark = nodes.sparkSession
    queries = Scratch(spark, "exact").keep(queries.select("node", "u"))
    n, m = nodes.count(), queries.count()
    shares, groups = max(1, n // 20_000), max(1, m // block)

    def score(asked: pa.Table, there: pa.Table) -> pa.Table:
        if not asked.num_rows or not there.num_rows:
            return _lists(*_NONE)
        x, ids, y, mine = _exact(asked), asked["node"].to_numpy(), _exact(there), there["node"].to_numpy()
        t = min(k + 1, len(mine))  # the query itself may be among them
        near, sims = [], []
        for lo in range(0, len(ids), 256):
            s = x[lo : lo + 256] @ y.T
            s[ids[lo : lo + 256, None] == mine[None, :]] = -2  # below any cosine
            at = np.argpartition(s, len(mine) - t, axis=1)[:, -t:]
            near.append(mine[at])
            sims.append(np.take_along_axis(s, at, 1))
        flat, cos = np.concatenate(near).ravel(), np.concatenate(sims).ravel()
        asker = np.repeat(ids, t)
        other = asker != flat
        return pa.Table.from_batches([_top(asker[other], flat[other], cos[other], k)])

    kind = F.col("node").bitwiseAND(63).alias("kind")
    a = queries.select("node", "u", kind, F.pmod(F.xxhash64("node"), F.lit(groups)).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("s"))
    b = nodes.select("node", "u", kind, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), F.pmod(F.xxhash64("node", F.lit(1)), F.lit(shares)).cast("int").alias("s"))
    met = a.groupBy("kind", "g", "s").cogroup(b.groupBy("kind", "g", "s")).applyInArrow(score, LISTS)
    return _merge(met, k, int(spark.conf.get("spark.sql.shuffle.partitions")))


def similar_links(graph: DataFrame, least: float) -> DataFrame:
    """``(a, b)``, a < b: nodes with similarity of at least ``least``; with the members of each node these stand for all pairs of rows."""
    edges = graph.select("node", F.explode(F.arrays_zip("near", "sims")).alias("e")).where(F.col("e.sims") >= least)
    return edges.select(F.least("node", "e.near").alias("a"), F.greatest("node", "e.near").alias("b")).distinct()


def similar_pairs(graph: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """``(kind, id_a, id_b)``: pairs of rows with similarity of at least ``least``, copies of a node included.

    As many rows as there are pairs: where a vector is filed m times these are
    m (m - 1) / 2, and ``similar_links`` with the members says the same in m.
    """
    twins = members.groupBy("node").count().where("count > 1").select(F.col("node").alias("a"), F.col("node").alias("b"))
    ma = members.select(F.col("node").alias("a"), "kind", F.col("id").alias("x"))
    mb = members.select(F.col("node").alias("b"), F.col("id").alias("y"))
    both = similar_links(graph, least).unionByName(twins).join(ma, "a").join(mb, "b").where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return both.select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
