"""Problem 1: fill fixed-capacity requests with chunks (hierarchical residual packing).

Each scan partition packs its own items best-fit decreasing, block by block, and
emits the nearly full bins.  Under-full bins travel on as items of their own
(their fill is their size) up a tree: each level joins ``fan_in`` tasks of the
one below into one, packs what they passed on, and passes on the emptiest of
what is still under-full, a bounded number, until one task is left.
Only (id, piece, size) leaves the JVM, never a text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import Scratch

BLOCK = 200_000
_BIN = T.StructType([
    T.StructField("closed", T.BooleanType()),
    T.StructField("request_id", T.LongType()),
    T.StructField("fill", T.IntegerType()),
    T.StructField("ids", T.ArrayType(T.LongType())),
    T.StructField("pieces", T.ArrayType(T.IntegerType())),
    T.StructField("costs", T.ArrayType(T.IntegerType())),
    T.StructField("node", T.IntegerType()),
])


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing; bins as lists of item positions, deterministic for a given order.

    Open bins stand in stacks by free space and a bit mask says which stacks
    hold any, so finding the tightest bin is one bit operation.
    """
    order = np.argsort(-sizes, kind="stable")
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    mask = 0
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            stack = stacks[free]
            at = stack.pop()
            if not stack:
                mask &= ~(1 << free)
            bins[at].append(i)
            free -= size
        else:
            at, free = len(bins), capacity - size
            bins.append([i])
        if free:
            stacks[free].append(at)
            mask |= 1 << free
    return bins


def _packer(capacity: int, slack: int, round_no: int, last: bool, pass_on: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        node = TaskContext.get().partitionId()
        base = (round_no << 56) | (node << 32)
        made = 0
        held: list[pa.RecordBatch] = []

        def pack() -> pa.RecordBatch:
            nonlocal made
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            fill = t["fill"].to_numpy()
            lists = [t[c].combine_chunks() for c in ("ids", "pieces", "costs")]
            lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
            starts = lists[0].offsets.to_numpy()
            counts = np.diff(starts)
            bins = best_fit(fill, capacity)
            order = np.fromiter((i for b in bins for i in b), np.int64)
            per_bin = np.fromiter((len(b) for b in bins), np.int64, len(bins))
            first = np.concatenate([[0], np.cumsum(per_bin)[:-1]])
            total = np.add.reduceat(fill[order], first)
            n = counts[order]
            take = np.arange(n.sum()) + np.repeat(starts[order] - (np.cumsum(n) - n), n)
            offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(n, first))]).astype(np.int32)
            closed = np.ones(len(bins), bool) if last else total >= capacity - slack
            under = np.nonzero(~closed)[0]
            if len(under) > pass_on:  # the emptiest have the best chance to meet a mate
                closed[under[np.argsort(total[under], kind="stable")[pass_on:]]] = True
            values = [x.values.to_numpy(zero_copy_only=False)[take] for x in lists]
            arrays = [pa.array(closed), pa.array(base + made + np.arange(len(bins))), pa.array(total.astype(np.int32))]
            arrays += [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]
            arrays.append(pa.array(np.full(len(bins), node, np.int32)))
            made += len(bins)
            return pa.RecordBatch.from_arrays(arrays, names=_BIN.names)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                yield pack()
        if held:
            yield pack()

    return run


def pack_requests(items: DataFrame, id_col: str, text_col: str, capacity: int = 1024, chars_per_token: int = 4,
                  slack: int | None = None, open_per_task: int = 20_000, fan_in: int = 16) -> DataFrame:
    """Requests as ``(request_id, fill, ids, pieces, costs)``, one row per request.

    The size of an item is the characters of ``text_col`` div ``chars_per_token``
    (at least 1); any stored token count is ignored, as are further columns.
    An item above ``capacity`` becomes pieces 1..k, all full but the last; no
    other item is split.  Null texts have nothing to embed and are in no
    request; an empty text costs 1.  Repeated rows are items of their own.
    Empty input gives no requests.  ``slack``: bins with at most that much free
    count as nearly full (default capacity/128).  A task passes on at most
    ``open_per_task`` under-full bins for each block it packs; those beyond are
    requests as they are.
    """
    spark = items.sparkSession
    slack = capacity // 128 if slack is None else slack
    cost = F.greatest(F.floor(F.length(text_col) / chars_per_token), F.lit(1)).cast("long")
    k = F.ceil(F.col("cost") / capacity).cast("int")
    pieces = (
        items.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), cost.alias("cost"))
        .select("id", "cost", k.alias("k"), F.explode(F.sequence(F.lit(1), k)).alias("piece"))
        .select("id", "piece", F.when(F.col("piece") < F.col("k"), F.lit(capacity)).otherwise(F.col("cost") - (F.col("k") - 1) * capacity).cast("int").alias("c"))
    )
    bins = pieces.select(
        F.lit(False).alias("closed"), F.lit(0).cast("long").alias("request_id"), F.col("c").alias("fill"),
        F.array("id").alias("ids"), F.array("piece").alias("pieces"), F.array("c").alias("costs"), F.lit(0).alias("node"))
    scratch = Scratch(spark, "packing")
    done: list[DataFrame] = []
    round_no, parts = 0, 0
    while True:
        last = parts == 1
        out = scratch.keep(bins.mapInArrow(_packer(capacity, slack, round_no, last, open_per_task), _BIN))
        done.append(out.where("closed"))
        opened = out.where(~F.col("closed"))
        nodes = 0 if last else opened.agg(F.max("node")).first()[0]
        if last or nodes is None:
            break
        round_no, parts = round_no + 1, nodes // fan_in + 1
        bins = opened.repartition(parts, F.floor(F.col("node") / fan_in))
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result.drop("closed", "node")


def assignments(requests: DataFrame) -> DataFrame:
    """``(chunk_id, piece, request_id, tokens)``: one row per piece of a chunk."""
    zipped = F.explode(F.arrays_zip("ids", "pieces", "costs")).alias("m")
    return requests.select("request_id", zipped).select(
        F.col("m.ids").alias("chunk_id"), F.col("m.pieces").alias("piece"), "request_id", F.col("m.costs").alias("tokens"))
