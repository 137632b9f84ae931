"""Problem 7: mix sources to target weights (pivotal dependent rounding).

Every record of a source is due the same fractional number of copies.  The
whole part is given; the fractional parts are rounded by the pivotal method:
two fractional records meet, mass moves between them at random until one is 0
or 1, the other goes on to meet the next.  Records are dealt to blocks by a hash
of their id, each block leaves at most one fractional record per source, and
those residuals are combined in a reduction tree of bounded fan-in.  The number
of extra copies a source gets is thereby exact to one record.  Blocks, order and
random numbers follow from ids and the number of records alone, so every
cluster gives the same mix.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public split pattern of byte-level BPE vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EPS = 1e-12
_GAP = re.compile(r"(?<=\S)\s")


def _encoder(path: str):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def spans(text: str, size: int = 100_000) -> Iterator[str]:
    """The text in spans of about ``size`` characters whose tokens together are those of the whole.

    Each ends before white space that follows a visible character, where the
    split pattern always ends a piece.  A longer run without such a place stays whole.
    """
    at = 0
    while len(text) - at > size:
        gap = _GAP.search(text, at + size)
        if not gap:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def count_tokens(docs: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(id, source, tokens)`` with the source in its clean spelling; a null text has no tokens, whole texts are read.

    ``tokenizer`` is a vocabulary file of the driver; it is sent to the workers.
    """
    docs.sparkSession.sparkContext.addFile(tokenizer)
    name = Path(tokenizer).name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        enc = _encoder(SparkFiles.get(name))
        for b in batches:
            n = [sum(len(enc.encode_ordinary(s)) for s in spans(t)) if t else 0 for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], b["source"], pa.array(n, pa.int64())], names=["id", "source", "tokens"])

    clean = F.lower(F.trim(F.col(source_col)))
    return docs.select(F.col(id_col).cast("long").alias("id"), clean.alias("source"), F.col(text_col).alias("text")).mapInArrow(run, "id long, source string, tokens long")


def mixture_size(sources: Iterable[tuple[float, float]], most: float, over: float) -> float:
    """The largest size up to ``most`` at which no source stands above its share by more than ``over``.

    ``sources`` is ``(share, tokens it can give at most)``.  At a size T every
    source gives share * T or all it can; what the exhausted ones lack lifts the
    shares of the others, and the less the smaller T is.  Sources that can give
    nothing lift them at any size and are left out of the measure.
    """
    givers = sorted((cap / share, cap, share) for share, cap in sources if share > 0 and cap > 0)
    rest = sum(share for _, _, share in givers)
    floor = rest / (1 + over) - EPS
    full = 0.0
    for at, cap, share in givers:
        if full + rest * at < floor * at:
            break
        full += cap
        rest -= share
    return min(most, full / (floor - rest)) if floor > rest else most


def source_report(sizes: DataFrame, targets: DataFrame, over: float | None = None) -> DataFrame:
    """One row per target source: tokens, copies due per record, whether it can be reached.

    The mixture is as large as all texts of all sources together, or with
    ``over`` as ``mixture_size`` says.  ``reachable`` is judged at the former size.
    Sources without a target get no copies; a target without records can't be
    reached unless its share is 0.  A source named twice adds its shares, with
    the smaller cap; a null share is 0, a null cap 1.
    """
    per = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("records"))
    total = per.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    t = targets.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    have = F.coalesce(F.col("tokens"), F.lit(0)).cast("long")
    scratch = Scratch(sizes.sparkSession, "report")
    known = scratch.keep(t.join(per, "source", "left").crossJoin(F.broadcast(total))  # total is one row
                         .select("source", "target_share", "max_repeats", have.alias("tokens"), F.coalesce("records", F.lit(0)).alias("records"), "total"), 1)
    size = F.col("total").cast("double")
    if over is not None:
        rows = known.collect()  # one row per target source
        most = float(rows[0]["total"]) if rows else 0.0
        size = F.lit(mixture_size([(r["target_share"], float(r["tokens"] * r["max_repeats"])) for r in rows], most, over))
    due = F.col("target_share") * size
    return known.select("*", (F.col("tokens") * F.col("max_repeats") >= F.col("target_share") * F.col("total")).alias("reachable"),
                        F.when(F.col("tokens") > 0, F.least(due / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0)).alias("copies_due"))


def pivot(records: list[tuple], rng: random.Random) -> tuple[list[tuple], tuple | None]:
    """One pass of the pivotal method over ``(id, p, ...)``; decided ``(id, 0|1)`` and the one left fractional, if any."""
    decided, held = [], None
    for rec in records:
        if rec[1] <= EPS or rec[1] >= 1 - EPS:
            decided.append((rec[0], round(rec[1])))
            continue
        if held is None:
            held = rec
            continue
        a, b = held[1], rec[1]
        s = a + b
        if s < 1:  # one gives all its mass to the other
            if rng.random() * s < b:
                decided.append((held[0], 0))
                held = (rec[0], s, *rec[2:])
            else:
                decided.append((rec[0], 0))
                held = (held[0], s, *held[2:])
        else:  # one is filled to 1 by the other
            if rng.random() * (2 - s) < 1 - b:
                decided.append((held[0], 1))
                held = (rec[0], s - 1, *rec[2:])
            else:
                decided.append((rec[0], 1))
                held = (held[0], s - 1, *held[2:])
        if held[1] <= EPS or held[1] >= 1 - EPS:
            decided.append((held[0], round(held[1])))
            held = None
    return decided, held


_OUT = ["id", "source", "tokens", "copies", "p", "block"]
_SCHEMA = "id long, source string, tokens long, copies int, p double, block long"


def _runs(seed: int, level: int, last: bool):
    """Pivots sorted rows run by run, a run being one source in one block; runs may stretch over batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, rng = None, None, random.Random(0)

        def closing() -> list[tuple]:
            if held is None:
                return []
            i, p, source, tokens, copies, block = held
            if last:
                return [(i, source, tokens, copies + int(rng.random() < p), None, block)]
            return [(i, source, tokens, copies, p, block)]

        for pdf in batches:
            out: list[tuple] = []
            rows = list(zip(pdf["id"].tolist(), pdf["p"].tolist(), pdf["source"].tolist(), pdf["tokens"].tolist(), pdf["copies"].tolist(), pdf["block"].tolist()))
            lo = 0
            while lo < len(rows):
                key = (rows[lo][5], rows[lo][2])
                hi = lo
                while hi < len(rows) and (rows[hi][5], rows[hi][2]) == key:
                    hi += 1
                if key != at:
                    out += closing()
                    at, held, rng = key, None, random.Random(f"{seed}|{level}|{key}")
                # decided rows name their place, so repeated ids stay apart
                part = ([held] if held else []) + rows[lo:hi]
                decided, left = pivot([(k, r[1]) for k, r in enumerate(part)], rng)
                out += [(part[k][0], part[k][2], part[k][3], part[k][4] + x, None, part[k][5]) for k, x in decided]
                held = (part[left[0]][0], left[1], *part[left[0]][2:]) if left else None
                lo = hi
            yield pd.DataFrame(out, columns=_OUT)
        yield pd.DataFrame(closing(), columns=_OUT)

    return run


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 7, fan_in: int = 16, over: float | None = None, per_block: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """``(copies, report)``: how often each record is used, and the shares reached.

    ``sizes`` is ``count_tokens``' result.  ``copies`` keeps every row of
    ``sizes`` (records of size 0, of an unknown or null source: 0 copies) and
    never exceeds ``max_repeats``.  Records of like size meet first, so moving
    a copy between them hardly changes the tokens.  ``over`` chooses the size of
    the mixture, see ``source_report``; a source exhausted at that size is used
    up and stays below its share.
    """
    scratch = Scratch(sizes.sparkSession, "mixing")
    sizes = scratch.keep(sizes)
    report = scratch.keep(source_report(sizes, targets, over), 1)
    due = report.select("source", F.floor("copies_due").cast("int").alias("whole"), (F.col("copies_due") - F.floor("copies_due")).alias("p"))
    recs = sizes.join(F.broadcast(due), "source", "left")  # due: one row per target source
    live = F.col("tokens") > 0
    blocks = max(1, -(-sizes.count() // per_block))
    rest = recs.select("id", "source", "tokens", F.when(live, F.coalesce("whole", F.lit(0))).otherwise(0).alias("copies"), F.when(live, F.coalesce("p", F.lit(0.0))).otherwise(0.0).alias("p"),
                       F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(blocks)).alias("block"))
    done: list[DataFrame] = []
    level = 0
    while True:
        ordered = rest.repartition(blocks, "block").sortWithinPartitions("block", "source", "tokens", "id")
        step = scratch.keep(ordered.mapInPandas(_runs(seed, level, blocks == 1), _SCHEMA))
        done.append(step.where("p IS NULL"))
        if blocks == 1:
            break
        # each block holds at most one open record per source: ``fan_in`` of them go on as one
        blocks, level = -(-blocks // fan_in), level + 1
        rest = step.where("p IS NOT NULL").withColumn("block", F.floor(F.col("block") / fan_in).cast("long"))
    copies = done[0]
    for d in done[1:]:
        copies = copies.unionByName(d)
    copies = copies.select("id", "source", "tokens", "copies")
    used = copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    whole = used.agg(F.sum("used_tokens").alias("all_used"))
    reached = (
        report.join(used, "source", "left").crossJoin(F.broadcast(whole))  # one row
        .withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
        .withColumn("share_reached", F.when(F.col("all_used") > 0, F.col("used_tokens") / F.col("all_used")).otherwise(0.0))
        .drop("all_used", "total")
    )
    return copies, reached


def short_sources(copies: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source)``: target sources all of whose records are used as often as allowed and that still miss their share of all tokens.

    ``copies`` is a mix as large as all texts (``over=None``).
    """
    per = copies.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.min(F.when(F.col("tokens") > 0, F.col("copies"))).alias("least"))
    total = per.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    t = targets.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("cap"))
    held = t.join(per, "source", "left").crossJoin(F.broadcast(total))  # one row
    return held.where((F.coalesce("used", F.lit(0)) < F.col("share") * F.col("total")) & (F.col("least").isNull() | (F.col("least") >= F.col("cap")))).select("source")
