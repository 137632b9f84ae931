"""Problem 6: held-out items leaking into a corpus (CGK embedding, bit-sampling LSH, edit verification).

Texts become sequences of normal words.  A case is an item of n words that
stands in a document with at most ``rate`` * n word edits, or a run of it that
still has ``run`` words when ``penalty`` are taken off for each edit.

Every window of ``run`` words (of a shorter item: all its words) is read by
random walks: at step t the walk writes the word it stands on and moves on by a
random bit of (t, word).  Windows few edits apart give outputs few positions
apart, so a few sampled positions agree with fair probability; ``plan`` computes
how many repetitions with other walks bring the recall of altered items to the
target.  What collides is verified by exact word alignment.

The corpus is read once, however many items there are: a task knows of the
items no more than two bit maps of bounded size, one of their words and one of
their window keys.  Windows that hit are joined to the table of item keys, and
only the words of documents with hits are shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch
from .lookalikes import CYRILLIC, CYRILLIC_AS, GREEK, GREEK_AS, INVISIBLE

_LOOKS = str.maketrans(GREEK + CYRILLIC, GREEK_AS + CYRILLIC_AS, INVISIBLE)
_ODD = re.compile(f"[{GREEK}{CYRILLIC}{INVISIBLE}]")
_BREAK = re.compile(r"(?<=\w)[-‐‑]\s*\n\s*(?=\w)")
_WORD = re.compile(r"[^\W_]+")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
WORD_BITS = 24
SLOT = 15


def normal_words(text: str) -> list[str]:
    """Words in case-folded, compatibility-composed form; look-alikes mapped, invisible characters and line-break hyphens gone."""
    if not text.isascii():
        if _ODD.search(text):
            text = text.translate(_LOOKS)
        text = unicodedata.normalize("NFKC", text)
    if "\n" in text:
        text = _BREAK.sub("", text)
    return _WORD.findall(text.casefold())


def word_code(word: str) -> int:
    """A positive 63-bit number for a word; 0 is left for words that no item has."""
    return (xxhash.xxh64_intdigest(word.encode("utf-8", "replace")) >> 1) or 1


# --- the LSH ---------------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _walks(repetitions: int, window: int, sampled: int, seed: int) -> tuple[tuple[int, frozenset[int]], ...]:
    """Per repetition the seed of its walk and the sampled steps; the walk over ``window`` words takes about twice as many steps."""
    rng = np.random.default_rng([seed, window])
    last = max(2 * window - 4, 1)
    return tuple((int(rng.integers(1, 1 << 62)), frozenset(rng.choice(last, min(sampled, last), replace=False).tolist())) for _ in range(repetitions))


def walk_keys(codes: np.ndarray, starts: np.ndarray, window: int, walk: tuple[int, frozenset[int]]) -> np.ndarray:
    """One key per window: the words its walk wrote at the sampled steps; many texts may stand in ``codes``."""
    seed, wanted = walk
    words = codes.astype(np.uint64)
    bits = _mix(words ^ np.uint64(seed))
    at = np.zeros(len(starts), np.int64)
    key = np.full(len(starts), np.uint64(seed))
    for t in range(max(wanted) + 1):
        here = starts + np.minimum(at, window - 1)
        if t in wanted:
            key = _mix(key * _GOLDEN + np.where(at < window, words[here], np.uint64(0)) + np.uint64(t + 1))
        at += ((bits[here] >> np.uint64(t % 64)) & np.uint64(1)).astype(np.int64)
    return (key >> np.uint64(1)).astype(np.int64)


@cache
def plan(target: float = 0.999, rate: float = 0.3, window: int = 18, sampled: int = 5, edits: int = 6, words: int = 60, trials: int = 4000, most: int = 64, seed: int = 11) -> tuple[int, float]:
    """``(repetitions, recall)``: the fewest walks that find the ``target`` share of items of ``words`` words at the worst edit rate.

    Estimated on ``trials`` random items of which each word is changed or dropped
    with probability ``rate``, with the walks and the bound the scan uses.
    """
    rng = np.random.default_rng(seed)
    walks = _walks(most, window, sampled, seed)
    cases = []
    for _ in range(trials):
        item = rng.integers(1, 1 << 62, words)
        fate = rng.random(words)
        other = np.where(fate < rate * 0.6, 0, item)[(fate < rate * 0.6) | (fate >= rate)]
        strange = np.concatenate([[0], np.cumsum(other == 0)])
        starts = np.nonzero(strange[window:] - strange[:-window] <= edits)[0] if len(other) >= window else np.zeros(0, np.int64)
        cases.append((item, other, starts))
    found = np.zeros(trials, bool)
    for r, walk in enumerate(walks):
        for i in np.nonzero(~found)[0]:
            item, other, starts = cases[i]
            if len(starts):
                found[i] = np.isin(walk_keys(other, starts, window, walk), walk_keys(item, np.arange(words - window + 1), window, walk)).any()
        if found.mean() >= target:
            return r + 1, float(found.mean())
    return most, float(found.mean())


# --- exact verification ----------------------------------------------------

def alignment(item: np.ndarray, region: np.ndarray, penalty: int = 3) -> int:
    """Exact best local alignment by word edits: matched words less ``penalty`` for each changed, dropped or added word."""
    ramp = penalty * np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    best = 0
    for word in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(region == word, 1, -penalty), row[1:] - penalty)
        row = np.maximum.accumulate(np.maximum(new, 0) + ramp) - ramp
        best = max(best, int(row.max()))
    return best


def distance(item: np.ndarray, region: np.ndarray) -> int:
    """Fewest word edits that turn the item into some stretch of the region."""
    ramp = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for j, word in enumerate(item):
        new = np.empty_like(row)
        new[0] = j + 1
        new[1:] = np.minimum(row[:-1] + (region != word), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row.min())


def verify(item: np.ndarray, region: np.ndarray, run: int, rate: float, penalty: int) -> tuple[int, int] | None:
    """``(score, edits)`` of a case, None for no case: the best run's score, and the edits of the whole item."""
    allowed = int(rate * len(item))
    a, b = item.tolist(), region.tolist()
    there = set(b)
    # what is in no place of the region costs an edit each
    whole = sum(w in there for w in a) >= len(a) - allowed
    if not whole:
        if len(a) < run:
            return None
        # m matches in e + 1 blocks hold m - 2(e + 1) triples, at least run - 2 where m - penalty * e >= run and penalty >= 2
        mine = set(zip(a, a[1:], a[2:]))
        if sum(t in mine for t in zip(b, b[1:], b[2:])) < run - 2:
            return None
    score, edits = alignment(item, region, penalty), distance(item, region)
    return (score, edits) if edits <= allowed or (len(item) >= run and score >= run) else None


# --- items -----------------------------------------------------------------

def _lines(text: str) -> list[str]:
    return [x.strip() for x in text.splitlines() if x.strip()]


def _digest(lines: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(lines).encode("utf-8", "replace")) >> 1


def passages(items: DataFrame, item_id: str, item_text: str, run: int) -> DataFrame:
    """``(item, ids, words)``: the distinct passages as word codes, with the ids they stand under.

    The lines texts open with are an instruction where two or more different
    passages follow them and none of these lines is a run in itself; the longest
    instruction is not part of the passage.  An item of nothing else has none.
    """
    texts = items.where(F.col(item_text).isNotNull()).groupBy(F.col(item_text).alias("text")).agg(F.array_sort(F.collect_list(F.col(item_id).cast("long"))).alias("ids"), F.min(F.xxhash64(item_text)).alias("item"))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for item, text in zip(b["item"].to_pylist(), b["text"].to_pylist()):
                lines = _lines(text)
                for j in range(1, len(lines) + 1):
                    if len(normal_words(lines[j - 1])) >= run:
                        break
                    rest = normal_words("\n".join(lines[j:]))
                    rows.append((item, j, _digest(lines[:j]), _digest(rest) if rest else None))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["item", "depth", "head", "rest"])

    opened = texts.select("item", "text").mapInArrow(heads, "item long, depth int, head long, rest long")
    shared = opened.groupBy("head").agg(F.min("rest").alias("a"), F.max("rest").alias("b")).where("a <> b").select("head")
    depth = opened.join(shared, "head", "left_semi").groupBy("item").agg(F.max("depth").alias("depth"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [[word_code(w) for w in normal_words("\n".join(_lines(t)[d:]))] for t, d in zip(b["text"].to_pylist(), b["depth"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["item"], b["ids"], pa.array(words, pa.list_(pa.int64()))], names=["item", "ids", "words"])

    whole = texts.join(depth, "item", "left").select("item", "ids", "text", F.coalesce("depth", F.lit(0)).alias("depth"))
    return whole.mapInArrow(coded, "item long, ids array<long>, words array<long>").where(F.size("words") > 0)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and where each list starts, with the end."""
    n = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n)])


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)


def item_keys(items: DataFrame, window: int, walks_of) -> DataFrame:
    """``(key, item)``: the keys of all windows of all items, in every repetition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, edge = _flat(b["words"])
            n, ids = np.diff(edge), b["item"].to_numpy()
            keys, owners = [], []
            for size in np.unique(np.minimum(n, window)).tolist():
                mine = np.nonzero(np.minimum(n, window) == size)[0]
                counts = n[mine] - size + 1
                starts = _ranges(edge[mine], counts)
                for walk in walks_of(size):
                    keys.append(walk_keys(codes, starts, size, walk))
                    owners.append(np.repeat(ids[mine], counts))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], names=["key", "item"])

    return items.select("item", "words").mapInArrow(run, "key long, item long").distinct()


def bit_map(numbers: DataFrame, bits: int) -> np.ndarray:
    """A bit map of 2^``bits`` bits with those of column ``h``'s low bits set; at most that much reaches the driver."""
    parts = int(numbers.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for b in batches:
            h = b["h"].to_numpy()
            order = np.argsort(h)
            h = h[order]
            for part in np.split(h, np.nonzero(np.diff(h >> SLOT))[0] + 1) if len(h) else ():
                seen.setdefault(int(part[0] >> SLOT), np.zeros(1 << SLOT, bool))[part & ((1 << SLOT) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array([np.packbits(v, bitorder="little").tobytes() for v in seen.values()], pa.binary())], names=["slot", "blob"])

    low = numbers.select(F.col("h").bitwiseAND((1 << bits) - 1).alias("h"))
    slots = low.repartition(parts, F.shiftright("h", SLOT)).mapInArrow(run, "slot long, blob binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in slots.toLocalIterator():
        at = row["slot"] << (SLOT - 3)
        out[at : at + (1 << (SLOT - 3))] |= np.frombuffer(row["blob"], np.uint8)
    return out


def _holds(bitmap: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    at = numbers & (len(bitmap) * 8 - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


# --- the scan --------------------------------------------------------------

def _hits(docs: DataFrame, shared, sizes: list[int], walks_of, edits: int) -> DataFrame:
    """``(row, doc_id, words, hits)`` of the documents with windows whose key some item has; words that no item has are 0."""

    class Codes(dict):
        def __init__(self, known: np.ndarray):
            super().__init__()
            self.known = known

        def __missing__(self, word: str) -> int:
            code = word_code(word)
            at = code & ((1 << WORD_BITS) - 1)
            if not self.known[at >> 3] >> (at & 7) & 1:
                code = 0
            self[word] = code
            return code

    longest = max(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words_known, keys_known = shared.value
        codes_of = Codes(words_known)
        made = TaskContext.get().partitionId() << 40
        for big in batches:
            for lo in range(0, big.num_rows, 500):
                b = big.slice(lo, 500)
                if len(codes_of) > 1_000_000:  # memory only; codes are computed again
                    codes_of.clear()
                lists = [list(map(codes_of.__getitem__, normal_words(t))) for t in b["text"].to_pylist()]
                n = np.fromiter((max(len(x), longest) for x in lists), np.int64, len(lists))
                edge = np.concatenate([[0], np.cumsum(n)])
                codes = np.zeros(edge[-1], np.int64)
                for at, x in zip(edge.tolist(), lists):
                    codes[at : at + len(x)] = x
                strange = np.concatenate([[0], np.cumsum(codes == 0)])
                found_at, found_key = [], []
                for size in sizes:
                    starts = _ranges(edge[:-1], n - size + 1)
                    # a word that no item has is an edit: beyond ``edits`` of them a window is not sought
                    starts = starts[strange[starts + size] - strange[starts] <= min(edits, size - 1)]
                    for walk in walks_of(size) if len(starts) else ():
                        keys = walk_keys(codes, starts, size, walk)
                        on = _holds(keys_known, keys)
                        found_at.append(starts[on])
                        found_key.append(keys[on])
                if not found_at:
                    continue
                at, key = np.concatenate(found_at), np.concatenate(found_key)
                order = np.argsort(at, kind="stable")
                at, key = at[order], key[order]
                owner = np.searchsorted(edge, at, "right") - 1
                docs_hit, first = np.unique(owner, return_index=True)
                if not len(docs_hit):
                    continue
                offsets = pa.array(np.append(first, len(at)).astype(np.int32))
                inner = pa.StructArray.from_arrays([pa.array(key), pa.array((at - edge[owner]).astype(np.int32))], names=["key", "at"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made + np.arange(len(docs_hit))), b["doc_id"].take(pa.array(docs_hit)), pa.array([codes[edge[i] : edge[i + 1]] for i in docs_hit.tolist()], pa.list_(pa.int64())), pa.ListArray.from_arrays(offsets, inner)],
                    names=["row", "doc_id", "words", "hits"])
                made += len(docs_hit)

    return docs.mapInArrow(run, "row long, doc_id long, words array<long>, hits array<struct<key:long,at:int>>")


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
               run: int = 18, rate: float = 0.3, penalty: int = 3, target: float = 0.999, sampled: int = 5, most_bits: int = 28, seed: int = 11) -> DataFrame:
    """``(doc_id, item_id, score, edits)``: documents that hold an item's passage or a run of at least ``run`` of its words.

    ``edits`` are the fewest word edits between the whole item and some stretch
    of the document, ``score`` the matched words of the best run less ``penalty``
    for each edit in it.  A case has ``edits`` of at most ``rate`` of the item's
    words, or a ``score`` of at least ``run``: every clean run of that length
    passes, an altered run must be longer by ``penalty`` words for each edit, and
    the phrases of a common style don't pass.  Items shorter than a run must
    stand whole.  ``target`` is the recall of altered items sought by ``plan``.
    ``most_bits`` bounds the bit map of keys.  Instructions, see ``passages``,
    are no part of an item; equal passages are one item, reported under each id.
    Null and empty texts on either side match nothing; repeated rows give
    repeated results of their own.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score int, edits int"
    scratch = Scratch(spark, "leakage")
    known = scratch.keep(passages(items, item_id, item_text, run))
    sizes = [r["s"] for r in known.select(F.least(F.size("words"), F.lit(run)).alias("s")).distinct().orderBy("s").collect()]  # at most ``run`` numbers
    if not sizes:
        return spark.createDataFrame([], schema)
    edits = int(rate * run) + 1
    repetitions, _ = plan(target, rate, run, sampled, edits, seed=seed)

    def walks_of(size: int):
        return _walks(repetitions, size, sampled, seed)

    keys = scratch.keep(item_keys(known, run, walks_of))
    bits = min(most_bits, max(20, (keys.count() * 512).bit_length()))
    words_known = bit_map(known.select(F.explode("words").alias("h")), WORD_BITS)
    shared = spark.sparkContext.broadcast((words_known, bit_map(keys.select(F.col("key").alias("h")), bits)))  # 2 MB and at most 2^(most_bits - 3) bytes
    src = docs.where(F.col(doc_text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text"))
    hits = scratch.keep(_hits(src, shared, sizes, walks_of, edits))
    met = hits.select("row", F.explode("hits").alias("h")).select("row", "h.key", "h.at").join(keys, "key")
    met = met.groupBy("row", "item").agg(F.array_sort(F.collect_set("at")).alias("at"))  # at most the places of one document
    cand = met.join(hits.select("row", "doc_id", F.col("words").alias("text_words")), "row").join(known, "item").select("doc_id", "ids", "words", "text_words", "at")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            lists = [b[c].flatten().to_numpy(zero_copy_only=False) for c in ("words", "text_words", "at")]
            edges = [np.concatenate([[0], np.cumsum(np.diff(b[c].offsets.to_numpy()))]) for c in ("words", "text_words", "at")]
            for i, (d, ids) in enumerate(zip(b["doc_id"].to_pylist(), b["ids"].to_pylist())):
                item, text, at = (x[e[i] : e[i + 1]] for x, e in zip(lists, edges))
                reach = len(item) + int(rate * len(item)) + run
                # places an item's length apart at most share one region
                cuts = np.nonzero(np.diff(at) > reach)[0] + 1
                got = [verify(item, text[max(0, part[0] - reach) : part[-1] + run + reach], run, rate, penalty) for part in np.split(at, cuts)]
                got = [g for g in got if g]
                if got:
                    rows += [(d, one, max(g[0] for g in got), min(g[1] for g in got)) for one in ids]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "score", "edits"])

    return cand.mapInArrow(check, schema)


def recall_plan(spark: SparkSession, target: float = 0.999, rate: float = 0.3, run: int = 18, sampled: int = 5) -> DataFrame:
    """One row: what the search is built for and the repetitions that follow."""
    edits = int(rate * run) + 1
    repetitions, recall = plan(target, rate, run, sampled, edits)
    return spark.createDataFrame([(run, sampled, edits, rate, target, repetitions, recall)], "window int, sampled int, window_edits int, edit_rate double, target_recall double, repetitions int, expected_recall double")
