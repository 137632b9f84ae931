"""Indexes for retrieval: vectors in cells and postings of words, both written as partitioned tables.

A search reads the cells nearest to the query and the postings of its words,
not the whole collection.  Probing every cell is the exact search; postings are
always exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fulltext, vectors
from .search import ARM_LIMIT, SearchFilters, _in_scope, _ranked, chunk_citations, fuse

MOST_CELLS = 4096


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _usable(df: DataFrame, vector: str, dim: int) -> DataFrame:
    return df.where((F.size(vector) == dim) & F.exists(vector, lambda x: x != 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))


def _centres(sample: np.ndarray, cells: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means on unit vectors; a cell that loses all its members keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        of = np.concatenate([(part @ centres.T).argmax(1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        sums = np.zeros_like(centres)
        np.add.at(sums, of, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


class VectorCells:
    """Vectors in the cell of their nearest centre, one folder per cell.

    The centres are fitted on a bounded sample (``sample`` rows, by a hash of the
    id); every row is indexed.  Searches read ``probes`` cells.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # at most MOST_CELLS
        self.centres = np.array([r["centre"] for r in rows])

    @classmethod
    def build(cls, chunks: DataFrame, path: str, dim: int, cells: int | None = None, sample: int = 20_000, rounds: int = 8, seed: int = 4) -> VectorCells:
        """Index ``(id, document_id, embedding)``; rows without a usable vector are in no cell.  About the square root of the rows makes the number of cells."""
        spark = chunks.sparkSession
        src = _usable(chunks.select("id", "document_id", "embedding"), "embedding", dim)
        n = src.count()
        near = F.pmod(F.xxhash64("id"), F.lit(1 << 32))
        few = src.where(near < min(1 << 32, int((1 << 32) * 1.2 * sample / max(n, 1)) + 1)).orderBy(near, "id").limit(sample).select("embedding").collect()
        x = np.array([r["embedding"] for r in few], np.float64).reshape(len(few), dim)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        count = min(len(x), MOST_CELLS, cells or max(1, round(n ** 0.5)))
        centres = _centres(x, count, rounds, seed) if count else np.zeros((0, dim))
        spark.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
        shared = spark.sparkContext.broadcast(centres)  # at most MOST_CELLS rows

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = (_matrix(b["embedding"], dim) @ shared.value.T).argmax(1) if b.num_rows else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], names=[*b.schema.names, "cell"])

        placed = src.mapInArrow(place, "id long, document_id long, embedding array<float>, cell int")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # a cell that many rows share is written by several tasks
        placed.repartition(parts, "cell", F.pmod(F.xxhash64("id"), F.lit(max(1, n // 4_000_000)))).sortWithinPartitions("cell", "document_id").write.partitionBy("cell").parquet(f"{path}/cells")
        return cls(spark, path)

    def near(self, query: list[float], probes: int | None) -> list[int] | None:
        """The cells to read, nearest first; None for all."""
        if probes is None or probes >= len(self.centres):
            return None
        return np.argsort(-(self.centres @ np.asarray(query, np.float64)), kind="stable")[:probes].tolist()

    def candidates(self, query: list[float], probes: int | None) -> DataFrame:
        cells = self.near(query, probes)
        df = self.spark.read.schema("id long, document_id long, embedding array<float>, cell int").parquet(f"{self.path}/cells") if len(self.centres) else self.spark.createDataFrame([], "id long, document_id long, embedding array<float>, cell int")
        return df if cells is None else df.where(F.col("cell").isin(cells))

    def arm(self, docs: DataFrame, query: list[float], filters: SearchFilters | None = None, limit: int = ARM_LIMIT, probes: int | None = 24) -> DataFrame:
        """``(chunk_id, similarity, rank)`` like the scanning arm, from ``probes`` cells."""
        scope = _in_scope(self.candidates(query, probes), docs, filters)
        sim = F.round(vectors.cosine_to(F.col("embedding"), query), 6)
        return _ranked(scope.select(F.col("id").alias("chunk_id"), sim.alias("similarity")), "similarity", limit)


def batch_arm(rows: DataFrame, queries: DataFrame, dim: int, limit: int = 10, block: int = 4096) -> DataFrame:
    """``(query_id, chunk_id, similarity, rank)``: the nearest ``(id, embedding)`` of every ``(query_id, vector)``, exactly.

    The queries are a stated set; they are taken in blocks of ``block``, each held
    against all rows in one pass that keeps ``limit`` per task and query.
    """
    spark = rows.sparkSession
    asked = [(r["query_id"], r["vector"]) for r in _usable(queries, "vector", dim).select("query_id", "vector").orderBy("query_id").toLocalIterator()]
    schema = "query_id long, chunk_id long, similarity double"
    found = []
    for lo in range(0, len(asked), block):
        ids = np.array([i for i, _ in asked[lo : lo + block]])
        q = np.array([v for _, v in asked[lo : lo + block]], np.float64)
        shared = spark.sparkContext.broadcast((ids, q / np.linalg.norm(q, axis=1, keepdims=True)))  # at most ``block`` vectors

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            keep_id, keep_sim = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
            for b in batches:
                if not b.num_rows:
                    continue
                x = _matrix(b["embedding"], dim)
                s = np.round((q @ x.T) / np.linalg.norm(x, axis=1), 6)
                keep_id = np.concatenate([keep_id, np.broadcast_to(b["id"].to_numpy(), s.shape)], 1)
                keep_sim = np.concatenate([keep_sim, s], 1)
                order = np.lexsort((keep_id, -keep_sim), axis=1)[:, :limit]
                keep_id, keep_sim = np.take_along_axis(keep_id, order, 1), np.take_along_axis(keep_sim, order, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, keep_id.shape[1])), pa.array(keep_id.ravel()), pa.array(keep_sim.ravel())], names=["query_id", "chunk_id", "similarity"])

        found.append(_usable(rows.select("id", "embedding"), "embedding", dim).mapInArrow(score, schema))
    if not found:
        return spark.createDataFrame([], schema + ", rank bigint")
    by = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "chunk_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(by).cast("bigint")).where(F.col("rank") <= limit)


def recall(cells: VectorCells, exact: DataFrame, queries: DataFrame, dim: int, steps: int = 8) -> DataFrame:
    """``(step, probes, recall)``: what probing 1/``steps``, 2/``steps``, ... of the cells finds of the ``exact`` neighbours (``query_id, chunk_id``) of a stated set of queries.

    A neighbour is found where its cell is among the query's nearest.
    """
    n = len(cells.centres)
    order = [(r["query_id"], np.argsort(-(cells.centres @ np.asarray(r["vector"], np.float64)), kind="stable").tolist()) for r in _usable(queries, "vector", dim).toLocalIterator()]
    probed = cells.spark.createDataFrame(order, "query_id long, near array<int>")
    placed = cells.candidates([], None).select(F.col("id").alias("chunk_id"), "cell")
    at = exact.join(placed, "chunk_id").join(probed, "query_id").select(F.array_position("near", F.col("cell")).alias("at"))
    takes = [max(1, n * k // steps) for k in range(1, steps + 1)]
    each = F.array(*[F.struct(F.lit(k + 1).alias("step"), F.lit(t).alias("probes"), (F.col("at") <= t).cast("double").alias("hit")) for k, t in enumerate(takes)])
    return at.select(F.explode(each).alias("e")).groupBy("e.step", "e.probes").agg(F.round(F.avg("e.hit"), 4).alias("recall"))


# --- postings --------------------------------------------------------------

def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class Postings:
    """One row per word and chunk with the word's places, in folders by a hash of the word."""

    SCHEMA = "term string, chunk_id long, document_id long, places array<int>, bucket int"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    @classmethod
    def build(cls, chunks: DataFrame, path: str, buckets: int = 64) -> Postings:
        """Index ``(id, document_id, tsv)``; the places of a word stay within its chunk, so no list grows with the collection."""
        words = chunks.select(F.col("id").alias("chunk_id"), "document_id", F.posexplode("tsv").alias("at", "term")).where("term IS NOT NULL")
        # a chunk's words are gathered where it is read: one row per chunk and word comes before any shuffle of words
        rows = words.groupBy("chunk_id", "document_id", "term").agg(F.array_sort(F.collect_list("at")).alias("places"))
        dealt = rows.select("term", "chunk_id", "document_id", "places", _bucket(F.col("term"), buckets).alias("bucket"))
        # a common word is spread over tasks, then sorted so that its row groups are skipped when another is asked for
        dealt.repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket", F.pmod("chunk_id", F.lit(16))).sortWithinPartitions("bucket", "term", "chunk_id").write.partitionBy("bucket").parquet(f"{path}/postings")
        return cls(chunks.sparkSession, path, buckets)

    def of(self, words: list[str]) -> DataFrame:
        """The postings of some words: only their folders and row groups are read."""
        table = self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/postings")
        if not words:
            return table.limit(0)
        there = reduce(lambda a, b: a | b, [F.col("bucket") == _bucket(F.lit(w), self.buckets) for w in words])  # folded to constants, so folders are pruned
        return table.where(there & F.col("term").isin(words))

    def matches(self, docs: DataFrame, text: str, filters: SearchFilters | None = None) -> DataFrame:
        """``(chunk_id, score)`` of all chunks that match.

        A query with an alternative of exclusions only matches chunks that have
        none of its words; those are in no posting, and it is an error here.
        """
        query = fulltext.parse(text)
        if any(all(not t.wanted for t in g) for g in query.groups):
            raise ValueError("an alternative of exclusions only needs the scanning arm")
        words = list(dict.fromkeys(w for g in query.groups for t in g for w in t.words))
        rows = _in_scope(self.of(words), docs, filters)
        # at most one entry per word of the query
        per = rows.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("m"))
        places = {w: F.coalesce(F.try_element_at("m", F.lit(w)), F.array().cast("array<int>")) for w in words}
        return per.where(fulltext.match_places(query, places)).select("chunk_id", F.round(fulltext.rank_places(query, places), 6).alias("score"))

    def arm(self, docs: DataFrame, text: str, filters: SearchFilters | None = None, limit: int = ARM_LIMIT) -> DataFrame:
        """``(chunk_id, score, rank)`` like the scanning arm."""
        return _ranked(self.matches(docs, text, filters), "score", limit)


def hybrid(cells: VectorCells, postings: Postings, chunks: DataFrame, docs: DataFrame, text: str, query: list[float], filters: SearchFilters | None = None, limit: int = 8, arm_limit: int = ARM_LIMIT, probes: int | None = 24) -> DataFrame:
    """The ``limit`` best chunks of both indexed arms with their citation columns; the rows are fetched by key, so sorted files are skipped."""
    fused = fuse(cells.arm(docs, query, filters, arm_limit, probes), postings.arm(docs, text, filters, arm_limit))
    top = fused.orderBy(F.col("score").desc(), "chunk_id").limit(limit).collect()
    schema = "chunk_id long, vector_rank bigint, keyword_rank bigint, score double"
    best = chunks.sparkSession.createDataFrame(top, schema)
    hits = chunks.where(F.col("id").isin([r["chunk_id"] for r in top])).join(F.broadcast(best.withColumnRenamed("chunk_id", "id")), "id")
    return chunk_citations(F.broadcast(hits), docs).orderBy(F.col("score").desc(), "chunk_id")  # ``limit`` rows
