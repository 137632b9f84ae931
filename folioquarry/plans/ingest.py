"""Scan a shelf and bring the store up to date: diff, extract, describe, chunk, embed, write."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DIR_MEANING, Config, Shelf
from ..embed import embed_column
from ..functions import text as tx
from ..operators import chunking, merge, metadata
from ..runtime import Scratch
from ..sources import files
from .store import Store

_META = {"manuals": metadata.manual, "meetings": metadata.meeting}


def sync_shelves(store: Store, config: Config) -> None:
    spark = store.spark
    rows = [(s.name, s.description, DIR_MEANING[s.type], None, s.type, s.path) for s in config.shelves.values()]
    known = store.read("shelves")
    new = spark.createDataFrame(rows, known.schema).withColumn("created_at", F.current_timestamp())
    store.write_shelves(merge.sync_shelves(known, new))


def _described(good: DataFrame, shelf: Shelf, network: bool) -> DataFrame:
    """The readable files with title, date, authors and summary; papers are looked up where ``network`` allows."""
    out = good.withColumnRenamed("pages", "page_rows").withColumn("pages", F.transform("page_rows", lambda p: p["text"]))
    if shelf.type == "scientific":
        found = metadata.lookups(good) if network else {}
        return metadata.paper(out, **found)
    return _META[shelf.type](out)


def summary_text(title: Column, summary: Column, model: str) -> Column:
    """What a document's summary vector stands for: the title, a line end and the summary, as the model wants it; null without a summary."""
    whole = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), summary)
    return tx.model_prefix(F.when(F.coalesce(summary, F.lit("")) != "", whole), model, query=False)


def scan_shelf(spark: SparkSession, store: Store, shelf: Shelf, config: Config, force: bool = False) -> dict[str, int]:
    """Counts of indexed, skipped, deleted and failed files.

    Unchanged files (same hash) are skipped unless ``force``.  A failed file
    keeps its former rows.  Without the shelf's folder nothing is done, so
    nothing is deleted.  Only the buckets of changed documents are read in full
    and written; where nothing changed nothing is.
    """
    scratch = Scratch(spark, "ingest")
    found = files.hashed(files.supported(files.listing(spark, shelf)))
    seen = scratch.keep(found.select("rel_path", "content_hash"))
    none = {"indexed": 0, "skipped": 0, "deleted": 0, "failed": 0}
    if not seen.head(1) and not _exists(shelf):
        return none
    known = store.read("documents", shelf.name).select("id", "rel_path", "content_hash")
    status = scratch.keep(merge.scan_diff(seen, known.drop("id"), force))
    counts = none | {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}  # three rows at most
    if not counts["indexed"] and not counts["deleted"]:
        return counts
    todo = found.join(status.where("status = 'indexed'").select("rel_path"), "rel_path", "left_semi")
    good = scratch.keep(files.extract(todo)).where("error IS NULL")
    described = scratch.keep(_described(good, shelf, config.watcher.network_metadata).withColumn("id", F.xxhash64("rel_path")))
    c, model = config.chunking, config.embedding.model
    cut = chunking.chunk_documents(described, "id", "page_rows", c.target_tokens, c.overlap_tokens, c.min_tokens)
    cut = embed_column(cut.withColumn("asked", tx.model_prefix(F.col("content"), model, query=False)), "asked", "embedding", config.embedding).where("embedding IS NOT NULL")
    now = F.current_timestamp()
    new_chunks = scratch.keep(cut.select(F.xxhash64("document_id", "chunk_index").alias("id"), "document_id", "chunk_index", "page_start", "page_end", "section", "content", "token_count", "embedding", tx.tokens(F.col("content")).alias("tsv"), now.alias("created_at")))
    docs = embed_column(described.withColumn("asked", summary_text(F.col("title"), F.col("summary"), model)), "asked", "summary_embedding", config.embedding)
    kind = F.when(F.col("suffix").isin(".txt", ".md", ".markdown"), "text").otherwise(F.substring("suffix", 2, 9))
    new_docs = scratch.keep(docs.join(new_chunks.select(F.col("document_id").alias("id")).distinct(), "id", "left_semi").select(
        "id", "shelf", "rel_path", "filename", "source_dir", "title", "authors", "doc_date", "year", "summary", "summary_embedding", "content_hash",
        F.size("page_rows").alias("page_count"), F.map_concat("extra", F.create_map(F.lit("kind"), kind)).alias("extra"), now.alias("indexed_at"), now.alias("created_at"), now.alias("updated_at")))
    gone = scratch.keep(known.join(status.where("status = 'deleted'"), "rel_path", "left_semi").select(F.col("id").alias("document_id")))
    changed = new_docs.select("id").unionByName(gone.select(F.col("document_id").alias("id")))
    buckets = sorted(r["b"] for r in changed.select(store.bucket("id").alias("b")).distinct().collect())  # at most as many as there are
    if buckets:
        old_docs, old_chunks = store.read("documents", shelf.name, buckets), store.read("chunks", shelf.name, buckets)
        left_docs, left_chunks = merge.delete_documents(old_docs, old_chunks, gone)
        store.write(shelf.name, buckets, {
            "documents": merge.upsert(left_docs, new_docs, "rel_path", keep=("id", "created_at"), stamp=now),
            "chunks": left_chunks.join(new_docs.select(F.col("id").alias("document_id")), "document_id", "left_anti").select(new_chunks.columns).unionByName(new_chunks),
        })
    done = new_docs.count()
    return counts | {"indexed": done, "failed": counts["indexed"] - done}


def _exists(shelf: Shelf) -> bool:
    import os

    return "://" in shelf.path or os.path.isdir(shelf.path)


def scan_all(spark: SparkSession, store: Store, config: Config, force: bool = False) -> dict[str, int]:
    results = [scan_shelf(spark, store, s, config, force) for s in config.shelves.values()]
    return reduce(lambda a, b: {k: a[k] + b[k] for k in a}, results)
