"""Upsert, delete and change detection as joins of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_scans(scans: DataFrame) -> DataFrame:
    """The last state of each path: repeats count once, late rows take their place by scan time; no window over a hot path."""
    order = F.struct("scanned_at", "scan_id")
    return scans.where("rel_path IS NOT NULL").groupBy("rel_path").agg(F.max_by(F.struct("content_hash", "outcome", "scanned_at"), order).alias("s")).select("rel_path", "s.content_hash", "s.outcome", "s.scanned_at")


def scan_diff(seen: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """``(rel_path, status)``: indexed (new, changed or forced), skipped (same hash) or deleted (known, no longer seen).

    ``seen`` and ``known`` are ``(rel_path, content_hash)``, unique by path.  A null hash never equals.
    """
    s = seen.select("rel_path", F.col("content_hash").alias("new"), F.lit(True).alias("here"))
    k = known.select("rel_path", F.col("content_hash").alias("old"))
    same = F.coalesce(F.col("new") == F.col("old"), F.lit(False)) & F.lit(not force)
    return s.join(k, "rel_path", "full").select("rel_path", F.when(F.col("here").isNull(), "deleted").when(same, "skipped").otherwise("indexed").alias("status"))


def counters(status: DataFrame) -> DataFrame:
    """One row: how many paths were indexed, skipped, deleted, failed."""
    return status.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("indexed", "skipped", "deleted", "failed")])


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = (), stamp: Column | None = None) -> DataFrame:
    """``new`` over ``old`` by ``key``: a known row keeps the columns ``keep`` of the old one, the rest is replaced; ``stamp`` fills updated_at of replaced rows."""
    kept = old.select(key, *[F.col(c).alias(f"_{c}") for c in keep], F.lit(True).alias("_known"))
    incoming = new.join(kept, key, "left")
    incoming = incoming.withColumns({c: F.coalesce(f"_{c}", c) for c in keep})
    if stamp is not None:
        incoming = incoming.withColumn("updated_at", F.when(F.col("_known"), stamp).otherwise(F.col("updated_at")))
    return old.join(new.select(key), key, "left_anti").unionByName(incoming.select(old.columns))


def delete_documents(documents: DataFrame, chunks: DataFrame, gone: DataFrame, doc_id: str = "id") -> tuple[DataFrame, DataFrame]:
    """Both tables without the documents ``gone`` (``document_id``) and their chunks."""
    ids = gone.select("document_id").distinct()
    return documents.join(ids, documents[doc_id] == ids["document_id"], "left_anti"), chunks.join(ids, "document_id", "left_anti")


def sync_shelves(shelves: DataFrame, configured: DataFrame) -> DataFrame:
    """Configured shelves over known ones by name; nothing is deleted, an empty description becomes the name."""
    given = configured.withColumn("description", F.when(F.coalesce("description", F.lit("")) == "", F.col("name")).otherwise(F.col("description")))
    return upsert(shelves, given, "name", keep=("created_at",))


def seed(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there yet are added, nothing else changes."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti").select(table.columns))


def backfill_type(shelves: DataFrame) -> DataFrame:
    guess = F.when(F.col("dir_meaning") == "device", "manuals").when(F.col("dir_meaning") == "date", "meetings").otherwise("scientific")
    return shelves.withColumn("type", F.coalesce("type", guess))
