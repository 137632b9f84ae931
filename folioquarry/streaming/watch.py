"""The watcher: a stream of requests, each micro-batch a coalesced rescan; plus a full pass at fixed intervals."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..runtime import file_system, put_text

REQUEST = "shelf string, force boolean"
log = logging.getLogger(__name__)


def request(spark: SparkSession, folder: str, shelf: str = "*", force: bool = False) -> None:
    """Asks for a rescan of one shelf, or of all with ``*``; no reader sees half a file."""
    fs, at = file_system(spark, folder)
    fs.mkdirs(at)
    put_text(spark, folder, f"{uuid.uuid4().hex}.json", json.dumps({"shelf": shelf, "force": force}))


def wanted(requests: DataFrame, config: Config) -> tuple[list[str], bool]:
    """Which shelves a batch of requests asks for, and whether by force; ``*`` asks for all, unknown names for none."""
    names = list(config.shelves)
    row = requests.where(F.col("shelf").isin([*names, "*"])).agg(F.collect_set("shelf").alias("s"), F.coalesce(F.bool_or("force"), F.lit(False)).alias("f")).first()
    return (names if "*" in row["s"] else [n for n in names if n in row["s"]]), bool(row["f"])


def watch(spark: SparkSession, folder: str, config: Config, scan: Callable[[str, bool], dict], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Runs ``scan(shelf, force)`` for what is asked; a shelf that fails stops no other.

    ``once`` works off what is there and ends; otherwise the feed is looked at
    every few seconds and callers add a ``*`` request every scan interval
    (``tick``).  Micro-batches never overlap, the checkpoint keeps the place.
    """
    fs, at = file_system(spark, folder)
    fs.mkdirs(at)

    def batch(df: DataFrame, _: int) -> None:
        shelves, force = wanted(df, config)
        for name in shelves:
            try:
                log.info("%s: %s", name, scan(name, force))
            except Exception:
                log.exception("scan of %s failed", name)

    stream = spark.readStream.schema(REQUEST).json(folder)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def tick(spark: SparkSession, query: StreamingQuery, folder: str, config: Config) -> None:
    """Adds a full-pass request every scan interval until the query ends; ``query.stop()`` ends both."""
    request(spark, folder)
    while not query.awaitTermination(config.watcher.scan_interval_seconds):
        request(spark, folder)
