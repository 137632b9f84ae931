"""Folders of files as DataFrames."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Shelf
from ..functions import text as tx
from . import office

_SCHEMA = "rel_path string, shelf string, filename string, source_dir string, suffix string, content_hash string, file_size long, modified_at timestamp, pages {pages}, prop_title string, prop_created date, font_title string, error string"
_PAGES = "array<struct<number:int,text:string,section:string>>"


def listing(spark: SparkSession, shelf: Shelf) -> DataFrame:
    """``(rel_path, shelf, filename, source_dir, suffix, modified_at, file_size, content, legacy)`` of the shelf's files, without hidden ones.

    A missing folder gives no rows.  ``rel_path`` begins with the shelf's own
    folder name.  Content is read only by plans that use it.
    """
    local = shelf.path.removeprefix("file://")
    if "://" not in shelf.path and not os.path.isdir(local):
        return spark.createDataFrame([], "rel_path string, shelf string, filename string, source_dir string, suffix string, modified_at timestamp, file_size long, content binary, legacy boolean")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(shelf.path)
    root = local.rstrip("/")
    base = os.path.basename(root)
    path = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), r"^file:/+", "/")
    rel = F.concat(F.lit(base), F.substring_index(path, root, -1))
    df = raw.select(tx.nfc(rel).alias("rel_path"), F.col("modificationTime").alias("modified_at"), F.col("length").alias("file_size"), "content")
    parts = F.split("rel_path", "/")
    return df.select(
        "rel_path", F.lit(shelf.name).alias("shelf"), F.element_at(parts, -1).alias("filename"), F.try_element_at(parts, F.lit(-2)).alias("source_dir"),
        tx.suffix_of(F.col("rel_path")).alias("suffix"), "modified_at", "file_size", "content",
        (F.hex(F.substring("content", 1, 8)) == office.OLE_MAGIC.hex().upper()).alias("legacy"),
    ).where(~F.col("filename").startswith("."))


def supported(files: DataFrame) -> DataFrame:
    return files.where(F.col("suffix").isin(sorted(office.READERS)))


def hashed(files: DataFrame) -> DataFrame:
    return files.withColumn("content_hash", F.sha2("content", 256))


def extract(files: DataFrame) -> DataFrame:
    """Pages and properties of each file; one that can't be read has ``error`` instead, and stops no other."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pages, titles, created, fonts, errors = [], [], [], [], []
            for suffix, data in zip(pdf["suffix"], pdf["content"]):
                t = c = big = err = None
                found = None
                try:
                    found = [{"number": n, "text": x, "section": s} for n, x, s in office.READERS[suffix](bytes(data))]
                    t, c = office.properties(suffix, bytes(data))
                    big = office.font_title(suffix, bytes(data))
                    if not found:
                        err = "no text"
                except Exception as e:  # a broken file is a row with an error
                    err = f"{type(e).__name__}: {e}"[:500]
                pages.append(found)
                titles.append(t)
                created.append(pd.to_datetime(c).date() if c else None)
                fonts.append(big)
                errors.append(err)
            yield pdf.drop(columns=["content"]).assign(pages=pages, prop_title=titles, prop_created=created, font_title=fonts, error=errors)

    src = files.select("rel_path", "shelf", "filename", "source_dir", "suffix", "content_hash", "file_size", "modified_at", "content")
    return src.mapInPandas(run, _SCHEMA.format(pages=_PAGES))
