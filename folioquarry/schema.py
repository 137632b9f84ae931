"""Table schemas and their constraints as data-quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import DIR_MEANING

SHELVES = "name string, description string, dir_meaning string, created_at timestamp, type string, root_path string"
DOCUMENTS = (
    "id bigint, shelf string, rel_path string, filename string, source_dir string, title string, authors array<string>, doc_date date, year int, "
    "summary string, summary_embedding array<float>, content_hash string, page_count int, extra map<string,string>, indexed_at timestamp, created_at timestamp, updated_at timestamp"
)
CHUNKS = "id bigint, document_id bigint, chunk_index int, page_start int, page_end int, section string, content string, token_count int, embedding array<float>, tsv array<string>, created_at timestamp"


def violations(shelves: DataFrame, documents: DataFrame, chunks: DataFrame, doc_id: str = "id") -> DataFrame:
    """``(rule, violations)``: rows that break a check, key or reference; one row per rule."""
    def rows(rule: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")

    def unique(rule: str, df: DataFrame, *keys: str) -> DataFrame:
        return rows(rule, df.groupBy(*keys).count().where("count > 1"))

    docs = documents.select(F.col(doc_id).alias("document_id"), "shelf", "rel_path")
    return reduce(DataFrame.unionByName, [
        rows("shelves.dir_meaning", shelves.where(~F.col("dir_meaning").isin(*DIR_MEANING.values()))),
        rows("shelves.type", shelves.where(~F.col("type").isin(*DIR_MEANING))),
        unique("shelves.name", shelves, "name"),
        unique("documents.id", docs, "document_id"),
        unique("documents.rel_path", docs, "rel_path"),
        rows("documents.shelf", docs.where("shelf IS NOT NULL").join(shelves.select(F.col("name").alias("shelf")), "shelf", "left_anti")),
        unique("chunks.document_id_chunk_index", chunks, "document_id", "chunk_index"),
        rows("chunks.page_order", chunks.where("page_end < page_start")),
        rows("chunks.document_id", chunks.join(docs, "document_id", "left_anti")),
    ])
