"""Retrieval: filters, the two arms, rank fusion, context and reading.

Filters stand below the arms' limits, arms rank ids only, wide columns join at
the end.  Ranks are over similarity rounded to six places, then id, so results
do not depend on the last bit.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fulltext, vectors

ARM_LIMIT = 60
RRF_K = 60
READ_BUDGET = 24_000


@dataclass(frozen=True)
class SearchFilters:
    """All given ones hold together; an empty one (None, [], "", 0) does not filter.

    ``source_dir`` and ``author`` match anywhere, without case; ``%`` and ``_``
    in them are wildcards.
    """

    shelves: list[str] = field(default_factory=list)
    document_ids: list[int] = field(default_factory=list)
    source_dir: str | None = None
    dates: list[dt.date] = field(default_factory=list)
    date_from: dt.date | None = None
    date_to: dt.date | None = None
    year_from: int | None = None
    year_to: int | None = None
    author: str | None = None

    def predicates(self, id_col: str = "doc_id") -> list[Column]:
        c = F.col
        out = []
        if self.shelves:
            out.append(c("shelf").isin(list(self.shelves)))
        if self.document_ids:
            out.append(c(id_col).isin(list(self.document_ids)))
        if self.source_dir:
            out.append(c("source_dir").ilike(f"%{self.source_dir}%"))
        if self.dates:
            out.append(c("doc_date").isin([F.lit(d) for d in self.dates]))
        if self.date_from:
            out.append(c("doc_date") >= F.lit(self.date_from))
        if self.date_to:
            out.append(c("doc_date") <= F.lit(self.date_to))
        if self.year_from:
            out.append(c("year") >= self.year_from)
        if self.year_to:
            out.append(c("year") <= self.year_to)
        if self.author:
            out.append(F.coalesce(F.exists("authors", lambda a: a.ilike(f"%{self.author}%")), F.lit(False)))
        return out


def filtered(docs: DataFrame, filters: SearchFilters | None, id_col: str = "doc_id") -> DataFrame:
    return reduce(lambda d, p: d.where(p), filters.predicates(id_col) if filters else [], docs)


def _in_scope(chunks: DataFrame, docs: DataFrame, filters: SearchFilters | None) -> DataFrame:
    """Chunks of the documents the filters leave; chunks refer to a document, so without filters nothing is joined."""
    if not filters or not filters.predicates():
        return chunks
    keep = filtered(docs, filters).select(F.col("doc_id").alias("document_id"))
    return chunks.join(keep, "document_id", "left_semi")


def _ranked(df: DataFrame, score: str, limit: int) -> DataFrame:
    """Top ``limit`` with their rank: the limit stands below the window, which then sees ``limit`` rows."""
    top = df.orderBy(F.col(score).desc(), "chunk_id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), "chunk_id")).cast("bigint"))


def vector_arm(chunks: DataFrame, docs: DataFrame, query: list[float], filters: SearchFilters | None = None, limit: int = ARM_LIMIT) -> DataFrame:
    """``(chunk_id, similarity, rank)``, exact; null and all-zero vectors have no similarity and are left out."""
    scope = _in_scope(chunks.select("id", "document_id", "embedding"), docs, filters)
    sim = F.round(vectors.cosine_to(F.col("embedding"), query), 6)
    scored = scope.where(F.col("embedding").isNotNull()).select(F.col("id").alias("chunk_id"), sim.alias("similarity")).where("similarity IS NOT NULL")
    return _ranked(scored, "similarity", limit)


def keyword_arm(chunks: DataFrame, docs: DataFrame, text: str, filters: SearchFilters | None = None, limit: int = ARM_LIMIT) -> DataFrame:
    """``(chunk_id, score, rank)`` of the chunks that match a web-style query."""
    query = fulltext.parse(text)
    scope = _in_scope(chunks.select("id", "document_id", "tsv"), docs, filters).where(fulltext.match(query, F.col("tsv")))
    scored = scope.select(F.col("id").alias("chunk_id"), F.round(fulltext.rank(query, F.col("tsv")), 6).alias("score"))
    return _ranked(scored, "score", limit)


def fuse(vec: DataFrame, kw: DataFrame) -> DataFrame:
    """Reciprocal rank fusion by full outer join of the arms (at most two limits of rows)."""
    share = lambda r: F.coalesce(F.lit(1.0) / (RRF_K + F.col(r)), F.lit(0.0))
    v = vec.select("chunk_id", F.col("rank").alias("vector_rank"))
    k = kw.select("chunk_id", F.col("rank").alias("keyword_rank"))
    return v.join(k, "chunk_id", "full").select("chunk_id", "vector_rank", "keyword_rank", F.round(share("vector_rank") + share("keyword_rank"), 9).alias("score"))


def fuse_union(vec: DataFrame, kw: DataFrame) -> DataFrame:
    """The same fusion as one aggregate instead of a join."""
    none = F.lit(None).cast("bigint")
    both = vec.select("chunk_id", F.col("rank").alias("vector_rank"), none.alias("keyword_rank")).unionByName(kw.select("chunk_id", none.alias("vector_rank"), F.col("rank").alias("keyword_rank")))
    out = both.groupBy("chunk_id").agg(F.max("vector_rank").alias("vector_rank"), F.max("keyword_rank").alias("keyword_rank"))
    share = lambda r: F.coalesce(F.lit(1.0) / (RRF_K + F.col(r)), F.lit(0.0))
    return out.withColumn("score", F.round(share("vector_rank") + share("keyword_rank"), 9))


def chunk_citations(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """The citation view: a chunk with what names its place; ranks and scores a chunk has got are kept."""
    extra = [c for c in ("vector_rank", "keyword_rank", "score") if c in chunks.columns]
    c = chunks.select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", "page_start", "page_end", "section", "content", "token_count", *extra)
    d = docs.select(F.col("doc_id").alias("document_id"), "shelf", "rel_path", "filename", "source_dir", "title", "authors", "doc_date", "year")
    return c.join(d, "document_id")


def page_label(start: Column, end: Column) -> Column:
    """``6-7``, ``6`` or null; page 0 counts as none."""
    first = F.when(start != 0, start.cast("string"))
    return F.when((start != 0) & (end != 0) & (start != end), F.concat(first, F.lit("-"), end.cast("string"))).otherwise(first)


def citation(df: DataFrame) -> DataFrame:
    """Adds ``citation``: the document, and pages, section, date and up to five authors where present."""
    return df.withColumn("citation", F.struct(
        "document_id", "shelf", "title", "filename", page_label(F.col("page_start"), F.col("page_end")).alias("pages"),
        F.when(F.col("section") != "", F.col("section")).alias("section"), F.date_format("doc_date", "yyyy-MM-dd").alias("date"),
        F.when(F.size("authors") > 0, F.slice("authors", 1, 5)).alias("authors")))


def hybrid(chunks: DataFrame, docs: DataFrame, text: str, query: list[float], filters: SearchFilters | None = None, limit: int = 8, arm_limit: int = ARM_LIMIT) -> DataFrame:
    """The ``limit`` best chunks of both arms, with their citation columns."""
    fused = fuse(vector_arm(chunks, docs, query, filters, arm_limit), keyword_arm(chunks, docs, text, filters, arm_limit))
    top = fused.orderBy(F.col("score").desc(), "chunk_id").limit(limit)
    # at most ``limit`` rows by construction: read once, broadcast to the chunks and then, with their text, to the documents
    found = chunks.join(F.broadcast(top.withColumnRenamed("chunk_id", "id")), "id")
    hits = chunk_citations(F.broadcast(found), docs)
    return hits.orderBy(F.col("score").desc(), "chunk_id")


def find_documents(docs: DataFrame, query: list[float], filters: SearchFilters | None = None, limit: int = 10) -> DataFrame:
    sim = F.round(vectors.cosine_to(F.col("summary_embedding"), query), 6)
    scored = filtered(docs, filters).where(F.col("summary_embedding").isNotNull()).withColumn("score", sim).where("score IS NOT NULL")
    return scored.orderBy(F.col("score").desc(), "doc_id").limit(limit).select(
        "doc_id", "shelf", "title", "source_dir", "authors", "doc_date", "year", F.left("summary", F.lit(600)).alias("summary"), F.bround("score", 4).alias("score"))


def list_shelves(shelves: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents are counted before the join, so one crowded shelf is no hot key."""
    per = docs.groupBy(F.col("shelf").alias("name")).agg(F.count("doc_id").alias("documents"), F.min("doc_date").alias("first_date"), F.max("doc_date").alias("last_date"))
    return shelves.join(per, "name", "left").select("name", "type", "description", F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"), "first_date", "last_date").orderBy("name")


def list_documents(docs: DataFrame, filters: SearchFilters | None = None, limit: int = 200) -> DataFrame:
    out = filtered(docs, filters).orderBy(F.col("doc_date").desc_nulls_last(), F.col("title").asc_nulls_last(), "doc_id").limit(limit)
    return out.select("doc_id", "shelf", "title", "source_dir", F.date_format("doc_date", "yyyy-MM-dd").alias("doc_date"), "page_count", F.left("summary", F.lit(300)).alias("summary"))


def context(chunks: DataFrame, targets: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """Neighbours of the ``targets`` (``chunk_id``) by position in their document: ``(target, chunk_id, chunk_index, content, ...)``."""
    t = chunks.join(targets.select(F.col("chunk_id").alias("id")), "id").select(F.col("id").alias("target"), F.col("document_id").alias("doc"), F.col("chunk_index").alias("at"))
    near = (F.col("document_id") == F.col("doc")) & F.col("chunk_index").between(F.col("at") - before, F.col("at") + after)
    return chunks.join(t, near).select("target", F.col("id").alias("chunk_id"), "document_id", "chunk_index", "page_start", "section", "content")


def read_documents(chunks: DataFrame, budget: int = READ_BUDGET) -> DataFrame:
    """Per document its text in reading order up to ``budget`` characters: ``(document_id, text, chars_total, shown, chunks, truncated)``.

    Chunks go in while the length so far, two characters added for each, is
    below the budget.  ``truncated`` keeps a known quirk: false when only the last
    chunk is missing.
    """
    w = Window.partitionBy("document_id").orderBy("chunk_index", "id")
    used = F.coalesce(F.sum(F.length("content") + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = chunks.select("document_id", "id", "chunk_index", "content").withColumn("shown", used < budget)
    # the text of a document is at most the budget and one chunk
    agg = marked.groupBy("document_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("shown"), F.struct("chunk_index", "id", "content")))), lambda s: s["content"]), "\n\n").alias("text"),
        F.sum(F.length("content")).alias("chars_total"), F.count_if("shown").alias("shown"), F.count(F.lit(1)).alias("chunks"))
    return agg.withColumn("truncated", F.least(F.col("shown") + 1, F.col("chunks")) < F.col("chunks"))


def hit_json(hits: DataFrame) -> DataFrame:
    """One JSON object per hit: ``{chunk_id, text, score, citation}``; absent parts are left out."""
    return citation(hits).select("chunk_id", F.to_json(F.struct("chunk_id", F.col("content").alias("text"), F.bround("score", 5).alias("score"), "citation")).alias("hit"))
