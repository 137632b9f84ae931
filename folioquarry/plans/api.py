"""The tool surface: ten calls that answer with plain dicts."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..embed import backend, embed_texts
from ..functions import text as tx
from ..operators import search
from ..operators.search import SearchFilters
from ..streaming.watch import request


def _date(value: str | None) -> dt.date | None:
    return dt.date.fromisoformat(value) if value else None


def _dates(values: list[str] | None) -> list[dt.date]:
    return [dt.date.fromisoformat(v) for v in values or []]


def _day() -> Column:
    return F.date_format("doc_date", "yyyy-MM-dd").alias("date")


def _rows(df: DataFrame) -> list[dict]:
    """Rows of a result that is limited by construction."""
    return [r.asDict(recursive=True) for r in df.collect()]


def _counted(name: str, rows: list[dict]) -> dict:
    return {"count": len(rows), name: rows}


class Library:
    """``documents`` has the columns of the store with the key as ``doc_id``."""

    TOOLS = ("list_shelves", "list_documents", "find_documents", "search_manuals", "search_meetings", "search_papers", "get_context", "read_document", "get_document_info", "reindex")

    def __init__(self, spark: SparkSession, config: Config, shelves: DataFrame, documents: DataFrame, chunks: DataFrame, requests: str | None = None):
        self.spark, self.config, self.requests = spark, config, requests
        self.shelves, self.docs, self.chunks = shelves, documents, chunks

    def _vector(self, text: str) -> list[float]:
        asked = self.spark.range(1).select(tx.model_prefix(F.lit(text), self.config.embedding.model, query=True)).first()[0]
        vector = embed_texts([asked], backend(self.config.embedding), self.config.embedding)[0]
        if vector is None:
            raise ValueError("the query has nothing to embed")
        return vector

    def _search(self, query: str, filters: SearchFilters, limit: int) -> dict:
        hits = search.hit_json(search.hybrid(self.chunks, self.docs, query, self._vector(query), filters, limit))
        return _counted("results", [json.loads(r["hit"]) for r in hits.collect()])

    def _document(self, document_id: int) -> dict | None:
        d = self.docs.where(F.col("doc_id") == document_id).select(
            F.col("doc_id").alias("document_id"), "shelf", "title", "authors", _day(), "year", "filename", F.col("source_dir").alias("folder"), F.col("page_count").alias("pages"), "summary", "indexed_at").first()
        return d and d.asDict(recursive=True)

    def list_shelves(self) -> dict:
        return {"shelves": _rows(search.list_shelves(self.shelves, self.docs))}

    def list_documents(self, shelf: str | None = None, date_from: str | None = None, date_to: str | None = None, dates: list[str] | None = None, limit: int = 200) -> dict:
        f = SearchFilters(shelves=[shelf] if shelf else [], date_from=_date(date_from), date_to=_date(date_to), dates=_dates(dates))
        listed = search.list_documents(self.docs, f, limit)
        return _counted("documents", _rows(listed.select(F.col("doc_id").alias("document_id"), "shelf", "title", F.col("source_dir").alias("folder"), F.col("doc_date").alias("date"), F.col("page_count").alias("pages"))))

    def find_documents(self, query: str, shelf: str | None = None, limit: int = 10) -> dict:
        found = search.find_documents(self.docs, self._vector(query), SearchFilters(shelves=[shelf] if shelf else []), limit)
        return _counted("documents", _rows(found.select(F.col("doc_id").alias("document_id"), "shelf", "title", "authors", "year", _day(), "summary", "score")))

    def search_manuals(self, query: str, device: str | None = None, limit: int = 5) -> dict:
        return self._search(query, SearchFilters(shelves=self.config.names("manuals"), source_dir=device), limit)

    def search_meetings(self, query: str, shelf: str | None = None, date_from: str | None = None, date_to: str | None = None, dates: list[str] | None = None, document_ids: list[int] | None = None, limit: int = 6) -> dict:
        f = SearchFilters(shelves=[shelf] if shelf else self.config.names("meetings"), document_ids=document_ids or [], date_from=_date(date_from), date_to=_date(date_to), dates=_dates(dates))
        return self._search(query, f, limit)

    def search_papers(self, query: str, document_ids: list[int] | None = None, author: str | None = None, year_from: int | None = None, year_to: int | None = None, limit: int = 6) -> dict:
        return self._search(query, SearchFilters(shelves=self.config.names("scientific"), document_ids=document_ids or [], author=author, year_from=year_from, year_to=year_to), limit)

    def get_context(self, chunk_id: int, before: int = 1, after: int = 1) -> dict:
        target = self.spark.createDataFrame([(chunk_id,)], "chunk_id long")
        near = search.context(self.chunks, target, before, after).orderBy("chunk_index")
        return {"passages": _rows(near.select("chunk_id", F.col("content").alias("text"), "section", F.col("page_start").alias("pages")))}

    def read_document(self, document_id: int, budget: int = search.READ_BUDGET) -> dict:
        d = self._document(document_id)
        if d is None:
            return {"error": f"No document with id {document_id}"}
        read = search.read_documents(self.chunks.where(F.col("document_id") == document_id), budget).first()
        out = {k: d[k] for k in ("document_id", "title", "filename", "date", "pages")}
        out |= {k: read[k] for k in ("text", "truncated", "chars_total")} if read else {"text": "", "truncated": False, "chars_total": 0}
        if out["truncated"]:
            out["note"] = f"The first {len(out['text'])} of {out['chars_total']} characters. Ask for the context of a chunk, or search this document, to read on."
        return out

    def get_document_info(self, document_id: int) -> dict:
        d = self._document(document_id)
        if d is None:
            return {"error": f"No document with id {document_id}"}
        return d | {"indexed_at": d["indexed_at"] and d["indexed_at"].isoformat()}

    def reindex(self, shelf: str | None = None) -> dict:
        if shelf and shelf not in self.config.shelves:
            return {"error": f"Unknown shelf {shelf!r}", "available": list(self.config.shelves)}
        if not self.requests:
            return {"error": "no request folder configured"}
        request(self.spark, self.requests, shelf or "*")
        return {"status": "requested", "shelf": shelf or "all"}
