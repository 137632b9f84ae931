"""Title, date, authors and summary of a document, by the type of its shelf."""

from __future__ import annotations

import logging
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as tx

# Identifiers in file names, and the abstract of a first page.
ARXIV = r"(\d{4}\.\d{4,5}(?:v\d+)?|[a-z\-]+(?:\.[A-Z]{2})?/\d{7})"
DOI = r"(10\.\d{4,9}[/_.][^\s]+)"
ABSTRACT = r"(?is)\bAbstract\b[:.\s]*(.{100,2500}?)(?:\n\s*\n|\bIntroduction\b|\b1\.?\s+Introduction\b)"


# The public look-up services.
CROSSREF_URL = "https://api.crossref.org/works/{}"
ARXIV_URL = "https://export.arxiv.org/api/query?id_list={}&max_results=1"
log = logging.getLogger(__name__)


def _found(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def arxiv_id(stem: Column) -> Column:
    return _found(stem, ARXIV)


def doi(stem: Column) -> Column:
    return _found(F.replace(stem, F.lit("_"), F.lit("/")), DOI)


def abstract(first_page: Column) -> Column:
    return F.nullif(tx.squeeze(F.regexp_extract(first_page, ABSTRACT, 1)), F.lit(""))


def first_text(pages: Column, limit: int) -> Column:
    """The first two pages in one line of up to ``limit`` characters."""
    return tx.strip(F.left(F.array_join(F.slice(pages, 1, 2), " "), F.lit(limit)))


def manual(df: DataFrame) -> DataFrame:
    """Of ``(rel_path, source_dir, pages)``: the folder is the title."""
    return df.withColumns({
        "title": F.col("source_dir"),
        "summary": F.concat(F.col("source_dir"), F.lit(" device manual. "), first_text(F.col("pages"), 800)),
        "extra": F.create_map(F.lit("revision"), tx.stem_of(F.col("rel_path"))),
        "doc_date": F.lit(None).cast("date"), "year": F.lit(None).cast("int"), "authors": F.lit(None).cast("array<string>"),
    })


def meeting(df: DataFrame) -> DataFrame:
    """Dated by folder, then file name, then the file's own created date; also needs ``prop_title`` and ``prop_created``."""
    stem = tx.stem_of(F.col("rel_path"))
    of_stem = dates.dir_date(stem)
    df = df.withColumn("doc_date", F.coalesce(dates.dir_date(F.col("source_dir")), of_stem, F.col("prop_created")))
    plain = tx.clean_stem(stem)
    dated = F.when(F.col("doc_date").isNotNull(), F.concat(plain, F.lit(" ("), F.date_format("doc_date", "yyyy-MM-dd"), F.lit(")"))).otherwise(plain)
    own = F.nullif(F.col("prop_title"), F.lit(""))
    return df.withColumns({
        "title": F.when(own.isNotNull() & of_stem.isNull(), own).otherwise(dated),
        "year": F.year("doc_date"),
        "summary": first_text(F.col("pages"), 1200),
        "extra": F.when(own.isNotNull(), F.create_map(F.lit("doc_title"), own)).otherwise(F.create_map().cast("map<string,string>")),
        "authors": F.lit(None).cast("array<string>"),
    })


def paper(df: DataFrame, crossref: DataFrame | None = None, arxiv: DataFrame | None = None) -> DataFrame:
    """Looked up by DOI, then arXiv id, else extracted (``font_title`` or the file name; abstract or first text).

    ``crossref`` and ``arxiv`` are tables ``(key, title, authors, doc_date,
    summary)`` fetched beforehand; the larger side of the join is the corpus.
    """
    empty = df.sparkSession.createDataFrame([], "key string, title string, authors array<string>, doc_date date, summary string")
    stem = tx.stem_of(F.col("rel_path"))
    df = df.withColumns({"doi_key": doi(stem), "arxiv_key": arxiv_id(stem)})
    for table, tag in ((empty if crossref is None else crossref, "c"), (empty if arxiv is None else arxiv, "a")):
        one = table.groupBy("key").agg(*[F.min(c).alias(f"{tag}_{c}") for c in ("title", "authors", "doc_date", "summary")], F.lit(True).alias(f"{tag}_hit"))
        key = "doi_key" if tag == "c" else "arxiv_key"
        df = df.join(one.withColumnRenamed("key", key), key, "left")
    pick = lambda c, other: F.when(F.col("c_hit"), F.col(f"c_{c}")).when(F.col("a_hit"), F.col(f"a_{c}")).otherwise(other)
    title = pick("title", F.coalesce("font_title", tx.clean_stem(stem)))
    body = pick("summary", F.coalesce(abstract(F.get("pages", F.lit(0))), first_text(F.col("pages"), 1200)))
    source = F.when(F.col("c_hit"), "crossref").when(F.col("a_hit"), "arxiv").otherwise("extracted")
    ident = F.when(F.col("c_hit"), F.create_map(F.lit("metadata_source"), source, F.lit("doi"), F.col("doi_key"))).when(
        F.col("a_hit"), F.create_map(F.lit("metadata_source"), source, F.lit("arxiv_id"), F.col("arxiv_key"))).otherwise(F.create_map(F.lit("metadata_source"), source))
    date = pick("doc_date", F.lit(None).cast("date"))
    out = df.withColumns({"title": title, "authors": pick("authors", F.lit(None).cast("array<string>")), "doc_date": date, "year": F.year(date), "body": body, "extra": ident})
    out = out.withColumn("summary", F.when(F.coalesce("body", F.lit("")) != "", F.concat("title", F.lit(". "), "body")).otherwise(F.col("body")))
    return out.drop("body", "doi_key", "arxiv_key", *[f"{t}_{c}" for t in "ca" for c in ("title", "authors", "doc_date", "summary", "hit")])


def crossref_record(reply: Column) -> Column:
    """``struct(title, authors, doc_date, summary)`` of a Crossref reply (JSON)."""
    msg = F.from_json(reply, "message struct<title:array<string>,author:array<struct<given:string,family:string>>,issued:struct<`date-parts`:array<array<int>>>,abstract:string>")["message"]
    parts = F.get(msg["issued"]["date-parts"], 0)
    at = lambda i: F.coalesce(F.get(parts, i), F.lit(1)).cast("string")
    full = F.try_to_date(F.concat_ws("-", F.get(parts, 0).cast("string"), F.lpad(at(1), 2, "0"), F.lpad(at(2), 2, "0")), "yyyy-MM-dd")
    first = F.try_to_date(F.concat(F.get(parts, 0).cast("string"), F.lit("-01-01")), "yyyy-MM-dd")
    return F.struct(
        tx.squeeze(F.get(msg["title"], 0)).alias("title"),
        F.filter(F.transform(msg["author"], lambda a: tx.strip(F.concat_ws(" ", a["given"], a["family"]))), lambda a: a != "").alias("authors"),
        F.when(F.get(parts, 0).isNotNull(), F.coalesce(full, first)).alias("doc_date"), tx.strip_tags(msg["abstract"]).alias("summary"))


def arxiv_record(reply: Column) -> Column:
    """The same of an arXiv reply (Atom)."""
    at = lambda p: tx.squeeze(F.xpath_string(reply, F.lit(p)))
    entry = "/*[local-name()='feed']/*[local-name()='entry']"
    return F.struct(
        at(f"{entry}/*[local-name()='title']").alias("title"),
        F.xpath(reply, F.lit(f"{entry}/*[local-name()='author']/*[local-name()='name']/text()")).alias("authors"),
        F.try_to_date(F.left(at(f"{entry}/*[local-name()='published']"), F.lit(10)), "yyyy-MM-dd").alias("doc_date"),
        at(f"{entry}/*[local-name()='summary']").alias("summary"))


def fetched(keys: DataFrame, url: str, timeout: float = 20.0) -> DataFrame:
    """``(key, reply)`` of the distinct ``key``s of a table, asked on the executors; a failed request has no row and stops nothing."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key in pdf["key"]:
                try:
                    with urllib.request.urlopen(url.format(urllib.parse.quote(key, safe="/")), timeout=timeout) as r:
                        rows.append((key, r.read().decode("utf-8", "replace")))
                except (OSError, ValueError) as e:
                    log.warning("look-up of %s failed: %s", key, e)
            yield pd.DataFrame(rows, columns=["key", "reply"])

    return keys.where("key IS NOT NULL").select("key").distinct().mapInPandas(run, "key string, reply string")


def lookups(files: DataFrame, crossref_url: str = CROSSREF_URL, arxiv_url: str = ARXIV_URL) -> dict[str, DataFrame]:
    """The tables ``paper`` joins, fetched for the file names in ``rel_path``; arXiv is asked only where Crossref has no answer."""
    stem = tx.stem_of(F.col("rel_path"))
    names = files.select(doi(stem).alias("doi"), arxiv_id(stem).alias("arxiv"))
    record = lambda df, make: df.select("key", make(F.col("reply")).alias("r")).select("key", "r.*").where("title IS NOT NULL")
    cross = record(fetched(names.select(F.col("doi").alias("key")), crossref_url), crossref_record)
    rest = names.join(cross.select(F.col("key").alias("doi")), "doi", "left_anti")
    return {"crossref": cross, "arxiv": record(fetched(rest.select(F.col("arxiv").alias("key")), arxiv_url), arxiv_record).where("title <> ''")}
