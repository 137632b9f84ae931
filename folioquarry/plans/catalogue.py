"""Named queries over the library tables, each with the SQL it must equal.

Every query reads its whole tables.  A limit stands only where the operator is a
top-k or listing.  Arrays and dates leave as text, counts as bigint, scores
rounded, so that both engines can be compared value by value.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ChunkingConfig, EmbeddingConfig
from ..embed import embed_column
from ..functions import dates, fulltext, vectors
from ..functions import text as tx
from ..operators import chunking, index, merge, metadata, search
from ..operators.search import SearchFilters
from ..runtime import Scratch, table
from ..schema import violations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
QUERY_ID = 3
WORD = "minutes"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _vec(spark: SparkSession, d: str, query_id: int = QUERY_ID) -> list[float]:
    """The vector of one query: one row of a fixed table of 400."""
    return list(table(spark, d, "queries").where(F.col("query_id") == query_id).first()["query_vector"])


_UNIT = "SELECT query_vector::DOUBLE[] AS q FROM queries WHERE query_id = 3"
_VEC = f"""vec AS (
  SELECT chunk_id, similarity, row_number() OVER (ORDER BY similarity DESC, chunk_id) AS rank FROM (
    SELECT c.id AS chunk_id, round(list_cosine_similarity(c.embedding::DOUBLE[], q), 6) AS similarity
    FROM chunks c JOIN documents d ON d.doc_id = c.document_id, ({_UNIT})
    WHERE c.embedding IS NOT NULL AND list_inner_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]) > 0 {{where}}
    ORDER BY similarity DESC, chunk_id LIMIT 60))"""
_KW = """kw AS (
  SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT c.id AS chunk_id, round(len(list_filter(c.tsv, lambda x: x = '{word}')) * 0.1::DOUBLE, 6) AS score
    FROM chunks c JOIN documents d ON d.doc_id = c.document_id WHERE list_contains(c.tsv, '{word}') {where}
    ORDER BY score DESC, chunk_id LIMIT 60))"""
_FUSED = """fused AS (SELECT coalesce(v.chunk_id, k.chunk_id) AS chunk_id, v.rank AS vector_rank, k.rank AS keyword_rank,
  round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + k.rank), 0), 9) AS score FROM vec v FULL JOIN kw k ON v.chunk_id = k.chunk_id)"""
_HITS = """SELECT f.chunk_id, f.vector_rank, f.keyword_rank, f.score, d.shelf, d.title, c.section FROM (SELECT * FROM fused ORDER BY score DESC, chunk_id LIMIT {limit}) f
  JOIN chunks c ON c.id = f.chunk_id JOIN documents d ON d.doc_id = c.document_id"""


def _hybrid_sql(word: str, where: str = "", limit: int = 8) -> str:
    return f"WITH {_VEC.format(where=where)}, {_KW.format(word=word, where=where)}, {_FUSED} {_HITS.format(limit=limit)}"


def _hits(df: DataFrame) -> DataFrame:
    return df.select("chunk_id", "vector_rank", "keyword_rank", "score", "shelf", "title", "section")


# Documents and shelves

@query("SELECT s.name, s.type, s.description, count(d.doc_id) AS documents, CAST(min(d.doc_date) AS VARCHAR) AS first_date, CAST(max(d.doc_date) AS VARCHAR) AS last_date FROM shelves s LEFT JOIN documents d ON d.shelf = s.name GROUP BY 1, 2, 3")
def list_shelves(spark: SparkSession, d: str) -> DataFrame:
    out = search.list_shelves(table(spark, d, "shelves"), table(spark, d, "documents"))
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


_LIST = "SELECT doc_id, shelf, title, source_dir, strftime(doc_date, '%Y-%m-%d') AS doc_date, page_count, left(summary, 300) AS summary FROM documents WHERE {} ORDER BY documents.doc_date DESC NULLS LAST, title ASC NULLS LAST, doc_id LIMIT 200"


@query(_LIST.format("documents.doc_date >= DATE '2020-01-01' AND documents.doc_date <= DATE '2021-12-31'"))
def list_documents_range(spark: SparkSession, d: str) -> DataFrame:
    return search.list_documents(table(spark, d, "documents"), SearchFilters(date_from=dt.date(2020, 1, 1), date_to=dt.date(2021, 12, 31)))


@query(_LIST.format("documents.doc_date IN (DATE '2020-06-13', DATE '2023-08-08', DATE '2019-02-20')"))
def list_documents_dates(spark: SparkSession, d: str) -> DataFrame:
    return search.list_documents(table(spark, d, "documents"), SearchFilters(dates=[dt.date(2020, 6, 13), dt.date(2023, 8, 8), dt.date(2019, 2, 20)]))


@query(_LIST.format("year >= 2022 AND year <= 2023"))
def list_documents_year(spark: SparkSession, d: str) -> DataFrame:
    return search.list_documents(table(spark, d, "documents"), SearchFilters(year_from=2022, year_to=2023))


@query(_LIST.format("true"))
def list_documents_all(spark: SparkSession, d: str) -> DataFrame:
    return search.list_documents(table(spark, d, "documents"), SearchFilters(shelves=[], source_dir="", year_from=0))


@query("SELECT doc_id, shelf, rel_path FROM documents WHERE shelf IN ('articles', 'lab_reports') AND doc_id IN (5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55)")
def shelf_and_ids(spark: SparkSession, d: str) -> DataFrame:
    f = SearchFilters(shelves=["articles", "lab_reports"], document_ids=list(range(5, 56, 5)))
    return search.filtered(table(spark, d, "documents"), f).select("doc_id", "shelf", "rel_path")


@query("SELECT doc_id, source_dir FROM documents WHERE source_dir ILIKE '%mini_4%'")
def dir_ilike(spark: SparkSession, d: str) -> DataFrame:
    return search.filtered(table(spark, d, "documents"), SearchFilters(source_dir="mini_4")).select("doc_id", "source_dir")


@query("SELECT doc_id, array_to_string(authors, '; ') AS authors FROM documents WHERE len(list_filter(authors, lambda a: a ILIKE '%est%')) > 0")
def author_any_ilike(spark: SparkSession, d: str) -> DataFrame:
    return search.filtered(table(spark, d, "documents"), SearchFilters(author="est")).select("doc_id", F.array_join("authors", "; ").alias("authors"))


@query(f"""SELECT doc_id, shelf, title, source_dir, array_to_string(authors, '; ') AS authors, CAST(doc_date AS VARCHAR) AS doc_date, year, left(summary, 600) AS summary, round(score, 4) AS score FROM (
  SELECT d.*, round(list_cosine_similarity(summary_embedding::DOUBLE[], q), 6) AS score FROM documents d, ({_UNIT})
  WHERE summary_embedding IS NOT NULL AND list_inner_product(summary_embedding::DOUBLE[], summary_embedding::DOUBLE[]) > 0 ORDER BY score DESC, doc_id LIMIT 10)""")
def find_documents(spark: SparkSession, d: str) -> DataFrame:
    out = search.find_documents(table(spark, d, "documents"), _vec(spark, d))
    return out.withColumns({"authors": F.array_join("authors", "; "), "doc_date": F.col("doc_date").cast("string")})


@query("SELECT doc_id, shelf, rel_path, filename, source_dir, title, CAST(doc_date AS VARCHAR) AS doc_date, year, page_count FROM documents WHERE doc_id = 5")
def document_info(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_id = 5").select("doc_id", "shelf", "rel_path", "filename", "source_dir", "title", F.col("doc_date").cast("string").alias("doc_date"), "year", "page_count")


@query("SELECT id AS chunk_id, chunk_index, page_start, page_end, section, content FROM chunks WHERE document_id = 5")
def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("document_id = 5").orderBy("chunk_index").select(F.col("id").alias("chunk_id"), "chunk_index", "page_start", "page_end", "section", "content")


# Retrieval

@query(f"WITH {_VEC.format(where='')} SELECT * FROM vec")
def vector_arm(spark: SparkSession, d: str) -> DataFrame:
    return search.vector_arm(table(spark, d, "chunks"), table(spark, d, "documents"), _vec(spark, d))


@query(f"WITH {_KW.format(word=WORD, where='')} SELECT * FROM kw")
def keyword_arm(spark: SparkSession, d: str) -> DataFrame:
    return search.keyword_arm(table(spark, d, "chunks"), table(spark, d, "documents"), WORD)


def _matching(spark: SparkSession, d: str, text: str) -> DataFrame:
    q = fulltext.parse(text)
    return table(spark, d, "chunks").where(fulltext.match(q, F.col("tsv"))).select(F.col("id").alias("chunk_id"))


@query("SELECT id AS chunk_id FROM chunks WHERE list_contains(tsv, 'water') AND list_contains(tsv, 'board')")
def keyword_and(spark: SparkSession, d: str) -> DataFrame:
    return _matching(spark, d, "Water board")


@query("SELECT id AS chunk_id, round(len(list_filter(tsv, lambda x: x IN ('boiler', 'lamp'))) * 0.1::DOUBLE, 6) AS score FROM chunks WHERE list_contains(tsv, 'boiler') OR list_contains(tsv, 'lamp')")
def keyword_or(spark: SparkSession, d: str) -> DataFrame:
    q = fulltext.parse("boiler OR lamp")
    c = table(spark, d, "chunks").where(fulltext.match(q, F.col("tsv")))
    return c.select(F.col("id").alias("chunk_id"), F.round(fulltext.rank(q, F.col("tsv")), 6).alias("score"))


@query("SELECT id AS chunk_id FROM chunks WHERE list_contains(tsv, 'water') AND NOT list_contains(tsv, 'board')")
def keyword_not(spark: SparkSession, d: str) -> DataFrame:
    return _matching(spark, d, "water -board")


@query("SELECT id AS chunk_id FROM chunks WHERE ' ' || array_to_string(tsv, ' ') || ' ' LIKE '% annual meeting %' AND list_contains(tsv, 'minutes')")
def keyword_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _matching(spark, d, '"annual meeting" minutes')


@query("""WITH w AS (SELECT id, unnest(tsv) AS t, generate_subscripts(tsv, 1) AS p FROM chunks), h AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS nth FROM w WHERE t IN ('board', 'decided', 'euros')),
  l AS (SELECT *, max(p) FILTER (t = 'board') OVER o AS a, max(p) FILTER (t = 'decided') OVER o AS b, max(p) FILTER (t = 'euros') OVER o AS c FROM h WINDOW o AS (PARTITION BY id ORDER BY p ROWS UNBOUNDED PRECEDING)),
  s AS (SELECT *, least(a, b, c) AS s FROM l WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL), f AS (SELECT *, lag(s) OVER (PARTITION BY id ORDER BY p) AS before FROM s)
  SELECT f.id AS chunk_id, round(sum(0.1::DOUBLE / (1 + (f.p - f.s) - (f.nth - h.nth))), 6) AS score FROM f JOIN h ON h.id = f.id AND h.p = f.s WHERE before IS NULL OR f.s > before GROUP BY 1""")
def keyword_rank_cover(spark: SparkSession, d: str) -> DataFrame:
    """Cover density of three terms over all chunks that hold them."""
    q = fulltext.parse("board decided euros")
    c = table(spark, d, "chunks").where(fulltext.match(q, F.col("tsv")))
    return c.select(F.col("id").alias("chunk_id"), F.round(fulltext.rank(q, F.col("tsv")), 6).alias("score"))


@query(_hybrid_sql(WORD))
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return _hits(search.hybrid(table(spark, d, "chunks"), table(spark, d, "documents"), WORD, _vec(spark, d)))


@query(_hybrid_sql("board", "AND d.shelf IN ('staff_meetings', 'yard_meetings') AND d.doc_date >= DATE '2020-01-01' AND d.source_dir ILIKE '%20%'"))
def hybrid_filtered(spark: SparkSession, d: str) -> DataFrame:
    f = SearchFilters(shelves=["staff_meetings", "yard_meetings"], date_from=dt.date(2020, 1, 1), source_dir="20")
    return _hits(search.hybrid(table(spark, d, "chunks"), table(spark, d, "documents"), "board", _vec(spark, d), f))


@query(_hybrid_sql("nosuchwordanywhere"))
def hybrid_empty_keyword(spark: SparkSession, d: str) -> DataFrame:
    return _hits(search.hybrid(table(spark, d, "chunks"), table(spark, d, "documents"), "nosuchwordanywhere", _vec(spark, d)))


@query(f"WITH {_VEC.format(where='')}, {_KW.format(word=WORD, where='')}, {_FUSED} SELECT * FROM fused")
def rrf_union_variant(spark: SparkSession, d: str) -> DataFrame:
    c, docs = table(spark, d, "chunks"), table(spark, d, "documents")
    return search.fuse_union(search.vector_arm(c, docs, _vec(spark, d)), search.keyword_arm(c, docs, WORD))


@query(f"WITH {_VEC.format(where='')}, {_KW.format(word=WORD, where='')}, {_FUSED} SELECT * FROM fused")
def rrf_full_join(spark: SparkSession, d: str) -> DataFrame:
    c, docs = table(spark, d, "chunks"), table(spark, d, "documents")
    return search.fuse(search.vector_arm(c, docs, _vec(spark, d)), search.keyword_arm(c, docs, WORD))


@query("""SELECT c.id AS chunk_id, c.document_id, d.filename, CASE WHEN page_start <> 0 AND page_end <> 0 AND page_start <> page_end THEN page_start || '-' || page_end WHEN page_start <> 0 THEN page_start::VARCHAR END AS pages,
  nullif(section, '') AS section, strftime(d.doc_date, '%Y-%m-%d') AS date, array_to_string(authors[1:5], '; ') AS authors FROM chunks c JOIN documents d ON d.doc_id = c.document_id""")
def citations(spark: SparkSession, d: str) -> DataFrame:
    out = search.citation(search.chunk_citations(table(spark, d, "chunks"), table(spark, d, "documents")))
    return out.select("chunk_id", "citation.document_id", "citation.filename", "citation.pages", "citation.section", "citation.date", F.array_join("citation.authors", "; ").alias("authors"))


@query("SELECT c.id AS chunk_id, c.document_id, c.chunk_index, c.page_start, c.page_end, c.section, c.content, c.token_count, d.shelf, d.rel_path, d.filename, d.source_dir, d.title, array_to_string(d.authors, '; ') AS authors, CAST(d.doc_date AS VARCHAR) AS doc_date, d.year FROM chunks c JOIN documents d ON d.doc_id = c.document_id")
def chunk_citations(spark: SparkSession, d: str) -> DataFrame:
    out = search.chunk_citations(table(spark, d, "chunks"), table(spark, d, "documents"))
    return out.withColumns({"authors": F.array_join("authors", "; "), "doc_date": F.col("doc_date").cast("string")})


@query("SELECT t.id AS target, c.id AS chunk_id, c.document_id, c.chunk_index, c.page_start, c.section, c.content FROM chunks t JOIN chunks c ON c.document_id = t.document_id AND c.chunk_index BETWEEN t.chunk_index - 1 AND t.chunk_index + 1")
def context_window(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return search.context(c, c.select(F.col("id").alias("chunk_id")))


@query("""WITH r AS (SELECT document_id, id, chunk_index, content, coalesce(sum(length(content) + 2) OVER (PARTITION BY document_id ORDER BY chunk_index, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 24000 AS shown FROM chunks)
  SELECT document_id, coalesce(string_agg(CASE WHEN shown THEN content END, chr(10) || chr(10) ORDER BY chunk_index, id), '') AS text, CAST(sum(length(content)) AS BIGINT) AS chars_total, count(*) FILTER (shown) AS shown, count(*) AS chunks,
  least(count(*) FILTER (shown) + 1, count(*)) < count(*) AS truncated FROM r GROUP BY 1""")
def read_document_budget(spark: SparkSession, d: str) -> DataFrame:
    return search.read_documents(table(spark, d, "chunks"))


@query(f"""WITH {_VEC.format(where='')}, {_KW.format(word=WORD, where='')}, {_FUSED} SELECT f.chunk_id, c.content AS text, round_even(f.score, 5) AS score, d.doc_id AS document_id, d.shelf, d.title, d.filename,
  CASE WHEN page_start <> 0 AND page_end <> 0 AND page_start <> page_end THEN page_start || '-' || page_end WHEN page_start <> 0 THEN page_start::VARCHAR END AS pages, nullif(c.section, '') AS section, strftime(d.doc_date, '%Y-%m-%d') AS date
  FROM (SELECT * FROM fused ORDER BY score DESC, chunk_id LIMIT 8) f JOIN chunks c ON c.id = f.chunk_id JOIN documents d ON d.doc_id = c.document_id""")
def hit_json(spark: SparkSession, d: str) -> DataFrame:
    """The hits as JSON, read back field by field."""
    hits = search.hit_json(search.hybrid(table(spark, d, "chunks"), table(spark, d, "documents"), WORD, _vec(spark, d)))
    at = lambda *path: F.get_json_object("hit", "$." + ".".join(path)).alias(path[-1])
    cited = [at("citation", c) for c in ("shelf", "title", "filename", "pages", "section", "date")]
    return hits.select(at("chunk_id").cast("long").alias("chunk_id"), at("text"), at("score").cast("double").alias("score"), at("citation", "document_id").cast("long").alias("document_id"), *cited)


@query("SELECT label, i AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS value FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2)")
def mean_vector(spark: SparkSession, d: str) -> DataFrame:
    m = vectors.mean_vectors(table(spark, d, "embeddings"), ["label"], "embedding")
    return m.select("label", F.posexplode("mean").alias("p", "v")).select("label", (F.col("p") + 1).cast("bigint").alias("pos"), F.round("v", 6).alias("value"))


# The same retrieval over indexes, built once per session and data directory

_BUILT: dict[tuple[str, str], tuple] = {}
DIM = 64


def _indexes(spark: SparkSession, d: str) -> tuple[index.VectorCells, index.Postings]:
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        at, chunks = Scratch(spark, "index").root, table(spark, d, "chunks")
        _BUILT[key] = index.VectorCells.build(chunks, at, DIM), index.Postings.build(chunks, at)
    return _BUILT[key]


@query(ORACLE["vector_arm"])
def vector_cells_exact(spark: SparkSession, d: str) -> DataFrame:
    """Every cell probed: the exact arm."""
    return _indexes(spark, d)[0].arm(table(spark, d, "documents"), _vec(spark, d), probes=None)


@query()
def vector_cells_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the ten nearest of all queries by the part of the cells that is probed."""
    cells, _ = _indexes(spark, d)
    asked = table(spark, d, "queries").select("query_id", F.col("query_vector").alias("vector"))
    return index.recall(cells, index.batch_arm(table(spark, d, "chunks"), asked, DIM), asked, DIM)


@query("""SELECT query_id, chunk_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM (
  SELECT q.query_id, c.id AS chunk_id, round(list_cosine_similarity(c.embedding::DOUBLE[], q.query_vector::DOUBLE[]), 6) AS similarity FROM queries q, chunks c
  WHERE c.embedding IS NOT NULL AND list_inner_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]) > 0)) WHERE rank <= 10""")
def vector_batch(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest chunks of each of the 400 queries."""
    asked = table(spark, d, "queries").select("query_id", F.col("query_vector").alias("vector"))
    return index.batch_arm(table(spark, d, "chunks"), asked, DIM)


@query(ORACLE["keyword_arm"])
def keyword_postings(spark: SparkSession, d: str) -> DataFrame:
    return _indexes(spark, d)[1].arm(table(spark, d, "documents"), WORD)


def _posted(spark: SparkSession, d: str, text: str) -> DataFrame:
    return _indexes(spark, d)[1].matches(table(spark, d, "documents"), text).select("chunk_id")


@query(ORACLE["keyword_not"])
def keyword_postings_not(spark: SparkSession, d: str) -> DataFrame:
    return _posted(spark, d, "water -board")


@query(ORACLE["keyword_or"])
def keyword_postings_or(spark: SparkSession, d: str) -> DataFrame:
    return _indexes(spark, d)[1].matches(table(spark, d, "documents"), "boiler OR lamp")


@query(ORACLE["keyword_phrase"])
def keyword_postings_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _posted(spark, d, '"annual meeting" minutes')


@query("""WITH w AS (SELECT id, unnest(tsv) AS t, generate_subscripts(tsv, 1) - 1 AS p FROM chunks) SELECT t AS term, id AS chunk_id, array_to_string(list(p ORDER BY p), ' ') AS places FROM w GROUP BY 1, 2""")
def postings(spark: SparkSession, d: str) -> DataFrame:
    at = _indexes(spark, d)[1]
    return spark.read.schema(at.SCHEMA).parquet(f"{at.path}/postings").select("term", "chunk_id", F.array_join("places", " ").alias("places"))


@query(ORACLE["hybrid_rrf"])
def hybrid_indexed(spark: SparkSession, d: str) -> DataFrame:
    cells, posted = _indexes(spark, d)
    return _hits(index.hybrid(cells, posted, table(spark, d, "chunks"), table(spark, d, "documents"), WORD, _vec(spark, d), probes=None))


# Change detection, upsert, constraints

_SCANS = "latest AS (SELECT rel_path, arg_max({'h': content_hash, 'o': outcome}, (scanned_at, scan_id)) AS s FROM file_scans WHERE rel_path IS NOT NULL GROUP BY 1), seen AS (SELECT rel_path, s.h AS h FROM latest WHERE s.o <> 'deleted')"
_DIFF = f"""WITH {_SCANS} SELECT coalesce(s.rel_path, d.rel_path) AS rel_path, CASE WHEN s.rel_path IS NULL THEN 'deleted' WHEN s.h = d.content_hash THEN 'skipped' ELSE 'indexed' END AS status
  FROM seen s FULL JOIN documents d ON d.rel_path = s.rel_path"""


def _diff(spark: SparkSession, d: str, force: bool = False) -> DataFrame:
    seen = merge.latest_scans(table(spark, d, "file_scans")).where("outcome <> 'deleted'")
    return merge.scan_diff(seen, table(spark, d, "documents"), force)


@query(_DIFF)
def scan_diff(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d)


@query(f"SELECT count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'deleted') AS deleted, count(*) FILTER (status = 'failed') AS failed FROM ({_DIFF})")
def scan_counters(spark: SparkSession, d: str) -> DataFrame:
    return merge.counters(_diff(spark, d))


@query(_DIFF.replace("s.h = d.content_hash", "false"))
def scan_diff_forced(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d, force=True)


@query("SELECT source_dir, outcome, count(*) AS n FROM (SELECT DISTINCT * FROM file_scans) s JOIN documents d ON d.rel_path = s.rel_path GROUP BY 1, 2")
def scans_by_folder(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "file_scans").distinct().select("rel_path", "outcome")
    return s.join(table(spark, d, "documents").select("rel_path", "source_dir"), "rel_path").groupBy("source_dir", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_SCANS}, incoming AS (SELECT rel_path, h AS content_hash FROM seen UNION ALL SELECT 'copy/' || rel_path, h FROM seen)
  SELECT coalesce(d.doc_id, ('0x' || md5(i.rel_path)[1:15])::BIGINT) AS doc_id, i.rel_path, i.content_hash FROM incoming i LEFT JOIN documents d ON d.rel_path = i.rel_path
  UNION ALL SELECT doc_id, rel_path, content_hash FROM documents WHERE rel_path NOT IN (SELECT rel_path FROM incoming)""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """The latest scans, and as many new paths, over the documents: known paths keep their id, new ones get one made from the path."""
    old = table(spark, d, "documents").select("doc_id", "rel_path", "content_hash")
    seen = merge.latest_scans(table(spark, d, "file_scans")).where("outcome <> 'deleted'").select("rel_path", "content_hash")
    new = seen.unionByName(seen.withColumn("rel_path", F.concat(F.lit("copy/"), "rel_path")))
    ident = F.conv(F.left(F.md5("rel_path"), F.lit(15)), 16, 10).cast("bigint")
    return merge.upsert(old, new.withColumn("doc_id", ident), "rel_path", keep=("doc_id",))


_GONE = f"(WITH {_SCANS} SELECT d.doc_id FROM documents d WHERE d.rel_path NOT IN (SELECT rel_path FROM seen))"


@query(f"SELECT 'documents' AS item, count(*) AS n FROM documents WHERE doc_id NOT IN {_GONE} UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE document_id NOT IN {_GONE} UNION ALL SELECT 'removed', count(*) FROM documents WHERE doc_id IN {_GONE}")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    docs, chunks = table(spark, d, "documents"), table(spark, d, "chunks")
    gone = docs.join(_diff(spark, d).where("status = 'deleted'"), "rel_path", "left_semi").select(F.col("doc_id").alias("document_id"))
    a, b = merge.delete_documents(docs, chunks, gone, "doc_id")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("item"), "n")
    return n(a, "documents").unionByName(n(b, "chunks")).unionByName(n(gone, "removed"))


@query("""SELECT name, CASE WHEN name = 'articles' THEN 'articles' ELSE description END AS description, dir_meaning, type FROM shelves UNION ALL SELECT 'new_shelf', 'new_shelf', 'date', 'meetings'""")
def sync_shelves(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "shelves")
    new = s.where("name = 'articles'").withColumn("description", F.lit("")).unionByName(spark.createDataFrame([("new_shelf", None, "date", None, "meetings", None)], s.schema))
    return merge.sync_shelves(s, new).select("name", "description", "dir_meaning", "type")


@query("SELECT name, type FROM shelves UNION ALL SELECT 'spare', 'manuals'")
def seed_shelves(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "shelves").select("name", "type")
    return merge.seed(s, spark.createDataFrame([("articles", "manuals"), ("spare", "manuals")], s.schema), "name")


@query("SELECT name, CASE dir_meaning WHEN 'device' THEN 'manuals' WHEN 'date' THEN 'meetings' ELSE 'scientific' END AS type FROM shelves")
def backfill_types(spark: SparkSession, d: str) -> DataFrame:
    return merge.backfill_type(table(spark, d, "shelves").withColumn("type", F.lit(None).cast("string"))).select("name", "type")


@query("""SELECT 'shelves.dir_meaning' AS rule, count(*) AS violations FROM shelves WHERE dir_meaning NOT IN ('device', 'date', 'none') UNION ALL
 SELECT 'shelves.type', count(*) FROM shelves WHERE type NOT IN ('manuals', 'meetings', 'scientific') UNION ALL
 SELECT 'shelves.name', count(*) FROM (SELECT name FROM shelves GROUP BY 1 HAVING count(*) > 1) UNION ALL
 SELECT 'documents.id', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1) UNION ALL
 SELECT 'documents.rel_path', count(*) FROM (SELECT rel_path FROM documents GROUP BY 1 HAVING count(*) > 1) UNION ALL
 SELECT 'documents.shelf', count(*) FROM documents WHERE shelf IS NOT NULL AND shelf NOT IN (SELECT name FROM shelves) UNION ALL
 SELECT 'chunks.document_id_chunk_index', count(*) FROM (SELECT 1 FROM chunks GROUP BY document_id, chunk_index HAVING count(*) > 1) UNION ALL
 SELECT 'chunks.page_order', count(*) FROM chunks WHERE page_end < page_start UNION ALL
 SELECT 'chunks.document_id', count(*) FROM chunks WHERE document_id NOT IN (SELECT doc_id FROM documents)""")
def constraint_checks(spark: SparkSession, d: str) -> DataFrame:
    return violations(table(spark, d, "shelves"), table(spark, d, "documents"), table(spark, d, "chunks"), "doc_id")


# Text

_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _clean_sql(x: str) -> str:
    x = f"regexp_replace(nfc_normalize({x}), '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x{{9f}}]', ' ', 'g')"
    x = f"regexp_replace({x}, '[\\x{{fffd}}\\x{{e000}}-\\x{{f8ff}}\\p{{Cf}}]', '', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return _strip_sql(x)


@query(f"SELECT doc_id, {_clean_sql('text')} AS text FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("text"))


@query("SELECT doc_id, coalesce(regexp_matches(text, '[\\p{L}\\p{N}]'), false) AS embeddable FROM documents")
def is_embeddable(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.is_embeddable(F.col("text")).alias("embeddable"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query(f"SELECT id AS chunk_id, {_strip_sql(f'regexp_replace(content, $${_WS}+$$, $$ $$, $$g$$)')} AS line FROM chunks".replace("$$", "'"))
def wire_safe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), tx.wire_safe(F.col("content")).alias("line"))


@query("SELECT id AS chunk_id, CAST(length(content) // 4 AS INTEGER) AS tokens, CAST(length(content) // 2 + 1 AS INTEGER) AS wire_tokens FROM chunks")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), tx.chunk_tokens(F.col("content")).alias("tokens"), tx.wire_tokens(F.col("content")).alias("wire_tokens"))


@query("SELECT id AS chunk_id, array_to_string(tsv, ' ') AS terms FROM chunks")
def tokenise(spark: SparkSession, d: str) -> DataFrame:
    """Terms made from the content; the stored index column is what they must equal."""
    return table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), F.array_join(tx.tokens(F.col("content")), " ").alias("terms"))


@query("SELECT id AS chunk_id, CAST(len(string_split(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS BIGINT) AS n, string_split(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1] AS first FROM chunks")
def sentences(spark: SparkSession, d: str) -> DataFrame:
    s = tx.sentences(F.col("content"))
    return table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), F.size(s).cast("bigint").alias("n"), F.get(s, F.lit(0)).alias("first"))


@query()
def text_pages(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_pages(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


_PAGES_SQL = f"""raw AS (SELECT doc_id, unnest(string_split(text, chr(12))) AS t, generate_subscripts(string_split(text, chr(12)), 1) AS pos FROM documents WHERE text IS NOT NULL),
  pages AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS page, t FROM (SELECT doc_id, pos, {_clean_sql('t')} AS t FROM raw) WHERE regexp_matches(t, '[\\p{{L}}\\p{{N}}]'))"""
_HEADING_SQL = tx.HEADING.replace(r"\w", r"\p{L}\p{N}_").replace(r"\s", _WS).replace(r"\S", "[^" + _WS[1:]).replace(r"\d", r"\p{Nd}")
ORACLE["text_pages"] = f"WITH {_PAGES_SQL} SELECT doc_id, CAST(page AS INTEGER) AS page, t AS text FROM pages"


@query(f"""WITH {_PAGES_SQL}, heads AS (SELECT *, {_strip_sql("string_split(t, chr(10))[1]")} AS l FROM pages),
  own AS (SELECT doc_id, page, t, CASE WHEN length(l) < 90 AND regexp_matches(l, '{_HEADING_SQL}') THEN l END AS head FROM heads),
  carried AS (SELECT doc_id, page, t, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM own)
  SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(para AS INTEGER) AS para, text, section FROM (SELECT doc_id, page, section, unnest(string_split(t, chr(10) || chr(10))) AS x, generate_subscripts(string_split(t, chr(10) || chr(10)), 1) - 1 AS para, {_strip_sql('x')} AS text FROM carried) WHERE text <> ''""")
def paragraphs_sections(spark: SparkSession, d: str) -> DataFrame:
    pages = chunking.split_pages(table(spark, d, "documents"), "doc_id", "text")
    return chunking.paragraphs(pages).withColumnRenamed("id", "doc_id")


_FOLD_SQL = f"""WITH RECURSIVE {_PAGES_SQL}, heads AS (SELECT *, {_strip_sql("string_split(t, chr(10))[1]")} AS l FROM pages),
  own AS (SELECT doc_id, page, t, CASE WHEN length(l) < 90 AND regexp_matches(l, '{_HEADING_SQL}') THEN l END AS head FROM heads),
  carried AS (SELECT doc_id, page, t, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM own),
  cut AS (SELECT doc_id, page, section, unnest(string_split(t, chr(10) || chr(10))) AS x, generate_subscripts(string_split(t, chr(10) || chr(10)), 1) AS para FROM carried),
  paras AS (SELECT doc_id, page, section, text, row_number() OVER (PARTITION BY doc_id ORDER BY page, para) AS i FROM (SELECT *, {_strip_sql('x')} AS text FROM cut) WHERE text <> ''),
  docs AS (SELECT doc_id, list(struct_pack(t := text, n := length(text), page := page, section := section) ORDER BY i) AS p FROM paras GROUP BY 1),
  -- one step per paragraph: the buffer is first..i - 1 with size characters; what a step closes is from..till, or a long paragraph
  fold AS (
    SELECT doc_id, 0::BIGINT AS i, 1::BIGINT AS first, 0::BIGINT AS size, NULL::BIGINT AS a, NULL::BIGINT AS z, NULL::BIGINT AS long FROM docs
    UNION ALL
    SELECT doc_id, i, CASE WHEN big OR full_ AND carry >= 1600 THEN i + 1 WHEN full_ THEN back ELSE first END,
      CASE WHEN big OR full_ AND carry >= 1600 THEN 0 WHEN full_ THEN carry ELSE grown END,
      CASE WHEN big AND first < i OR full_ THEN first END, CASE WHEN big AND first < i THEN i - 1 WHEN full_ THEN i END, CASE WHEN big THEN i END
    FROM (SELECT *, list_sum([q.n FOR q IN p[back : i]])::BIGINT AS carry FROM (
      SELECT *, NOT big AND grown >= 1600 AS full_,
        greatest(first, coalesce(list_max([k FOR k IN range(first, i + 1) IF list_sum([q.n FOR q IN p[k : i]]) >= 240]), first)) AS back
      FROM (SELECT f.doc_id, f.i + 1 AS i, f.first, p, p[f.i + 1].n > 2400 AS big, f.size + p[f.i + 1].n AS grown FROM fold f JOIN docs d ON d.doc_id = f.doc_id WHERE f.i < len(p))))
  ),
  last_ AS (SELECT doc_id, max(i) AS i FROM fold GROUP BY 1),
  closed AS (SELECT doc_id, i, 0 AS sub, a, z FROM fold WHERE a IS NOT NULL UNION ALL SELECT f.doc_id, f.i + 1, 0, f.first, f.i FROM fold f JOIN last_ l ON l.doc_id = f.doc_id AND l.i = f.i WHERE f.first <= f.i),
  plain AS (SELECT c.doc_id, c.i, 0::BIGINT AS sub, {_clean_sql("array_to_string([q.t FOR q IN p[a : z]], chr(10) || chr(10))")} AS content, p[a].page AS page_start, p[z].page AS page_end, list_filter([q.section FOR q IN p[a : z]], lambda v: v IS NOT NULL)[1] AS section FROM closed c JOIN docs d ON d.doc_id = c.doc_id),
  sent AS (SELECT f.doc_id, f.i, string_split(regexp_replace(p[f.long].t, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1)) AS s, p[f.long].page AS page, p[f.long].section AS section FROM fold f JOIN docs d ON d.doc_id = f.doc_id WHERE f.long IS NOT NULL),
  pieces AS (
    SELECT doc_id, i, 1::BIGINT AS k, s[1] AS cur, NULL::VARCHAR AS piece, s, page, section FROM sent
    UNION ALL
    SELECT doc_id, i, k + 1, CASE WHEN length(cur) + length(s[k + 1]) > 1600 THEN s[k + 1] ELSE cur || ' ' || s[k + 1] END, CASE WHEN length(cur) + length(s[k + 1]) > 1600 THEN cur END, s, page, section FROM pieces WHERE k < len(s)
  ),
  longs AS (SELECT doc_id, i, k AS sub, piece AS content, page, section FROM pieces WHERE piece IS NOT NULL UNION ALL SELECT doc_id, i, k + 1, cur, page, section FROM pieces WHERE k = len(s)),
  every AS (SELECT * FROM plain WHERE length(content) >= 160 UNION ALL SELECT doc_id, i, sub, content, page, page, section FROM longs)
  SELECT doc_id AS document_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, sub > 0, sub) - 1 AS INTEGER) AS chunk_index, content, CAST(page_start AS INTEGER) AS page_start, CAST(page_end AS INTEGER) AS page_end, section, CAST(length(content) // 4 AS INTEGER) AS token_count
  FROM every WHERE regexp_matches(content, '[\\p{{L}}\\p{{N}}]')"""


@query(_FOLD_SQL)
def chunk_fold(spark: SparkSession, d: str) -> DataFrame:
    c = ChunkingConfig()
    return chunking.chunk_texts(table(spark, d, "documents"), "doc_id", "text", c.target_tokens, c.overlap_tokens, c.min_tokens)


@query(f"""WITH w AS (SELECT id, unnest(string_split(lower({_strip_sql(f"regexp_replace(content, '{_WS}+', ' ', 'g')")}), ' ')) AS w FROM chunks WHERE regexp_matches(content, '[\\p{{L}}\\p{{N}}]')),
  h AS (SELECT id, ('0x' || md5(w)[1:12])::BIGINT % 16 AS i, CASE WHEN ('0x' || md5(w)[31:32])::BIGINT % 2 = 1 THEN 1.0::DOUBLE ELSE -1 END AS x FROM w),
  v AS (SELECT c.id, r.i, coalesce(sum(x), 0) AS x FROM chunks c CROSS JOIN range(16) r(i) LEFT JOIN h ON h.id = c.id AND h.i = r.i WHERE regexp_matches(content, '[\\p{{L}}\\p{{N}}]') GROUP BY 1, 2)
  SELECT id AS chunk_id, CAST(i AS INTEGER) AS pos, CASE WHEN n = 0 THEN 0 ELSE round((x / sqrt(n))::FLOAT::DOUBLE, 5) END AS value FROM (SELECT *, sum(x * x) OVER (PARTITION BY id) AS n FROM v)""")
def embed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk through the packing client with the offline backend, value by value."""
    c = EmbeddingConfig(backend="hash", dimensions=16, max_tokens_per_request=10_000_000)
    out = embed_column(table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "content"), "content", "vector", c)
    return out.where("vector IS NOT NULL").select("chunk_id", F.posexplode("vector").alias("pos", "x")).select("chunk_id", "pos", F.round(F.col("x").cast("double"), 5).alias("value"))


_PREFIXES = {"nomic-embed-text": "search_query: ", "multilingual-e5-large": "query: ", "LFM2-350M": "query: ", "qwen3-embedding": "Instruct: Given a search query, retrieve relevant passages\nQuery: ", "bge-m3": ""}


@query("SELECT query_id, model, p || query_text AS text FROM queries, (VALUES " + ", ".join(f"('{m}', '{p}')" for m, p in _PREFIXES.items()).replace("\n", "' || chr(10) || '") + ") v(model, p)")
def query_prefixes(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "queries")
    return q.select("query_id", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), tx.model_prefix(F.col("query_text"), m, True).alias("text")) for m in _PREFIXES])).alias("s")).select("query_id", "s.model", "s.text")


_DIR_DATE = """CASE WHEN regexp_matches(n, '^\\d{4}-\\d{2}-\\d{2}') THEN n[1:10] WHEN regexp_matches(n, '^\\d{4}_\\d{2}_\\d{2}') THEN replace(n[1:10], '_', '-')
     WHEN regexp_matches(n, '^\\d{8}$') THEN n[1:4] || '-' || n[5:6] || '-' || n[7:8] WHEN regexp_matches(n, '^\\d{2}\\.\\d{2}\\.\\d{4}') THEN n[7:10] || '-' || n[4:5] || '-' || n[1:2]
     WHEN regexp_matches(n, '^\\d{4}[-_]\\d{2}$') THEN n[1:4] || '-' || n[6:7] || '-01'
     WHEN regexp_matches(n, '^\\d{6}(\\D|$)') THEN CASE WHEN n[1:2] >= '70' THEN '19' ELSE '20' END || n[1:2] || '-' || n[3:4] || '-' || n[5:6] END"""


@query(f"SELECT doc_id, n AS folder, CAST(TRY_CAST({_DIR_DATE} AS DATE) AS VARCHAR) AS date FROM (SELECT doc_id, trim(source_dir) AS n FROM documents)")
def dir_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.trim("source_dir").alias("folder"), dates.dir_date(F.col("source_dir")).cast("string").alias("date"))


@query("""SELECT doc_id, nullif(regexp_extract(stem, '(\\d{4}\\.\\d{4,5}(?:v\\d+)?|[a-z\\-]+(?:\\.[A-Z]{2})?/\\d{7})', 1), '') AS arxiv, nullif(regexp_extract(replace(stem, '_', '/'), '(10\\.\\d{4,9}[/_.][^\\s]+)', 1), '') AS doi
  FROM (SELECT doc_id, regexp_replace(string_split(rel_path, '/')[-1], '(.)\\.[^.]*$', '\\1') AS stem FROM documents)""")
def doi_arxiv(spark: SparkSession, d: str) -> DataFrame:
    stem = tx.stem_of(F.col("rel_path"))
    return table(spark, d, "documents").select("doc_id", metadata.arxiv_id(stem).alias("arxiv"), metadata.doi(stem).alias("doi"))


@query(f"SELECT doc_id, {_strip_sql(f'regexp_replace(regexp_replace(text, $$<[^>]+>$$, $$$$, $$g$$), $${_WS}+$$, $$ $$, $$g$$)')} AS text FROM documents".replace("$$", "'"))
def strip_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.strip_tags(F.col("text")).alias("text"))


def _squeeze_sql(x: str) -> str:
    return _strip_sql(f"regexp_replace({x}, '{_WS}+', ' ', 'g')")


def _abstract_sql(x: str) -> str:
    """The lazy end of the pattern is sought behind its least length, which the other engine's repeats can't express."""
    tail = f"regexp_extract({x}, '(?is)\\bAbstract\\b[:.\\s]*(.*)', 1)"
    end = r"'(?is)^(.*?)(?:\n\s*\n|\bIntroduction\b|\b1\.?\s+Introduction\b)'"
    body = f"regexp_extract({tail}[101:], {end}, 1)"
    return f"CASE WHEN length({tail}) >= 100 AND regexp_matches({tail}[101:], {end}) AND length({body}) <= 2400 THEN nullif({_squeeze_sql(f'{tail}[1:100] || {body}')}, '') END"


@query(f"SELECT doc_id, {_abstract_sql('text')} AS abstract FROM documents")
def abstracts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", metadata.abstract(F.col("text")).alias("abstract"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')) AS x, generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1) AS i FROM documents WHERE text IS NOT NULL),
  f AS (SELECT *, regexp_matches(x, '^\s*(```|~~~)') AS fence FROM l), p AS (SELECT *, sum(fence::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 0 AS outside FROM f)
  SELECT doc_id, coalesce(string_agg(regexp_replace(x, '^#{1,6}\s+(.*?)\s*#*\s*$', '\1'), chr(10) ORDER BY i) FILTER (outside AND NOT fence), '') AS text FROM p GROUP BY 1 UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL""")
def markdown_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.markdown_text(F.col("text")).alias("text"))


_LINES_SQL = "SELECT id AS chunk_id, generate_subscripts(string_split(content, chr(10)), 1) AS line, unnest(string_split(content, chr(10))) AS t FROM chunks"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), F.posexplode(F.split("content", "\n")).alias("line", "t")).where(F.col("t").contains("|"))
    return lines.select("chunk_id", (F.col("line") + 1).cast("bigint").alias("line"), F.transform(F.split("t", r"\|"), lambda x: F.trim(x)).alias("cells"))


_CELLS_SQL = f"SELECT chunk_id, line, list_transform(string_split(t, '|'), lambda x: trim(x, ' ')) AS cells FROM ({_LINES_SQL}) WHERE contains(t, '|')"


@query(f"SELECT chunk_id, line, len(list_filter(cells, lambda x: x <> '')) >= 2 AND len(list_filter(cells, lambda x: length(x) > 60)) = 0 AND len(list_filter(cells, lambda x: regexp_matches(replace(x, ' ', ''), '^\\d+$'))) = 0 AS is_header FROM ({_CELLS_SQL})")
def header_detect(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("chunk_id", "line", tx.is_header(F.col("cells")).alias("is_header"))


@query(f"""WITH c AS ({_CELLS_SQL}), h AS (SELECT *, lag(cells) OVER (PARTITION BY chunk_id ORDER BY line) AS head FROM c),
  p AS (SELECT *, list_filter([CASE WHEN coalesce(head[i], '') <> '' AND coalesce(cells[i], '') <> '' THEN head[i] || ': ' || cells[i] END FOR i IN range(1, least(len(head), len(cells)) + 1)], lambda x: x IS NOT NULL) AS pairs FROM h)
  SELECT chunk_id, line, CASE WHEN head IS NOT NULL AND len(pairs) > 0 THEN array_to_string(pairs, ' | ') ELSE array_to_string(list_filter(cells, lambda x: x <> ''), ' | ') END AS text FROM p""")
def row_linearise(spark: SparkSession, d: str) -> DataFrame:
    """Each table row under the row above it as its header."""
    head = F.lag("cells").over(Window.partitionBy("chunk_id").orderBy("line"))
    return _rows(spark, d).withColumn("head", head).select("chunk_id", "line", tx.linearise(F.col("head"), F.col("cells")).alias("text"))


_FIRST_SQL = f"(WITH {_PAGES_SQL} SELECT doc_id, string_agg(t, ' ' ORDER BY page) FILTER (page <= 2) AS two FROM pages GROUP BY 1)"


@query(f"""SELECT d.doc_id, source_dir AS title, source_dir || ' device manual. ' || {_strip_sql("left(coalesce(two, ''), 800)")} AS summary, regexp_replace(string_split(rel_path, '/')[-1], '(.)\\.[^.]*$', '\\1') AS revision
  FROM documents d JOIN shelves s ON s.name = d.shelf LEFT JOIN {_FIRST_SQL} f ON f.doc_id = d.doc_id WHERE s.type = 'manuals' AND d.text IS NOT NULL""")
def meta_manual(spark: SparkSession, d: str) -> DataFrame:
    out = metadata.manual(_described(spark, d, "manuals"))
    return out.select("doc_id", "title", "summary", F.col("extra")["revision"].alias("revision"))


def _described(spark: SparkSession, d: str, kind: str) -> DataFrame:
    names = table(spark, d, "shelves").where(F.col("type") == kind).select(F.col("name").alias("shelf"))
    docs = table(spark, d, "documents").where("text IS NOT NULL").join(names, "shelf", "left_semi")
    pages = F.transform(chunking.text_pages(F.col("text")), lambda p: p["text"])
    return docs.select("doc_id", "rel_path", "source_dir", pages.alias("pages"), F.lit(None).cast("string").alias("prop_title"), F.lit(None).cast("date").alias("prop_created"), F.lit(None).cast("string").alias("font_title"))


_STEM_SQL = "regexp_replace(string_split(rel_path, '/')[-1], '(.)\\.[^.]*$', '\\1')"
_CLEAN_STEM_SQL = _strip_sql("regexp_replace(stem, '[_\\-]+', ' ', 'g')")
_META_SQL = f"""SELECT doc_id, source_dir, stem, n, first, two, array_to_string([CASE WHEN i = 1 OR NOT regexp_matches(plain[i - 1], '\\p{{L}}') THEN upper(plain[i]) ELSE lower(plain[i]) END FOR i IN range(1, length(plain) + 1)], '') AS title
  FROM (SELECT *, {_CLEAN_STEM_SQL} AS plain FROM (SELECT d.doc_id, source_dir, trim(source_dir) AS n, {_STEM_SQL} AS stem, first, two FROM documents d JOIN shelves s ON s.name = d.shelf
    LEFT JOIN (WITH {_PAGES_SQL} SELECT doc_id, string_agg(t, ' ' ORDER BY page) FILTER (page <= 2) AS two, min(t) FILTER (page = 1) AS first FROM pages GROUP BY 1) f ON f.doc_id = d.doc_id WHERE s.type = 'KIND' AND d.text IS NOT NULL))"""


@query(f"""WITH m AS ({_META_SQL.replace('KIND', 'meetings')}), a AS (SELECT *, TRY_CAST({_DIR_DATE} AS DATE) AS by_folder FROM m), b AS (SELECT * EXCLUDE (n), trim(stem) AS n FROM a),
  c AS (SELECT *, coalesce(by_folder, TRY_CAST({_DIR_DATE} AS DATE)) AS d FROM b)
  SELECT doc_id, CASE WHEN d IS NULL THEN title ELSE title || ' (' || strftime(d, '%Y-%m-%d') || ')' END AS title, CAST(d AS VARCHAR) AS doc_date, CAST(year(d) AS INTEGER) AS year, {_strip_sql("left(coalesce(two, ''), 1200)")} AS summary FROM c""")
def meta_meeting(spark: SparkSession, d: str) -> DataFrame:
    return metadata.meeting(_described(spark, d, "meetings")).select("doc_id", "title", F.col("doc_date").cast("string").alias("doc_date"), "year", "summary")


@query(f"""WITH m AS ({_META_SQL.replace('KIND', 'scientific')}), b AS (SELECT *, coalesce({_abstract_sql('first')}, {_strip_sql("left(coalesce(two, ''), 1200)")}) AS body FROM m)
  SELECT doc_id, title, CASE WHEN body <> '' THEN title || '. ' || body ELSE body END AS summary, 'extracted' AS metadata_source FROM b""")
def meta_paper(spark: SparkSession, d: str) -> DataFrame:
    return metadata.paper(_described(spark, d, "scientific")).select("doc_id", "title", "summary", F.col("extra")["metadata_source"].alias("metadata_source"))
