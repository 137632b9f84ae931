"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import languages, leakage, lookalikes, mixing, neighbours, outranking, packing, splitting


def p1_requests(spark: SparkSession, d: str) -> DataFrame:
    req = packing.pack_requests(table(spark, d, "chunks"), "id", "content")
    return req.select("request_id", "fill", F.size("ids").alias("n_pieces"), F.array_sort("ids").alias("chunk_ids"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    req = packing.pack_requests(table(spark, d, "chunks"), "id", "content")
    return packing.assignments(req).where("piece > 1").select("chunk_id").distinct()


def p1_assigned(spark: SparkSession, d: str) -> DataFrame:
    """Per chunk its pieces and tokens over all requests, and whether each of these keeps the capacity."""
    req = packing.pack_requests(table(spark, d, "chunks"), "id", "content")
    parts = packing.assignments(req).join(req.select("request_id", "fill"), "request_id")
    return parts.groupBy("chunk_id").agg(F.count_distinct("piece").alias("pieces"), F.sum("tokens").alias("tokens"), (F.max("fill") <= 1024).alias("fits"))


def p1_fill(spark: SparkSession, d: str) -> DataFrame:
    """One row: tokens packed, the fewest requests that could hold them, and whether ours are at most 5 % more."""
    req = packing.pack_requests(table(spark, d, "chunks"), "id", "content")
    least = F.ceil(F.sum("fill") / 1024)
    return req.agg(F.sum("fill").cast("long").alias("tokens"), least.alias("least_requests"), (F.count(F.lit(1)) <= 1.05 * least).alias("within_5_percent"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return languages.mislabelled_chunks(table(spark, d, "chunks"), docs, languages.train(docs))


def p2_stretches(spark: SparkSession, d: str) -> DataFrame:
    model = languages.train(table(spark, d, "documents"))
    return languages.stretches(table(spark, d, "chunks"), model, "id", "content").withColumnRenamed("id", "chunk_id")


def p2_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return languages.document_languages(docs, languages.train(docs)).withColumnRenamed("id", "doc_id")


KINDS = ("chunks", "documents")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "chunks").select(F.lit(0).alias("kind"), "id", F.col("embedding").alias("v"))
    b = table(spark, d, "documents").select(F.lit(1).alias("kind"), F.col("doc_id").alias("id"), F.col("summary_embedding").alias("v"))
    return a.unionByName(b)


def _kind() -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind").cast("int") + 1).alias("item_table")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    graph, members, _ = neighbours.neighbour_graph(_vectors(spark, d))
    return neighbours.similar_pairs(graph, members, 0.88).select(_kind(), "id_a", "id_b")


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """One row per usable vector: its node's neighbours by the smallest id of each, and how many copies share the node."""
    graph, members, _ = neighbours.neighbour_graph(_vectors(spark, d))
    copies = members.groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    lists = graph.join(copies, "node").select("node", "copies", F.transform(F.slice("near", 1, 10), lambda x: F.shiftright(x, 6)).alias("neighbours"), F.transform(F.slice("sims", 1, 10), lambda s: F.round(1 - s, 3)).alias("distances"))
    return members.join(lists, "node", "left").select(_kind(), "id", F.shiftright("node", 6).alias("class_id"), "copies", "neighbours", "distances")


def _asked(members: DataFrame) -> DataFrame:
    """The stated query set, ``(node, kind, id)``: every row whose id is divisible by 20, copies of another row among them."""
    return members.where(F.col("id") % 20 == 0)


def p3_search(spark: SparkSession, d: str) -> DataFrame:
    """Greedy graph search of the rows whose id is divisible by 20 against all rows.

    Equal vectors are searched and found once, as the class named by its
    smallest id: ``copies`` rows are in the query's own, ``neighbour_copies`` in
    the one found.  ``p3_neighbours`` names the class of every row.
    """
    graph, members, nodes = neighbours.neighbour_graph(_vectors(spark, d))
    asked = _asked(members)
    found = neighbours.graph_search(graph, nodes, nodes.join(asked.select("node").distinct(), "node", "left_semi"))
    sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    hits = found.select("node", F.posexplode(F.arrays_zip("near", "sims")).alias("rank", "e")).select("node", "rank", "e.near", "e.sims")
    hits = hits.join(sizes.select(F.col("node").alias("near"), F.col("copies").alias("neighbour_copies")), "near")
    rows = asked.join(sizes, "node").join(hits, "node", "left")  # a row that finds nothing is still answered
    return rows.select(_kind(), "id", F.shiftright("node", 6).alias("class_id"), "copies", (F.col("rank") + 1).alias("rank"), F.shiftright("near", 6).alias("neighbour_id"), "neighbour_copies", F.round(1 - F.col("sims"), 3).alias("distance"))


def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of the exact ten nearest that lists and searches find, over a stated part of the rows each, compared in blocks.

    The searched rows (id divisible by 20, copies included) are left out of the
    graph, so the search meets vectors it has never seen; the lists are those of
    the nodes with id one more than a multiple of 100.
    """
    members, nodes = neighbours.nodes_of(_vectors(spark, d))
    rows = _asked(members)
    held = rows.select("node").distinct()
    inside, asked = nodes.join(held, "node", "left_anti"), nodes.join(held, "node", "left_semi")
    graph = neighbours.graph_of(inside)
    listed = inside.where(F.shiftright("node", 6) % 100 == 1)
    none = F.array().cast("array<long>")
    pick = lambda df, name: df.select("node", F.slice("near", 1, 10).alias(name))
    lists = pick(neighbours.exact_search(inside, listed), "true").join(pick(graph, "got"), "node", "left").withColumn("of", F.lit("graph"))
    found = pick(neighbours.exact_search(inside, asked), "true").join(pick(neighbours.graph_search(graph, inside, asked), "got"), "node", "left")
    both = lists.unionByName(rows.select("node").join(found, "node").withColumn("of", F.lit("search")))
    hits, all_ = F.size(F.array_intersect("true", F.coalesce("got", none))), F.size("true")
    share = lambda of: F.round(F.sum(F.when(F.col("of") == of, hits)) / F.sum(F.when(F.col("of") == of, all_)), 4).alias(f"{of}_recall")
    per = both.groupBy(F.col("node").bitwiseAND(63).alias("kind")).agg(F.count_if(F.col("of") == "search").alias("queries"), share("graph"), share("search"))
    return per.select(_kind(), "queries", "graph_recall", "search_recall")


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs between different vectors, each named by the smallest id it is filed under; ``p3_neighbours`` tells who else shares it."""
    graph, _, _ = neighbours.neighbour_graph(_vectors(spark, d))
    links = neighbours.similar_links(graph, 0.88).withColumn("kind", F.col("a").bitwiseAND(63))
    return links.select(_kind(), F.shiftright("a", 6).alias("class_a"), F.shiftright("b", 6).alias("class_b"))


def _wide(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    arms = [(r["arm"], r["better"] == "low") for r in table(spark, d, "score_arms").orderBy("arm").collect()]  # 4 rows, fixed
    return outranking.wide_scores(table(spark, d, "search_scores"), arms), len(arms)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    wide, n = _wide(spark, d)
    ranked = outranking.rank_items(wide, n, need=3)
    return ranked.where("clear AND position = 1").select(F.col("g").alias("request_id"), F.col("item").alias("chunk_id"))


def p4_ranking(spark: SparkSession, d: str) -> DataFrame:
    wide, n = _wide(spark, d)
    ranked = outranking.rank_items(wide, n, need=3)
    return ranked.select(F.col("g").alias("request_id"), F.col("item").alias("chunk_id"), F.round("flow", 6).alias("flow"), "position")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks"), blank=True).select("chunk_id", "boundary").distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_recall(spark: SparkSession, d: str) -> DataFrame:
    """The recall the search is built for, and the repetitions that follow from it."""
    return leakage.recall_plan(spark)


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return mixing.count_tokens(table(spark, d, "documents"), "doc_id", "text", "source")


#: How far a source of the mix may stand above its target share.
OVER = 0.02


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    copies, _ = mixing.mix(_sizes(spark, d), targets)  # as large as all texts
    return mixing.short_sources(copies, targets)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    _, report = mixing.mix(_sizes(spark, d), table(spark, d, "mix_targets"), over=OVER)
    return report


def p7_copies(spark: SparkSession, d: str) -> DataFrame:
    copies, _ = mixing.mix(_sizes(spark, d), table(spark, d, "mix_targets"), over=OVER)
    return copies.select(F.col("id").alias("doc_id"), "source", "tokens", "copies")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per target source whether the mix keeps its promises: due no more than ``OVER`` above its share, below it only when used up, and given as many copies as due to one."""
    copies, report = mixing.mix(_sizes(spark, d), table(spark, d, "mix_targets"), over=OVER)
    given = copies.where("tokens > 0").groupBy("source").agg(F.sum("copies").alias("given"), F.count(F.lit(1)).alias("live"))
    due = report.join(given, "source", "left").withColumn("due", F.col("copies_due") * F.col("tokens")).withColumn("able", F.when(F.col("tokens") > 0, F.col("target_share")).otherwise(0.0))
    whole = due.agg(F.sum("due").alias("all_due"), F.sum("able").alias("able_share"))
    share = F.col("due") / F.col("all_due")
    exhausted = (F.col("tokens") == 0) | (F.col("copies_due") >= F.col("max_repeats"))
    return due.crossJoin(F.broadcast(whole)).select(  # one row
        "source", (share * F.col("able_share") <= F.col("target_share") * (1 + OVER) + 1e-9).alias("not_above"), (exhausted | (share >= F.col("target_share") - 1e-9)).alias("not_below"),
        (F.abs(F.coalesce("given", F.lit(0)) - F.col("copies_due") * F.coalesce("live", F.lit(0))) <= 1 + 1e-6).alias("exact_copies"), (F.coalesce("most_copies", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.look_alike_pairs(table(spark, d, "documents"))


def p8_unified(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.unify(table(spark, d, "documents")).select(F.col("id").alias("doc_id"), "text")


def p8_looks(spark: SparkSession, d: str) -> DataFrame:
    """The form in which all texts are compared."""
    return lookalikes.looks(table(spark, d, "documents")).select(F.col("id").alias("doc_id"), "look")


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """Membership: the class of every document whose look another text shares, named by its smallest id."""
    return lookalikes.classes(table(spark, d, "documents")).select(F.col("id").alias("doc_id"), "class_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_assigned, p1_fill, p1_requests, p2_found, p2_stretches, p2_documents, p3_found, p3_links, p3_neighbours, p3_search, p3_recall, p4_found, p4_ranking, p5_found, p5_pieces, p6_found, p6_leaks, p6_recall, p7_found, p7_mix, p7_copies, p7_shares, p8_found, p8_classes, p8_looks, p8_unified)}

_WHITE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _longest(text: str, pattern: str) -> str:
    return f"list_max(list_transform(string_split_regex({text}, '{pattern}'), lambda x: length(regexp_replace(x, '^{_WHITE}+|{_WHITE}+$', '', 'g'))))"


_P3 = """SELECT '{t}' AS item_table, a.id AS id_a, b.id AS id_b FROM v{t} a JOIN v{t} b ON a.id < b.id AND list_cosine_similarity(a.v, b.v) >= 0.88"""
_P3_V = "v{t} AS (SELECT {id} AS id, {v}::DOUBLE[] AS v FROM {t} WHERE {v} IS NOT NULL AND list_inner_product({v}::DOUBLE[], {v}::DOUBLE[]) > 0)"


def _looks_sql(accents: bool = False) -> str:
    source, target = lookalikes._pairs()
    more = lookalikes.ACCENTED if accents else {}
    one = {c: t for c, t in more.items() if len(t) == 1}
    source, target = source + "".join(one), target + "".join(one.values())
    out = f"translate(nfc_normalize(text), '{source + lookalikes.INVISIBLE}', '{target.replace(chr(39), chr(39) * 2)}')"
    for mark, letters in (lookalikes.LIGATURES | {c: t for c, t in more.items() if len(t) > 1}).items():
        out = f"replace({out}, '{mark}', '{letters}')"
    return f"nfc_normalize({out})"


_BETTER = " + ".join(f"CAST(a.v{i} IS NOT NULL AND (b.v{i} IS NULL OR a.v{i} > b.v{i}) AS INTEGER)" for i in range(4))

ORACLE = {
    "p1_found": "SELECT id AS chunk_id FROM chunks WHERE length(content) // 4 > 1024",
    "p1_assigned": "WITH c AS (SELECT id, greatest(length(content) // 4, 1) AS n FROM chunks WHERE content IS NOT NULL) SELECT id AS chunk_id, (n + 1023) // 1024 AS pieces, n AS tokens, true AS fits FROM c",
    "p1_fill": "SELECT sum(greatest(length(content) // 4, 1))::BIGINT AS tokens, CAST(ceil(sum(greatest(length(content) // 4, 1)) / 1024) AS BIGINT) AS least_requests, true AS within_5_percent FROM chunks WHERE content IS NOT NULL",
    "p3_found": "WITH " + _P3_V.format(t="chunks", id="id", v="embedding") + ", " + _P3_V.format(t="documents", id="doc_id", v="summary_embedding") + " " + _P3.format(t="chunks") + " UNION ALL " + _P3.format(t="documents"),
    "p4_found": f"""WITH s AS (SELECT request_id, chunk_id, arm, max(CASE WHEN better = 'low' THEN -raw_score ELSE raw_score END) AS v FROM search_scores JOIN score_arms USING (arm) GROUP BY 1, 2, 3),
  w AS (SELECT request_id, chunk_id, max(v) FILTER (arm = 'age') AS v0, max(v) FILTER (arm = 'keyword') AS v1, max(v) FILTER (arm = 'title') AS v2, max(v) FILTER (arm = 'vector') AS v3 FROM s GROUP BY 1, 2)
  SELECT a.request_id, a.chunk_id FROM w a JOIN w b ON a.request_id = b.request_id AND a.chunk_id <> b.chunk_id GROUP BY 1, 2 HAVING min({_BETTER}) >= 3""",
    "p5_found": f"""SELECT id AS chunk_id, CASE WHEN {_longest("content", r"\f|\r?\n(?:[ \t]*\r?\n)+")} <= 2400 THEN 'paragraph' WHEN {_longest("content", r"\f|\r?\n")} <= 2400 THEN 'line'
  WHEN {_longest(f"regexp_replace(content, '([.!?]){_WHITE}+', '\\1' || chr(1), 'g')", r"\x01|\f|\r?\n")} <= 2400 THEN 'sentence' WHEN {_longest("content", _WHITE + "+")} <= 2400 THEN 'word' ELSE 'none' END AS boundary
  FROM chunks WHERE length(content) > 2400""",
    # no case hangs on the tokenizer, so characters stand for tokens here
    "p7_found": """WITH n AS (SELECT lower(trim(source)) AS source, sum(length(text)) AS n FROM documents GROUP BY 1)
  SELECT t.source FROM mix_targets t LEFT JOIN n ON n.source = t.source WHERE coalesce(n.n, 0) * max_repeats < target_share * (SELECT sum(n) FROM n)""",
    "p7_shares": "SELECT lower(trim(source)) AS source, true AS not_above, true AS not_below, true AS exact_copies, true AS within_cap FROM mix_targets",
    "p8_found": f"""WITH t AS (SELECT doc_id, text, {_looks_sql()} AS look FROM documents WHERE regexp_replace(text, '{_WHITE}+', '', 'g') <> '')
  SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM t a JOIN t b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p8_looks": f"SELECT doc_id, CASE WHEN trim(text) = '' THEN text ELSE {_looks_sql(accents=True)} END AS look FROM documents",
    "p8_classes": f"""WITH t AS (SELECT doc_id, text, {_looks_sql()} AS look FROM documents WHERE regexp_replace(text, '{_WHITE}+', '', 'g') <> ''),
  c AS (SELECT look, min(doc_id) AS class_id FROM t GROUP BY look HAVING count(DISTINCT text) > 1) SELECT doc_id, class_id FROM t JOIN c ON t.look = c.look""",
}
