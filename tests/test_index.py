import numpy as np
import pytest
from pyspark.sql import functions as F

from folioquarry.functions import fulltext
from folioquarry.operators import index, search


def rows(spark, vectors, words=()):
    words = list(words) or [["a"]] * len(vectors)
    return spark.createDataFrame([(i, i // 3, None if v is None else [float(x) for x in v], w) for i, (v, w) in enumerate(zip(vectors, words))], "id long, document_id long, embedding array<float>, tsv array<string>")


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 12)) * 3
    x = [*(centres[rng.integers(0, 30, 900)] + 0.3 * rng.standard_normal((900, 12))), np.zeros(12), None, [float("nan")] * 12, [1.0] * 5]
    df = rows(spark, x)
    return df, index.VectorCells.build(df, str(tmp_path_factory.mktemp("cells")), 12), x


def test_every_cell_is_exact(spark, clustered):
    df, cells, x = clustered
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 200, "a").otherwise("b").alias("shelf"))
    query = [float(v) for v in x[5]]
    for filters in (None, search.SearchFilters(shelves=["b"])):
        want = search.vector_arm(df.where("id < 900"), docs, query, filters, 20).collect()
        assert cells.arm(docs, query, filters, 20, probes=None).collect() == want and len(want) == 20
    assert cells.candidates([], None).count() == 900


def test_few_cells_find_nearly_all_where_there_are_clusters(spark, clustered):
    df, cells, x = clustered
    asked = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(0, 900, 30)], "query_id long, vector array<float>")
    exact = index.batch_arm(df, asked, 12)
    got = {r["step"]: r["recall"] for r in index.recall(cells, exact, asked, 12).collect()}
    assert got[2] > 0.95 and got[8] == 1.0 and sorted(got.values()) == [got[k] for k in range(1, 9)]
    some = cells.candidates([float(v) for v in x[0]], 4)
    assert 0 < some.count() < 500 and "PartitionFilters: [cell" in some._jdf.queryExecution().toString()


def test_batch_against_numpy(spark, clustered):
    df, _, x = clustered
    u = np.array(x[:900]) / np.linalg.norm(np.array(x[:900]), axis=1, keepdims=True)
    asked = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(7)] + [(50, [0.0] * 12), (51, None)], "query_id long, vector array<float>")
    got = {}
    for r in index.batch_arm(df, asked, 12, limit=5, block=3).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["chunk_id"]
    assert set(got) == set(range(7))
    for i in range(7):
        assert [got[i][k] for k in range(1, 6)] == np.argsort(-(u @ u[i]), kind="stable")[:5].tolist()
    assert index.batch_arm(df, asked.limit(0), 12).collect() == []


def test_empty_collection(spark, tmp_path):
    empty = rows(spark, [])
    cells = index.VectorCells.build(empty, str(tmp_path / "c"), 4)
    docs = spark.createDataFrame([], "doc_id long, shelf string")
    assert cells.arm(docs, [1.0] * 4).collect() == []
    assert index.Postings.build(empty, str(tmp_path / "p")).arm(docs, "word").collect() == []


WORDS = ["pump", "valve", "lid", "board", "roof"]


def test_postings_agree_with_the_scan(spark, tmp_path):
    rng = np.random.default_rng(3)
    texts = [[str(w) for w in rng.choice(WORDS, rng.integers(0, 25))] for _ in range(150)] + [None]
    df = rows(spark, [[1.0]] * 151, texts)
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("s").alias("shelf"))
    posted = index.Postings.build(df, str(tmp_path / "p"), buckets=5)
    for text in ("pump", "pump valve", "pump -valve", '"pump valve" lid', "pump or lid", '"lid board" or roof -pump', '-"pump valve" roof', "nothing", "", "pump pump", '"pump pump"'):
        q = fulltext.parse(text)
        scan = df.where(fulltext.match(q, F.col("tsv"))).select("id", F.round(fulltext.rank(q, F.col("tsv")), 6).alias("score"))
        assert sorted(map(tuple, posted.matches(docs, text).collect())) == sorted(map(tuple, scan.collect())), text
    for f in (None, search.SearchFilters(document_ids=[3, 4, 5])):
        assert posted.arm(docs, "pump or lid", f, 9).collect() == search.keyword_arm(df, docs, "pump or lid", f, 9).collect()
    with pytest.raises(ValueError):
        posted.matches(docs, "-pump")
    assert "PartitionFilters: [(bucket" in posted.of(["pump"])._jdf.queryExecution().toString() or "bucket" in posted.of(["pump"])._jdf.queryExecution().toString()
