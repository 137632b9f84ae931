import math
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioquarry.functions import dates, fulltext, vectors
from folioquarry.functions import text as tx


def column(spark, values, f, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {kind}").select("i", f(F.col("x")).alias("y"))
    return [r["y"] for r in sorted(df.collect(), key=lambda r: r["i"])]


def test_dir_date(spark):
    cases = {
        "2026-03-14": "2026-03-14", " 2026-03-14 notes": "2026-03-14", "2026_03_14 board": "2026-03-14", "20260314": "2026-03-14", "20260314x": None,
        "14.03.2026": "2026-03-14", "2026-03": "2026-03-01", "2026_03": "2026-03-01", "170630putki": "2017-06-30", "991231": "1999-12-31", "691231": "2069-12-31",
        "700101": "1970-01-01", "2026-13-01": None, "202603": None, "Palaveri 1.2.2026": None, "": None,
    }
    got = column(spark, list(cases), lambda c: dates.dir_date(c).cast("string"))
    assert dict(zip(cases, got)) == cases
    assert column(spark, [None], lambda c: dates.dir_date(c).cast("string")) == [None]


def test_clean_text(spark):
    cases = {"a\x00b": "a b", "a­b": "ab", "a \t b": "a b", "a\n\n\n\nb": "a\n\nb", "a\r\n\r\nb": "a \n \nb", "é": "é", "xz": "xz", "x�z": "xz", "": "", None: None, " x ": "x"}
    assert column(spark, list(cases), tx.clean_text) == list(cases.values())


def test_clean_text_is_composed(spark):
    words = ["KK", "Å", "plain", "가", "café", "豈"]
    assert column(spark, words, tx.nfc) == [unicodedata.normalize("NFC", w) for w in words]


def test_scalars(spark):
    assert column(spark, ["", "---", " ", "ä", "E04", "1", None], tx.is_embeddable) == [False, False, False, True, True, True, False]
    assert column(spark, ["x" * 1601, "", None], tx.chunk_tokens) == [400, 0, None]
    assert column(spark, ["abcde"], tx.wire_tokens) == [3]
    assert column(spark, ["a \n\t b "], tx.wire_safe) == ["a b"]
    assert column(spark, ["budget_2026-v2a", "don't_stop"], tx.clean_stem) == ["Budget 2026 V2A", "Don'T Stop"]
    heads = ["4.2 Results", "TROUBLESHOOTING", "Budetti 2017", "Palaveri 1.2.2026", "This is prose."]
    assert column(spark, heads, tx.heading_of) == [*heads[:4], None]
    assert column(spark, ["a/b.c/notes.v2.PDF", "x", ".hidden"], tx.stem_of) == ["notes.v2", "x", ".hidden"]
    assert column(spark, ["a/b.PDF", "x"], tx.suffix_of) == [".pdf", ""]


def test_markdown(spark):
    cases = {"## Setup ##\ntext": "Setup\ntext", "a\n```\ncode\n```\nb": "a\nb", "a\n~~~\nlost": "a", "# A\r\nb": "A\nb"}
    assert column(spark, list(cases), tx.markdown_text) == list(cases.values())


def test_headers_and_rows(spark):
    cells = [["Item", "Cost"], ["Item"], ["Item", "12"], ["Item", "12,5"]]
    assert column(spark, cells, tx.is_header, "array<string>") == [True, False, False, True]
    df = spark.createDataFrame([(["Item", "Cost"], ["Pump", "12"]), (["Item", "Cost"], ["Pump", ""]), (None, ["Pump", "12"])], "h array<string>, v array<string>")
    assert [r[0] for r in df.select(tx.linearise(F.col("h"), F.col("v"))).collect()] == ["Item: Pump | Cost: 12", "Item: Pump", "Pump | 12"]


def test_parse():
    q = fulltext.parse('pump "red valve" -leak or fan')
    assert [[(t.words, t.wanted) for t in g] for g in q.groups] == [[(("pump",), True), (("red", "valve"), True), (("leak",), False)], [(("fan",), True)]]
    assert fulltext.parse("").groups == () and fulltext.parse('"').groups == () and fulltext.parse("or - or").groups == ()


def cover_density(query, tokens):
    hits = [(i, t) for i, t in enumerate(tokens) if t in query.words]
    sets = [{w for t in g if t.wanted for w in t.words} for g in query.groups]
    full = lambda a, b: any(s and s <= {hits[k][1] for k in range(a, b + 1)} for s in sets)
    total, begin = 0.0, 0
    while begin < len(hits):
        end = next((e for e in range(begin, len(hits)) if full(begin, e)), None)
        if end is None:
            break
        at = max(b for b in range(begin, end + 1) if full(b, end))
        total += 0.1 / (1 + (hits[end][0] - hits[at][0]) - (end - at))
        begin = at + 1
    return total


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdx"), max_size=14), min_size=1, max_size=30), st.sampled_from(["a", "a b", "a b c", "a or b", "a b or c d"]))
def test_rank_is_cover_density(spark, docs, text):
    q = fulltext.parse(text)
    got = column(spark, docs, lambda c: fulltext.rank(q, c), "array<string>")
    assert all(math.isclose(g, cover_density(q, d), abs_tol=1e-12) for g, d in zip(got, docs))


def test_match(spark):
    docs = [["red", "valve", "pump"], ["valve", "red"], ["red"], [], None]
    m = lambda text: column(spark, docs, lambda c: fulltext.match(fulltext.parse(text), c), "array<string>")
    assert m('"red valve"') == [True, False, False, False, False]
    assert m("red -valve") == [False, False, True, False, False]
    assert m("pump or red") == [True, True, True, False, False]
    assert m("") == [False] * 5


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(2**-0.5) and got[1:] == [None, None]
    assert [r[0] for r in df.select(vectors.cosine_to(F.col("a"), [2.0, 0.0])).collect()] == [1.0, None, None]
    m = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None)], "k int, v array<float>")
    assert {r["k"]: [round(x, 4) for x in r["mean"]] for r in vectors.mean_vectors(m, ["k"], "v").collect()} == {1: [0.7071, 0.7071]}
    with pytest.raises(Exception, match="expected a vector of 3"):
        df.select(vectors.of_dimension(F.col("b"), 3)).collect()
