import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioquarry.config import EmbeddingConfig, load_config
from folioquarry.embed import HashBackend, embed_texts
from folioquarry.operators import chunking, merge, metadata, search


def fold(lengths, text=None):
    paras = [((text or "abc defg. ") * 400, 1, None)[0][:n].ljust(n, "x") for n in lengths]
    paras = [f"{i:04d}" + p[4:] for i, p in enumerate(paras)]
    return paras, chunking.fold_paragraphs([(p, i + 1, None) for i, p in enumerate(paras)], 1600, 240, 160)


def test_fold_golden():
    assert fold([100])[1] == []
    paras, out = fold([200])
    assert [c[0] for c in out] == [chunking.py_clean(paras[0])]
    paras, out = fold([800, 800])
    assert [(c[1], c[2]) for c in out] == [(1, 2), (2, 2)]
    assert [(c[1], c[2]) for c in fold([1700])[1]] == [(1, 1)]
    assert all(c[1] == 2 for c in fold([100, 2500])[1])
    assert [c[1] for c in fold([200, 2500])[1]][0] == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4000), max_size=12))
def test_fold_properties(lengths):
    _, out = fold(lengths)
    for content, a, b, _, tokens in out:
        assert a <= b and tokens == len(content) // 4 and content


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab. !", min_size=1, max_size=60), max_size=30), st.integers(5, 80))
def test_packers(words, budget):
    line = " ".join(w.strip() or "a" for w in words)
    assert " ".join(chunking.wire_split(line, budget)).split() == line.split()
    sizes = [len(w) for w in words]
    batches = chunking.pack_batches(sizes, 4, 90)
    assert [i for b in batches for i in b] == list(range(len(sizes)))
    assert all(len(b) <= 4 and (len(b) == 1 or sum(sizes[i] for i in b) <= 90) for b in batches)
    assert " ".join(chunking.split_long(line, budget)).split() == line.split()


def test_split_long():
    a, b = "a" * 49 + ".", "b" * 49 + "."
    assert chunking.split_long(f"{a} {b}", 100) == [f"{a} {b}"] and chunking.split_long(f"{a} {b}", 99) == [a, b]
    assert chunking.split_long("x" * 300, 100) == ["x" * 300] and chunking.split_long("", 100) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=25), st.integers(5, 80))
def test_split_long_fills_greedily(sizes, target):
    parts = ["w" * (n - 1) + "." for n in sizes]
    want, cur = [], ""
    for p in parts:
        if cur and len(cur) + len(p) > target:
            want.append(cur)
            cur = p
        else:
            cur = f"{cur} {p}".strip()
    assert chunking.split_long(" ".join(parts), target) == want + ([cur] if cur else [])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=30), st.integers(5, 25), st.integers(0, 12))
def test_ranges_follow_the_contract(lengths, target, overlap):
    """Step by step: a buffer that is closed at the target and keeps a tail."""
    want, buf = [], []

    def tail():
        kept = []
        while len(kept) < len(buf) and sum(lengths[i] for i in kept) < overlap:
            kept.insert(0, buf[-1 - len(kept)])
        return [] if sum(lengths[i] for i in kept) >= target else kept

    for i, n in enumerate(lengths):
        if n > 1.5 * target:
            want += [(buf[0], buf[-1] + 1, False)] if buf else []
            want.append((i, i + 1, True))
            buf = []
            continue
        buf.append(i)
        if sum(lengths[k] for k in buf) >= target:
            want.append((buf[0], buf[-1] + 1, False))
            buf = tail()
    want += [(buf[0], buf[-1] + 1, False)] if buf else []
    assert list(chunking.chunk_ranges(lengths, target, overlap)) == want


def test_chunk_documents(spark):
    pages = [(1, "INTRODUCTION\n\n" + "word " * 100, None), (2, "tail " * 80, "Own")]
    df = spark.createDataFrame([(7, pages), (8, None), (9, [])], f"id long, pages {chunking.PAGES}")
    rows = chunking.chunk_documents(df, "id", "pages").collect()
    assert [(r["document_id"], r["chunk_index"], r["page_start"], r["page_end"], r["section"]) for r in rows] == [(7, 0, 1, 2, "INTRODUCTION")]


def test_docx_pages(spark):
    rows = [("d", 0, "one", None, False, False), ("d", 1, "two", None, False, True), ("d", 2, "three", None, False, False), ("d", 3, "Head", "Head", False, False), ("d", 4, "four", None, False, False), ("d", 5, "---", None, True, False)]
    df = spark.createDataFrame(rows, "doc string, pos int, text string, heading string, brk boolean, brk_after boolean")
    got = [(r["page"], r["section"], r["text"]) for r in chunking.docx_pages(df).orderBy("page").collect()]
    assert got == [(1, None, "one\n\ntwo"), (2, None, "three"), (3, "Head", "Head\n\nfour")]


def test_read_documents(spark):
    def read(n):
        df = spark.createDataFrame([(1, i, i, "x" * 12000) for i in range(n)], "document_id long, id long, chunk_index int, content string")
        r = search.read_documents(df).first()
        return r["shown"], r["truncated"]

    assert [read(n) for n in (2, 3, 4)] == [(2, False), (2, False), (2, True)]


def test_page_label(spark):
    df = spark.createDataFrame([(6, 7), (6, 6), (6, None), (None, 7), (0, 3)], "a int, b int")
    assert [r[0] for r in df.select(search.page_label(F.col("a"), F.col("b"))).collect()] == ["6-7", "6", "6", None, None]


def test_filters(spark):
    df = spark.createDataFrame([(1, "s", "axb", dt.date(2020, 1, 1), 2020, ["Ann Bee"]), (2, "t", "ab", None, None, None)], "doc_id long, shelf string, source_dir string, doc_date date, year int, authors array<string>")
    ids = lambda **k: [r["doc_id"] for r in search.filtered(df, search.SearchFilters(**k)).orderBy("doc_id").collect()]
    assert ids() == [1, 2] and ids(shelves=[], source_dir="", year_from=0, dates=[]) == [1, 2]
    assert ids(source_dir="A_B") == [1] and ids(author="bee") == [1] and ids(year_to=2020) == [1] and ids(document_ids=[2]) == [2]
    assert ids(date_from=dt.date(2020, 1, 1), date_to=dt.date(2020, 1, 1)) == [1] and ids(dates=[dt.date(2020, 1, 1)]) == [1]


def test_fusions_agree(spark):
    v = spark.createDataFrame([(1, 1), (2, 2)], "chunk_id long, rank long")
    k = spark.createDataFrame([(1, 1), (3, 2)], "chunk_id long, rank long")
    a = {r["chunk_id"]: r["score"] for r in search.fuse(v, k).collect()}
    b = {r["chunk_id"]: r["score"] for r in search.fuse_union(v, k).collect()}
    assert a == b and a[1] == round(2 / 61, 9) and a[2] == a[3] == round(1 / 62, 9)


def test_scan_diff(spark):
    seen = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("n", None)], "rel_path string, content_hash string")
    known = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4"), ("n", None)], "rel_path string, content_hash string")
    got = {r["rel_path"]: r["status"] for r in merge.scan_diff(seen, known).collect()}
    assert got == {"a": "skipped", "b": "indexed", "c": "indexed", "d": "deleted", "n": "indexed"}
    assert {r["status"] for r in merge.scan_diff(seen, known, force=True).collect()} == {"indexed", "deleted"}


def test_latest_scans(spark):
    rows = [(1, "a", "x", "indexed", dt.datetime(2020, 1, 1)), (2, "a", "y", "indexed", dt.datetime(2020, 1, 2)), (2, "a", "y", "indexed", dt.datetime(2020, 1, 2)), (3, None, "z", "indexed", dt.datetime(2020, 1, 3))]
    df = spark.createDataFrame(rows, "scan_id long, rel_path string, content_hash string, outcome string, scanned_at timestamp")
    assert [(r["rel_path"], r["content_hash"]) for r in merge.latest_scans(df).collect()] == [("a", "y")]


def test_metadata(spark):
    df = spark.createDataFrame([(1, "s/2024-05-02/a_b.docx", "2024-05-02", ["p one", "p two", "p three"], "Own", None), (2, "s/misc/notes.txt", "misc", ["p"], "Own", dt.date(2020, 1, 2))],
                               "doc_id long, rel_path string, source_dir string, pages array<string>, prop_title string, prop_created date")
    m = {r["doc_id"]: r for r in metadata.meeting(df).collect()}
    assert m[1]["title"] == "Own" and str(m[1]["doc_date"]) == "2024-05-02" and m[1]["summary"] == "p one p two" and m[2]["year"] == 2020
    assert metadata.manual(df).orderBy("doc_id").first()["summary"] == "2024-05-02 device manual. p one p two"
    papers = spark.createDataFrame([(1, "x/10.1234_abc.pdf", ["t"], None), (2, "x/2503.01234v2.pdf", ["t"], None), (3, "x/own_paper.pdf", ["Abstract: " + "words " * 30 + "\n\nrest"], "Big Title")], "doc_id long, rel_path string, pages array<string>, font_title string")
    look = "key string, title string, authors array<string>, doc_date date, summary string"
    cross = spark.createDataFrame([("10.1234/abc", "T", ["A"], dt.date(2021, 2, 3), "S")], look)
    arx = spark.createDataFrame([("2503.01234v2", "U", ["B"], None, "R")], look)
    p = {r["doc_id"]: r for r in metadata.paper(papers, cross, arx).collect()}
    assert (p[1]["title"], p[1]["summary"], p[1]["year"], p[1]["extra"]["doi"]) == ("T", "T. S", 2021, "10.1234/abc")
    assert p[2]["extra"]["metadata_source"] == "arxiv" and p[3]["title"] == "Big Title" and p[3]["summary"].startswith("Big Title. words")


def test_lookup_replies(spark):
    reply = '{"message":{"title":["A  B"],"author":[{"given":"Ann","family":"Bee"},{"family":"Cee"}],"issued":{"date-parts":[[2020,13]]},"abstract":"<p>Hi <b>you</b></p>"}}'
    r = spark.createDataFrame([(reply,)], "j string").select(metadata.crossref_record(F.col("j")).alias("r")).first()["r"]
    assert (r["title"], r["authors"], str(r["doc_date"]), r["summary"]) == ("A B", ["Ann Bee", "Cee"], "2020-01-01", "Hi you")
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A\n B</title><summary> s </summary><published>2020-02-03T00:00:00Z</published><author><name>Ann</name></author></entry></feed>'
    r = spark.createDataFrame([(atom,)], "j string").select(metadata.arxiv_record(F.col("j")).alias("r")).first()["r"]
    assert (r["title"], r["authors"], str(r["doc_date"]), r["summary"]) == ("A B", ["Ann"], "2020-02-03", "s")


def test_embed_texts():
    c = EmbeddingConfig(backend="hash", dimensions=8, max_tokens_per_request=10)
    got = embed_texts(["one two three four five six seven", "---", None, "x"], HashBackend(c), c)
    assert got[1] is None and got[2] is None and len(got[0]) == 8 and abs(sum(x * x for x in got[0]) - 1) < 1e-9


def test_config(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("shelves:\n  - {name: a, type: manuals, path: /x}\nembedding: {backend: hash}\n")
    c = load_config(f)
    assert c.shelves["a"].path == "/x" and c.names("manuals") == ["a"] and c.names("meetings") == [] and c.embedding.backend == "hash"
    for bad in ("shelves: []", "shelves:\n  - {name: a, type: nope, path: /x}", "shelves:\n  - {name: a, type: manuals, path: /x}\n  - {name: a, type: manuals, path: /x}", "shelves:\n  - {name: a, type: manuals, path: /x}\nembedding: {backend: nope}", "shelves:\n  - {name: a, type: manuals, path: /x}\nchunking: {target: 4}", "shelves:\n  - {name: a, type: manuals}"):
        f.write_text(bad)
        with pytest.raises(ValueError):
            load_config(f)
    with pytest.raises(FileNotFoundError):
        load_config(tmp_path / "none.yaml")
