import itertools
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from folioquarry.llm import queries, splitting


def grade(text, limit):
    segs = [text]
    for name, p in zip(splitting.GRADES, (r"\f|\r?\n(?:[ \t]*\r?\n)+", r"\r?\n", r"(?<=[.!?])\s+", r"\s+")):
        segs = [y for s in segs for y in re.split(p, s)]
        if max(len(s.strip()) for s in segs) <= limit:
            return name
    return "none"


texts = st.lists(st.sampled_from(["word", "longerword", ". ", "! ", "\n", "\n \n", "\f", "\r\n", " ", "x" * 30, "ä"]), min_size=5, max_size=120).map("".join)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_pieces(text):
    limit, overlap = 40, 8
    if len(text) <= limit:
        return
    g, pieces = splitting.split_text(text, 3, None, limit, overlap)
    assert g == grade(text, limit)
    covered = set()
    for first, body, last, content, p0, p1, tokens in pieces:
        assert content == text[first:last] and content == content.strip() and 0 < len(content) <= limit
        assert tokens == len(content) // 4 and p0 == 3 + text[:first].count("\f") and p1 == 3 + text[: last].count("\f")
        covered |= set(range(first, last))
    assert all(i in covered or c.isspace() for i, c in enumerate(text))
    for a, b in zip(pieces, pieces[1:]):
        assert b[0] >= a[0] and b[2] >= a[2] and a[2] - b[0] <= overlap + 1 or b[0] >= a[1]


def reference_cost(text, cuts, limit, overlap):
    """Cost of a way to cut, None where a piece is too long."""
    g, at, cost = splitting.boundaries(text, limit, limit - overlap - 1)
    pay = dict(zip(at, cost))
    length = max(1, len(text.strip()))
    room = limit - overlap - 1
    even = length / max(1, -(-length // room))
    total = 0.0
    for a, b in zip([0, *cuts], [*cuts, len(text)]):
        size = len(text[a:b].strip())
        if size > (limit if a == 0 else room):
            return None
        total += pay.get(b, 0.0) + ((size - even) / even) ** 2 + 0.02
    return total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", "long word ", ". ", "\n", "\n\n", " ", "x" * 12]), min_size=8, max_size=22).map("".join))
def test_cuts_are_the_cheapest(text):
    limit, overlap = 30, 6
    _, at, cost = splitting.boundaries(text, limit, limit - overlap - 1)
    if len(text) <= limit or len(at) > 11 or not text.strip():
        return
    mine = reference_cost(text, splitting.choose_cuts(text, at, cost, limit, overlap), limit, overlap)
    costs = [reference_cost(text, cuts, limit, overlap) for n in range(len(at) + 1) for cuts in itertools.combinations(at, n)]
    assert mine is not None and abs(mine - min(c for c in costs if c is not None)) < 1e-9


def test_every_piece_has_its_overlap():
    # paragraphs that fit the limit but leave no room for an overlap
    text = "\n\n".join(" ".join(f"w{p}x{i:03d}" for i in range(330)) for p in range(6))
    assert all(2160 < len(p) <= 2400 for p in text.split("\n\n"))
    g, pieces = splitting.split_text(text, 1, 1)
    assert g == "paragraph" and all(len(p[3]) <= 2400 for p in pieces)
    assert all(180 <= a[2] - b[0] <= 242 for a, b in zip(pieces, pieces[1:]))


def test_long_white_space():
    text = "ab cd. " * 400 + " " * 30_000 + "ef gh. " * 400 + "\f" + "\t" * 9_000 + "end"
    g, pieces = splitting.split_text(text, 1, 2)
    assert all(0 < len(p[3]) <= 2400 and p[3] == p[3].strip() for p in pieces)
    assert {w for p in pieces for w in p[3].split()} == {"ab", "cd.", "ef", "gh.", "end"} and pieces[-1][3].endswith("end") and pieces[-1][5] == 2


def test_overlap_is_about_as_asked():
    text = " ".join(f"word{i}" for i in range(2000))
    _, pieces = splitting.split_text(text, None, None)
    laps = [a[2] - b[0] for a, b in zip(pieces, pieces[1:])]
    assert all(200 <= x <= 240 for x in laps) and all(p[4] is None for p in pieces)
    assert text == "".join(text[a[2] if a else 0 : b[2]] for a, b in zip([None, *pieces], pieces))


def test_frame(spark):
    rows = [(1, "short", 1, 1, 9, "x"), (2, None, 1, 1, 9, "x"), (3, "", None, None, None, "x"), (4, "w " * 2000, 5, 5, 0, "x"), (4, "w " * 2000, 5, 5, 0, "x"), (5, " " * 3000, 1, 1, 0, "x"), (6, "y" * 9000, None, None, 0, "x")]
    df = spark.createDataFrame(rows, "id long, content string, page_start int, page_end int, token_count int, boundary string")
    got = splitting.split_oversized(df).collect()
    assert {(r["chunk_id"], r["boundary"]) for r in got} == {(4, "word"), (6, "none")}
    assert all(len(r["content"]) <= 2400 for r in got) and all(r["page_start"] == 5 for r in got if r["chunk_id"] == 4)
    assert splitting.split_oversized(df.limit(0)).collect() == []


def test_very_long_text():
    _, pieces = splitting.split_text("ab cd. " * 60_000, 1, 1)
    assert all(len(p[3]) <= 2400 for p in pieces)


def test_found_keeps_blank_chunks(spark, monkeypatch):
    df = spark.createDataFrame([(5, " " * 3000, 1, 2), (6, "short", 1, 1)], "id long, content string, page_start int, page_end int")
    monkeypatch.setattr(queries, "table", lambda *a: df)
    assert [tuple(r) for r in queries.p5_found(spark, "").collect()] == [(5, "paragraph")]
