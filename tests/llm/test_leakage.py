import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from folioquarry.llm import leakage

WORDS = [f"w{i}" for i in range(400)]


def passage(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def brute(item, doc, penalty=3):
    h = [[0] * (len(doc) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i in range(1, len(item) + 1):
        for j in range(1, len(doc) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if item[i - 1] == doc[j - 1] else -penalty), h[i - 1][j] - penalty, h[i][j - 1] - penalty)
            best = max(best, h[i][j])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=14), st.lists(st.integers(1, 4), min_size=1, max_size=20))
def test_alignment(item, doc):
    assert leakage.alignment(np.array(item), np.array(doc)) == brute(item, doc)


def noisy(words, rng):
    out = []
    for w in words:
        r = rng.random()
        if r < 0.05:
            continue
        out.append(rng.choice(WORDS) if r < 0.1 else w)
    text = " ".join(out).upper().replace(" ", "  ", 3).replace("W1", "Ｗ1")
    return text.replace("9 ", "9-\n", 1).replace("7", "7​", 2)


def test_find(spark):
    rng = random.Random(4)
    items = [(i, "Read the text below.\n" + " ".join(passage(rng, 50)), "x") for i in range(30)]
    docs, want = [], set()
    for d in range(120):
        words = passage(rng, 150)
        text = " ".join(words)
        if d % 4 == 0:
            i = d % 30
            own = items[i][1].split("\n")[1].split()
            text += " " + (noisy(own, rng) if d % 8 else " ".join(own[9:29])) + " " + " ".join(words)
            want.add((d, i))
        if d % 4 == 1:
            text += " Read the text below. " + " ".join(items[3][1].split("\n")[1].split()[:9])
        docs.append((d, text, 1))
    docs += [(900, None, 1), (901, "", 1), (902, "\n", 1), (0, docs[0][1], 1)]
    items += [(90, None, "x"), (91, "", "x"), (92, "Read the text below.", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score int")
    it = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    got = [(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(df, it).collect()]
    assert set(got) == want and len(got) == len(want) + 1
    assert leakage.find_leaks(df, it.limit(0)).collect() == [] and leakage.find_leaks(df.limit(0), it).collect() == []


def test_repeated_items_keep_their_passage(spark):
    rng = random.Random(6)
    one, two, three = (" ".join(passage(rng, 40)) for _ in range(3))
    head = "Read the text below."
    items = [(1, f"{head}\n{one}"), (2, f"{head}\n{one}"), (3, f"Choose the answer.\n{two}"), (4, f"Fill the gaps.\n{two}"), (5, f"{head}\n{three}")]
    docs = [(d, " ".join(passage(rng, 60)) + " " + x + " " + " ".join(passage(rng, 60))) for d, x in enumerate([one, two, three, head])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(df, it).collect()}
    assert got == {(0, 1), (0, 2), (1, 3), (1, 4), (2, 5)}


def brute_distance(item, doc):
    row = [0] * (len(doc) + 1)
    for j, w in enumerate(item):
        new = [j + 1]
        for k, x in enumerate(doc):
            new.append(min(row[k] + (w != x), row[k + 1] + 1, new[k] + 1))
        row = new
    return min(row)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=14), st.lists(st.integers(1, 4), min_size=1, max_size=20))
def test_distance(item, doc):
    assert leakage.distance(np.array(item), np.array(doc)) == brute_distance(item, doc)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=30), st.randoms(use_true_random=False))
def test_no_case_is_filtered_out(item, rng):
    """The cheap bounds before the alignments lose nothing."""
    doc = [rng.randint(10, 20) for _ in range(5)]
    for w in item:
        r = rng.random()
        doc += [] if r < 0.1 else [rng.randint(1, 20)] if r < 0.2 else [w]
    score, edits = brute(item, doc), brute_distance(item, doc)
    want = (score, edits) if edits <= int(0.3 * len(item)) or (len(item) >= 8 and score >= 8) else None
    assert leakage.verify(np.array(item), np.array(doc), 8, 0.3, 3) == want


def test_plan_reaches_the_target():
    repetitions, recall = leakage.plan(0.99, 0.3, 18, 5, 6)
    assert recall >= 0.99 and 1 < repetitions < 40
    assert leakage.plan(0.9, 0.3, 18, 5, 6)[0] <= repetitions


def test_against_all_pairs(spark):
    """Every pair of a made corpus, by the definition and without hashing: altered, partial, split and short items, and mere style."""
    rng = random.Random(8)
    style = [passage(rng, 9) for _ in range(6)]
    items = {i: sum((rng.choice(style) + passage(rng, 4) for _ in range(4)), []) for i in range(25)}
    items |= {100 + n: passage(rng, n) for n in (3, 7, 12, 17, 18, 19)}
    docs = {}
    for d in range(200):
        words = passage(rng, 40) + rng.choice(style)
        own = items[rng.choice(list(items))]
        kind = d % 5
        if kind == 0:
            words += own
        elif kind == 1 and len(own) > 30:
            at = rng.randrange(len(own) - 22)
            words += own[at : at + rng.randint(14, 22)]
        elif kind == 2:
            words += [w if rng.random() > 0.2 else rng.choice(WORDS) for w in own]
        elif kind == 3:
            words += own[: len(own) // 2] + passage(rng, 12) + own[len(own) // 2 :]
        docs[d] = words + passage(rng, 20)
    want = set()
    for d, words in docs.items():
        for i, item in items.items():
            if brute_distance(item, words) <= int(0.3 * len(item)) or (len(item) >= 18 and brute(item, words) >= 18):
                want.add((d, i))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(df, it).collect()}
    assert len(want) > 60 and got <= want and len(want - got) <= 0.01 * len(want)


def test_bit_map(spark):
    numbers = [3, 3, 70_000, (1 << 40) + 9, 5_000_000]
    got = leakage.bit_map(spark.createDataFrame([(n,) for n in numbers], "h long"), 22)
    assert np.nonzero(np.unpackbits(got, bitorder="little"))[0].tolist() == sorted({n & ((1 << 22) - 1) for n in numbers})
