import unicodedata

from pyspark.sql import functions as F

from folioquarry.llm import lookalikes

SAME = ["Max 300X päivä fix-up", "Мах 300X päivä fix-up", "Max ３００Ｘ päivä fix-up", unicodedata.normalize("NFD", "Max 300X päivä fix-up"), "Max 300X päi​vä ﬁx‑up", "﻿Max 300X\xa0päivä fix‐up"]
OTHER = ["max 300X päivä fix-up", "Max 300X paiva fix-up", "Max 3OOX päivä fix-up", "Max 300X päivä fix—up", "Max 300X päivä. fix-up", "Max  300X päivä fix-up", "Max 300X\npäivä fix-up"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, look string, raw int")


def test_pairs(spark):
    texts = [*SAME, *OTHER, SAME[0], None, "", " \n", "\xa0 ", "plain", "plain"]
    got = {(r[0], r[1]) for r in lookalikes.look_alike_pairs(frame(spark, texts)).collect()}
    same = [*range(len(SAME)), len(SAME) + len(OTHER)]
    want = {(a, b) for a in same for b in same if a < b and texts[a] != texts[b]}
    assert got == want


def test_unify(spark):
    texts = [*SAME, *OTHER, None, "", " "]
    got = {r["id"]: r["text"] for r in lookalikes.unify(frame(spark, texts)).collect()}
    assert len(got) == len(texts) and len({got[i] for i in range(len(SAME))}) == 1
    assert [got[len(SAME) + i] for i in range(len(OTHER))] == OTHER
    assert got[len(texts) - 3] is None and got[len(texts) - 2] == "" and got[len(texts) - 1] == " "


def test_empty(spark):
    empty = frame(spark, ["x"]).limit(0)
    assert lookalikes.look_alike_pairs(empty).collect() == [] and lookalikes.unify(empty).collect() == []


def test_coarse_key_follows_the_collation(spark):
    df = spark.createDataFrame([("ä b",), (unicodedata.normalize("NFD", "ä b"),), ("a b",)], "t string")
    a, b, c = [r[0] for r in df.select(lookalikes.coarse_key(F.col("t"))).collect()]
    assert a == b != c


def test_unify_composes_texts_of_no_class(spark):
    lone = unicodedata.normalize("NFD", "päivä näin, Åbo")
    #   alone in its look; Cyrillic e and a mark; a mark behind an invisible; precomposed look-alikes
    texts = [lone, "caf\u0435\u0301", "u\u200d\u0308ber", "\u0451lan", "\u045ees", None]
    got = {r["id"]: r["text"] for r in lookalikes.unify(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == ["päivä näin, Åbo", "café", "über", "ëlan", "y\u0306es", None]


def test_pairs_hold_to_composed_characters(spark):
    texts = ["\u0435\u0308 one", "\u0451 one", "\u00eb one"]  # the SQL composes first, so the first is Cyrillic io
    assert [tuple(r) for r in lookalikes.look_alike_pairs(frame(spark, texts)).collect()] == [(0, 1)]


def test_every_uncomposed_character_is_seen(spark):
    odd = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and unicodedata.normalize("NFC", c) != c]
    got = lookalikes.unify(frame(spark, ["x" + c for c in odd])).collect()
    assert len(got) == len(odd) and all(unicodedata.is_normalized("NFC", r["text"]) for r in got)


def test_words_keep_their_script(spark):
    texts = {
        "Москва и рост оса": "Москва и рост оса", "знак «Насос» 7": "знак «Насос» 7", "Всё ещё": "Всё ещё", "λόγος ὁ αὐτός": "λόγος ὁ αὐτός",
        "Mосква": "Москва", "Мах 300X": "Max 300X", "рumр on": "pump on", "Τhe νalve": "The valve", "а b с": "a b c", "Соре": "Cope",
        "IT-отдел": "IT-отдел", "pу́мпа": "ру́мпа", unicodedata.normalize("NFD", "päivä ёлка"): "päivä ёлка", "Ս Տ": "U S", "Հայաստան": "Հայաստան", "": "", None: None,
    }
    got = {r["id"]: r["text"] for r in lookalikes.unify(frame(spark, list(texts))).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_one_form_is_stable(spark):
    once = [lookalikes.settled(t) for t in ("Мах и Mосква", "λόγος vο", "рumр ёлка", "oса оса, сок")]
    assert [lookalikes.settled(t) for t in once] == once


def test_texts_in_other_scripts_do_not_share_a_key(spark):
    texts = ["제주도의 한라산", "서울의 북한산", "Москва", "Казань", "東京", "大阪", "ábc", "ábd"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.select(lookalikes.coarse_key(F.col("t"))).distinct().count() == len(texts)


def test_copies_and_a_third_of_the_rows_in_one_class(spark):
    texts = ["Max pump"] * 40 + ["Мax pump"] * 3 + ["other %d" % i for i in range(80)]
    df = frame(spark, texts)
    got = {(r[0], r[1]) for r in lookalikes.look_alike_pairs(df).collect()}
    assert got == {(a, b) for a in range(40) for b in range(40, 43)}
    c = lookalikes.classes(df).collect()
    assert {r["id"] for r in c} == set(range(43)) and {r["class_id"] for r in c} == {0}
    out = lookalikes.unify(df).collect()
    assert len(out) == len(texts) and {r["text"] for r in out if r["id"] < 43} == {"Max pump"}


def test_repeated_rows_are_kept(spark):
    df = frame(spark, ["Max pump", "Мax pump"]).unionByName(frame(spark, ["Max pump", "else", None]))
    out = sorted((r["id"], r["text"]) for r in lookalikes.unify(df).where("text IS NOT NULL").collect())
    assert out == [(0, "Max pump"), (0, "Max pump"), (1, "Max pump"), (1, "else")]
