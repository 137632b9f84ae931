"""Problem 8: bring text that looks the same to the same characters.

Built-in functions map look-alike characters; only texts that may hold
uncomposed accents or accented look-alikes travel to Python, which composes
before and after the mapping.  Grouping runs in SQL under the
accent- and case-sensitive UNICODE collation, for which precomposed and
combining accents, and invisible characters, are equal.  Each class gets one
deterministic canonical member, joined back to every document.

Classes compare by looks alone.  What comes out is also right to read: a word
that is Cyrillic, Greek or Armenian by its other letters stays in its script.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import UNCOMPOSED, nfc
from ..runtime import Scratch

# Look-alike letters, then what they look like, place by place.
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿνορϲϳ"
GREEK_AS = "ABEZHIKMNOPTYXCJvopcj"
CYRILLIC = "АВЕКМНОРСТХІЈЅҮԌԚԜѴаеорсухіјѕһԁԛԝѵ"
CYRILLIC_AS = "ABEKMHOPCTXIJSYGQWVaeopcyxijshdqwv"
ARMENIAN = "ՍՏՕԼսոհցօյ"
ARMENIAN_AS = "USOLunhgoj"
SPACES = "              　"
HYPHENS = "‐‑－"
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤﻿"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
SIGNS = "KÅΩ"
SIGNS_AS = "KÅΩ"


def _pairs() -> tuple[str, str]:
    full = "".join(chr(c) for c in range(0xFF01, 0xFF5F) if chr(c) not in HYPHENS)
    plain = "".join(chr(ord(c) - 0xFEE0) for c in full)
    source = GREEK + CYRILLIC + ARMENIAN + SPACES + HYPHENS + SIGNS + full
    return source, GREEK_AS + CYRILLIC_AS + ARMENIAN_AS + " " * len(SPACES) + "-" * len(HYPHENS) + SIGNS_AS + plain


def _accented() -> dict[str, str]:
    """Precomposed accented look-alikes and what they look like: Cyrillic io is e with diaeresis."""
    plain = dict(zip(GREEK + CYRILLIC, GREEK_AS + CYRILLIC_AS))
    out = {}
    for c in map(chr, [*range(0x370, 0x530), *range(0x1F00, 0x2000)]):
        first, *rest = unicodedata.normalize("NFD", c)
        if rest and first in plain:
            out[c] = unicodedata.normalize("NFC", plain[first] + "".join(rest))
    return out


ACCENTED = _accented()
_SCRIPTS = {"greek": (GREEK, GREEK_AS), "cyrillic": (CYRILLIC, CYRILLIC_AS), "armenian": (ARMENIAN, ARMENIAN_AS)}
_FOREIGN = r"[\x{370}-\x{3ff}\x{1f00}-\x{1fff}\x{400}-\x{52f}\x{530}-\x{58f}]"
_MARKED = "(?:[^\\W\\d_]|[\u0300-\u036f])"
_FOREIGN_WORD = re.compile(f"{_MARKED}*[\u0370-\u03ff\u1f00-\u1fff\u0400-\u052f\u0530-\u058f]{_MARKED}*")
_LETTER = re.compile(r"[^\W\d_]")
# Beyond UNCOMPOSED: letters and signs that composition replaces wherever they stand.
REPLACED = r"\x{374}\x{958}-\x{95f}\x{9dc}-\x{9df}\x{a33}-\x{a5e}\x{b5c}\x{b5d}\x{f43}-\x{f69}\x{2adc}\x{1d15e}-\x{1d1c0}\x{2f800}-\x{2fa1f}"


@cache
def _composed(accents: bool):
    """``mapped`` in Python, between two compositions; made on first use, as workers have no session."""
    source, target = _pairs()
    table = str.maketrans(dict(zip(source, target)) | dict.fromkeys(INVISIBLE, "") | LIGATURES | (ACCENTED if accents else {}))

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", unicodedata.normalize("NFC", x).translate(table)), na_action="ignore")

    return F.pandas_udf(run, "string")


def mapped(text: Column, accents: bool = False) -> Column:
    """The text composed, look-alikes replaced and invisible characters removed; JVM-side but for what needs composing, skipped for plain ASCII.

    With ``accents`` accented look-alikes are replaced as well.
    """
    source, target = _pairs()
    out = F.translate(text, source + INVISIBLE, target)  # characters beyond the target's length are deleted
    for ligature, letters in LIGATURES.items():
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    odd = F.octet_length(text) != F.length(text)
    # the cheap ranges come first: nearly all characters end there
    needs = text.rlike(r"[\x{300}-\x{2001}\x{2126}-\x{10ffff}&&" + UNCOMPOSED[:-1] + REPLACED + ("".join(ACCENTED) if accents else "") + "]]")
    return F.coalesce(_composed(accents)(F.when(odd & needs, text)), F.when(odd, out).otherwise(text))


def _script(c: str) -> str | None:
    """The script of a letter, as far as look-alikes go: greek, cyrillic, armenian or latin."""
    n = ord(c)
    if 0x370 <= n <= 0x3FF or 0x1F00 <= n <= 0x1FFF:
        return "greek"
    if 0x400 <= n <= 0x52F:
        return "cyrillic"
    if 0x530 <= n <= 0x58F:
        return "armenian"
    return "latin" if n < 0x250 or 0x1E00 <= n <= 0x1EFF else None


@cache
def _tables(accents: bool) -> tuple[dict[str, str], dict[str, dict[str, str]], dict]:
    """Look-alike letters to what they look like, per script the way back, and what is replaced wherever it stands."""
    there = {c: t for source, target in _SCRIPTS.values() for c, t in zip(source, target)} | (ACCENTED if accents else {})
    back: dict[str, dict[str, str]] = {s: {} for s in _SCRIPTS}
    for c, t in there.items():
        back[_script(c)].setdefault(t, c)
    rest = {c: t for c, t in zip(*_pairs()) if c not in there} | dict.fromkeys(INVISIBLE, "") | LIGATURES
    return there, back, str.maketrans(rest)


def settled(text: str, accents: bool = True) -> str:
    """The text in one form, every word in the script its unmistakable letters have.

    A word with unmistakable letters of one script takes that script as a whole.
    A word of look-alikes only is Latin, unless it stands in another script and
    next to a word of it.  A word with unmistakable letters of two scripts keeps
    them, its look-alikes become Latin.
    """
    there, back, rest = _tables(accents)
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).translate(rest))
    words = list(_FOREIGN_WORD.finditer(text))  # all others are Latin already
    kinds: list[str] = []
    for m in words:
        scripts = {s for s in map(_script, m.group()) if s}
        others = scripts - {"latin"}
        sure = {s for c in m.group() if (s := _script(c)) and (c not in there if s != "latin" else any(c not in back[o] for o in others))}
        kinds.append(sure.pop() if len(sure) == 1 else "latin" if sure or len(scripts) > 1 else "?" + others.pop())
    # words with no Latin word between them
    near = [bool(i) and not _LETTER.search(text, words[i - 1].end(), words[i].start()) for i in range(len(words))] + [False]
    for order, back_one in ((range(len(words)), -1), (range(len(words) - 1, -1, -1), 1)):
        for i in order:
            if kinds[i][0] == "?" and near[i if back_one < 0 else i + 1] and kinds[i][1:] == kinds[i + back_one]:
                kinds[i] = kinds[i][1:]
    out, at = [], 0
    for m, kind in zip(words, kinds):
        word = m.group()
        if kind in back:
            word = "".join(back[kind].get(c, c) if _script(c) == "latin" else c for c in word)
        else:
            word = "".join(there.get(c, c) for c in word)
        out += [text[at : m.start()], word]
        at = m.end()
    return unicodedata.normalize("NFC", "".join([*out, text[at:]]))


@cache
def _settle():
    def run(s: pd.Series) -> pd.Series:
        return s.map(settled, na_action="ignore")

    return F.pandas_udf(run, "string")


def one_form(text: Column) -> Column:
    """``settled``; texts without Greek, Cyrillic or Armenian letters, nearly all, stay in the JVM where ``mapped`` does."""
    foreign = text.rlike(_FOREIGN)
    return F.coalesce(_settle()(F.when(foreign, text)), mapped(F.when(~foreign, text), accents=True))


def _key(look: Column) -> Column:
    return F.xxhash64(F.regexp_replace(look, r"[\p{M}\p{C}&&[^\t\n\f\r]]", ""))


def coarse_key(look: Column) -> Column:
    """A hash that texts equal under the collation share: of the composed text without what it leaves out, control and format characters and loose marks.

    Letters of every script count, so texts in other scripts don't crowd under one key.
    """
    return _key(nfc(look))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, class_id, canonical_id, raw)``: one row per document with non-blank text that shares its look with another text.

    ``class_id`` is the smallest id of the class, ``canonical_id`` the id of its
    canonical member: the text with the fewest characters outside ASCII, then
    the shortest, then the first in binary order.  ``raw`` is a 64-bit hash of
    the exact characters.  Of all texts only hashes are shuffled; the texts
    themselves only where two different ones share the coarse key, and those
    are grouped by the whole text under the collation.
    """
    spark = docs.sparkSession
    visible = F.regexp_replace(F.translate(F.col(text_col), INVISIBLE, ""), r"[\s\x{00a0}\x{2007}\x{202f}]+", "") != ""
    base = docs.where(F.col(text_col).isNotNull() & visible).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    looks = base.select("id", "text", F.xxhash64("text").alias("raw"), mapped(F.col("text")).alias("look"))
    keyed = looks.withColumn("h", _key(F.col("look")))  # a look is composed already
    scratch = Scratch(spark, "lookalikes")
    keys = scratch.keep(keyed.select("id", "raw", "h"))
    several = keys.groupBy("h").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a <> b").select("h")
    wanted = scratch.keep(keys.join(several, "h", "left_semi"))
    # broadcast only up to a counted 500,000 ids; beyond that the texts are joined by shuffle
    few = wanted.count() <= 500_000
    texts = base.join(F.broadcast(wanted) if few else wanted, "id").select("id", "raw", "text", mapped(F.col("text")).alias("look"))
    # one text per exact form: a group of copies is one row here
    forms = texts.groupBy("raw", F.col("text")).agg(F.min("id").alias("form_id"), F.first("look").alias("look"))
    forms = scratch.keep(forms.select("raw", "form_id", "look", (F.octet_length("text") - F.length("text")).alias("odd"), F.length("text").alias("n")))
    view = "folioquarry_forms_" + scratch.root[-12:]
    forms.createOrReplaceTempView(view)
    canon = spark.sql(f"""
        SELECT min(form_id) AS class_id, min(struct(odd, n, look, form_id)).form_id AS canonical_id, collect_list(raw) AS raws
        FROM {view} GROUP BY collate(look, 'UNICODE') HAVING count(*) > 1""")
    member = canon.select("class_id", "canonical_id", F.explode("raws").alias("raw"))
    return wanted.select("id", "raw").join(member, "raw").select("id", "class_id", "canonical_id", "raw")


def unify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text)``: every row of ``docs`` in its ``one_form``; the texts of a class take that of its canonical member.

    Null stays null, blank and empty texts stay as they are.  Only texts of
    classes are shuffled; all others are mapped where they are read.
    """
    c = Scratch(docs.sparkSession, "unify").keep(classes(docs, id_col, text_col).select("id", "canonical_id", "raw"))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # broadcast only up to a counted 500,000 rows
    few = (lambda df: F.broadcast(df)) if c.count() <= 500_000 else (lambda df: df)
    own = F.when(F.trim("text") == "", F.col("text")).otherwise(one_form(F.col("text")))
    rows = c.select("id", "raw").distinct()
    lone = base.where("text IS NULL").unionByName(
        base.where("text IS NOT NULL").withColumn("raw", F.xxhash64("text")).join(few(rows), ["id", "raw"], "left_anti").select("id", "text"))
    heads = base.join(few(c.select(F.col("canonical_id").alias("id")).distinct()), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    canon = heads.select(F.col("id").alias("canonical_id"), one_form(F.col("text")).alias("text"))
    return lone.select("id", own.alias("text")).unionByName(c.join(canon, "canonical_id").select("id", "text"))


def looks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, look)``: the form texts are compared in, all look-alikes as Latin whatever the word; null for null, blank as it is."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.when(F.trim(text_col) == "", text).otherwise(mapped(text, accents=True)).alias("look"))


def look_alike_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id_a, doc_id_b)``: documents of one class whose texts are not the same characters.

    Pairs are made of the different texts of a class and only then of their
    documents, so copies of one text are never paired with each other.
    """
    c = Scratch(docs.sparkSession, "pairs").keep(classes(docs, id_col, text_col))
    forms = c.select("class_id", "raw").distinct()
    other = forms.select("class_id", F.col("raw").alias("raw_b")).join(forms.withColumnRenamed("raw", "raw_a"), "class_id").where("raw_a < raw_b").select("raw_a", "raw_b")
    x = c.select(F.col("raw").alias("raw_a"), F.col("id").alias("x"))
    y = c.select(F.col("raw").alias("raw_b"), F.col("id").alias("y"))
    both = other.join(x, "raw_a").join(y, "raw_b").where("x <> y")
    return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
