"""Text functions as JVM-side expressions; Python only where Unicode composition or title case needs it."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a heading line (numbered; short capitals; title case ending in digits).
HEADING = (
    r"^(?:\d+(?:\.\d+)*\.?\s+\S.{0,80}"
    r"|[A-Z][A-Z0-9 \-/]{3,60}"
    r"|[A-Z][\w\-ÔÄÖÅäöå]+(?:[ \-/][\w\-ÔÄÖÅäöå]+)*\s+\d[\d.]{1,14})$"
)
#: Characters whose presence may mean that a text is not in composed form.
UNCOMPOSED = r"[\p{M}\x{37e}\x{387}\x{1100}-\x{11ff}\x{1f71}-\x{1fff}\x{2000}\x{2001}\x{2126}\x{212a}\x{212b}\x{2329}\x{232a}\x{f900}-\x{faff}\x{fb1d}-\x{fb4f}]"
TOKEN = r"[\p{L}\p{N}_]+(?:[-.][\p{L}\p{N}_]+)*"
CHARS_PER_TOKEN = 4
#: Fixed value: every white-space character.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def _title(s: pd.Series) -> pd.Series:
    return s.str.title()


@cache
def _udf(f):
    """Made on first use: workers import this module too and have no session."""
    return F.pandas_udf(f, "string")


def title_case(c: Column) -> Column:
    """Capital after every non-letter, unlike ``initcap``."""
    return _udf(_title)(c)


def nfc(c: Column) -> Column:
    """Composed form; only texts that may need it travel to Python."""
    return F.coalesce(_udf(_nfc)(F.when(c.rlike(UNCOMPOSED), c)), c)


def strip(c: Column) -> Column:
    """White space of any kind off both ends (``trim`` alone takes blanks only); linear, unlike a pattern for the end."""
    return F.btrim(c, F.lit(WHITE))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_text(c: Column) -> Column:
    return clean_composed(nfc(c))


def clean_composed(c: Column) -> Column:
    """``clean_text`` of text that is in composed form already; fit for lambdas, which take no Python."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", " ")
    c = F.regexp_replace(c, r"[\x{fffd}\x{e000}-\x{f8ff}\p{Cf}]", "")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def is_embeddable(c: Column) -> Column:
    """At least one letter or digit."""
    return F.coalesce(c.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def wire_safe(c: Column) -> Column:
    """One line, single blanks: the form an embedding server takes."""
    return squeeze(c)


def chunk_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / CHARS_PER_TOKEN).cast("int")


def wire_tokens(c: Column) -> Column:
    return (F.floor(F.length(c) / 2) + 1).cast("int")


def heading_of(c: Column) -> Column:
    """The first line where it reads like a heading under 90 characters, else null."""
    line = strip(F.substring_index(c, "\n", 1))
    return F.when(line.rlike("(?U)" + HEADING) & (F.length(line) < 90), line)


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def tokens(c: Column) -> Column:
    """Lower-case index terms in reading order; a hyphen or point inside a term stays."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def strip_tags(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, r"<[^>]+>", ""))


def stem_of(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r".(\.[^.]+)$", 1))


def clean_stem(stem: Column) -> Column:
    return title_case(strip(F.regexp_replace(stem, r"[_\-]+", " ")))


def markdown_text(c: Column) -> Column:
    """Markdown without fenced blocks and heading marks; an unclosed fence drops the rest."""
    lines = F.split(c, r"\r\n|\r|\n")
    fence = r"^\s*(```|~~~)"
    state = F.aggregate(
        lines,
        F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept")),
        lambda acc, x: F.struct(
            F.when(x.rlike(fence), ~acc["inside"]).otherwise(acc["inside"]).alias("inside"),
            F.when(x.rlike(fence) | acc["inside"], acc["kept"]).otherwise(F.array_append(acc["kept"], F.regexp_replace(x, r"^#{1,6}\s+(.*?)\s*#*\s*$", "$1"))).alias("kept")),
    )
    return F.array_join(state["kept"], "\n")


def row_cells(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, r"\|"), strip), lambda x: x != "")


def is_header(cells: Column) -> Column:
    """Two or more filled cells, none longer than 60 characters, none a plain number."""
    filled = F.filter(cells, lambda x: x.isNotNull() & (x != ""))
    return (F.size(filled) >= 2) & F.forall(filled, lambda x: F.length(x) <= 60) & ~F.exists(filled, lambda x: F.regexp_replace(x, " ", "").rlike(r"(?U)^\d+$"))


def linearise(header: Column, row: Column) -> Column:
    """``head: value | head: value`` for the pairs filled on both sides, else the filled cells."""
    pairs = F.filter(F.arrays_zip(header.alias("h"), row.alias("v")), lambda p: (F.coalesce(p["h"], F.lit("")) != "") & (F.coalesce(p["v"], F.lit("")) != ""))
    joined = F.array_join(F.transform(pairs, lambda p: F.concat(p["h"], F.lit(": "), p["v"])), " | ")
    plain = F.array_join(F.filter(row, lambda x: F.coalesce(x, F.lit("")) != ""), " | ")
    return F.when(header.isNotNull() & (F.size(pairs) > 0), joined).otherwise(plain)


def model_prefix(text: Column, model: str, query: bool) -> Column:
    """The prefix an embedding model expects before a query or a document."""
    name = model.lower()
    # Model name part, query prefix, document prefix; the first that fits holds.
    for part, ask, store in (
        ("nomic-embed", "search_query: ", "search_document: "),
        ("e5", "query: ", "passage: "),
        ("lfm2", "query: ", "document: "),
        ("qwen3-embedding", "Instruct: Given a search query, retrieve relevant passages\nQuery: ", ""),
    ):
        if part in name:
            return F.concat(F.lit(ask if query else store), text)
    return text
