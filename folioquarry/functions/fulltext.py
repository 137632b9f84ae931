"""Full-text search over token arrays: web-style queries, matching and cover-density rank, all JVM-side."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = re.compile(r'(-?)"([^"]*)"?|(\S+)')
_TOKEN = re.compile(r"[^\W]+(?:[-.][^\W]+)*")
WEIGHT = 0.1


@dataclass(frozen=True)
class Term:
    words: tuple[str, ...]
    wanted: bool = True


@dataclass(frozen=True)
class Query:
    """An OR of ANDs."""

    groups: tuple[tuple[Term, ...], ...]

    @property
    def words(self) -> list[str]:
        return list(dict.fromkeys(w for g in self.groups for t in g if t.wanted for w in t.words))


def parse(text: str) -> Query:
    """Bare words are ANDed, ``"..."`` is a phrase, ``or`` an alternative, a leading ``-`` excludes; never an error, empty matches nothing."""
    groups: list[list[Term]] = [[]]
    for m in _PART.finditer(text or ""):
        minus, phrase, word = m.groups()
        if word is not None:
            if word.lower() == "or":
                if groups[-1]:
                    groups.append([])
                continue
            minus = "-" if word.startswith("-") else ""
            phrase = word
        found = tuple(_TOKEN.findall(phrase.lower()))
        if found:
            groups[-1].append(Term(found, not minus))
    return Query(tuple(tuple(g) for g in groups if g))


def _has(tokens: Column, words: tuple[str, ...]) -> Column:
    if len(words) == 1:
        return F.array_contains(tokens, words[0])
    n = len(words)
    phrase = F.array(*map(F.lit, words))
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1)))
    near = reduce(lambda a, b: a & b, [F.array_contains(tokens, w) for w in words])  # cheap test first
    return near & (F.size(tokens) >= n) & F.exists(starts, lambda i: F.slice(tokens, i, n) == phrase)


def match(query: Query, tokens: Column) -> Column:
    return _alternatives(query, lambda words: _has(tokens, words))


def _alternatives(query: Query, has) -> Column:
    if not query.groups:
        return F.lit(False)
    ands = [reduce(lambda a, b: a & b, [has(t.words) if t.wanted else ~has(t.words) for t in g]) for g in query.groups]
    return F.coalesce(reduce(lambda a, b: a | b, ands), F.lit(False))


def match_places(query: Query, places: dict[str, Column]) -> Column:
    """``match`` on the places of each word of the query, ascending arrays that are empty where a word is absent."""
    def has(words: tuple[str, ...]) -> Column:
        first = places[words[0]]
        if len(words) == 1:
            return F.size(first) > 0
        return F.exists(first, lambda p: reduce(lambda a, b: a & b, [F.array_contains(places[w], p + k) for k, w in enumerate(words) if k]))

    return _alternatives(query, has)


def rank(query: Query, tokens: Column) -> Column:
    """Cover density: each minimal stretch that satisfies the query adds 0.1 / (1 + words in it that the query has not).

    A fold over the hits keeps the last place of every word; a stretch begins at
    the latest place from which some alternative is complete, and counts when
    that beginning has moved.  One word gives 0.1 per occurrence.
    """
    words = query.words
    if not words:
        return F.lit(0.0)
    if len(words) == 1:
        return F.size(F.filter(tokens, lambda t: t == words[0])) * F.lit(WEIGHT)
    wanted = F.array(*map(F.lit, words))
    return _density(query, F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("pos"), F.array_position(wanted, t).cast("int").alias("word"))), lambda h: h["word"] > 0))


def rank_places(query: Query, places: dict[str, Column]) -> Column:
    """``rank`` on the places of each word of the query."""
    words = query.words
    if not words:
        return F.lit(0.0)
    if len(words) == 1:
        return F.size(places[words[0]]) * F.lit(WEIGHT)

    def marked(word: str, number: int) -> Column:
        return F.transform(places[word], lambda p: F.struct(p.cast("int").alias("pos"), F.lit(number).alias("word")))

    return _density(query, F.array_sort(F.concat(*[marked(w, k + 1) for k, w in enumerate(words)])))


def _density(query: Query, hits: Column) -> Column:
    words = query.words
    hits = F.transform(hits, lambda h, k: F.struct(h["pos"].alias("pos"), h["word"].alias("word"), k.alias("nth")))
    sets = [[words.index(w) for t in g if t.wanted for w in t.words] for g in query.groups]
    sets = [s for s in sets if s]
    place = "struct<pos:int,nth:int>"
    none = F.lit(None).cast(place)

    def start(last: Column) -> Column:
        ready = [F.when(reduce(lambda a, b: a & b, [last[i].isNotNull() for i in s]), F.array_min(F.array(*[last[i] for i in s]))) for s in sets]
        return F.array_max(F.array(*ready))

    def step(acc: Column, h: Column) -> Column:
        here = F.struct(h["pos"].alias("pos"), h["nth"].alias("nth")).cast(place)
        last = F.transform(acc["last"], lambda p, i: F.when(i + 1 == h["word"], here).otherwise(p))
        return F.struct(last.alias("last"), acc["begun"].alias("begun"), acc["sum"].alias("sum"), here.alias("here"))

    def count(acc: Column) -> Column:
        s = start(acc["last"])
        fresh = s.isNotNull() & (s["pos"] > acc["begun"])
        noise = (acc["here"]["pos"] - s["pos"]) - (acc["here"]["nth"] - s["nth"])
        return F.struct(acc["last"].alias("last"), F.when(fresh, s["pos"]).otherwise(acc["begun"]).alias("begun"),
                        F.when(fresh, acc["sum"] + F.lit(WEIGHT) / (1 + noise)).otherwise(acc["sum"]).alias("sum"), acc["here"].alias("here"))

    zero = F.struct(F.array(*[none] * len(words)).alias("last"), F.lit(-1).alias("begun"), F.lit(0.0).alias("sum"), none.alias("here"))
    return F.aggregate(hits, zero, lambda acc, h: count(step(acc, h)), lambda acc: acc["sum"])
