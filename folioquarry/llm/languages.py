"""Problem 2: languages of documents and of stretches of mixed text (linear-chain CRF).

Words carry hashed affix, n-gram and lexicon features (with and without
accents); a learned transition matrix couples neighbours, and forward-backward
gives each word a distribution over languages.  Words gather into units (a
sentence, a quoted sentence, a running line), units of one language into
stretches with a confidence.

The model is fitted here, on a bounded sample of labelled documents
(``sample_docs``), once per session and table.  Their labels are only a start:
sentences with clear common words are labelled by those, and all labels are
re-estimated by a word model until they agree with the words.  Everything else
runs over all rows and whole texts.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookalikes import CYRILLIC, CYRILLIC_AS, GREEK, GREEK_AS, INVISIBLE

LANGUAGES = ("en", "fi", "sv", "da", "de", "fr")
BUCKETS = 1 << 17
#: Words that make a line running text; a sentence with capital and full stop may be shorter.
MIN_WORDS = 5
SHORT_SENTENCE = 2
_MARKS = "̀-ͯ­​-‏⁠﻿"
#: A word, or one character that ends a unit.
TOKEN = re.compile(rf"(?<![\w/+=])(?:[^\W\d_]|[{_MARKS}])+(?![\w/+=])|[\n\r\f|;“”„\"«»()\[\]]|[.!?](?=[\s\"”»)\]]|$)")
_LOOKS = str.maketrans(GREEK + CYRILLIC, GREEK_AS + CYRILLIC_AS, INVISIBLE)


# Common words of each language, as lexicon features; their weights are learned.
LEXICON = {
    "en": "a about above all an and answer any are as at be been below between but by can could do each following follows for from had has have he her his how if in into is it its may more most must no not of on one only or other our out over read says she should so some such than that the their them then there these they this those through to under up use using was we were what when where which who why will with would you your",
    "fi": "aina alla ei eivät eli ennen ensin entä että hän he ilman itse ja jo joita joka jokin jonka jos jota jotka joten kaikki kanssa koko koska kuin kuinka kun kunnes kuten kyllä lisäksi lue me mikä mitä mukaan mutta muu myös myöten ne niin noin nyt oli olivat olla olisi on ovat samoin se sekä sen siitä silloin sitten sitä tai te tämä tämän tästä vain vasta vaikka vielä vuoksi yhden yksi älä",
    "sv": "alla allt att av bara bli blir blivit de dem den denna deras dess det detta dig din du där då efter eller en enligt er ett finns från få för förr genom ha hade han har hon hur här i icke in inga ingen inte jag kan kunde man med mellan men mig min mot mycket ned nedan när något några nu och om oss på samma sedan sig sin ska skulle som till under upp ut utan vad var vara varje vi vid vilken vår än är även över",
    "da": "ad af alle alt at bare blev blive bliver da de dem den denne der deres det dette dig din disse du efter eller en end er et efterfølgende for fordi fra få før gennem ham han har havde hende her hun hvad hver hvis hvor i igen ikke ind ingen jeg kan kunne lige man mange med meget mellem men mig min mod må ned nedenfor nogen noget nogle nu når og også om op os over på samme selv sig sin skal skulle som til ud uden under var ved vi vil være",
    "de": "aber alle allem als also am an auch auf aus bei bin bis bitte da damit dann das dass dem den denn der des dich die dies diese dieser doch dort du durch ein eine einem einen einer eines er es folgenden für gegen hat hatte ich ihm ihn ihr im in ist ja jede jeder kann kein keine können lesen man mit muss nach nicht noch nun nur ob oder ohne sehr sein seine sich sie sind so über um und uns unter unten vom von vor war was weil welche wenn werden wie wird wir wo wurde zu zum zur zwischen",
    "fr": "a afin ainsi alors après au aucun aussi autre aux avant avec avoir car ce cela ces cet cette chaque ci comme contre d dans de depuis des donc du elle elles en encore entre est et eux fait font il ils je jusqu l la le les leur lisez lui mais même moins ne ni non nos notre nous on ont ou où par pas pendant peu peut plus pour puis qu quand que quel quelle qui répondez s sa sans se ses si son sont sous sur tous tout toute très un une vos votre vous y à été être",
}
_LEXED = {lang: frozenset(words.split()) for lang, words in LEXICON.items()}


def normal_word(word: str) -> str:
    if word.isascii():
        return word.lower()
    return unicodedata.normalize("NFC", word.translate(_LOOKS)).lower()


def _bare(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).replace("æ", "ae").replace("ø", "o").replace("ß", "ss")


_BARE = {lang: frozenset(map(_bare, words)) for lang, words in _LEXED.items()}


def features(word: str) -> list[int]:
    """Hashed feature ids of one normal word."""
    names = ["w" + word]
    bare = word if word.isascii() else _bare(word)
    names.append("b" + bare)
    names += ["l" + lang for lang, words in _LEXED.items() if word in words or bare in _BARE[lang]]
    names += [f"p{word[:k]}" for k in (1, 2, 3, 4) if len(word) >= k] + [f"s{word[-k:]}" for k in (1, 2, 3, 4) if len(word) >= k]
    for tag, form in (("n", word), ("m", bare)):
        edged = f"^{form}$"
        for k in (2, 3, 4):
            names += [tag + edged[i : i + k] for i in range(len(edged) - k + 1)]
    return [zlib.crc32(x.encode()) % BUCKETS for x in names]


def label_of(lang: Column) -> Column:
    """The language a stored label stands for; null for a null, empty or placeholder label."""
    base = F.lower(F.regexp_extract(F.trim(lang), "^([A-Za-z]{2})(?:[-_].*)?$", 1))
    return F.when(base.isin(*LANGUAGES), base)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # BUCKETS x languages
    moves: np.ndarray  # languages x languages
    start: np.ndarray

    def emission(self, word: str) -> np.ndarray:
        return self.weights[features(word)].sum(0)


def forward_backward(emit: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Marginals of padded sequences ``emit`` (B, T, L); with ``pairs`` also the expected transitions and log Z."""
    b, t, _ = emit.shape
    e = np.exp(emit - emit.max(2, keepdims=True))
    m = np.exp(moves)
    alpha = np.empty_like(e)
    scale = np.ones((b, t), e.dtype)
    a = np.exp(start) * e[:, 0]
    scale[:, 0] = a.sum(1)
    alpha[:, 0] = a / scale[:, :1]
    for i in range(1, t):
        a = (alpha[:, i - 1] @ m) * e[:, i]
        s = a.sum(1)
        scale[:, i] = s
        alpha[:, i] = a / s[:, None]
    beta = np.ones_like(e)
    live = np.arange(t)[None, :] < lengths[:, None]
    expected = np.zeros_like(moves) if pairs else None
    for i in range(t - 2, -1, -1):
        x = e[:, i + 1] * beta[:, i + 1] / scale[:, i + 1, None]
        on = live[:, i + 1]
        if pairs:
            expected += (np.where(on[:, None], alpha[:, i], 0).T @ x) * m
        beta[:, i] = np.where(on[:, None], x @ m.T, 1.0)
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    if not pairs:
        return gamma
    log_z = (np.where(live, np.log(scale) + emit.max(2), 0)).sum()
    return gamma, expected, log_z


def _sentences(text: str) -> list[list[str]]:
    out, cur = [], []
    for tok in TOKEN.findall(text):
        if len(tok) == 1 and not tok.isalpha():
            if cur:
                out.append(cur)
            cur = []
        else:
            cur.append(normal_word(tok))
    if cur:
        out.append(cur)
    return out


def _votes(sentence: list[str]) -> np.ndarray:
    """Per language the common words of it in the sentence, with or without their accents."""
    return np.array([sum(w in _LEXED[lang] or w in _BARE[lang] for w in sentence) for lang in LANGUAGES])


def _settle(sentences: list[list[str]], labels: np.ndarray, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Sentence labels re-estimated by a word model, and their margins.

    The start is the language that leads by two or more common words, else the
    document's label: a line that stands in documents of other languages only
    would confirm itself with their label for ever.
    """
    votes = np.array([_votes(s) for s in sentences])
    ranked = np.sort(votes, 1)
    labels = np.where(ranked[:, -1] - ranked[:, -2] >= 2, votes.argmax(1), labels)
    vocab: dict[str, int] = {}
    flat = np.array([vocab.setdefault(_bare(w), len(vocab)) for s in sentences for w in s])
    at = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
    n = len(LANGUAGES)
    margin = np.zeros(len(sentences))
    for _ in range(rounds):
        counts = np.zeros((len(vocab), n))
        np.add.at(counts, (flat, labels[at]), 1.0)
        prob = np.log((counts + 0.05) / (counts.sum(0) + 0.05 * len(vocab)))
        score = np.zeros((len(sentences), n))
        np.add.at(score, at, prob[flat])
        new = score.argmax(1)
        top = np.sort(score, 1)
        margin = top[:, -1] - top[:, -2]
        if (new == labels).all():
            break
        labels = new
    return labels, margin


def fit(texts: list[str], labels: list[str], epochs: int = 40, seed: int = 3, max_words: int = 400_000) -> Model:
    """Fit the CRF by full-batch adaptive gradient ascent on natural and recombined sentence sequences.

    ``max_words`` bounds the words fitted on, as ``sample_docs`` bounds the documents.
    """
    rng = random.Random(seed)
    sents, first, words = [], [], 0
    for text, label in zip(texts, labels):
        for s in _sentences(text):
            if len(s) >= MIN_WORDS and words < max_words:
                sents.append(s)
                first.append(LANGUAGES.index(label))
                words += len(s)
    n = len(LANGUAGES)
    if not sents:
        return Model(np.zeros((BUCKETS, n), np.float32), np.zeros((n, n)), np.zeros(n))
    settled, margin = _settle(sents, np.array(first))
    good = [i for i in range(len(sents)) if margin[i] > 3.0]
    by_lang = [[i for i in good if settled[i] == k] for k in range(n)]
    have = [k for k in range(n) if by_lang[k]]
    sequences: list[tuple[list[str], list[int]]] = []

    def add(ids: list[int], bare: bool) -> None:
        ws = [(_bare(w) if bare else w) for i in ids for w in sents[i]]
        sequences.append((ws, [int(settled[i]) for i in ids for _ in sents[i]]))

    for a, b, c in zip(good[::3], good[1::3], good[2::3]):
        add([a, b, c], rng.random() < 0.3)
    for _ in range(len(good) // 4):  # code-switched, all languages alike
        add([rng.choice(by_lang[rng.choice(have)]) for _ in range(3)], rng.random() < 0.3)
    vocab: dict[str, int] = {}
    coded = [np.array([vocab.setdefault(w, len(vocab)) for w in ws]) for ws, _ in sequences]
    feats = [features(w) for w in vocab]
    flat = np.array([f for fs in feats for f in fs])
    used, flat = np.unique(flat, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum([len(f) for f in feats])[:-1]])
    owner = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    order = np.argsort([len(c) for c in coded], kind="stable")
    batches = []
    for lo in range(0, len(order), 1024):
        ids = order[lo : lo + 1024]
        lens = np.array([len(coded[i]) for i in ids])
        x = np.zeros((len(ids), lens.max()), np.int64)
        y = np.full(x.shape, -1)
        for r, i in enumerate(ids):
            x[r, : lens[r]] = coded[i]
            y[r, : lens[r]] = sequences[i][1]
        batches.append((x, y, lens))
    w = np.zeros((len(used), n))
    moves, start = np.zeros((n, n)), np.zeros(n)
    sums = [np.full_like(p, 1e-8) for p in (w, moves, start)]
    total = sum(len(c) for c in coded)
    for _ in range(epochs):
        table = np.add.reduceat(w[flat], starts)
        g_word, g_moves, g_start = np.zeros((len(vocab), n)), np.zeros((n, n)), np.zeros(n)
        for x, y, lens in batches:
            gamma, expected, _ = forward_backward(table[x], lens, moves, start, pairs=True)
            live = y >= 0
            diff = -gamma
            r, c = np.nonzero(live)
            diff[r, c, y[r, c]] += 1
            diff[~live] = 0
            for k in range(n):
                g_word[:, k] += np.bincount(x.ravel(), diff[:, :, k].ravel(), minlength=len(vocab))
            seen = live[:, 1:]
            np.add.at(g_moves, (y[:, :-1][seen], y[:, 1:][seen]), 1.0)
            g_moves -= expected
            g_start += diff[:, 0].sum(0)
        g_feat = np.stack([np.bincount(flat, g_word[owner, k], minlength=len(used)) for k in range(n)], 1)
        grads = (g_feat / total * 100 - 5e-3 * w, g_moves / total * 100 - 1e-3 * moves, g_start / total * 100)
        for p, g, s in zip((w, moves, start), grads, sums):
            s += g * g
            p += 0.15 * g / np.sqrt(s)
    weights = np.zeros((BUCKETS, n), np.float32)
    weights[used] = w
    return Model(weights, moves.astype(np.float32), start.astype(np.float32))


_FITTED: dict[tuple, Model] = {}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 1_500) -> Model:
    """Fit on at most ``sample_docs`` labelled documents, chosen by a hash of the id (the same at any size of the table).

    Only rows below a hash threshold, about one and a half times the sample,
    leave the tasks, however many tasks there are.  Of copies of one text one is
    used.  A table is fitted on once per session.
    """
    key = (docs.sparkSession.sparkContext.applicationId, docs.semanticHash(), id_col, text_col, lang_col, sample_docs)
    if key not in _FITTED:
        label = label_of(F.col(lang_col))
        n = docs.where(label.isNotNull()).count()
        near = F.pmod(F.xxhash64(id_col), F.lit(1 << 32))
        bound = (1 << 32) if n <= 2 * sample_docs else int((1 << 32) * (1.5 * sample_docs + 100) / n)
        few = docs.where(label.isNotNull() & (near < bound) & F.col(text_col).isNotNull()).groupBy(F.xxhash64(text_col).alias("t")).agg(
            F.min(F.struct(near.alias("h"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), label.alias("label"))).alias("d"))
        chosen = few.orderBy("d.h", "d.id").limit(sample_docs).select("d.text", "d.label").collect()
        _FITTED[key] = fit([r["text"] for r in chosen], [r["label"] for r in chosen])
    return _FITTED[key]


def _runs(mass: np.ndarray) -> list[tuple[int, int]]:
    """Parts of a unit in one language each, from its words' distributions: cut where that explains at least four words more."""
    n = len(mass)
    if n < 2 * MIN_WORDS:
        return [(0, n)]
    sums = np.concatenate([np.zeros((1, mass.shape[1])), np.cumsum(mass, 0)])
    cuts = np.arange(MIN_WORDS, n - MIN_WORDS + 1)
    left, right = sums[cuts], sums[n] - sums[cuts]
    gain = left.max(1) + right.max(1)
    at = int(gain.argmax())
    if gain[at] - sums[n].max() < 4 or left[at].max() < 0.6 * cuts[at] or right[at].max() < 0.6 * (n - cuts[at]):
        return [(0, n)]
    cut = int(cuts[at])
    return _runs(mass[:cut]) + [(a + cut, b + cut) for a, b in _runs(mass[cut:])]


def _tag_batch(texts: list[str | None], emit_of, table: list, cache: dict, model: Model) -> list[list[tuple]]:
    """Stretches ``(begin, end, language, confidence, words, whole)`` of each text."""
    words_of, units_of, spans_of, closed_of = [], [], [], []
    for text in texts:
        ids, ends, spans, closed = [], [], [], []
        begin = None
        for m in TOKEN.finditer(text or ""):
            tok = m.group()
            if len(tok) == 1 and not tok.isalpha():
                if begin is not None:
                    ends.append(len(ids))
                    spans.append(places)
                    closed.append(tok in ".!?" and text[begin].isupper())
                    begin = None
                continue
            k = cache.get(tok)
            if k is None:
                k = emit_of(tok)
            ids.append(k)
            if begin is None:
                begin, places = m.start(), []
            places.append((m.start(), m.end()))
        if begin is not None:
            ends.append(len(ids))
            spans.append(places)
            closed.append(False)
        words_of.append(ids)
        closed_of.append(closed)
        units_of.append(ends)
        spans_of.append(spans)
    emission = np.asarray(table, np.float32)
    out: list[list[tuple]] = [[] for _ in texts]
    order = sorted((i for i in range(len(texts)) if words_of[i]), key=lambda i: len(words_of[i]))
    at = 0
    while at < len(order):
        ids = order[at : at + 512]
        while len(ids) > 1 and len(ids) * len(words_of[ids[-1]]) > 400_000:  # padded size, not a cap: the rest follows
            ids = ids[: len(ids) // 2]
        at += len(ids)
        lens = np.array([len(words_of[i]) for i in ids])
        x = np.zeros((len(ids), lens.max()), np.int64)
        for r, i in enumerate(ids):
            x[r, : lens[r]] = words_of[i]
        gamma = forward_backward(emission[x], lens, model.moves, model.start)
        for r, i in enumerate(ids):
            ends = np.array(units_of[i])
            starts = np.concatenate([[0], ends[:-1]])
            n = ends - starts
            mass = np.add.reduceat(gamma[r, : lens[r]], starts)
            spans = [(p[0][0], p[-1][1]) for p in spans_of[i]]
            closed = closed_of[i]
            mixed = (n >= 2 * MIN_WORDS) & (mass.max(1) < n - 4)
            if mixed.any():  # a unit that goes on in another language is as many units
                parts = [(u, a, b) for u in range(len(n)) for a, b in (_runs(gamma[r, starts[u] : ends[u]]) if mixed[u] else [(0, n[u])])]
                spans = [(spans_of[i][u][a][0], spans_of[i][u][b - 1][1]) for u, a, b in parts]
                closed = [closed[u] for u, _, _ in parts]
                n = np.array([b - a for _, a, b in parts])
                mass = np.add.reduceat(gamma[r, : lens[r]], np.array([starts[u] + a for u, a, _ in parts]))
            best = mass.argmax(1)
            conf = mass[np.arange(len(best)), best]
            # a stretch: neighbouring units of one language; a scrap in between goes with the stretch it stands in
            rows = out[i]
            for (b, e), k, c, w, v, end in zip(spans, best.tolist(), conf.tolist(), n.tolist(), mass.tolist(), closed):
                whole = c >= 0.6 * w if w >= MIN_WORDS else end and w >= SHORT_SENTENCE and c >= 0.8 * w
                if rows and (rows[-1][2] == k or not whole):
                    p = rows[-1]
                    rows[-1] = (p[0], e, p[2], p[3] + v[p[2]], p[4] + w, p[5] or (whole and k == p[2]))
                elif rows and not rows[-1][5]:
                    p = rows[-1]
                    rows[-1] = (p[0], e, k, v[k] + p[3], p[4] + w, whole)
                else:
                    rows.append((b, e, k, c, w, whole))
    return [[(b, e, LANGUAGES[k], c / w, w, whole) for b, e, k, c, w, whole in rows] for rows in out]


def stretches(texts: DataFrame, model: Model, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *keep, stretch, begin, stop, lang, confidence, words, whole)``: one row per stretch in one language.

    ``whole`` tells whether it holds a running line of at least five words or a
    whole sentence, with capital and end mark, of at least two.  A text without words (null, empty, codes, numbers) gives
    one row with null language.  Texts of any length are read whole; repeated
    rows are tagged alike.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)  # weights: BUCKETS x languages, a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table: list[np.ndarray] = []
        cache: dict[str, int] = {}

        def emit_of(tok: str) -> int:
            table.append(model.emission(normal_word(tok)))
            cache[tok] = len(table) - 1
            return len(table) - 1

        for big in batches:
            for lo in range(0, big.num_rows, 1000):
                batch = big.slice(lo, 1000)
                if len(table) > 1_000_000:  # memory only; emissions are recomputed
                    table.clear()
                    cache.clear()
                rows, cols = [], [[] for _ in range(7)]
                for i, found in enumerate(_tag_batch(batch.column("text").to_pylist(), emit_of, table, cache, model)):
                    for j, s in enumerate(found or [(None, None, None, None, 0, False)]):
                        rows.append(i)
                        for c, v in zip(cols, (j, *s)):
                            c.append(v)
                head = batch.drop_columns(["text"]).take(pa.array(rows, pa.int64()))
                types = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([*head.columns, *(pa.array(c, t) for c, t in zip(cols, types))], names=[*head.schema.names, "stretch", "begin", "stop", "lang", "confidence", "words", "whole"])

    src = texts.select(F.col(id_col).cast("long").alias("id"), *keep, F.col(text_col).alias("text"))
    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in src.schema if f.name in keep)
    return src.mapInArrow(run, f"id long{extra}, stretch int, begin int, stop int, lang string, confidence double, words int, whole boolean")


def document_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang, confidence, languages)``: the language of most words, its share of sure words, and all languages of whole sentences.

    Null language and no languages for a text without words.
    """
    s = stretches(docs, model, id_col, text_col)
    per = s.groupBy("id", "lang").agg(F.sum(F.col("confidence") * F.col("words")).alias("mass"), F.sum("words").alias("n"), F.max("whole").alias("whole"))
    top = per.groupBy("id").agg(F.max_by("lang", F.struct(F.coalesce("mass", F.lit(0.0)), "lang")).alias("lang"), F.max(F.coalesce("mass", F.lit(0.0))).alias("mass"), F.sum("n").alias("n"),
                                F.array_sort(F.collect_set(F.when(F.col("whole"), F.col("lang")))).alias("languages"))
    return top.select("id", "lang", F.when(F.col("n") > 0, F.col("mass") / F.col("n")).alias("confidence"), "languages")


def mislabelled_chunks(chunks: DataFrame, docs: DataFrame, model: Model) -> DataFrame:
    """``(chunk_id, lang)``: languages of chunks whose set of languages is not exactly what the document's label says."""
    s = stretches(chunks, model, "id", "content", keep=("document_id",)).where("whole")
    sets = s.groupBy("id", "document_id").agg(F.collect_set("lang").alias("langs"))  # at most the known languages
    labels = docs.select(F.col("doc_id").alias("document_id"), label_of(F.col("lang")).alias("label"))
    wrong = (F.size("langs") > 1) | F.col("label").isNull() | (F.element_at("langs", 1) != F.col("label"))
    return sets.join(labels, "document_id", "left").where(wrong).select(F.col("id").alias("chunk_id"), F.explode("langs").alias("lang"))
