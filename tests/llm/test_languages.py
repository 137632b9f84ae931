import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioquarry.llm import languages
from folioquarry.runtime import table


def test_forward_backward():
    rng = np.random.default_rng(0)
    emit, moves, start = rng.standard_normal((2, 4, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3)
    lens = np.array([4, 2])
    gamma, expected, log_z = languages.forward_backward(emit, lens, moves, start, pairs=True)
    total, pairs = 0.0, np.zeros((3, 3))
    for b, n in enumerate(lens):
        score = {p: start[p[0]] + sum(emit[b, i, p[i]] for i in range(n)) + sum(moves[p[i], p[i + 1]] for i in range(n - 1)) for p in itertools.product(range(3), repeat=int(n))}
        z = np.log(sum(np.exp(list(score.values()))))
        total += z
        for p, s in score.items():
            w = np.exp(s - z)
            for i in range(n - 1):
                pairs[p[i], p[i + 1]] += w
        for i in range(n):
            want = [sum(np.exp(s - z) for p, s in score.items() if p[i] == k) for k in range(3)]
            assert np.allclose(gamma[b, i], want)
    assert np.allclose(expected, pairs) and log_z == pytest.approx(total)


def test_labels(spark):
    rows = ["fi", "FI", "fi-FI", "fi ", "en_GB", "und", "??", "", None, "es", "finnish"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, l string").select("i", languages.label_of(F.col("l")).alias("l"))
    assert [r["l"] for r in sorted(df.collect(), key=lambda r: r["i"])] == ["fi", "fi", "fi", "fi", "en", None, None, None, None, None, None]


@pytest.fixture(scope="module")
def model(spark, small):
    return languages.train(table(spark, small.replace("sf0.001", "sf0.01"), "documents"), sample_docs=400)


def test_stretches(spark, model):
    fi = "Hallitus päätti, että lämmitysventtiili uusitaan viime tiistaina ja työ maksaa 5551 euroa."
    sv = "En varningston anger att pannluckan har stått öppen i 17 minuter."
    en = "Press and hold the button for 47 seconds until the boiler lid starts to blink."
    rows = [(1, fi, "c", 1), (2, f"{fi}\n\n{sv}", "c", 1), (3, f"{en} “{sv}” {en}", "c", 1), (4, None, "c", 1), (5, "", "c", 1), (6, "P: 362.4 | Q: 368.1", "c", 1), (7, fi.upper().replace("Ä", "A").replace("Ö", "O"), "c", 1), (1, fi, "c", 1), (8, f"2.6 Budget\n{fi} (Safety notes)", "c", 1)]
    df = spark.createDataFrame(rows, "id long, content string, lang string, words int")
    got = {}
    for r in languages.stretches(df, model, "id", "content").collect():
        got.setdefault(r["id"], []).append(r)
        assert r["lang"] is None or 0 < r["confidence"] <= 1
    whole = {k: [r["lang"] for r in sorted(v, key=lambda r: r["stretch"]) if r["whole"]] for k, v in got.items()}
    assert set(whole[1]) == {"fi"} and len(whole[1]) == 2 and whole[2] == ["fi", "sv"] and whole[3] == ["en", "sv", "en"]
    assert whole[4] == whole[5] == whole[6] == [] and whole[7] == ["fi"] and whole[8] == ["fi"]
    s = got[2][0]
    assert rows[1][1][s["begin"] : s["stop"]].startswith("Hallitus")


def test_documents_and_chunks(spark, model):
    fi = "Hallitus päätti, että lämmitysventtiili uusitaan viime tiistaina ja työ maksaa 5551 euroa."
    docs = spark.createDataFrame([(1, fi, "fi-FI"), (2, fi, "en"), (3, None, None)], "doc_id long, text string, lang string")
    d = {r["id"]: r for r in languages.document_languages(docs, model).collect()}
    assert d[1]["lang"] == "fi" and d[1]["languages"] == ["fi"] and d[3]["lang"] is None and d[3]["confidence"] is None
    chunks = spark.createDataFrame([(10, 1, fi), (20, 2, fi), (30, 3, fi), (40, 99, fi), (50, 2, "---")], "id long, document_id long, content string")
    got = {(r["chunk_id"], r["lang"]) for r in languages.mislabelled_chunks(chunks, docs, model).collect()}
    assert got == {(20, "fi"), (30, "fi"), (40, "fi")}


def test_held_out(spark, small, model):
    """Documents outside the sample, judged by their clean labels."""
    docs = table(spark, small, "documents")
    labelled = docs.select("doc_id", "text", languages.label_of(F.col("lang")).alias("label")).where("label IS NOT NULL AND length(text) > 200")
    found = languages.document_languages(labelled, model)
    rows = found.join(labelled, F.col("id") == F.col("doc_id")).select("lang", "label").collect()
    assert np.mean([r["lang"] == r["label"] for r in rows]) > 0.8  # about a tenth of the labels are wrong


def test_no_labels(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    m = languages.train(docs)
    chunks = spark.createDataFrame([], "id long, document_id long, content string")
    assert languages.mislabelled_chunks(chunks, docs, m).collect() == []


def found(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    out = {i: [] for i in range(len(texts))}
    for r in languages.stretches(df, model, "id", "content").orderBy("id", "stretch").collect():
        out[r["id"]].append(r)
    return out


def test_language_changes_within_a_line(spark, model):
    sv = "Man kom överens om att begära 98 offerter och återkomma till frågan inom två månader"
    en = "the board decided that the boiler lid will be replaced next spring at a cost of"
    fi = "Paina painiketta 94 sekunnin ajan, kunnes vesimittari alkaa vilkkua"
    texts = [f"{en} {sv}.", f"{fi} {sv} {en}.", sv, f"Der Vorstand prüft die Software Release Candidate und den Bericht im nächsten Frühjahr noch einmal."]
    got = found(spark, model, texts)
    langs = {i: [r["lang"] for r in rows if r["whole"]] for i, rows in got.items()}
    assert langs == {0: ["en", "sv"], 1: ["fi", "sv", "en"], 2: ["sv"], 3: ["de"]}
    a, b = got[0]
    assert abs(b["begin"] - len(en)) <= 6 and texts[0][b["begin"] : b["stop"]].endswith("månader")


def test_runs():
    two = np.repeat(np.eye(3)[[0, 2]], [7, 9], axis=0)
    assert languages._runs(two) == [(0, 7), (7, 16)] and languages._runs(two[:9]) == [(0, 9)] and languages._runs(two[2:12]) == [(0, 5), (5, 10)]
    assert languages._runs(np.full((30, 3), 1 / 3)) == [(0, 30)]


def test_short_sentences_count_and_headings_do_not(spark, model):
    long = "Hallitus päätti, että lämmitysventtiili uusitaan viime tiistaina ja työ maksaa 5551 euroa."
    texts = [f"{long}\nThe board decided.\n{long}", f"{long}\nSafety notes\n{long}", f"{long} Ystrava.\n{long}"]
    got = {i: {r["lang"] for r in rows if r["whole"]} for i, rows in found(spark, model, texts).items()}
    assert got == {0: {"fi", "en"}, 1: {"fi"}, 2: {"fi"}}


def test_a_line_filed_under_a_wrong_label_only(spark):
    """An English line that stands in Danish documents alone is not learned as Danish."""
    da = "Bestyrelsen besluttede, at udeføleren skal udskiftes i efteråret, og at det koster {} euro."
    en = "The board decided that the door opener will be replaced next spring at a cost of {} euros."
    line = "Using only the excerpt from the manual, say which statement is correct."
    docs = [(i, (da if i % 2 else en).format(i) + " " + (da if i % 2 else en).format(i + 7) + ("\n" + line if i % 2 else ""), "da" if i % 2 else "en") for i in range(60)]
    m = languages.fit([t for _, t, _ in docs], [x for _, _, x in docs])
    assert [r["lang"] for r in found(spark, m, [line])[0]] == ["en"]


def test_sample_is_bounded_and_fitted_once(spark, monkeypatch):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id % 3000) AS text", "'EN' AS lang", "1 AS n")
    seen = []
    monkeypatch.setattr(languages, "fit", lambda texts, labels: seen.append((texts, labels)) or "model")
    assert languages.train(docs, sample_docs=50) == languages.train(docs, sample_docs=50) == "model"
    assert len(seen) == 1 and len(seen[0][0]) == len(set(seen[0][0])) == 50 and set(seen[0][1]) == {"en"}


# sentences that stand nowhere in the test tables
OWN = {
    "en": "Yesterday evening the neighbours noticed that water was dripping from the ceiling of the kitchen and they called a plumber who arrived within an hour with his tools",
    "fi": "Eilen illalla naapurit huomasivat, että keittiön katosta tippui vettä, ja he soittivat putkimiehelle, joka saapui tunnin sisällä työkalujensa kanssa",
    "sv": "Igår kväll märkte grannarna att det droppade vatten från taket i köket och de ringde en rörmokare som kom inom en timme med sina verktyg",
    "da": "I går aftes opdagede naboerne, at der dryppede vand fra loftet i køkkenet, og de ringede til en blikkenslager, som kom inden for en time med sit værktøj",
    "de": "Gestern Abend bemerkten die Nachbarn, dass Wasser von der Decke der Küche tropfte, und sie riefen einen Klempner, der innerhalb einer Stunde mit seinem Werkzeug kam",
    "fr": "Hier soir les voisins ont remarqué que de l'eau gouttait du plafond de la cuisine et ils ont appelé un plombier qui est arrivé dans l'heure avec ses outils",
}


def test_confidence_says_how_often_it_is_right(spark, model):
    texts, want = [], []
    for lang, sentence in OWN.items():
        words = sentence.split()
        for size in (5, 8, 12):
            for at in range(0, len(words) - size + 1):
                texts.append(" ".join(words[at : at + size]))
                want.append(lang)
    got = found(spark, model, texts)
    right = np.array([got[i][0]["lang"] == want[i] for i in range(len(texts))])
    sure = np.array([got[i][0]["confidence"] for i in range(len(texts))])
    assert right.mean() > 0.9 and right[sure > 0.9].mean() > 0.97
    assert -0.05 < right.mean() - sure.mean() < 0.2 and sure[right].mean() > sure[~right].mean() + 0.1
