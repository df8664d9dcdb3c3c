import random

import numpy as np
import pyarrow as pa
import pytest

from lexigrove.llm import reading as R

EASY = ["the cat sat on the mat", "we had a big red ball", "she ran to the old barn"]
HARD = ["notwithstanding the heterogeneous electrochemical perturbation, which the multivariable investigation, whose phenomenological underpinnings presuppose homogeneity, demonstrated"]


def texts(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        band = i % 5 + 1
        parts = [rng.choice(HARD if rng.random() < (band - 1) / 4 else EASY).capitalize() + "." for _ in range(12)]
        out.append((i, " ".join(parts), "en", band))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = texts(300)
    docs = [(i, t, lang, "x") for i, t, lang, _ in rows] + [(900, None, "en", "x"), (901, "", None, "x"), (902, "Too short.", "en", "x"), (903, "le la les des du une et dans est été pour sur avec " * 6, "fr", "x"), (904, "We had a big red ball. " * 5000, "en", "x"), (5, rows[5][1], "en", "x")]
    labels = [(i, f"r{k}", b, "x") for i, _, _, b in rows[:200] for k in range(2)] * 2 + [(1, "r9", None, "x"), (2, "r9", 7, "x"), (5000, "r1", 3, "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, band string"), spark.createDataFrame(labels, "doc_id long, rater string, band int, text string")


def test_held_out_texts(tables):
    docs, labels = tables
    got = {r.doc_id: r for r in R.reading_bands(docs, labels).collect()}
    held = [(i, b) for i, _, _, b in texts(300)[200:]]
    off = [abs(got[i].band - b) for i, b in held]
    assert np.mean([x <= 1 for x in off]) > 0.95
    assert all(got[i].band == 1 for i, b in held if b == 1) and all(got[i].band >= 4 for i, b in held if b == 5)
    assert [got[i].band for i in (900, 901, 902)] == [None] * 3 and got[900].words == 0
    assert not got[903].english and got[1].english and got[904].band == 1


def test_no_labels_and_no_documents(tables):
    docs, labels = tables
    with pytest.raises(ValueError):
        R.reading_bands(docs, labels.limit(0))
    with pytest.raises(ValueError):
        R.reading_bands(docs.limit(0), labels)


def test_consensus(spark):
    rows = [(1, "a", 2), (1, "a", 2), (1, "a", 4), (1, "b", 1), (2, "a", None), (3, "a", 9)]
    got = {r.doc_id: (r.band, r.raters) for r in R.consensus(spark.createDataFrame(rows, "doc_id long, rater string, band int")).collect()}
    assert got == {1: (2.0, 2)}


def test_ordinal_model():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, len(R.FEATURES)))
    level = x[:, 0] * 2 - x[:, 3] + rng.logistic(size=4000)
    y = 1 + (level[:, None] > np.array([-3, -1, 1, 3])).sum(1)
    m = R.OrdinalModel.fit(x, y.astype(float))
    w = m.weights / m.scale
    assert abs(w[0] - 2) < 0.2 and abs(w[3] + 1) < 0.15 and abs(w[5]) < 0.1
    assert np.all(np.diff(m.cuts) > 0)


def test_variety_sees_every_word():
    w = [f"w{i}" for i in range(R.WINDOW)]
    assert R._variety(w) == R._variety(w * 3) == 1
    assert R._variety(w + ["x"] * (R.WINDOW - 1)) == (1 + 2 / R.WINDOW) / 2
    assert R._variety(w + ["y"] + w[:1] + ["x"] * 2) < 1
    assert R._variety(["a", "b", "a"]) == 2 / 3 and R._variety(["a"] * R.WINDOW) == 1 / R.WINDOW


ITALIAN = "La ricerca condotta in questo studio ha permesso di valutare gli effetti della terapia sui pazienti affetti da malattie croniche, e di confrontare i risultati ottenuti con quelli riportati nella letteratura precedente, tenendo conto delle differenze tra i gruppi e della durata del trattamento. " * 2
OTHERS = {
    910: ITALIAN, 911: "研究 结果 表明 治疗 有效 " * 12, 912: "12 405 77 3.14 2020 " * 12, 913: "Tutkimuksen tulokset osoittavat, ettei hoidolla ollut vaikutusta potilaiden elämänlaatuun pitkällä aikavälillä. " * 5,
    914: "De resultaten van het onderzoek waren in de eerste groep niet beter dan die van patiënten met een andere behandeling. " * 4, 915: "... --- !!! " * 40,
}


def test_other_languages_are_not_english(tables):
    docs, labels = tables
    more = docs.sparkSession.createDataFrame([(i, t, "en", "x") for i, t in OTHERS.items()] + [(920, "Dogs run fast. Cats jump high. Birds sing songs. " * 8, "xx", "x")], docs.schema)
    got = {r.doc_id: r for r in R.reading_bands(docs.unionByName(more), labels).collect()}
    assert not any(got[i].english for i in OTHERS)
    assert all(got[i].english for i in range(300)) and got[904].english


def test_rarity_is_exact(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(vocab, weights=[1 / (k + 1) ** 2 for k in range(200)], k=rng.randint(0, 30)))) for i in range(300)] + [(3, "w1 w1 only"), (400, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    holds = {w: sum(w in (t or "").split() for _, t in rows) for w in [*vocab, "only"]}
    for most in (5, 10_000):
        got = sorted((r.doc_id, r.words, round(r.rarity, 9), round(r.unknown, 9)) for r in R.document_features(df, head_rows=most).collect())
        n = len(rows)
        want = []
        for i, t in rows:
            w = (t or "").split()
            k = max(1, len(w))
            want.append((i, len(w), round(sum(-np.log(holds[x] / n) for x in w) / k, 9), round(sum(holds[x] < n * R.KNOWN_SHARE for x in w) / k, 9)))
        assert got == sorted(want)


def test_hashed_sample(spark):
    from lexigrove.llm.sampling import hashed_sample

    df = spark.range(10_000)
    a = {r.id for r in hashed_sample(df, ["id"], 500).collect()}
    assert 350 < len(a) <= 500 and a == {r.id for r in hashed_sample(df.repartition(7), ["id"], 500).collect()}
    assert hashed_sample(df, ["id"], 20_000).count() == 10_000


def test_trigrams_of_every_english_text_are_counted(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randint(1, 6)))
    rows = [f"The {word()} of {word()}, and {word()}." for _ in range(24_000)] + ["The end of the line."] * 300 + ["le la les des", "12 of", "", None]
    counted = []
    fit = R.English.fit
    monkeypatch.setattr(R.English, "fit", staticmethod(lambda c: counted.append(c.copy()) or fit(c)))
    monkeypatch.setattr(R, "HELD", 5_000, raising=False)
    R.document_features(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(6))
    english = [t for t in rows if t and "of" in t.split()]
    want = np.bincount(np.concatenate([R.trigrams(R.letter_codes(t)) for t in english]), minlength=R.LETTERS**3)
    assert len(counted) == 1 and (counted[0] == want).all()


def test_every_graded_text_is_fitted(spark):
    rng = np.random.default_rng(2)
    n = 24_000
    x = rng.normal(size=(n, len(R.FEATURES))) * np.arange(1, len(R.FEATURES) + 1) + 5
    y = np.stack([1 + ((x[:, 0] - x[:, 3] / 4 + rng.logistic(size=n))[:, None] > np.array([0, 2, 5, 7])).sum(1) for _ in range(2)], 1)
    ids = pa.array(range(n))
    feats = spark.createDataFrame(pa.table({"doc_id": ids, "words": pa.array([R.LEAST_WORDS] * n)} | {f: x[:, i] for i, f in enumerate(R.FEATURES)}))
    labels = spark.createDataFrame(pa.table({"doc_id": pa.concat_arrays([ids, ids]), "rater": ["a"] * n + ["b"] * n, "band": np.concatenate([y[:, 0], y[:, 1]])}))
    short = feats.limit(50).selectExpr("doc_id", "0L AS words", *[f"1e6 AS {f}" for f in R.FEATURES])
    got, want = R.fit_model(feats.unionByName(short), labels), R.OrdinalModel.fit(x, y.mean(1))
    for a, b in ((got.mean, want.mean), (got.scale, want.scale), (got.weights, want.weights), (got.cuts, want.cuts)):
        assert np.allclose(a, b, rtol=1e-7, atol=1e-7)
