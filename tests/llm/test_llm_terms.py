from collections import Counter
from math import exp, factorial, log

import numpy as np
import pyarrow as pa
import pytest

from lexigrove.functions.text import tokenize
from lexigrove.llm import distinctive as D
from lexigrove.llm import frequency as Q

ROWS = [
    (1, "alpha beta beta the", 0), (2, "alpha gamma", 0), (3, None, 0), (4, "", 0), (5, "alpha beta " + "delta " * 5000, 0), (5, "alpha ﬁne ａlpha", 0), (6, "the of", 0), (7, "zz yy", 0), (8, "zz yy", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, term int").repartition(3)


def test_counts(docs):
    occ, df = Counter(), Counter()
    for _, t, _ in ROWS:
        occ.update(tokenize(t))
        df.update(set(tokenize(t)))
    got = {r.term: (r.occurrences, r.documents) for r in Q.term_counts(docs).collect()}
    assert got == {t: (occ[t], df[t]) for t in occ}


def test_small_tables_of_partial_counts(docs, monkeypatch):
    want = {tuple(r) for r in Q.term_counts(docs).collect()}
    monkeypatch.setattr(Q, "FLUSH", 1)
    assert {tuple(r) for r in Q.term_counts(docs).collect()} == want


def test_marks(docs):
    marks = {r.token: r.mark for r in Q.marked_terms(docs, common_share=0.4).collect()}
    assert marks["alpha"] == "common" and marks["gamma"] == "rare" and "the" not in marks
    assert Q.marked_terms(docs.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.001, 0.3, 1.0])
def test_most_weighted(docs, share):
    n = len(ROWS)
    df = Counter(t for _, x, _ in ROWS for t in set(tokenize(x)))
    want = []
    for i, x, _ in ROWS:
        c = Counter(t for t in tokenize(x) if df[t] >= 2)
        if c:
            want.append((i, min(c, key=lambda t: (-round(c[t] * log(n / df[t]), 6), t))))
    got = [tuple(r)[:2] for r in D.Scores(docs, head_share=share).most_weighted().collect()]
    assert {g for g in got if g[0] != 5} == {w for w in want if w[0] != 5}
    rows = {(r.doc_id, r.token): (r.tf, r.df) for r in D.Scores(docs, head_share=share).all().collect()}
    assert rows[1, "beta"] == (2, 2) and rows[5, "delta"] == (5000, 1)


def test_empty(docs):
    s = D.Scores(docs.limit(0))
    assert s.all().count() == 0 and s.most_weighted().count() == 0


def test_mixture_recovers_its_parts():
    rng = np.random.default_rng(0)
    n, share, hi, lo = 20_000, 0.2, 6.0, 0.3
    k = np.where(rng.random(n) < share, rng.poisson(hi, n), rng.poisson(lo, n))
    tf = np.arange(1, k.max() + 1)
    h = np.array([(k == x).sum() for x in tf], float)
    alpha, beta = D.fit(tf[h > 0].astype(float), h[h > 0], np.array([0]), n, 300)
    pois = lambda m, x: exp(-m) * m**x / factorial(x)
    for x in (1, 2, 3, 5):
        true = share * pois(hi, x) / (share * pois(hi, x) + (1 - share) * pois(lo, x))
        assert abs(1 / (1 + exp(-(alpha[0] + beta[0] * x))) - true) < 0.05


def test_elite_rises_with_count(docs):
    rows = D.Scores(docs).all().where("token = 'beta'").collect()
    by = {r.tf: r.elite for r in rows}
    assert 0 <= by[1] < by[2] <= 1


SLOW = [{1: 196, 2: 14, 3: 1}, {1: 232, 2: 14, 3: 1}, {1: 30, 2: 9, 3: 2, 7: 1}, {1: 60}]


def test_fit_is_that_of_a_long_run():
    total = 10_000
    tf, n = (np.array(x, float) for x in zip(*[i for h in SLOW for i in h.items()], strict=True))
    start = np.cumsum([0] + [len(h) for h in SLOW])[:-1]
    alpha, beta = D.fit(tf, n, start, total)
    for k, h in enumerate(SLOW):
        x, c = np.array([0, *h], float), np.array([total - sum(h.values()), *h.values()], float)
        mean = (x * c).sum() / total
        pi, hi, lo = c[1:].sum() / total / 2, (x * c).sum() / c[1:].sum() + 0.5, mean / 2
        for _ in range(30_000):
            z = 1 / (1 + (1 - pi) / pi * np.exp(hi - lo - x * np.log(hi / lo)))
            pi, lo, hi = (c * z).sum() / total, max((c * (1 - z) * x).sum() / (c * (1 - z)).sum(), 1e-30), (c * z * x).sum() / (c * z).sum()
        assert 1 / (1 + np.exp(-(alpha[k] + beta[k] * x[1:]))) == pytest.approx(z[1:], abs=1e-3), h


def test_unsettled_fit_is_marked():
    h = np.array([470.0, 16.0])
    assert np.isnan(D.fit(np.array([1.0, 2.0]), h, np.array([0]), 10_000, D.PLAIN + 1)[0][0])


def test_head_is_bounded(docs):
    want = {tuple(r) for r in D.Scores(docs).all().collect()}
    s = D.Scores(docs, head_share=0.0, head_rows=1)
    assert s.least > 2 and s.models.where(D.F.col("df") >= s.least).count() <= 1
    assert {tuple(r) for r in s.all().collect()} == want


def test_heaviest_terms_carry_their_posterior(docs):
    s = D.Scores(docs)
    score = {(r.doc_id, r.token): r.elite for r in s.all().collect() if r.doc_id != 5}
    top = [r for r in s.most_weighted().collect() if r.doc_id != 5]
    assert top and all(score[r.doc_id, r.token] == r.elite for r in top)
    a = s.agreement().head()
    assert a.documents == len(top) + 1 and 0 <= a.same <= a.documents and 0 <= a.least_elite <= a.mean_elite <= 1


def test_a_batch_of_many_terms_is_sent_on_in_parts(docs, monkeypatch):
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    texts = [None, "", *(" ".join(f"w{k}x{i}" for i in range(400)) for k in range(1_500)), "the of", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    at, most = 0, 0
    for part in D.document_terms(docs)(iter([batch, batch.slice(0, 0)])):
        for r in part.to_pylist():
            assert r["doc_id"] == at and {x["token"]: x["tf"] for x in r["terms"]} == Counter(tokenize(texts[at]))
            at += 1
        most = max(most, len(part.column(1).flatten()))
    assert at == len(texts) and most <= 50_400
