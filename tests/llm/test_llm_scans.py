import random
import textwrap

import numpy as np
import pytest

from lexigrove.llm import scans as S
from lexigrove.llm.boosting import Boosted

SYL = "hepa tubu loma nectin cyto phage derma stat mora viro plas gram".split()


def words(rng, n=120):
    return sorted({"".join(rng.choices(SYL, k=3)) for _ in range(n)})


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    vocab = words(rng) + ["the", "of", "and", "with", "was", "well-known", "long-term", "cell-free", "half-life"] * 6
    docs = []
    for i in range(260):
        paras = []
        for _ in range(5):
            s = []
            for _ in range(6):
                w = rng.choices(vocab, k=14)
                s.append(" ".join(w).capitalize() + ".")
            paras.append(" ".join(s))
        docs.append((i, "\n".join(paras), " ".join(rng.choices(words(rng), k=7)).capitalize(), f"Annals of {rng.choice(SYL).capitalize()} Studies"))
    return docs


def test_boosted_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = Boosted().fit(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert Boosted().fit(x[:5], np.ones(5)).score(x[:2]).min() > 0.9
    assert len(Boosted().fit(x[:0], y[:0]).score(x[:3])) == 3


def test_fold_hides_confusions():
    rng = random.Random(3)
    for a, b in S.CONFUSIONS:
        if (a, b) not in (("m", "in"), ("h", "li")):
            assert S.fold(f"xk{a}kx") == S.fold(f"xk{b}kx"), (a, b)
    for w in words(rng):
        t = S.misread(w, rng)
        assert t == w or S.confusions_between(t, w) == 1
    assert S.confusions_between("abc", "xyz") > 4 and S.confusions_between("abc", "abc") == 0


@pytest.mark.parametrize("frame", ["t{}e", "w{}ter", "pheno{}enologicalstu{}pe"])
def test_every_confusion_has_its_candidate(spark, frame):
    true = {frame.replace("{}", b): frame.replace("{}", a) for a, b in S.CONFUSIONS if a.isalpha()}
    true |= {frame.replace("{}", b, 1).replace("{}", a): frame.replace("{}", a) for a, b in S.CONFUSIONS if a.isalpha()}
    pairs = [(t, w) for t, w in true.items() if w.isalpha()]
    vocab = spark.createDataFrame([(w, 9, 9, 0) for w in sorted({w for _, w in pairs} | {"unrelated"})], "term string, occ long, df long, scan_occ long")
    seen = spark.createDataFrame([(t, 1, 1) for t in sorted({t for t, _ in pairs})], "token string, occ long, df long")
    got = {(r.token, r.cand) for r in S.candidates(seen, vocab).collect()}
    assert not set(pairs) - got
    assert not any(c == "unrelated" for _, c in got)


def test_furniture_on_held_out_scans(corpus):
    clean = [(t, ti, v) for _, t, ti, v in corpus]
    head, page = S.fit_lines(clean[:130])
    rng = random.Random(99)
    hits = {1: [0, 0, 0], 2: [0, 0, 0]}
    for row in clean[130:]:
        lines, kind = S.simulate(*row, rng)
        [got] = S.line_kinds([(lines, row[1], row[2])], head, page)
        for g, k in zip(got, kind, strict=True):
            for c in (1, 2):
                hits[c][0] += g == c and k == c
                hits[c][1] += g == c and k != c
                hits[c][2] += g != c and k == c
    for tp, fp, fn in hits.values():
        assert tp / (tp + fp) > 0.97 and tp / (tp + fn) > 0.95


@pytest.fixture(scope="module")
def repaired(spark, corpus):
    rng = random.Random(8)
    rows, truth = [], {}
    for i, t, ti, v in corpus:
        if i < 40:
            lines, kind = S.simulate(t, ti, v, rng)
            truth[i] = (lines, kind, t)
            t = "\n".join(lines)
        rows.append((i, t, ti, v, "x"))
    rows += [(900, None, None, None, "x"), (901, "", None, None, "x"), (902, "word " * 40_000, None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, title string, venue string, kinds string").repartition(4)
    return df, truth, {r.doc_id: r for r in S.repair_scans(df).collect()}


def test_only_scans_are_repaired(repaired):
    _, truth, got = repaired
    assert set(got) <= set(truth) and len(got) >= 0.9 * len(truth)


def test_divided_words_and_text(repaired):
    _, truth, got = repaired
    right = wrong = left = parted = 0
    for i, r in got.items():
        lines, kind, clean = truth[i]
        plain = set(clean.lower().replace("\n", " ").split(" "))
        new = r.text.lower().split()
        right += sum(w in plain for w in new)
        wrong += sum(w not in plain for w in new)
        left += sum(r.text.count(h) for h in "¬\xad")
        parted += sum(x.endswith(("¬", "\xad")) for x in lines)
    assert right / (right + wrong) > 0.97 and left < 0.02 * parted


def test_misread_words(repaired):
    _, truth, got = repaired
    tp = fp = fn = 0
    for i, r in got.items():
        lines, kind, clean = truth[i]
        known = set(S.WORD.findall(clean.lower()))
        found = {f.line_no for f in r.found if f.kind == S.MISREAD}
        for n, (x, k) in enumerate(zip(lines, kind, strict=True)):
            if k or not x.strip():
                continue
            inner = S.WORD.findall(x.lower())[1:-1]
            bad = any(w not in known and not any(c.isdigit() for c in w[:1]) and w.isalnum() for w in inner if not w.isdigit())
            if len(inner) > 1:
                tp += bad and n in found
                fn += bad and n not in found
                fp += not bad and n in found and all(w in known for w in S.WORD.findall(x.lower()))
    assert tp / (tp + fp) > 0.9 and tp / (tp + fn) > 0.8


def typeset(text, title, venue, rng, width=58, per=22):
    """A scan of another making than the module's own: pages set by textwrap, one running head, one style of number, errors of four kinds, and what each line holds."""
    body, kinds = [], []
    for para in text.split("\n"):
        for raw in textwrap.wrap(para, width - 2, break_long_words=False):
            body.append(raw)
    held = []
    for n, line in enumerate(body[:-1]):
        first, _, rest = body[n + 1].partition(" ")
        if len(first) > 7 and first.isalpha() and first.islower() and rest and rng.random() < 0.5:
            cut = len(first) // 2
            body[n], body[n + 1] = f"{line} {first[:cut]}-", f"{first[cut:]} {rest}"
            held.append(n)
    lines, page, shown = [], 0, rng.randint(2, 90)
    for n, line in enumerate(body):
        if n % per == 0:
            page += 1
            lines.append(f"{venue}      {shown + page}" if page % 2 else f"{shown + page}      {' '.join(title.split()[:4])}")
            kinds.append({S.HEADER})
            if page > 1:
                lines.insert(-1, str(shown + page - 1))
                kinds.insert(-1, {S.PAGE})
        kind = {S.BROKEN} if n in held else set()
        words = line.split(" ")
        spots = [k for k in range(1, len(words) - 1) if len(words[k]) > 6 and words[k].isalpha() and words[k].islower()]
        if spots and rng.random() < 0.15:
            k = rng.choice(spots)
            a, b = rng.choice([("m", "rn"), ("l", "1"), ("o", "0"), ("e", "c")])
            if a in words[k]:
                words[k] = words[k].replace(a, b, 1)
                kind.add(S.MISREAD)
        lines.append(" ".join(words))
        kinds.append(kind)
    return lines, kinds


def recall_by_kind(got, truth):
    out = {}
    for kind in (S.HEADER, S.PAGE, S.BROKEN, S.MISREAD):
        true = {(i, n) for i, (_, kinds) in truth.items() for n, k in enumerate(kinds) if kind in k}
        found = {(i, f.line_no) for i, r in got.items() for f in r.found if f.kind == kind}
        out[kind] = (len(true & found) / len(true), len(true & found) / max(1, len(found)))
    return out


@pytest.fixture(scope="module")
def typeset_rows(corpus):
    rng = random.Random(31)
    truth = {i: typeset(t, ti, v, rng) for i, t, ti, v in corpus[:60]}
    rows = [(i, "\n".join(truth[i][0]) if i in truth else t, ti, v) for i, t, ti, v in corpus]
    return rows, truth


SCHEMA = "doc_id long, text string, title string, venue string"


def test_recall_by_kind_on_other_scans(spark, typeset_rows):
    rows, truth = typeset_rows
    got = {r.doc_id: r for r in S.repair_scans(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == set(truth)
    for kind, (recall, precision) in recall_by_kind(got, truth).items():
        assert recall >= 0.9 and precision >= 0.9, (kind, recall, precision)


def test_corpus_of_scans_only(spark, typeset_rows):
    rows, truth = typeset_rows
    only = spark.createDataFrame([r for r in rows if r[0] in truth], SCHEMA)
    with pytest.raises(ValueError, match="models"):
        S.repair_scans(only)
    models = S.fit_models(spark.createDataFrame([r for r in rows if r[0] not in truth], SCHEMA))
    got = {r.doc_id: r for r in S.repair_scans(only, models=models).collect()}
    by = recall_by_kind(got, truth)
    for kind in (S.HEADER, S.PAGE, S.BROKEN):
        assert min(by[kind]) >= 0.9, (kind, by)
    assert by[S.MISREAD][1] >= 0.9
    lost = sum(w not in r.text.lower() for r in got.values() for w in ("the", "with"))
    assert lost < len(got) * 0.2  # common words are in scans only, and stay
    with pytest.raises(ValueError):
        S.fit_models(only)


def test_short_scans(spark, corpus):
    w = "the well phagestatviro tubulomagram was seen in the nectinlomastat of all of"
    whole = " ".join(sorted({x for _, t, _, _ in corpus for x in t.lower().replace(".", "").split() if len(x) > 9})[:1])
    cut = len(whole) // 2
    short = {
        800: f"{w} {whole[:cut]}-\n{whole[cut:]} {w} the\nof the last of them.",
        801: f"{w} {whole[:cut]}-\n{whole[cut:]} {w} the",
        802: f"{w} the\n{w} and\nof no more.",
        803: "one line only",
    }
    rows = [*corpus, *[(i, t, "No such title at all", "Nowhere Letters") for i, t in short.items()]]
    got = {r.doc_id: r for r in S.repair_scans(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {800, 801}
    assert all(whole in got[i].text and [(f.line_no, f.kind) for f in got[i].found] == [(0, S.BROKEN)] for i in got)


def test_hot_keys_are_split(spark):
    vocab = [f"hepatic{a}{b}oma" for a in "abcdehkmprstuvw" for b in "aeiou"]
    words = spark.createDataFrame([(w, 9, 9, 0) for w in vocab], "term string, occ long, df long, scan_occ long")
    seen = spark.createDataFrame([(w.replace("o", "0"), 1, 1) for w in vocab], "token string, occ long, df long")
    rows = lambda most: sorted(map(tuple, S.candidates(seen, words, most).collect()))
    assert rows(3) == rows(10**6) and {r[3] for r in rows(3)} >= set(vocab)


def test_other_readings(spark):
    words = spark.createDataFrame([("nectinloma", 9, 9, 0), ("203", 4, 4, 0)], "term string, occ long, df long, scan_occ long")
    seen = spark.createDataFrame([(t, 1, 1) for t in ("nect1nl0ma", "nectinl0ma", "hepat0stat", "2o3", "l2", "p53", "ab12cd34", "plain")], "token string, occ long, df long")
    got = {r.token: (r.cand, r.cocc) for r in S.other_readings(seen, words).collect()}
    assert got == {"nect1nl0ma": ("nectlnloma", 0), "nectinl0ma": ("nectinloma", 9), "hepat0stat": ("hepatostat", 0), "2o3": ("203", 4), "l2": ("12", 0)}


def test_empty(repaired):
    df, _, _ = repaired
    assert S.repair_scans(df.limit(0)).count() == 0
    assert S.repair_scans(df.where("doc_id >= 900"), title=None, venue=None).count() == 0
