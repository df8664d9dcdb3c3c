import random
import unicodedata

from lexigrove.llm import leakage as L

WORDS = [f"w{i}" for i in range(30)]


def runs(text, n=L.RUN):
    w = L.normal_words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def make(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, make(rng, rng.choice([5, 12, 13, 40]))) for i in range(30)] + [(77, None), (78, ""), (3, make(rng, 20))]
    docs = []
    for d in range(60):
        t = make(rng, 30)
        if d % 3 == 0:
            i = rng.randrange(30)
            w = (items[i][1] or "").split()
            part = w[: rng.choice([11, 12, len(w)])]
            t = f"{make(rng, 7)} {'-  '.join(part).upper()}.\n{make(rng, 9)}"
        docs.append((d, t, "clash"))
    docs += [(500, None, ""), (501, "", ""), (502, "x " * 50_000 + items[2][1], "")]
    docs += [docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    it = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, t, _ in docs for i, x in items if runs(t) & runs(x)}
    assert want
    got = L.leaks(df, it).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    blocks = L.leaks(df, it, block_runs=30).collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == want
    text = {d: t for d, t, _ in docs}
    by = {}
    for i, x in items:
        by[i] = by.get(i, set()) | runs(x)
    for r in got:
        part = text[r.doc_id][r.start : r.end]
        assert len(L.normal_words(part)) >= L.RUN and runs(part) & by[r.item_id]
        edge = text[r.doc_id]
        assert (r.start == 0 or not edge[r.start - 1].isalnum()) and (r.end == len(edge) or not edge[r.end].isalnum())


def test_offsets_where_lower_case_is_longer():
    block = [(1, [f"w{k}" for k in range(12)])]
    auto = L.Automaton(block, 12)
    text = "İİ " + " ".join(f"W{k}" for k in range(12)) + " end"
    [(item, s, e)] = list(auto.leaks(text))
    assert item == 1 and text[s:e] == " ".join(f"W{k}" for k in range(12))


def test_empty(spark):
    df = spark.createDataFrame([(1, "a " * 20)], "doc_id long, text string")
    it = spark.createDataFrame([(1, "a " * 20)], "item_id long, text string")
    assert L.leaks(df, it).count() == 1
    assert L.leaks(df.limit(0), it).count() == 0 and L.leaks(df, it.limit(0)).count() == 0


def test_separate_passages_are_told_apart(spark):
    item = [f"w{k}" for k in range(40)]
    head, tail, other = " ".join(item[:14]), " ".join(item[26:]), "some other words " * 30
    text = f"{head} {other}{tail}"
    df, it = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = [(r.item_id, text[r.start : r.end]) for r in L.leaks(df, it).orderBy("start").collect()]
    assert got == [(7, head), (7, tail)]


def test_normal_forms_on_both_sides(spark):
    base = ["naïve", "ﬁne", "Ångström", "x²", "São", "voilà", "한국", "Große", "ünder", "über", "coöp", "déjà"]
    item = " ".join(base)
    docs = [(1, unicodedata.normalize("NFD", item).upper()), (2, "[[" + unicodedata.normalize("NFKC", item) + "]]"), (3, unicodedata.normalize("NFC", item)), (4, "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in item))]
    docs = [(i, f"è́ x {t} tail") for i, t in docs]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r for r in L.leaks(df, it).collect()}
    text = dict(docs)
    assert set(got) >= {2, 3, 4}
    for i, r in got.items():
        part = text[i][r.start : r.end]
        assert L.normal_words(part) == L.normal_words(text[i])[r.first_word : r.last_word + 1] and len(L.normal_words(part)) == 12
        assert not part[:1].isspace() and not part[-1:].isspace()


def test_automaton_stays_in_the_worker():
    class Shared:
        value = [(1, [f"w{k}" for k in range(12)])]

    a = L._automaton("k", 0, Shared, 12)
    assert L._automaton("k", 0, Shared, 12) is a
    assert L._automaton("other", 0, Shared, 12) is not a and len(L._kept) == 1
