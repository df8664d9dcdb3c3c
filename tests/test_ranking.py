import random

import pytest

from lexigrove.operators import ranking as R


def table(spark, lists):
    rows = [(i, f"w{i}", p, d, h) for i, docs in enumerate(lists) for p, (d, h) in enumerate(docs)]
    return spark.createDataFrame(rows, "word_idx int, word string, list_pos int, doc_id long, hits array<int>")


def walk_bonus(hits):
    """Forward to the first body hit, then backward to the last one."""
    seen = set()
    for direction in (hits, hits[::-1]):
        for h in direction:
            if h % 10 == 1:
                break
            seen.add(h % 10)
    return sum(R.BONUS.get(c, 0) for c in seen)


def simulate(lists, normalize=True):
    n = len(lists)
    maps = [dict(x) for x in lists]
    relevant = lambda h: bool(h) and (h[0] % 10 != 1 or h[-1] % 10 != 1)
    levels = []
    if n > 1:
        levels.append({d: relevant(h) for d, h in maps[0].items()})
        for m in maps[1:]:
            levels.append({d: v and relevant(m[d]) for d, v in levels[-1].items() if d in m})

    def multiplier(d):
        for i in range(len(levels) - 1, 0, -1):
            if levels[i].get(d):
                return (i + 1) * 100
        for i in range(len(levels) - 1, 0, -1):
            if d in levels[i]:
                return (i + 1) * 2
        return 1

    total = {}
    for docs in lists:
        scored = []
        for d, h in docs:
            m = multiplier(d)
            scored.append(((min(len(h), 20) + (10 if m > 1 else 0) + walk_bonus(h)) * m, d))
        for s, d in sorted(scored, key=lambda x: -x[0]):
            total[d] = total.get(d, 0) + s
    if levels:
        for d in total:
            if d in levels[-1]:
                total[d] *= 3 if levels[-1][d] else 1.5
    if normalize and n > 1:
        total = {d: s / n for d, s in total.items()}
    return sorted(((float(s), d) for d, s in total.items()), key=lambda x: -x[0])


@pytest.mark.parametrize(
    "docs, expected",
    [
        ([(1, [1, 1, 1]), (2, [1, 1]), (3, [1])], [(3, 1), (2, 2), (1, 3)]),
        ([(1, [0, 1, 1]), (2, [1, 1, 1, 1])], [(53, 1), (4, 2)]),
        ([(1, [1, 1, 2]), (2, [1, 1, 1, 1])], [(33, 1), (4, 2)]),
        ([(1, [1, 1, 3]), (2, [1, 1, 1])], [(23, 1), (3, 2)]),
        ([(1, [1, 1, 5]), (2, [1, 1, 1, 1])], [(33, 1), (4, 2)]),
        ([(1, [1] * 50), (2, [1] * 20)], [(20, 1), (20, 2)]),
        ([(1, [0, 0, 0, 1])], [(54, 1)]),
        ([(1, [0, 1, 1, 2, 3, 5])], [(136, 1)]),
        ([(1, [1, 0, 1])], [(3, 1)]),
        ([(1, [])], [(0, 1)]),
    ],
)
def test_single_word(spark, docs, expected):
    rows = R.rank_single(table(spark, [docs])).orderBy("rank").collect()
    assert [(r.score, r.doc_id) for r in rows] == expected


def test_relevance(spark):
    df = table(spark, [[(1, [0, 1, 1]), (2, [1, 1, 2]), (3, [1, 1, 1]), (4, []), (5, [1, 0, 1]), (6, [4, 1]), (7, None)]])
    got = {r.doc_id: r.x for r in df.select("doc_id", R.is_relevant(df.hits).alias("x")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True, 7: False}


A = [(1, [0, 1, 1]), (2, [1, 1]), (3, [1])]
B = [(1, [0, 1]), (2, [1]), (4, [1, 2])]


def test_worked_example(spark):
    rows = R.rank_query(["a", "b"], table(spark, [A, B])).orderBy("rank").collect()
    assert [(r.score, r.doc_id) for r in rows] == [(37500.0, 1), (69.0, 2), (16.0, 4), (0.5, 3)]
    raw = R.rank_multi(table(spark, [A, B]), 2, normalize=False).orderBy("rank").collect()
    assert [(r.score, r.doc_id) for r in raw] == [(75000.0, 1), (138.0, 2), (32.0, 4), (1.0, 3)]


def test_intersections(spark):
    t = table(spark, [A, B])
    assert {(r.level, r.doc_id, r.relevant) for r in R.intersections(t, 2).collect()} == {(0, 1, True), (0, 2, False), (0, 3, False), (1, 1, True), (1, 2, False)}
    assert R.intersections(t, 1).count() == 0
    assert {r.doc_id: r.multiplier for r in R.intersection_multiplier(t, 2).collect()} == {1: 200, 2: 4, 3: 1, 4: 1}


def test_dispatch_and_empty(spark):
    t = table(spark, [A, B])
    assert R.rank_query(["w1"], t).count() == 3
    with pytest.raises(KeyError):
        R.rank_query(["none"], t)
    assert R.rank_multi(t.limit(0), 0).count() == 0
    assert R.rank_query([], t.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_random_queries_follow_the_steps(spark, seed):
    rng = random.Random(seed)
    lists = []
    for _ in range(rng.randint(2, 4)):
        docs = rng.sample(range(12), rng.randint(1, 10))
        lists.append([(d, [rng.choice([0, 1, 1, 1, 2, 3, 5, 7]) + 10 * k for k in range(rng.randint(0, 6))]) for d in docs])
    rows = R.rank_multi(table(spark, lists), len(lists)).orderBy("rank").collect()
    assert [(r.score, r.doc_id) for r in rows] == simulate(lists)
