import random
from collections import Counter, defaultdict
from math import ceil

from lexigrove.operators import skew as S

POST = "shard_id int, token_id long, doc_id long, freq int, weight string"


def rows(seed=2):
    rng = random.Random(seed)
    out = []
    for d in range(600):
        out.append((0, 1 if d % 3 else rng.randint(2, 9), d, rng.choice([1, 1, 2, 3, 50]), "clash"))
    return out + out[:100] + [(1, 1, 5, None, None), (None, 1, 5, 2, None)]


def test_lengths(spark):
    p = spark.createDataFrame(rows(), POST)
    units = {(s, t, d): f for s, t, d, f, _ in rows()}
    want = defaultdict(lambda: 4)
    for (s, t, _), f in units.items():
        want[s, t] += 12 + 4 * (f or 0)
    assert {(r.shard_id, r.token_id): r.true_length for r in S.true_lengths(S.freq_table(p)).collect()} == dict(want)
    stated = [(s, t, 0, n) for (s, t), n in want.items()] + [(0, 1, 0, 7), (0, 99, 0, 4), (0, 98, 0, 5), (0, 97, 0, None), (0, 98, 0, 5)]
    o = spark.createDataFrame(stated, "shard_id int, token_id long, offset long, length long")
    assert sorted(map(tuple, S.wrong_lengths(p, o).collect())) == [(0, 1), (0, 97), (0, 98)]
    assert S.wrong_lengths(p.limit(0), o.limit(0)).count() == 0


def test_summary_and_percentiles(spark):
    p = spark.createDataFrame(rows(), POST)
    f = S.freq_table(p)
    by = defaultdict(list)
    for (s, t, _), v in {(s, t, d): v for s, t, d, v, _ in rows()}.items():
        by[s, t].append(v)
    got = {(r.shard_id, r.token_id): r for r in S.weighted_summary(f, S.KEYS, "freq").collect()}
    for k, v in by.items():
        known = [x for x in v if x is not None]
        c = Counter(known)
        mode = min(c, key=lambda x: (-c[x], x)) if c else None
        assert (got[k].n, got[k].distinct_values, got[k].total, got[k].mode) == (len(v), len(c), sum(known) if known else None, mode)
    pct = {(r.shard_id, r.token_id): (r.p50, r.p90) for r in S.weighted_percentiles(f, S.KEYS, "freq", [0.5, 0.9]).collect()}
    want = {}
    for k, v in by.items():
        v = sorted(x for x in v if x is not None)
        if v:
            want[k] = tuple(v[max(1, ceil(len(v) * s)) - 1] for s in (0.5, 0.9))
    assert pct == want
    assert S.weighted_percentiles(f.limit(0), S.KEYS, "freq", [0.5]).count() == 0
