import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrove.llm import packing as P


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=40), st.integers(50, 90))
def test_windows_hold_everything_once(sizes, capacity):
    windows = P.pack(sizes, capacity)
    assert sorted(p for w in windows for p in w) == list(range(len(sizes)))
    assert all(sum(sizes[p] for p in w) <= capacity for w in windows)


def test_differencing_is_near_equal():
    rng = random.Random(3)
    sizes = [rng.randint(1, 1000) for _ in range(200)]
    sums = [s for s, _ in P.differencing(sizes, 7)]
    assert len(sums) == 7 and max(sums) - min(sums) <= 5
    assert sorted(s for s, _ in P.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]


@pytest.fixture(scope="module")
def packed(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([1, 5, 30, 200]), "x", 1) for i in range(400)] + [(900, None, "x", 1), (901, "", "x", 1), (902, "long word " * 20_000, "x", 1), (5, "w w", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, container_kind string, row int").repartition(3)
    kinds = spark.createDataFrame([("small", 64), ("large", 500), ("none", None), ("zero", 0), ("small", 64)], "container_kind string, capacity_tokens int")
    return docs, kinds, P.pack_documents(docs, kinds).collect()


def test_packing(packed):
    docs, _, rows = packed
    size = defaultdict(list)
    for r in P.token_counts(docs).collect():
        size[r.doc_id].append(r.tokens)
    for kind, cap in (("small", 64), ("large", 500)):
        own = [r for r in rows if r.container_kind == kind]
        load, pieces = defaultdict(int), defaultdict(list)
        for r in own:
            load[r.container_id] += r.token_end - r.token_start
            pieces[r.doc_id].append((r.token_start, r.token_end))
        assert max(load.values()) <= cap
        assert set(pieces) == set(size)
        for d, p in pieces.items():
            assert sum(b - a for a, b in p) == sum(size[d])
            if len(size[d]) == 1:
                p.sort()
                assert p[0][0] == 0 and all(x[1] == y[0] for x, y in zip(p, p[1:], strict=False))
                assert len(p) == 1 or size[d][0] > cap  # only texts over the capacity are divided
        assert sum(load.values()) / (len(load) * cap) > 0.85
    assert {r.container_kind for r in rows} == {"small", "large"}


def test_same_result_again(packed):
    docs, kinds, rows = packed
    again = P.pack_documents(docs.repartition(7), kinds).collect()
    by = lambda x: sorted(map(tuple, x))
    assert by(again) == by(rows)


def test_faults(packed):
    docs, kinds, rows = packed
    spark = docs.sparkSession
    schema = "container_kind string, container_id string, doc_id long, piece_no int, token_start long, token_end long"
    good = P.faults(spark.createDataFrame(rows, schema), kinds).collect()
    assert {tuple(r) for r in good} == {(k, docs.count(), 0, 0, 0) for k in ("small", "large")}
    bad = [("small", "a", 1, 0, 0, 60), ("small", "a", 2, 0, 0, 60), ("small", "b", 3, 0, 0, 10), ("small", "b", 3, 1, 10, 20), ("small", "c", 4, 0, 0, 64), ("small", "d", 4, 1, 70, 80)]
    assert [tuple(r) for r in P.faults(spark.createDataFrame(bad, schema), kinds).collect()] == [("small", 4, 1, 1, 1)]


def test_empty(packed):
    docs, kinds, _ = packed
    assert P.pack_documents(docs.limit(0), kinds).count() == 0
    assert P.pack_documents(docs, kinds.limit(0)).count() == 0
