import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexigrove.functions.text import tokenize
from lexigrove.operators import barrels as B
from lexigrove.operators import storage
from lexigrove.operators.index import EmptyCorpus, build_index
from lexigrove.operators.numbering import dense_number, running_sum
from lexigrove.operators.search import UnknownTerm, term_lookup
from lexigrove.operators.validate import block_order, compare_postings, sample_tokens
from lexigrove.sources import store
from lexigrove.sources.store import lookup, read_index_table, write_index


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    words = ["the"] + [f"w{i}" for i in range(40)]
    out = []
    for i in range(n):
        k = rng.choice([0, 3, 12])
        text = None if i == 7 else " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=k))
        out.append((i, f"P{i}", text, "clash"))
    return out


@pytest.fixture(scope="module")
def built(spark):
    df = spark.createDataFrame(corpus(), "n int, paper_id string, text string, tokens string").repartition(5)
    return build_index(df, ["n"])


@pytest.fixture(scope="module")
def simulated():
    docs, lexicon = [], {}
    for _, paper, text, _ in corpus():
        toks = tokenize(text)
        if toks:
            docs.append((len(docs), paper, [lexicon.setdefault(t, len(lexicon)) for t in toks]))
    return docs, lexicon


def test_numbers_follow_first_occurrence(built, simulated):
    docs, lexicon = simulated
    assert {(r.doc_id, r.paper_id) for r in built.doc_ids().collect()} == {(d, p) for d, p, _ in docs}
    assert {r.token: r.token_id for r in built.lexicon.collect()} == lexicon
    assert {r.doc_id: r.token_ids for r in built.forward().collect()} == {d: ids for d, _, ids in docs}


def test_postings_and_inverted(built, simulated):
    docs, _ = simulated
    want, inv = {}, defaultdict(list)
    for d, _, ids in docs:
        for t in sorted(set(ids)):
            pos = [i for i, x in enumerate(ids) if x == t]
            want[t, d] = (len(pos), pos)
            inv[t].append(d)
    assert {(r.token_id, r.doc_id): (r.freq, r.positions) for r in built.postings.collect()} == want
    assert {r.token_id: r.doc_ids for r in built.inverted().collect()} == dict(inv)
    whole = defaultdict(list)
    for r in built.inverted(block=5).orderBy("token_id", "block_no").collect():
        assert len(r.doc_ids) <= 5 and r.doc_freq == len(inv[r.token_id])
        whole[r.token_id] += r.doc_ids
    assert whole == inv
    s = built.inverted_stats().head()
    assert (s.unique_tokens, s.total_postings, s.documents_indexed) == (len(inv), len(want), len(docs))
    f = built.forward_stats().head()
    assert (f.documents_indexed, f.docs_skipped) == (len(docs), len(corpus()) - len(docs))


def test_barrels_follow_formula(built, simulated):
    docs, _ = simulated
    df = defaultdict(int)
    for _, _, ids in docs:
        for t in set(ids):
            df[t] += 1
    b = B.Barrels(built, num_barrels=4, share=0.3)
    th = max(1, int(len(docs) * 0.3))
    rest = sorted((t for t in df if df[t] < th), key=lambda t: (df[t], t))
    want = {t: 4 for t in df if df[t] >= th} | {t: min(int((i / len(rest)) ** 0.6 * 4), 3) for i, t in enumerate(rest)}
    assert {r.token_id: r.barrel_id for r in b.barrel_map().collect()} == want
    assert b.stats().agg(F.sum("token_count")).head()[0] == len(df)
    assert [r.token_id for r in b.most_frequent(5).orderBy("rank").collect()] == sorted(df, key=lambda t: (-df[t], t))[:5]
    assert b.analysis().agg(F.sum("token_count")).head()[0] == len(df)


def test_barrel_fallback(spark):
    posts = spark.createDataFrame([(5, 0, 1, [0]), (6, 0, 1, [1]), (7, 0, 1, [2])], "token_id long, doc_id long, freq int, positions array<int>")
    known = spark.createDataFrame([(5, 2), (7, 99)], "token_id long, barrel_id int")
    assert {r.token_id: r.barrel_id for r in B.assign_barrel(posts, known, 4).collect()} == {5: 2, 6: 2, 7: 4}


def test_block_layout_of_dedupe_case(spark):
    df = spark.createDataFrame([(0, "x", "a1 a1 b2 b2 b2 c3"), (1, "y", "b2 c3 d4")], "n int, paper_id string, text string")
    ix = build_index(df, ["n"])
    rows = sorted((r.token_id, r.offset, r.length) for r in storage.offsets(ix.postings).collect())
    assert rows == [(0, 0, 24), (1, 24, 44), (2, 68, 36), (3, 104, 20)]
    assert {r.doc_id: r.freq for r in term_lookup(ix, "b2").collect()} == {0: 3, 1: 1}


def test_lookup(built):
    rows = term_lookup(built, "w1", top=3).collect()
    assert len(rows) == 3 and rows[0].doc_count >= 3
    assert term_lookup(built, "W1").collect() == []
    with pytest.raises(UnknownTerm):
        term_lookup(built, "nothing", strict=True)


def test_heavy_and_stats(built):
    h = storage.heavy(built.postings, 0.2, 2).orderBy(F.desc("bytes")).collect()
    assert len(h) == 2 and h[0].bytes >= h[1].bytes and h[0].total_heavy >= 2
    assert storage.heavy(built.postings, 0.2, 0).count() == h[0].total_heavy
    ids = {r.token_id for r in h}
    assert {r.token_id for r in storage.heavy_postings(built.postings, 0.2, 2).collect()} == ids
    lengths = sorted(r.length for r in storage.block_lengths(built.postings).collect())
    from statistics import median, quantiles

    s = storage.block_stats(built.postings).head()
    assert s.median_bytes == median(lengths) and abs(s.p95_bytes - quantiles(lengths, n=100)[94]) < 1e-9
    assert storage.largest_blocks(built.postings, 3).count() == 3
    assert storage.memory_estimate(built).head().total_bytes == 180 * built.lexicon.count()


def test_limit_and_empty(spark):
    df = spark.createDataFrame(corpus(), "n int, paper_id string, text string, tokens string")
    assert build_index(df, ["n"], limit=3).docs.count() == 3
    with pytest.raises(EmptyCorpus):
        build_index(df.limit(0), ["n"])
    with pytest.raises(EmptyCorpus):
        build_index(df, ["n"], limit=0)
    with pytest.raises(ValueError):
        build_index(df, ["n"], limit=-1)


def test_validation_finds_differences(built):
    n = built.postings.count()
    assert [tuple(r) for r in compare_postings(built.postings, built.postings).collect()] == [(-1, "compared", 2 * n)]
    less = built.postings.where("token_id <> 2 OR doc_id > 3")
    gone = n - less.count()
    assert {tuple(r) for r in compare_postings(built.postings, less).collect()} == {(2, "not in barrels", gone), (-1, "compared", 2 * n - gone)}
    assert {tuple(r) for r in compare_postings(less, built.postings).where("token_id >= 0").collect()} == {(2, "not in index", gone)}
    assert sample_tokens(built.lexicon, 3).collect() == sample_tokens(built.lexicon.repartition(3), 3).collect()


def test_validation_checks_block_order(spark):
    rows = [(1, 5, "a", 0), (1, 7, "a", 1), (1, 9, "b", 0), (2, 5, "a", 2), (2, 4, "a", 3), (3, 8, "a", 4), (3, 8, "b", 1), (4, 1, "b", 2)]
    df = spark.createDataFrame(rows, "token_id long, doc_id long, file string, row long")
    assert {tuple(r) for r in block_order(df, ["file", "row"]).collect()} == {(2, "order", 1), (3, "order", 1)}


def test_hot_tokens_change_nothing(spark, built):
    df = spark.createDataFrame(corpus(), "n int, paper_id string, text string, tokens string")
    other = build_index(df, ["n"], hot_share=0.2)
    assert other.hot.count() and other.rare.count()
    key = lambda ix: sorted((r.token_id, r.doc_id, r.freq, tuple(r.positions)) for r in ix.postings.collect())
    assert key(other) == key(built)
    a, b = B.Barrels(built, 4, 0.3).postings(), B.Barrels(other, 4, 0.3).postings()
    assert sorted((r.token_id, r.doc_id, r.barrel_id) for r in a.collect()) == sorted((r.token_id, r.doc_id, r.barrel_id) for r in b.collect())
    assert {r.token_id: r.doc_freq for r in other.doc_freq().collect()} == {r.token_id: r["count"] for r in built.postings.groupBy("token_id").count().collect()}


def test_numbering_and_running_sum(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 5).alias("v")).repartition(7)
    assert {(r.k, r.n) for r in dense_number(df, ["k"], "n").collect()} == {(k, k) for k in range(1000)}
    rows = sorted((r.k, r.v, r.s) for r in running_sum(df, ["k"], "v", "s").collect())
    total = 0
    for _, v, s in rows:
        assert s == total
        total += v
    assert dense_number(df.limit(0), ["k"], "n").count() == 0


def test_store_round_trip(built, spark, tmp_path):
    b = B.Barrels(built)
    folder = f"file://{tmp_path}/index"
    builds = [write_index(b, folder, threshold_kb=0.2, top=2).rpartition("/")[2] for _ in range(3)]
    assert read_index_table(spark, folder, "postings").count() == built.postings.count()
    assert {p.name for p in (tmp_path / "index").glob("build-*")} == set(builds[1:]) and store.current_build(spark, folder).endswith(builds[2])
    for term in ("w0", "w1", "w33"):
        want = [(r.doc_id, r.freq) for r in term_lookup(built, term).orderBy("doc_id").collect()]
        for heavy in (True, False):
            got = lookup(spark, folder, term, use_heavy=heavy)
            assert got.code == store.FOUND and got.rows == want and got.doc_count == built.postings.where(F.col("token_id") == got.token_id).count()
    assert lookup(spark, folder, "w0").heavy and set(got.ms) == {"lexicon", "offset", "locate", "read"}
    assert lookup(spark, folder, "nothing").code == store.NO_TERM
    assert [r.token_id for r in store.heavy_tokens(spark, folder, 0.2, 2).orderBy(F.desc("bytes")).collect()] == [r.token_id for r in read_index_table(spark, folder, "heavy_manifest").orderBy(F.desc("bytes")).collect()]
    with pytest.raises(FileNotFoundError):
        read_index_table(spark, f"file://{tmp_path}/none", "postings")


def test_lookup_tells_what_is_missing(built, spark, tmp_path):
    import shutil

    folder, root = f"file://{tmp_path}/index", tmp_path / "index"
    write_index(B.Barrels(built), folder)
    build = root / store.current_build(spark, folder).rpartition("/")[2]
    shutil.rmtree(build / "barrel_map")
    assert lookup(spark, folder, "w1").rows  # a token without a barrel
    shutil.rmtree(build / "heavy_postings")
    assert lookup(spark, folder, "w1").rows
    places = read_index_table(spark, folder, "offsets").where(F.col("token_id") != lookup(spark, folder, "w1").token_id).collect()
    shutil.rmtree(build / "offsets")
    assert lookup(spark, folder, "w1").code == store.NO_INDEX
    spark.createDataFrame(places).write.parquet(f"file://{build}/offsets")
    assert lookup(spark, folder, "w1").code == store.NO_OFFSET and lookup(spark, folder, "w2").code == store.FOUND
    shutil.rmtree(build / "lexicon")
    assert lookup(spark, folder, "w1").code == store.NO_LEXICON
    assert lookup(spark, f"{folder}x", "w1").code == store.NO_INDEX


def test_stored_validation(built, spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    write_index(B.Barrels(built), folder)
    assert [r.problem for r in store.validate(spark, folder).collect()] == ["compared"]
    assert store.validate(spark, folder, sample=3).head().rows > 0
    path = f"{store.current_build(spark, folder)}/postings"
    rows = spark.read.parquet(path).collect()
    moved = spark.createDataFrame(rows, spark.read.parquet(path).schema)
    moved = moved.where("token_id <> 1 OR doc_id > 20").coalesce(1).sortWithinPartitions("barrel_id", "token_id", F.when(F.col("token_id") == 2, -F.col("doc_id")).otherwise(F.col("doc_id")))
    moved.write.mode("overwrite").partitionBy("barrel_id").parquet(path)
    bad = {(r.token_id, r.problem) for r in store.validate(spark, folder).collect()}
    assert bad == {(-1, "compared"), (1, "not in index"), (2, "order")}
    assert {r.problem for r in store.validate(spark, folder, tokens=[3]).collect()} == {"compared"}


def test_stored_tables_are_dropped(spark):
    from lexigrove.session import drop_tables, materialize, shared_folder, stored_tables, sweep

    before = stored_tables(spark)
    df = materialize(spark.range(10).selectExpr("id", "id % 2 = 0 AS even"), ["even"])
    assert df.columns == ["id", "even"] and df.where("even").count() == 5
    [path] = stored_tables(spark) - before
    assert drop_tables(spark, before) == 1 and stored_tables(spark) == before
    spark.range(3).write.parquet(path)  # as a killed driver leaves it
    assert sweep(spark, 1.0) == 0
    import time

    assert sweep(spark, 1.0, (time.time() + 7200) * 1000) >= 1 and shared_folder(spark)


def test_index_is_rebuilt_for_changed_files(spark, tmp_path):
    from lexigrove.plans import catalog

    for text in ("one two", "one two three"):
        spark.createDataFrame([(1, text)], "doc_id long, text string").write.mode("overwrite").parquet(f"file://{tmp_path}/documents.parquet")
        ix = catalog.index_of(spark, f"file://{tmp_path}")
        assert ix.lexicon.count() == len(text.split())
        assert catalog.index_of(spark, f"file://{tmp_path}") is ix
