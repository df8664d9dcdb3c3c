import struct

import pytest

from lexigrove.operators import storage
from lexigrove.operators.barrels import Barrels
from lexigrove.operators.index import build_index
from lexigrove.sources import binary as B


@pytest.fixture(scope="module")
def index(spark):
    rows = [(i, f"P{i}", " ".join(f"w{k}" for k in range(i % 7)) + " åb åb") for i in range(30)]
    return build_index(spark.createDataFrame(rows, "n int, paper_id string, text string"), ["n"])


def words(*x):
    return struct.pack(f"<{len(x)}I", *x)


def test_lists(spark, tmp_path, index, monkeypatch):
    monkeypatch.setattr(B, "PIECE", 7)
    forward = {r.doc_id: r.token_ids for r in index.forward().collect()}
    data = words(len(forward)) + b"".join(words(d, len(t), *t) for d, t in forward.items())
    path = tmp_path / "forward_index.bin"
    path.write_bytes(data)
    assert {r.doc_id: r.list for r in B.read_lists(spark, f"file://{path}", "forward").collect()} == forward
    for bad in (data[:-2], words(len(forward) + 1) + data[4:], b"xx", data + words(1)):
        path.write_bytes(bad)
        with pytest.raises(Exception, match="record|header"):
            B.read_lists(spark, f"file://{path}", "forward").collect()
    (tmp_path / "empty.bin").write_bytes(words(0))
    assert B.read_lists(spark, f"file://{tmp_path}/empty.bin", "inverted").count() == 0


def test_lexicon(spark, tmp_path, index):
    tokens = {r.token_id: r.token for r in index.lexicon.collect()}
    data = words(len(tokens)) + b"".join(words(len(t.encode())) + t.encode() + words(i) for i, t in tokens.items())
    path = tmp_path / "lexicon.bin"
    path.write_bytes(data)
    assert {r.token_id: r.token for r in B.read_lexicon(spark, f"file://{path}").collect()} == tokens
    path.write_bytes(data[:-1])
    with pytest.raises(Exception, match="within a record"):
        B.read_lexicon(spark, f"file://{path}").collect()


def test_postings(spark, tmp_path, index, monkeypatch):
    monkeypatch.setattr(B, "TASK_BYTES", 200)
    posts = sorted((r.token_id, r.doc_id, r.freq, r.positions) for r in index.postings.collect())
    blocks = {t: [p for p in posts if p[0] == t] for t in {p[0] for p in posts}}
    data = b"".join(words(len(ps)) + b"".join(words(d, f, len(x), *x) for _, d, f, x in ps) for _, ps in sorted(blocks.items()))
    places = [(r.token_id, r.offset, r.length) for r in storage.offsets(index.postings).orderBy("token_id").collect()]
    (tmp_path / "postings_index.bin").write_bytes(data)
    (tmp_path / "postings_offsets.bin").write_bytes(words(len(places)) + b"".join(struct.pack("<IQQ", *p) for p in places))
    offsets = B.read_offsets(spark, f"file://{tmp_path}/postings_offsets.bin")
    assert sorted(map(tuple, offsets.collect())) == places
    got = B.read_postings(spark, f"file://{tmp_path}/postings_index.bin", offsets)
    assert sorted((r.token_id, r.doc_id, r.freq, r.positions) for r in got.collect()) == posts and got.rdd.getNumPartitions() > 1
    with pytest.raises(Exception, match="block|record"):
        B.read_postings(spark, f"file://{tmp_path}/postings_index.bin", offsets.selectExpr("token_id", "offset", "length - 4 AS length")).collect()


def test_barrels(spark, tmp_path, index):
    posts = Barrels(index, 4, 0.3).postings()
    files = B.write_barrels(posts, f"file://{tmp_path}/barrels").collect()
    assert sum(r.records for r in files) == posts.count()
    back = []
    for k in {r.barrel_id for r in files}:
        whole = tmp_path / f"barrel_{k:02d}.bin"
        whole.write_bytes(b"".join((tmp_path / "barrels" / r.file).read_bytes() for r in files if r.barrel_id == k))
        back += [(r.token_id, r.doc_id, r.freq, r.list, k) for r in B.read_lists(spark, f"file://{whole}", "barrel").collect()]
    assert sorted(back) == sorted((r.token_id, r.doc_id, r.freq, r.positions, r.barrel_id) for r in posts.collect())
    pairs = sorted({(t, k) for t, *_, k in back})
    (tmp_path / "map.bin").write_bytes(words(4, 4, len(pairs)) + b"".join(words(*p) for p in pairs))
    assert sorted(map(tuple, B.read_barrel_map(spark, f"file://{tmp_path}/map.bin").collect())) == pairs
