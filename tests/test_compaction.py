import json
from datetime import datetime
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrove.operators import compaction as C

T = datetime(2030, 1, 1)
SCHEMA = "file_id long, path string, content string, written_at timestamp, raw string, piece int"


def rec(i, k, text="t", **more):
    return {"paper_id": i, "block_no": k, "text": text} | more


def files(*contents):
    return [(n, f"d/{n}.json", c, T, "clash", 5) for n, c in enumerate(contents)]


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.text(max_size=5), JSON, max_size=4), max_size=4), st.sampled_from(["array", "lines", "pretty"]), st.floats(0, 1), st.booleans())
def test_slices_are_the_whole_objects(objects, layout, cut, ascii_):
    if layout == "array":
        text = json.dumps(objects, ensure_ascii=ascii_)
    else:
        text = "\r\n".join(json.dumps(o, ensure_ascii=ascii_, indent=2 if layout == "pretty" else None) for o in objects)
    data = ("﻿" + text).encode("utf-8", "surrogatepass")
    assert [json.loads(data[s:e].decode("utf-8", "surrogatepass")) for s, e in C.object_slices(data)] == objects
    short = data[: int(len(data) * cut)]
    got = [json.loads(short[s:e].decode("utf-8", "surrogatepass")) for s, e in C.object_slices(short)]
    assert got == objects[: len(got)]


def consolidated(spark, tmp_path, rows, target=C.TARGET_BYTES):
    folder = f"file://{tmp_path}/out"
    m = C.consolidate(spark.createDataFrame(rows, SCHEMA), folder, target=target)
    return folder, m, [json.loads(bytes(r.raw)) for r in C.read_containers(spark, folder, m).collect()]


def test_each_record_once(spark, tmp_path):
    long = "x" * 300_000
    rows = files(
        json.dumps(rec("A", 0)), "", None, json.dumps([rec("A", 0), rec("A", 1, 'q"}{')]), json.dumps(rec("B", 0, long), indent=1),
        json.dumps(rec("B", 1)) + "\n" + json.dumps(rec("B", 2))[:-3], json.dumps({"text": "t", "block_no": 3, "paper_id": "B"}), "nonsense {", json.dumps(rec("C", 0, "")), json.dumps({"text": "no key"}),
    )
    _, m, got = consolidated(spark, tmp_path, rows + rows)
    assert sorted((r.get("paper_id") or "", r.get("block_no", -1)) for r in got) == [("", -1), ("A", 0), ("A", 1), ("B", 0), ("B", 1), ("B", 3), ("C", 0)]
    assert {r["text"] for r in got} >= {'q"}{', long, ""}
    assert m.count() == 1


def test_last_version_stays_and_bins_are_cut_by_bytes(spark, tmp_path):
    rows = files(*[json.dumps(rec("A", k, "y" * 100)) for k in range(50)])
    rows.append((99, "d/new.json", json.dumps(rec("A", 7, "new")), datetime(2031, 1, 1), "clash", 5))
    _, m, got = consolidated(spark, tmp_path, rows, target=2000)
    assert len(got) == 50 and {r["text"] for r in got if r["block_no"] == 7} == {"new"}
    assert m.count() == 4 and max(r.raw_bytes for r in m.collect()) <= 2200


def test_empty_table(spark, tmp_path):
    _, m, got = consolidated(spark, tmp_path, [])
    assert m.count() == 0 and got == []


def test_damage_is_noticed(spark, tmp_path):
    folder, m, _ = consolidated(spark, tmp_path, files(json.dumps(rec("A", 0))))
    path = next(Path(f"{tmp_path}/out").glob("bin-*.zst"))
    path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    data = path.read_bytes()
    path.write_bytes(data[:-1] + bytes([data[-1] ^ 1]))
    with pytest.raises(Exception, match="checksum"):
        C.read_containers(spark, folder, m).collect()


def test_records_without_a_whole_key_are_kept(spark, tmp_path):
    loose = [{"text": "a"}, {"text": "b"}, {"paper_id": "A", "text": "a"}, {"paper_id": "A", "text": "b"}, {"block_no": 1, "text": "a"}, {"paper_id": "A", "block_no": None, "text": "a"}]
    typed = [rec("A", 3), rec("A", "3"), rec("A", 3.5), rec("A", [3]), rec("A", "x"), rec(5, 3), rec("5", 3)]
    rows = files(json.dumps(loose), "\n".join(map(json.dumps, typed)), json.dumps(loose[:3]), json.dumps([{"text": "a", "deep": {"paper_id": "A", "block_no": 3}}]), r'{"paper_id": "A", "block_no": 3, "text": "t"}')
    _, m, got = consolidated(spark, tmp_path, rows)
    want = [*loose, *typed, {"text": "a", "deep": {"paper_id": "A", "block_no": 3}}]
    assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, want))
    assert m.agg({"records": "sum"}).head()[0] == len(want)


def test_equal_keyless_objects_of_one_file_stay(spark, tmp_path):
    _, _, got = consolidated(spark, tmp_path, files('{"text": "a"}\n{"text": "a"}', '{"text": "a"}'))
    assert got == [{"text": "a"}] * 2


def test_lines_and_frames_are_copied_as_they_are(spark, tmp_path):
    import zstandard

    lines = "".join(json.dumps(rec("A", k)) + "\n" for k in range(5)).encode()
    frames = zstandard.ZstdCompressor(level=7).compress(lines.replace(b'"A"', b'"Z"'))
    two = zstandard.compress(json.dumps(rec("Y", 0)).encode() + b"\n") + zstandard.compress(json.dumps(rec("Y", 1)).encode() + b"\n")
    cut = zstandard.compress(json.dumps(rec("X", 0)).encode() + b"\n") + zstandard.compress(b"x" * 999)[:-3]
    rows = [(n, "p", bytearray(c), T, "r", 0) for n, c in enumerate([b"\xef\xbb\xbf" + lines[:-1], frames, two, cut, b"[" + lines[:-1].replace(b"\n", b",\r\n") + b"]"])]
    folder = f"file://{tmp_path}/out"
    m = C.consolidate(spark.createDataFrame(rows, SCHEMA.replace("content string", "content binary")), folder)
    got = [bytes(r.raw) for r in C.read_containers(spark, folder, m).collect()]
    assert sorted(got) == sorted([*lines.splitlines(), *lines.replace(b'"A"', b'"Z"').splitlines(), *(json.dumps(rec(*k)).encode() for k in (("Y", 0), ("Y", 1), ("X", 0)))])
    [path] = (tmp_path / "out").glob("bin-*.zst")
    assert frames in path.read_bytes() and two in path.read_bytes()


def test_stretches():
    c = b'{"a":1}\n{"b":2}\n{"c":\n3}\n{"d":4},{"e":5}'
    runs = list(C._stretches(c, list(C.object_slices(c))))
    assert [(c[s:e], n) for s, e, n in runs] == [(b'{"a":1}\n{"b":2}', 2), (b'{"c":\n3}', 1), (b'{"d":4}', 1), (b'{"e":5}', 1)]
