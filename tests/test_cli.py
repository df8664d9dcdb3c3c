import json

import pytest
from pyspark.sql import functions as F

from lexigrove import cli
from lexigrove.sources import store
from lexigrove.functions.scalars import file_key, file_stem, human_size


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    (root / "pdf_json").mkdir()
    for i in range(45):
        text = f"virus cell{i % 7} " + ("serum " * (i % 3))
        (root / "pdf_json" / f"p{i:02}.json").write_text(json.dumps({"paper_id": f"P{i}", "body_text": [{"text": text}]}))
    (root / "pdf_json" / "bad.json").write_text("{")
    folder = f"file://{root}/index"
    assert cli.main(["build", f"file://{root}", folder], spark) == 0
    return root, folder


def test_lookup(stored, spark, capsys):
    _, folder = stored
    assert cli.main(["lookup", folder, "serum", "--top", "2"], spark) == 0
    assert "doc_id" in capsys.readouterr().out
    assert cli.main(["lookup", folder, "SERUM"], spark) == store.NO_TERM
    assert cli.main(["lookup", f"{folder}x", "serum"], spark) == store.NO_INDEX


def test_reports(stored, spark, capsys):
    root, folder = stored
    for command in ("heavy", "barrels", "frequent", "validate", "timings"):
        assert cli.main([command, folder], spark) == 0
    assert cli.main(["validate", folder, "--sample", "2"], spark) == cli.main(["validate", folder, "--token", "1"], spark) == 0
    assert cli.main(["timings", folder, "--terms", "virus,nothing", "--warm"], spark) == 0
    assert cli.main(["sweep"], spark) == 0
    capsys.readouterr()
    assert cli.main(["heavy", folder, "--threshold-kb", "0.1", "--top", "2", "--write"], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 3
    assert cli.main(["heavy", folder], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 3
    assert cli.main(["lookup", folder, "virus"], spark) == 0
    assert "heavy list" in (said := capsys.readouterr().out) and "in 45 documents" in said
    assert cli.main(["frequent", folder], spark) == 0
    assert "virus" in capsys.readouterr().out
    stats = json.loads((root / "index/storage_stats.json").read_text())
    assert stats["documents"] == 45 and stats["vocabulary"] == 9 and stats["artifacts"]["lexicon.bin"] > 0


def test_empty_corpus(spark, tmp_path):
    (tmp_path / "pdf_json").mkdir()
    assert cli.main(["build", f"file://{tmp_path}", f"file://{tmp_path}/index"], spark) == 1


def test_scalars(spark):
    df = spark.createDataFrame([(0, "a/b%20c.xml.json"), (1023, "x"), (1024, ".h"), (1536 * 1024, "d/e.f"), (5 * 1024**4 * 1024, "z.json"), (None, None), (0, "a+b%2Bc.json")], "n long, p string")
    rows = df.select(human_size(F.col("n")).alias("s"), file_stem(F.col("p")).alias("stem"), file_key(F.col("p")).alias("key")).collect()
    assert [r.s for r in rows] == ["0.00 B", "1023.00 B", "1.00 KB", "1.50 MB", "5120.00 TB", None, "0.00 B"]
    assert [(r.stem, r.key) for r in rows[:2]] == [("b c.xml", "b c"), ("x", "x")] and rows[6].key == "a+b+c"


def test_ids_of(stored, spark):
    from lexigrove.operators.index import build_index

    ix = build_index(spark.createDataFrame([(1, "p", "b2 a1")], "n int, paper_id string, text string"), ["n"])
    got = ix.ids_of(spark.createDataFrame([("a1",), ("zz",), ("b2",)], "token string"))
    assert {r.token: r.token_id for r in got.collect()} == {"a1": 1, "zz": -1, "b2": 0}


def test_reports_print_every_row(spark, capsys, monkeypatch):
    n = 1500
    tables = {
        "barrel_map": spark.range(n).selectExpr("id AS token_id", "16 AS barrel_id"),
        "lexicon": spark.range(n).selectExpr("id AS token_id", "concat('t', id) AS token"),
        "heavy_manifest": spark.range(30).selectExpr("id * 7 % 30 AS token_id", "id * 7 % 30 div 2 AS bytes"),
        "postings": spark.range(150).selectExpr("id AS token_id", "CAST(id AS INT) AS barrel_id", "1 AS freq"),
    }
    monkeypatch.setattr(cli.store, "read_index_table", lambda _, __, name: tables[name])
    lines = {}
    for command in ("heavy", "barrels", "frequent"):
        assert cli.main([command, "x"], spark) == 0
        lines[command] = [x.split("\t") for x in capsys.readouterr().out.splitlines()[1:]]
    assert lines["frequent"] == [[str(i), f"t{i}"] for i in range(n)]
    assert lines["heavy"] == [[str(i), str(i // 2)] for i in sorted(range(30), key=lambda i: (-(i // 2), i))]
    assert [x[0] for x in lines["barrels"]] == [str(i) for i in range(150)]
