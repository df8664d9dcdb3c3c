import json

import pytest

from lexigrove.sources.papers_json import read_papers


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_corpus(spark, tmp_path):
    doc = lambda i, *t: {"paper_id": i, "metadata": {"title": "T"}, "abstract": [{"text": "abs"}], "body_text": [{"text": x} for x in t]}
    write(tmp_path / "pmc_json/PMC1.xml.json", doc("", "body", "", "more"))
    write(tmp_path / "pmc_json/a b.json", doc("X2"))
    write(tmp_path / "pmc_json/a+b.json", doc("X3"))
    write(tmp_path / "pdf_json/a%20b.json", doc(None))
    write(tmp_path / "pdf_json/PMC1.json", doc("other", "pdf"))
    write(tmp_path / "pdf_json/bad.json", '{"paper_id": ')
    write(tmp_path / "pdf_json/list.json", "[{}, {}]")
    write(tmp_path / "pdf_json/none.json", {"paper_id": "E"})
    good, bad = read_papers(spark, f"file://{tmp_path}")
    rows = {r.paper_id: (r.source, r.title, r.text) for r in good.collect()}
    assert rows == {"PMC1.xml": ("pmc", "T", "abs\nbody\nmore"), "X2": ("pmc", "T", "abs"), "X3": ("pmc", "T", "abs"), "a%20b": ("pdf", "T", "abs"), "E": ("pdf", "", "")}
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in bad.collect()} == {"bad.json": "malformed", "list.json": "not an object"}


def test_missing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_papers(spark, f"file://{tmp_path}/nowhere")
    good, bad = read_papers(spark, f"file://{tmp_path}")
    assert good.count() == bad.count() == 0
