from datetime import datetime

from lexigrove.operators import shredding as S

SCHEMA = (
    "record_id long, source_tag string, paper_id string, metadata struct<title:string,authors:array<struct<first:string,middle:array<string>>>>, "
    + ", ".join(f"{a} array<struct<text:string,cite_spans:{S._SPAN},ref_spans:{S._SPAN},section:string>>" for a in S.AREAS)
    + ", bib_entries map<string,struct<title:string,year:int,venue:string>>, ref_entries map<string,struct<text:string,latex:string,type:string>>, node string, parent int"
)


def span(ref):
    return (0, 1, "x", ref)


LONG = "z" * 200_000
ROWS = [
    (1, "pmc", "P1", ("T", [("A", ["m", "n"]), None]), [("a", [], [span("F1"), None, span(None)], "S")], [None, ("b", None, [span("F2"), span("f1")], None)], None, {}, {"F1": ("cap", None, "figure")}, "clash", 3),
    (2, None, None, None, None, [], [(LONG, [span("B1")], [], "")], None, None, None, None),
    (3, "pdf", "P3", (None, None), None, None, None, {"B1": ("t", 1999, "v")}, {"F1": None}, "clash", 4),
    (None, "pdf", "P4", None, None, [("c", None, [span("F1")], "x")], None, None, {"F1": ("", "", "")}, None, None),
]


def nodes(spark, rows=ROWS):
    return S.paper_nodes(spark.createDataFrame(rows, SCHEMA))


def test_links(spark):
    got = {tuple(r) for r in S.span_links(nodes(spark)).collect()}
    assert got == {
        (1, "abstract", 0, 0, "F1"), (1, "abstract", 0, 1, ""), (1, "abstract", 0, 2, ""),
        (1, "body_text", 1, 0, ""), (1, "body_text", 1, 1, ""),
        (None, "body_text", 0, 0, "F1"),
    }


def test_entities(spark):
    n = nodes(spark)
    assert {tuple(r) for r in S.records(n).collect()} == {(1, "pmc", "P1", "T"), (2, None, None, None), (3, "pdf", "P3", None), (None, "pdf", "P4", None)}
    blocks = {(r.record_id, r.area, r.block_no): (r.section, r.text) for r in S.blocks(n).collect()}
    assert blocks == {(1, "abstract", 0): ("S", "a"), (1, "body_text", 0): (None, None), (1, "body_text", 1): (None, "b"), (2, "back_matter", 0): ("", LONG), (None, "body_text", 0): ("x", "c")}
    assert {(r.record_id, r.entry_key, r.text, r.type) for r in S.entries(n).collect()} == {(1, "F1", "cap", "figure"), (3, "F1", None, None), (None, "F1", "", "")}
    assert [tuple(r) for r in S.entries(n, "bib_entries", ("title", "year")).collect()] == [(3, "B1", "t", "1999")]
    assert {(r.record_id, r.section, r.ref_id) for r in S.spans(n, "cite_spans").collect()} == {(2, "", "B1")}


def test_arrays_of_scalars_keep_their_place(spark):
    rows = nodes(spark).where("label = 'middle' AND record = 1").orderBy("ordinal").collect()
    assert [(r.ordinal, r.scalar, r.parent) for r in rows] == [(0, "m", "/metadata/authors:0"), (1, "n", "/metadata/authors:0")]


def test_every_child_has_its_parent(spark):
    n = nodes(spark).where("record = 1").collect()
    ids = {r.node for r in n}
    assert len(ids) == len(n) and all(r.parent in ids for r in n if r.parent is not None)


def test_repeated_and_no_rows(spark):
    twice = S.span_links(nodes(spark, [ROWS[0], ROWS[0]])).collect()
    assert len(twice) == 5
    assert S.span_links(nodes(spark, [])).count() == 0


def test_other_schemas(spark):
    df = spark.createDataFrame([("k", {"a": 1, "b": None}, [["x"], ["y", "z"]], (3, ("deep",)))], "id string, m map<string,int>, aa array<array<string>>, s struct<n:int,t:struct<u:string>>")
    rows = {r.node: (r.kind, r.scalar, r.ordinal) for r in S.shred(df, "id").collect()}
    assert rows["/s/n"] == ("scalar", "3", 0) and rows["/s/t/u"] == ("scalar", "deep", 0) and rows["/s/t"][0] == "object"
    assert {rows[f"/m:{i}/@key"][1]: rows[f"/m:{i}/@value"][1] for i in (0, 1)} == {"a": "1", "b": None}
    assert rows["/aa:1"] == ("scalar", "[y, z]", 1)


def test_whole_tables(spark, tmp_path):
    person = "first:string,middle:array<string>,last:string,suffix:string"
    schema = (
        f"record_id long, source_tag string, paper_id string, metadata struct<title:string,authors:array<struct<{person},affiliation:struct<laboratory:string,institution:string,location:struct<addrLine:string,country:string>>,email:string>>>, "
        + ", ".join(f"{a} array<struct<text:string,cite_spans:{S._SPAN},ref_spans:{S._SPAN},section:string>>" for a in S.AREAS)
        + f", bib_entries map<string,struct<ref_id:string,title:string,authors:array<struct<{person}>>,year:int,venue:string,volume:string,issn:string,pages:string>>"
        + ", ref_entries map<string,struct<text:string,latex:string,type:string>>, ingested_at timestamp_ntz"
    )
    when = datetime(2020, 1, 2, 3, 4, 5, 6)
    one = ("A", ["m", None, "n"], "B", "Jr", ("lab", "inst", ("street", "land")), "a@b")
    row = (1, "pmc", "P1", ("T", [one, None, ("C", [], "D", None, None, None)]), [("a", [(1, 2, "c", "B1")], [(3, None, "r", "F1")], "S")], None, None,
           {"B1": ("b1", "t", [("E", ["x"], "F", "s")], 1999, "v", "7", "i", "1-2"), "B2": ("b2", None, None, None, None, None, None, None)}, {"F1": ("cap", "x^2", "figure")}, when)
    bare = (None, "pdf", None, ("U", [("G", ["h"], None, None, (None, None, None), None)]), None, None, None, None, None, None)
    spark.createDataFrame([row, bare], schema).write.parquet(f"file://{tmp_path}/papers.parquet")
    got = {q: {tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in f(spark, f"file://{tmp_path}").collect()} for q, f in S.queries().items() if "whole" in q or "authors" in q or "affil" in q}
    assert got == {
        "p2_whole_records": {(1, "pmc", "P1", "T", when), (None, "pdf", None, "U", None)},
        "p2_whole_ref_spans": {(1, "abstract", 0, 0, "S", 3, None, "r", "F1")},
        "p2_whole_cite_spans": {(1, "abstract", 0, 0, "S", 1, 2, "c", "B1")},
        "p2_whole_ref_entries": {(1, "F1", "cap", "x^2", "figure")},
        "p2_whole_bib_entries": {(1, "B1", "b1", "t", 1999, "v", "7", "i", "1-2"), (1, "B2", "b2", None, None, None, None, None, None)},
        "p2_authors": {
            (1, 0, "A", "m||n", "B", "Jr", "lab", "inst", "street", "land", "a@b"), (1, 1, *[None] * 9),
            (1, 2, "C", None, "D", *[None] * 6), (None, 0, "G", "h", *[None] * 7),
        },
        "p2_bib_authors": {(1, "B1", 0, "E", "x", "F", "s")},
        "p2_affiliations": {(1, 0, "lab", "inst", "street", "land"), (None, 0, None, None, None, None)},
    }
