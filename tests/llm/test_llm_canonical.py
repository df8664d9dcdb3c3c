import random
import unicodedata

import pytest

from lexigrove.llm import canonical as C


@pytest.fixture(scope="module")
def counts(spark):
    df = spark.createDataFrame([("the receptor of a cop saw the sea and the ace in Oslo",)] * 3 + [("Москва столица и город реки",), (None,), ("",)], "text string")
    return C.bigram_counts(df)


def disguise(text, rng):
    out = []
    for ch in text:
        r = rng.random()
        if ch in C.VARIANTS and r < 0.3:
            ch = rng.choice(next(g for g in C.LOOK_ALIKES if ch in g))
        elif ch in C.VARIANTS and r < 0.4:
            ch = rng.choice(list(C.VARIANTS[ch].values()))
        elif ch == " " and r < 0.5:
            ch = rng.choice("   　\t")
        elif "!" <= ch <= "~" and r > 0.8:
            ch = chr(ord(ch) + 0xFEE0)
        elif not ch.isascii() and r < 0.7:
            ch = unicodedata.normalize("NFD", ch)
        if rng.random() < 0.1:
            ch += rng.choice("​‌‍⁠﻿­")
        out.append(ch)
    return "".join(out)


@pytest.mark.parametrize("text", ["The receptor of naïve cops, at 5 µL (Fig. 2).", "RÉSUMÉ of Ëve's GDFL Nu", "ace", "a", "Ångström - fine", "Москва и сор", "μ receptor βeta", "x\ny  z"])
def test_same_look_same_form(counts, text):
    look = C.LookAlikes(counts)
    want = look.text(text)
    rng = random.Random(1)
    for _ in range(200):
        assert look.text(disguise(text, rng)) == want
    assert look.text(want) == want


def test_differences_stay(counts):
    look = C.LookAlikes(counts)
    forms = ["a b", "ab", "a  b", "A b", "á b", "a b.", "a c", "1 b", "l b", "I b"]
    assert len({look.text(x) for x in forms}) == len(forms)
    assert look.text("Москва") == "Москва"
    assert look.text("rесерtоr") == "receptor"


def test_pairs_and_classes(spark):
    t = "The receptor was low in Zürnau."
    rows = [
        (1, t, "x"), (2, t, "x"), (3, t.replace("o", "о"), "x"), (4, unicodedata.normalize("NFD", t), "x"), (5, t.upper(), "x"), (6, None, "x"), (7, "", "x"),
        (8, " ​ ", "x"), (9, " ", "x"), (10, "b" * 100_000 + " c", "x"), (11, "b" * 100_000 + " c", "x"), (1, t, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, look string")
    got = {tuple(r) for r in C.look_alike_pairs(df).collect()}
    assert got == {(1, 3), (2, 3), (1, 4), (2, 4), (3, 4), (10, 11)}
    classes = {r.doc_id: (r.class_id, r.spelling_id, r.spellings) for r in C.look_alike_classes(df).collect()}
    assert classes[4] == (1, 4, 3) and classes[2] == (1, 1, 3) and classes[5] == (5, 5, 1) and classes[11] == (10, 11, 2) and 6 not in classes and 8 not in classes
    out = {r.doc_id: r.canonical for r in C.canonical(df).collect()}
    assert out[3] == t and out[6] is None and out[7] == ""
    assert C.look_alike_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("end", ["\r", "\r\n", "\x85", "\u2028", "\u2029"])
def test_line_ends(spark, end):
    t = "The quick fox"
    df = spark.createDataFrame([(1, t + "\n"), (2, t + end), (3, t), (4, t + end + "x"), (5, t + "\nx")], "doc_id long, text string")
    assert {tuple(r) for r in C.look_alike_pairs(df).collect()} == {(1, 2), (4, 5)}
    assert C.unstable(df).head().changed == 0


def test_scripts(counts):
    look = C.LookAlikes(counts)
    assert look.text("ꓡоng ꓓ\u0301ark Rӏver") == "Long D\u0301ark Rlver"
    assert look.text("café") == look.text("саf\u0435\u0301") == "café"
    assert C.script_of("ß") == "latin" and C.script_of("中") == "other"
    for g in C.LOOK_ALIKES:
        assert len(set(g)) == len(g) and len({look.text(f"тд {x}") for x in g}) == 1
