import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrove.functions import text as X


def slow_tokens(text, stop):
    out, cur = [], ""
    for ch in unicodedata.normalize("NFKC", text).lower() + " ":
        if ch.isalnum():
            cur += ch
        else:
            if cur and cur not in stop:
                out.append(cur)
            cur = ""
    return out


@pytest.mark.parametrize(
    "text, expected",
    [("Ångström ①", ["ångström", "1"]), ("ΟΔΟΣ", ["οδος"]), ("İSTANBUL", ["i", "stanbul"]), ("ﬁne", ["fine"]), ("virus_and_cell", ["virus", "and", "cell"]), ("", []), (None, [])],
)
def test_tokens_without_stopwords(text, expected):
    assert X.tokenize(text, frozenset()) == expected


def test_builtin_stopwords():
    assert len(X.STOPWORDS) == 23
    assert X.tokenize("the virus and_the cell") == ["virus", "cell"]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_matches_character_rule(text):
    assert X.tokenize(text) == slow_tokens(text, X.STOPWORDS)


def test_stopword_file(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("Virus\n\n  \nﬁne\n")
    stop = X.read_stopwords(spark, str(tmp_path / "stop.txt"))
    assert stop == X.STOPWORDS | {"virus", "fine"}


def test_with_tokens_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "a b c", "x"), (2, None, "y"), (3, "", None)], "id int, text string, tokens string")
    rows = {r.id: r.tokens for r in X.with_tokens(df).collect()}
    assert rows == {1: ["b", "c"], 2: [], 3: []}
