"""Unicode-exact tokenization.

Spark has neither NFKC nor the letter and digit classes of a current Unicode version, so tokens
are made in Arrow batches by Python; everything after that stays in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The built-in stopwords.
STOPWORDS = frozenset(
    "a an the and or but if while to of in for on with as by is it this that be are from".split()
)

#: A maximal run of characters for which ``str.isalnum`` holds.
WORD = re.compile(r"[^\W_]+")


def nfkc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def tokenize(text: str | None, stopwords: frozenset[str] = STOPWORDS) -> list[str]:
    """Tokens of ``text``: NFKC, lower case, maximal runs of letters and digits, no stopwords. Null gives none."""
    if not text:
        return []
    return [w for w in WORD.findall(nfkc(text).lower()) if w not in stopwords]


def stopword_set(extra: Iterable[str] = ()) -> frozenset[str]:
    """The built-in stopwords and ``extra`` ones, brought to the form of tokens; blank words are left out."""
    return STOPWORDS | {nfkc(w.strip()).lower() for w in extra if w.strip()}


def read_stopwords(spark: SparkSession, path: str) -> frozenset[str]:
    """Stopwords of a file with one word a line, and the built-in ones."""
    return stopword_set(r.value for r in spark.read.text(path).toLocalIterator())


def with_token_lists(df: DataFrame, columns: dict[str, str], stopwords: frozenset[str] = STOPWORDS) -> DataFrame:
    """``df`` with the array of tokens of each key of ``columns`` in the column that it names, instead of the text; one pass for all of them.

    Null and empty texts give an empty array. A column of ``df`` that already has such a name is replaced.
    """
    kept = [c for c in df.columns if c not in columns and c not in columns.values()]
    new = list(columns.values())
    schema = df.select(*[F.col(f"`{c}`") for c in kept], *[F.array(F.lit("")).alias(c) for c in new]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [pa.array([tokenize(t, stopwords) for t in c.to_pylist()], pa.list_(pa.string())) for c in b.columns[len(kept) :]]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *lists], [*kept, *new])

    texts = [F.col(f"`{c}`").cast("string").alias(to) for c, to in columns.items()]
    return df.select(*[F.col(f"`{c}`") for c in kept], *texts).mapInArrow(run, schema)


def with_tokens(df: DataFrame, text: str = "text", to: str = "tokens", stopwords: frozenset[str] = STOPWORDS) -> DataFrame:
    """:func:`with_token_lists` of one column."""
    return with_token_lists(df, {text: to}, stopwords)
