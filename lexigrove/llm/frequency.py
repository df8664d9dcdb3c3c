"""How often every term occurs, in how many documents, and whether it is too rare or too common."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.text import STOPWORDS, WORD, nfkc

#: Entries that a task's table of partial counts may have before it is sent on.
FLUSH = 300_000
RARE_BELOW = 3
COMMON_SHARE = 0.05


def words(text: str) -> list[str]:
    """Tokens with stopwords."""
    return WORD.findall(nfkc(text).lower())


def term_counts(docs: DataFrame, text: str = "text", split: Callable[[str], list[str]] = words, drop: frozenset[str] = STOPWORDS) -> DataFrame:
    """term, occurrences, documents over all of ``docs``; null and empty texts hold no term.

    Each task combines its documents' counts in a hash table of bounded size, so that a term leaves a
    task a few times at most, however common it is; the shuffle then adds these up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occ: Counter[str] = Counter()
        df: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            for w in drop:
                occ.pop(w, None)
            keys = list(occ)
            b = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(occ.values(), pa.int64()), pa.array([df[k] for k in keys], pa.int64())], ["term", "occurrences", "documents"])
            occ.clear()
            df.clear()
            return b

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    w = split(t)
                    occ.update(w)
                    df.update(set(w))
            if len(occ) > FLUSH:
                yield out()
        yield out()

    parts = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "term string, occurrences long, documents long")
    return parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))


def marked_terms(docs: DataFrame, text: str = "text", rare_below: int = RARE_BELOW, common_share: float = COMMON_SHARE) -> DataFrame:
    """token, occurrences, documents, mark: ``rare`` in fewer than ``rare_below`` documents, ``common`` in at least ``common_share`` of all rows, else null.

    A term that is both, which takes a very small table, is ``rare``.
    """
    n = docs.count()
    mark = F.when(F.col("documents") < rare_below, "rare").when(F.col("documents") >= F.lit(n * common_share), "common")
    return term_counts(docs, text).select(F.col("term").alias("token"), "occurrences", "documents", mark.alias("mark"))


def head_terms(counts: DataFrame, n: int, share: float) -> DataFrame:
    """Terms in at least ``share`` of ``n`` documents. At most mean distinct terms a document / ``share`` of them exist, however large the corpus."""
    return counts.where(F.col("documents") >= F.lit(max(1.0, n * share)))
