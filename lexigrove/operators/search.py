"""Term lookup in an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.operators.index import Index


class UnknownTerm(LookupError):
    """The term has no entry in the lexicon."""


def term_lookup(index: Index, term: str, top: int = 10, heavy: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """term, token_id, doc_count, doc_id, freq: the first ``top`` documents, in their order, that hold ``term``.

    The term is compared as given, without normalization. An unknown term gives no row, or
    :class:`UnknownTerm` where ``strict``. ``heavy``: doc-only postings to read instead where they
    hold the token.
    """
    entry = index.lexicon.where(F.col("token") == term)
    found = entry.head()  # at most one row: tokens are unique
    if found is None:
        if strict:
            raise UnknownTerm(term)
        return index.postings.limit(0).select(F.lit(term).alias("term"), "token_id", F.lit(0).cast("long").alias("doc_count"), "doc_id", "freq")
    source = index.postings
    if heavy is not None and not heavy.where(F.col("token_id") == found.token_id).isEmpty():
        source = heavy
    rows = source.where(F.col("token_id") == found.token_id).select("doc_id", "freq")
    return rows.orderBy("doc_id").limit(top).select(F.lit(term).alias("term"), F.lit(found.token_id).alias("token_id"), F.lit(found.doc_freq).alias("doc_count"), "doc_id", "freq")
