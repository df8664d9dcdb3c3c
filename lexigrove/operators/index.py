"""Lexicon, forward index, inverted index and positional postings of a corpus.

All tables come from one chain: token lists, dense document numbers, first occurrences, dense
token numbers, postings. The order of documents is that of the column given as ``order``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.functions.text import STOPWORDS, with_tokens
from lexigrove.operators.numbering import dense_number
from lexigrove.session import materialize


#: Document numbers in one row of an inverted list.
BLOCK = 1 << 16
#: Share of documents from which on a token is hot: its number is broadcast, and no row of its is shuffled by token. At most HOT_ROWS tokens are;
#: where more are so common, only commoner ones.
HOT_SHARE = 0.001
HOT_ROWS = 200_000


class EmptyCorpus(ValueError):
    """No document is left after stopwords."""


@dataclass
class Index:
    """``docs``: doc_id, paper_id, tokens. ``lexicon``: token_id, token, doc_freq. ``hot``, ``rare``: token_id, doc_id, freq, positions
    of tokens in at least ``least`` documents, and of the others; both are stored in runs sorted by token, so that pages of other tokens are skipped.

    ``skipped`` counts the source documents without a token; they take no number.
    """

    docs: DataFrame
    lexicon: DataFrame
    hot: DataFrame
    rare: DataFrame
    sources: int
    least: float

    @property
    def postings(self) -> DataFrame:
        """token_id, doc_id, freq, positions. A filter on token_id reaches both scans and skips the pages of other tokens."""
        return self.hot.unionByName(self.rare)

    def by_token(self, pairs: DataFrame, of_tokens: DataFrame, key: str = "token") -> DataFrame:
        """``pairs`` of documents and tokens joined with a table of tokens that has doc_freq: hot tokens by a broadcast, the others, none of them in many rows, by a shuffle."""
        hot = F.broadcast(of_tokens.where(F.col("doc_freq") >= self.least))  # at most HOT_ROWS
        rest = pairs.join(hot.select(key), key, "left_anti").join(of_tokens.where(F.col("doc_freq") < self.least), key)
        return pairs.join(hot, key).unionByName(rest)

    @property
    def spark(self):
        return self.docs.sparkSession

    # Tables

    def doc_ids(self) -> DataFrame:
        return self.docs.select("doc_id", "paper_id")

    def tokens(self) -> DataFrame:
        return self.docs.select("doc_id", F.posexplode("tokens").alias("pos", "token"))

    def forward(self) -> DataFrame:
        """doc_id, token_ids: the tokens of each document in order, as numbers.

        Postings hold each pair of document and token once, so the shuffle moves position lists, not
        occurrences; a group is one document.
        """
        pairs = self.postings.select("doc_id", F.explode(F.transform("positions", lambda p: F.struct(p.alias("pos"), F.col("token_id")))).alias("x"))
        return pairs.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["token_id"]).alias("token_ids"))

    def doc_freq(self) -> DataFrame:
        return self.lexicon.select("token_id", "doc_freq")

    def ids_of(self, terms: DataFrame, term: str = "token") -> DataFrame:
        """``terms`` with the column token_id, -1 for terms that the lexicon lacks; it is not changed."""
        known = self.lexicon.select("token_id", F.col("token").alias("__token"))
        return terms.join(known, F.col(term) == F.col("__token"), "left").drop("__token").withColumn("token_id", F.coalesce("token_id", F.lit(-1)))

    def inverted(self, block: int = BLOCK) -> DataFrame:
        """token_id, doc_freq, block_no, doc_ids ascending: the list of each token, a row for each ``block`` of document numbers.

        So no row or task holds more than a block, however many documents have the token; its whole list
        is its blocks in order.
        """
        lists = self.postings.groupBy("token_id", F.floor(F.col("doc_id") / F.lit(block)).alias("block_no")).agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))
        n = F.sum(F.size("doc_ids")).over(Window.partitionBy("token_id")).cast("long")  # one row a block
        return lists.select("token_id", n.alias("doc_freq"), "block_no", "doc_ids")

    # Statistics

    def lexicon_stats(self) -> DataFrame:
        return self.forward_stats().select("documents_indexed", "unique_terms", "avg_doc_length")

    def forward_stats(self) -> DataFrame:
        n = self.docs.agg(F.count("*").alias("documents_indexed"), F.sum(F.size("tokens")).cast("long").alias("total_tokens"))
        v = self.lexicon.agg(F.count("*").alias("unique_terms"))
        return n.crossJoin(v).select(  # one row each
            "documents_indexed",
            (F.lit(self.sources) - F.col("documents_indexed")).alias("docs_skipped"),
            "unique_terms",
            "total_tokens",
            (F.col("total_tokens") / F.col("documents_indexed")).alias("avg_doc_length"),
            F.col("documents_indexed").alias("doc_ids_recorded"),
        )

    def inverted_stats(self) -> DataFrame:
        n = self.docs.agg(F.count("*").alias("documents_indexed"))
        p = self.postings.agg(F.count("*").alias("total_postings"), F.sum("freq").cast("long").alias("total_token_occurrences"))
        v = self.lexicon.agg(F.count("*").alias("unique_tokens"))
        return n.crossJoin(p).crossJoin(v).select(  # one row each
            "unique_tokens",
            "total_postings",
            (F.col("total_postings") / F.col("unique_tokens")).alias("avg_postings_per_token"),
            "documents_indexed",
            "total_token_occurrences",
        )


def _positions(numbers: Broadcast, hot: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, token, positions: each token of a document once, without a shuffle, as a document is one row.

    ``numbers`` of hot tokens: either these, as numbers, are given, or the others, as they are. A batch comes in the order of tokens, then documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for b in batches:
            lists = b.column(1)
            offsets = np.asarray(lists.offsets)
            words = lists.flatten().dictionary_encode()
            number = np.array([known.get(w, -1) for w in words.dictionary.to_pylist()], np.int64)
            code, size = np.asarray(words.indices), np.diff(offsets)
            keep = np.flatnonzero((number[code] >= 0) == hot)
            doc = np.repeat(np.arange(len(size)), size)[keep]
            place = keep - np.repeat(offsets[:-1] - offsets[0], size)[keep]
            key = (number[code] if hot else code)[keep]
            order = np.argsort(key, kind="stable")  # documents and places are ascending, and stay so
            key, doc, place = key[order], doc[order], place[order]
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])][: len(key)])
            token = pa.array(key[start]) if hot else words.dictionary.take(pa.array(key[start]))
            positions = pa.ListArray.from_arrays(pa.array(np.append(start, len(key)).astype(np.int32)), pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc[start])), token, positions], ["doc_id", "token", "positions"])

    return run


def build_index(
    docs: DataFrame,
    order: list[str],
    paper_id: str = "paper_id",
    text: str = "text",
    stopwords: frozenset[str] = STOPWORDS,
    limit: int | None = None,
    hot_share: float = HOT_SHARE,
) -> Index:
    """Index of ``docs``. Documents without a token after stopwords are skipped and take no number.

    ``limit``: index only the first so many numbered documents; ``None`` for all. Raises
    :class:`EmptyCorpus` where nothing is left to index, ``ValueError`` for a negative limit.
    """
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    named = docs.select(*[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)], F.col(paper_id).cast("string").alias("paper_id"), F.col(text).alias("__text"))
    tokens = lambda df: with_tokens(df, "__text", "tokens", stopwords).where(F.size("tokens") > 0)
    numbered = dense_number(named, [f"__o{k}" for k in range(len(order))], "doc_id", then=tokens).select("doc_id", "paper_id", "tokens")
    if limit is not None:
        numbered = numbered.where(F.col("doc_id") < limit)
    if numbered.isEmpty():
        raise EmptyCorpus("no documents to index")
    # Among a document's distinct tokens, which keep their order, each token is once; so the first document decides,
    # and both values are kept in a hash table, which a struct is not.
    first = numbered.select("doc_id", F.posexplode(F.array_distinct("tokens")).alias("pos", "token")).groupBy("token")
    first = first.agg(F.min("doc_id").alias("__doc"), F.min_by("pos", "doc_id").alias("__pos"), F.count("*").alias("doc_freq"))
    lexicon = dense_number(first, ["__doc", "__pos"], "token_id").select("token_id", "token", "doc_freq")
    least = max(2.0, numbered.count() * hot_share)
    while lexicon.where(F.col("doc_freq") >= least).count() > HOT_ROWS:
        least *= 2
    hot = lexicon.where(F.col("doc_freq") >= least).select("token", "token_id").toArrow().to_pydict()  # at most HOT_ROWS
    numbers = numbered.sparkSession.sparkContext.broadcast(dict(zip(hot["token"], hot["token_id"], strict=True)))
    lists = numbered.select("doc_id", "tokens")
    pairs = lists.mapInArrow(_positions(numbers, True), "doc_id long, token long, positions array<int>")
    freq = F.size("positions").alias("freq")
    stored = materialize(pairs.select(F.col("token").alias("token_id"), "doc_id", freq, "positions"))
    rare = lists.mapInArrow(_positions(numbers, False), "doc_id long, token string, positions array<int>").join(lexicon.where(F.col("doc_freq") < least), "token")
    rare = materialize(rare.select("token_id", "doc_id", freq, "positions").sortWithinPartitions("token_id", "doc_id"))
    return Index(numbered, lexicon, stored, rare, docs.count(), least)
