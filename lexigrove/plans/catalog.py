"""The named queries of the index over the ``documents`` table, and of the general operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.functions.text import with_token_lists
from lexigrove.operators import barrels as B
from lexigrove.operators import compaction, ranking, shredding, skew, storage, validate
from lexigrove.operators.index import Index, build_index
from lexigrove.operators.search import term_lookup
from lexigrove.session import drop_tables, file_state, stored_tables
from lexigrove.sources.tables import spread, table

LOOKUP_TERM = "receptor"
RANK_WORD = "receptor"
RANK_WORDS = ["receptor", "analysis", "households"]
FORWARD_LIMIT = 100


_built: dict[tuple[str, str, int | None], tuple[tuple, B.Barrels, set[str]]] = {}


def barrels_of(spark: SparkSession, folder: str, limit: int | None = None) -> B.Barrels:
    """The barrels, and with them the index, of a folder's documents, or of the first ``limit`` that are indexed: stored tables, built once an application and folder.

    Where the documents' files have changed since, the index is built anew and the old one's tables are dropped.
    """
    key = (spark.sparkContext.applicationId, folder, limit)
    state = file_state(spark, f"{folder}/documents.parquet")
    if key in _built and _built[key][0] != state:
        drop_tables(spark, stored_tables(spark) - _built.pop(key)[2])
    if key not in _built:
        before = stored_tables(spark)
        docs = table(spark, folder, "documents").select("doc_id", F.col("doc_id").cast("string").alias("paper_id"), "text")
        barrels = B.Barrels(build_index(docs, ["doc_id"], limit=limit))
        _built[key] = (state, barrels, stored_tables(spark) - before)
    return _built[key][1]


def index_of(spark: SparkSession, folder: str, limit: int | None = None) -> Index:
    return barrels_of(spark, folder, limit).index


def _hits_in(tokens: Column, code: int, rank: int, words: list[str]) -> Column:
    """Array of a field's hits on ``words``: what is no hit never becomes a row."""
    hit = F.transform(tokens, lambda t, i: F.struct(F.lit(code).alias("code"), F.lit(rank).alias("field_rank"), i.alias("pos"), t.alias("token")))
    return F.filter(hit, lambda x: x["token"].isin(words))


def hits_of(spark: SparkSession, folder: str, words: list[str]) -> DataFrame:
    """Hit lists from title, text and venue, whose tokens stand for the fields title, body and tags."""
    fields = (("title", ranking.TITLE), ("text", ranking.TEXT), ("venue", ranking.TAGS))
    docs = with_token_lists(spread(table(spark, folder, "documents").select("doc_id", *[c for c, _ in fields])), {c: f"{c}_tokens" for c, _ in fields})
    hits = [_hits_in(F.col(f"{c}_tokens"), code, rank, words) for rank, (c, code) in enumerate(fields)]
    return ranking.field_hits(docs.select("doc_id", F.inline(F.concat(*hits))), words)


def _joined(c: str):
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


def _forward(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.size("token_ids").alias("token_count"), _joined("token_ids"))


def _validate(s: SparkSession, d: str) -> DataFrame:
    b = barrels_of(s, d)
    return validate.compare_postings(b.index.postings, _postings_from_forward(b.index))


def _postings_from_forward(index: Index) -> DataFrame:
    """Postings derived a second time, from documents and lexicon."""
    occ = index.docs.select("doc_id", F.posexplode("tokens").alias("pos", "token"))
    pairs = occ.groupBy("doc_id", "token").agg(F.count("*").cast("int").alias("freq"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return index.by_token(pairs, index.lexicon)


Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    ix, br, N = index_of, barrels_of, len(RANK_WORDS)
    out: dict[str, Query] = {
        "tokens": lambda s, d: ix(s, d).tokens(),
        "doc_ids": lambda s, d: ix(s, d).doc_ids(),
        "lexicon": lambda s, d: ix(s, d).lexicon.select("token_id", "token"),
        "lexicon_stats": lambda s, d: ix(s, d).lexicon_stats(),
        "forward_index": lambda s, d: _forward(ix(s, d).forward()),
        "forward_limit": lambda s, d: _forward(ix(s, d, FORWARD_LIMIT).forward()),
        "forward_stats": lambda s, d: ix(s, d).forward_stats(),
        "inverted_index": lambda s, d: ix(s, d).inverted().select("token_id", "doc_freq", "block_no", _joined("doc_ids")),
        "doc_freq": lambda s, d: ix(s, d).doc_freq(),
        "inverted_stats": lambda s, d: ix(s, d).inverted_stats(),
        "frequent_tokens": lambda s, d: br(s, d).frequent_tokens(),
        "barrel_map": lambda s, d: br(s, d).barrel_map().select("token_id", "barrel_id"),
        "barrel_stats": lambda s, d: br(s, d).stats(),
        "most_frequent_tokens": lambda s, d: br(s, d).most_frequent(),
        "frequency_barrel": lambda s, d: br(s, d).frequency_barrel(),
        "postings": lambda s, d: ix(s, d).postings.select("token_id", "doc_id", "freq", _joined("positions")),
        "barrel_build_stats": lambda s, d: br(s, d).build_stats(),
        "postings_index": lambda s, d: storage.block_lengths(ix(s, d).postings).select("token_id", "doc_count", "total_freq"),
        "postings_offsets": lambda s, d: storage.offsets(ix(s, d).postings),
        "heavy_tokens": lambda s, d: storage.heavy(ix(s, d).postings, HEAVY_KB).select("token_id", "bytes"),
        "heavy_postings": lambda s, d: storage.heavy_postings(ix(s, d).postings, HEAVY_KB),
        "heavy_manifest": lambda s, d: storage.heavy(ix(s, d).postings, HEAVY_KB),
        "doc_only_postings": lambda s, d: ix(s, d).postings.select("token_id", "doc_id", "freq"),
        "term_lookup": lambda s, d: term_lookup(ix(s, d), LOOKUP_TERM),
        "barrel_analysis": lambda s, d: br(s, d).analysis(),
        "block_stats": lambda s, d: storage.block_stats(ix(s, d).postings),
        "largest_blocks": lambda s, d: storage.largest_blocks(ix(s, d).postings),
        "artifact_sizes": lambda s, d: storage.artifact_sizes(ix(s, d), br(s, d)),
        "memory_estimate": lambda s, d: storage.memory_estimate(ix(s, d)),
        "validate_postings": _validate,
        "is_relevant": lambda s, d: hits_of(s, d, [RANK_WORD]).select("doc_id", ranking.is_relevant(F.col("hits")).alias("relevant")),
        "rank_single": lambda s, d: ranking.rank_single(hits_of(s, d, [RANK_WORD])),
        "intersections": lambda s, d: ranking.intersections(hits_of(s, d, RANK_WORDS), N),
        "intersection_multiplier": lambda s, d: ranking.intersection_multiplier(hits_of(s, d, RANK_WORDS), N),
        "rank_multi": lambda s, d: ranking.rank_multi(hits_of(s, d, RANK_WORDS), N),
        "rank_multi_raw": lambda s, d: ranking.rank_multi(hits_of(s, d, RANK_WORDS), N, normalize=False),
        "rank_query": lambda s, d: ranking.rank_query(RANK_WORDS, hits_of(s, d, RANK_WORDS)),
    }
    return out | shredding.queries() | skew.queries() | compaction.queries()


#: A block of 8 KB counts as heavy in the queries: the tables here are small.
HEAVY_KB = 8
