"""Field-weighted ranking of single-word and multi-word queries.

Input: ``hits(word_idx, word, list_pos, doc_id, hits)``, one row for each document in each word's
list. A hit's last digit is the code of its field. A document is in a list once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.operators.numbering import dense_number

# Field codes, their bonus, and the scoring constants.
TITLE, TEXT, URL, AUTHORS, TAGS = 0, 1, 2, 3, 5
BONUS = {TITLE: 50, URL: 30, AUTHORS: 20, TAGS: 30}
HIT_CAP = 20
BUMP = 10
RELEVANT_STEP = 100
DEPTH_STEP = 2
ALL_RELEVANT, ALL_PRESENT = 3.0, 1.5


def _codes(hits: Column) -> Column:
    return F.transform(hits, lambda h: F.pmod(h, F.lit(10)).cast("int"))


def is_relevant(hits: Column) -> Column:
    """Whether the first or the last hit lies outside the body text; false for an empty or null list."""
    ends = (F.pmod(F.element_at(hits, 1), F.lit(10)) != TEXT) | (F.pmod(F.element_at(hits, -1), F.lit(10)) != TEXT)
    return F.coalesce(F.when(F.size(hits) > 0, ends), F.lit(False))


def field_bonus(hits: Column) -> Column:
    """Sum of the bonuses of the fields met before the first or after the last body hit, each once."""
    codes = _codes(hits)
    first = F.array_position(codes, F.lit(TEXT)).cast("int")
    last = F.array_position(F.reverse(codes), F.lit(TEXT)).cast("int")
    seen = F.when(first == 0, codes).otherwise(F.concat(F.slice(codes, F.lit(1), first - 1), F.slice(F.reverse(codes), F.lit(1), last - 1)))
    total = F.lit(0)
    for code, bonus in BONUS.items():
        total = total + F.when(F.array_contains(seen, code), bonus).otherwise(0)
    return F.coalesce(total, F.lit(0))


def word_score(hits: Column, multiplier: Column) -> Column:
    """Score of one word's hits in a document."""
    size = F.greatest(F.size(F.coalesce(hits, F.array().cast("array<int>"))), F.lit(0))
    return (F.least(size, F.lit(HIT_CAP)) + F.when(multiplier > 1, BUMP).otherwise(0) + field_bonus(hits)) * multiplier


def rank_single(hits: DataFrame) -> DataFrame:
    """rank, doc_id, score of a single list; ties in list order."""
    scored = hits.select("doc_id", "list_pos", word_score(F.col("hits"), F.lit(1)).cast("double").alias("score"))
    return dense_number(scored, [F.desc("score"), F.col("list_pos")], "rank", 1).select("rank", "doc_id", "score")


def _depths(hits: DataFrame, n_words: int) -> DataFrame:
    """doc_id, depth, rel_depth and entries of each document: over how many leading words it is listed, and listed as relevant.

    A group is one document's rows, at most one a word.
    """
    idx = F.sequence(F.lit(0), F.lit(n_words - 1))

    def prefix(have: Column) -> Column:
        gap = F.array_position(F.transform(idx, lambda i: F.array_contains(have, i)), F.lit(False))
        return F.when(gap == 0, F.lit(n_words)).otherwise(gap - 1).cast("int")

    entry = F.struct("word_idx", "list_pos", "hits")
    return (
        hits.groupBy("doc_id")
        .agg(
            F.collect_set("word_idx").alias("__w"),
            F.collect_set(F.when(is_relevant(F.col("hits")), F.col("word_idx"))).alias("__r"),
            F.sort_array(F.collect_list(entry)).alias("entries"),
        )
        .select("doc_id", prefix(F.col("__w")).alias("depth"), prefix(F.col("__r")).alias("rel_depth"), "entries")
    )


def intersections(hits: DataFrame, n_words: int) -> DataFrame:
    """level, doc_id, relevant: documents in the lists of words 0 to level, and whether relevant in each. No rows for fewer than two words."""
    d = _depths(hits, max(n_words, 1))
    if n_words < 2:
        d = d.limit(0)
    return d.where(F.col("depth") > 0).select(
        F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("level"), "doc_id", "rel_depth"
    ).select("level", "doc_id", (F.col("rel_depth") > F.col("level")).alias("relevant"))


def _multiplier(n_words: int) -> Column:
    if n_words < 2:
        return F.lit(1)
    r, d = F.col("rel_depth"), F.col("depth")
    return F.when(r >= 2, r * RELEVANT_STEP).when(d >= 2, d * DEPTH_STEP).otherwise(1)


def intersection_multiplier(hits: DataFrame, n_words: int) -> DataFrame:
    """doc_id, multiplier."""
    return _depths(hits, n_words).select("doc_id", _multiplier(n_words).alias("multiplier"))


def rank_multi(hits: DataFrame, n_words: int, normalize: bool = True) -> DataFrame:
    """rank, doc_id, score over all lists. Ties: first word that lists the document, its score there, its place there. No words give no rows."""
    if n_words < 1:
        return hits.limit(0).select(F.lit(0).cast("long").alias("rank"), "doc_id", F.lit(0.0).alias("score"))
    m = _multiplier(n_words)
    d = _depths(hits, n_words).withColumn("m", m)
    scores = F.transform("entries", lambda e: word_score(e["hits"], F.col("m")))
    boost = F.lit(1.0)
    if n_words > 1:
        boost = F.when(F.col("rel_depth") == n_words, ALL_RELEVANT).when(F.col("depth") == n_words, ALL_PRESENT).otherwise(1.0)
    d = d.withColumn("__s", scores).select(
        "doc_id",
        (F.aggregate("__s", F.lit(0).cast("long"), lambda a, x: a + x).cast("double") * boost / F.lit(float(n_words if normalize and n_words > 1 else 1))).alias("score"),
        F.col("entries")[0]["word_idx"].alias("__w"),
        F.col("__s")[0].alias("__f"),
        F.col("entries")[0]["list_pos"].alias("__l"),
    )
    return dense_number(d, [F.desc("score"), F.col("__w"), F.desc("__f"), F.col("__l")], "rank", 1).select("rank", "doc_id", "score")


def rank_query(words: list[str], hits: DataFrame) -> DataFrame:
    """rank, doc_id, score. One word ranks that word's list and must have one; several rank every list given, normalized."""
    if len(words) == 1:
        own = hits.where(F.col("word") == words[0])
        if own.isEmpty():
            raise KeyError(words[0])
        return rank_single(own)
    n = (hits.agg(F.max("word_idx")).head()[0] or 0) + 1 if not hits.isEmpty() else 0
    return rank_multi(hits, n)


def field_hits(index_tokens: DataFrame, words: list[str]) -> DataFrame:
    """Hit lists of ``words`` from ``tokens(doc_id, code, field_rank, pos, token)``: hits are ``10 * pos + code``, fields in their rank."""
    table = F.create_map(*[x for i, w in enumerate(words) for x in (F.lit(w), F.lit(i))])
    own = index_tokens.where(F.col("token").isin(words))
    lists = own.groupBy("doc_id", "token").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("field_rank", "pos", "code"))), lambda x: (x["pos"] * 10 + x["code"]).cast("int")).alias("hits")
    )
    return lists.select(table[F.col("token")].alias("word_idx"), F.col("token").alias("word"), F.col("doc_id").alias("list_pos"), "doc_id", "hits")
