"""Per-key results where a few keys hold most rows.

Rows are first counted by key and value. That table has one row for each distinct value of a key,
however often it occurs, and sums over it are exact; a hot key's rows are spread by their values
and by the partial step of each aggregation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.operators.storage import BLOCK_HEADER, posting_bytes
from lexigrove.session import materialize
from lexigrove.sources.tables import table


def value_frequencies(df: DataFrame, keys: list[str], value: str, unit: list[str] | None = None) -> DataFrame:
    """keys, value, weight: how often each value occurs with each key.

    ``unit``: columns that name a thing counted once a key however many rows it has (repeated rows); of
    differing values the largest counts. Null keys, units and values are values like any other.
    """
    if unit:
        df = df.groupBy(*keys, *unit).agg(F.max(value).alias(value))
    return df.groupBy(*keys, value).agg(F.count("*").alias("weight"))


def weighted_summary(freq: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, distinct_values, total, mode of a table of value frequencies. Null values count in ``n`` only; of equal modes the smallest value."""
    w, v = F.col("weight"), F.col(value)
    best = F.max(F.when(v.isNotNull(), F.struct(w.alias("w"), (-v).alias("neg"), v.alias("v"))))
    return freq.groupBy(*keys).agg(
        F.sum(w).alias("n"),
        F.count(v).alias("distinct_values"),
        F.sum(w * v).alias("total"),
        best["v"].alias("mode"),
    )


def weighted_percentiles(freq: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys and p<share * 100> for each of ``shares``: the smallest value with at least that share of the key's non-null rows at or below it.

    Rows are range-partitioned by (keys, value), so a key with very many values lies in several partitions. Within one, weights are
    summed up along the rows; what a key has in the partitions before is known from one row for each partition and key that
    it holds. Only partitions in which a rank falls give a value, so no row is joined with its key's other rows.
    """
    known = freq.where(F.col(value).isNotNull())
    order = [*keys, value]
    placed = materialize(known.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()))
    by_key = Window.partitionBy(*keys)
    parts = placed.groupBy(*keys, "__p").agg(F.sum("weight").alias("__w"))
    earlier = by_key.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition of the key
    parts = parts.select(*keys, "__p", F.coalesce(F.sum("__w").over(earlier), F.lit(0)).alias("__start"), "__w", F.sum("__w").over(by_key).alias("__n"))
    ranks = [F.greatest(F.ceil(F.col("__n") * F.lit(s)), F.lit(1)) - F.col("__start") for s in shares]
    inner = Window.partitionBy("__p", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)  # a part of the key: rows of one partition
    upto = placed.select(*keys, "__p", value, "weight", F.sum("weight").over(inner).alias("__upto"))
    asked = parts.select(*keys, "__p", *[F.when((r > 0) & (r <= F.col("__w")), r).alias(f"__r{i}") for i, r in enumerate(ranks)]).where(" OR ".join(f"__r{i} IS NOT NULL" for i in range(len(shares))))
    a, b = upto.alias("a"), asked.alias("b")
    on: Column = F.col("a.__p") == F.col("b.__p")
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    picks = []
    for i, s in enumerate(shares):
        r = F.col(f"__r{i}")
        picks.append(F.max(F.when((F.col("__upto") - F.col("weight") < r) & (r <= F.col("__upto")), F.col(f"a.{value}"))).alias(f"p{round(s * 100)}"))
    return a.join(b, on).groupBy(*[F.col(f"a.{k}").alias(k) for k in keys]).agg(*picks)


# Postings

KEYS = ["shard_id", "token_id"]


def freq_table(postings: DataFrame) -> DataFrame:
    """shard_id, token_id, freq, weight: each document counted once in a shard's token."""
    return value_frequencies(postings.select(*KEYS, "doc_id", "freq"), KEYS, "freq", ["doc_id"])


def true_lengths(freq: DataFrame) -> DataFrame:
    """shard_id, token_id, length of each block by its weighted frequencies; a null freq counts as 0."""
    size = F.sum(F.col("weight") * posting_bytes(F.coalesce(F.col("freq"), F.lit(0))))
    return freq.groupBy(*KEYS).agg((F.lit(BLOCK_HEADER) + size).alias("true_length"))


def wrong_lengths(postings: DataFrame, offsets: DataFrame) -> DataFrame:
    """Distinct keys of ``offsets`` with a stored length other than the block's; a key without postings has an empty block, a null length is wrong."""
    stated = offsets.select(*KEYS, "length").distinct()
    real = true_lengths(freq_table(postings)).alias("t")
    o = stated.alias("o")
    on = F.col("o.shard_id").eqNullSafe(F.col("t.shard_id")) & F.col("o.token_id").eqNullSafe(F.col("t.token_id"))
    wrong = ~F.col("o.length").eqNullSafe(F.coalesce(F.col("true_length"), F.lit(BLOCK_HEADER)))
    return o.join(real, on, "left").where(wrong).select("o.shard_id", "o.token_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    freq = lambda s, d: freq_table(table(s, d, "postings"))
    return {
        "p3_found": lambda s, d: wrong_lengths(table(s, d, "postings"), table(s, d, "postings_offsets")),
        "p3_lengths": lambda s, d: true_lengths(freq(s, d)),
        "p3_summary": lambda s, d: weighted_summary(freq(s, d), KEYS, "freq"),
        "p3_percentiles": lambda s, d: weighted_percentiles(freq(s, d), KEYS, "freq", [0.5, 0.9]),
    }
