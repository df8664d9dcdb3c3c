"""Cross-check of two independently derived postings tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


COMPARED = "compared"


def compare_postings(index_side: DataFrame, barrel_side: DataFrame) -> DataFrame:
    """token_id, problem, rows: for each token that differs how many of its postings are ``not in barrels`` or ``not in index``.

    One more row, of token -1 and the problem ``compared``, tells how many rows there were on both sides. Both are ``token_id, doc_id,
    freq, positions``, compared as bags.
    """
    cols = ["token_id", "doc_id", "freq", "positions"]
    both = index_side.select(*cols, F.lit(1).alias("__d")).unionByName(barrel_side.select(*cols, F.lit(-1).alias("__d")))
    net = both.groupBy(*cols).agg(F.sum("__d").alias("__net"), F.count("*").alias("__c"))
    per = net.groupBy("token_id").agg(F.sum(F.greatest("__net", F.lit(0))).alias("a"), F.sum(F.greatest(-F.col("__net"), F.lit(0))).alias("b"), F.sum("__c").alias("c"))
    each = F.array(
        F.struct("token_id", F.lit("not in barrels").alias("problem"), F.col("a").alias("rows")), F.struct("token_id", F.lit("not in index").alias("problem"), F.col("b").alias("rows")),
        F.struct(F.lit(-1).cast("long").alias("token_id"), F.lit(COMPARED).alias("problem"), F.col("c").alias("rows")),
    )
    return per.select(F.inline(each)).groupBy("token_id", "problem").agg(F.sum("rows").alias("rows")).where(f"rows > 0 OR problem = '{COMPARED}'")


def block_order(postings: DataFrame, place: list[str]) -> DataFrame:
    """token_id, problem, rows: how many postings of each token don't have a greater document number than the one before, in the order of ``place``.

    ``place``: columns that name a file in the order of files, then a row in it. Each file's blocks are checked on
    their own, and then their ends, so no task gets more than a token's rows of a file.
    """
    file, row = place
    inner = Window.partitionBy("token_id", file).orderBy(row)
    seen = postings.select("token_id", "doc_id", file, row, F.lag("doc_id").over(inner).alias("__before"))
    ends = seen.groupBy("token_id", file).agg(F.count_if(F.col("doc_id") <= F.col("__before")).alias("bad"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    across = ends.withColumn("__hi", F.lag("hi").over(Window.partitionBy("token_id").orderBy(file)))  # one row a file
    bad = F.sum(F.col("bad") + F.coalesce((F.col("lo") <= F.col("__hi")).cast("long"), F.lit(0)))
    return across.groupBy("token_id").agg(bad.alias("rows")).where("rows > 0").select("token_id", F.lit("order").alias("problem"), "rows")


def sample_tokens(offsets: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``k`` tokens drawn by a seeded hash: the same ones each time."""
    return offsets.orderBy(F.xxhash64("token_id", F.lit(seed)), "token_id").limit(k)
