"""Barrels: tokens grouped by how many documents hold them.

Frequent tokens go to a special barrel; the rest, from rare to frequent, to barrels whose share of
tokens grows with their number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.operators.index import Index
from lexigrove.operators.numbering import dense_number

# The defaults of the index format.
NUM_BARRELS = 16
FREQUENT_SHARE = 0.05
EXPONENT = 0.6


def frequent_threshold(documents: int, share: float = FREQUENT_SHARE) -> int:
    """Least number of documents of a frequent token: at least 1."""
    return max(1, int(documents * share))


@dataclass
class Barrels:
    index: Index
    num_barrels: int = NUM_BARRELS
    share: float = FREQUENT_SHARE

    def __post_init__(self):
        self.df = self.index.doc_freq()
        self.threshold = frequent_threshold(self.index.docs.count(), self.share)
        self._map: DataFrame | None = None

    def frequent_tokens(self) -> DataFrame:
        return self.df.where(F.col("doc_freq") >= self.threshold)

    def most_frequent(self, n: int = 100) -> DataFrame:
        """The ``n`` tokens in most documents, rank from 1; ties by token_id."""
        top = self.df.orderBy(F.desc("doc_freq"), "token_id").limit(n)
        return top.select(F.row_number().over(Window.orderBy(F.desc("doc_freq"), "token_id")).alias("rank"), "token_id", "doc_freq")

    def barrel_map(self) -> DataFrame:
        """token_id, barrel_id, doc_freq."""
        if self._map is None:
            rest = self.df.where(F.col("doc_freq") < self.threshold)
            placed = dense_number(rest, ["doc_freq", "token_id"], "__i")
            m = placed.agg(F.count("*").alias("__m"))
            barrel = F.least(F.floor(F.pow(F.col("__i") / F.col("__m").cast("double"), F.lit(EXPONENT)) * self.num_barrels), F.lit(self.num_barrels - 1)).cast("int")
            low = placed.crossJoin(F.broadcast(m)).select("token_id", barrel.alias("barrel_id"), "doc_freq")  # m is one row
            high = self.frequent_tokens().select("token_id", F.lit(self.num_barrels).alias("barrel_id"), "doc_freq")
            self._map = low.unionByName(high)
        return self._map

    def stats(self) -> DataFrame:
        return self.barrel_map().groupBy("barrel_id").agg(F.count("*").alias("token_count"), F.sum("doc_freq").alias("postings"))

    def build_stats(self) -> DataFrame:
        n = self.index.docs.agg(F.count("*").alias("documents_indexed"))
        t = self.barrel_map().agg(F.count("*").alias("tokens_assigned"))
        return n.crossJoin(t).select("documents_indexed", "tokens_assigned", F.col("tokens_assigned").alias("unique_tokens_seen"))  # one row each

    def postings(self) -> DataFrame:
        """Postings with their barrel_id; tokens missing from the map fall to ``token_id % num_barrels``. Hot tokens get theirs by a broadcast."""
        of = self.barrel_map()
        hot = F.broadcast(of.where(F.col("doc_freq") >= self.index.least).select("token_id", "barrel_id"))  # at most HOT_ROWS
        rare = of.where(F.col("doc_freq") < self.index.least).select("token_id", "barrel_id")
        return assign_barrel(self.index.hot, hot, self.num_barrels).unionByName(assign_barrel(self.index.rare, rare, self.num_barrels))

    def frequency_barrel(self) -> DataFrame:
        """token_id and word of the special barrel; a token without a word is called ``UNKNOWN_<id>``."""
        special = self.barrel_map().where(F.col("barrel_id") == self.num_barrels).select("token_id")
        return special.join(self.index.lexicon, "token_id", "left").select(
            "token_id", F.coalesce("token", F.concat(F.lit("UNKNOWN_"), F.col("token_id").cast("string"))).alias("token")
        )

    def analysis(self) -> DataFrame:
        """Per barrel: tokens, bytes of its file and bytes a token."""
        size = self.index.postings.groupBy("token_id").agg(F.sum(record_bytes(F.col("freq"))).alias("__b"))
        return (
            self.barrel_map()
            .join(size, "token_id")
            .groupBy("barrel_id")
            .agg(F.count("*").alias("token_count"), F.sum("__b").alias("size_bytes"))
            .withColumn("avg_bytes_per_token", F.col("size_bytes") / F.col("token_count"))
        )


def record_bytes(freq: Column) -> Column:
    """Bytes of one posting in a barrel file."""
    return (F.lit(16) + F.lit(4) * freq).cast("long")


def assign_barrel(postings: DataFrame, barrels: DataFrame, num_barrels: int) -> DataFrame:
    """``postings`` with barrel_id; unmapped tokens get ``token_id % num_barrels``, numbers out of range the special barrel."""
    given = F.coalesce(F.col("barrel_id"), (F.col("token_id") % num_barrels).cast("int"))
    return postings.drop("barrel_id").join(barrels, "token_id", "left").withColumn(
        "barrel_id", F.when((given < 0) | (given > num_barrels), num_barrels).otherwise(given)
    )
