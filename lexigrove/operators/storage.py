"""Sizes, offsets and heavy tokens of the index, by the byte layout of its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.operators.barrels import Barrels, record_bytes
from lexigrove.operators.index import Index
from lexigrove.operators.numbering import dense_number, running_sum

# The byte layout and the reports' constants.
BLOCK_HEADER = 4
HEAVY_KB = 128
HEAVY_TOP = 50
OFFSET_ENTRY_BYTES = 120
LEXICON_ENTRY_BYTES = 60


def posting_bytes(freq: Column) -> Column:
    """Bytes of one posting in its token's block."""
    return (F.lit(12) + F.lit(4) * freq).cast("long")


def block_lengths(postings: DataFrame) -> DataFrame:
    """token_id, length, doc_count, total_freq. Partial sums are made before the shuffle, so a hot token costs nothing more."""
    return postings.groupBy("token_id").agg(
        (F.lit(BLOCK_HEADER) + F.sum(posting_bytes(F.col("freq")))).alias("length"),
        F.count("*").alias("doc_count"),
        F.sum("freq").cast("long").alias("total_freq"),
    )


def offsets(postings: DataFrame) -> DataFrame:
    """token_id, offset, length: where each token's block starts in a file of all blocks in the order of token_id."""
    return running_sum(block_lengths(postings).select("token_id", "length"), ["token_id"], "length", "offset").select("token_id", "offset", "length")


def heavy(postings: DataFrame, threshold_kb: float = HEAVY_KB, top: int = HEAVY_TOP) -> DataFrame:
    """token_id, bytes, doc_count, path, total_heavy of the ``top`` longest blocks from ``threshold_kb`` on; 0 for all of them."""
    big = block_lengths(postings).where(F.col("length") >= F.lit(threshold_kb * 1024.0))
    total = big.agg(F.count("*").alias("total_heavy"))
    chosen = big.orderBy(F.desc("length"), "token_id").limit(top) if top else big
    return chosen.crossJoin(F.broadcast(total)).select(  # total is one row
        "token_id",
        F.col("length").alias("bytes"),
        "doc_count",
        F.concat(F.lit("heavy/token_"), F.col("token_id").cast("string"), F.lit(".bin")).alias("path"),
        "total_heavy",
    )


def heavy_of(postings: DataFrame, ids: DataFrame, top: int) -> DataFrame:
    """token_id, doc_id, freq of the tokens in ``ids``, of which there are ``top``, or any number where that is 0; without positions."""
    return postings.select("token_id", "doc_id", "freq").join(F.broadcast(ids) if top and top <= 10_000 else ids, "token_id", "left_semi")


def heavy_postings(postings: DataFrame, threshold_kb: float = HEAVY_KB, top: int = HEAVY_TOP) -> DataFrame:
    """token_id, doc_id, freq of the heavy tokens."""
    return heavy_of(postings, heavy(postings, threshold_kb, top).select("token_id"), top)


def block_stats(postings: DataFrame) -> DataFrame:
    """Count, sum, mean, median, 95th percentile (exclusive method) and maximum of block lengths; null percentile for fewer than two blocks."""
    lengths = block_lengths(postings).select("token_id", "length")
    placed = dense_number(lengths, ["length", "token_id"], "__i", 1)
    n = lengths.agg(F.count("*").alias("__n"))
    at = F.col("__i")
    j = F.greatest(F.lit(1), F.least(F.floor(F.lit(95) * (F.col("__n") + 1) / 100), F.col("__n") - 1))
    pick = lambda k: F.max(F.when(at == k, F.col("length")))
    g = placed.crossJoin(F.broadcast(n))  # n is one row
    lo, hi = F.floor((F.col("__n") + 1) / 2), F.floor((F.col("__n") + 2) / 2)
    row = g.agg(
        F.count("*").alias("tokens"), F.sum("length").alias("total_bytes"), F.avg("length").alias("avg_bytes"), F.max("length").alias("max_bytes"),
        pick(lo).alias("__lo"), pick(hi).alias("__hi"), pick(j).alias("__a"), pick(j + 1).alias("__b"),
    )
    jn = F.greatest(F.lit(1), F.least(F.floor(F.lit(95) * (F.col("tokens") + 1) / 100), F.col("tokens") - 1))
    d = F.lit(95) * (F.col("tokens") + 1) - jn * 100
    return row.select(
        "tokens", "total_bytes", "avg_bytes",
        ((F.col("__lo") + F.col("__hi")) / 2.0).alias("median_bytes"),
        F.when(F.col("tokens") >= 2, (F.col("__a") * (100 - d) + F.col("__b") * d) / 100.0).alias("p95_bytes"),
        "max_bytes",
    )


def largest_blocks(postings: DataFrame, n: int = 10) -> DataFrame:
    top = block_lengths(postings).select("token_id", F.col("length").alias("bytes")).orderBy(F.desc("bytes"), "token_id").limit(n)
    return top.select(F.row_number().over(Window.orderBy(F.desc("bytes"), "token_id")).alias("rank"), "token_id", "bytes")


def artifact_sizes(index: Index, barrels: Barrels) -> DataFrame:
    """artifact, bytes: the size each file of the binary layout would have."""
    v = index.lexicon.agg(F.count("*").alias("v"), F.sum(F.octet_length("token") + 8).alias("lex"))
    d = index.docs.agg(F.sum(F.lit(8) + F.lit(4) * F.size("tokens")).alias("fwd"))
    p = index.postings.agg(
        F.count("*").alias("p"), F.sum(record_bytes(F.col("freq"))).alias("bar"), F.sum(posting_bytes(F.col("freq"))).alias("blk")
    )
    one = v.crossJoin(d).crossJoin(p)  # one row each
    sizes = {
        "lexicon.bin": F.col("lex") + 4,
        "forward_index.bin": F.col("fwd") + 4,
        "inverted_index.bin": F.lit(4) + F.col("v") * 8 + F.col("p") * 4,
        "barrel_mapping.bin": F.lit(12) + F.col("v") * 8,
        "postings_index.bin": F.col("v") * BLOCK_HEADER + F.col("blk"),
        "postings_offsets.bin": F.lit(4) + F.col("v") * 20,
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("artifact"), x.cast("long").alias("bytes")) for k, x in sizes.items()])
    files = one.select(F.inline(pairs))
    name = F.when(F.col("barrel_id") == barrels.num_barrels, "barrel_freq.bin").otherwise(F.format_string("barrel_%02d.bin", "barrel_id"))
    return files.unionByName(barrels.analysis().select(name.alias("artifact"), F.col("size_bytes").cast("long").alias("bytes")))


def memory_estimate(index: Index) -> DataFrame:
    v = index.lexicon.agg(F.count("*").alias("v"))
    return v.select(
        (F.col("v") * OFFSET_ENTRY_BYTES).alias("offsets_bytes"),
        (F.col("v") * LEXICON_ENTRY_BYTES).alias("lexicon_bytes"),
        (F.col("v") * (OFFSET_ENTRY_BYTES + LEXICON_ENTRY_BYTES)).alias("total_bytes"),
    )
