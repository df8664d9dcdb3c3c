"""Bounded samples for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30


def under(by: list[str], most: int, count: int, seed: int = 0) -> Column:
    """Whether a row is under the threshold of a hash of the columns ``by`` that lets about ``most`` of ``count`` rows through, or all where there are no more."""
    if count <= most:
        return F.lit(True)
    return F.pmod(F.xxhash64(*[F.col(c) for c in by], F.lit(seed)), F.lit(_STEPS)) < int(_STEPS * 0.95 * most / count)


def hashed_sample(df: DataFrame, by: list[str], most: int, seed: int = 0, count: int | None = None) -> DataFrame:
    """At most ``most`` rows of ``df``: all of them, or those under a threshold of a hash of the columns ``by`` that is set from their number.

    Each task leaves out its own rows, so no more than the sample comes together. ``count``: the number of rows,
    where it is known. The same rows are drawn whatever the partitions; only should the hash let more than ``most`` through,
    which takes a deviation of 5 %, or many rows of one hash, does the limit choose.
    """
    return df.where(under(by, most, df.count() if count is None else count, seed)).limit(most)
