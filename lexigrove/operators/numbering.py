"""Dense numbers and running sums over a global order, without a global window.

Rows are range-partitioned and sorted; a row's place in its partition plus the size of the
partitions before it is its number. Only one row a partition is ever brought together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.session import materialize

_IN_PARTITION = (1 << 33) - 1


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def dense_number(
    df: DataFrame, order: list[str | Column], to: str, start: int = 0, then: Callable[[DataFrame], DataFrame] = lambda df: df
) -> DataFrame:
    """``df`` with the column ``to``: ``start``, ``start`` + 1, ... in ``order``, which must decide every tie.

    The rows are written to the shared folder first, because range bounds are sampled and a second
    evaluation could draw others. An empty table stays empty. ``then``: a row-wise step that keeps the rows'
    order and may drop some, done once the rows are in order and before they are numbered; what is
    costly belongs there, as the sampling runs through everything before.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = materialize(then(_ranged(df, cols)).withColumn("__rs_m", F.monotonically_increasing_id()))
    part = F.shiftright("__rs_m", 33)
    sizes = placed.groupBy(part.alias("__rs_p")).agg(F.count("*").alias("__rs_n"))
    before = sizes.select(
        "__rs_p", F.coalesce(F.sum("__rs_n").over(Window.orderBy("__rs_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__rs_before")
    )
    return (
        placed.withColumn("__rs_p", part)
        .join(F.broadcast(before), "__rs_p")  # one row a partition
        .withColumn(to, (F.col("__rs_before") + F.col("__rs_m").bitwiseAND(F.lit(_IN_PARTITION)) + F.lit(start)).cast("long"))
        .drop("__rs_p", "__rs_m", "__rs_before")
    )


def running_sum(df: DataFrame, order: list[str], value: str, to: str) -> DataFrame:
    """``df`` with the column ``to``: the sum of ``value`` over all rows that come before in ``order``, 0 for the first."""
    placed = materialize(
        _ranged(df, [F.col(c) for c in order]).withColumn("__rs_p", F.spark_partition_id())
    )
    sizes = placed.groupBy("__rs_p").agg(F.sum(value).alias("__rs_n"))
    before = sizes.select(
        "__rs_p", F.coalesce(F.sum("__rs_n").over(Window.orderBy("__rs_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__rs_before")
    )
    inner = Window.partitionBy("__rs_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("__rs_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(F.broadcast(before), "__rs_p")
        .withColumn(to, F.col("__rs_before") + F.col("__rs_in"))
        .drop("__rs_p", "__rs_in", "__rs_before")
    )
