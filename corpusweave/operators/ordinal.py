"""Consecutive numbers in a global order, without bringing the rows to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.lineage import cut

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above and the row below this bit.


def with_ordinal(
    df: DataFrame, order: Sequence[Column | str], name: str = "ordinal", start: int = 1
) -> DataFrame:
    """Add ``start, start + 1, …`` in the given order.

    The rows are range-partitioned and sorted; a row's number is its place in its partition plus
    the number of rows in the partitions before. Only one count per partition is brought together.
    """
    numbered = cut(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    partition = F.shiftright("_id", _ROW_BITS)
    placed = numbered.select(
        *df.columns,
        partition.alias("_p"),
        (F.col("_id") - F.shiftleft(partition, _ROW_BITS)).alias("_at"),
    )
    # One row per partition of the sort, so both the window and the broadcast are small.
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_p")
        .agg(F.count("*").alias("_n"))
        .select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return placed.join(F.broadcast(offsets), "_p").select(
        *df.columns, (F.col("_before") + F.col("_at") + start).alias(name)
    )
