"""Sums along a global order, without one task that sorts all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.sources.staging import checkpoint


def sums_before(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows before a row in the given order, 0 for the first.

    Rows are dealt out by range and sorted inside their range; a row's sum is that of the ranges before plus that inside
    its own. Only one row for each range is ordered by one task.
    """
    dealt = df.withColumn("_value", value).repartitionByRange(*order).sortWithinPartitions(*order)
    held = checkpoint(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    ranges = held.groupBy(part.alias("_part")).agg(F.sum("_value").alias("_sum"))
    ranges = ranges.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_begun"))
    inside = F.sum("_value").over(Window.partitionBy("_part").orderBy("_at")) - F.col("_value")
    # as many ranges as the exchange has partitions
    joined = held.withColumn("_part", part).join(F.broadcast(ranges), "_part")
    return joined.withColumn(name, F.col("_begun") + inside).select(*df.columns, name)
