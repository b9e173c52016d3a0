"""Numbering rows in an order without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillet.session import checkpoint


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df dealt by ranges of the order and written, with __part, its range, and __at, its place: however often one key stands, no range holds more than a share of the rows."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    return checkpoint(placed).withColumn("__part", F.shiftright("__at", 33))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with its 0-based place in the order.

    A range shuffle sorts; rows are numbered within their partition; the partitions' offsets come from a table of one row each, which
    is broadcast (as small as the number of partitions).
    """
    held = ranged(df, order).withColumn("__row", F.col("__at").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.groupBy("__part").agg(F.count("*").alias("__rows")).select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    return held.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__offset") + F.col("__row")).drop("__part", "__row", "__offset", "__at")
