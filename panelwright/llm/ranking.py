"""Gapless numbers within groups, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.session import cut_lineage


def number_within(df: DataFrame, group: list[str], order: list[str | Column], name: str) -> DataFrame:
    """`df` with a number from 0 in every group, in `order`; rows that tie get different numbers.

    Rows are laid out once by range over (group, order), so a hot group spreads over many tasks. A row's place in its
    partition is read off while writing; the groups' first places and counts per partition (one row per partition and
    one more per group: a table bounded by those two numbers) carry the offsets and are broadcast.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    keys = [*group, *order]
    laid = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", at)
    laid = cut_lineage(laid.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = laid.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*group, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return laid.join(F.broadcast(offsets), [*group, "_part"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
