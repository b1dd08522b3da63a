"""Ranks and running sums in a global order, without bringing the rows, or those of one key, to one task.

Rows are dealt by ranges of the order, sorted within each range, and written with a number that says range and place. What each
range holds is added up to offsets, one row for each range (and key in it); those are few, however many rows there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpoint

#: Bits of monotonically_increasing_id that count the rows of a partition.
PLACE_BITS = 33


def _placed(df: DataFrame, order: list) -> DataFrame:
    """df in ranges of the order, with __part, its range, and __place, its place there from 0; written, so that both stay as they are."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = checkpoint(placed)
    return placed.select(*df.columns, F.shiftright("__at", PLACE_BITS).alias("__part"), F.col("__at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("__place"))


def ranked(df: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """df with a long column `name`: 1, 2, 3... in this order. Rows that tie get different numbers; an order that tells all
    rows apart gives the same numbers each time. An empty table stays empty."""
    placed = _placed(df, [F.col(c) if isinstance(c, str) else c for c in order])
    counts = placed.groupBy("__part").agg(F.count("*").alias("n"))  # one row for each range
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__part", F.coalesce(before, F.lit(0).cast("long")).alias("__before"))
    return placed.join(F.broadcast(offsets), "__part").select(*df.columns, (F.col("__before") + F.col("__place") + 1).alias(name))


def running(df: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, str]) -> DataFrame:
    """df with a long column for each name of `sums`: the sum of that name's column over the rows of the same keys that come before in
    this order, 0 for the first."""
    placed = _placed(df, [*map(F.col, keys), *[F.col(c) if isinstance(c, str) else c for c in order]])
    zero = F.lit(0).cast("long")
    held = placed.groupBy(*keys, "__part").agg(*[F.sum(c).alias(f"__{name}") for name, c in sums.items()])  # one row for each range and key in it
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(*keys, "__part", *[F.coalesce(F.sum(f"__{name}").over(earlier), zero).alias(f"__{name}") for name in sums])
    within = Window.partitionBy(*keys, "__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.select("*", *[F.coalesce(F.sum(c).over(within), zero).alias(f"__in_{name}") for name, c in sums.items()])
    return inside.join(offsets, [*keys, "__part"]).select(*df.columns, *[(F.col(f"__{name}") + F.col(f"__in_{name}")).alias(name) for name in sums])
