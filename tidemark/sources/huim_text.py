"""Text formats of utility mining: a transaction is items:total:utilities, a pattern items #UTIL: n or items:n."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packing import packed
from ..functions.scalars import pattern_key


def transaction_lines(tx_item: DataFrame, tx: DataFrame | None = None) -> DataFrame:
    """One line for each transaction. With headers, emptied transactions have a line of their own (:0:), else none."""
    grouped = packed(tx_item, tx)
    if tx is None:
        grouped = grouped.filter(F.size("x") > 0)
    joined = lambda c: F.array_join(F.transform(f"x.{c}", lambda v: v.cast("string")), " ")
    total = F.aggregate("x.util", F.lit(0).cast("long"), lambda a, v: a + v)
    return grouped.select("window_key", "tid", F.concat_ws(":", joined("item_id"), total.cast("string"), joined("util")).alias("line"))


def write_transactions(tx_item: DataFrame, path: str, tx: DataFrame | None = None) -> None:
    """Lines under `path`, a folder for each month."""
    transaction_lines(tx_item, tx).select("window_key", "line").write.partitionBy("window_key").mode("overwrite").text(path)


def parse_patterns(lines: DataFrame, column: str = "value") -> DataFrame:
    """items, utility and pattern_key of pattern lines; lines that are none are dropped, of equal patterns the first line counts.

    A utility is the first word after the mark, a plain or exponential number of any sign, truncated.
    """
    c = F.col(column)
    marked = F.regexp_extract(c, r"^\s*([0-9 \t]+?)\s*#UTIL:", 1)
    left = F.when(marked != "", marked).otherwise(F.regexp_extract(c, r"^\s*([0-9 \t]+?)\s*:", 1))
    value = F.regexp_extract(c, r":\s*(\S+)", 1)
    number = F.when(value.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"), value).try_cast("double")
    items = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(F.trim(left), r"[ \t]+"), lambda x: x != ""), lambda x: x.try_cast("int"))))
    rows = lines.select(items.alias("items"), number.cast("long").alias("utility"), F.monotonically_increasing_id().alias("line")).filter((F.size("items") > 0) & F.col("utility").isNotNull())
    return rows.withColumn("pattern_key", pattern_key(F.col("items"))).groupBy("pattern_key").agg(F.first("items").alias("items"), F.min_by("utility", "line").alias("utility"))


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    return parse_patterns(spark.read.text(path))
