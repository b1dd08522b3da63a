"""Patterns over months: exact utilities, statistics, selection of peak-sensitive ones, item scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packing import is_packed, packed


def pattern_support(patterns: DataFrame, tx_item: DataFrame, positive: bool = True) -> DataFrame:
    """pattern_key, window_key, tid, utility for each transaction that holds all of a pattern's items (with positive utility).

    Transactions are packed once, if they are not yet, and meet the patterns whose first item they hold; the other items are looked up in the packed row,
    so that no row for each item of each pattern is shuffled. Patterns are few and broadcast by their size, if it is small enough.
    """
    if is_packed(tx_item):
        rows = tx_item.select("window_key", "tid", "x")
        rows = rows.withColumn("x", F.filter("x", lambda e: e["util"] > 0)) if positive else rows
    else:
        rows = packed(tx_item.filter("util > 0") if positive else tx_item)
    return holding(rows, patterns).select("pattern_key", "window_key", "tid", "utility")


def holding(packed: DataFrame, patterns: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Packed transactions (x: item_id, util and more) with each pattern all of whose items they hold, once: all columns of both,
    `held`, the entries of the pattern's items, and `utility`, their sum. `on` are further columns that must agree."""
    # The second item, or the only one. Patterns of one first item are looked up by it, so that only those of whose first two items a
    # transaction holds both meet it, however many begin alike.
    wanted = patterns.withColumn("__first", F.col("items")[0]).withColumn("__second", F.coalesce(F.get("items", F.lit(1)), "__first"))
    second = wanted.groupBy("__first", *on).agg(F.collect_set("__second").alias("__seconds"))
    met = packed.withColumn("__first", F.explode(F.array_distinct("x.item_id"))).join(second, ["__first", *on])
    met = met.withColumn("__second", F.explode(F.array_intersect("__seconds", "x.item_id"))).drop("__seconds").join(wanted, ["__first", "__second", *on]).drop("__first", "__second")
    met = met.withColumn("held", F.filter("x", lambda e: F.array_contains("items", e["item_id"]))).filter(F.size("held") == F.size("items"))
    return met.withColumn("utility", F.aggregate("held", F.lit(0).cast("long"), lambda a, e: a + e["util"]))


def pattern_windows(patterns: DataFrame, tx_item: DataFrame, windows: DataFrame) -> DataFrame:
    """Utility and share of every pattern in every month, 0 where it does not occur."""
    sums = pattern_support(patterns, tx_item, positive=False).groupBy("pattern_key", "window_key").agg(F.sum("utility").alias("utility"))
    # Patterns by months, as the statistics ask for every pair: months are few.
    every = patterns.select("pattern_key").crossJoin(windows.select("window_key", "total_utility"))
    dense = every.join(sums, ["pattern_key", "window_key"], "left").withColumn("utility", F.coalesce("utility", F.lit(0).cast("long")))
    return dense.select("pattern_key", "window_key", "utility", F.coalesce(F.try_divide(F.col("utility").cast("double"), F.col("total_utility").cast("double")), F.lit(0.0)).alias("ratio"))


def temporal_stats(dense: DataFrame) -> DataFrame:
    """Support, peak and mean of each pattern over the months.

    max_window has the largest utility, then ratio, then is the earliest; max_ratio is the ratio there, and need not be the
    largest ratio. mean_ratio is over positive ratios; peakness_ratio is their quotient, 0 if there is no mean.
    """
    first = F.struct(-F.col("utility"), -F.col("ratio"), F.col("window_key"))
    traces = F.array_sort(F.collect_list(F.struct("window_key", "utility", "ratio")))
    out = dense.groupBy("pattern_key").agg(
        F.count_if(F.col("utility") > 0).alias("support_windows"), F.min_by("window_key", first).alias("max_window"), F.max("utility").alias("max_utility"), F.min_by("ratio", first).alias("max_ratio"), traces.alias("traces"),
    )
    positive = F.filter("traces", lambda t: t["ratio"] > 0)
    mean = F.aggregate(positive, F.lit(0.0), lambda a, t: a + t["ratio"], lambda a: F.coalesce(F.try_divide(a, F.size(positive).cast("double")), F.lit(0.0)))
    out = out.withColumn("mean_ratio", mean).withColumn("peakness_ratio", F.coalesce(F.try_divide("max_ratio", "mean_ratio"), F.lit(0.0)))
    peaks = F.transform(F.filter("traces", lambda t: (t["ratio"] == F.col("max_ratio")) & (t["ratio"] > 0)), lambda t: t["window_key"])
    return out.withColumn("peak_windows", peaks)


def survivors(stats: DataFrame, sensitive_ratio: float, min_peakness: float, min_support: int) -> DataFrame:
    reaches = F.exists("traces", lambda t: t["ratio"] >= float(sensitive_ratio))
    return stats.filter((F.col("support_windows") >= min_support) & (F.col("peakness_ratio") >= float(min_peakness)) & reaches)


def select_peaks(kept: DataFrame, sensitive_ratio: float, per_window: int) -> DataFrame:
    """Of each month, the survivors that reach the sensitive ratio there: the first `per_window` by ratio, utility, peakness, key."""
    each = kept.select("*", F.explode("traces").alias("t")).drop("traces")
    each = each.filter((F.col("t.utility") > 0) & (F.col("t.ratio") >= float(sensitive_ratio)))
    each = each.select(*[c for c in each.columns if c != "t"], F.col("t.window_key").alias("selected_window"), F.col("t.utility").alias("window_utility"), F.col("t.ratio").alias("window_ratio"))
    order = Window.partitionBy("selected_window").orderBy(F.desc("window_ratio"), F.desc("window_utility"), F.desc("peakness_ratio"), "pattern_key")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_window)


def items_of(key: str = "pattern_key"):
    """The items of a pattern key."""
    return F.transform(F.split(key, " "), lambda i: i.cast("int"))


def item_scores(selected: DataFrame) -> DataFrame:
    """Share times peakness, added up over the selected rows that hold an item."""
    each = selected.select("pattern_key", "selected_window", (F.col("window_ratio") * F.col("peakness_ratio")).alias("score"), F.explode(items_of()).alias("item_id"))
    return each.groupBy("item_id").agg(F.sum("score").alias("score"), F.count("*").alias("selected_count"), F.array_sort(F.collect_set("selected_window")).alias("windows"), F.array_sort(F.collect_set("pattern_key")).alias("patterns"))


def restrict(selected: DataFrame, keys: list[str] | DataFrame) -> DataFrame:
    """Selected rows of the given patterns only, a list or a table with pattern_key; an empty list or table is no restriction. Item
    scores stay those of the whole selection."""
    if isinstance(keys, DataFrame):
        if keys.isEmpty():
            return selected
        return selected.join(keys.select("pattern_key").distinct(), "pattern_key", "left_semi")
    return selected.filter(F.col("pattern_key").isin(keys)) if keys else selected
