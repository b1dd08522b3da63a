"""High-utility itemsets of each month.

An itemset's utility in a month is what its items add up to over the transactions that hold all of them; it is high if it
reaches the month's threshold. Candidates grow level by level from prefixes: a frontier row is one prefix in one transaction, with
the prefix's utility and the later items. A prefix whose own and remaining utility fall short of the threshold has no high-utility
extension and is dropped, which is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint
from ..functions.packing import is_packed, packed
from ..functions.scalars import mining_threshold, pattern_key


def thresholds(tx: DataFrame, ratio: float) -> DataFrame:
    """window_key and min_util, from the declared totals."""
    return tx.groupBy("window_key").agg(mining_threshold(F.sum("transaction_utility"), ratio).alias("min_util"))


def twu(tx_item: DataFrame, tx: DataFrame) -> DataFrame:
    """Transaction-weighted utility of each item and month: the full utility of the transactions that hold it."""
    if is_packed(tx_item):
        held = tx_item.select("window_key", "transaction_utility", F.explode(F.array_distinct("x.item_id")).alias("item_id"))
        return held.groupBy("window_key", "item_id").agg(F.sum("transaction_utility").alias("twu"))
    held = tx_item.select("window_key", "tid", "item_id").distinct().join(tx.select("window_key", "tid", "transaction_utility"), ["window_key", "tid"])
    return held.groupBy("window_key", "item_id").agg(F.sum("transaction_utility").alias("twu"))


def twu_prune(tx_item: DataFrame, tx: DataFrame, ratio: float) -> DataFrame:
    """tx_item without items whose transaction-weighted utility is below the threshold; one pass, as a bound needs no more."""
    kept = twu(tx_item, tx).join(thresholds(tx, ratio), "window_key").filter("twu >= min_util").select("window_key", "item_id")
    if is_packed(tx_item):
        months = kept.groupBy("window_key").agg(F.collect_set("item_id").alias("__kept"))  # a row for each month
        return tx_item.join(F.broadcast(months), "window_key").withColumn("x", F.filter("x", lambda e: F.array_contains("__kept", e["item_id"]))).drop("__kept").filter(F.size("x") > 0)
    return tx_item.join(kept, ["window_key", "item_id"], "left_semi")


def twu_stats(tx_item: DataFrame, tx: DataFrame, ratio: float) -> DataFrame:
    """Items, lengths and transactions of each month before and after pruning."""

    def side(rows: DataFrame, name: str) -> DataFrame:
        lengths = rows.groupBy("window_key", "tid").agg(F.count("*").alias("n"))
        items = rows.groupBy("window_key").agg(F.countDistinct("item_id").alias(f"{name}_items"))
        return lengths.groupBy("window_key").agg(F.avg("n").alias(f"{name}_avg_len"), F.max("n").alias(f"{name}_max_len"), F.count("*").alias(f"{name}_tx")).join(items, "window_key")

    before, after = side(tx_item, "before"), side(twu_prune(tx_item, tx, ratio), "after")
    return before.join(after, "window_key", "left").fillna(0).withColumnRenamed("after_tx", "kept_tx")


def mine(tx_item: DataFrame, tx: DataFrame, ratio: float, prune: bool = True, max_len: int | None = None) -> DataFrame:
    """window_key, items (ascending), utility: every itemset of positive items that reaches its month's threshold.

    A threshold of 0 would let through every itemset that occurs; it counts as 1. max_len limits the itemsets' length.
    """
    limits = checkpoint(thresholds(tx, ratio).withColumn("min_util", F.greatest("min_util", F.lit(1).cast("long"))))
    listed = twu_prune(tx_item, tx, ratio) if prune else tx_item
    listed = packed(listed if is_packed(listed) else listed.filter("util > 0")).select("window_key", F.filter("x", lambda e: e["util"] > 0).alias("x"))

    def later(x, at):
        return F.slice(x, at + 2, F.greatest(F.size(x) - at - 1, F.lit(0)))

    # Each entry says what the later ones add up to, as no prefix that ends there can gain more; written, as the first levels each read
    # the transactions. Their levels only unfold them.
    gain = F.transform("x", lambda e, at: e.withField("left", F.aggregate(later(F.col("x"), at), F.lit(0).cast("long"), lambda a, r: a + r["util"])))
    listed = checkpoint(listed.filter(F.size("x") > 0).withColumn("x", gain))
    frontier = listed.select("window_key", "x", F.posexplode("x").alias("at", "i"))
    # rest: the later items; left: what they add up to.
    frontier = frontier.select("window_key", F.array("i.item_id").alias("items"), F.col("i.util").alias("used"), F.col("i.left").alias("left"), later(F.col("x"), F.col("at")).alias("rest"))
    found, level = [], 1
    while True:
        if level > 2:  # the first levels are read off the transactions: most pairs fall short, and are not worth writing
            frontier = checkpoint(frontier)
            if frontier.isEmpty():
                break
        sums = frontier.groupBy("window_key", "items").agg(F.sum("used").alias("utility"), F.sum(F.col("used") + F.col("left")).alias("bound")).join(limits, "window_key")
        # Prefixes that can reach the threshold, all high ones among them; written, so that their size is known when they are joined.
        alive = checkpoint(sums.filter("bound >= min_util"))
        found.append(alive.filter("utility >= min_util").select("window_key", "items", "utility"))
        if level == max_len:
            break
        grown = frontier.filter("left > 0").join(alive.select("window_key", "items"), ["window_key", "items"], "left_semi")
        grown = grown.select("window_key", "items", "used", "rest", F.posexplode("rest").alias("at", "i"))
        frontier = grown.select("window_key", F.concat("items", F.array("i.item_id")).alias("items"), (F.col("used") + F.col("i.util")).alias("used"), F.col("i.left").alias("left"), later(F.col("rest"), F.col("at")).alias("rest"))
        level += 1
    return reduce(DataFrame.unionByName, found).withColumn("pattern_key", pattern_key(F.col("items")))


def top_patterns(patterns: DataFrame, n: int | None) -> DataFrame:
    """The n patterns of most utility of each month, ties by key; None keeps all."""
    if n is None:
        return patterns
    order = Window.partitionBy("window_key").orderBy(F.desc("utility"), "pattern_key")
    return patterns.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("rank")


def candidates(patterns: DataFrame) -> DataFrame:
    """Distinct patterns, the months they were mined in, and their largest mined utility."""
    return patterns.groupBy("pattern_key").agg(F.first("items").alias("items"), F.array_sort(F.collect_set("window_key")).alias("source_windows"), F.max("utility").alias("max_mined_utility"))
