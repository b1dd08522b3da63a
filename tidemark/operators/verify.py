"""Independent checks of a sanitized database against the original one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.packing import ENTRIES, is_packed
from ..functions.scalars import hiding_threshold
from .temporal import pattern_support


def audit(tx_item: DataFrame, tx: DataFrame) -> DataFrame:
    """Each transaction with a problem: which of the four rules it breaks."""
    if is_packed(tx_item):
        each = lambda name: F.col(f"x.{name}")
        joined = tx_item.select(
            "window_key", "tid", "transaction_utility", F.aggregate(each("util"), F.lit(0).cast("long"), lambda a, u: a + u).alias("computed_tu"), F.size("x").alias("n"),
            F.size(F.array_distinct(each("item_id"))).alias("distinct"), F.size(F.filter(each("util"), lambda u: u > 0)).alias("positive"),
        )
        return _problems(joined)
    sums = tx_item.groupBy("window_key", "tid").agg(F.sum("util").alias("computed_tu"), F.count("*").alias("n"), F.countDistinct("item_id").alias("distinct"), F.count_if(F.col("util") > 0).alias("positive"))
    joined = tx.select("window_key", "tid", "transaction_utility").join(sums, ["window_key", "tid"], "left").fillna(0, ["computed_tu", "n", "distinct", "positive"])
    return _problems(joined)


def _problems(joined: DataFrame) -> DataFrame:
    rows = joined.select(
        "window_key", "tid", F.col("transaction_utility").alias("declared_tu"), "computed_tu", (F.col("transaction_utility") != F.col("computed_tu")).alias("bad_tu"),
        ((F.col("positive") == 0) | (F.col("transaction_utility") <= 0)).alias("empty_transaction"), (F.col("n") != F.col("distinct")).alias("duplicate_items"), (F.col("n") - F.col("positive")).alias("zero_or_negative_item_utils"),
    )
    return rows.filter("bad_tu or empty_transaction or duplicate_items or zero_or_negative_item_utils > 0")


def audit_counts(tx_item: DataFrame, tx: DataFrame) -> DataFrame:
    """One row: transactions with a wrong total, without positive items, with repeated items; item utilities that are not positive."""
    return audit(tx_item, tx).agg(F.count_if("bad_tu").alias("bad_tu"), F.count_if("empty_transaction").alias("empty_transactions"), F.count_if("duplicate_items").alias("duplicate_items"), F.coalesce(F.sum("zero_or_negative_item_utils"), F.lit(0)).alias("zero_or_negative_item_utils"))


def local_hiding(definitions: DataFrame, tx: DataFrame, after_item: DataFrame, after: DataFrame, ratio: float) -> DataFrame:
    """For each month of either database: targets, how many are hidden, which are not, and the utility given up."""
    total = lambda rows, name: rows.groupBy("window_key").agg(F.sum("transaction_utility").alias(name))
    months = total(tx, "original_utility").join(total(after, "sanitized_utility"), "window_key", "full_outer").fillna(0, ["original_utility", "sanitized_utility"])
    months = months.withColumn("local_threshold_abs", hiding_threshold(F.col("original_utility"), ratio))
    sums = pattern_support(definitions, after_item).groupBy("pattern_key", "window_key").agg(F.sum("utility").alias("u"))
    targets = definitions.select("pattern_key", F.explode("local_target_windows").alias("window_key")).join(sums, ["pattern_key", "window_key"], "left")
    open_ = F.coalesce("u", F.lit(0)) >= F.col("local_threshold_abs")
    judged = targets.join(months, "window_key").groupBy("window_key").agg(F.count("*").alias("targets"), F.count_if(open_).alias("violations"), F.array_join(F.array_sort(F.collect_list(F.when(open_, F.col("pattern_key")))), " ").alias("violation_pattern_keys"))
    out = months.join(judged, "window_key", "left").fillna(0, ["targets", "violations"]).fillna("", ["violation_pattern_keys"])
    reduced = F.col("original_utility") - F.col("sanitized_utility")
    return out.select("window_key", "targets", (F.col("targets") - F.col("violations")).alias("hidden"), "violations", "violation_pattern_keys", "local_threshold_abs", "original_utility", "sanitized_utility", reduced.alias("utility_reduced"), F.coalesce(F.try_divide(reduced.cast("double"), F.col("original_utility").cast("double")), F.lit(0.0)).alias("utility_loss_rate"))


def pattern_totals(definitions: DataFrame, tx_item: DataFrame) -> DataFrame:
    """Utility of each sensitive pattern over all months, 0 if it does not occur."""
    sums = pattern_support(definitions, tx_item).groupBy("pattern_key").agg(F.sum("utility").alias("utility"))
    return definitions.select("pattern_key").join(sums, "pattern_key", "left").fillna(0, ["utility"])


def pattern_metrics(definitions: DataFrame, tx_item: DataFrame, tx: DataFrame, after_item: DataFrame, ratio: float) -> DataFrame:
    """One row for each sensitive pattern: its utility before and after, and whether it still leaks."""
    limit = tx.agg(hiding_threshold(F.coalesce(F.sum("transaction_utility"), F.lit(0)), ratio).alias("global_threshold_abs"))  # one row
    before = pattern_totals(definitions, tx_item).withColumnRenamed("utility", "original_global_utility")
    after = pattern_totals(definitions, after_item).withColumnRenamed("utility", "sanitized_global_utility")
    out = definitions.join(before, "pattern_key").join(after, "pattern_key").crossJoin(limit)
    words = lambda c: F.array_join(c, " ").alias(c)
    return out.select("pattern_key", words("local_target_windows"), words("peak_windows"), "original_global_utility", "sanitized_global_utility", "global_threshold_abs", (F.col("sanitized_global_utility") >= F.col("global_threshold_abs")).alias("global_leak"))


def compare(tx_item: DataFrame, tx: DataFrame, after_item: DataFrame, after: DataFrame, items: DataFrame, changed_only: bool = True, shared_only: bool = False) -> DataFrame:
    """Utilities of every item of every transaction before and after; only those that differ, unless asked otherwise. With
    `shared_only`, transactions that one of the databases does not have are passed over."""
    keys = ["window_key", "tid", "item_id"]
    if is_packed(tx_item) and is_packed(after_item):
        return _named(_compared(tx_item, after_item, changed_only, shared_only), items)
    if shared_only:
        both = tx.select("window_key", "tid").join(after.select("window_key", "tid"), ["window_key", "tid"], "left_semi")
        tx_item, after_item = (x.join(both, ["window_key", "tid"], "left_semi") for x in (tx_item, after_item))
    both = tx_item.select(*keys, F.col("util").alias("b")).join(after_item.select(*keys, F.col("util").alias("a")), keys, "full_outer").fillna(0, ["a", "b"])
    if changed_only:
        both = both.filter("a <> b")
    names = tx.select("window_key", "tid", F.col("invoice_no").alias("i1")).join(after.select("window_key", "tid", F.col("invoice_no").alias("i2")), ["window_key", "tid"], "full_outer")
    names = names.select("window_key", "tid", F.coalesce("i2", "i1", F.lit("")).alias("invoice_no"))
    return _named(both.join(names, ["window_key", "tid"], "left"), items)


def _compared(before: DataFrame, after: DataFrame, changed_only: bool, shared_only: bool) -> DataFrame:
    """The rows of `compare` from packed tables: a transaction of one meets that of the other once, unchanged ones go at once."""
    keys = ["window_key", "tid"]
    left, right = (t.select(*keys, F.col("invoice_no").alias(f"i{n}"), F.col("x").alias(f"x{n}")) for n, t in ((1, before), (2, after)))
    both = left.join(right, keys, "inner" if shared_only else "full_outer")
    both = both.filter(~F.col("x1").eqNullSafe(F.col("x2"))) if changed_only else both
    one, two = (F.coalesce(c, F.array().cast(ENTRIES)) for c in ("x1", "x2"))
    both = both.select(*keys, F.coalesce("i2", "i1", F.lit("")).alias("invoice_no"), F.map_from_entries(one).alias("m1"), F.map_from_entries(two).alias("m2"))
    each = both.withColumn("item_id", F.explode(F.array_union(F.map_keys("m1"), F.map_keys("m2"))))
    util = lambda m: F.coalesce(F.try_element_at(m, F.col("item_id")), F.lit(0).cast("long"))
    out = each.select(*keys, "item_id", util(F.col("m1")).alias("b"), util(F.col("m2")).alias("a"), "invoice_no")
    return out.filter("a <> b") if changed_only else out


def _named(both: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of a comparison with codes and descriptions of their items."""
    out = both.join(items, "item_id", "left")
    return out.select("window_key", "tid", "invoice_no", "item_id", F.coalesce("stock_code", F.col("item_id").cast("string")).alias("stock_code"), F.coalesce("description", F.lit("")).alias("description"), F.col("b").alias("before_utility"), F.col("a").alias("after_utility"), (F.col("b") - F.col("a")).alias("delta"))


def report(definitions: DataFrame, tx_item: DataFrame, tx: DataFrame, after_item: DataFrame, after: DataFrame, items: DataFrame, local_ratio: float, global_ratio: float) -> DataFrame:
    """One row: totals, rates, and whether integrity, local and global hiding pass."""
    total = lambda name: F.coalesce(F.sum("transaction_utility"), F.lit(0)).alias(name)
    row = tx.agg(total("original_total_utility"), F.count("*").alias("total_transactions")).crossJoin(after.agg(total("sanitized_total_utility")))
    row = row.crossJoin(local_hiding(definitions, tx, after_item, after, local_ratio).agg(F.coalesce(F.sum("violations"), F.lit(0)).alias("local_violations_after")))
    leaks = pattern_metrics(definitions, tx_item, tx, after_item, global_ratio).filter("global_leak")
    row = row.crossJoin(leaks.agg(F.count("*").alias("global_leaks_after"), F.array_join(F.array_sort(F.collect_list("pattern_key")), ",").alias("global_leaking_pattern_keys")))
    row = row.crossJoin(compare(tx_item, tx, after_item, after, items).select("window_key", "tid").distinct().agg(F.count("*").alias("modified_transactions")))
    row = row.crossJoin(audit_counts(after_item, after))  # all of these are single rows
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), F.col(b).cast("double")), F.lit(0.0))
    reduced = F.col("original_total_utility") - F.col("sanitized_total_utility")
    row = row.withColumn("total_utility_reduced", reduced).withColumn("utility_loss_rate", part(reduced, "original_total_utility")).withColumn("modified_tx_rate", part(F.col("modified_transactions"), "total_transactions"))
    clean = (F.col("bad_tu") + F.col("empty_transactions") + F.col("duplicate_items") + F.col("zero_or_negative_item_utils")) == 0
    row = row.withColumn("global_threshold_abs", hiding_threshold(F.col("original_total_utility"), global_ratio)).withColumn("pass_integrity", clean).withColumn("pass_local", F.col("local_violations_after") == 0).withColumn("pass_global", F.col("global_leaks_after") == 0)
    return row.withColumn("passed", F.col("pass_integrity") & F.col("pass_local") & F.col("pass_global"))
