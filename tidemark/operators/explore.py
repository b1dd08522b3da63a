"""Row shapes for people: labels, transaction details, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import label, short_text
from .temporal import items_of
from .verify import compare


def normalise_mapping(raw: DataFrame) -> DataFrame:
    """item_id, stock_code, description from rows (key string, value string): value is an id, a code, or a JSON object.

    An object may name its fields in several ways; a key that is a number is an id, else the value must be one. Others go.
    """
    whole = r"^\s*[+-]?\d+\s*$"
    rows = raw.select("key", "value", F.get_json_object("value", "$.ItemID").alias("a"), F.get_json_object("value", "$.item_id").alias("b"), F.get_json_object("value", "$.id").alias("c"), F.coalesce(*[F.get_json_object("value", f"$.{n}") for n in ("StockCode", "stock_code", "stockCode")]).alias("code"), F.coalesce(F.get_json_object("value", "$.Description"), F.get_json_object("value", "$.description"), F.lit("")).alias("text"), F.trim("value").startswith("{").alias("object"))
    key_id, value_id = F.when(F.col("key").rlike(whole), F.trim("key")), F.when(F.col("value").rlike(whole), F.trim("value"))
    item = F.when(F.col("object"), F.coalesce("a", "b", key_id, "c")).otherwise(F.coalesce(key_id, value_id)).try_cast("int")
    code = F.when(F.col("object"), F.coalesce("code", "key")).when(key_id.isNotNull(), F.col("value")).otherwise(F.col("key"))
    return rows.select(item.alias("item_id"), code.alias("stock_code"), F.when(F.col("object"), F.col("text")).otherwise("").alias("description")).filter("item_id is not null")


def pattern_labels(selected: DataFrame, items: DataFrame) -> DataFrame:
    """Each selected row with the labels of its items, in order, and a short text."""
    each = selected.select("pattern_key", "selected_window", F.posexplode(items_of()).alias("pos", "item_id")).join(items, "item_id", "left")
    one = label(F.col("item_id"), F.col("stock_code"), F.col("description"))
    described = F.coalesce("description", F.lit(""))
    short = F.when(F.col("stock_code").isNull(), F.concat(F.lit("ItemID "), F.col("item_id").cast("string"))).otherwise(F.concat("stock_code", F.when(described != "", F.concat(F.lit(" - "), described)).otherwise("")))
    listed = each.groupBy("pattern_key", "selected_window").agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("label"), short.alias("short")))).alias("l"))
    return listed.select("pattern_key", "selected_window", F.col("l.label").alias("labels"), short_text(F.col("l.short")).alias("short_text"))


def cross_sell(labelled: DataFrame) -> DataFrame:
    """For each pattern of two labels or more, each member as the main product and the others as what to suggest with it."""
    many = labelled.filter(F.size("labels") >= 2)
    main = many.select("pattern_key", "selected_window", "labels", F.explode("labels").alias("main_product"))
    return main.select("pattern_key", "selected_window", "main_product", F.array_join(F.array_remove("labels", F.col("main_product")), ", ").alias("suggested"), F.array_join("labels", " + ").alias("combo"))


def business_rows(selected: DataFrame) -> DataFrame:
    """Selected rows with their peak month and why they matter: a peakness of 2 or more is a seasonal peak, else utility counts."""
    reason = F.when(F.col("peakness_ratio") >= 2, "seasonal_peak").when(F.col("window_utility") > 0, "high_revenue_bundle").otherwise("protect")
    return selected.select("pattern_key", "selected_window", "window_utility", F.coalesce(F.get("peak_windows", F.lit(0)), "selected_window").alias("peak_window"), "peakness_ratio", "support_windows", reason.alias("reason"))


def transaction_detail(window_key: str, tid: str, tx_item: DataFrame, tx: DataFrame, after_item: DataFrame, after: DataFrame, items: DataFrame) -> DataFrame:
    """All items of one transaction before and after, also those that did not change."""
    one = lambda df: df.filter((F.col("window_key") == window_key) & (F.col("tid") == tid))
    return compare(one(tx_item), one(tx), one(after_item), one(after), items, changed_only=False)
