"""Transactions as one row each, so that what concerns a whole transaction needs no shuffle.

A packed table is both fact table and header: window_key, tid, invoice_no, transaction_utility, length, and x, the items with their
utilities, ascending. A transaction whose items are all gone has an empty x.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRIES = "array<struct<item_id:int,util:bigint>>"
HEADER = ("window_key", "tid", "invoice_no", "transaction_utility", "length")


def is_packed(tx_item: DataFrame) -> bool:
    return "x" in tx_item.columns


def entries() -> Column:
    """x of the rows of a group."""
    return F.sort_array(F.collect_list(F.struct("item_id", "util"))).alias("x")


def packed(tx_item: DataFrame, tx: DataFrame | None = None) -> DataFrame:
    """window_key, tid and x of facts, which may be packed already; with headers all their columns, and an empty x where there are no items."""
    if is_packed(tx_item):
        return tx_item
    rows = tx_item.groupBy("window_key", "tid").agg(entries())
    return rows if tx is None else tx.join(rows, ["window_key", "tid"], "left").withColumn("x", F.coalesce("x", F.array().cast(ENTRIES)))


def unpacked(rows: DataFrame) -> DataFrame:
    """The facts of a packed table, one row for each item."""
    return rows.select("window_key", "tid", "invoice_no", F.explode("x").alias("e")).select("window_key", "tid", "invoice_no", "e.item_id", "e.util")


def headers(rows: DataFrame) -> DataFrame:
    return rows.select(*HEADER)
