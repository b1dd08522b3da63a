"""From raw sales rows to transactions by month.

The fact table is tx_item (window_key, tid, invoice_no, item_id, util); the header is tx (window_key, tid, invoice_no,
transaction_utility, length). A header stays when its items go. `baskets` has both in one row for each transaction
(functions/packing.py), from which they are read without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.lineage import checkpoint
from ..functions.ordered import ranked
from ..functions.packing import entries, is_packed
from ..functions.scalars import int_utility, month, number, text, timestamp
from ..schema import REQUIRED, require_columns

#: The order in which rules drop rows: each row is counted at the first that it breaks.
REASONS = ("missing_required", "cancelled_invoice", "nonpositive_quantity_or_price", "invalid_invoice_date", "nonpositive_utility")
MAX_LENS = (30, 40, 50, 60, 80, 100, 150, 200)


def classify(df: DataFrame) -> DataFrame:
    """Every row with cleaned fields and drop_reason, null if it is kept. A column row_id gives the file order, if there is one."""
    df = df.toDF(*[c.strip() for c in df.columns])
    require_columns(df.columns)
    missing = F.lit(False)
    for c in REQUIRED:
        missing = missing | F.col(c).isNull()
    q, p, ts = number(df, "Quantity"), number(df, "UnitPrice"), timestamp(df, "InvoiceDate")
    invoice = F.trim(text(df, "InvoiceNo"))  # few end like a decimal, so that few need a regular expression
    order = F.col("row_id") if "row_id" in df.columns else F.monotonically_increasing_id()
    rows = df.select(
        order.alias("row_id"), missing.alias("missing"), F.when(invoice.contains(".0"), F.regexp_replace(invoice, r"\.0$", "")).otherwise(invoice).alias("invoice_no"), F.trim(text(df, "StockCode")).alias("stock_code"),
        text(df, "Description").alias("description"), q.alias("quantity"), p.alias("unit_price"), ts.alias("ts"), int_utility(q, p).alias("util"),
    )
    sold = F.coalesce((F.col("quantity") > 0) & (F.col("unit_price") > 0), F.lit(False))
    reason = F.when(F.col("missing"), REASONS[0]).when(F.col("invoice_no").startswith("C"), REASONS[1]).when(~sold, REASONS[2]).when(F.col("ts").isNull(), REASONS[3]).when(F.col("util") <= 0, REASONS[4])
    return rows.withColumn("drop_reason", reason).withColumn("window_key", month(F.col("ts"))).drop("missing")


def drop_report(classified: DataFrame) -> DataFrame:
    """Rows by reason, ok for those kept; every reason has a row."""
    spark = classified.sparkSession
    every = spark.createDataFrame([(r,) for r in (*REASONS, "ok")], "reason string")
    counts = classified.groupBy(F.coalesce("drop_reason", F.lit("ok")).alias("reason")).count()
    return every.join(counts, "reason", "left").select("reason", F.coalesce("count", F.lit(0)).cast("long").alias("n_rows"))


def clean(classified: DataFrame) -> DataFrame:
    return classified.filter("drop_reason is null").drop("drop_reason")


def item_dictionary(rows: DataFrame) -> DataFrame:
    """item_id by rank of the stock code, and each code's first description that is not null, in file order.

    The least leading field of row_id is looked for first: numbers are added up by hashing, where whole rows would have to be sorted.
    Only rows that have it then meet row_id itself."""
    kind = rows.schema["row_id"].dataType
    lead = F.col(f"row_id.`{kind.names[0]}`") if isinstance(kind, StructType) else F.col("row_id")
    told = F.col("description").isNotNull() & F.col("row_id").isNotNull()
    # A null in a row_id comes before all numbers.
    least = F.when(~F.coalesce(F.bool_or(told & lead.isNull()), F.lit(False)), F.min(F.when(told, lead)))
    codes = checkpoint(rows.groupBy("stock_code").agg(least.alias("__least")))
    first = rows.filter(told).join(codes.select(F.col("stock_code").alias("__code"), "__least"), (F.col("stock_code") == F.col("__code")) & lead.eqNullSafe(F.col("__least")))
    first = first.groupBy("stock_code").agg(F.min_by("description", "row_id").alias("description"))
    codes = codes.select("stock_code").join(first, "stock_code", "left")
    return ranked(codes, ["stock_code"], "item_id").select(F.col("item_id").cast("int"), "stock_code", "description")


def item_level(rows: DataFrame, items: DataFrame) -> DataFrame:
    """tx_item: utilities of an item within an invoice and month added up."""
    keyed = rows.join(items.select("stock_code", "item_id"), "stock_code")
    out = keyed.groupBy("window_key", "invoice_no", "item_id").agg(F.sum("util").alias("util"))
    return out.select("window_key", F.concat_ws("_", "window_key", "invoice_no").alias("tid"), "invoice_no", "item_id", "util")


def baskets(rows: DataFrame, items: DataFrame) -> DataFrame:
    """The facts of item_level and their headers, packed. Rows of an invoice and month are brought together once."""
    keyed = rows.join(items.select("stock_code", "item_id"), "stock_code").select("window_key", "invoice_no", "item_id", "util").repartition("window_key", "invoice_no")
    added = keyed.groupBy("window_key", "invoice_no", "item_id").agg(F.sum("util").alias("util"))
    out = added.groupBy("window_key", "invoice_no").agg(F.sum("util").alias("transaction_utility"), F.count("*").cast("int").alias("length"), entries())
    return out.select("window_key", F.concat_ws("_", "window_key", "invoice_no").alias("tid"), "invoice_no", "transaction_utility", "length", "x")


def headers(tx_item: DataFrame) -> DataFrame:
    return tx_item.groupBy("window_key", "tid", "invoice_no").agg(F.sum("util").alias("transaction_utility"), F.count("*").cast("int").alias("length"))


def limit_length(tx_item: DataFrame, tx: DataFrame, max_len: int | None) -> tuple[DataFrame, DataFrame]:
    """Drop whole transactions of more items; None keeps all."""
    if max_len is None:
        return tx_item, tx
    kept = tx.filter(F.col("length") <= max_len)
    return tx_item.join(kept.select("window_key", "tid"), ["window_key", "tid"], "left_semi"), kept


def nested(tx_item: DataFrame) -> DataFrame:
    """Transactions as one row each, items ascending, with their utilities as a map."""
    if is_packed(tx_item):
        return tx_item.select("window_key", "tid", "invoice_no", F.col("x.item_id").alias("items"), F.map_from_entries("x").alias("item_utils"), "transaction_utility", "length")
    grouped = tx_item.groupBy("window_key", "tid", "invoice_no").agg(F.array_sort(F.collect_list(F.struct("item_id", "util"))).alias("x"), F.sum("util").alias("transaction_utility"))
    return grouped.select("window_key", "tid", "invoice_no", F.col("x.item_id").alias("items"), F.map_from_entries("x").alias("item_utils"), "transaction_utility", F.size("x").alias("length"))


def windows(tx: DataFrame) -> DataFrame:
    """Total utility and number of transactions of each month that has any."""
    return tx.groupBy("window_key").agg(F.sum("transaction_utility").alias("total_utility"), F.count("*").alias("num_transactions"))


def max_len_impact(tx: DataFrame, thresholds: tuple[int, ...] = MAX_LENS) -> DataFrame:
    """What a limit on length would keep and remove, for each threshold; no rows without transactions."""
    spark = tx.sparkSession
    limits = F.broadcast(spark.createDataFrame([(t,) for t in thresholds], "max_len int"))
    # Lengths are counted first, so that only distinct lengths meet the thresholds.
    lengths = tx.groupBy("length").agg(F.count("*").alias("n"), F.sum("transaction_utility").alias("u"))
    kept = F.col("length") <= F.col("max_len")
    out = lengths.crossJoin(limits).groupBy("max_len").agg(
        F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("kept_tx"), F.sum(F.when(kept, 0).otherwise(F.col("n"))).alias("removed_tx"),
        F.sum(F.when(kept, F.col("u")).otherwise(0)).alias("kept_utility"), F.sum(F.when(kept, 0).otherwise(F.col("u"))).alias("removed_utility"),
        F.sum(F.when(kept, F.col("n") * F.col("length")).otherwise(0)).alias("sum_len"), F.coalesce(F.max(F.when(kept, F.col("length"))), F.lit(0)).alias("max_len_after"),
    )
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double")), F.lit(0.0))
    return out.select("max_len", "kept_tx", "removed_tx", part("removed_tx", "kept_tx").alias("removed_tx_rate"), "kept_utility", "removed_utility", part("removed_utility", "kept_utility").alias("removed_utility_rate"), F.coalesce(F.try_divide(F.col("sum_len").cast("double"), F.col("kept_tx").cast("double")), F.lit(0.0)).alias("avg_len_after"), "max_len_after")


def report(classified: DataFrame, tx_before: DataFrame, tx_after: DataFrame) -> DataFrame:
    """One row: what went in, what each rule dropped, and transactions before and after the limit on length."""
    dropped = [F.count_if(F.col("drop_reason") == r).alias(f"rows_dropped_{r}") for r in REASONS]
    rows = classified.agg(F.count("*").alias("input_rows"), *dropped, F.count_if(F.col("drop_reason").isNull()).alias("clean_rows"), F.countDistinct(F.when(F.col("drop_reason").isNull(), F.col("stock_code"))).alias("num_items"))
    total = lambda: F.coalesce(F.sum("transaction_utility"), F.lit(0))
    before = tx_before.agg(F.count("*").alias("transactions_before_filter"), total().alias("utility_before_filter"))
    after = tx_after.agg(F.count("*").alias("transactions_after_filter"), total().alias("utility_after_filter"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_len_after"), F.coalesce(F.max("length"), F.lit(0)).alias("max_len_after"), F.countDistinct("window_key").alias("num_windows"))
    joined = rows.crossJoin(before).crossJoin(after)  # three single rows
    return joined.withColumn("transactions_removed_by_max_len", F.col("transactions_before_filter") - F.col("transactions_after_filter"))
