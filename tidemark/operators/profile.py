"""Profiles of raw sales rows. Here nothing is trimmed and utilities are not rounded, unlike in preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import column_or_null, month, number, text, timestamp
from ..schema import REQUIRED


def _raw(df: DataFrame) -> DataFrame:
    q, p = number(df, "Quantity"), number(df, "UnitPrice")
    return df.select(
        text(df, "InvoiceNo").alias("invoice"), text(df, "StockCode").alias("stock"), text(df, "Description").alias("description"),
        q.alias("quantity"), p.alias("price"), F.coalesce(q * p, F.lit(0.0)).alias("utility"), timestamp(df, "InvoiceDate").alias("ts"),
        column_or_null(df, "Quantity").isNotNull().alias("has_quantity"), column_or_null(df, "UnitPrice").isNotNull().alias("has_price"),
        _missing(df).alias("missing"),
    ).withColumn("valid", _valid(df))


def _missing(df: DataFrame) -> Column:
    present = [c for c in REQUIRED if c in df.columns]
    out = F.lit(not present)
    for c in present:
        out = out | F.col(c).isNull()
    return out


def _valid(df: DataFrame) -> Column:
    if not all(c in df.columns for c in REQUIRED):
        return F.lit(False)
    rules = F.col("invoice").isNotNull() & ~F.col("invoice").startswith("C") & F.col("stock").isNotNull() & (F.col("quantity") > 0) & (F.col("price") > 0) & F.col("ts").isNotNull()
    return F.coalesce(rules, F.lit(False))


def valid_sales(df: DataFrame) -> DataFrame:
    """Rows with an invoice that is not cancelled, an item, positive quantity and price, and a date."""
    return _raw(df).filter("valid")


def raw_summary(df: DataFrame) -> DataFrame:
    """One row of 17 metrics."""
    valid = F.col("valid")
    revenue, invoices = F.coalesce(F.sum(F.when(valid, F.col("utility"))), F.lit(0.0)), F.countDistinct(F.when(valid, F.col("invoice")))

    def bad(has: str, c: str) -> Column:
        return F.count_if((F.col(has) & F.col(c).isNull()) | F.coalesce(F.col(c) <= 0, F.lit(False)))

    return _raw(df).agg(
        F.count("*").alias("total_rows"),
        F.lit(len(df.columns)).cast("long").alias("total_columns"),
        F.countDistinct("invoice").alias("total_invoices"),
        F.countDistinct("stock").alias("total_items"),
        revenue.alias("total_revenue"),
        F.count_if(valid).alias("valid_transactions"),
        invoices.alias("valid_invoices"),
        F.count_if(~valid).alias("removed_rows"),
        F.coalesce(F.try_divide(revenue, invoices), F.lit(0.0)).alias("average_invoice_value"),
        F.countDistinct(F.when(valid, month(F.col("ts")))).alias("data_months"),
        F.count_if("missing").alias("missing_required_rows"),
        F.count_if(F.coalesce(F.col("invoice").startswith("C"), F.lit(False))).alias("cancelled_invoices_count"),
        bad("has_quantity", "quantity").alias("invalid_quantity_rows"),
        bad("has_price", "price").alias("invalid_unitprice_rows"),
        F.date_format(F.min("ts"), "yyyy-MM-dd").alias("date_min"),
        F.date_format(F.max("ts"), "yyyy-MM-dd").alias("date_max"),
        F.coalesce(F.sum("utility"), F.lit(0.0)).alias("raw_total_utility"),
    )


def sales_overview(df: DataFrame) -> DataFrame:
    """Six metrics of the valid rows; zeros without any."""
    revenue, invoices = F.coalesce(F.sum("utility"), F.lit(0.0)), F.countDistinct("invoice")
    return valid_sales(df).agg(
        revenue.alias("total_revenue"), invoices.alias("invoice_count"), F.countDistinct("stock").alias("product_count"), F.countDistinct(month(F.col("ts"))).alias("data_months"),
        F.coalesce(F.try_divide(revenue, invoices), F.lit(0.0)).alias("average_invoice_value"), F.count("*").alias("valid_transactions"),
    )


def monthly_stats(df: DataFrame) -> DataFrame:
    return valid_sales(df).groupBy(month(F.col("ts")).alias("window_key")).agg(F.count("*").alias("rows"), F.countDistinct("invoice").alias("invoices"), F.sum("quantity").alias("total_quantity"), F.sum("utility").alias("total_utility"))


def products(df: DataFrame) -> DataFrame:
    """Totals by stock code and, if there is such a column, description; a null description is a group of its own."""
    keys = ["stock", "description"] if "Description" in df.columns else ["stock"]
    out = valid_sales(df).groupBy(*keys).agg(F.sum("quantity").alias("total_quantity"), F.sum("utility").alias("total_utility"), F.countDistinct("invoice").alias("invoice_count"))
    return out.withColumnsRenamed({"stock": "stock_code"})


def top_products(df: DataFrame, by: str = "total_utility", n: int = 10) -> DataFrame:
    """The n first products by total_utility or total_quantity; ties by stock code, then description."""
    found = products(df)
    ties = [F.col(c).asc_nulls_first() for c in ("stock_code", "description") if c in found.columns]
    return found.orderBy(F.round(by, 6).desc(), *ties).limit(n)


def invoice_lengths(df: DataFrame) -> DataFrame:
    """Distinct items of each invoice, of all rows as they are."""
    return _raw(df).filter("invoice is not null").groupBy("invoice").agg(F.countDistinct("stock").alias("transaction_length")).withColumnRenamed("invoice", "invoice_no")


def invoice_utilities(df: DataFrame) -> DataFrame:
    """Utility of each invoice, of all rows as they are."""
    return _raw(df).filter("invoice is not null").groupBy("invoice").agg(F.sum("utility").alias("transaction_utility")).withColumnRenamed("invoice", "invoice_no")
