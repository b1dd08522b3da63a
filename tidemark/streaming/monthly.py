"""An extension: monthly totals of a stream of sales rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import int_utility, month


def monthly_totals(rows: DataFrame, late: str = "31 days") -> DataFrame:
    """Rows, quantity and rounded utility by month of a stream with ts, quantity, unit_price.

    Rows later than `late` behind the newest one may be dropped by the watermark; months are kept in state until it has passed
    their days.
    """
    sold = rows.filter((F.col("quantity") > 0) & (F.col("unit_price") > 0)).withWatermark("ts", late)
    days = sold.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("rows"), F.sum("quantity").alias("quantity"), F.sum(int_utility(F.col("quantity"), F.col("unit_price"))).alias("utility"))
    return days.select(month(F.col("window.start")).alias("window_key"), F.to_date("window.start").alias("day"), "rows", "quantity", "utility")
