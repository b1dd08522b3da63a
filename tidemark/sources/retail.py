"""Sales rows from the star-schema tables: an order line is a row, its brand the item, its type the description."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def retail(spark: SparkSession, sf_dir: str, dirty: bool = False) -> DataFrame:
    """Columns of a sales file, and row_id, the order of its rows. With `dirty`, rows that break each rule are mixed in, and dates
    are day-first text."""
    line, orders, part, customer, nation = (_table(spark, sf_dir, t) for t in ("lineitem", "orders", "part", "customer", "nation"))
    if dirty:  # once for each order, not for each of its lines
        orders = orders.withColumn("o_orderdate", F.date_format("o_orderdate", "dd/MM/yyyy HH:mm"))
    # Orders are fewer than lines, so they meet their customers first; lines are shuffled twice, last by order.
    sold = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    rows = line.join(part, line.l_partkey == part.p_partkey).join(sold, line.l_orderkey == orders.o_orderkey)
    invoice = F.concat(F.when(F.col("o_orderstatus") == "P", "C").otherwise(""), F.col("o_orderkey").cast("string"))
    stock, quantity, price, date = F.col("p_brand"), F.col("l_quantity"), F.col("p_retailprice"), F.col("o_orderdate")
    if dirty:
        number, flag = F.col("l_linenumber"), F.col("l_returnflag")
        stock = F.when(~((number == 7) & (flag == "N")), stock)
        date = F.when((number == 4) & (flag == "N") & (quantity > 45), "bad").otherwise(date)
        price = F.when((number == 5) & (flag == "A"), 0.004).otherwise(price)
        quantity = F.when((number == 6) & (flag == "R"), -quantity).otherwise(quantity)
    return rows.select(
        invoice.alias("InvoiceNo"), stock.alias("StockCode"), F.when(F.col("p_partkey") % 50 != 0, F.col("p_type")).alias("Description"), quantity.alias("Quantity"), price.alias("UnitPrice"), date.alias("InvoiceDate"),
        F.col("c_custkey").cast("string").alias("CustomerID"), F.col("n_name").alias("Country"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
    )
