"""Invented sales rows, the same for the same seed and any partitioning.

Every draw is a hash of the seed, what is drawn and for whom; choices with given shares compare it with cumulative shares, and k of
m things are the k with the least hashes.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import ranked

PRODUCTS, COMMON = 24, 12
#: Products bought together, the month after the first in which they peak, and their share of its invoices.
COMBOS = (((1, 2, 3), 1, 0.30), ((10, 11, 12), 3, 0.26), ((20, 21), 4, 0.24))
#: The share of invoices with such products in other months, with further products, cancelled; of rows without description.
OFF_PEAK, FURTHER, CANCELLED, NAMELESS = 0.04, 0.25, 0.015, 0.01
#: Countries and their shares.
COUNTRIES = (("United Kingdom", 0.82), ("France", 0.06), ("Germany", 0.05), ("Netherlands", 0.04), ("EIRE", 0.03))


def synthetic_retail(spark: SparkSession, rows: int = 1500, start: str = "2011-01-01", months: int = 6, seed: int = 42) -> DataFrame:
    """So many sales rows, 50 at least, over the months from `start`: 24 products, three combinations that peak in a month each, a few
    cancelled invoices and missing descriptions. Dates are day-first text. ValueError for fewer rows or no month."""
    if rows < 50 or months < 1:
        raise ValueError("at least 50 rows and 1 month are needed")

    def u(name: str, *of: str | Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(f"{seed}-{name}"), *[F.col(c) if isinstance(c, str) else c for c in of]), F.lit(1 << 30)).cast("double") / float(1 << 30)

    def between(name: str, low: int, high: int, *of: str) -> Column:
        return (F.floor(u(name, *of) * (high - low + 1)) + low).cast("int")

    def some(name: str, of: range, k: Column) -> Column:
        by_hash = F.array_sort(F.array(*[F.struct(u(name, "invoice", F.lit(p)).alias("u"), F.lit(p).alias("p")) for p in of]))
        return F.slice(F.transform(by_hash, lambda x: x["p"]), 1, k)

    # An invoice has three products or more on average, so that half as many invoices as rows, and some, are enough.
    r = spark.range(rows // 2 + 50).withColumnRenamed("id", "invoice").withColumn("month", between("month", 0, months - 1, "invoice"))
    none = F.array().cast("array<int>")
    chosen = [some("common", range(1, COMMON + 1), between("common-n", 1, 5, "invoice")), F.when(u("more", "invoice") < FURTHER, some("further", range(1, PRODUCTS + 1), between("further-n", 1, 3, "invoice"))).otherwise(none)]
    for i, (products, peak, share) in enumerate(COMBOS):
        odds = F.when(F.col("month") == peak % months, share).otherwise(OFF_PEAK)
        chosen.append(F.when(u(f"combo-{i}", "invoice") < odds, F.array(*map(F.lit, products))).otherwise(none))
    r = r.withColumn("product", F.explode(F.array_distinct(F.concat(*chosen))))
    r = ranked(r, ["invoice", "product"], "place").filter(F.col("place") <= rows)
    first = F.add_months(F.lit(start).cast("date"), F.col("month"))
    day = F.date_add(first, F.floor(u("day", "invoice") * F.dayofmonth(F.last_day(first))).cast("int"))
    r = r.withColumn("day", day).withColumn("hour", between("hour", 8, 18, "invoice")).withColumn("minute", 5 * between("minute", 0, 11, "invoice"))
    country = F.lit(COUNTRIES[-1][0])
    for name, upto in reversed(list(zip([c for c, _ in COUNTRIES], accumulate(s for _, s in COUNTRIES), strict=True))[:-1]):
        country = F.when(u("country", "place") < upto, name).otherwise(country)
    return r.select(
        F.concat(F.when(u("cancel", "invoice") < CANCELLED, "C").otherwise(""), (F.col("invoice") + 100000).cast("string")).alias("InvoiceNo"),
        F.format_string("SYN%d", F.col("product") + 1000).alias("StockCode"),
        F.when(u("null", "place") >= NAMELESS, F.format_string("Product %d", F.col("product"))).alias("Description"),
        between("quantity", 1, 8, "place").cast("string").alias("Quantity"),
        F.concat(F.date_format("day", "dd/MM/yyyy"), F.format_string(" %02d:%02d", "hour", "minute")).alias("InvoiceDate"),
        F.round((F.col("product") * 0.75 + 1.25) * (0.9 + 0.25 * u("price", "place")), 2).cast("string").alias("UnitPrice"),
        country.alias("Country"), (F.col("place") - 1).alias("row_id"),
    )
