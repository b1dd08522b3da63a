"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
#: Day-first formats, and ISO dates read as what they say; no two have as many strokes and colons.
DATE_FORMATS = ("d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
#: Texts that stand for a missing value in CSV files.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def column_or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def text(df: DataFrame, name: str) -> Column:
    return column_or_null(df, name).cast("string")


def number(df: DataFrame, name: str) -> Column:
    """A double; text that is not a plain number becomes null."""
    c = column_or_null(df, name)
    if dict(df.dtypes).get(name, "string") != "string":
        return c.cast("double")
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def timestamp(df: DataFrame, name: str, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """A timestamp; typed columns stay as they are, text is read by the one format that has its strokes and colons, else null.

    Each text is parsed once, whatever the format of its column, and no pass over the column is needed to find that out.
    """
    c = column_or_null(df, name)
    if dict(df.dtypes).get(name, "string") != "string":
        return c.cast("timestamp")
    if len({_marks(f) for f in formats}) < len(formats):  # marks do not tell these formats apart
        return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats])
    count = lambda mark: F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))
    none = F.lit(None).cast("timestamp")
    out = none
    for strokes in {_marks(f)[0] for f in formats}:
        of_colons = none
        for f in formats:
            if _marks(f)[0] == strokes:
                of_colons = F.when(count(":") == _marks(f)[1], F.try_to_timestamp(F.trim(c), F.lit(f))).otherwise(of_colons)
        out = F.when(count("/") == strokes, of_colons).otherwise(out)
    return out


def _marks(date_format: str) -> tuple[int, int]:
    return date_format.count("/"), date_format.count(":")


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def int_utility(quantity: Column, price: Column) -> Column:
    """The product, rounded half to even."""
    return F.rint(quantity * price).cast("long")


def pattern_key(items: Column) -> Column:
    """Item ids in numeric order, parted by spaces."""
    return F.array_join(F.transform(F.array_sort(items), lambda i: i.cast("string")), " ")


def mining_threshold(total: Column, ratio: float) -> Column:
    return (total * F.lit(float(ratio))).cast("long")


def hiding_threshold(total: Column, ratio: float) -> Column:
    """0 without utility, else at least 1."""
    return F.when(total <= 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), (total * F.lit(float(ratio))).cast("long")))


def label(item: Column, stock_code: Column, description: Column) -> Column:
    """ItemID n | StockCode s | Description d, as far as they are known."""
    named = F.concat(F.lit(" | StockCode "), stock_code)
    described = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit(" | Description "), description)).otherwise("")
    return F.concat(F.lit("ItemID "), item.cast("string"), F.coalesce(F.concat(named, described), F.lit("")))


def short_text(labels: Column, most: int = 5) -> Column:
    """The first labels joined by bars, and how many more there are."""
    more = F.size(labels) - most
    return F.concat(F.array_join(F.slice(labels, 1, most), " | "), F.when(more > 0, F.concat(F.lit(" | +"), more.cast("string"), F.lit(" more"))).otherwise(""))
