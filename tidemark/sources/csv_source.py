"""Sales files as CSV: encodings and separators are tried in turn, and everything is read as text.

One scan of the lines tells whether they are UTF-8 and whether a quoted field goes over a line's end; only files with such fields
are read whole by one task, all others in splits.
"""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.scalars import NULL_TOKENS
from ..schema import REQUIRED

SEPARATORS = (",", ";")


def wrong_separator(columns: list[str], separator: str) -> bool:
    """Whether a header read as one column was meant for the other separator."""
    if len(columns) != 1:
        return False
    if separator == ",":
        return ";" in columns[0]
    return "," in columns[0] and not any(r in columns[0].split(",") for r in REQUIRED) or columns[0].count(",") >= 2


@F.pandas_udf(StringType())
def _unescaped(lines: pd.Series) -> pd.Series:
    """Lines with \\\\x, \\\\u and other escapes as the characters they stand for; null where an escape is malformed."""

    def one(line: str | None) -> str | None:
        try:
            return None if line is None else codecs.decode(line.encode("latin-1"), "unicode_escape")
        except UnicodeError:
            return None

    return lines.map(one)


def _escapes(lines: DataFrame) -> DataFrame | None:
    """The lines of a file that is not UTF-8 with their escapes decoded; None if it has none, or malformed ones."""
    latin = lines.select(F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("value"))
    if latin.filter(F.contains("value", F.lit("\\"))).isEmpty():
        return None
    decoded = latin.select(F.when(F.contains("value", F.lit("\\")), _unescaped("value")).otherwise(F.col("value")).alias("value"))
    return None if not decoded.filter("value is null").isEmpty() else decoded


def _parsed(lines: DataFrame, separator: str) -> DataFrame:
    """Decoded lines as columns by the header, the first line."""
    header = lines.first().value
    schema = lines.sparkSession.read.option("header", True).option("sep", separator).csv(lines.sparkSession.sparkContext.parallelize([header])).columns
    ddl = ", ".join(f"`c{i}` string" for i in range(len(schema)))
    rows = lines.filter(F.col("value") != header).select(F.from_csv("value", ddl, {"sep": separator, "escape": '"'}).alias("r")).select("r.*")
    return rows.toDF(*schema)


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """The first plausible reading of a file, as text columns with trimmed names and row_id; ValueError if there is none.

    Bytes that are not UTF-8 make the file ISO-8859-1, with escapes such as \\\\xe9 decoded if there are any and all are well formed.
    Files with ; have decimal commas, which become points. Texts that stand for missing values become null.
    """
    lines = spark.read.text(path) if _exists(spark, path) else None
    if lines is None:
        raise ValueError(f"the file cannot be read: {path} is absent")
    odd = F.pmod(F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit(""))), F.lit(2)) == 1
    seen = lines.agg(F.coalesce(F.bool_and(F.expr("is_valid_utf8(value)")), F.lit(True)).alias("utf8"), F.coalesce(F.bool_or(odd), F.lit(False)).alias("multi")).first()
    escaped = None if seen.utf8 else _escapes(lines)
    reader = spark.read.option("header", True).option("encoding", "UTF-8" if seen.utf8 else "ISO-8859-1").option("multiLine", seen.multi).option("quote", '"').option("escape", '"')
    errors = []
    for separator in SEPARATORS:
        df = reader.option("sep", separator).csv(path) if escaped is None else _parsed(escaped, separator)
        df = df.toDF(*[c.replace("﻿", "").replace("ï»¿", "").strip() for c in df.columns])
        if not df.columns or wrong_separator(df.columns, separator):
            errors.append(f"{separator} does not part the columns")
            continue
        text = {c: F.when(~F.trim(F.col(f"`{c}`")).isin(*NULL_TOKENS), F.col(f"`{c}`")) for c in df.columns}
        if separator == ";":
            text |= {c: F.regexp_replace(text[c], ",", ".") for c in ("Quantity", "UnitPrice") if c in text}
        return df.select(*[x.alias(c) for c, x in text.items()], F.monotonically_increasing_id().alias("row_id"))
    raise ValueError("the file cannot be read: " + "; ".join(errors))


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition()):
            return False
        raise
    return True
