"""What the stages of a run leave behind, as folders of JSON, CSV and text that Spark writes, and how finished ones are read back.

A stage writes tables, not one document: each line of a JSON folder is a month, a pattern or a record, so that no task holds a
whole database. Names of the folders are fixed values, which other tools look for.
"""

from __future__ import annotations

import json
from functools import reduce
from json import JSONDecodeError

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packing import packed
from ..operators import prepare, sanitize, verify
from ..plans.run import Mined, Prepared, Sanitized
from ..schema import Params
from .huim_text import transaction_lines

#: Names of what each stage writes.
PREPARED = ("temporal_db.json", "temporal_db_metadata.json", "temporal_db_windows.json", "preprocess_report.json", "item_mapping.json", "tx_before_filter.csv", "tx_after_filter.csv")
MINED = ("phase1_peak_shui.json", "phase1_pattern_stats.json", "phase1_item_scores.json", "phase1_windows.json")
SANITIZED = ("phase2_sanitized_db.json", "phase2_summary.json", "phase2_modifications.json", "modified_transactions.csv", "sanitized_retail.txt")
VERIFIED = ("phase3_verification_report.json", "phase3_window_metrics.csv", "phase3_pattern_metrics.csv")
#: Results of a comparison of methods, which are shown where they are found and made by nobody here.
COMPARISON_REPORT = "comparison_report.json"
COMPARISONS = (
    "00_high_level_summary.csv", "01_static_efim_hui.csv", "02_temporal_selected_pshui.csv", "03_static_vs_temporal.csv", "04_static_vs_temporal_summary.csv",
    "05_phase2_summary.csv", "06_phase2_window_summary.csv", "07_method_static_vs_temporal.csv", "08_algorithm_comparison.csv",
)
#: Other names under which a transaction database is found, best first.
ALIASES = {"temporal_db.json": ("temporal_db_filtered.json", "temporal_db_original.json")}
#: Every name that an import recognises.
KNOWN = (*PREPARED, *MINED, *SANITIZED, *VERIFIED, *ALIASES["temporal_db.json"], COMPARISON_REPORT, "comparison_report.xlsx", *COMPARISONS)
#: Columns that a finished artifact should have; others are welcome.
EXPECTED = {
    "temporal_db.json": ("window_key", "tid", "items", "item_utils", "transaction_utility"),
    "item_mapping.json": ("item_id", "stock_code"),
    "phase1_peak_shui.json": ("pattern_key", "selected_window", "window_utility"),
    "phase2_sanitized_db.json": ("window_key", "tid", "items", "item_utils", "transaction_utility"),
    "phase3_verification_report.json": ("pass_integrity", "pass_local", "pass_global"),
}

#: A database as one document: months by key, transactions inside.
DOCUMENT = "windows map<string,struct<transactions:array<struct<tid:string,invoice_no:string,window:string,items:array<int>,item_utils:map<string,bigint>,transaction_utility:bigint,tu:bigint>>>>"
DATABASE = "window_key string, tid string, invoice_no string, items array<int>, item_utils map<string,bigint>, transaction_utility bigint, length int"


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, as CSV has no other form for them."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])


def _write(df: DataFrame, base: str, name: str, months: bool = False) -> None:
    writer, path = df.write.mode("overwrite"), f"{base.rstrip('/')}/{name}"
    writer = writer.partitionBy("window_key") if months else writer
    if name.endswith(".csv"):
        _flat(df).write.mode("overwrite").option("header", True).csv(path)
    elif name.endswith(".txt"):
        writer.text(path)
    else:
        writer.json(path)


def database(tx_item: DataFrame, tx: DataFrame) -> DataFrame:
    """One row for each transaction, emptied ones included, with its items in order and their utilities."""
    utils = F.map_from_entries(F.transform("x", lambda v: F.struct(v["item_id"].cast("string"), v["util"])))
    return packed(tx_item, tx).select("window_key", "tid", "invoice_no", F.col("x.item_id").alias("items"), utils.alias("item_utils"), "transaction_utility", F.size("x").alias("length"))


def facts(db: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tx_item and tx of a database that was read. A transaction without a declared utility has the sum of its items."""
    each = db.select("window_key", "tid", "invoice_no", F.explode("item_utils").alias("item", "util"))
    tx_item = each.select("window_key", "tid", "invoice_no", F.col("item").cast("int").alias("item_id"), F.col("util").cast("long").alias("util"))
    total = F.aggregate(F.map_values("item_utils"), F.lit(0).cast("long"), lambda a, v: a + v)
    return tx_item, db.select("window_key", "tid", "invoice_no", F.coalesce("transaction_utility", total).alias("transaction_utility"), F.size("items").alias("length"))


def from_document(document: DataFrame) -> DataFrame:
    """Rows of DATABASE from databases that are one document each."""
    months = document.select(F.explode("windows").alias("key", "month")).select("key", F.explode("month.transactions").alias("t"))
    return months.select(F.coalesce("t.window", "key").alias("window_key"), "t.tid", "t.invoice_no", "t.items", "t.item_utils", F.coalesce("t.transaction_utility", "t.tu").alias("transaction_utility"), F.size("t.items").alias("length"))


def read_database(spark: SparkSession, base: str, name: str = "temporal_db.json") -> tuple[DataFrame, DataFrame]:
    """tx_item and tx of a database artifact, rows of transactions or one document; without rows if there is none."""
    path = locate(spark, base, name)
    if path is not None and not _is_rows(spark, path):
        return facts(from_document(spark.read.schema(DOCUMENT).option("multiLine", True).json(path)))
    return facts(optional(spark, base, name, DATABASE))


def _is_rows(spark: SparkSession, path: str) -> bool:
    """Whether the first line of a JSON artifact is a whole record of a transaction: a document has its months under `windows`."""
    first = spark.read.text(path).filter(F.trim("value") != "").select("value").first()
    try:
        return first is None or "tid" in json.loads(first.value)
    except JSONDecodeError:
        return False


def metadata(data: Prepared, params: Params) -> DataFrame:
    """One row: what the database was made from, and how much of it there is before and after the limit on length."""
    r = prepare.report(data.classified, data.tx_before, data.tx)
    return r.select(
        F.col("input_rows").alias("source_rows"), "clean_rows", F.lit(params.max_transaction_len).cast("int").alias("max_transaction_len"), F.lit(params.window_granularity).alias("window_granularity"), F.lit(params.utility_mode).alias("utility_mode"),
        "num_items", F.col("transactions_before_filter").alias("num_transactions_before_filter"), F.col("transactions_after_filter").alias("num_transactions_after_filter"), "utility_before_filter", "utility_after_filter",
    )


def write_prepared(data: Prepared, base: str, params: Params = Params()) -> None:
    _write(database(data.baskets, data.baskets), base, "temporal_db.json", months=True)
    _write(metadata(data, params), base, "temporal_db_metadata.json")
    _write(prepare.windows(data.tx), base, "temporal_db_windows.json")
    _write(prepare.report(data.classified, data.tx_before, data.tx), base, "preprocess_report.json")
    _write(data.items, base, "item_mapping.json")
    _write(prepare.nested(data.baskets_before), base, "tx_before_filter.csv")
    _write(prepare.nested(data.baskets), base, "tx_after_filter.csv")


def mining_windows(data: Prepared, found: Mined, params: Params) -> DataFrame:
    """For each month: its total, its threshold, and how many patterns were mined and selected in it."""
    count = lambda df, key, name: df.groupBy(F.col(key).alias("window_key")).agg(F.count("*").alias(name))
    limits = prepare.windows(data.tx).withColumn("min_util", (F.col("total_utility") * F.lit(float(params.candidate_mining_ratio))).cast("long"))
    out = limits.join(count(found.patterns, "window_key", "patterns"), "window_key", "left").join(count(found.selected, "selected_window", "selected"), "window_key", "left")
    return out.fillna(0, ["patterns", "selected"])


def ordered_stats(stats: DataFrame) -> DataFrame:
    """Pattern statistics, the largest ratios first, then the largest utilities."""
    return stats.orderBy(F.desc("max_ratio"), F.desc("max_utility"), "pattern_key")


def ordered_scores(scores: DataFrame) -> DataFrame:
    """Item scores, the largest first, then those selected most."""
    return scores.orderBy(F.desc("score"), F.desc("selected_count"), "item_id")


def write_mined(data: Prepared, found: Mined, base: str, params: Params = Params()) -> None:
    _write(found.selected, base, "phase1_peak_shui.json")
    _write(ordered_stats(found.stats), base, "phase1_pattern_stats.json")
    _write(ordered_scores(found.scores), base, "phase1_item_scores.json")
    _write(mining_windows(data, found, params), base, "phase1_windows.json")


def write_sanitized(data: Prepared, hidden: Sanitized, base: str, params: Params = Params()) -> None:
    _write(database(hidden.baskets, hidden.baskets), base, "phase2_sanitized_db.json", months=True)
    _write(sanitize.summary(hidden.definitions, data.baskets, data.baskets, hidden.modifications, hidden.baskets, hidden.baskets, params.local_ratio, params.global_ratio), base, "phase2_summary.json")
    _write(hidden.modifications, base, "phase2_modifications.json")
    _write(verify.compare(data.baskets, data.baskets, hidden.baskets, hidden.baskets, data.items, shared_only=True), base, "modified_transactions.csv")
    _write(transaction_lines(hidden.baskets, hidden.baskets).select("line"), base, "sanitized_retail.txt")


def write_verified(data: Prepared, hidden: Sanitized, base: str, params: Params = Params()) -> None:
    d = hidden.definitions
    _write(verify.report(d, data.baskets, data.baskets, hidden.baskets, hidden.baskets, data.items, params.local_ratio, params.global_ratio), base, "phase3_verification_report.json")
    _write(verify.local_hiding(d, data.tx, hidden.baskets, hidden.baskets, params.local_ratio), base, "phase3_window_metrics.csv")
    _write(verify.pattern_metrics(d, data.baskets, data.baskets, hidden.baskets, params.global_ratio), base, "phase3_pattern_metrics.csv")


def _read(spark: SparkSession, path: str, name: str, schema: str | None) -> DataFrame | None:
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        return reader.option("header", True).csv(path) if name.endswith(".csv") else reader.text(path) if name.endswith(".txt") else reader.json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition()) or "UNABLE_TO_INFER_SCHEMA" in str(e.getCondition()):
            return None
        raise


def locate(spark: SparkSession, base: str, name: str) -> str | None:
    """The path of the artifact of this name, or of another name that it goes by, in the folder itself or in any folder below, the
    least deep one, then the first by path; None if absent. Folders are listed in the store they are in, artifacts not entered."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(base)
    fs, level, seen = top.getFileSystem(conf), [top], {}
    if not fs.exists(top):
        return None
    names = (name, *ALIASES.get(name, ()))
    while level and name not in seen:
        below = []
        for folder in level:
            for status in fs.listStatus(folder):
                path = status.getPath()
                if path.getName() in names:
                    seen[path.getName()] = min(seen.get(path.getName(), path.toString()), path.toString())
                elif status.isDirectory() and path.getName() not in KNOWN:
                    below.append(path)
        level = below
    return next((seen[n] for n in names if n in seen), None)


def adopt(spark: SparkSession, folder: str, base: str) -> None:
    """Moves the folders name=... that a partitioned write has left to `base`, under their names; an older one is replaced."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(conf)
    for status in fs.listStatus(top) if fs.exists(top) else []:
        name = status.getPath().getName()
        if name.startswith("name="):
            plain = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name[5:])
            target = jvm.org.apache.hadoop.fs.Path(base, plain)
            fs.delete(target, True)
            fs.rename(status.getPath(), target)
    fs.delete(top, True)


def find(spark: SparkSession, base: str, name: str, schema: str | None = None) -> DataFrame | None:
    """The artifact of this name as a table, wherever below the folder it lies (see locate); None if absent or empty."""
    path = locate(spark, base, name)
    return None if path is None else _read(spark, path, name, schema)


def optional(spark: SparkSession, base: str, name: str, schema: str) -> DataFrame:
    """The artifact, or an empty table of this schema."""
    df = find(spark, base, name, schema)
    return spark.createDataFrame([], schema) if df is None else df


def _columns(spark: SparkSession, path: str, name: str) -> list[str]:
    """The columns of an artifact, of a JSON one those of its first rows."""
    if name.endswith(".json"):
        first = [r.value for r in spark.read.text(path).filter("value <> ''").limit(100).collect()]
        partitions = ["window_key"] if name.endswith("_db.json") else []
        schema = spark.range(1).select(*[F.schema_of_json(F.lit(line)).alias(f"c{i}") for i, line in enumerate(first) if line.startswith("{")]).first() if first else []
        return partitions + sorted({c for kind in schema or [] for c in _fields(kind)})
    found = _read(spark, path, name, None)
    return found.columns if found is not None else []


def _fields(kind: str) -> list[str]:
    from pyspark.sql.types import StructType

    parsed = StructType.fromDDL(f"r {kind}")[0].dataType
    return parsed.names if isinstance(parsed, StructType) else []


def imported(spark: SparkSession, base: str) -> dict:
    """Which artifacts a folder of finished results has, which are missing, and what those that are there lack. Nothing is refused."""
    names = PREPARED + MINED + SANITIZED + VERIFIED
    found = {n: path for n in names if (path := locate(spark, base, n)) is not None}
    warnings = []
    for n, columns in EXPECTED.items():
        if n in found and not (n.endswith("_db.json") and not _is_rows(spark, found[n])):
            have = _columns(spark, found[n], n)
            warnings += [f"{n}: no column {c}" for c in columns if c not in have]
    return {"found": sorted(found), "missing": [n for n in names if n not in found], "warnings": warnings}


#: The sections of the explorer, and the artifact that each shows.
SECTIONS = {
    "modified_transactions": "modified_transactions.csv", "selected_patterns": "phase1_peak_shui.json", "window_metrics": "phase3_window_metrics.csv", "pattern_metrics": "phase3_pattern_metrics.csv",
    "phase0_summary": "temporal_db_metadata.json", "phase2_summary": "phase2_summary.json", "comparison_summary": COMPARISON_REPORT, **{n: n for n in COMPARISONS},
}


def explorer_bundle(spark: SparkSession, base: str) -> DataFrame:
    """section and document: every record of the artifacts that a run's explorer shows, as JSON. Absent artifacts have no rows.

    A section may hold as many records as the database has transactions, so that they are rows, not one document."""
    parts = [spark.createDataFrame([], "section string, document string")]
    for section, name in SECTIONS.items():
        if (df := find(spark, base, name)) is not None:
            parts.append(df.select(F.lit(section).alias("section"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("document")))
    return reduce(DataFrame.unionByName, parts)
