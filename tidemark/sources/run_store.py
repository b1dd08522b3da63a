"""Runs as folders of Parquet tables and JSON metadata, in any store that Spark can reach."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that a finished run has; others may lie beside them.
KNOWN = ("raw", "tx_item", "tx", "items", "patterns", "selected", "item_scores", "modifications", "sanitized_item", "sanitized_tx", "report")


#: Bytes of a table that a download holds at a time.
CHUNK = 4 << 20


class RunStore:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def path(self, run_id: str, name: str = "") -> str:
        if not run_id.isalnum() or not all(p.replace("_", "").replace("-", "").isalnum() for p in ([name] if name else [])):
            raise ValueError("run ids and table names are letters and digits only")
        return f"{self.base}/{run_id}" + (f"/{name}" if name else "")

    def create(self, source: str) -> str:
        run_id = uuid.uuid4().hex
        row = [(run_id, source, datetime.now(timezone.utc).isoformat())]
        self.spark.createDataFrame(row, "run_id string, source string, created_at string").coalesce(1).write.json(self.path(run_id, "metadata"))
        return run_id

    def save(self, run_id: str, name: str, df: DataFrame, partition_by: str | None = None) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(self.path(run_id, name))

    def load(self, run_id: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(run_id, name))

    def optional(self, run_id: str, name: str, schema: str) -> DataFrame:
        """The table, or an empty one of this schema."""
        try:
            return self.load(run_id, name)
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def metadata(self, run_id: str) -> DataFrame:
        return self.spark.read.json(self.path(run_id, "metadata"))

    def runs(self) -> DataFrame:
        return self.spark.read.json(f"{self.base}/*/metadata")

    def outputs(self, run_id: str) -> DataFrame:
        """Tables of a run with files and bytes."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.path(run_id)).select("path", "length")
        named = files.withColumn("name", F.regexp_extract("path", f"/{run_id}/([^/]+)/", 1))
        return named.groupBy("name").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))

    def status(self, run_id: str) -> dict[str, bool]:
        """Which of the known tables a run has."""
        names = {r.name for r in self.outputs(run_id).select("name").collect()}  # one short row for each table
        return {k: k in names for k in KNOWN}

    def export(self, run_id: str, name: str, kind: str = "json") -> str:
        """A table as JSON or CSV beside it; nested columns become JSON text in CSV. Returns the folder."""
        df, path = self.load(run_id, name), f"{self.path(run_id)}/{name}_{kind}"
        if kind == "csv":
            nested = {c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))}
            df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns]).write.mode("overwrite").option("header", True).csv(path)
        else:
            df.write.mode("overwrite").json(path)
        return path

    def choose(self, run_id: str, keys: list[str]) -> None:
        """Keep the patterns that a user has chosen, each once, in place of those chosen before."""
        rows = [(k,) for k in sorted(set(keys))]
        self.spark.createDataFrame(rows, "pattern_key string").coalesce(1).write.mode("overwrite").parquet(self.path(run_id, "chosen"))

    def chosen(self, run_id: str) -> DataFrame:
        """The chosen patterns as a table for `temporal.restrict`; no rows if none were chosen."""
        return self.optional(run_id, "chosen", "pattern_key string")

    def download(self, run_id: str, name: str, kind: str = "json", chunk: int = CHUNK) -> Iterator[bytes]:
        """A table as one JSON-lines or CSV file, in pieces of at most `chunk` bytes, with one header.

        Executors write the parts, in the table's order; here they are read through one after the other, without being held.
        Without rows, JSON is nothing and CSV is the header.
        """
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.export(run_id, name, kind))
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        parts = sorted((int(m[1]), n) for n in names if (m := re.match(r"part-(\d+)", n)))
        header = b""
        for k, (_, part) in enumerate(parts):
            stream = fs.open(self.spark._jvm.org.apache.hadoop.fs.Path(folder, part))
            try:
                if kind == "csv" and k:
                    stream.seek(min(len(header), fs.getFileStatus(self.spark._jvm.org.apache.hadoop.fs.Path(folder, part)).getLen()))
                while piece := bytes(stream.readNBytes(chunk)):
                    if kind == "csv" and not k and not header.endswith(b"\n"):
                        header += piece[: piece.find(b"\n") + 1] or piece
                    yield piece
            finally:
                stream.close()
