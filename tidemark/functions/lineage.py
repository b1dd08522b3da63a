"""Cutting the lineage of iterative plans in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir.

    Only in local mode, as in tests on one machine, may that setting be absent: then a temporary folder takes its place."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """The same rows from a table written to the shared folder: computed once, and read by later plans with known sizes."""
    spark = df.sparkSession
    path = f"{shared(spark)}/lineage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
