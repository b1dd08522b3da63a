"""Token counts through a digest cache.

Content digests are joined to counts stored under the tokenizer's version; only distinct contents that the cache lacks are
encoded, and their counts are appended. Texts are shuffled once and only when missing, after equal ones met in each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoders import PieceCounter, WordEncoder, file_bytes, once
from .shared import whole

CACHE = "digest string, n_tokens long"


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Counts stored for one tokenizer version; empty if none are."""
    try:
        return spark.read.schema(CACHE).parquet(f"{path}/tokenizer={version}")
    except AnalysisException:
        return spark.createDataFrame([], CACHE)


def _encode(kind, version: str, model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        encoder = once(kind, version, model.value)
        for b in batches:
            if kind is PieceCounter:
                counts = [encoder.count(x) for x in b.column("content").to_pylist()]
            else:
                counts = [len(encoder.ids(x.encode())) // (2 if encoder.kind == "H" else 4) for x in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, cache: str, text: str = "text", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """`docs` with n_tokens, the number of tokens of the whole text.

    tokenizer: path of a .model or .json file. cache: a shared folder that this call reads and appends to. normalise: changes
    that the tokenizer itself makes, so that contents which differ only by them share one entry; none by default, as both
    kinds of file may keep every character apart.
    Null text counts as the empty text. Equal texts are encoded once; repeated rows stay rows. An empty table gives an empty
    result. Other columns are kept; a column of docs named n_tokens is replaced.
    """
    spark = docs.sparkSession
    data, file_digest = file_bytes(tokenizer)
    kind = PieceCounter if tokenizer.endswith(".model") else WordEncoder
    content = (normalise or (lambda c: c))(whole(text))
    version = f"{kind.__name__}-{file_digest[:32]}"
    keyed = docs.drop("n_tokens").withColumn("__digest", F.sha2(content.cast("binary"), 256))
    asked = docs.select(F.sha2(content.cast("binary"), 256).alias("digest"), content.alias("content"))
    missing = asked.join(read_cache(spark, cache, version), "digest", "left_anti").dropDuplicates(["digest"])
    model = spark.sparkContext.broadcast(data)
    missing.mapInArrow(_encode(kind, version, model), CACHE).write.mode("append").parquet(f"{cache}/tokenizer={version}")
    known = read_cache(spark, cache, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keyed.join(known.withColumnRenamed("digest", "__digest"), "__digest", "left").drop("__digest")
