"""A corpus pipeline of five stages over `documents`; each stage reads what the one before it has written.

A stage's result reads tables that the stage has written to the shared folder. It is to be written before the next stage is called
in the same thread, as that deletes these tables (but for those that its own input still reads)."""

from __future__ import annotations

from contextvars import ContextVar
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, jaccard_join, substring_dedup, toxicity
from tidemark.llm.shared import delete, materialise, recorded, shared_dir, table

#: Ids up to which a list of documents to drop is broadcast; beyond, it is joined by shuffling.
BROADCAST_IDS = 1_000_000


#: Column that tells the rows of a stage's documents apart.
ROW = "__row"


#: Folders of tables that stages before have left, in this thread.
_LEFT: ContextVar[tuple[str, ...]] = ContextVar("left", default=())


def _stage(f):
    """A stage that first deletes the tables of those before it: their results are written, and kept tables of all stages would add up."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left, read = _LEFT.get(), docs.inputFiles() if _LEFT.get() else []
        kept = tuple(p for p in left if any(f"/{p.rsplit('/', 1)[1]}/" in r for r in read))
        delete(spark, [p for p in left if p not in kept])
        _LEFT.set(kept)
        with recorded() as paths:
            found = f(spark, docs, sf_dir)
        _LEFT.set((*kept, *paths))
        return found

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, in the order of ids, those without an id last, and of equal ids by a hash of the row, so that
    it is the same in every run; written, so that it stays the same. Rows that are equal throughout may change places."""
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and t != "variant"]))
    return materialise(ordered.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows")


def _drop(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs of _keyed without these rows, and without the numbers."""
    rows = rows.select(ROW)
    return docs.join(F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows, ROW, "left_anti").drop(ROW)


@_stage
def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is 0.5 or more."""
    lexicon = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, lexicon).filter("score < 0.5").select(*docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of linked documents the first row with the smallest id."""
    columns, docs = docs.columns, _keyed(docs)
    classes = jaccard_join.jaccard_classes(docs, id=ROW)
    return _drop(docs, materialise(classes.filter(f"{ROW} <> component_id").select(ROW), "pipeline-duplicates")).select(*columns)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that an earlier row (by id) has; a document of which nothing is left goes.

    n_chars follows the text where it is cut; all other columns stay, also those named like the operator's own."""
    hidden = {c: f"__{c}" for c in ("n_words", "spans") if c in docs.columns}
    found = substring_dedup.repeated_passages(_keyed(docs.withColumnsRenamed(hidden)), id=ROW, cut=True)
    changed = F.exists("spans", lambda s: s["first_id"] != F.col(ROW))
    n_chars = F.when(changed, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")).alias("n_chars")
    return found.filter(~changed | (F.col("text") != "")).select(*[n_chars if c == "n_chars" else F.col(f"`{hidden.get(c, c)}`").alias(c) for c in docs.columns])


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages."""
    columns, docs = docs.columns, _keyed(docs)
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), id=ROW).filter("contaminated").select(ROW)
    return _drop(docs, materialise(found, "pipeline-leaks")).select(*columns)


@_stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of ids and of the text that they decode to."""
    coded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]

#: The learnt lexicon and the tokenizer cannot be said in SQL; a test holds the stages against what a small table must give.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = shared_dir(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if k:
            delete(spark, [before])
        docs, before = spark.read.parquet(path), path
    return docs
