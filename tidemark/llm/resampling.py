"""Importance resampling of documents towards a target, over hashed n-grams, in two Arrow passes.

1.  Each partition counts its hashed features into one vector of `buckets` numbers, np.bincount of block after block; treeReduce
    adds the vectors up, of the documents and of the target texts alike. What reaches the driver are two vectors.
2.  Each bucket's gain, the logarithm of how much likelier it is in the target, is broadcast, as many numbers as there are
    buckets. The second pass gathers the gains of a document's features and adds them up with np.bincount weights.
3.  Documents are drawn by weight plus Gumbel noise, which is fixed by the id, so that the same rows are drawn each time. Ranks
    come from ranges of the order and offsets (functions/ordered.py), no task sees all scores.
"""

from __future__ import annotations

import math
from hashlib import sha256
from itertools import repeat
from operator import add
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import ranked
from .shared import materialise, split_blocks, whole

BUCKETS = 10_000
#: Text bytes of a block: its words are Python objects, of some ten times the size.
BLOCK = 2 << 20
#: Lower case for A-Z, a space for every other ASCII byte that is no digit or letter.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters (A-Z lower-cased), ASCII digits and all other characters beyond ASCII."""
    return text.translate(_FOLD).split()


def features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its number of words; of all features (words and pairs of neighbouring words) the bucket and the text's place."""
    words = [words_of(t) for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for ws in words for w in ws]
    single = np.fromiter(map(crc32, flat), np.uint32, len(flat))
    pairs = np.fromiter(map(crc32, flat[1:], map(crc32, repeat(b" "), single.tolist())), np.uint32, max(len(flat) - 1, 0))
    owner = np.repeat(np.arange(len(texts)), n)
    inside = owner[1:] == owner[:-1]
    return n, np.concatenate([single, pairs[inside]]).astype(np.int64) % buckets, np.concatenate([owner, owner[1:][inside]])


def _vectors(buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for (texts,) in split_blocks(batches, ["text"], BLOCK):
            total += np.bincount(features(texts, buckets)[1], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket's features occur in all texts: one vector for each partition, merged in a tree."""
    vectors = texts.mapInArrow(_vectors(buckets), "counts binary").rdd.map(lambda r: np.frombuffer(r.counts, np.int64))
    return vectors.treeReduce(add) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + B) / ((s + 1) (T + B)))) of every bucket, S and T the sums of s and t, B the number of buckets."""
    a, b = float(int(source.sum()) + len(source)), float(int(target.sum()) + len(target))
    return np.array([math.floor(1000 * math.log((float(t) + 1) * a / ((float(s) + 1) * b))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(id, seed: int) -> int:
    """Gumbel noise of an id, in thousandths; a null id counts as the empty text."""
    h = int(sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigh(gain, seed: int):
    def run(batches):
        each = gain.value
        for ids, texts in split_blocks(batches, ["id", "text"], BLOCK):
            n, bucket, owner = features(texts, len(each))
            held = np.bincount(owner, minlength=len(texts))
            sums = np.bincount(owner, weights=each[bucket], minlength=len(texts)).astype(np.int64)  # whole numbers far below 2**53
            weight = sums // np.maximum(held, 1)
            score = weight + np.fromiter((noise(i, seed) for i in ids), np.int64, len(ids))
            columns = (pa.array(ids, pa.int64()), pa.array(n), pa.array(held.astype(np.int64)), pa.array(weight), pa.array(score))
            yield pa.RecordBatch.from_arrays(list(columns), ["id", "n_words", "n_features", "weight", "score"])

    return run


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, n_features, weight, score, and rank, which those drawn have.

    Of the N rows with at least `least_words` words floor(percent N / 100) are drawn, the highest scores, ties to the smaller id
    (null first), then to any. weight is the floored mean of the gains of a text's features, 0 without features.
    Null and empty texts have no words; null ids take part, with the noise of an empty id; repeated rows stay rows, and copies of
    one row have one score and neighbouring ranks. An empty table of documents gives an empty result, without target texts all
    gains come from the documents alone. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    source = bucket_counts(docs.select(whole(text).alias("text")), buckets)
    wanted = bucket_counts(target.select(whole(text).alias("text")), buckets)
    gain = spark.sparkContext.broadcast(gains(source, wanted))
    rows = docs.select(F.col(id).cast("long").alias("id"), whole(text).alias("text"))
    scored = materialise(rows.mapInArrow(_weigh(gain, seed), "id long, n_words long, n_features long, weight long, score long"), "resampling-scores")
    able = F.col("n_words") >= least_words
    draws = scored.filter(able).count() * percent // 100
    ranks = ranked(scored.filter(able), [F.desc("score"), F.asc_nulls_first("id"), "n_features"])
    ranks = ranks.withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    return ranks.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))).withColumnRenamed("id", id)


def drawn(docs: DataFrame, ranks: DataFrame, id: str = "doc_id") -> DataFrame:
    """The rows of docs, with all their columns, that a table of `resample` has drawn; rows of one id go together, none has a null id."""
    return docs.join(ranks.filter("rank is not null").select(id), id, "left_semi")
