"""A two-word language model by deleted interpolation.

The probability of a word after another is a mixture of the two-word maximum-likelihood estimate, the one-word estimate and a
uniform share; the weights depend on how often the context was seen, in buckets of powers of two. The counts come from the
training documents. The weights come from expectation-maximisation on a part of them that is deleted from the counts for that
purpose, so that they are learnt on text that the counts have not seen.

Words and pairs of words are counted once for each block of documents; the blocks' counts are shuffled by hash, added up, and
sent back in the order in which they came. So no count, however common its word, is more than one entry for each block, and
scoring needs no join of single tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WordHashes, ascii_lower, fold_of, materialise, mix, partitions, runs, split_blocks, squeeze, squeeze_sorted, unsqueeze, unsqueeze_sorted, whole

#: Folds of crc32 of the id, modulo FOLDS: HELD_OUT is not learnt from; DELETED is the part the weights are learnt on.
FOLDS, HELD_OUT, DELETED = 7, 2, 3
#: Context buckets, by the power of two of a context's count; bins for a probability, two for each power of two, 0 for none.
CONTEXTS, BINS = 24, 64
END = xxhash.xxh64_intdigest(b"\n")  # no word holds white space


def _tokens(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, one end after each text, and where each text ends."""
    words = [ascii_lower(t).split() for t in texts]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    out = np.empty(int(ends[-1]), np.uint64)
    out[ends - 1] = END
    inside = np.ones(len(out), bool)
    inside[ends - 1] = False
    out[inside] = hashes.of([w for ws in words for w in ws])
    return out, ends


def _keys(tokens: np.ndarray) -> list[np.ndarray]:
    """Keys of the words, and of each word with the one before it; before a text's first word stands an end."""
    before = np.r_[np.uint64(END), tokens[:-1]]
    with np.errstate(over="ignore"):
        return [tokens, mix(before * np.uint64(0x9E3779B97F4A7C15) + (tokens ^ np.uint64(0x2545F4914F6CDD1D)))]


def _dealt(keys: np.ndarray, kind: int, buckets: int):
    """Bucket, and the ascending keys' places, of what a block asks for."""
    bucket = ((keys >> np.uint64(36)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(keys)]
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        if e > s:
            yield kind * buckets + int(bucket[order[s]]), order[s:e]


def _ask(buckets: int):
    def run(batches):
        hashes, task = WordHashes(), TaskContext.get().partitionId() << 32
        for seq, (folds, texts) in enumerate(split_blocks(batches, ["fold", "text"])):
            tokens, ends = _tokens(texts, hashes)
            fold = np.repeat(np.array(folds), np.diff(ends, prepend=0))
            rows = []
            for kind, each in enumerate(_keys(tokens)):
                keys, at = np.unique(each, return_inverse=True)
                train = np.bincount(at, weights=fold != HELD_OUT).astype(np.uint32)
                deleted = np.bincount(at, weights=fold == DELETED).astype(np.uint32)
                rows += [(bucket, task | seq, squeeze_sorted(keys[p]), squeeze(train[p]), squeeze(deleted[p])) for bucket, p in _dealt(keys, kind, buckets)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "keys", "train", "deleted"])

    return run


_ANSWER = "block long, bucket int, check long, train binary, deleted binary, tokens long, types long, deleted_tokens long"


def _answer(buckets: int):
    """Add up the counts of a bucket and answer each block in the order of its keys."""

    def run(batches):
        for t in runs(batches, "bucket"):
            bucket, blocks = t.column("bucket")[0].as_py(), t.column("block").to_pylist()
            asked = [unsqueeze_sorted(x.as_py()) for x in t.column("keys")]
            keys, at = np.unique(np.concatenate(asked), return_inverse=True)
            train = np.bincount(at, weights=np.concatenate([unsqueeze(x.as_py(), np.uint32) for x in t.column("train")])).astype(np.uint32)
            deleted = np.bincount(at, weights=np.concatenate([unsqueeze(x.as_py(), np.uint32) for x in t.column("deleted")])).astype(np.uint32)
            one = bucket < buckets  # words, not pairs
            sums = (int(train.sum(dtype=np.int64)), int((train > 0).sum()), int(deleted.sum(dtype=np.int64))) if one else (0, 0, 0)
            start = 0
            for block, sent in zip(blocks, asked, strict=True):
                p = at[start : start + len(sent)]
                start += len(sent)
                check = xxhash.xxh64_intdigest(sent.tobytes()) >> 1
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((block, bucket, check, squeeze(train[p]), squeeze(deleted[p]), *sums), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["block", "bucket", "check", "train", "deleted", "tokens", "types", "deleted_tokens"])
                sums = (0, 0, 0)

    return run


def _blobs(batches):
    task = TaskContext.get().partitionId() << 32
    for seq, (ids, folds, texts) in enumerate(split_blocks(batches, ["id", "fold", "text"])):
        sizes = squeeze(np.fromiter(map(len, texts), np.int64, len(texts)))
        yield pa.RecordBatch.from_arrays([pa.array([task | seq], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([folds], pa.list_(pa.int32())), pa.array([sizes], pa.binary()), pa.array([zstandard.compress(b"".join(texts), 3)], pa.binary())], ["block", "ids", "folds", "sizes", "texts"])


def context_of(counts: np.ndarray) -> np.ndarray:
    """Bucket of a context by its count: 0 for none, then one for each power of two."""
    return np.minimum(np.ceil(np.log2(counts.astype(np.float64) + 1)).astype(np.int64), CONTEXTS - 1)


def _bin(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(1 + np.floor(-2 * np.log2(np.maximum(p, 1e-300))), 1, BINS - 1), 0).astype(np.int64)


def bin_value(bins: np.ndarray) -> np.ndarray:
    return np.where(bins > 0, 2.0 ** (-(bins - 0.5) / 2), 0.0)


_COUNTED = "ids array<long>, folds array<int>, lengths binary, words binary, pairs binary, cells binary, cell_counts binary"


def _assemble(buckets: int, main_tokens: int):
    """Counts of each token and pair of a block's texts, and a grid of the deleted part's probabilities by context bucket."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = {r["bucket"]: r for r in right.to_pylist()}
        out = []
        for b in left.to_pylist():
            blob, to = zstandard.decompress(b["texts"]), np.cumsum(unsqueeze(b["sizes"], np.int64)).tolist()
            tokens, ends = _tokens([blob[s:e] for s, e in zip([0, *to], to, strict=False)], WordHashes())
            found = []
            for kind, each in enumerate(_keys(tokens)):
                keys, at = np.unique(each, return_inverse=True)
                train, deleted = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint32)
                for bucket, p in _dealt(keys, kind, buckets):
                    a = answers.get(bucket)
                    if a is None or a["check"] != xxhash.xxh64_intdigest(keys[p].tobytes()) >> 1:
                        raise ValueError("the documents came in another order when read again; write them to a table first")
                    train[p], deleted[p] = unsqueeze(a["train"], np.uint32), unsqueeze(a["deleted"], np.uint32)
                found.append((train[at], deleted[at]))
            (words, words_deleted), (pairs, pairs_deleted) = found
            lengths = np.diff(ends, prepend=0)
            mine = np.repeat(np.array(b["folds"]) == DELETED, lengths)
            main = (words - words_deleted).astype(np.float64)
            # An end's count stands for the start of a text: each text has one end.
            end_count = main[ends[0] - 1]
            context = np.r_[end_count, main[:-1]]
            pair = np.divide((pairs - pairs_deleted), context, out=np.zeros(len(main)), where=context > 0)
            cell = (context_of(context[mine]) * BINS + _bin(pair[mine])) * BINS + _bin(main[mine] / max(1, main_tokens))
            cells, counts = np.unique(cell, return_counts=True)
            out.append((b["ids"], b["folds"], squeeze(lengths), squeeze(words, 3), squeeze(pairs, 3), squeeze(cells), squeeze(counts)))
        kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 5)
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=["ids", "folds", "lengths", "words", "pairs", "cells", "cell_counts"])

    return run


def _grid(batches):
    for b in batches:
        for cells, counts in zip(b.column("cells").to_pylist(), b.column("cell_counts").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(unsqueeze(cells, np.int64)), pa.array(unsqueeze(counts, np.int64))], ["cell", "n"])


def expectation_maximisation(cells: np.ndarray, counts: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights of pair, word and uniform share for each context bucket, from the counted grid."""
    bucket, pair, word = cells // (BINS * BINS), bin_value(cells // BINS % BINS), bin_value(cells % BINS)
    parts = np.stack([pair, word, np.full(len(cells), uniform)], 1)
    weights = np.full((CONTEXTS, 3), 1 / 3)
    weights[0] = (0.0, 0.5, 0.5)  # an unseen context has no pair estimate
    for _ in range(rounds):
        share = parts * weights[bucket]
        share *= (counts / np.maximum(share.sum(1), 1e-300))[:, None]
        total = np.stack([np.bincount(bucket, weights=share[:, k], minlength=CONTEXTS) for k in range(3)], 1).astype(np.float64)
        total += 0.1 * weights  # keeps the weights of buckets without counts, and none quite at 0
        weights = total / total.sum(1, keepdims=True)
    return weights


def _score(tokens: int, types: int, weights: np.ndarray):
    def run(batches):
        for b in batches:
            for ids, folds, lengths, words, pairs in zip(*(b.column(c).to_pylist() for c in ("ids", "folds", "lengths", "words", "pairs")), strict=True):
                lengths, words, pairs = unsqueeze(lengths, np.int64), unsqueeze(words, np.uint32).astype(np.float64), unsqueeze(pairs, np.uint32)
                starts = np.cumsum(lengths) - lengths
                context = np.r_[words[lengths[0] - 1], words[:-1]]
                w = weights[context_of(context)]
                pair = np.divide(pairs, context, out=np.zeros(len(words)), where=context > 0)
                p = w[:, 0] * pair + w[:, 1] * words / max(1, tokens) + w[:, 2] / (types + 1)
                base = np.log10((words + 1) / (tokens + (types + 1)))
                columns = [
                    (ids, pa.int64()), ([f == HELD_OUT for f in folds], pa.bool_()), (lengths, pa.int64()), (np.add.reduceat((words > 0).astype(np.int64), starts), pa.int64()),
                    (np.full(len(ids), tokens), pa.int64()), (np.add.reduceat(base, starts), pa.float64()), (np.add.reduceat(np.log10(p), starts), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score and score, both in log10.

    Tokens are runs without ASCII white space, A-Z lower-cased, then one end for each text; null texts are empty and have the end
    alone. Learns from rows whose crc32 of the id as text, modulo 7, is not 2 (a null id counts as the empty text). base_score is
    the one-word model with one added to every count. Repeated rows stay rows and count as often as they come; an empty table
    gives an empty result. Words are told apart by 64-bit hashes. The documents are read twice, and must come in the same order
    each time, as from files; otherwise this fails and says so.
    """
    spark = docs.sparkSession
    buckets = partitions(spark)
    rows = docs.select(F.col(id).cast("long").alias("id"), fold_of(id, FOLDS).cast("int").alias("fold"), whole(text).alias("text"))
    asked = rows.mapInArrow(_ask(buckets), "bucket int, block long, keys binary, train binary, deleted binary")
    answers = materialise(asked.repartition(2 * buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer(buckets), _ANSWER), "lm-answers")
    sums = answers.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"), F.sum("deleted_tokens").alias("deleted")).first()
    tokens, types, deleted = sums.tokens or 0, sums.types or 0, sums.deleted or 0
    blobs = rows.mapInArrow(_blobs, "block long, ids array<long>, folds array<int>, sizes binary, texts binary")
    counted = blobs.groupBy("block").cogroup(answers.select("block", "bucket", "check", "train", "deleted").groupBy("block")).applyInArrow(_assemble(buckets, tokens - deleted), _COUNTED)
    counted = materialise(counted, "lm-counted")
    # At most CONTEXTS * BINS * BINS cells.
    grid = counted.select("cells", "cell_counts").mapInArrow(_grid, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    weights = expectation_maximisation(grid.column("cell").to_numpy(), grid.column("n").to_numpy().astype(np.float64), 1 / (types + 1))
    scored = counted.select("ids", "folds", "lengths", "words", "pairs").mapInArrow(_score(tokens, types, weights), "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("id", id)
