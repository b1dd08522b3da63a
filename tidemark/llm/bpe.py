"""BPE encoding through a table of distinct words, and decoding through a table of pieces.

Texts are split into words where the tokenizer always separates. Words are shuffled by hash, so that each distinct word of the
corpus is encoded once; the ids go back to the block of documents that asked, in the order in which its words were sent, and are
put in place of the words. A block holds a few MB of text; within it a word is sent once, so what is shuffled is the compressed
texts and a small part for words, and no word, however common, is more than one entry for each block.

To decode, a task sends the distinct ids of some rows ahead of the rows. They meet the table of pieces, which is as long as the
vocabulary and so is broadcast, and come out of the join as pieces ahead of the same rows, whose ids then become text. A join with
a broadcast table leaves the rows of a partition together and in order, so nothing is shuffled; where an id had no answer, the task
fails instead of leaving a gap.
"""

from __future__ import annotations

import array

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encoders import WordEncoder, file_bytes, once
from .shared import SLICE_ROWS, partitions, split_blocks, squeeze, unsqueeze, whole


def _block_number(seq: int) -> int:
    return (TaskContext.get().partitionId() << 32) | seq


def _dealt(texts: list[bytes], buckets: int) -> dict[int, list[bytes]]:
    """The distinct words of a block by bucket, each list in order."""
    out: dict[int, list[bytes]] = {}
    for word in sorted({w for t in texts for w in t.split()}):
        out.setdefault(xxhash.xxh32_intdigest(word) % buckets, []).append(word)
    return out


def _words(buckets: int):
    def run(batches):
        for seq, (_, texts) in enumerate(split_blocks(batches, ["id", "text"])):
            dealt = _dealt(texts, buckets)
            rows = [(b, _block_number(seq), zstandard.compress(b"\n".join(w), 1)) for b, w in dealt.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["bucket", "block", "words"])

    return run


def _blobs(batches):
    for seq, (ids, texts) in enumerate(split_blocks(batches, ["id", "text"])):
        sizes = squeeze(np.fromiter(map(len, texts), np.int64, len(texts)))
        yield pa.RecordBatch.from_arrays([pa.array([_block_number(seq)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.binary()), pa.array([zstandard.compress(b"".join(texts), 3)], pa.binary())], ["block", "ids", "sizes", "texts"])


def _encode(version: str, model):
    """Encode the distinct words of a bucket; for each block that asked, how many ids each of its words has, and the ids."""

    def run(batches):
        from .shared import runs

        encoder = once(WordEncoder, version, model.value)
        for t in runs(batches, "bucket"):
            table: dict[bytes, bytes] = {}
            for b in t.to_batches():
                rows = []
                for bucket, block, words in zip(b.column("bucket").to_pylist(), b.column("block").to_pylist(), b.column("words").to_pylist(), strict=True):
                    words = zstandard.decompress(words)
                    check = xxhash.xxh64_intdigest(words) >> 1
                    words = words.split(b"\n")
                    for w in words:
                        if w not in table:
                            table[w] = encoder.word(w)
                    ids = [table[w] for w in words]
                    rows.append((block, bucket, check, squeeze(np.fromiter(map(len, ids), np.uint32, len(ids))), zstandard.compress(b"".join(ids), 1)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "bucket", "check", "counts", "ids"])
        encoder.forget()

    return run


#: Columns of the rows that ask for pieces, and of the answers.
TOKEN, PIECE = "__token", "__piece"


def _asking(rows: pa.Table, ids: str) -> pa.Table:
    """The rows, behind one row for each distinct id in them that holds nothing else."""
    distinct = np.unique(np.frombuffer(b"".join(x for x in rows.column(ids).to_pylist() if x), "<u4")).astype(np.int64)
    asks = pa.table([pa.array(distinct)], names=[TOKEN])
    return pa.concat_tables([asks, rows], promote_options="default").select([*rows.column_names, TOKEN])


def _asked(ids: str):
    def run(batches):
        for b in batches:
            yield from _asking(pa.Table.from_batches([b]), ids).to_batches()

    return run


def _pieces(spark: SparkSession, encoder: WordEncoder) -> DataFrame:
    """The piece of every id of the vocabulary."""
    known = [(i, p) for i in range(encoder.size) if (p := encoder.lib.id_to_token(i)) is not None]
    ids, pieces = zip(*known, strict=True)
    return spark.createDataFrame(pa.table([pa.array(ids, pa.int64()), pa.array(pieces, pa.string())], names=[TOKEN, PIECE]))


def _texts(ids: str, joined: bool, version: str, model):
    """Rows behind the pieces they asked for, with decoded; ids without a piece are passed over, as the library does."""

    def run(batches):
        text = " ".join if joined else once(WordEncoder, version, model.value).lib.decoder.decode
        pieces: dict[int, str | None] = {}
        answering = gaps = False
        for b in batches:
            answer = b.column(TOKEN).is_valid().to_numpy(zero_copy_only=False)
            cuts = (np.flatnonzero(np.diff(answer)) + 1).tolist()
            for s, e in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if s == e:
                    continue
                if answer[s]:
                    part = b.slice(s, e - s)
                    if not answering:
                        pieces = {}
                    pieces.update(zip(part.column(TOKEN).to_pylist(), part.column(PIECE).to_pylist(), strict=True))
                    answering, gaps = True, None in pieces.values()
                    continue
                answering = False
                for part in (b.slice(at, min(SLICE_ROWS, e - at)) for at in range(s, e, SLICE_ROWS)):
                    decoded = []
                    for row in part.column(ids).to_pylist():
                        found = [] if row is None else list(map(pieces.__getitem__, np.frombuffer(row, "<u4").tolist()))
                        decoded.append(None if row is None else text([p for p in found if p is not None] if gaps else found))
                    kept = part.drop_columns([TOKEN, PIECE])
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(decoded, pa.large_string()).cast(pa.string())], [*kept.schema.names, "decoded"])

    return run


def _decoded(asked: DataFrame, encoder: WordEncoder, version: str, model, ids: str) -> DataFrame:
    """Rows of _asking with decoded in place of the ids that they asked for."""
    answered = asked.join(F.broadcast(_pieces(asked.sparkSession, encoder)), TOKEN, "left")
    order = [c for c in asked.columns if c != TOKEN]
    fields = [T.StructField(c, asked.schema[c].dataType) for c in order] + [T.StructField("decoded", T.StringType())]
    return answered.select(*[F.col(f"`{c}`") for c in order], TOKEN, PIECE).mapInArrow(_texts(ids, encoder.joined, version, model), T.StructType(fields))


def _assemble(version: str, model, kind: str, buckets: int, ask: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = {b: (c, n, i) for b, c, n, i in zip(right.column("bucket").to_pylist(), right.column("check").to_pylist(), right.column("counts").to_pylist(), right.column("ids").to_pylist(), strict=True)}
        out_ids, out_tokens = [], []
        for ids, sizes, blob in zip(left.column("ids").to_pylist(), left.column("sizes").to_pylist(), left.column("texts").to_pylist(), strict=True):
            blob, ends = zstandard.decompress(blob), np.cumsum(unsqueeze(sizes, np.int64)).tolist()
            texts = [blob[s:e] for s, e in zip([0, *ends], ends, strict=False)]
            table: dict[bytes, bytes] = {}
            for bucket, words in _dealt(texts, buckets).items():
                check, counts, flat = answers.get(bucket, (None, None, None))
                if check != xxhash.xxh64_intdigest(b"\n".join(words)) >> 1:  # the rows came in another order the second time
                    encoder = once(WordEncoder, version, model.value)
                    table.update((w, encoder.word(w)) for w in words)
                    continue
                flat, at = zstandard.decompress(flat), np.cumsum(unsqueeze(counts, np.uint32)).tolist()
                table.update((w, flat[s:e]) for w, s, e in zip(words, [0, *at], at, strict=False))
            for doc, text in zip(ids, texts, strict=True):
                tokens = array.array(kind, b"".join([table[w] for w in text.split()]))
                out_ids.append(doc)
                out_tokens.append(np.asarray(tokens).astype("<u4").tobytes())
        rows = pa.table([pa.array(out_ids, pa.int64()), pa.array(out_tokens, pa.binary())], names=["id", "ids"])
        return _asking(rows, "ids") if ask else rows

    return run


def encode(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", decode: bool = True) -> DataFrame:
    """One row for each row of docs: id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded.

    Ids are those of the tokenizers library with add_special_tokens=False; decoded is its decode(ids, skip_special_tokens=False),
    null if `decode` is false. Null and empty texts have no ids and decode to the empty text. Ids of rows may be null or equal;
    every row stays. An empty table gives an empty result. The tokenizer must separate at white space, else ValueError.
    """
    spark = docs.sparkSession
    data, version = file_bytes(tokenizer)
    encoder = WordEncoder(data)
    if not encoder.by_word:
        raise ValueError("this tokenizer does not always separate at white space")
    model = spark.sparkContext.broadcast(data)
    buckets = 2 * partitions(spark)
    rows = docs.select(F.col(id).cast("long").alias("id"), whole(text).alias("text"))
    words = rows.mapInArrow(_words(buckets), "bucket int, block long, words binary")
    known = words.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(_encode(version, model), "block long, bucket int, check long, counts binary, ids binary")
    blobs = rows.mapInArrow(_blobs, "block long, ids array<long>, sizes binary, texts binary")
    assemble = _assemble(version, model, encoder.kind, buckets, decode)
    out = blobs.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(assemble, f"id long, ids binary, {TOKEN} long" if decode else "id long, ids binary")
    out = _decoded(out, encoder, version, model, "ids") if decode else out.withColumn("decoded", F.lit(None).cast("string"))
    return out.select(F.col("id").alias(id), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """`encoded` with decoded, the text of a column of ids (little-endian unsigned 32-bit integers), as the library's
    decode(ids, skip_special_tokens=False) gives it, through a join with the table of pieces.

    Null ids give null, empty ones the empty text; ids that the vocabulary does not have are passed over. A column decoded is
    replaced, all others and all rows stay. An empty table gives an empty result.
    """
    data, version = file_bytes(tokenizer)
    rows = encoded.drop("decoded")
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema] + [T.StructField(TOKEN, T.LongType())])
    model = encoded.sparkSession.sparkContext.broadcast(data)
    return _decoded(rows.mapInArrow(_asked(ids), kind), WordEncoder(data), version, model, ids)
