"""Token ids as length-delimited binary records with a separate offset index.

A record, all integers little-endian:

    length      u64   bytes of the payload
    mask        u32   masked crc32 of those 8 bytes
    payload           flag u8 (1: the id is null), id i64, width u8 (bytes of one token id), token ids
    mask        u32   masked crc32 of the payload
    end         u8    0x0A

A masked checksum is the crc32 rotated right by 15 bits plus a constant, so that checksums of data that holds checksums stay
strong. Records lie in ascending order of id, within a file and over the files in order of name; Spark's own text writer
writes and commits the files, so they can lie in any store that Spark writes to and survive lost executors. The index is a
Parquet table with, for each record, its file, offset, size, tokens and the place of its first token in the whole sequence,
so that a reader can take records in any order.
"""

from __future__ import annotations

import array
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoders import WordEncoder, file_bytes, once
from .shared import partitions, whole

MASK_DELTA = 0xA282EAD8
HEAD, META = "<QI", "<BqB"
HEAD_SIZE, META_SIZE = struct.calcsize(HEAD), struct.calcsize(META)
#: Text bytes of a file, about; a reader holds a file at a time.
FILE_BYTES = 64 << 20
RECORD = "doc_id long, file string, offset long, size long, n_tokens long, local_start long, ids binary"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload)), b"\n"))


def frames(data: bytes) -> Iterator[tuple[int, memoryview]]:
    """Offset and payload of each record; a record that its checksums or length do not fit raises ValueError."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if at + HEAD_SIZE > len(data):
            raise ValueError(f"cut off header at {at}")
        length, check = struct.unpack_from(HEAD, view, at)
        if masked(bytes(view[at : at + 8])) != check:
            raise ValueError(f"wrong length checksum at {at}")
        start, end = at + HEAD_SIZE, at + HEAD_SIZE + length
        if end + 5 > len(data) or view[end + 4] != 10:
            raise ValueError(f"cut off record at {at}")
        payload = view[start:end]
        if masked(bytes(payload)) != struct.unpack_from("<I", view, end)[0]:
            raise ValueError(f"wrong payload checksum at {at}")
        yield at, payload
        at = end + 5


def _to_records(version: str, model, end_id: int | None):
    def run(batches):
        encoder = once(WordEncoder, version, model.value)
        width = array.array(encoder.kind).itemsize
        if end_id is not None and end_id >= 1 << (8 * width):
            raise ValueError("the end id does not fit")
        end = b"" if end_id is None else array.array(encoder.kind, [end_id]).tobytes()
        for b in batches:
            ids = b.column("id").to_pylist()
            out = [frame(struct.pack(META, i is None, i or 0, width) + t + end)[:-1] for i, t in zip(ids, encoder.column_ids(b.column("text")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return run


def _parts(payload) -> tuple[int | None, int, bytes]:
    """Id, width of a token id and the ids' bytes of a payload."""
    null, doc, width = struct.unpack_from(META, payload, 0)
    return (None if null else doc), width, bytes(payload[META_SIZE:])


def _wide(width: int, body: bytes) -> bytes:
    return array.array("I", array.array("H", body)).tobytes() if width == 2 else body


def _from_files(with_ids: bool):
    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows, start, size = [], 0, 0
                for at, payload in frames(content.as_buffer().to_pybytes()):
                    doc, width, body = _parts(payload)
                    n = len(body) // width
                    wide = _wide(width, body) if with_ids else b""
                    rows.append((doc, path, at, HEAD_SIZE + len(payload) + 5, n, start, wide))
                    start += n
                    size += len(wide) + 64
                    if size > 16 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return run


_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
_NAMES = ["doc_id", "file", "offset", "size", "n_tokens", "local_start", "ids"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def write_records(docs: DataFrame, tokenizer: str, path: str, id: str = "doc_id", text: str = "text", end_id: int | None = None, files: int | None = None) -> None:
    """Encode every whole text and write the records under `path`/data in ascending order of id, and the index under `path`/index.

    Null text is encoded as the empty text; null ids come first; rows with equal ids are ordered by their text. An empty table
    gives an empty folder. Very long texts are one record each. Other columns are not read. `files` defaults to the session's
    number of shuffle partitions, or more, so that a file comes to about FILE_BYTES of text; texts, which are smaller than
    their ids, are what is shuffled.
    """
    spark = docs.sparkSession
    data, version = file_bytes(tokenizer)
    model = spark.sparkContext.broadcast(data)
    rows = docs.select(F.col(id).cast("long").alias("id"), whole(text).alias("text"))
    if files is None:
        total = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()["bytes"] or 0
        files = max(partitions(spark), -(-total // FILE_BYTES))
    ordered = rows.repartitionByRange(files, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    records = ordered.mapInArrow(_to_records(version, model, end_id), "record binary")
    # The text writer puts a row's bytes out as they are; its line separator is the end byte of the format.
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/data")
    scan = read_files(spark, path, with_ids=False)
    totals = scan.groupBy("file").agg(F.sum("n_tokens").alias("tokens"))
    before = totals.select("file", (F.sum("tokens").over(Window.orderBy(*file_order())) - F.col("tokens")).alias("before"))  # one row for each file
    index = scan.drop("ids").join(before, "file").withColumn("start", F.col("before") + F.col("local_start"))
    index.drop("before", "local_start").write.parquet(f"{path}/index")


def file_order() -> list:
    """The order of files: by the number in their names, which has five digits or more, so that names do not sort by it."""
    return [F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).try_cast("long"), F.col("file")]


def read_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row for each record of the files: id, file, offset, size, n_tokens, tokens before it in its file, ids as u32."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
    return found.select("path", "content").mapInArrow(_from_files(with_ids), RECORD)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


#: Files up to which the first places of the files, one short row each, are broadcast; beyond, they are joined by shuffling.
BROADCAST_FILES = 200_000


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (u32, little-endian) of every record, from the files and their index."""
    starts = read_index(spark, path).groupBy("file").agg(F.min("start").alias("before"))
    small = starts.count() <= BROADCAST_FILES
    rows = read_files(spark, path).join(F.broadcast(starts) if small else starts, "file")
    return rows.select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _from_slices(batches):
    for b in batches:
        rows = []
        for place, record in zip(b.column("place").to_pylist(), b.column("record").to_pylist(), strict=True):
            (_, payload), *more = frames(record)
            if more:
                raise ValueError("the index does not fit the files")
            doc, width, body = _parts(payload)
            rows.append((place, doc, len(body) // width, _wide(width, body)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["place", "doc_id", "n_tokens", "ids"])


def read_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """place, doc_id, n_tokens and ids of the records at the rows of `places`: file, offset and size as in the index, and place,
    a number by which the caller orders them.

    Only files that hold such a record are opened, and only their records are cut out and checked. Repeated places give repeated
    rows; no places give an empty result.
    """
    wanted = places.select(*[F.col(c) for c in ("place", "file", "offset", "size")])
    files = [r["file"] for r in wanted.select("file").distinct().toLocalIterator()]  # names of files, few beside their records
    if not files:
        return spark.createDataFrame([], "place long, doc_id long, n_tokens long, ids binary")
    content = spark.read.format("binaryFile").load(files).select(F.col("path").alias("file"), "content")
    cut = content.join(wanted, "file").select("place", F.expr("substring(content, int(offset) + 1, int(size))").alias("record"))
    return cut.mapInArrow(_from_slices, "place long, doc_id long, n_tokens long, ids binary")


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """Every record once, with its place in an order that the seed decides."""
    index = read_index(spark, path)
    return read_at(spark, path, index.withColumn("place", F.xxhash64("file", "offset", F.lit(seed))))
