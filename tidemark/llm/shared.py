"""What the operators of this subpackage have in common: tables, shared folders, row keys, worker-side helpers."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes gathered by a task before it packs them as one block.
BLOCK_BYTES = 8 << 20
#: Rows of an Arrow batch that are turned to Python objects at a time.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share, `spark.checkpoint.dir`.

    Only in local mode, as in tests on one machine, may the setting be absent: then a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _local_base()
    return base.rstrip("/")


@cache
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders of the tables that are written while `recorded` is on.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def recorded():
    """A list that gets the folder of each table of `materialise` that is written meanwhile, in this thread."""
    paths: list[str] = []
    token = _WRITTEN.set(paths)
    try:
        yield paths
    finally:
        _WRITTEN.reset(token)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage with files that outlive any executor."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of `materialise` that nothing will read again, as their successors are written, and let the driver find out
    which shuffles nothing refers to any more, so that executors delete their files too."""
    delete(SparkSession.active(), {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()})


def delete(spark: SparkSession, folders) -> None:
    """Delete these folders, where they are still there, and what shuffles nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let executors delete the files of shuffles that nothing refers to any more.

    Listeners refer to a query for a moment after its end, and what outlives a collection stays until the next: so there are two."""
    for wait in (0.2, 1):
        time.sleep(wait)
        delete(spark, [])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(column: str, modulus: int) -> Column:
    """crc32 of the id as text, by modulus; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty, without decoding."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def ascii_lower(data: bytes) -> bytes:
    return data.lower()  # bytes.lower() changes A-Z only


def word_hash(word: bytes, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(word, seed)


class WordHashes(dict):
    """64-bit hashes of words, remembered for a bounded number of words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    def of_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many words each text has, and the 64-bit hashes of all words, A-Z lower-cased, one after the other.

        No word becomes a Python object, but for long ones."""
        data = np.frombuffer(b"".join([b" ", b" ".join(texts).lower(), b" " * 8]), np.uint8)
        blank = (data == 0x20) | (data - np.uint8(9) < 5)
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        begins = np.cumsum(np.fromiter((1, *(len(x) + 1 for x in texts)), np.int64, len(texts) + 1))
        return np.diff(np.searchsorted(starts, begins)), _xxh64(data, starts, sizes)


def _rotated(values: np.ndarray, by: int) -> np.ndarray:
    return (values << np.uint64(by)) | (values >> np.uint64(64 - by))


def _xxh64(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What xxhash gives for these stretches of bytes, for all of a length at a time; at least 8 bytes follow the last one."""
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    at = lambda kind: np.ndarray(len(data) - 7, kind, data, strides=(1,))  # noqa: E731  the number that begins at each byte
    longs, ints, most = at("<u8"), at("<u4"), 31
    out = np.empty(len(starts), np.uint64)
    order = np.argsort(np.minimum(sizes, most + 1).astype(np.uint8), kind="stable")
    cuts = np.cumsum(np.bincount(np.minimum(sizes, most + 1), minlength=most + 2))
    with np.errstate(over="ignore"):
        for size in range(1, most + 1):
            some = order[cuts[size - 1] : cuts[size]]
            if not len(some):
                continue
            place, h = starts[some], np.full(len(some), five + np.uint64(size))
            for k in range(0, size - 7, 8):
                h = _rotated(h ^ (_rotated(longs[place + k] * two, 31) * one), 27) * one + four
            if size & 4:
                h = _rotated(h ^ (ints[place + (size & ~7)].astype(np.uint64) * one), 23) * two + three
            for k in range(size & ~3, size):
                h = _rotated(h ^ (data[place + k].astype(np.uint64) * five), 11) * one
            h = (h ^ (h >> np.uint64(33))) * two
            h = (h ^ (h >> np.uint64(29))) * three
            out[some] = h ^ (h >> np.uint64(32))
    for k in order[cuts[most] :].tolist():
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : starts[k] + sizes[k]].tobytes())
    return out


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        values = values ^ (values >> np.uint64(30))
        values = values * np.uint64(0xBF58476D1CE4E5B9)
        values = values ^ (values >> np.uint64(27))
        values = values * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words, in order; with fewer words, one hash of the whole run, none without words."""
    if not len(words):
        return words
    short = len(words) < width
    width = min(width, len(words))
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        out = np.full(n, len(words) if short else 0, np.uint64)
        for k in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
            out ^= out >> np.uint64(29)
    return mix(out)


def squeeze(values: np.ndarray, level: int = 1) -> bytes:
    """Compress an integer array by byte planes; sorted or small integers take little room."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T)
    return zstandard.compress(planes.tobytes(), level)


def unsqueeze(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def squeeze_sorted(values: np.ndarray) -> bytes:
    """Compress ascending integers as differences."""
    return squeeze(np.diff(values, prepend=np.zeros(1, values.dtype)))


def unsqueeze_sorted(data: bytes, dtype=np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unsqueeze(data, dtype), dtype=dtype)


def split_blocks(batches, columns: list[str], most: int = BLOCK_BYTES):
    """Rows of Arrow batches as lists of columns, in blocks of about `most` text bytes; the last column is the text, as bytes."""
    rows: list[list] = [[] for _ in columns]
    size = 0
    for b in (whole_batch.slice(at, SLICE_ROWS) for whole_batch in batches for at in range(0, whole_batch.num_rows, SLICE_ROWS)):
        values = [b.column(c).to_pylist() for c in columns[:-1]] + [texts_of(b.column(columns[-1]))]
        for i, text in enumerate(values[-1]):
            for into, column in zip(rows, values, strict=True):
                into.append(column[i])
            size += len(text) + 64
            if size >= most:
                yield rows
                rows, size = [[] for _ in columns], 0
    if rows[0]:
        yield rows
    pa.default_memory_pool().release_unused()  # a worker that waits for other work holds little


def runs(batches, key: str):
    """Groups of rows with equal values of an integer column, from Arrow batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts = [0, *cuts.tolist()]
        for s, e in zip(starts, [*starts[1:], b.num_rows], strict=True):
            if held and keys[s] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = keys[s]
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)
    pa.default_memory_pool().release_unused()


def block_shingles(texts: list[bytes], hashes: WordHashes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending: how many each has, and all of them one after the other."""
    n, flat = hashes.of_texts(texts)
    ends = np.cumsum(n)
    owner = np.repeat(np.arange(len(texts)), n)
    found = shingle_hashes(flat, width) if len(flat) >= width else flat[:0]
    at = np.arange(len(found))
    whole_run = at + width <= ends[owner[: len(found)]]
    owner, found = owner[: len(found)][whole_run], found[whole_run]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        extra = np.concatenate([shingle_hashes(flat[ends[i] - n[i] : ends[i]], width) for i in short])
        owner, found = np.concatenate([owner, short]), np.concatenate([found, extra])
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    if len(found):
        new = np.r_[True, (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])]
        owner, found = owner[new], found[new]
    return np.bincount(owner, minlength=len(texts)), found
