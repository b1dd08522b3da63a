"""Near-duplicate documents by SetSketch registers, verified on whole sets of shingles.

1.  A register holds the least of the exponentially distributed hashes of a set's shingles, on an exponential scale and cut off at
    both ends; the register of a union is the larger one of its parts', so that sketches merge. Two sets of similarity J have equal
    registers with probability J, but for rounding.
2.  Registers are taken in bands; sets that agree in a band form a group. A pair of J = 0.85 misses all 32 bands of 5 registers
    with probability 7e-9, a pair of lower J is met less often.
3.  Within a group, a pair whose bitmaps of hashed shingles rule the threshold out is left at that. Of the others, the numbers of
    registers that are equal, larger and smaller, and the known sizes of both sets, give the likelihood of each J; a pair goes on
    unless the most likely J is more than six standard errors below the threshold.
4.  What is left is verified on the sorted sets, and links between different classes merge them: rounds of stars and tiles, as in
    jaccard_join, so that no group gives all its pairs and yet no pair of a group is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard_join import BLOCK, BROADCAST_NODES, Signature, _bitmap_pairs, _bitmap_tile, _few, _nodes, bitmap, link_groups
from .shared import WordHashes, block_shingles, discard, materialise, mix, split_blocks, squeeze_sorted, whole

#: Registers of a band, bands, and registers of a sketch.
ROWS, BANDS = 5, 32
REGISTERS = ROWS * BANDS
#: The scale of registers: the base, the rate of the exponential hashes, and the largest value but one.
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
#: Bits of a bitmap for each shingle, at least.
BITS = 8
#: Standard errors below the threshold at which a pair is given up.
ERRORS = 6
_ADD, _TIMES = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)), mix(np.arange(REGISTERS + 1, 2 * REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)


def registers(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of registers for each of the sets that start at these places (none is empty)."""
    least = np.empty((len(starts), REGISTERS), np.uint64)
    if len(starts):
        with np.errstate(over="ignore"):
            for k in range(REGISTERS):
                least[:, k] = np.minimum.reduceat((hashes ^ _ADD[k]) * _TIMES[k], starts)
    exponential = -np.log1p(-np.minimum((least.astype(np.float64) + 0.5) * 2.0**-64, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def bands(sketches: np.ndarray) -> np.ndarray:
    """For each row of registers a hash of every band."""
    parts = sketches.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        keys = mix((keys << np.uint64(16)) ^ parts[:, :, k] ^ (keys >> np.uint64(48)))
    return keys


def _slope(j, larger, smaller, equal, u, v):
    """The derivative of the log-likelihood of similarity j: `larger`, `smaller`, `equal` registers, sizes in the ratio u to v, u + v = 1."""
    q, scale = (BASE - 1) / BASE, np.log(BASE)
    x, y = np.maximum(u - v * j, 1e-300), np.maximum(v - u * j, 1e-300)
    p, r = -np.log1p(-q * x) / scale, -np.log1p(-q * y) / scale  # that a register is larger, or smaller
    dp, dr = q / (1 - q * x) / scale * v, q / (1 - q * y) / scale * u
    return equal * (dp + dr) / np.maximum(1 - p - r, 1e-300) - np.where(larger > 0, larger * dp / p, 0) - np.where(smaller > 0, smaller * dr / r, 0)


def likeliest(larger: np.ndarray, smaller: np.ndarray, na: np.ndarray, nb: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The similarity of most likelihood, given sizes and how many of m registers are larger and smaller. The likelihood has one
    peak, found by halving."""
    larger, smaller, na, nb = np.broadcast_arrays(larger, smaller, np.asarray(na, float), np.asarray(nb, float))
    u, equal = na / (na + nb), m - larger - smaller
    low, high = np.zeros(u.shape), np.minimum(u, 1 - u) / np.maximum(u, 1 - u)
    for _ in range(24):
        middle = (low + high) / 2
        up = _slope(middle, larger, smaller, equal, u, 1 - u) > 0
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    return (low + high) / 2


def _judge(larger, smaller, na, nb, percent: int):
    """Which pairs may link, and their most likely similarity."""
    t = percent / 100
    floor = t - ERRORS * np.sqrt(t * (1 - t) / REGISTERS)
    na, nb = np.broadcast_arrays(na, nb)
    ok = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (REGISTERS - larger - smaller > 0)
    score = np.zeros(ok.shape)
    # The likelihood rises at the floor exactly if its peak is above; the peak is worked out for those alone.
    u = na[ok] / (na[ok] + nb[ok])
    rises = _slope(np.full(len(u), floor), larger[ok], smaller[ok], REGISTERS - larger[ok] - smaller[ok], u, 1 - u) >= 0
    ok[ok] = rises
    score[ok] = likeliest(larger[ok], smaller[ok], na[ok], nb[ok])
    return ok, score


def _rows(sketches: list[bytes]) -> np.ndarray:
    """The registers at the head of signatures; a bitmap may follow."""
    return np.frombuffer(b"".join(x[: 2 * REGISTERS] for x in sketches), np.uint16).reshape(-1, REGISTERS)


def _judged(x: np.ndarray, nx, y: np.ndarray, ny, percent: int):
    return _judge((x > y).sum(1), (x < y).sum(1), nx, ny, percent)


def _by_pairs(x, nx, y, ny, percent):
    ok, _ = _bitmap_pairs([v[2 * REGISTERS :] for v in x], nx, [v[2 * REGISTERS :] for v in y], ny, percent)
    at, score = np.flatnonzero(ok), np.zeros(len(ok))
    if len(at):
        a, b = (_rows([side[k] for k in at]) for side in (x, y))
        ok[at], score[at] = _judged(a, nx[at], b, ny[at], percent)
    return ok, score


def _by_tile(x, nx, y, ny, percent):
    ok, _ = _bitmap_tile([v[2 * REGISTERS :] for v in x], nx, [v[2 * REGISTERS :] for v in y], ny, percent)
    a, b, score = _rows(x), _rows(y), np.zeros(ok.shape)
    i, j = np.nonzero(ok)
    for s in range(0, len(i), 16_384):
        p, q = i[s : s + 16_384], j[s : s + 16_384]
        ok[p, q], score[p, q] = _judged(a[p], nx[p], b[q], ny[q], percent)
    return ok, score


SKETCHES = Signature(_by_pairs, _by_tile)


def _sketch(width: int):
    """Rows of id, name and size of the set, and, once for equal sets of a block, the sketch."""

    def run(batches):
        hashes = WordHashes()
        for ids, texts in split_blocks(batches, ["id", "text"], BLOCK):
            n, found = block_shingles(texts, hashes, width)
            nodes = _nodes(n, found)
            first = np.zeros(len(n), bool)
            first[np.unique(nodes, return_index=True)[1]] = True
            own = np.flatnonzero(first & (n > 0))
            carried = np.repeat(first & (n > 0), n)
            made = registers(found[carried], np.cumsum(n[own]) - n[own])
            sketches = [None] * len(n)
            for i, row in zip(own.tolist(), made, strict=True):
                sketches[i] = row.tobytes()
            columns = [pa.array(ids, pa.int64()), pa.array(nodes, mask=n == 0), pa.array(n), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "node", "n", "bits"])

    return run


def _memberships(batches):
    for b in (whole_batch.slice(at, 2048) for whole_batch in batches for at in range(0, whole_batch.num_rows, 2048)):
        keys = bands(_rows(b.column("bits").to_pylist()))
        columns = [pa.array(keys.ravel().view(np.int64)), *[pa.array(np.repeat(b.column(c).to_numpy(), BANDS)) for c in ("node", "n")]]
        yield pa.RecordBatch.from_arrays(columns, ["gid", "node", "n"])


def _whole_sets(width: int):
    def run(batches):
        hashes = WordHashes()
        for (texts,) in split_blocks(batches, ["text"], BLOCK):
            n, found = block_shingles(texts, hashes, width)
            nodes, ends = _nodes(n, found), np.cumsum(n)
            own = np.unique(nodes, return_index=True)[1]
            own = own[n[own] > 0]
            for s in range(0, len(own), 500):
                part = own[s : s + 500]
                parts = [found[ends[i] - n[i] : ends[i]] for i in part]
                columns = [pa.array(nodes[part]), pa.array([squeeze_sorted(p) for p in parts], pa.binary()), pa.array([bitmap(p, BITS) for p in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "hashes", "bitmap"])

    return run


def _groups(nodes: DataFrame) -> DataFrame:
    """gid, node, n, members of the bands that several nodes have; bands with the same nodes once."""
    member = nodes.mapInArrow(_memberships, "gid long, node long, n long")
    sizes = member.groupBy("gid").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("all"), F.min("node").alias("first"), F.max("node").alias("last")).filter("members > 1")
    kept = materialise(sizes.groupBy("members", "all", "first", "last").agg(F.min("gid").alias("gid")).select("gid", "members"), "sketch-bands")
    groups = materialise(member.join(_few(kept, kept.count()), "gid"), "sketch-groups")
    discard(kept)
    return groups


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, the smallest id of its class, and kept, whether it is the class's own.

    Two texts link when 100 * intersection >= percent * union of their sets of `width`-word shingles (words: runs without ASCII white
    space, A-Z lower-cased; a text with fewer words has one shingle, all of it). Null, empty and blank texts have no shingle and link
    with nothing; their component is their own id. Ids are integers; rows with a null id take part, and are kept only where no row of
    their class has an id, so that component_id is null. Repeated rows stay rows, and have one verdict. Other columns are not read,
    whatever their names. An empty table gives an empty result. Shingles are compared by 64-bit hashes.
    """
    rows = docs.select(F.col(id).cast("long").alias("id"), whole(text).alias("text"))
    sketched = materialise(rows.mapInArrow(_sketch(width), "id long, node long, n long, bits binary"), "sketches")
    nodes = materialise(sketched.filter("bits is not null").select("node", "n", "bits").dropDuplicates(["node"]), "sketch-nodes")
    groups = _groups(nodes)
    names = materialise(groups.select("node").distinct(), "sketch-names")
    few = names.count()
    sets = rows.select("text").mapInArrow(_whole_sets(width), "node long, hashes binary, bitmap binary").join(_few(names, few), "node", "left_semi")
    sets = materialise(sets.dropDuplicates(["node"]), "sketch-sets")
    signed = nodes.join(sets.select("node", "bitmap"), "node").select("node", "n", F.concat("bits", "bitmap").alias("bits"))
    signed = materialise(signed, "sketch-signed")
    discard(nodes)
    labels = link_groups(groups, signed, sets, names, percent, SKETCHES)
    member = sketched.select("id", "node", "n").join(labels if few > BROADCAST_NODES else F.broadcast(labels), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = materialise(member.filter("comp is not null").groupBy("comp").agg(F.min("id").alias("least")), "sketch-least")
    discard(groups, names, sets, signed)
    component = F.when(F.col("comp").isNull(), F.col("id")).otherwise(F.col("least"))
    found = member.join(least, "comp", "left").select("id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return found.select(F.col("id").alias(id), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
