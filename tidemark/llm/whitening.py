"""Whitening of embeddings by TSQR: a tall-skinny QR over partitions, of which only triangular factors are merged.

1.  Vectors become whole numbers x, so that their sums are exact, in whatever order partitions are added.
2.  Each partition takes the QR of its centred rows, block after block; the factors R, dimensions squared at most, merge in a tree.
    The covariance is never formed, so that no precision is lost by squaring.
3.  The singular values of the last R give the eigenvalues, its right singular vectors the components; a further pass projects.

What leaves a partition has the size of one R or of one vector, however many rows there are.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of vectors of a block.
BLOCK = 1 << 20
SCALE, OFFSET = 64, 1_000_000
EXACT = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Fit:
    """n and sums: rows and their exact sums. components: a row each, by falling eigenvalue. total: the trace of the covariance.
    rank: how many eigenvalues are more than rounding. error: the largest entry of whitened's covariance minus the identity."""

    n: int
    sums: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray
    total: float
    rank: int
    error: float


def _whole(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector of `dims` finite entries, and these vectors as whole numbers."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    kept = np.flatnonzero(lengths == dims)
    values = column.take(pa.array(kept)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # nulls are NaN
    finite = np.isfinite(values).all(axis=1)
    return kept[finite], np.floor(SCALE * values[finite]).astype(np.int64) + OFFSET


def _blocks(batches, dims: int):
    """Arrow batches in parts of bounded size, with the rows that count and their vectors."""
    rows = max(1, BLOCK // max(dims, 1))
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            kept, x = _whole(part.column("vector"), dims)
            if len(kept):
                yield part, kept, x


def _packed(value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([value.tobytes()], pa.binary())], ["part"])


def _merged(vectors: DataFrame, run, dtype, shape, merge) -> np.ndarray | None:
    """What the partitions give, one array each or none, merged in a tree."""
    parts = vectors.mapInArrow(run, "part binary").rdd.map(lambda r: np.frombuffer(r.part, dtype).reshape(shape))
    # A partition may hold no row: the merge sees what is there.
    lists = parts.mapPartitions(lambda arrays: [list(arrays)])
    found = lists.treeReduce(lambda a, b: [merge(x, y) for x, y in zip(a, b, strict=True)] if a and b else a or b) if lists.getNumPartitions() else []
    return found[0] if found else None


def _sums(dims: int):
    def run(batches):
        total = np.zeros(dims + 1, np.int64)
        for _, kept, x in _blocks(batches, dims):
            total[0] += len(kept)
            total[1:] += x.sum(axis=0)
        if total[0]:
            yield _packed(total)

    return run


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / float(n)  # the difference is exact


def _factors(dims: int, n: int, sums: np.ndarray):
    def run(batches):
        r = np.zeros((0, dims))
        for _, _, x in _blocks(batches, dims):
            r = _triangle(r, _centred(x, n, sums))
        if len(r):
            yield _packed(r)

    return run


def _triangle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack([a, b]), mode="r")


def _project(x: np.ndarray, n: int, sums: np.ndarray, components: np.ndarray, eigenvalues: np.ndarray) -> np.ndarray:
    return _centred(x, n, sums) @ components.T / np.sqrt(eigenvalues)


def _moments(dims: int, n: int, sums: np.ndarray, components: np.ndarray, eigenvalues: np.ndarray):
    """Rows: count, means, and centred products of the whitened rows of a partition."""

    def run(batches):
        held = None
        for _, _, x in _blocks(batches, dims):
            w = _project(x, n, sums, components, eigenvalues)
            mean = w.mean(axis=0)
            one = np.vstack([np.full(len(mean), float(len(w))), mean, (w - mean).T @ (w - mean)])
            held = one if held is None else _together(held, one)
        if held is not None:
            yield _packed(held)

    return run


def _together(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of both lists of rows: the products are centred before they are multiplied."""
    na, nb = a[0, 0], b[0, 0]
    gap = b[1] - a[1]
    return np.vstack([a[0] + b[0], a[1] + gap * nb / (na + nb), a[2:] + b[2:] + np.outer(gap, gap) * na * nb / (na + nb)])


def dimensions(vectors: DataFrame, vector: str = "embedding") -> int:
    """The most frequent length of a vector, the larger of equally frequent ones; 0 if there is none."""
    lengths = vectors.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count()
    first = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    return first.d if first else 0


def fit(vectors: DataFrame, vector: str = "embedding", most: int = 32) -> Fit | None:
    """Components of all vectors, `most` at most; None without a vector that counts (see whiten)."""
    rows, dims = vectors.select(F.col(vector).alias("vector")), dimensions(vectors, vector)
    summed = _merged(rows, _sums(dims), np.int64, (-1,), add) if dims else None
    if summed is None:
        return None
    n, sums = int(summed[0]), summed[1:]
    r = _merged(rows, _factors(dims, n, sums), np.float64, (-1, dims), _triangle)
    _, sigma, right = np.linalg.svd(r, full_matrices=False)
    eigenvalues = np.zeros(dims)
    eigenvalues[: len(sigma)] = sigma**2 / n
    components = np.vstack([right, np.zeros((dims - len(right), dims))])[:most]
    rank = int((sigma > sigma[0] * max(n, dims) * np.finfo(float).eps).sum()) if len(sigma) and sigma[0] > 0 else 0
    total, eigenvalues, rank = float(eigenvalues.sum()), eigenvalues[:most], min(rank, most)
    error = 0.0
    if rank:
        kept = components[:rank], eigenvalues[:rank]
        moments = _merged(rows, _moments(dims, n, sums, *kept), np.float64, (rank + 2, rank), _together)
        error = float(np.abs(moments[2:] / n - np.eye(rank)).max())
    return Fit(n, sums, eigenvalues, components, total, rank, error)


def _whiten(f: Fit):
    dims, most = len(f.sums), len(f.components)
    explained = f.eigenvalues / f.total if f.total > 0 else np.zeros(most)

    def run(batches):
        for part, kept, x in _blocks(batches, dims):
            gap = f.n * x - f.sums
            if (gap.astype(np.float64) ** 2).sum(axis=1).max() < 2.0**62:
                deviation = pa.array((gap * gap).sum(axis=1)).cast(EXACT)
            else:
                deviation = pa.array(map(Decimal, (gap.astype(object) ** 2).sum(axis=1)), EXACT)
            w = np.full((len(kept), most), np.nan)
            w[:, : f.rank] = _project(x, f.n, f.sums, f.components[: f.rank], f.eigenvalues[: f.rank])
            rows = len(kept) * most
            columns = [
                part.column("id").take(pa.array(np.repeat(kept, most))),
                pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), len(kept))),
                pa.array(np.full(rows, f.n)),
                deviation.take(pa.array(np.repeat(np.arange(len(kept)), most))),
                pa.array(w.ravel(), from_pandas=True),
                pa.array(np.tile(explained, len(kept))),
                pa.array(np.full(rows, f.error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", most: int = 32) -> DataFrame:
    """One row for each row of vectors that counts and each component up to `most`: id, component, n, deviation, whitened, explained,
    identity_error.

    x = floor(64 c) + 1000000 of each entry c, as double. n counts all vectors; deviation is the exact sum over dimensions of
    (n x - S)^2, S the sums of x, a decimal, as it outgrows 64 bits where n does some ten million; whitened the centred x on the
    component, over the root of its eigenvalue e; explained e over the trace of the covariance, whose divisor is n; identity_error
    the largest entry, over all vectors, of the covariance of whitened minus the identity.

    Vectors that are null, empty or hold a null or an entry that is not finite are left out, and so are those of another length than
    the most frequent one (of equally frequent ones the larger). Null ids and repeated rows take part. Components whose eigenvalue is
    no more than rounding have whitened null and do not count for identity_error; equal vectors, or a single one, have such only.
    Other columns are not read, whatever their names. An empty table, or one without a vector that counts, gives an empty result.
    """
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[id]
    schema = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    f = fit(vectors, vector, most)
    if f is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id)
    return vectors.select(F.col(id).alias("id"), F.col(vector).alias("vector")).mapInArrow(_whiten(f), schema).withColumnRenamed("id", id)
