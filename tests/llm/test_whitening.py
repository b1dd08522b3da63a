"""Whitening against a covariance and its eigenvectors in numpy."""

import math

import numpy as np
import pytest

from tidemark.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n int"


def vectors(n=300, dims=40, seed=5):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, dims)) * np.linspace(3, 0.3, dims) @ np.linalg.qr(rng.normal(size=(dims, dims)))[0] + 2).astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], "x", 0) for i, v in rows], SCHEMA).repartition(6)


def check(got, kept, most=32):
    """kept: (id, vector) of the rows that count."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in kept], object)
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s).astype(float) / n
    cov = centred.T @ centred / n
    e, right = np.linalg.eigh(cov)
    e, right = e[::-1], right[:, ::-1]
    most = min(most, x.shape[1])
    assert len(got) == n * most
    want = {}
    for (id, _), row, dev in zip(kept, centred, ((n * x - s) ** 2).sum(axis=1), strict=True):
        want.setdefault(id, []).append((dev, row @ right[:, :most] / np.sqrt(e[:most])))
    rows = {}
    for r in got:
        assert r.n == n and r.identity_error <= 1e-8
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-6)
        rows.setdefault((r.vec_id, r.component), []).append(r)
    sign = {}
    for (id, k), found in rows.items():
        mine = sorted((int(r.deviation), abs(r.whitened)) for r in found)
        theirs = sorted((int(d), abs(w[k - 1])) for d, w in want[id])
        assert [d for d, _ in mine] == [d for d, _ in theirs]
        assert np.allclose([w for _, w in mine], [w for _, w in theirs], atol=1e-6)
        if len(found) == 1 and abs(found[0].whitened) > 0.1:
            assert sign.setdefault(k, np.sign(found[0].whitened * want[id][0][1][k - 1])) == np.sign(found[0].whitened * want[id][0][1][k - 1])


def test_like_eigenvectors_of_the_covariance(spark):
    v = vectors()
    rows = [(i, row) for i, row in enumerate(v)]
    bad = [(900, None), (901, [None, *v[0][1:]]), (902, [float("nan"), *v[0][1:]]), (903, [float("inf"), *v[0][1:]]), (904, []), (905, v[0][:7])]
    kept = [*rows, (None, v[3]), (8, v[8]), (9, v[11])]
    check(whitening.whiten(frame(spark, kept + bad)).collect(), kept)


def test_few_dimensions_and_query(spark, tmp_path):
    rows = [(i, row) for i, row in enumerate(vectors(80, 5))]
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_whitening(spark, str(tmp_path))
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check(got.collect(), rows)


def test_equal_vectors_have_no_component(spark):
    got = whitening.whiten(frame(spark, [(1, [0.5, 1.5]), (2, [0.5, 1.5])])).collect()
    assert len(got) == 4 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.identity_error == 0 for r in got)
    line = whitening.whiten(frame(spark, [(1, [0.0, 1.0]), (2, [1.0, 2.0]), (3, [2.0, 3.0])])).collect()  # one direction only
    assert all((r.whitened is None) == (r.component == 2) for r in line) and len(line) == 6


def test_deviations_beyond_64_bits(spark):
    got = whitening.whiten(frame(spark, [(1, [1e7]), (2, [-1e7]), (3, [0.0])])).collect()
    assert {r.vec_id: int(r.deviation) for r in got} == {1: (3 * 64 * 10**7) ** 2, 2: (3 * 64 * 10**7) ** 2, 3: 0}


def test_no_vectors(spark):
    assert whitening.whiten(frame(spark, [])).isEmpty()
    assert whitening.whiten(frame(spark, [(1, None), (2, []), (3, [None])])).isEmpty()
