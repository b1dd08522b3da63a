"""Sketch registers, their likelihood, and near-duplicate classes against brute force."""

import itertools
import random

import numpy as np
import pytest

from tidemark.llm import queries, setsketch


def sets(texts, width=3):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    return out


def classes(rows, percent=85):
    """rows: (id, text); what each row must give."""
    s, parent = sets([t for _, t in rows]), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (id, _) in enumerate(rows):
        if id is not None:
            least[find(i)] = min(least.get(find(i), id), id)
    own = lambda i: least.get(find(i)) if s[i] else rows[i][0]
    return sorted(((id, len(s[i]), own(i), id == own(i)) for i, (id, _) in enumerate(rows)), key=str)


def corpus(seed, n=150):
    """Texts of few and many words, with chains of changes whose neighbours are just above or below the threshold."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    out = [None, "", " \t\n", "one", "ONE", "one two", "one two three", "One Two Three"]
    while len(out) < n:
        size = rng.choice([4, 8, 15, 40, 60, 90, 200])
        base = [rng.choice(words) for _ in range(size)]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 2, 5])):
            base = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                base[rng.randrange(size)] = rng.choice(words)
            out.append(rng.choice([" ", "\n"]).join(base).upper())
    return list(enumerate(out))


def got(frame):
    return sorted((tuple(r) for r in setsketch.near_duplicates(frame).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_like_brute_force(spark, seed):
    rows = corpus(seed)
    rows += [(None, rows[20][1]), (None, "nobody else has these words"), (30, rows[30][1]), (30, rows[31][1]), (-5, rows[40][1]), (9000, "long " * 20_000 + rows[50][1])]
    frame = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, node string, component_id int").repartition(5)
    assert got(frame) == classes(rows)


def test_query_over_a_written_table_and_an_empty_one(spark, tmp_path):
    rows = corpus(3, 40)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_setsketch_dedup(spark, str(tmp_path))
    assert dict(found.dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}
    assert sorted((tuple(r) for r in found.collect()), key=str) == classes(rows)
    assert setsketch.near_duplicates(frame.limit(0)).isEmpty()


def test_many_variants_of_one_text_in_small_tiles(spark, monkeypatch):
    """Variants that differ from each other in more words than from the text they come from."""
    from tidemark.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "TILE", 8)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(60):
        x = list(base)
        for at in rng.sample(range(100), rng.choice([2, 3, 4, 6])):
            x[at] = f"v{i}_{at}"
        rows.append((i, " ".join(x)))
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == classes(rows)


def pair(rng, n, j):
    """Two sets of hashes of n members each, of similarity about j."""
    common = round(2 * n * j / (1 + j))
    values = rng.integers(0, 2**63, 2 * n - common, dtype=np.uint64)
    return values[:n], np.concatenate([values[:common], values[n:]]), common / (2 * n - common)


def test_registers_merge_and_meet():
    rng = np.random.default_rng(1)
    found, met = [], 0
    for _ in range(200):
        a, b, j = pair(rng, 200, 0.85)
        x, y = (setsketch.registers(v, np.array([0])) for v in (a, b))
        assert (setsketch.merged(x, y) == setsketch.registers(np.union1d(a, b), np.array([0]))).all()
        found.append(setsketch.likeliest((x > y).sum(1), (x < y).sum(1), [len(a)], [len(b)])[0])
        met += (setsketch.bands(x) == setsketch.bands(y)).any()
    assert abs(np.mean(found) - j) < 0.01 and np.std(found) < 0.04 and met == 200
    assert (abs(np.array(found) - j) < setsketch.ERRORS * 0.0283).all()


def test_likelihood_has_its_peak_where_a_grid_has_it():
    for larger, smaller, na, nb in [(10, 20, 100, 120), (0, 0, 50, 50), (0, 30, 50, 61), (40, 60, 90, 95), (5, 0, 200, 190)]:
        u = na / (na + nb)
        grid = np.linspace(1e-6, min(u, 1 - u) / max(u, 1 - u) - 1e-6, 20_001)
        q = (setsketch.BASE - 1) / setsketch.BASE
        p, r = (-np.log(1 - q * x) / np.log(setsketch.BASE) for x in (u - (1 - u) * grid, (1 - u) - u * grid))
        value = larger * np.log(p) + smaller * np.log(r) + (setsketch.REGISTERS - larger - smaller) * np.log(1 - p - r)
        got = setsketch.likeliest(np.array([larger]), np.array([smaller]), [na], [nb])[0]
        assert abs(got - grid[value.argmax()]) < 1e-3
