"""The language model against plain Python, and the pipeline's stages on a small table."""

import collections
import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import interpolation_lm as lm


def documents(spark, n=60):
    """Texts in which a word mostly follows from the one before it."""
    rng = random.Random(4)
    follows = {"The": "cat", "cat": "sat", "sat": "on", "on": "a", "a": "mat", "mat": "The"}
    texts: list[str | None] = []
    for _ in range(n):
        words = ["The"] * rng.randint(0, 1)
        for _ in range(rng.randint(0, 60)):
            words.append(follows.get(words[-1], "The") if words and rng.random() < 0.8 else rng.choice([*follows, f"x{rng.randrange(200)}"]))
        texts.append(" ".join(words))
    texts[0] = None
    return texts, spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")


def test_scores_like_plain_python(spark):
    texts, docs = documents(spark)
    tokens = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in enumerate(texts)}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    words, pairs = collections.Counter(), collections.Counter()
    for i in train:
        words.update(tokens[i])
        pairs.update(zip([b"\n", *tokens[i]], tokens[i], strict=False))
    total, types = sum(words.values()), len(words)
    rows = lm.score(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2, len(t), sum(words[w] > 0 for w in t), total)
        assert math.isclose(r.base_score, sum(math.log10((words[w] + 1) / (total + types + 1)) for w in t), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_weights_follow_the_better_estimate():
    cell = lambda b, pair, word: (b * lm.BINS + pair) * lm.BINS + word
    cells = np.array([cell(3, 2, 20), cell(5, 0, 4)])
    weights = lm.expectation_maximisation(cells, np.array([1000.0, 1000.0]), 1e-6)
    assert weights[3][0] > 0.9 and weights[5][1] > 0.9 and np.allclose(weights.sum(1), 1)


def test_model_of_empty_and_repeated_tables(spark):
    _, docs = documents(spark, 5)
    assert lm.score(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    assert lm.score(same).count() == 3


def test_pipeline_stages_take_effect(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(7)
    fresh = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    item, passage, twin = fresh(30), fresh(70), fresh(100)
    texts = {i: fresh(80) for i in range(100)}
    for i in range(0, 60, 2):
        texts[i] += " grumbo"
    texts |= {200: twin, 201: twin + " more", 202: fresh(40) + " " + passage, 203: passage + " " + fresh(40), 204: fresh(20) + " " + item, 205: None, 206: "what grumbo"}
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 2 == 0 and i < 60)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r.n_tokens for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i in texts if not (i < 60 and i % 2 == 0)} - {201, 204, 206}
    assert got[203] < got[202] and got[205] == 0


def test_pipeline_drops_rows_not_ids(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    fresh = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    item, passage, same, null, one, other = fresh(30), fresh(70), fresh(80), fresh(80), fresh(80), fresh(80)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = lambda rows: spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    key = lambda x: (x[0] or -1, x[1])
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=key)
    docs = frame([(3, same), (3, same), (None, same), (None, null), (None, null), (5, one), (5, other), (6, other), (4, other)])
    assert rows(pipeline.near_duplicates(spark, docs, str(tmp_path))) == sorted([(3, same), (None, null), (5, one), (4, other)], key=key)
    docs = frame([(7, one), (7, one + " " + item), (None, item), (None, null)])
    assert rows(pipeline.decontamination(spark, docs, str(tmp_path))) == sorted([(7, one), (None, null)], key=key)
    docs = frame([(8, "left " + passage), (8, "right " + passage), (None, passage + " end"), (1, "first")])
    got = rows(pipeline.repeated_passages(spark, docs, str(tmp_path)))
    assert [i for i, _ in got] == [None, 1, 8, 8] and got[0][1] == "end" and sorted(len(t.split()) for i, t in got if i == 8) == [1, 71]


def test_pipeline_orders_equal_ids_the_same_way_and_keeps_names(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    words = lambda k: " ".join(f"q{k}x{i}" for i in range(70))
    rows = [(1, words(1), "a", 70), (1, words(1) + " more", "b", 71), (1, words(2), "c", 72), (None, words(3), "d", 73), (2, None, "e", 74)]
    columns = "doc_id long, text string, spans string, n_words int"
    seen = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, columns).repartition(3)
        seen.append([r.asDict() for r in pipeline._keyed(docs).orderBy(pipeline.ROW).drop(pipeline.ROW).collect()])
        cut = pipeline.repeated_passages(spark, docs.withColumn("n_chars", F.length("text")), str(tmp_path))
        kept = {(r.spans, r.n_words) for r in cut.collect()}
        assert cut.columns == ["doc_id", "text", "spans", "n_words", "n_chars"] and len(kept) >= 4 and kept <= {(r[2], r[3]) for r in rows}
    assert seen[0] == seen[1]
    empty = spark.createDataFrame([], columns)
    assert pipeline.near_duplicates(spark, empty, str(tmp_path)).count() == pipeline.repeated_passages(spark, empty.withColumn("n_chars", F.lit(0)), str(tmp_path)).count() == 0


def test_pipeline_stages_delete_what_those_before_left(spark, tmp_path):
    """Before, the tables of all stages stayed until the end and added up."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(k, "one two three four five six", 27) for k in range(3)], "doc_id long, text string, n_chars int")
    found = pipeline.near_duplicates(spark, docs, str(tmp_path))
    left = pipeline._LEFT.get()
    assert len([p for p in left if Path(p).exists()]) >= 2
    pipeline.repeated_passages(spark, found, str(tmp_path)).write.parquet(str(tmp_path / "lazy"))  # its input still reads some of them
    assert found.count() == spark.read.parquet(str(tmp_path / "lazy")).count() == 1
    found.write.parquet(str(tmp_path / "written"))
    pipeline.repeated_passages(spark, spark.read.parquet(str(tmp_path / "written")), str(tmp_path))
    assert not any(Path(p).exists() for p in left)
