"""Importance resampling against a plain count in Python."""

import hashlib
import math
import random
import re
import zlib

from pyspark.sql import functions as F

from tidemark.llm import queries, resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def grams(text):
    w = WORD.findall(lower(text))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def bucket(gram):
    return zlib.crc32(gram.encode()) % 10000


def brute(docs, target, percent=25, least=20):
    counts = []
    for texts in ([t for _, t in docs], target):
        c = [0] * 10000
        for t in texts:
            for g in grams(t)[1]:
                c[bucket(g)] += 1
        counts.append(c)
    s, t = counts
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log(float(t[k] + 1) * (big_s + 10000) / (float(s[k] + 1) * (big_t + 10000)))) for k in range(10000)]
    out = []
    for key, text in docs:
        n, found = grams(text)
        weight = sum(gain[bucket(g)] for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


def corpus(n=120):
    rng = random.Random(3)
    words = ["Zug", "zug", "été", "5", "x1", "漢字", "the", "of", "a\x00b", "it's", "line\nbreak", "NBSP here", *[f"w{i}" for i in range(60)]]
    docs = [(i, rng.choice([" ", ", ", "\t"]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 19, 20, 40, 90])))) for i in range(n)]
    return [*docs, (None, None), (None, " ".join(words)), (500, ""), (7, docs[7][1]), (7, docs[7][1]), (501, "word " * 60_000)], ["the of a zug", None, "été w3 w4 w5 " * 30]


def test_like_a_plain_count(spark):
    docs, target = corpus()
    frame = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, score string, rank int").repartition(5)
    got = resampling.resample(frame, spark.createDataFrame([(t,) for t in target], "text string").repartition(3))
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=str) == brute(docs, target)
    drawn = resampling.drawn(frame, got)
    assert drawn.columns == frame.columns and drawn.count() >= got.filter("rank is not null and doc_id is not null").count()


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two " * 20)], "doc_id long, text string")
    assert resampling.resample(docs.limit(0), docs).isEmpty()
    assert resampling.resample(docs, docs.limit(0)).first()["rank"] is None  # a quarter of one is none
    assert resampling.resample(docs, docs, percent=100).first()["rank"] == 1


def test_query_over_written_tables(spark, tmp_path):
    docs, target = corpus(40)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(t,) for t in target], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op11_resampling(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, target)
    assert got.agg(F.max("rank")).first()[0] == got.filter("rank is not null").count()
