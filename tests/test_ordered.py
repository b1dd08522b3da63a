"""Global ranks and running sums against plain Python, with keys of very different sizes."""

import random

from pyspark.sql import functions as F

from tidemark.functions.ordered import ranked, running


def test_ranks_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), i) for i in range(500)] + [(None, 500), (7, 501)]
    got = ranked(spark.createDataFrame(rows, "score int, id int").repartition(7), [F.desc("score"), "id"]).collect()
    want = sorted(rows, key=lambda r: (-r[0] if r[0] is not None else 1, r[1]))
    assert [(r.score, r.id) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got) == list(range(1, 503))


def test_ranks_of_rows_that_are_all_the_same(spark):
    assert sorted(r["rank"] for r in ranked(spark.range(100).select(F.lit(1).alias("x")), ["x"]).collect()) == list(range(1, 101))


def test_running_sums_with_one_large_key(spark):
    rng = random.Random(2)
    rows = [("a" if rng.random() < 0.6 else rng.choice("bcdefgh"), i, rng.randrange(100)) for i in range(600)]
    got = running(spark.createDataFrame(rows, "key string, id int, v long").repartition(5), ["key"], [F.desc("id")], {"before": "v", "ids": "id"}).collect()
    for r in got:
        assert r.before == sum(v for k, i, v in rows if k == r.key and i > r.id)
        assert r.ids == sum(i for k, i, v in rows if k == r.key and i > r.id)
    assert len(got) == len(rows)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "key string, v long")
    assert ranked(empty, ["v"]).isEmpty() and running(empty, ["key"], ["v"], {"before": "v"}).isEmpty()
