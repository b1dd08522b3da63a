"""Packed transactions: raw rows are read once, and what concerns a whole transaction is not shuffled."""

from pyspark.sql import functions as F

from tidemark.functions import packing
from tidemark.operators import mining, prepare, temporal
from tidemark.plans import run
from tidemark.schema import Params
from tidemark.sources.synthetic import synthetic_retail


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_headers_and_facts_are_read_without_a_shuffle(spark):
    raw = synthetic_retail(spark, 300, months=2)
    data = run.prepared(raw, Params(max_transaction_len=3))
    assert not any("Exchange" in plan(df) or "Aggregate" in plan(df) for df in (data.tx, data.tx_before, data.tx_item, data.facts))
    assert "Exchange" not in plan(data.classified), "raw rows are classified once, and written"
    clean = prepare.clean(prepare.classify(raw))
    facts = prepare.item_level(clean, data.items)
    item, tx = prepare.limit_length(facts, prepare.headers(facts), 3)
    assert rows(data.tx_item) == rows(item) and rows(data.tx) == rows(tx) and rows(data.facts) == rows(facts) and data.tx.count() < data.tx_before.count()
    assert rows(prepare.nested(data.baskets)) == rows(prepare.nested(item))


def test_first_descriptions_without_sorting_all_rows(spark):
    given = [("A", "late", (2, 1)), ("A", None, (1, 1)), ("A", "third", (1, 3)), ("A", "second", (1, 2)), ("B", None, (1, 1)), ("C", "one", (3, 1)), ("C", "null first", (None, 9))]
    df = spark.createDataFrame(given, "stock_code string, description string, row_id struct<a: int, b: int>")
    got = {r.stock_code: (r.item_id, r.description) for r in prepare.item_dictionary(df).collect()}
    assert got == {"A": (1, "second"), "B": (2, None), "C": (3, "null first")}
    flat = df.withColumn("row_id", F.coalesce(F.col("row_id.a") * 10 + F.col("row_id.b"), F.lit(None).cast("int")))
    assert {r.stock_code: r.description for r in prepare.item_dictionary(flat).collect()} == {"A": "second", "B": None, "C": "one"}


def test_hiding_and_checks_do_not_group_transactions(spark):
    """Packed tables give what facts and headers gave, and neither patterns nor the audit shuffle transactions."""
    from tidemark.operators import mining, sanitize, temporal, verify
    from tidemark.sources import artifacts
    from tidemark.sources.huim_text import transaction_lines

    data = run.prepared(synthetic_retail(spark, 400, months=3), Params(max_transaction_len=None))
    old = (data.tx_item, data.tx)
    assert rows(mining.twu(data.baskets, data.baskets)) == rows(mining.twu(*old))
    assert rows(mining.mine(data.baskets, data.baskets, 0.1)) == rows(mining.mine(*old, 0.1))
    first = data.tx_item.filter("item_id = 1").select("window_key", "tid", "item_id", F.col("util").alias("delta"))
    changes = first.unionByName(data.tx_item.filter("item_id = 2 and util > 1").select("window_key", "tid", "item_id", F.lit(1).cast("long").alias("delta")))
    assert not first.isEmpty()
    after, same = sanitize.apply_modifications(data.baskets, data.baskets, changes)
    assert after is same
    facts, head = sanitize.apply_modifications(*old, changes)
    assert rows(after.select(F.explode("x").alias("e"), "window_key", "tid", "invoice_no").select("window_key", "tid", "invoice_no", "e.*")) == rows(facts)
    assert rows(after.drop("x")) == rows(head)
    for options in ({}, {"changed_only": False}, {"shared_only": True}):
        assert rows(verify.compare(data.baskets, data.baskets, after, after, data.items, **options)) == rows(verify.compare(*old, facts, head, data.items, **options))
    assert rows(verify.audit(after, after)) == rows(verify.audit(facts, head))
    assert "Exchange" not in plan(verify.audit(data.baskets, data.baskets)) and "Exchange hashpartitioning" not in plan(artifacts.database(data.baskets, data.baskets))
    patterns = spark.createDataFrame([("1 2", [1, 2]), ("3", [3])], "pattern_key string, items array<int>")
    assert rows(temporal.pattern_support(patterns, after)) == rows(temporal.pattern_support(patterns, facts))
    assert rows(artifacts.database(after, after).withColumn("item_utils", F.to_json("item_utils"))) == rows(artifacts.database(facts, head).withColumn("item_utils", F.to_json("item_utils")))
    assert rows(transaction_lines(after, after)) == rows(transaction_lines(facts, head)) and rows(transaction_lines(after)) == rows(transaction_lines(facts))


def test_pairs_that_fall_short_are_not_written(spark, monkeypatch):
    facts = spark.createDataFrame([("m", f"t{k}", i, u) for k in range(10) for i, u in ((1, 10), (2 + k, 1))], "window_key string, tid string, item_id int, util long")
    tx = facts.groupBy("window_key", "tid").agg(F.sum("util").alias("transaction_utility"))
    written, write = [], mining.checkpoint

    def counted(df):
        out = write(df)
        if "rest" in df.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(mining, "checkpoint", counted)
    found = mining.mine(facts, tx, 0.5)
    assert [(r.pattern_key, r.utility) for r in found.collect()] == [("1", 100)] and sum(written) == 0


def test_patterns_meet_transactions_that_hold_their_first_two_items(spark):
    baskets = [{1: 5}, {1: 2, 2: 3}, {1: 1, 2: 2, 3: 4}, {2: 7, 3: 8, 5: 9}, {1: 6, 9: 1}, {}]
    patterns = [[1], [3], [1, 2], [1, 3], [2, 3, 5], [9, 1], [1, 4], [7, 8]]
    entry = "window_key string, tid string, x array<struct<item_id:int,util:bigint>>"
    packed = spark.createDataFrame([("m", str(k), list(b.items())) for k, b in enumerate(baskets)], entry)
    wanted = spark.createDataFrame([(" ".join(map(str, p)), p, w) for p in patterns for w in ("m", "other")], "pattern_key string, items array<int>, window_key string")
    want = sorted((" ".join(map(str, p)), str(k), sum(b[i] for i in p)) for p in patterns for k, b in enumerate(baskets) if set(p) <= set(b))
    met = temporal.holding(packed, wanted, ("window_key",))
    assert sorted((r.pattern_key, r.tid, r.utility) for r in met.collect()) == want
    every = temporal.holding(packed.drop("window_key"), wanted.filter("window_key = 'm'").drop("window_key"))
    assert sorted((r.pattern_key, r.tid, r.utility) for r in every.collect()) == want
    assert "__second" in met._jdf.queryExecution().optimizedPlan().toString(), "not every pattern that begins alike"


def test_levels_read_written_transactions_that_say_what_later_items_add(spark, monkeypatch):
    """Before, each of the first levels filtered the transactions and added up their later items again."""
    written, cut = [], mining.checkpoint
    monkeypatch.setattr(mining, "checkpoint", lambda df: written.append(cut(df)) or written[-1])
    rows = spark.createDataFrame([("2024-01", "a", "a", 12, 4, [(1, 5), (2, 0), (3, 4), (4, 3)])], f"window_key string, tid string, invoice_no string, transaction_utility long, length int, x {packing.ENTRIES}")
    found = {tuple(r["items"]): r.utility for r in mining.mine(rows, rows, 0.5).collect()}
    assert found == {(1, 3): 9, (1, 4): 8, (3, 4): 7, (1, 3, 4): 12}
    listed = [df for df in written if "x" in df.columns]
    assert [[tuple(e) for e in r.x] for df in listed for r in df.collect()] == [[(1, 5, 7), (3, 4, 3), (4, 3, 0)]]
