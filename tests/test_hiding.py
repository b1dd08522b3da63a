"""Mining and hiding against plain Python on small random databases, and cases made by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import ordered
from tidemark.operators import mining, prepare, sanitize, temporal, verify
from tidemark.schema import PRESETS, Params, Statistics, advise, validate_schema

FACT = "window_key string, tid string, invoice_no string, item_id int, util long"


def database(spark, seed, months=2, n=6, items=4):
    rng = random.Random(seed)
    rows = [(f"2011-0{m + 1}", f"2011-0{m + 1}_{t}", str(t), i, rng.randint(1, 9)) for m in range(months) for t in range(n) for i in range(1, items + 1) if rng.random() < 0.7]
    facts = spark.createDataFrame(rows, FACT)
    return rows, facts, prepare.headers(facts)


def nested(rows):
    db = {}
    for w, t, _, i, u in rows:
        db.setdefault(w, {}).setdefault(t, {})[i] = u
    return db


@pytest.mark.parametrize("seed", [1, 2])
def test_mine_is_the_power_set(spark, seed):
    rows, facts, tx = database(spark, seed)
    want = set()
    for w, txs in nested(rows).items():
        least = max(1, int(sum(sum(t.values()) for t in txs.values()) * 0.15))
        items = sorted({i for t in txs.values() for i in t})
        for k in range(1, len(items) + 1):
            for p in itertools.combinations(items, k):
                u = sum(sum(t[i] for i in p) for t in txs.values() if all(i in t for i in p))
                if u >= least:
                    want.add((w, " ".join(map(str, p)), u))
    for prune in (True, False):
        got = {(r.window_key, r.pattern_key, r.utility) for r in mining.mine(facts, tx, 0.15, prune).collect()}
        assert got == want


def step_loop(db, defs, scores, local, global_, beta=0.25, gamma=0.75):
    """The greedy procedure, one step at a time, everything worked out afresh."""
    total = {(w, t): sum(x.values()) for w, txs in db.items() for t, x in txs.items()}

    def utility(w, t, p):
        got = [db[w][t].get(i, 0) for i in p]
        return sum(got) if all(got) else 0

    def step(places, p, need):
        held = [(w, t) for w, t in places if utility(w, t, p) > 0]
        victim = lambda w, t: min(p, key=lambda i: (scores.get(i, 0), -db[w][t][i], i))
        best = min(held, key=lambda x: (-(utility(*x, p) + beta * total[x] + gamma - scores.get(victim(*x), 0)), x))
        i = victim(*best)
        delta = min(need, db[best[0]][best[1]][i])
        db[best[0]][best[1]][i] -= delta
        total[best] -= delta

    everywhere = [(w, t) for w in db for t in db[w]]
    limit_all = global_ if isinstance(global_, int) else max(1, int(sum(total.values()) * global_))
    for w in sorted(db):
        limit = max(1, int(sum(total[w, t] for t in db[w]) * local))
        for key, p, targets in sorted(defs):
            while w in targets and (u := sum(utility(w, t, p) for t in db[w])) >= limit:
                step([(w, t) for t in db[w]], p, u - limit + 1)
    while leaks := [(-u, key, p) for key, p, _ in defs if (u := sum(utility(*x, p) for x in everywhere)) >= limit_all]:
        u, _, p = min(leaks)
        step(everywhere, p, -u - limit_all + 1)
    return db


def scored(spark, rows):
    return spark.createDataFrame(rows, "item_id int, score double")


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_hiding_like_the_step_loop(spark, seed):
    rows, facts, tx = database(spark, seed)
    months = sorted({r[0] for r in rows})
    defs = [("1 2", [1, 2], months), ("2 3", [2, 3], months[:1]), ("3", [3], months)]
    scores = {1: 0.5, 2: 0.25, 3: 0.75}
    definitions = spark.createDataFrame([(k, p, w) for k, p, w in defs], "pattern_key string, items array<int>, local_target_windows array<string>")
    changes = sanitize.local_pass(definitions, facts, tx, scored(spark, list(scores.items())), 0.2)
    after, head = sanitize.apply_modifications(facts, tx, changes)
    want = step_loop(nested(rows), defs, scores, 0.2, 1.0)
    got = {(r.window_key, r.tid, r.item_id): r.util for r in after.collect()}
    assert got == {(w, t, i): u for w, txs in want.items() for t, x in txs.items() for i, u in x.items() if u > 0}
    assert {(r.window_key, r.tid): r.transaction_utility for r in head.collect()} == {(w, t): sum(x.values()) for w, txs in want.items() for t, x in txs.items()}


def utilities(facts):
    return {(r.window_key, r.tid, r.item_id): r.util for r in facts.collect()}


def flat(db):
    return {(w, t, i): u for w, txs in db.items() for t, x in txs.items() for i, u in x.items() if u > 0}


@pytest.mark.parametrize("seed", [7, 8])
def test_both_passes_like_the_step_loop(spark, seed):
    rows, facts, tx = database(spark, seed, n=20, items=5)
    months = sorted({r[0] for r in rows})
    defs = [("1 2", [1, 2], months), ("1 2 3", [1, 2, 3], months[1:]), ("2 3", [2, 3], months[:1]), ("3 4", [3, 4], months), ("5", [5], months)]
    scores = {1: 0.5, 2: 0.25, 3: 0.25, 5: 0.125}
    definitions = spark.createDataFrame(defs, "pattern_key string, items array<int>, local_target_windows array<string>")
    _, after, head = sanitize.sanitize(definitions, facts, tx, scored(spark, list(scores.items())), 0.2, 0.12)
    want = step_loop(nested(rows), defs, scores, 0.2, 0.12)
    assert utilities(after) == flat(want)
    assert {(r.window_key, r.tid): r.transaction_utility for r in head.collect()} == {(w, t): sum(x.values()) for w, txs in want.items() for t, x in txs.items()}


def test_global_pass_of_hundreds_of_cases_like_the_step_loop(spark):
    """Cases have items of their own, so that each is a component, or several; the threshold is that of all."""
    rng, rows, defs, scores, limit = random.Random(9), [], [], {}, 25
    for case in range(200):
        items = list(range(10 * case + 1, 10 * case + 6))
        for t in range(rng.randint(3, 12)):
            w = rng.choice(["2011-01", "2011-02"])
            rows += [(w, f"{w}_{case}_{t}", "i", i, rng.randint(1, 9)) for i in items if rng.random() < 0.75]
        for p in {tuple(sorted(rng.sample(items, rng.choice([1, 2, 2, 3])))) for _ in range(rng.randint(1, 4))}:
            defs.append((" ".join(map(str, p)), list(p), []))
        scores |= {i: rng.choice([0.0, 0.25, 0.5]) for i in items[:3]}
    facts = spark.createDataFrame(rows, FACT)
    tx = prepare.headers(facts)
    definitions = spark.createDataFrame(defs, "pattern_key string, items array<int>, local_target_windows array<string>")
    changes = sanitize.global_pass(definitions, facts, tx, scored(spark, list(scores.items())), limit)
    want = {}
    for case in range(200):
        own = [r for r in rows if r[3] // 10 == case]
        mine = [d for d in defs if d[1][0] // 10 == case]
        want |= flat(step_loop(nested(own), mine, scores, 1.0, limit))
    assert utilities(sanitize.apply_modifications(facts, tx, changes)[0]) == want


def test_global_pass_takes_only_the_top_of_the_order(spark):
    """Of many transactions a pattern that must lose little meets few."""
    rows = [("2011-01", f"2011-01_{t}", "i", i, 5 + (t * 7 + i) % 4) for t in range(400) for i in (1, 2)]
    facts = spark.createDataFrame(rows, FACT)
    tx = prepare.headers(facts)
    total = sum(r[4] for r in rows)
    orders = temporal.pattern_support(spark.createDataFrame([("1 2", [1, 2])], "pattern_key string, items array<int>"), facts)
    ran = ordered.running(orders, ["pattern_key"], [F.desc("utility"), "window_key", "tid"], {"before": "utility"})
    assert sanitize._tops(ran, {"1 2": 100}).count() < 10
    definitions = spark.createDataFrame([("1 2", [1, 2], [])], "pattern_key string, items array<int>, local_target_windows array<string>")
    changes = sanitize.global_pass(definitions, facts, tx, scored(spark, []), total - 99)
    assert utilities(sanitize.apply_modifications(facts, tx, changes)[0]) == flat(step_loop(nested(rows), [("1 2", [1, 2], [])], {}, 2.0, total - 99))


def test_global_pass_leaves_no_leak(spark):
    rows, facts, tx = database(spark, 6)
    definitions = spark.createDataFrame([("1 2", [1, 2]), ("2 3", [2, 3])], "pattern_key string, items array<int>")
    changes = sanitize.global_pass(definitions, facts, tx, scored(spark, [(1, 0.5)]), 20)
    after, head = sanitize.apply_modifications(facts, tx, changes)
    assert verify.pattern_totals(definitions, after).filter("utility >= 20").isEmpty()
    assert after.join(facts.withColumnRenamed("util", "was"), ["window_key", "tid", "item_id"]).filter("util > was").isEmpty()
    lost = changes.agg(F.sum("delta")).first()[0]
    assert tx.agg(F.sum("transaction_utility")).first()[0] - head.agg(F.sum("transaction_utility")).first()[0] == lost


def test_peak_of_utility_is_not_peak_of_ratio(spark):
    dense = spark.createDataFrame([("1", "2011-01", 50, 0.1), ("1", "2011-02", 30, 0.6), ("2", "2011-01", 5, 0.5), ("2", "2011-02", 5, 0.5)], "pattern_key string, window_key string, utility long, ratio double")
    got = {r.pattern_key: r for r in temporal.temporal_stats(dense).collect()}
    assert (got["1"].max_window, got["1"].max_ratio, got["1"].peak_windows) == ("2011-01", 0.1, ["2011-01"])
    assert (got["2"].max_window, got["2"].peak_windows) == ("2011-01", ["2011-01", "2011-02"])


def test_emptied_transaction_fails_the_audit(spark):
    tx = spark.createDataFrame([("2011-01", "a", "a", 0, 0)], "window_key string, tid string, invoice_no string, transaction_utility long, length int")
    assert verify.audit_counts(spark.createDataFrame([], FACT), tx).first().empty_transactions == 1


SALES = "InvoiceNo string, StockCode string, Description string, Quantity string, UnitPrice string, InvoiceDate string"


def test_waterfall_and_half_even_rounding(spark):
    rows = [
        (" 1.0", " b ", None, "1", "2.5", "05/01/2011 08:30"), ("1.0", "b", "B", "1", "1.5", "05/01/2011 08:30"), ("1", "a", None, "1", "0.5", "05/02/2011 08:30"), ("1", "a", "A", "2", "3", "05/02/2011 08:30"),
        ("C2", "a", "A", "1", "1", "05/01/2011 08:30"), ("3", "a", "A", "5d", "1", "05/01/2011"), ("3", "a", "A", "1", "1", "bad"), ("3", None, "A", "1", "1", "05/01/2011"),
    ]
    classified = prepare.classify(spark.createDataFrame(rows, SALES).coalesce(1))
    counts = {r.reason: r.n_rows for r in prepare.drop_report(classified).collect()}
    assert counts == {"missing_required": 1, "cancelled_invoice": 1, "nonpositive_quantity_or_price": 1, "invalid_invoice_date": 1, "nonpositive_utility": 1, "ok": 3}
    items = prepare.item_dictionary(prepare.clean(classified))
    assert [(r.item_id, r.stock_code, r.description) for r in items.orderBy("item_id").collect()] == [(1, "a", "A"), (2, "b", "B")]
    facts = prepare.item_level(prepare.clean(classified), items)
    assert {(r.tid, r.item_id, r.util) for r in facts.collect()} == {("2011-01_1", 2, 4), ("2011-02_1", 1, 6)}


def test_empty_input(spark):
    classified = prepare.classify(spark.createDataFrame([], SALES))
    rows = prepare.clean(classified)
    facts = prepare.item_level(rows, prepare.item_dictionary(rows))
    tx = prepare.headers(facts)
    assert facts.isEmpty() and prepare.max_len_impact(tx).isEmpty() and mining.mine(facts, tx, 0.1).isEmpty()


def test_parameters():
    with pytest.raises(ValueError):
        Params(max_transaction_len=0)
    with pytest.raises(ValueError):
        Params(window_granularity="W")
    assert PRESETS["fast"].max_patterns_per_window == 1500
    assert not validate_schema(["InvoiceNo "])["is_valid"]
    large = Statistics(num_transactions=9000, avg_transaction_len=40, max_transaction_len=50)
    assert advise(large, Params())["risk_level"] == "medium" and len(advise(large, Params(max_patterns_per_window=20_000))["warnings"]) == 3
    assert advise(Statistics(10, 5, 2.0, 4), Params())["risk_level"] == "low" and advise(Statistics(10, 5, 2.0), Params())["risk_level"] == "low"
    assert advise(Statistics(), Params(candidate_mining_ratio=0.001))["risk_level"] == "high" and advise(None, Params())["errors"]
