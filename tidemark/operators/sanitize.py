"""Hiding sensitive patterns by lowering item utilities.

Local pass: within each month, each target pattern in order of its key, transactions by descending score lose utility of their
victim item until the pattern is below the month's threshold. A step leaves all other scores of its pattern as they are, so that a
running sum over the order of scores says what each transaction must give. Months are independent: a round does the next target
of all of them at once, and no month is a group (functions/ordered.py). Targets that are below the threshold already cost no round.

Global pass: while a pattern reaches the threshold over all months, the largest one loses utility in the best transaction of all.
Every step depends on those before it in transactions that both their patterns hold. Scores and utilities only fall, so a pattern
takes its transactions from the top of its order of scores, as far down as it needs to lose; patterns that share none of these
transactions do not touch each other. So each component of patterns is a group, with these top transactions only.

Ties between transactions go to the earliest month, then the smallest tid.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint
from ..functions.packing import headers, is_packed, packed, unpacked
from ..functions.ordered import running
from ..functions.scalars import hiding_threshold
from .temporal import holding, items_of, pattern_support

MODIFICATION = "window_key string, tid string, item_id int, before_utility long, after_utility long, delta long, phase string, pattern_key string, step long"


def sensitive_definitions(selected: DataFrame) -> DataFrame:
    """Each selected pattern with its target months and its peak months."""
    out = selected.groupBy("pattern_key").agg(F.array_sort(F.collect_set("selected_window")).alias("local_target_windows"), F.flatten(F.collect_set("peak_windows")).alias("peaks"), F.collect_set("max_window").alias("tops"))
    return out.select("pattern_key", items_of().alias("items"), "local_target_windows", F.array_sort(F.array_union("peaks", "tops")).alias("peak_windows"))


def local_thresholds(tx: DataFrame, ratio: float) -> DataFrame:
    return tx.groupBy("window_key").agg(hiding_threshold(F.sum("transaction_utility"), ratio).alias("threshold"))


def hide_first_target(definitions: DataFrame, tx_item: DataFrame, tx: DataFrame, scores: DataFrame, ratio: float, beta: float = 0.25, gamma: float = 0.75) -> DataFrame:
    """The local pass for the first target of each month only."""
    targets = definitions.select("pattern_key", F.explode("local_target_windows").alias("window_key"))
    first = targets.groupBy("window_key").agg(F.min("pattern_key").alias("pattern_key"))
    own = first.groupBy("pattern_key").agg(F.array_sort(F.collect_list("window_key")).alias("local_target_windows"))
    return local_pass(own.withColumn("items", items_of()), tx_item, tx, scores, ratio, beta, gamma).drop("phase", "step")


def _packed(definitions: DataFrame, tx_item: DataFrame, tx: DataFrame, scores: DataFrame) -> DataFrame:
    """window_key, tid, tu, and x: the items of positive utility that some pattern holds, with their scores; one row for each
    transaction with such an item."""
    items = definitions.select(F.explode("items").alias("item_id")).distinct().join(scores.select("item_id", "score"), "item_id", "left").fillna(0.0, ["score"])
    known = items.agg(F.map_from_entries(F.collect_list(F.struct("item_id", "score"))).alias("__score"))  # one row: items of selected patterns
    rows = packed(tx_item, tx).crossJoin(F.broadcast(known))
    x = F.filter("x", lambda e: (e["util"] > 0) & F.map_contains_key("__score", e["item_id"]))
    x = F.transform(x, lambda e: F.struct(e["item_id"].alias("item_id"), e["util"].alias("util"), F.element_at("__score", e["item_id"]).alias("score")))
    return rows.select("window_key", "tid", F.col("transaction_utility").alias("tu"), x.alias("x")).filter(F.size("x") > 0)


def _scored(held: DataFrame, beta: float, gamma: float) -> DataFrame:
    """Rows of `holding` with v, the victim item (its score, its utility negated, its id), and rank_score."""
    victim = F.array_min(F.transform("held", lambda e: F.struct(e["score"].alias("score"), (-e["util"]).alias("low"), e["item_id"].alias("item_id"))))
    return held.withColumn("v", victim).withColumn("rank_score", F.col("utility") + beta * F.col("tu") + gamma - F.col("v.score"))


def _alive(packed: DataFrame) -> DataFrame:
    return packed.withColumn("x", F.filter("x", lambda e: e["util"] > 0))


class _Component:
    """The global pass over one component: transactions with utilities of items, patterns with their totals."""

    def __init__(self, pdf: pd.DataFrame, patterns: dict[str, tuple[list[int], int]], scores: dict[int, float], beta: float, gamma: float):
        self.total, self.items = {}, {}
        for w, t, u, ids, utils in zip(pdf.window_key, pdf.tid, pdf.tu, pdf["items"], pdf.utils, strict=True):
            self.total[w, t] = int(u)
            self.items[w, t] = dict(zip(map(int, ids), map(int, utils), strict=True))
        self.members = {k: p for k, (p, _) in patterns.items()}
        self.left = {k: u for k, (_, u) in patterns.items()}
        self.scores, self.beta, self.gamma = scores, beta, gamma
        self.of_item: dict[int, list[str]] = {}
        for k, p in self.members.items():
            for i in p:
                self.of_item.setdefault(i, []).append(k)

    def utility(self, tx: tuple, key: str) -> int:
        got = [self.items[tx].get(i, 0) for i in self.members[key]]
        return sum(got) if min(got) > 0 else 0

    def victim(self, tx: tuple, key: str) -> int:
        return min(self.members[key], key=lambda i: (self.scores.get(i, 0.0), -self.items[tx][i], i))

    def order(self, tx: tuple, key: str) -> tuple:
        return (-(self.utility(tx, key) + self.beta * self.total[tx] + self.gamma - self.scores.get(self.victim(tx, key), 0.0)), tx)

    def steps(self, threshold: int):
        """Modifications in order. Both heaps hold old places of what has fallen since; such an entry goes back with its new place."""
        queues = {k: [self.order(tx, k) for tx in self.items if self.utility(tx, k)] for k in self.members}
        for q in queues.values():
            heapify(q)
        leaks = [(-u, k) for k, u in self.left.items() if u >= threshold]
        heapify(leaks)
        while leaks:
            u, key = heappop(leaks)
            if self.left[key] < threshold:
                continue
            if -u != self.left[key]:
                heappush(leaks, (-self.left[key], key))
                continue
            queue = queues[key]
            while queue:
                place, tx = heappop(queue)
                if not self.utility(tx, key):
                    continue
                if (now := self.order(tx, key))[0] > place:
                    heappush(queue, now)
                    continue
                yield self._step(tx, key, threshold)
                if self.utility(tx, key):
                    heappush(queue, self.order(tx, key))
                heappush(leaks, (-self.left[key], key))
                break

    def _step(self, tx: tuple, key: str, threshold: int) -> tuple:
        item = self.victim(tx, key)
        before = self.items[tx][item]
        delta = min(before, self.left[key] - threshold + 1)
        losses = [(k, self.utility(tx, k)) for k in self.of_item[item]]
        self.items[tx][item] = before - delta
        self.total[tx] -= delta
        for k, was in losses:
            if was:
                self.left[k] -= delta if delta < before else was
        return (*tx, item, before, before - delta, delta, "global", key)


def _global(components: list[dict[str, tuple[list[int], int]]], threshold: int, scores: dict[int, float], beta: float, gamma: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts: dict[str, int] = {}
        out = []
        for step in _Component(pdf, components[int(pdf.component.iloc[0])], scores, beta, gamma).steps(threshold):
            out.append((*step, counts.get(step[-1], 0)))
            counts[step[-1]] = out[-1][-1] + 1
        return pd.DataFrame(out, columns=[c.split()[0] for c in MODIFICATION.split(", ")])

    return run


def modified(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """A packed table after the changes; items at 0 go, transactions stay."""
    by_item = changes.groupBy("window_key", "tid", "item_id").agg(F.sum("delta").alias("d"))
    by_tx = by_item.groupBy("window_key", "tid").agg(F.map_from_entries(F.collect_list(F.struct("item_id", "d"))).alias("__lost"), F.sum("d").alias("__d"))
    lower = F.transform("x", lambda e: e.withField("util", e["util"] - F.coalesce(F.try_element_at("__lost", e["item_id"]), F.lit(0))))
    x = F.filter(F.when(F.col("__lost").isNull(), F.col("x")).otherwise(lower), lambda e: e["util"] > 0)
    out = rows.join(by_tx, ["window_key", "tid"], "left").withColumn("x", x)
    return out.withColumn("transaction_utility", F.col("transaction_utility") - F.coalesce("__d", F.lit(0))).withColumn("length", F.size("x")).select(*rows.columns)


def apply_modifications(tx_item: DataFrame, tx: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The facts and headers after the changes; items at 0 go, headers stay. Of a packed table, both are one packed table."""
    if is_packed(tx_item):
        return (modified(tx_item, changes),) * 2
    by_item = changes.groupBy("window_key", "tid", "item_id").agg(F.sum("delta").alias("d"))
    by_tx = changes.groupBy("window_key", "tid").agg(F.sum("delta").alias("d"))
    facts = tx_item.join(by_item, ["window_key", "tid", "item_id"], "left").withColumn("util", F.col("util") - F.coalesce("d", F.lit(0))).filter("util > 0").select(*tx_item.columns)
    lengths = facts.groupBy("window_key", "tid").agg(F.count("*").cast("int").alias("n"))
    head = tx.join(by_tx, ["window_key", "tid"], "left").join(lengths, ["window_key", "tid"], "left")
    head = head.withColumn("transaction_utility", F.col("transaction_utility") - F.coalesce("d", F.lit(0))).withColumn("length", F.coalesce("n", F.lit(0)))
    return facts, head.select(*tx.columns)


def _targeted(state: DataFrame, waiting: DataFrame) -> DataFrame:
    """Rows of _packed that hold a target of their month, with the items of such targets only."""
    wanted = waiting.groupBy("window_key").agg(F.collect_list("items").alias("__targets"))  # a row for each month
    met = state.join(F.broadcast(wanted), "window_key").filter(F.exists("__targets", lambda p: F.size(F.array_except(p, F.col("x.item_id"))) == 0))
    met = met.withColumn("__of", F.flatten("__targets"))
    return met.select("window_key", "tid", "tu", F.filter("x", lambda e: F.array_contains("__of", e["item_id"])).alias("x"))


def local_pass(definitions: DataFrame, tx_item: DataFrame, tx: DataFrame, scores: DataFrame, ratio: float, beta: float = 0.25, gamma: float = 0.75) -> DataFrame:
    """Modifications that hide every pattern in its target months; step counts those of a month and pattern in order, from 0."""
    waiting = definitions.select("pattern_key", "items", F.explode("local_target_windows").alias("window_key")).join(local_thresholds(tx, ratio), "window_key")
    waiting = checkpoint(waiting)
    state = checkpoint(_targeted(_packed(definitions, tx_item, tx, scores), waiting))
    spark, open_ = state.sparkSession, waiting
    done = spark.createDataFrame([], MODIFICATION)
    while True:
        # Of each month the first target that is not hidden. Those before it never need a step, as utilities only fall.
        sums = holding(_alive(state), open_, ("window_key",)).groupBy("window_key", "pattern_key", "items", "threshold").agg(F.sum("utility").alias("total"))
        first = sums.filter("total >= threshold").groupBy("window_key").agg(F.min_by(F.struct("pattern_key", "items", "threshold", "total"), "pattern_key").alias("f"))
        turns = first.select("window_key", "f.*").collect()  # a row for each month
        if not turns:
            return done
        turn = F.broadcast(spark.createDataFrame(turns, "window_key string, pattern_key string, items array<int>, threshold long, total long"))
        rows = _scored(holding(_alive(state), turn, ("window_key",)), beta, gamma).withColumn("one", F.lit(1).cast("long"))
        rows = rows.select("window_key", "tid", "pattern_key", "utility", "threshold", "total", "rank_score", "v", "one")
        ran = running(rows, ["window_key"], [F.desc("rank_score"), F.asc("tid")], {"before": "utility", "step": "one"})
        rest = F.col("total") - F.col("before")
        cut = ran.filter(rest >= F.col("threshold")).withColumn("delta", F.least(-F.col("v.low"), rest - F.col("threshold") + 1))
        cut = checkpoint(cut.select("window_key", "tid", F.col("v.item_id").alias("item_id"), (-F.col("v.low")).alias("before_utility"), (-F.col("v.low") - F.col("delta")).alias("after_utility"), "delta", F.lit("local").alias("phase"), "pattern_key", "step"))
        done = done.unionByName(cut)
        lost = cut.select("window_key", "tid", F.col("item_id").alias("__item"), "delta")
        left = F.transform("x", lambda e: e.withField("util", e["util"] - F.when(e["item_id"] == F.col("__item"), F.col("delta")).otherwise(F.lit(0))))
        after = waiting.join(turn.select("window_key", F.col("pattern_key").alias("__turn")), "window_key").filter("pattern_key > __turn").drop("__turn")
        open_ = checkpoint(after)  # written, so that its size is known
        # Months without further targets are done with.
        state = state.join(F.broadcast(open_.select("window_key").distinct()), "window_key", "left_semi")
        state = checkpoint(state.join(lost, ["window_key", "tid"], "left").select("window_key", "tid", (F.col("tu") - F.coalesce("delta", F.lit(0))).alias("tu"), left.alias("x")))


def _tops(orders: DataFrame, need: dict[str, int]) -> DataFrame:
    """Rows of `orders` (pattern_key, window_key, tid, utility, before: what the pattern's better transactions add up to) in which steps can
    take place.

    Each pattern has as many transactions from its top as to lose what it needs in those that are not among the tops of other
    patterns; or all of its transactions. A pattern's own transactions keep their scores until it takes them, so it takes none
    below them."""
    spark, whole = orders.sparkSession, orders.groupBy("pattern_key").agg(F.sum("utility").alias("u"))
    totals = {r.pattern_key: r.u for r in whole.collect()}  # one row for each leaking pattern
    depth = dict(need)
    while True:
        limits = spark.createDataFrame(list(depth.items()), "pattern_key string, depth long")
        tops = orders.join(F.broadcast(limits), "pattern_key").filter("before < depth")
        alone = tops.groupBy("window_key", "tid").agg(F.min("pattern_key").alias("pattern_key"), F.count("*").alias("n"), F.min("utility").alias("u")).filter("n = 1")
        own = {r.pattern_key: r.u for r in alone.groupBy("pattern_key").agg(F.sum("u").alias("u")).collect()}
        short = [k for k in depth if own.get(k, 0) < need[k] and depth[k] < totals[k]]
        if not short:
            return tops.select("window_key", "tid").distinct()
        for k in short:
            depth[k] = min(totals[k], 2 * depth[k] + need[k] - own.get(k, 0))


def _joined(pairs: list[tuple[str, str]], keys: list[str]) -> list[list[str]]:
    """Components of keys under pairs."""
    parent = {k: k for k in keys}

    def root(k: str) -> str:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for a, b in pairs:
        parent[root(a)] = root(b)
    groups: dict[str, list[str]] = {}
    for k in sorted(keys):
        groups.setdefault(root(k), []).append(k)
    return list(groups.values())


def global_pass(definitions: DataFrame, tx_item: DataFrame, tx: DataFrame, scores: DataFrame, threshold: int, beta: float = 0.25, gamma: float = 0.75) -> DataFrame:
    """Modifications that bring every pattern below the threshold over all months; step counts those of a pattern in order, from 0.
    tx_item and tx are those after the local pass.

    The driver holds the leaking patterns with their totals, selected ones at most; transactions stay where they are."""
    spark = definitions.sparkSession
    state = checkpoint(_packed(definitions, tx_item, tx, scores))
    held = _scored(holding(state, definitions.select("pattern_key", "items")), beta, gamma)
    sums = held.groupBy("pattern_key", "items").agg(F.sum("utility").alias("total")).filter(F.col("total") >= threshold).collect()
    patterns = {r.pattern_key: (list(r["items"]), r.total) for r in sums}
    if not patterns:
        return spark.createDataFrame([], MODIFICATION)
    rows = held.filter(F.col("pattern_key").isin(list(patterns))).select("pattern_key", "window_key", "tid", "utility", "rank_score")
    orders = checkpoint(running(rows, ["pattern_key"], [F.desc("rank_score"), F.asc("window_key"), F.asc("tid")], {"before": "utility"}))
    tops = checkpoint(_tops(orders, {k: u - threshold + 1 for k, (_, u) in patterns.items()}))
    # What happens in a top transaction concerns every leaking pattern that it holds.
    met = orders.join(tops, ["window_key", "tid"], "left_semi").groupBy("window_key", "tid").agg(F.array_sort(F.collect_set("pattern_key")).alias("keys"))
    met = checkpoint(met)
    pairs = met.select(F.col("keys")[0].alias("a"), F.explode("keys").alias("b")).distinct().collect()  # pairs of leaking patterns
    groups = _joined([(r.a, r.b) for r in pairs], list(patterns))
    names = spark.createDataFrame([(k, i) for i, g in enumerate(groups) for k in g], "key string, component int")
    rows = state.join(met.select("window_key", "tid", F.col("keys")[0].alias("key")), ["window_key", "tid"]).join(F.broadcast(names), "key")
    rows = rows.select("component", "window_key", "tid", "tu", F.col("x.item_id").alias("items"), F.col("x.util").alias("utils"))
    known = {r.item_id: r.score for r in scores.select("item_id", "score").collect()}  # items of selected patterns
    return rows.groupBy("component").applyInPandas(_global([{k: patterns[k] for k in g} for g in groups], threshold, known, beta, gamma), MODIFICATION)


def sanitize(definitions: DataFrame, tx_item: DataFrame, tx: DataFrame, scores: DataFrame, local_ratio: float, global_ratio: float, beta: float = 0.25, gamma: float = 0.75):
    """Both passes: modifications, and facts and headers after them."""
    changes, rows = sanitize_packed(definitions, packed(tx_item, tx), scores, local_ratio, global_ratio, beta, gamma)
    return changes, unpacked(rows), headers(rows)


def sanitize_packed(definitions: DataFrame, rows: DataFrame, scores: DataFrame, local_ratio: float, global_ratio: float, beta: float = 0.25, gamma: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Both passes over a packed table: modifications, and the table after them. Results are cut from their lineage, as each is used
    often."""
    local = checkpoint(local_pass(definitions, rows, rows, scores, local_ratio, beta, gamma))
    threshold = rows.agg(hiding_threshold(F.coalesce(F.sum("transaction_utility"), F.lit(0)), global_ratio).alias("t")).first().t
    middle = checkpoint(modified(rows, local))
    patched = checkpoint(global_pass(definitions, middle, middle, scores, threshold, beta, gamma))
    return local.unionByName(patched), checkpoint(modified(middle, patched))


def summary(definitions: DataFrame, tx_item: DataFrame, tx: DataFrame, modifications: DataFrame, after_item: DataFrame, after: DataFrame, local_ratio: float, global_ratio: float) -> DataFrame:
    """One row: what was hidden and at what cost."""
    total = lambda name: F.coalesce(F.sum("transaction_utility"), F.lit(0)).alias(name)
    row = tx.agg(total("original_total_utility")).crossJoin(after.agg(total("sanitized_total_utility"))).crossJoin(definitions.agg(F.count("*").alias("sensitive_patterns")))
    row = row.withColumn("global_threshold_abs", hiding_threshold(F.col("original_total_utility"), global_ratio))
    locally = local_reports(definitions, tx_item, tx, modifications, local_ratio)
    row = row.crossJoin(locally.agg(F.coalesce(F.sum("local_violations"), F.lit(0)).alias("local_violations_after")))
    middle, _ = apply_modifications(tx_item, tx, modifications.filter("phase = 'local'"))
    for facts, name in ((middle, "pre_patch_global_leaks"), (after_item, "post_patch_global_leaks")):
        sums = pattern_support(definitions, facts).groupBy("pattern_key").agg(F.sum("utility").alias("u"))
        row = row.crossJoin(sums.crossJoin(row.select(F.col("global_threshold_abs").alias("g"))).agg(F.count_if(F.col("u") >= F.col("g")).alias(name)))
    changed = modifications.groupBy("window_key", "tid").agg(F.sum("delta").alias("d")).agg(F.count("*").alias("modified_transactions"), F.coalesce(F.sum("d"), F.lit(0)).alias("total_utility_reduced"))
    row = row.crossJoin(changed)  # all of these are single rows
    return row.withColumn("utility_loss_rate", F.coalesce(F.try_divide(F.col("total_utility_reduced").cast("double"), F.col("original_total_utility").cast("double")), F.lit(0.0)))


def local_reports(definitions: DataFrame, tx_item: DataFrame, tx: DataFrame, modifications: DataFrame, ratio: float) -> DataFrame:
    """For each month: targets, modifications, utility given up, and targets that still reach the threshold after the local pass."""
    local = modifications.filter("phase = 'local'")
    middle, _ = apply_modifications(tx_item, tx, local)
    targets = definitions.select("pattern_key", F.explode("local_target_windows").alias("window_key"))
    sums = pattern_support(definitions, middle).groupBy("pattern_key", "window_key").agg(F.sum("utility").alias("u"))
    limits = local_thresholds(tx, ratio)
    hidden = targets.join(sums, ["pattern_key", "window_key"], "left").join(limits, "window_key").groupBy("window_key").agg(F.count("*").alias("targets"), F.count_if(F.coalesce("u", F.lit(0)) >= F.col("threshold")).alias("local_violations"))
    steps = local.groupBy("window_key").agg(F.count("*").alias("modifications"), F.sum("delta").alias("utility_reduced"))
    return limits.withColumnRenamed("threshold", "local_threshold_abs").join(hidden, "window_key", "left").join(steps, "window_key", "left").fillna(0, ["targets", "local_violations", "modifications", "utility_reduced"])
