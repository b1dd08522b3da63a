"""Every operator as a query over the star-schema tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lineage
from .operators import explore, mining, prepare, profile, sanitize, temporal, verify
from .plans import run
from .schema import Params
from .sources import artifacts
from .sources.huim_text import transaction_lines
from .sources.retail import retail

MINE = Params(candidate_mining_ratio=0.03, sensitive_ratio=0.03, max_patterns_per_window=None)
HIDE = Params(candidate_mining_ratio=0.05, sensitive_ratio=0.05, local_ratio=0.05, global_ratio=0.04, max_patterns_per_window=None)
IMPACT = (2, 3, 4, 5, 6, 8, 10, 30)
TOP = 5

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def dirty(spark, d):
    return retail(spark, d, dirty=True).drop("row_id")


def ready(spark, d, is_dirty=False):
    return run.prepared(retail(spark, d, dirty=is_dirty))


# Profiles


@query
def raw_summary(spark, d):
    return rounded(profile.raw_summary(dirty(spark, d)), 2)


@query
def sales_overview(spark, d):
    return rounded(profile.sales_overview(dirty(spark, d)), 2)


@query
def raw_monthly_stats(spark, d):
    return rounded(profile.monthly_stats(dirty(spark, d)), 2)


@query
def top_products_utility(spark, d):
    return rounded(profile.top_products(dirty(spark, d)), 2)


@query
def top_products_quantity(spark, d):
    return rounded(profile.top_products(dirty(spark, d), "total_quantity"), 2)


@query
def product_table(spark, d):
    return rounded(profile.top_products(dirty(spark, d), n=100), 2)


@query
def invoice_lengths(spark, d):
    return profile.invoice_lengths(dirty(spark, d))


@query
def invoice_utilities(spark, d):
    return rounded(profile.invoice_utilities(dirty(spark, d)), 2)


# Preparation


@query
def drop_report(spark, d):
    return prepare.drop_report(prepare.classify(retail(spark, d, dirty=True)))


@query
def item_dictionary(spark, d):
    return prepare.item_dictionary(prepare.clean(prepare.classify(retail(spark, d, dirty=True))))


@query
def item_level(spark, d):
    return ready(spark, d, True).tx_item


@query
def transactions(spark, d):
    rows = prepare.nested(ready(spark, d, True).baskets)
    return rows.select("window_key", "tid", "invoice_no", F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"), F.array_join(F.transform("items", lambda i: F.concat(i.cast("string"), F.lit("="), F.element_at("item_utils", i).cast("string"))), ",").alias("item_utils"), "transaction_utility", "length")


@query
def window_totals(spark, d):
    return prepare.windows(ready(spark, d, True).tx)


@query
def max_len_impact(spark, d):
    return rounded(prepare.max_len_impact(ready(spark, d, True).tx_before, IMPACT))


@query
def preprocess_report(spark, d):
    data = run.prepared(retail(spark, d, dirty=True), Params(max_transaction_len=4))
    return rounded(prepare.report(data.classified, data.tx_before, data.tx))


# Mining


@query
def twu_items(spark, d):
    data = ready(spark, d)
    return mining.twu(data.baskets, data.tx)


@query
def twu_pruned_items(spark, d):
    data = ready(spark, d)
    return mining.twu_prune(data.tx_item, data.tx, 0.1).select("window_key", "tid", "item_id", "util")


@query
def twu_stats(spark, d):
    data = ready(spark, d)
    return rounded(mining.twu_stats(data.tx_item, data.tx, 0.1))


@query
def hui_small(spark, d):
    data = ready(spark, d)
    return mining.mine(data.baskets, data.baskets, MINE.candidate_mining_ratio, max_len=2).select("window_key", "pattern_key", "utility")


@query
def hui_all(spark, d):
    data = ready(spark, d)
    return mining.mine(data.baskets, data.baskets, MINE.candidate_mining_ratio).select("window_key", "pattern_key", "utility")


@query
def hui_topk(spark, d):
    data = ready(spark, d)
    return mining.top_patterns(mining.mine(data.baskets, data.baskets, MINE.candidate_mining_ratio), TOP).select("window_key", "pattern_key", "utility")


def _mined(spark, d, params=MINE):
    data = ready(spark, d)
    return data, run.mined(data, params)


@query
def candidate_patterns(spark, d):
    return rounded(_mined(spark, d)[1].candidates.drop("items"))


@query
def candidate_utilities(spark, d):
    return rounded(_mined(spark, d)[1].dense, 9)


@query
def temporal_stats(spark, d):
    return rounded(_mined(spark, d)[1].stats.drop("traces"))


@query
def survivors(spark, d):
    return _mined(spark, d)[1].survivors.select("pattern_key", "support_windows", "max_window", "max_utility")


@query
def peak_sensitive_selection(spark, d):
    return rounded(_mined(spark, d)[1].selected.select("pattern_key", "selected_window", "window_utility", "window_ratio", "support_windows", "max_window", "max_utility", "max_ratio", "mean_ratio", "peakness_ratio", "peak_windows", "rank"))


@query
def item_scores(spark, d):
    return rounded(_mined(spark, d)[1].scores.drop("patterns"))


@query
def mining_summary(spark, d):
    m = _mined(spark, d)[1]
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(m.patterns, "total_raw_patterns").crossJoin(one(m.stats, "unique_candidates")).crossJoin(one(m.survivors, "survivors")).crossJoin(one(m.selected, "selected_patterns")).crossJoin(one(m.scores, "scored_items"))


# Hiding


def _definitions(spark, d):
    data, found = _mined(spark, d, HIDE)
    return data, found, sanitize.sensitive_definitions(found.selected)


@query
def sensitive_definitions(spark, d):
    return rounded(_definitions(spark, d)[2].drop("items"))


@query
def pattern_utils_local(spark, d):
    data, _, defs = _definitions(spark, d)
    return temporal.pattern_support(defs, data.baskets).groupBy("pattern_key", "window_key").agg(F.sum("utility").alias("utility"))


@query
def pattern_utils_global(spark, d):
    data, _, defs = _definitions(spark, d)
    return verify.pattern_totals(defs, data.baskets)


def _first(spark, d):
    data, found, defs = _definitions(spark, d)
    return data, sanitize.hide_first_target(defs, data.baskets, data.baskets, found.scores, HIDE.local_ratio)


@query
def local_pass_first_target(spark, d):
    return _first(spark, d)[1]


@query
def modified_after_first_target(spark, d):
    data, changes = _first(spark, d)
    return verify.compare(data.baskets, data.baskets, *sanitize.apply_modifications(data.baskets, data.baskets, changes), data.items)


@query
def integrity_audit(spark, d):
    data, changes = _first(spark, d)
    return verify.audit_counts(*sanitize.apply_modifications(data.baskets, data.baskets, changes))


@query
def integrity_audit_damaged(spark, d):
    """The audit of a database whose declared totals, items and utilities were changed: invoices by their last digit."""
    data = ready(spark, d)
    digit = F.substring("invoice_no", -1, 1)
    tx = data.tx.withColumn("transaction_utility", F.col("transaction_utility") + F.when(digit == "7", 5).otherwise(0))
    facts = data.tx_item.withColumn("util", F.when(digit == "3", 0).when((digit == "4") & (F.col("item_id") <= 12), F.lit(0)).otherwise(F.col("util")))
    return verify.audit_counts(facts.unionByName(facts.filter(digit == "1")), tx)


@query
def restricted_selection(spark, d):
    """The selection restricted to chosen patterns, here those that come first in some month, as a table of keys."""
    selected = _mined(spark, d, HIDE)[1].selected
    return temporal.restrict(selected, selected.filter("rank = 1").select("pattern_key")).select("pattern_key", "selected_window", "rank")


@query
def transaction_detail(spark, d):
    data, changes = _first(spark, d)
    chosen = data.tx.agg(F.max_by(F.struct("window_key", "tid"), F.struct("length", "window_key", "tid")).alias("c")).first().c
    return explore.transaction_detail(chosen.window_key, chosen.tid, data.baskets, data.baskets, *sanitize.apply_modifications(data.baskets, data.baskets, changes), data.items)


def _hidden(spark, d):
    data, found = _mined(spark, d, HIDE)
    return data, found, run.sanitized(data, found, HIDE)


@query
def modifications(spark, d):
    return _hidden(spark, d)[2].modifications


@query
def sanitized_items(spark, d):
    return _hidden(spark, d)[2].tx_item


@query
def sanitization_summary(spark, d):
    data, _, h = _hidden(spark, d)
    return rounded(sanitize.summary(h.definitions, data.baskets, data.baskets, h.modifications, h.baskets, h.baskets, HIDE.local_ratio, HIDE.global_ratio))


@query
def local_reports(spark, d):
    data, _, h = _hidden(spark, d)
    return sanitize.local_reports(h.definitions, data.baskets, data.baskets, h.modifications, HIDE.local_ratio)


# Verification


@query
def local_hiding(spark, d):
    data, _, h = _hidden(spark, d)
    return rounded(verify.local_hiding(h.definitions, data.tx, h.baskets, h.baskets, HIDE.local_ratio))


@query
def pattern_metrics(spark, d):
    data, _, h = _hidden(spark, d)
    return verify.pattern_metrics(h.definitions, data.baskets, data.baskets, h.baskets, HIDE.global_ratio)


@query
def global_leakage(spark, d):
    """Patterns at or above the global threshold before anything is hidden."""
    data, _, defs = _definitions(spark, d)
    return verify.pattern_metrics(defs, data.baskets, data.baskets, data.baskets, HIDE.global_ratio).filter("global_leak").select("pattern_key", "original_global_utility", "global_threshold_abs")


@query
def local_leakage(spark, d):
    """Months and their targets that are still open before anything is hidden."""
    data, _, defs = _definitions(spark, d)
    return rounded(verify.local_hiding(defs, data.tx, data.baskets, data.baskets, HIDE.local_ratio))


@query
def modified_transactions(spark, d):
    data, _, h = _hidden(spark, d)
    return verify.compare(data.baskets, data.baskets, h.baskets, h.baskets, data.items)


@query
def verification_report(spark, d):
    data, found, h = _hidden(spark, d)
    return rounded(run.verified(data, found, h, HIDE))


# Presentation


@query
def selected_pattern_labels(spark, d):
    data, found = _mined(spark, d, HIDE)
    out = explore.pattern_labels(found.selected, data.items)
    return out.select("pattern_key", "selected_window", F.array_join("labels", " + ").alias("labels"), "short_text")


@query
def cross_sell(spark, d):
    data, found = _mined(spark, d, HIDE)
    return explore.cross_sell(explore.pattern_labels(found.selected, data.items))


@query
def business_rows(spark, d):
    return rounded(explore.business_rows(_mined(spark, d, HIDE)[1].selected))


#: For each section of the explorer, the field that tells its records apart and a number of theirs.
_SHOWN = {
    "modified_transactions": (("tid", "item_id"), "delta"), "selected_patterns": (("pattern_key", "selected_window"), "window_utility"), "window_metrics": (("window_key",), "local_threshold_abs"),
    "pattern_metrics": (("pattern_key",), "sanitized_global_utility"), "phase0_summary": (("window_granularity",), "utility_after_filter"), "phase2_summary": ((), "total_utility_reduced"),
}


@query
def explorer_bundle(spark, d):
    """A run's artifacts, written by its stages and read back as the explorer shows them: each record's key and a number of it."""
    base = f"{lineage.shared(spark)}/explorer-{uuid.uuid4().hex}/run"
    data, found, h = _hidden(spark, d)
    artifacts.write_prepared(data, f"{base}/one/two/three", HIDE)
    artifacts.write_mined(data, found, base, HIDE)
    artifacts.write_sanitized(data, h, base, HIDE)
    artifacts.write_verified(data, h, f"{base}/checks", HIDE)
    rows = artifacts.explorer_bundle(spark, base)
    field = lambda c: F.get_json_object("document", f"$.{c}")
    key, number = F.lit(""), F.lit(None).cast("string")
    for section, (names, amount) in _SHOWN.items():
        key = F.when(F.col("section") == section, F.concat_ws(" ", *map(field, names))).otherwise(key)
        number = F.when(F.col("section") == section, field(amount)).otherwise(number)
    return rows.select("section", key.alias("key"), number.cast("long").alias("amount"))


@query
def huim_text(spark, d):
    return transaction_lines(ready(spark, d).baskets)
