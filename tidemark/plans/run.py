"""A whole run: profile, prepare, mine, select, sanitize, verify."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint
from ..functions.packing import headers, unpacked
from ..operators import mining, prepare, sanitize, temporal, verify
from ..schema import Params


@dataclass
class Prepared:
    classified: DataFrame
    items: DataFrame
    tx_item: DataFrame
    tx: DataFrame
    tx_before: DataFrame
    facts: DataFrame  # of tx_before
    baskets: DataFrame  # tx_item and tx, packed
    baskets_before: DataFrame  # facts and tx_before, packed


def prepared(raw: DataFrame, params: Params = Params()) -> Prepared:
    """Transactions by month, cut from their lineage as every later step reads them. Rows are joined and parsed once, and written
    with what the dictionary, the facts and the report need of them."""
    classified = checkpoint(prepare.classify(raw).drop("quantity", "unit_price", "ts"))
    rows = prepare.clean(classified)
    items = checkpoint(prepare.item_dictionary(rows))
    before = checkpoint(prepare.baskets(rows, items))
    kept = before if params.max_transaction_len is None else before.filter(F.col("length") <= params.max_transaction_len)
    return Prepared(classified, items, unpacked(kept), headers(kept), headers(before), unpacked(before), kept, before)


@dataclass
class Mined:
    patterns: DataFrame
    candidates: DataFrame
    dense: DataFrame
    stats: DataFrame
    survivors: DataFrame
    selected: DataFrame
    scores: DataFrame


def mined(data: Prepared, params: Params = Params()) -> Mined:
    patterns = checkpoint(mining.top_patterns(mining.mine(data.baskets, data.baskets, params.candidate_mining_ratio, params.enable_twu_pruning), params.max_patterns_per_window))
    found = mining.candidates(patterns)
    dense = temporal.pattern_windows(found, data.baskets, prepare.windows(data.tx))
    stats = checkpoint(temporal.temporal_stats(dense))
    kept = temporal.survivors(stats, params.sensitive_ratio, params.min_peakness_ratio, params.min_support_windows)
    selected = temporal.select_peaks(kept, params.sensitive_ratio, params.max_selected_per_window)
    return Mined(patterns, found, dense, stats, kept, selected, temporal.item_scores(selected))


@dataclass
class Sanitized:
    definitions: DataFrame
    scores: DataFrame
    modifications: DataFrame
    tx_item: DataFrame
    tx: DataFrame
    baskets: DataFrame  # tx_item and tx, packed


def sanitized(data: Prepared, found: Mined, params: Params = Params(), keys: list[str] | None = None) -> Sanitized:
    """Hide the selected patterns, or those of them with the given keys."""
    definitions = checkpoint(sanitize.sensitive_definitions(temporal.restrict(found.selected, keys or [])))
    scores = checkpoint(found.scores)
    changes, rows = sanitize.sanitize_packed(definitions, data.baskets, scores, params.local_ratio, params.global_ratio, params.beta, params.gamma)
    return Sanitized(definitions, scores, changes, unpacked(rows), headers(rows), rows)


def verified(data: Prepared, found: Mined, hidden: Sanitized, params: Params = Params()) -> DataFrame:
    """The report over every selected pattern, also those that were not asked to be hidden."""
    every = checkpoint(sanitize.sensitive_definitions(found.selected))
    return verify.report(every, data.baskets, data.tx, hidden.baskets, hidden.tx, data.items, params.local_ratio, params.global_ratio)
