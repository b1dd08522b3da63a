"""The same results as DuckDB SQL, for the queries that SQL can express."""

from __future__ import annotations

from .queries import HIDE, IMPACT, MINE, TOP

_JOINS = """FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
_ID = "{'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey} AS row_id"
_COMMON = "(CASE WHEN o_orderstatus = 'P' THEN 'C' ELSE '' END) || CAST(o_orderkey AS VARCHAR) AS invoice, CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_type END AS description"
CLEAN_ROWS = f"raw AS (SELECT {_COMMON}, p_brand AS stock, l_quantity AS quantity, p_retailprice AS price, o_orderdate AS ts, {_ID} {_JOINS})"
DIRTY_ROWS = f"""raw AS (SELECT {_COMMON}, CASE WHEN l_linenumber = 7 AND l_returnflag = 'N' THEN NULL ELSE p_brand END AS stock,
    CASE WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity,
    CASE WHEN l_linenumber = 5 AND l_returnflag = 'A' THEN 0.004::DOUBLE ELSE p_retailprice END AS price,
    CASE WHEN l_linenumber = 4 AND l_returnflag = 'N' AND l_quantity > 45 THEN NULL ELSE date_trunc('minute', o_orderdate) END AS ts, {_ID} {_JOINS})"""
VALID = "valid AS (SELECT *, coalesce(quantity * price, 0) AS utility FROM raw WHERE NOT starts_with(invoice, 'C') AND stock IS NOT NULL AND quantity > 0 AND price > 0 AND ts IS NOT NULL)"
CLASSIFIED = """classified AS (SELECT *, strftime(ts, '%Y-%m') AS window_key, round_even((quantity * price)::DOUBLE, 0)::BIGINT AS util,
    CASE WHEN stock IS NULL THEN 'missing_required' WHEN starts_with(invoice, 'C') THEN 'cancelled_invoice'
         WHEN NOT (quantity > 0 AND price > 0) THEN 'nonpositive_quantity_or_price' WHEN ts IS NULL THEN 'invalid_invoice_date'
         WHEN round_even((quantity * price)::DOUBLE, 0) <= 0 THEN 'nonpositive_utility' END AS drop_reason FROM raw),
kept AS (SELECT * FROM classified WHERE drop_reason IS NULL)"""
PREPARED = f"""{CLASSIFIED},
items AS (SELECT row_number() OVER (ORDER BY stock)::INT AS item_id, stock AS stock_code, description FROM
    (SELECT stock, arg_min(description, row_id) FILTER (WHERE description IS NOT NULL) AS description FROM kept GROUP BY stock)),
tx_item AS (SELECT window_key, window_key || '_' || invoice AS tid, invoice AS invoice_no, item_id, sum(util)::BIGINT AS util FROM kept JOIN items ON stock = stock_code GROUP BY window_key, invoice, item_id),
tx AS (SELECT window_key, tid, invoice_no, sum(util)::BIGINT AS transaction_utility, count(*)::INT AS length FROM tx_item GROUP BY ALL),
win AS (SELECT window_key, sum(transaction_utility)::BIGINT AS total_utility, count(*)::BIGINT AS num_transactions FROM tx GROUP BY window_key)"""
# The missing-value rule looks at dates before they are parsed: the text 'bad' is not missing, so only the stock can be.


def _dirty(select: str) -> str:
    return f"WITH {DIRTY_ROWS}, {PREPARED} {select}"


def _ready(select: str, more: str = "") -> str:
    return f"WITH RECURSIVE {CLEAN_ROWS}, {PREPARED}{more} {select}"


SUBSETS = """,
sub(window_key, tid, last, pattern_key, k, util, first_score) AS (
    SELECT window_key, tid, item_id, item_id::VARCHAR, 1, util, 0 FROM tx_item
    UNION ALL
    SELECT s.window_key, s.tid, i.item_id, s.pattern_key || ' ' || i.item_id, s.k + 1, s.util + i.util, 0
    FROM sub s JOIN tx_item i ON s.window_key = i.window_key AND s.tid = i.tid AND i.item_id > s.last)"""


def _mined(params) -> str:
    ratio, sensitive = params.candidate_mining_ratio, params.sensitive_ratio
    return f"""{SUBSETS},
hui AS (SELECT window_key, pattern_key, sum(util)::BIGINT AS utility FROM sub JOIN win USING (window_key) GROUP BY window_key, pattern_key, total_utility
    HAVING sum(util) >= greatest(1, trunc(total_utility * {ratio}::DOUBLE))),
cand AS (SELECT pattern_key, string_agg(window_key, ',' ORDER BY window_key) AS source_windows, max(utility)::BIGINT AS max_mined_utility FROM hui GROUP BY pattern_key),
used AS (SELECT pattern_key, window_key, sum(util)::BIGINT AS u FROM sub WHERE pattern_key IN (SELECT pattern_key FROM cand) GROUP BY ALL),
dense AS (SELECT pattern_key, window_key, coalesce(u, 0)::BIGINT AS utility, coalesce(u, 0)::DOUBLE / total_utility::DOUBLE AS ratio FROM cand CROSS JOIN win LEFT JOIN used USING (pattern_key, window_key)),
best AS (SELECT pattern_key, window_key AS max_window, utility AS max_utility, ratio AS max_ratio FROM dense QUALIFY row_number() OVER (PARTITION BY pattern_key ORDER BY utility DESC, ratio DESC, window_key) = 1),
stats AS (SELECT pattern_key, support_windows, max_window, max_utility, max_ratio, mean_ratio, coalesce(max_ratio / nullif(mean_ratio, 0), 0) AS peakness_ratio, peak_windows, top_ratio FROM best
    JOIN (SELECT pattern_key, count(*) FILTER (WHERE utility > 0)::BIGINT AS support_windows, coalesce(avg(ratio) FILTER (WHERE ratio > 0), 0) AS mean_ratio, max(ratio) AS top_ratio FROM dense GROUP BY pattern_key) USING (pattern_key)
    JOIN (SELECT d.pattern_key, coalesce(string_agg(d.window_key, ',' ORDER BY d.window_key) FILTER (WHERE d.ratio = b.max_ratio AND d.ratio > 0), '') AS peak_windows FROM dense d JOIN best b USING (pattern_key) GROUP BY d.pattern_key) USING (pattern_key)),
surv AS (SELECT * FROM stats WHERE support_windows >= {params.min_support_windows} AND peakness_ratio >= {params.min_peakness_ratio}::DOUBLE AND top_ratio >= {sensitive}::DOUBLE),
sel AS (SELECT s.*, d.window_key AS selected_window, d.utility AS window_utility, d.ratio AS window_ratio,
        row_number() OVER (PARTITION BY d.window_key ORDER BY d.ratio DESC, d.utility DESC, s.peakness_ratio DESC, s.pattern_key)::INT AS rank
    FROM surv s JOIN dense d USING (pattern_key) WHERE d.utility > 0 AND d.ratio >= {sensitive}::DOUBLE QUALIFY rank <= {params.max_selected_per_window}),
each AS (SELECT pattern_key, selected_window, window_ratio * peakness_ratio AS score, unnest(string_split(pattern_key, ' '))::INT AS item_id FROM sel),
scores AS (SELECT item_id, sum(score) AS score, count(*)::BIGINT AS selected_count, string_agg(DISTINCT selected_window, ',' ORDER BY selected_window) AS windows FROM each GROUP BY item_id)"""


def _hide() -> str:
    ratio = HIDE.local_ratio
    return f"""{_mined(HIDE)},
defs AS (SELECT pattern_key, string_agg(DISTINCT selected_window, ',' ORDER BY selected_window) AS local_target_windows FROM sel GROUP BY pattern_key),
peaks AS (SELECT pattern_key, string_agg(DISTINCT w, ',' ORDER BY w) AS peak_windows FROM (SELECT pattern_key, unnest(list_append(string_split(peak_windows, ','), max_window)) AS w FROM sel) WHERE w <> '' GROUP BY pattern_key),
support AS (SELECT pattern_key, window_key, tid, util AS utility FROM sub WHERE pattern_key IN (SELECT pattern_key FROM defs)),
limits AS (SELECT window_key, greatest(1, trunc(total_utility * {ratio}::DOUBLE))::BIGINT AS threshold FROM win),
total AS (SELECT sum(total_utility)::BIGINT AS total, greatest(1, trunc(sum(total_utility)::BIGINT * {HIDE.global_ratio}::DOUBLE))::BIGINT AS threshold FROM win),
globally AS (SELECT pattern_key, sum(utility)::BIGINT AS utility FROM support GROUP BY pattern_key),
target AS (SELECT selected_window AS window_key, min(pattern_key) AS pattern_key FROM sel GROUP BY selected_window),
members AS (SELECT window_key, pattern_key, unnest(string_split(pattern_key, ' '))::INT AS item_id FROM target),
victims AS (SELECT t.window_key, t.pattern_key, s.tid, s.utility, i.item_id, i.util, coalesce(c.score, 0) AS item_score
    FROM target t JOIN support s USING (window_key, pattern_key) JOIN members m USING (window_key, pattern_key) JOIN tx_item i ON i.window_key = s.window_key AND i.tid = s.tid AND i.item_id = m.item_id LEFT JOIN scores c ON c.item_id = i.item_id
    QUALIFY row_number() OVER (PARTITION BY t.window_key, t.pattern_key, s.tid ORDER BY coalesce(c.score, 0), i.util DESC, i.item_id) = 1),
ordered AS (SELECT v.*, threshold, sum(utility) OVER (PARTITION BY v.window_key)::BIGINT AS total,
        coalesce(sum(utility) OVER (PARTITION BY v.window_key ORDER BY utility + {HIDE.beta}::DOUBLE * transaction_utility + {HIDE.gamma}::DOUBLE - item_score DESC, v.tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM victims v JOIN tx ON tx.window_key = v.window_key AND tx.tid = v.tid JOIN limits l ON l.window_key = v.window_key),
cut AS (SELECT window_key, tid, item_id, util AS before_utility, (util - least(util, total - before - threshold + 1))::BIGINT AS after_utility, least(util, total - before - threshold + 1)::BIGINT AS delta, pattern_key FROM ordered WHERE total - before >= threshold),
after_item AS (SELECT i.window_key, i.tid, i.invoice_no, i.item_id, (i.util - coalesce(c.delta, 0))::BIGINT AS util FROM tx_item i LEFT JOIN cut c USING (window_key, tid, item_id) WHERE i.util - coalesce(c.delta, 0) > 0),
labelled AS (SELECT pattern_key, selected_window, list(label ORDER BY pos) AS labels, list(short ORDER BY pos) AS shorts FROM (
    SELECT pattern_key, selected_window, pos, 'ItemID ' || e.item_id || ' | StockCode ' || stock_code || CASE WHEN coalesce(description, '') <> '' THEN ' | Description ' || description ELSE '' END AS label,
        stock_code || CASE WHEN coalesce(description, '') <> '' THEN ' - ' || description ELSE '' END AS short
    FROM (SELECT pattern_key, selected_window, unnest(string_split(pattern_key, ' '))::INT AS item_id, generate_subscripts(string_split(pattern_key, ' '), 1) AS pos FROM sel) e JOIN items USING (item_id)) GROUP BY ALL)"""


def _steps() -> str:
    """Both passes of hiding. A row of `loc` is a transaction after the targets up to the r-th of its month, one of `everywhere` after n
    steps of the global pass; what a step takes stands in the row that it changes."""
    score = f"u + {HIDE.beta}::DOUBLE * tu + {HIDE.gamma}::DOUBLE - v.s"
    held = "list_filter({0}.x, lambda e: list_contains({1}.p, e.i) AND e.u > 0)"
    whole = "CASE WHEN len(held) = len(p) THEN list_sum(list_transform(held, lambda e: e.u))::BIGINT ELSE 0 END AS u, list_min(list_transform(held, lambda e: {'s': e.s, 'l': -e.u, 'i': e.i})) AS v"
    lower = "list_transform(x, lambda e: CASE WHEN e.i = {0} THEN struct_pack(i := e.i, u := e.u - {1}, s := e.s) ELSE e END)"
    earlier = f"OVER (PARTITION BY window_key ORDER BY CASE WHEN u > 0 THEN {score} END DESC NULLS LAST, tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{_hide()},
pats AS (SELECT pattern_key, list_transform(string_split(pattern_key, ' '), lambda x: x::INT) AS p FROM defs),
targets AS (SELECT selected_window AS window_key, sel.pattern_key, p, threshold, row_number() OVER (PARTITION BY selected_window ORDER BY sel.pattern_key) AS r FROM sel JOIN pats USING (pattern_key) JOIN limits ON limits.window_key = selected_window),
packed AS (SELECT i.window_key, i.tid, transaction_utility AS tu, list({{'i': i.item_id, 'u': i.util, 's': coalesce(score, 0)}} ORDER BY i.item_id) AS x
    FROM tx_item i JOIN tx ON tx.window_key = i.window_key AND tx.tid = i.tid LEFT JOIN scores ON scores.item_id = i.item_id WHERE i.item_id IN (SELECT item_id FROM each) GROUP BY i.window_key, i.tid, transaction_utility),
loc(r, window_key, tid, tu, x, pattern_key, item_id, before_utility, delta, step) AS (
    SELECT 0, window_key, tid, tu, x, NULL::VARCHAR, NULL::INT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM packed
    UNION ALL
    SELECT r, window_key, tid, (tu - coalesce(d, 0))::BIGINT, CASE WHEN d > 0 THEN {lower.format("v.i", "d")} ELSE x END, CASE WHEN d > 0 THEN pattern_key END, CASE WHEN d > 0 THEN v.i END, CASE WHEN d > 0 THEN -v.l END, CASE WHEN d > 0 THEN d END, step FROM
        (SELECT *, CASE WHEN u > 0 AND total - before >= threshold THEN least(-v.l, total - before - threshold + 1) END::BIGINT AS d FROM
            (SELECT *, sum(u) OVER (PARTITION BY window_key) AS total, coalesce(sum(u) {earlier}, 0) AS before, coalesce(sum(CASE WHEN u > 0 THEN 1 ELSE 0 END) {earlier}, 0)::BIGINT AS step FROM
                (SELECT *, {whole} FROM
                    (SELECT l.r + 1 AS r, l.window_key, l.tid, l.tu, l.x, t.pattern_key, t.p, t.threshold, {held.format("l", "t")} AS held FROM loc l LEFT JOIN targets t ON t.window_key = l.window_key AND t.r = l.r + 1 WHERE l.r < (SELECT max(r) FROM targets)))))),
mid AS (SELECT window_key, tid, tu, x FROM loc WHERE r = (SELECT max(r) FROM targets)),
leaking AS (SELECT pattern_key, p FROM (SELECT pattern_key, p, {whole} FROM (SELECT k.pattern_key, k.p, {held.format("m", "k")} AS held FROM mid m CROSS JOIN pats k)) GROUP BY pattern_key, p HAVING sum(u) >= (SELECT threshold FROM total)),
everywhere(n, window_key, tid, tu, x, pattern_key, item_id, before_utility, delta) AS (
    SELECT 0, window_key, tid, tu, x, NULL::VARCHAR, NULL::INT, NULL::BIGINT, NULL::BIGINT FROM mid m WHERE EXISTS (SELECT 1 FROM leaking k WHERE len({held.format("m", "k")}) = len(k.p))
    UNION ALL
    SELECT g.n + 1, g.window_key, g.tid, (g.tu - CASE WHEN hit THEN d ELSE 0 END)::BIGINT, CASE WHEN hit THEN {lower.format("b.i", "d")} ELSE x END, CASE WHEN hit THEN b.pattern_key END, CASE WHEN hit THEN b.i END, CASE WHEN hit THEN b.was END, CASE WHEN hit THEN d END FROM
        (SELECT g.n, g.window_key, g.tid, g.tu, g.x, b, b.d AS d, g.window_key = b.w AND g.tid = b.t AS hit FROM everywhere g CROSS JOIN
            (SELECT {{'pattern_key': pattern_key, 'w': window_key, 't': tid, 'i': v.i, 'was': -v.l, 'd': least(-v.l, total - threshold + 1)::BIGINT}} AS b FROM
                (SELECT *, sum(u) OVER (PARTITION BY pattern_key) AS total, (SELECT threshold FROM total) AS threshold FROM
                    (SELECT *, {whole} FROM (SELECT h.window_key, h.tid, h.tu, k.pattern_key, k.p, {held.format("h", "k")} AS held FROM everywhere h CROSS JOIN leaking k)))
                WHERE total >= threshold AND u > 0 ORDER BY total DESC, pattern_key, {score} DESC, window_key, tid LIMIT 1)) g),
mods AS (SELECT window_key, tid, item_id, before_utility, (before_utility - delta)::BIGINT AS after_utility, delta, 'local' AS phase, pattern_key, step FROM loc WHERE delta > 0
    UNION ALL SELECT window_key, tid, item_id, before_utility, (before_utility - delta)::BIGINT, delta, 'global', pattern_key, (row_number() OVER (PARTITION BY pattern_key ORDER BY n) - 1)::BIGINT FROM everywhere WHERE delta > 0),
taken AS (SELECT window_key, tid, item_id, sum(delta) AS d, coalesce(sum(delta) FILTER (WHERE phase = 'local'), 0) AS d_local FROM mods GROUP BY ALL),
end_item AS (SELECT i.window_key, i.tid, i.invoice_no, i.item_id, (i.util - coalesce(d, 0))::BIGINT AS util FROM tx_item i LEFT JOIN taken USING (window_key, tid, item_id) WHERE i.util - coalesce(d, 0) > 0),
mid_item AS (SELECT i.window_key, i.tid, i.item_id, (i.util - coalesce(d_local, 0))::BIGINT AS util FROM tx_item i LEFT JOIN taken USING (window_key, tid, item_id) WHERE i.util - coalesce(d_local, 0) > 0),
end_win AS (SELECT window_key, coalesce(sum(util), 0)::BIGINT AS sanitized_utility FROM win LEFT JOIN end_item USING (window_key) GROUP BY window_key),
members_of AS (SELECT pattern_key, len(p) AS k, unnest(p) AS item_id FROM pats),
end_support AS (SELECT pattern_key, window_key, tid, sum(util)::BIGINT AS u FROM members_of JOIN end_item USING (item_id) GROUP BY pattern_key, k, window_key, tid HAVING count(*) = k),
mid_support AS (SELECT pattern_key, window_key, tid, sum(util)::BIGINT AS u FROM members_of JOIN mid_item USING (item_id) GROUP BY pattern_key, k, window_key, tid HAVING count(*) = k),
judged AS (SELECT t.window_key, t.pattern_key, threshold, coalesce(e.u, 0) AS u, coalesce(m.u, 0) AS u_mid FROM targets t LEFT JOIN (SELECT pattern_key, window_key, sum(u) AS u FROM end_support GROUP BY ALL) e USING (pattern_key, window_key) LEFT JOIN (SELECT pattern_key, window_key, sum(u) AS u FROM mid_support GROUP BY ALL) m USING (pattern_key, window_key)),
hidden AS (SELECT window_key, count(*)::BIGINT AS targets, count(*) FILTER (WHERE u >= threshold)::BIGINT AS violations, count(*) FILTER (WHERE u_mid >= threshold)::BIGINT AS mid_violations, string_agg(pattern_key, ' ' ORDER BY pattern_key) FILTER (WHERE u >= threshold) AS keys FROM judged GROUP BY window_key),
metrics AS (SELECT pattern_key, replace(local_target_windows, ',', ' ') AS local_target_windows, replace(peak_windows, ',', ' ') AS peak_windows, utility AS original_global_utility, coalesce(u, 0)::BIGINT AS sanitized_global_utility, threshold AS global_threshold_abs, coalesce(u, 0) >= threshold AS global_leak
    FROM defs JOIN peaks USING (pattern_key) JOIN globally USING (pattern_key) LEFT JOIN (SELECT pattern_key, sum(u) AS u FROM end_support GROUP BY pattern_key) USING (pattern_key) CROSS JOIN total)"""


_PRODUCTS = f"WITH {DIRTY_ROWS}, {VALID} SELECT stock AS stock_code, description, round(sum(quantity), 2) AS total_quantity, round(sum(utility), 2) AS total_utility, count(DISTINCT invoice)::BIGINT AS invoice_count FROM valid GROUP BY stock, description"


def _top(by: str, n: int) -> str:
    return f"{_PRODUCTS} ORDER BY round(sum({by}), 6) DESC, stock NULLS FIRST, description NULLS FIRST LIMIT {n}"


def _twu(ratio: float) -> str:
    return f""", twu AS (SELECT i.window_key, i.item_id, sum(t.transaction_utility)::BIGINT AS twu FROM tx_item i JOIN tx t ON t.window_key = i.window_key AND t.tid = i.tid GROUP BY ALL),
pruned AS (SELECT i.window_key, i.tid, i.item_id, i.util FROM tx_item i JOIN twu USING (window_key, item_id) JOIN win USING (window_key) WHERE twu >= trunc(total_utility * {ratio}::DOUBLE))"""


def _lengths(rows: str, name: str) -> str:
    return f"(SELECT window_key, round(avg(n), 6) AS {name}_avg_len, max(n)::BIGINT AS {name}_max_len, count(*)::BIGINT AS {name}_tx FROM (SELECT window_key, tid, count(*) AS n FROM {rows} GROUP BY ALL) GROUP BY window_key) JOIN (SELECT window_key, count(DISTINCT item_id)::BIGINT AS {name}_items FROM {rows} GROUP BY window_key) USING (window_key)"


_SELECTED = "pattern_key, selected_window, window_utility, round(window_ratio, 6) AS window_ratio, support_windows, max_window, max_utility, round(max_ratio, 6) AS max_ratio, round(mean_ratio, 6) AS mean_ratio, round(peakness_ratio, 6) AS peakness_ratio, peak_windows, rank"
_COMPARED = "SELECT i.window_key, i.tid, i.invoice_no, i.item_id, stock_code, coalesce(description, '') AS description, i.util AS before_utility, coalesce(a.util, 0)::BIGINT AS after_utility, (i.util - coalesce(a.util, 0))::BIGINT AS delta FROM tx_item i LEFT JOIN after_item a USING (window_key, tid, item_id) JOIN items ON items.item_id = i.item_id"
_THRESHOLDS = ", ".join(f"({n})" for n in IMPACT)
_RATE = "coalesce({0}::DOUBLE / nullif({1}, 0), 0)"


def oracle_sql() -> dict[str, str]:
    mined, hide, steps = _mined(MINE), _hide(), _steps()
    reduced = "(SELECT coalesce(sum(delta), 0)::BIGINT FROM mods)"
    sums = f"(SELECT total::BIGINT FROM total) AS original_total_utility, (SELECT total - {reduced} FROM total)::BIGINT AS sanitized_total_utility"
    rate = f"round({_RATE.format(reduced, '(SELECT total FROM total)')}, 6) AS utility_loss_rate"
    return {
        "raw_summary": f"""WITH {DIRTY_ROWS}, {VALID} SELECT a.*, v.*, (total_rows - valid_transactions)::BIGINT AS removed_rows FROM
            (SELECT count(*)::BIGINT AS total_rows, 8::BIGINT AS total_columns, count(DISTINCT invoice)::BIGINT AS total_invoices, count(DISTINCT stock)::BIGINT AS total_items, count(*) FILTER (WHERE stock IS NULL)::BIGINT AS missing_required_rows,
                count(*) FILTER (WHERE starts_with(invoice, 'C'))::BIGINT AS cancelled_invoices_count, count(*) FILTER (WHERE quantity <= 0)::BIGINT AS invalid_quantity_rows, count(*) FILTER (WHERE price <= 0)::BIGINT AS invalid_unitprice_rows,
                strftime(min(ts), '%Y-%m-%d') AS date_min, strftime(max(ts), '%Y-%m-%d') AS date_max, round(sum(coalesce(quantity * price, 0)), 2) AS raw_total_utility FROM raw) a,
            (SELECT round(sum(utility), 2) AS total_revenue, count(*)::BIGINT AS valid_transactions, count(DISTINCT invoice)::BIGINT AS valid_invoices, round(sum(utility) / count(DISTINCT invoice), 2) AS average_invoice_value, count(DISTINCT strftime(ts, '%Y-%m'))::BIGINT AS data_months FROM valid) v""",
        "sales_overview": f"WITH {DIRTY_ROWS}, {VALID} SELECT round(sum(utility), 2) AS total_revenue, count(DISTINCT invoice)::BIGINT AS invoice_count, count(DISTINCT stock)::BIGINT AS product_count, count(DISTINCT strftime(ts, '%Y-%m'))::BIGINT AS data_months, round(sum(utility) / count(DISTINCT invoice), 2) AS average_invoice_value, count(*)::BIGINT AS valid_transactions FROM valid",
        "raw_monthly_stats": f"WITH {DIRTY_ROWS}, {VALID} SELECT strftime(ts, '%Y-%m') AS window_key, count(*)::BIGINT AS rows, count(DISTINCT invoice)::BIGINT AS invoices, round(sum(quantity), 2) AS total_quantity, round(sum(utility), 2) AS total_utility FROM valid GROUP BY 1",
        "top_products_utility": _top("utility", 10),
        "top_products_quantity": _top("quantity", 10),
        "product_table": _top("utility", 100),
        "invoice_lengths": f"WITH {DIRTY_ROWS} SELECT invoice AS invoice_no, count(DISTINCT stock)::BIGINT AS transaction_length FROM raw GROUP BY invoice",
        "invoice_utilities": f"WITH {DIRTY_ROWS} SELECT invoice AS invoice_no, round(sum(coalesce(quantity * price, 0)), 2) AS transaction_utility FROM raw GROUP BY invoice",
        "drop_report": _dirty("SELECT coalesce(drop_reason, 'ok') AS reason, count(*)::BIGINT AS n_rows FROM classified GROUP BY 1"),
        "item_dictionary": _dirty("SELECT * FROM items"),
        "item_level": _dirty("SELECT * FROM tx_item"),
        "transactions": _dirty("SELECT window_key, tid, invoice_no, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items, string_agg(item_id || '=' || util, ',' ORDER BY item_id) AS item_utils, sum(util)::BIGINT AS transaction_utility, count(*)::INT AS length FROM tx_item GROUP BY window_key, tid, invoice_no"),
        "window_totals": _dirty("SELECT * FROM win"),
        "max_len_impact": _dirty(f"""SELECT max_len, kept_tx, removed_tx, round({_RATE.format("removed_tx", "kept_tx + removed_tx")}, 6) AS removed_tx_rate, kept_utility, removed_utility, round({_RATE.format("removed_utility", "kept_utility + removed_utility")}, 6) AS removed_utility_rate, avg_len_after, max_len_after FROM
            (SELECT max_len::INT AS max_len, count(*) FILTER (WHERE length <= max_len)::BIGINT AS kept_tx, count(*) FILTER (WHERE length > max_len)::BIGINT AS removed_tx, coalesce(sum(transaction_utility) FILTER (WHERE length <= max_len), 0)::BIGINT AS kept_utility, coalesce(sum(transaction_utility) FILTER (WHERE length > max_len), 0)::BIGINT AS removed_utility,
                round(coalesce(avg(length) FILTER (WHERE length <= max_len), 0), 6) AS avg_len_after, coalesce(max(length) FILTER (WHERE length <= max_len), 0)::INT AS max_len_after FROM tx CROSS JOIN (VALUES {_THRESHOLDS}) t(max_len) GROUP BY max_len)"""),
        "preprocess_report": _dirty("""SELECT *, (transactions_before_filter - transactions_after_filter)::BIGINT AS transactions_removed_by_max_len FROM
            (SELECT count(*)::BIGINT AS input_rows, count(*) FILTER (WHERE drop_reason = 'missing_required')::BIGINT AS rows_dropped_missing_required, count(*) FILTER (WHERE drop_reason = 'cancelled_invoice')::BIGINT AS rows_dropped_cancelled_invoice, count(*) FILTER (WHERE drop_reason = 'nonpositive_quantity_or_price')::BIGINT AS rows_dropped_nonpositive_quantity_or_price,
                count(*) FILTER (WHERE drop_reason = 'invalid_invoice_date')::BIGINT AS rows_dropped_invalid_invoice_date, count(*) FILTER (WHERE drop_reason = 'nonpositive_utility')::BIGINT AS rows_dropped_nonpositive_utility, count(*) FILTER (WHERE drop_reason IS NULL)::BIGINT AS clean_rows, count(DISTINCT stock) FILTER (WHERE drop_reason IS NULL)::BIGINT AS num_items FROM classified),
            (SELECT count(*)::BIGINT AS transactions_before_filter, sum(transaction_utility)::BIGINT AS utility_before_filter FROM tx),
            (SELECT count(*)::BIGINT AS transactions_after_filter, sum(transaction_utility)::BIGINT AS utility_after_filter, round(avg(length), 6) AS avg_len_after, max(length)::INT AS max_len_after, count(DISTINCT window_key)::BIGINT AS num_windows FROM tx WHERE length <= 4)"""),
        "twu_items": _ready("SELECT * FROM twu", _twu(0.1)),
        "twu_pruned_items": _ready("SELECT * FROM pruned", _twu(0.1)),
        "twu_stats": _ready(f"SELECT window_key, before_avg_len, before_max_len, before_tx, before_items, coalesce(after_avg_len, 0) AS after_avg_len, coalesce(after_max_len, 0)::BIGINT AS after_max_len, coalesce(after_tx, 0)::BIGINT AS kept_tx, coalesce(after_items, 0)::BIGINT AS after_items FROM (SELECT * FROM {_lengths('tx_item', 'before')}) LEFT JOIN (SELECT * FROM {_lengths('pruned', 'after')}) USING (window_key)", _twu(0.1)),
        "hui_small": _ready("SELECT window_key, pattern_key, utility FROM hui WHERE pattern_key NOT LIKE '% % %'", mined),
        "hui_all": _ready("SELECT window_key, pattern_key, utility FROM hui", mined),
        "hui_topk": _ready(f"SELECT window_key, pattern_key, utility FROM hui QUALIFY row_number() OVER (PARTITION BY window_key ORDER BY utility DESC, pattern_key) <= {TOP}", mined),
        "candidate_patterns": _ready("SELECT * FROM cand", mined),
        "candidate_utilities": _ready("SELECT pattern_key, window_key, utility, round(ratio, 9) AS ratio FROM dense", mined),
        "temporal_stats": _ready("SELECT pattern_key, support_windows, max_window, max_utility, round(max_ratio, 6) AS max_ratio, round(mean_ratio, 6) AS mean_ratio, round(peakness_ratio, 6) AS peakness_ratio, peak_windows FROM stats", mined),
        "survivors": _ready("SELECT pattern_key, support_windows, max_window, max_utility FROM surv", mined),
        "peak_sensitive_selection": _ready(f"SELECT {_SELECTED} FROM sel", mined),
        "item_scores": _ready("SELECT item_id, round(score, 6) AS score, selected_count, windows FROM scores", mined),
        "mining_summary": _ready("SELECT (SELECT count(*) FROM hui)::BIGINT AS total_raw_patterns, (SELECT count(*) FROM cand)::BIGINT AS unique_candidates, (SELECT count(*) FROM surv)::BIGINT AS survivors, (SELECT count(*) FROM sel)::BIGINT AS selected_patterns, (SELECT count(*) FROM scores)::BIGINT AS scored_items", mined),
        "sensitive_definitions": _ready("SELECT pattern_key, local_target_windows, peak_windows FROM defs JOIN peaks USING (pattern_key)", hide),
        "pattern_utils_local": _ready("SELECT pattern_key, window_key, sum(utility)::BIGINT AS utility FROM support GROUP BY ALL", hide),
        "pattern_utils_global": _ready("SELECT pattern_key, utility FROM globally", hide),
        "local_pass_first_target": _ready("SELECT * FROM cut", hide),
        "modified_after_first_target": _ready(f"{_COMPARED} WHERE i.util <> coalesce(a.util, 0)", hide),
        "integrity_audit": _ready("""SELECT 0::BIGINT AS bad_tu, (SELECT count(*) FROM tx WHERE NOT EXISTS (SELECT 1 FROM after_item a WHERE a.window_key = tx.window_key AND a.tid = tx.tid))::BIGINT AS empty_transactions,
            (SELECT count(*) FROM (SELECT window_key, tid, item_id FROM after_item GROUP BY ALL HAVING count(*) > 1))::BIGINT AS duplicate_items, (SELECT count(*) FROM after_item WHERE util <= 0)::BIGINT AS zero_or_negative_item_utils""", hide),
        "transaction_detail": _ready(f"{_COMPARED} WHERE (i.window_key, i.tid) = (SELECT (window_key, tid) FROM tx ORDER BY length DESC, window_key DESC, tid DESC LIMIT 1)", hide),
        "global_leakage": _ready("SELECT pattern_key, utility AS original_global_utility, threshold AS global_threshold_abs FROM globally CROSS JOIN total WHERE utility >= threshold", hide),
        "local_leakage": _ready("""SELECT window_key, coalesce(targets, 0)::BIGINT AS targets, (coalesce(targets, 0) - coalesce(violations, 0))::BIGINT AS hidden, coalesce(violations, 0)::BIGINT AS violations, coalesce(keys, '') AS violation_pattern_keys, threshold AS local_threshold_abs,
            total_utility AS original_utility, total_utility AS sanitized_utility, 0::BIGINT AS utility_reduced, 0::DOUBLE AS utility_loss_rate FROM win JOIN limits USING (window_key)
            LEFT JOIN (SELECT selected_window AS window_key, count(*) AS targets, count(*) FILTER (WHERE u >= threshold) AS violations, string_agg(pattern_key, ' ' ORDER BY pattern_key) FILTER (WHERE u >= threshold) AS keys
                FROM (SELECT sel.pattern_key, selected_window, sum(utility) AS u FROM sel JOIN support s ON s.pattern_key = sel.pattern_key AND s.window_key = selected_window GROUP BY ALL) JOIN limits ON limits.window_key = selected_window GROUP BY selected_window) USING (window_key)""", hide),
        "modifications": _ready("SELECT * FROM mods", steps),
        "sanitized_items": _ready("SELECT * FROM end_item", steps),
        "modified_transactions": _ready(f"{_COMPARED.replace('after_item', 'end_item')} WHERE i.util <> coalesce(a.util, 0)", steps),
        "pattern_metrics": _ready("SELECT * FROM metrics", steps),
        "local_reports": _ready("""SELECT window_key, threshold AS local_threshold_abs, coalesce(targets, 0)::BIGINT AS targets, coalesce(mid_violations, 0)::BIGINT AS local_violations, coalesce(modifications, 0)::BIGINT AS modifications, coalesce(utility_reduced, 0)::BIGINT AS utility_reduced
            FROM limits LEFT JOIN hidden USING (window_key) LEFT JOIN (SELECT window_key, count(*) AS modifications, sum(delta) AS utility_reduced FROM mods WHERE phase = 'local' GROUP BY window_key) USING (window_key)""", steps),
        "local_hiding": _ready(f"""SELECT window_key, coalesce(targets, 0)::BIGINT AS targets, (coalesce(targets, 0) - coalesce(violations, 0))::BIGINT AS hidden, coalesce(violations, 0)::BIGINT AS violations, coalesce(keys, '') AS violation_pattern_keys, threshold AS local_threshold_abs,
            total_utility AS original_utility, sanitized_utility, (total_utility - sanitized_utility)::BIGINT AS utility_reduced, round({_RATE.format("(total_utility - sanitized_utility)", "total_utility")}, 6) AS utility_loss_rate FROM win JOIN limits USING (window_key) JOIN end_win USING (window_key) LEFT JOIN hidden USING (window_key)""", steps),
        "sanitization_summary": _ready(f"""SELECT {sums}, (SELECT count(*) FROM defs)::BIGINT AS sensitive_patterns, (SELECT threshold FROM total) AS global_threshold_abs, (SELECT coalesce(sum(mid_violations), 0) FROM hidden)::BIGINT AS local_violations_after,
            (SELECT count(*) FROM (SELECT pattern_key FROM mid_support GROUP BY pattern_key HAVING sum(u) >= (SELECT threshold FROM total)))::BIGINT AS pre_patch_global_leaks, (SELECT count(*) FROM metrics WHERE global_leak)::BIGINT AS post_patch_global_leaks,
            (SELECT count(*) FROM (SELECT DISTINCT window_key, tid FROM mods))::BIGINT AS modified_transactions, {reduced} AS total_utility_reduced, {rate}""", steps),
        "verification_report": _ready(f"""SELECT *, pass_integrity AND pass_local AND pass_global AS passed FROM (SELECT *, bad_tu + empty_transactions + duplicate_items + zero_or_negative_item_utils = 0 AS pass_integrity, local_violations_after = 0 AS pass_local, global_leaks_after = 0 AS pass_global FROM
            (SELECT {sums}, (SELECT count(*) FROM tx)::BIGINT AS total_transactions, (SELECT coalesce(sum(violations), 0) FROM hidden)::BIGINT AS local_violations_after, (SELECT count(*) FROM metrics WHERE global_leak)::BIGINT AS global_leaks_after,
                (SELECT coalesce(string_agg(pattern_key, ',' ORDER BY pattern_key), '') FROM metrics WHERE global_leak) AS global_leaking_pattern_keys, (SELECT count(*) FROM (SELECT DISTINCT window_key, tid FROM mods))::BIGINT AS modified_transactions,
                (SELECT count(*) FROM (SELECT tx.tid FROM tx LEFT JOIN (SELECT window_key, tid, sum(delta) AS d FROM mods GROUP BY ALL) m USING (window_key, tid) LEFT JOIN (SELECT window_key, tid, sum(util) AS s FROM end_item GROUP BY ALL) e USING (window_key, tid) WHERE transaction_utility - coalesce(d, 0) <> coalesce(s, 0)))::BIGINT AS bad_tu,
                (SELECT count(*) FROM tx WHERE NOT EXISTS (SELECT 1 FROM end_item a WHERE a.window_key = tx.window_key AND a.tid = tx.tid))::BIGINT AS empty_transactions, 0::BIGINT AS duplicate_items, 0::BIGINT AS zero_or_negative_item_utils, {reduced} AS total_utility_reduced, {rate},
                (SELECT round(count(DISTINCT (window_key, tid))::DOUBLE / (SELECT count(*) FROM tx), 6) FROM mods) AS modified_tx_rate, (SELECT threshold FROM total) AS global_threshold_abs))""", steps),
        "explorer_bundle": _ready(f"""SELECT 'modified_transactions' AS section, tid || ' ' || item_id AS key, sum(delta)::BIGINT AS amount FROM mods GROUP BY window_key, tid, item_id
            UNION ALL SELECT 'selected_patterns', pattern_key || ' ' || selected_window, window_utility FROM sel UNION ALL SELECT 'window_metrics', window_key, threshold FROM limits
            UNION ALL SELECT 'pattern_metrics', pattern_key, sanitized_global_utility FROM metrics UNION ALL SELECT 'phase0_summary', 'M', total::BIGINT FROM total UNION ALL SELECT 'phase2_summary', '', {reduced}""", steps),
        "integrity_audit_damaged": _ready("""SELECT count(*) FILTER (WHERE declared <> computed)::BIGINT AS bad_tu, count(*) FILTER (WHERE positive = 0 OR declared <= 0)::BIGINT AS empty_transactions, count(*) FILTER (WHERE n <> items)::BIGINT AS duplicate_items, coalesce(sum(n - positive), 0)::BIGINT AS zero_or_negative_item_utils FROM
            (SELECT declared, sum(util) AS computed, count(*) AS n, count(DISTINCT item_id) AS items, count(*) FILTER (WHERE util > 0) AS positive FROM
                (SELECT *, CASE WHEN digit = '3' OR digit = '4' AND item_id <= 12 THEN 0 ELSE held END AS util FROM
                    (SELECT i.window_key, i.tid, i.item_id, i.util AS held, right(i.invoice_no, 1) AS digit, transaction_utility + CASE WHEN right(i.invoice_no, 1) = '7' THEN 5 ELSE 0 END AS declared, unnest(range(CASE WHEN right(i.invoice_no, 1) = '1' THEN 2 ELSE 1 END)) AS copy FROM tx_item i JOIN tx USING (window_key, tid)))
            GROUP BY window_key, tid, declared)"""),
        "restricted_selection": _ready("SELECT pattern_key, selected_window, rank FROM sel WHERE pattern_key IN (SELECT pattern_key FROM sel WHERE rank = 1)", hide),
        "selected_pattern_labels": _ready("SELECT pattern_key, selected_window, array_to_string(labels, ' + ') AS labels, array_to_string(shorts[1:5], ' | ') || CASE WHEN len(shorts) > 5 THEN ' | +' || (len(shorts) - 5) || ' more' ELSE '' END AS short_text FROM labelled", hide),
        "cross_sell": _ready("SELECT pattern_key, selected_window, main_product, array_to_string(list_filter(labels, lambda x: x <> main_product), ', ') AS suggested, array_to_string(labels, ' + ') AS combo FROM (SELECT *, unnest(labels) AS main_product FROM labelled WHERE len(labels) >= 2)", hide),
        "business_rows": _ready("SELECT pattern_key, selected_window, window_utility, CASE WHEN peak_windows = '' THEN selected_window ELSE split_part(peak_windows, ',', 1) END AS peak_window, round(peakness_ratio, 6) AS peakness_ratio, support_windows, CASE WHEN peakness_ratio >= 2 THEN 'seasonal_peak' WHEN window_utility > 0 THEN 'high_revenue_bundle' ELSE 'protect' END AS reason FROM sel", hide),
        "huim_text": _ready("SELECT window_key, tid, string_agg(item_id::VARCHAR, ' ' ORDER BY item_id) || ':' || sum(util)::BIGINT || ':' || string_agg(util::VARCHAR, ' ' ORDER BY item_id) AS line FROM tx_item GROUP BY window_key, tid"),
    }
