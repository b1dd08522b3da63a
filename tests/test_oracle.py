"""Every query against its SQL on the smallest tables (the mining ones on the middle ones, where fewer patterns are mined)."""

import glob
import os

import duckdb
import pytest

from tidemark import oracle, queries

ROOT = "/root/testdata"
SQL = oracle.oracle_sql()
FAST = [n for n in ("raw_summary", "sales_overview", "raw_monthly_stats", "top_products_utility", "product_table", "invoice_utilities", "drop_report", "item_dictionary", "transactions", "window_totals", "max_len_impact", "preprocess_report", "twu_items", "twu_stats", "huim_text") if n in SQL]
MINED = ["hui_all", "temporal_stats", "peak_sensitive_selection", "item_scores", "local_pass_first_target", "transaction_detail", "cross_sell", "modifications", "integrity_audit_damaged", "restricted_selection"]


def rows(frame):
    columns = sorted(frame.columns)
    clean = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(tuple(str(round(x, 5)) if isinstance(x, float) else str(x) for x in r) for r in clean.itertuples(index=False))


def same(spark, name, folder):
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert rows(queries.queries()[name](spark, folder).toPandas()) == rows(con.execute(SQL[name]).df())


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, name):
    same(spark, name, f"{ROOT}/sf0.001")


@pytest.mark.parametrize("name", MINED)
def test_mining_against_sql(spark, name):
    same(spark, name, f"{ROOT}/sf0.01")
