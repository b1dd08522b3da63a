"""Readers and writers on files made by hand."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import explore, prepare, temporal, verify
from tidemark.plans import run
from tidemark.schema import Params
from tidemark.sources import artifacts
from tidemark.sources.csv_source import load_csv
from tidemark.sources.huim_text import parse_patterns, read_patterns, transaction_lines, write_transactions
from tidemark.sources.run_store import RunStore
from tidemark.sources.synthetic import synthetic_retail

HEAD = "InvoiceNo, StockCode ,Quantity,UnitPrice,InvoiceDate,Description"


def test_csv_comma_bom_and_nulls(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes(("﻿" + HEAD + "\n1,a,2,2.5,05/01/2011 08:30,NA\n").encode())
    row = load_csv(spark, str(path)).first()
    assert (row.InvoiceNo, row.StockCode, row.Description) == ("1", "a", None)


def test_csv_semicolon_decimal_comma_latin1(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_bytes((HEAD.replace(",", ";") + "\n1;a;2;2,55;05/01/2011 08:30;café\n").encode("latin-1"))
    row = load_csv(spark, str(path)).first()
    assert (row.UnitPrice, row.Description) == ("2.55", "café")


def test_csv_that_cannot_be_read(spark, tmp_path):
    with pytest.raises(ValueError):
        load_csv(spark, str(tmp_path / "absent.csv"))


def test_patterns(spark, tmp_path):
    lines = spark.createDataFrame([("1 5 #UTIL: 30",), ("1\t5:30",), ("10 2:7.0",), ("nothing",), ("x y:3",)], "value string")
    got = {(r.pattern_key, r.utility) for r in parse_patterns(lines).collect()}
    assert got == {("1 5", 30), ("2 10", 7)}
    lines.coalesce(1).write.text(str(tmp_path / "p"))
    assert read_patterns(spark, str(tmp_path / "p")).count() == 2


def test_transaction_lines_keep_emptied_ones_only_with_headers(spark, tmp_path):
    facts = spark.createDataFrame([("2011-01", "a", "a", 2, 7), ("2011-01", "a", "a", 10, 3)], "window_key string, tid string, invoice_no string, item_id int, util long")
    tx = spark.createDataFrame([("2011-01", "a"), ("2011-01", "b")], "window_key string, tid string")
    assert [r.line for r in transaction_lines(facts).collect()] == ["2 10:10:7 3"]
    assert {r.line for r in transaction_lines(facts, tx).collect()} == {"2 10:10:7 3", ":0:"}
    write_transactions(facts, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 1


def test_run_store(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"))
    run_id = store.create("demo")
    store.save(run_id, "tx", spark.createDataFrame([(1, [1, 2])], "a int, b array<int>"))
    store.export(run_id, "tx", "csv")
    assert store.load(run_id, "tx").count() == 1 and store.optional(run_id, "items", "a int").isEmpty()
    assert store.status(run_id)["tx"] and not store.status(run_id)["report"]
    assert store.runs().first().source == "demo"
    with pytest.raises(ValueError):
        store.path("../x")


def test_synthetic_run_end_to_end(spark):
    raw = synthetic_retail(spark, 400, months=3)
    assert raw.count() == 400 and raw.exceptAll(synthetic_retail(spark, 400, months=3).repartition(3)).isEmpty()
    params = Params(candidate_mining_ratio=0.08, sensitive_ratio=0.08, min_peakness_ratio=1.0, local_ratio=0.08, global_ratio=0.08)
    data = run.prepared(raw, params)
    found = run.mined(data, params)
    hidden = run.sanitized(data, found, params)
    report = run.verified(data, found, hidden, params).first()
    assert report.pass_local and report.pass_global and report.total_utility_reduced > 0
    assert hidden.modifications.agg(F.sum("delta")).first()[0] == report.total_utility_reduced
    labels = explore.pattern_labels(found.selected, data.items).first().labels
    assert all(x.startswith("ItemID ") for x in labels)
    assert prepare.nested(data.tx_item).first().length >= 1


def test_mapping_spellings(spark):
    rows = [("1", '{"StockCode": "a", "Description": "A"}'), ("b", "2"), ("3", "c"), ("d", '{"item_id": 4}'), ("x", "y")]
    got = {(r.item_id, r.stock_code, r.description) for r in explore.normalise_mapping(spark.createDataFrame(rows, "key string, value string")).collect()}
    assert got == {(1, "a", "A"), (2, "b", ""), (3, "c", ""), (4, "d", "")}


def test_first_pattern_line_counts(spark):
    lines = spark.createDataFrame([("1 2 #UTIL: 5",), ("2 1 #UTIL: 9",), ("3: -2.5 more",), ("4:1.5e2",), ("5:1e",), ("6 #UTIL: x",)], "value string").coalesce(1)
    assert {(r.pattern_key, r.utility) for r in parse_patterns(lines).collect()} == {("1 2", 5), ("3", -2), ("4", 150)}


def test_artifacts_come_back(spark, tmp_path):
    params = Params(candidate_mining_ratio=0.08, sensitive_ratio=0.08, min_peakness_ratio=1.0, local_ratio=0.08, global_ratio=0.08, max_transaction_len=3)
    data = run.prepared(synthetic_retail(spark, 300, months=2), params)
    found = run.mined(data, params)
    hidden = run.sanitized(data, found, params)
    base = str(tmp_path / "run")
    assert artifacts.imported(spark, base)["found"] == [] and artifacts.optional(spark, base, "item_mapping.json", "item_id int").isEmpty()
    artifacts.write_prepared(data, f"{base}/below")
    artifacts.write_mined(data, found, base, params)
    artifacts.write_sanitized(data, hidden, base, params)
    artifacts.write_verified(data, hidden, base, params)
    assert artifacts.imported(spark, base) == {"found": sorted(artifacts.PREPARED + artifacts.MINED + artifacts.SANITIZED + artifacts.VERIFIED), "missing": [], "warnings": []}
    same = lambda a, b: a.exceptAll(b.select(*a.columns)).isEmpty() and b.select(*a.columns).exceptAll(a).isEmpty()
    for name, want in (("temporal_db.json", (data.tx_item, data.tx)), ("phase2_sanitized_db.json", (hidden.tx_item, hidden.tx))):
        got = artifacts.read_database(spark, base, name)
        assert same(got[0], want[0].select(*got[0].columns)) and same(got[1], want[1].select(*got[1].columns))
    assert artifacts.find(spark, base, "tx_before_filter.csv").count() == data.tx_before.count() > data.tx.count() == artifacts.find(spark, base, "tx_after_filter.csv").count()
    assert artifacts.find(spark, base, "sanitized_retail.txt").count() == hidden.tx.count()
    scores = [r.score for r in artifacts.ordered_scores(found.scores).collect()]
    assert scores == sorted(scores, reverse=True)
    windows = artifacts.mining_windows(data, found, params)
    assert windows.agg(F.sum("patterns")).first()[0] == found.patterns.count()


def test_database_under_another_name_and_without_totals(spark, tmp_path):
    (tmp_path / "temporal_db_original.json").mkdir()
    (tmp_path / "temporal_db_original.json" / "part.json").write_text('{"window_key": "2011-01", "tid": "a", "invoice_no": "a", "items": [1, 2], "item_utils": {"1": 3, "2": 4}}\n')
    tx_item, tx = artifacts.read_database(spark, str(tmp_path))
    assert tx.first().transaction_utility == 7 and {(r.item_id, r.util) for r in tx_item.collect()} == {(1, 3), (2, 4)}
    assert artifacts.imported(spark, str(tmp_path))["warnings"] == ["temporal_db.json: no column transaction_utility"]


def test_artifacts_at_any_depth(spark, tmp_path):
    for depth, value in (("a/b/c/d/e", 1), ("a/z", 2)):
        (tmp_path / depth / "phase2_summary.json").mkdir(parents=True)
        (tmp_path / depth / "phase2_summary.json" / "part.json").write_text(f'{{"total_utility_reduced": {value}}}\n')
    read = lambda base: artifacts.optional(spark, str(base), "phase2_summary.json", "total_utility_reduced long").collect()
    assert read(tmp_path)[0][0] == 2 and read(tmp_path / "a/b")[0][0] == 1
    assert read(tmp_path / "a/z/phase2_summary.json") == [] and read(tmp_path / "absent") == []
    assert artifacts.find(spark, str(tmp_path), "item_mapping.json") is None


def test_a_database_that_is_one_document(spark, tmp_path):
    text = '{\n "metadata": {"num_items": 2},\n "windows": {"2011-01": {"window_key": "2011-01",\n "transactions": [{"tid": "a", "invoice_no": "i", "items": [1, 2], "item_utils": {"1": 3, "2": 4}, "tu": 7},\n {"tid": "b", "items": [], "item_utils": {}}]}}}'
    (tmp_path / "temporal_db.json").write_text(text)
    tx_item, tx = artifacts.read_database(spark, str(tmp_path))
    assert {(r.window_key, r.tid, r.item_id, r.util) for r in tx_item.collect()} == {("2011-01", "a", 1, 3), ("2011-01", "a", 2, 4)}
    assert {(r.tid, r.transaction_utility) for r in tx.collect()} == {("a", 7), ("b", 0)}
    assert artifacts.imported(spark, str(tmp_path))["warnings"] == []


def test_import_of_archives(spark, tmp_path):
    import zipfile

    source = tmp_path / "in"
    (source / "deep").mkdir(parents=True)
    with zipfile.ZipFile(source / "results.zip", "w") as z:
        z.writestr("run/phase2_summary.json", '{"total_utility_reduced": 5}\n')
        z.writestr("run/01_static_efim_hui.csv", "a,b\r\n1,é\r\n\r\n2,y\n")
        z.writestr("../../etc/item_mapping.json", "{}")
        z.writestr("/abs/item_mapping.json", "{}")
        z.writestr("x/..\\item_mapping.json", "{}")
        z.writestr("run/tool.exe", "no")
        z.writestr("run/inner.zip", "no")
        z.writestr("run/huge.txt", "0" * 5000)
        z.writestr("run/comparison_report.xlsx", b"PK\x00raw")
    (source / "deep" / "phase2_summary.json").write_text('{"total_utility_reduced": 9}\n')
    (source / "broken.zip").write_bytes(b"PK\x03\x04 nothing")
    got = artifacts_import(spark, source, tmp_path / "out", 4000)
    want = {
        ("deep/phase2_summary.json", "stored", True), ("run/phase2_summary.json", "shadowed", True), ("run/01_static_efim_hui.csv", "stored", True), ("../../etc/item_mapping.json", "refused", False), ("/abs/item_mapping.json", "refused", False),
        ("x/..\\item_mapping.json", "refused", False), ("run/tool.exe", "ignored", False), ("run/inner.zip", "ignored", False), ("run/huge.txt", "too large", False), ("run/comparison_report.xlsx", "stored", True), ("broken.zip", "unreadable: BadZipFile", False),
    }
    assert {(("deep/" if "/deep/" in r.source else "") + r.member, r.status, r.recognised) for r in got} == want
    out = str(tmp_path / "out")
    assert artifacts.find(spark, out, "phase2_summary.json").first()[0] == 9
    assert [tuple(r) for r in artifacts.find(spark, out, "01_static_efim_hui.csv").collect()] == [("1", "é"), ("2", "y")]
    assert bytes(spark.read.parquet(f"{out}/kept_files").first().content) == b"PK\x00raw"
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["01_static_efim_hui.csv", "kept_files", "phase2_summary.json"]
    assert not (tmp_path / "etc").exists()
    sections = {r.section for r in artifacts.explorer_bundle(spark, out).collect()}
    assert sections == {"phase2_summary", "01_static_efim_hui.csv"}
    (tmp_path / "none").mkdir()
    assert artifacts_import(spark, tmp_path / "none", tmp_path / "out2", 10) == []


def artifacts_import(spark, source, base, most):
    from tidemark.sources.results_import import import_results

    return import_results(spark, str(source), str(base), most).collect()


def test_csv_bytes_are_decoded_strictly(spark, tmp_path):
    rows = lambda name, data: (tmp_path / name).write_bytes(data) and load_csv(spark, str(tmp_path / name)).collect()
    head = HEAD.encode() + b"\n"
    assert rows("mark.csv", head + "1,a,2,2.5,05/01/2011,caf\ufffd\n".encode())[0].Description == "caf\ufffd"
    assert rows("latin.csv", head + b"1,a,2,2.5,05/01/2011,caf\xe9\n2,b,2,2.5,05/01/2011,x\n")[0].Description == "café"
    got = rows("escaped.csv", head + b"1,a,2,2.5,05/01/2011,caf\\xe9 \xe9 \\u6f22\n2,b,2,2.5,05/01/2011,\"x, y\"\n")
    assert [(r.InvoiceNo, r.StockCode, r.Description) for r in got] == [("1", "a", "café é 漢"), ("2", "b", "x, y")]
    assert rows("malformed.csv", head + b"1,a,2,2.5,05/01/2011,caf\xe9 \\x\n")[0].Description == "café \\x"
    assert rows("quoted.csv", head + b'1,a,2,2.5,05/01/2011,"two\nlines"\n')[0].Description == "two\nlines"
    with pytest.raises(ValueError):
        rows("none.csv", b"a\tb\n1\t2\n") and load_csv(spark, str(tmp_path / "absent"))


def test_shares_of_invented_rows(spark):
    n = 200_000
    raw = synthetic_retail(spark, n, months=6)
    assert raw.count() == n and raw.select("row_id").distinct().count() == n
    shares = {r.Country: r.n / n for r in raw.groupBy("Country").agg(F.count("*").alias("n")).collect()}
    for country, share in (("United Kingdom", 0.82), ("France", 0.06), ("Germany", 0.05), ("Netherlands", 0.04), ("EIRE", 0.03)):
        assert abs(shares[country] - share) < 0.01
    assert abs(raw.filter("Description is null").count() / n - 0.01) < 0.005
    invoices = raw.groupBy("InvoiceNo").agg(F.collect_set("StockCode").alias("x"), F.first(F.substring("InvoiceDate", 4, 2)).alias("m"))
    late = invoices.groupBy("m").agg(F.avg(F.array_contains("x", "SYN1020").cast("int") * F.array_contains("x", "SYN1021").cast("int")).alias("share"))
    got = {r.m: r.share for r in late.collect()}
    assert abs(got["05"] - 0.24) < 0.02 and all(abs(got[m] - 0.04) < 0.02 for m in got if m != "05")
    assert abs(invoices.filter("InvoiceNo like 'C%'").count() / invoices.count() - 0.015) < 0.005
    with pytest.raises(ValueError):
        synthetic_retail(spark, 49)


@pytest.mark.parametrize("kind", ["json", "csv"])
def test_download_is_one_file_with_one_header(spark, tmp_path, kind):
    store = RunStore(spark, str(tmp_path / "runs"))
    run_id = store.create("x.csv")
    rows = spark.range(1000).select("id", F.concat(F.lit('a "b", ü '), F.col("id")).alias("name, quoted"), F.array("id").alias("list"))
    store.save(run_id, "patterns", rows.repartitionByRange(7, "id"))
    store.save(run_id, "items", rows.limit(0))
    pieces = list(store.download(run_id, "patterns", kind, chunk=50))
    assert max(map(len, pieces)) <= 50
    shown = rows.withColumn("list", F.to_json("list")) if kind == "csv" else rows
    getattr(shown.orderBy("id").coalesce(1).write.option("header", True), kind)(str(tmp_path / "one"))
    (single,) = [p for p in (tmp_path / "one").iterdir() if p.name.startswith("part-")]
    lines = lambda data: [data.split(b"\n")[0], *sorted(data.split(b"\n")[1:])]
    assert sorted(b"".join(pieces).split(b"\n")) == sorted(single.read_bytes().split(b"\n"))
    if kind == "csv":
        assert lines(b"".join(pieces)) == lines(single.read_bytes())
        assert b"".join(store.download(run_id, "items", kind)) == single.read_bytes().split(b"\n")[0] + b"\n"
    else:
        assert b"".join(store.download(run_id, "items", kind)) == b""


def test_chosen_patterns_restrict_the_selection(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"))
    run_id = store.create("x.csv")
    selected = spark.createDataFrame([("1 2", "2020-01"), ("3", "2020-01"), ("1 2", "2020-02"), ("4", "2020-02")], "pattern_key string, selected_window string")
    keys = lambda df: sorted(r.pattern_key for r in df.collect())
    assert keys(temporal.restrict(selected, store.chosen(run_id))) == keys(selected) == keys(temporal.restrict(selected, []))
    store.choose(run_id, ["1 2", "9", "1 2"])
    assert keys(temporal.restrict(selected, store.chosen(run_id))) == ["1 2", "1 2"] == keys(temporal.restrict(selected, ["1 2", "9"]))
    store.choose(run_id, ["4"])
    assert keys(temporal.restrict(selected, store.chosen(run_id))) == ["4"]
    store.choose(run_id, [])
    assert keys(temporal.restrict(selected, store.chosen(run_id))) == keys(selected)


def test_transactions_of_one_database_only_can_be_passed_over(spark):
    facts = lambda rows: spark.createDataFrame(rows, "window_key string, tid string, item_id int, util long")
    heads = lambda rows: spark.createDataFrame(rows, "window_key string, tid string, invoice_no string")
    items = spark.createDataFrame([(1, "A", None)], "item_id int, stock_code string, description string")
    before = facts([("m", "m_1", 1, 9), ("m", "m_1", 2, 4), ("m", "m_3", 1, 2)]), heads([("m", "m_1", "1"), ("m", "m_3", "3")])
    after = facts([("m", "m_1", 1, 5), ("m", "m_1", 2, 4), ("m", "m_2", 1, 7)]), heads([("m", "m_1", "1"), ("m", "m_2", "2")])
    rows = lambda **k: sorted((r.tid, r.item_id, r.before_utility, r.after_utility, r.delta) for r in verify.compare(*before, *after, items, **k).collect())
    assert rows() == [("m_1", 1, 9, 5, 4), ("m_2", 1, 0, 7, -7), ("m_3", 1, 2, 0, 2)]
    assert rows(shared_only=True) == [("m_1", 1, 9, 5, 4)]


def test_dates_are_parsed_by_their_marks(spark):
    texts = ["1/2/2020 3:04:05", " 01/02/2020 3:04 ", "1/2/2020", "2020-02-01 03:04:05", "2020-02-01 03:04", "2020-02-01", "31/02/2020", "13/13/2020 1:00", "2020-02-01 3", "bad", "", ":", "1/2/2020 3:04:05:06", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    tried = F.coalesce(*[F.try_to_timestamp(F.trim("t"), F.lit(f)) for f in scalars.DATE_FORMATS])
    got = df.select("i", scalars.timestamp(df, "t").alias("got"), tried.alias("want")).orderBy("i").collect()
    assert [r.got for r in got] == [r.want for r in got] and sum(r.got is not None for r in got) == 6
    assert df.select(scalars.timestamp(df, "t", ("yyyy/M/d", "d/M/yyyy")).alias("x")).filter("x is not null").count() == 1
