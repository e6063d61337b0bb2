"""The library's plans, operators, readers and streams."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quartermill.functions import fuzzy, text
from quartermill.functions.categories import fund_label
from quartermill.operators import promote, relational
from quartermill.plans import registry
from quartermill.sources import canonical, filings
from quartermill.streaming import daily

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(registry.queries())


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return str(v)[:10] if hasattr(v, "year") else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_plan_matches_its_statement(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    rows = [tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()]
    sql = registry.statements().get(name)
    if sql is None:
        assert rows is not None
        return
    want = duck.sql(sql).df()
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(rows) == sorted(tuple(plain(v) for v in r) for r in want[sorted(want.columns)].astype(object).itertuples(index=False))


def test_as_of_takes_the_last_value_before(spark):
    d = dt.date
    left = spark.createDataFrame([("A", d(2001, 3, 31)), ("A", d(2000, 1, 1)), ("B", d(2001, 3, 31)), (None, d(2001, 3, 31)), ("A", None)], "k string, at date")
    right = spark.createDataFrame([("A", d(2001, 3, 31), 3), ("A", d(2001, 1, 1), 1), ("A", d(2001, 4, 1), 4), (None, d(2000, 1, 1), 9)], "k string, day date, v int")
    got = {(r.k, r.at): r.found for r in relational.as_of(left, right, "k", "at", "day", "v", "found").collect()}
    assert got == {("A", d(2001, 3, 31)): 3, ("A", d(2000, 1, 1)): None, ("B", d(2001, 3, 31)): None, (None, d(2001, 3, 31)): None, ("A", None): None}


def test_climb_ends_on_cycles_and_takes_the_farthest(spark):
    entities = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 6)], "entity_id bigint")
    day = dt.date(9999, 12, 31)
    edges = [(2, 1, "control", day), (3, 2, "mutual", day), (5, 4, "control", day), (4, 5, "control", day), (6, 1, "advisory", day), (6, 3, "control", dt.date(2001, 1, 1))]
    rel = spark.createDataFrame(edges, "parent_entity_id bigint, child_entity_id bigint, control_type string, valid_to date")
    got = {r.entity_id: (r.top_parent_entity_id, r.hops) for r in relational.climb(entities, rel).collect()}
    assert got[1] == (3, 2) and got[3] == (3, 0) and got[6] == (6, 0) and got[4][1] == 10


def test_full_join_matches_null_ids(spark):
    a = spark.createDataFrame([("T", None, 1), ("T", 5, 2)], "t string, id bigint, x int")
    b = spark.createDataFrame([("T", None, 3), ("U", None, 4)], "t string, id bigint, y int")
    got = {(r.t, r.id, r.x, r.y) for r in relational.full_null_safe(a, b, ["t"], ["id"]).collect()}
    assert got == {("T", None, 1, 3), ("T", 5, 2, None), ("U", None, None, 4)}


def test_closure_reaches_the_fixed_point(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "src bigint, dst bigint")
    got = relational.closure(spark.createDataFrame([(1,)], "entity_id bigint"), edges)
    assert sorted(r.entity_id for r in got.collect()) == [1, 2, 3]


def test_top_n_breaks_ties(spark):
    df = spark.createDataFrame([("g", "b", 1), ("g", "a", 1), ("g", "c", 2), ("h", "z", None)], "g string, k string, v int")
    got = sorted((r.g, r["rank"], r.k) for r in relational.top_n(df, ["g"], [F.desc_nulls_last("v"), F.asc("k")], 2).collect())
    assert got == [("g", 1, "c"), ("g", 2, "a"), ("h", 1, "z")]


def test_downgrades_are_found(spark):
    prod = spark.createDataFrame([("1", "x", True), ("2", "y", True), ("3", "z", False)], "k string, c string, is_latest boolean")
    staged = spark.createDataFrame([("1", None), ("2", "w"), ("3", None)], "k string, c string")
    assert [tuple(r) for r in promote.downgrades(prod, staged, ["k"], ["c"]).collect()] == [("1", "c", 1)]


def test_labels_and_names(spark):
    df = spark.createDataFrame([("active",), ("balanced",), ("bond_or_other",), ("final_filing",), (None,), ("odd",)], "s string")
    assert [r[0] for r in df.select(fund_label("s")).collect()] == ["active", "active", "bond", "excluded", "unknown", "unknown"]
    names = spark.createDataFrame([("Acme  Corporation, ",), ("Foo L.L.C.",), ("Bar Company Limited;",)], "n string")
    assert [r[0] for r in names.select(text.normal_name(F.col("n"))).collect()] == ["ACME CORP", "FOO LLC", "BAR CO LTD"]
    sums = spark.createDataFrame([(1.5e12,), (2e9,), (None,), (0.0,), (5e3,)], "v double")
    assert [r[0] for r in sums.select(text.aum_label(F.col("v"))).collect()] == ["$1.5T", "$2.0B", "—", "—", "$5.0K"]


def test_fund_strategies(spark):
    rows = [("Big Index Fund", 1.0, 3), ("Gold ETF", 1.0, 3), ("Plain", 0.0, 0), ("Plain", 0.95, 3), ("Plain", 0.7, 3), ("Plain", 0.4, 3), ("Plain", 0.1, 3), (None, 0.9, 1)]
    df = spark.createDataFrame(rows, "n string, s double, p int")
    assert [r[0] for r in df.select(text.fund_strategy(F.col("n"), F.col("s"), F.col("p"))).collect()] == ["passive", "excluded", "empty", "active", "balanced", "multi_asset", "bond_or_other", "active"]


def test_a_rejected_first_match_ends_the_search(spark):
    t = ["Item 11: 150 % and Percent of class: 7.5 %", "Percent of Class: 7,5 %", "nothing", "Item 9: 50 shares"]
    df = spark.createDataFrame([(x,) for x in t], "t string")
    assert [r[0] for r in df.select(text.pct_owned(F.col("t"))).collect()] == [None, 75.0, None, None]
    assert df.select(text.shares_owned(F.lit("Item 9: 1,250 and Amount owned 7"))).first()[0] == 1250


def test_fuzzy_names(spark):
    left = spark.createDataFrame([(1, "Zephyr Capital Management"), (2, "Unlike Name"), (3, "the fund")], "left_id int, left_name string")
    right = spark.createDataFrame([(7, "Capital Management Zephyr"), (8, "Zephyr Capital Managment"), (9, "Fund The")], "right_id int, right_name string")
    got = {r.left_id: (r.right_id, r.score) for r in fuzzy.best_matches(left, right).collect()}
    assert got == {1: (7, 100.0), 3: (9, 100.0)}
    assert fuzzy.token_sort_ratio("abc", "abd") == pytest.approx(200 * 2 / 6)


def test_fuzzy_names_of_a_frequent_brand(spark):
    left = spark.createDataFrame([(1, "Zephyr Growth Opportunity")], "left_id int, left_name string")
    right = spark.createDataFrame([(k, f"Zephyr {k}") for k in range(1100)] + [(5000, "Zephyr Growht Opportunities")], "right_id int, right_name string")
    got = fuzzy.best_matches(left, right).collect()
    assert [(r.left_id, r.right_id) for r in got] == [(1, 5000)] and 85 <= got[0].score < 100


# --- readers --------------------------------------------------------------


def write(path, lines, sep="\t"):
    path.write_text("\n".join(sep.join(x) for x in lines) + "\n")


def test_13f_files(spark, tmp_path):
    write(tmp_path / "SUBMISSION.tsv", [filings.SUBMISSION, ["a1", "14-FEB-2026", "13F-HR", "1111", "31-DEC-2025"], ["a2", "20-FEB-2026", "13F-HR/A", "2222", "31-DEC-2025"], ["a3", "14-FEB-2026", "13F-HR", "2222", "31-DEC-2025"]])
    write(tmp_path / "COVERPAGE.tsv", [filings.COVERPAGE, ["a1", "x", "N", "", "Alpha", "c", "NY", "9", "s"], ["a2", "x", "Y", "1", "Beta", "c", "NY", "8", "s"]])
    info = lambda a, c, v, s: [a, "Issuer", "COM", c, "", v, s, "SH", "", "SOLE", "", "1", "0", "0"]
    write(tmp_path / "INFOTABLE.tsv", [filings.INFOTABLE, info("a1", "c1", "100000", "10"), info("a1", "c2", "50000", "bad"), info("a2", "c1", "7", "1"), info("a3", "c1", "9", "1")])
    got = sorted((r.cik, r.cusip, r.market_value_usd, round(r.pct_of_portfolio, 6), r.shares, r.manager_name) for r in filings.read_13f(spark, str(tmp_path), "2025Q4").collect())
    assert got == [("0000001111", "c1", 100_000_000, 0.666667, 10, "Alpha"), ("0000001111", "c2", 50_000_000, 0.333333, None, "Alpha"), ("0000002222", "c1", 7000, 1.0, 1, "Beta")]


def test_nport_sets(spark):
    reg = spark.createDataFrame([("a1", "77", "Family"), ("a2", "77", "Family"), ("a3", None, None)], "ACCESSION_NUMBER string, CIK string, REGISTRANT_NAME string")
    sub = spark.createDataFrame([("a1", "31-DEC-2025", "N", None), ("a2", "31-Dec-2025", "Y", "NPORT-P/A"), ("a3", "30-NOV-2025", None, None), ("a4", "bad", None, None)], "ACCESSION_NUMBER string, REPORT_DATE string, IS_LAST_FILING string, SUB_TYPE string")
    info = spark.createDataFrame([("a1", "S1", "Fund", "10"), ("a2", "S1", "Fund", "11")], "ACCESSION_NUMBER string, SERIES_ID string, SERIES_NAME string, NET_ASSETS string")
    got = sorted((r.accession_number, r.series_id, r.fund_cik, r.report_month, r.quarter, r.is_final, r.total_net_assets) for r in filings.nport_submissions(reg, sub, info).collect())
    assert got == [("a2", "S1", "0000000077", "2025-12", "2025Q4", True, 11.0), ("a3", "0_a3", "0000000000", "2025-11", "2025Q4", False, None)]


def test_xml_files(spark, tmp_path):
    (tmp_path / "n.xml").write_text("""<edgarSubmission><formData><genInfo><regName>R</regName><seriesId>S9</seriesId><isFinalFiling>N</isFinalFiling></genInfo><fundInfo><netAssets>5.5</netAssets></fundInfo><invstOrSecs>
<invstOrSec><name> A </name><cusip>1</cusip><identifiers><isin value="US1"/><ticker value="AA"/></identifiers><balance>2</balance><valUSD>3.5</valUSD><assetCat>EC</assetCat></invstOrSec>
<invstOrSec><name>B</name><balance>-1</balance><assetConditional desc="x" assetCat="DFE"/></invstOrSec></invstOrSecs></formData></edgarSubmission>""")
    got = sorted((r.issuer_name, r.isin, r.ticker, r.shares, r.asset_category, r.currency, r.net_assets) for r in filings.read_nport_xml(spark, str(tmp_path / "n.xml")).collect())
    assert got == [("A", "US1", "AA", 2.0, "EC", "USD", 5.5), ("B", "", "", -1.0, "DFE", "USD", 5.5)]
    (tmp_path / "c.xml").write_text("""<x><formData><reportPeriodDate>2025-12-31</reportPeriodDate><managementInvestmentQuestionSeriesInfo>
<managementInvestmentQuestion><mgmtInvSeriesId>S1</mgmtInvSeriesId><mgmtInvFundName>F1</mgmtInvFundName><investmentAdvisers><investmentAdviser><investmentAdviserName>One</investmentAdviserName><investmentAdviserCrdNo>1</investmentAdviserCrdNo></investmentAdviser></investmentAdvisers></managementInvestmentQuestion>
<managementInvestmentQuestion><mgmtInvSeriesId>S2</mgmtInvSeriesId><mgmtInvFundName>F2</mgmtInvFundName><investmentAdvisers><investmentAdviser><investmentAdviserName>Two</investmentAdviserName></investmentAdviser></investmentAdvisers><subAdvisers><subAdviser><subAdviserName>Sub</subAdviserName></subAdviser></subAdvisers></managementInvestmentQuestion>
</managementInvestmentQuestionSeriesInfo></formData></x>""")
    rows = sorted((r.series_id, r.role, r.adviser_name) for r in filings.read_ncen_xml(spark, str(tmp_path / "c.xml")).collect())
    assert rows == [("S1", "adviser", "One"), ("S1", "subadviser", "Sub"), ("S2", "adviser", "Two")]


def test_csv_and_json_files(spark, tmp_path):
    write(tmp_path / "adv.csv", [["Organization CRD#", "Primary Business Name", "5F(2)(a)", "5F(2)(c)"], ["1", "Café", '"$1,000"', '"$3,000"'], ["2", "Bad", "x", ""]], ",")
    (tmp_path / "adv.csv").write_bytes((tmp_path / "adv.csv").read_text().encode("latin-1"))
    got = sorted((r.crd_number, r.firm_name, r.adv_5f_raum, r.pct_discretionary, r.cik) for r in filings.read_adv(spark, str(tmp_path / "adv.csv")).collect())
    assert got == [("1", "Café", 3000.0, 33.33, None), ("2", "Bad", 0.0, 0.0, None)]
    write(tmp_path / "s.txt", [["Date", "Symbol", "ShortVolume", "ShortExemptVolume", "TotalVolume", "Market"], ["20260102", "AA", "5.0", "1", "10", "N"], ["20260102", "WAYTOOLONGTICKER", "5", "1", "10", "N"], ["20260102", "BB", "x", "1", "10", "N"]], "|")
    assert [(r.ticker, r.short_volume, str(r.report_date), r.report_month) for r in filings.read_short_volume(spark, str(tmp_path / "s.txt")).collect()] == [("AA", 5, "2026-01-02", "2026-01")]
    (tmp_path / "f.json").write_text('{"cik": 42, "facts": {"dei": {"EntityCommonStockSharesOutstanding": {"units": {"shares": [{"end": "2025-01-31", "val": 7, "form": "10-K", "filed": "2025-02-01"}]}}}, "us-gaap": {"CommonStockSharesOutstanding": {"units": {"shares": [{"end": "2025-01-31", "val": 8}, {"end": "2024-12-31", "val": 6}, {"end": "2024-11-30", "val": 0}]}}}}}')
    assert sorted((str(r.as_of_date), r.shares, r.source_tag.split(":")[0]) for r in filings.read_share_facts(spark, str(tmp_path / "f.json")).collect()) == [("2024-12-31", 6, "us-gaap"), ("2025-01-31", 7, "dei")]
    odd = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (2.5, 3)], "x double, k int")
    assert [r.x for r in filings.finite(odd).orderBy("k").collect()] == [None, None, 2.5]


def test_stored_tables_prune_by_quarter(spark, tmp_path):
    made = canonical.Tables(spark, DATA)
    for name in ("holdings",):
        getattr(made, name).where("quarter in ('2001Q2', '2001Q3')").write.partitionBy("quarter").parquet(str(tmp_path / name))
    plan = spark.read.parquet(str(tmp_path / "holdings")).where("quarter = '2001Q3' and is_latest").select("cik")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(quarter" in plan and "PushedFilters: [IsNotNull(is_latest), EqualTo(is_latest,true)]" in plan


# --- streams --------------------------------------------------------------


def run_stream(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_streams_equal_batches(spark):
    stream = daily.events(spark, DATA)
    got = run_stream(daily.windowed_volume(stream), "volume", "complete").groupBy("ticker").agg(F.sum("total_volume").alias("v"))
    want = canonical.Tables(spark, DATA).short_interest.groupBy("ticker").agg(F.sum("total_volume").alias("v"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    rows = spark.read.parquet(f"{DATA}/events.parquet").count()
    assert run_stream(daily.first_rows(stream), "firsts", "append").count() == rows
    assert run_stream(daily.sessions(stream), "spells", "complete").agg(F.sum("n")).first()[0] == rows


def test_amended_batches_turn_rows_stale(spark, tmp_path):
    spark.createDataFrame([("1", 5), ("2", 6)], "k string, v int").write.parquet(str(tmp_path / "in"))
    state = {"now": spark.createDataFrame([("1", 1, True), ("3", 3, True)], "k string, v int, is_latest boolean")}
    stream = spark.readStream.schema("k string, v int").parquet(str(tmp_path / "in"))
    q = daily.amend(stream, lambda: state["now"], lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"v{n}")), ["k"], str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "v0")).collect())) == [("1", 1, False), ("1", 5, True), ("2", 6, True), ("3", 3, True)]


def test_not_in_knows_nulls(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, x string")
    lists = {("a",): [2], ("a", None): [], (): [1, 2, 3]}
    for values, left in lists.items():
        other = spark.createDataFrame([(v,) for v in values], "y string")
        assert sorted(r.n for r in relational.not_in(rows, "x", other, "y").collect()) == left


def test_rollback_undoes_inserts_before_flips(spark):
    before = spark.createDataFrame([("1", "a", True), ("2", "b", True)], "k string, c string, is_latest boolean")
    after = promote.append_is_latest(before, spark.createDataFrame([("2", "B"), ("3", "C")], "k string, c string"), ["k"])
    log = spark.createDataFrame([("2", "flip_is_latest"), ("2", "insert"), ("3", "insert")], "k string, action string")
    assert sorted(map(tuple, promote.rollback(after, log, ["k"]).collect())) == sorted(map(tuple, before.collect()))
