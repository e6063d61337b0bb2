from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from quartermill import control
from quartermill.functions import rules
from quartermill.functions import text as X


def test_lineage_orders_rebuilds():
    order = control.downstream_of("entities")
    assert order.index("rollup_history") < order.index("investor_flows") < order.index("ticker_flow_stats")
    assert control.downstream_of("ticker_flow_stats") == []
    with pytest.raises(KeyError):
        control.downstream_of("unknown")


def test_runs_halt_for_approval():
    run = control.Run().to("fetching").to("parsing").to("validating").to("pending_approval")
    with pytest.raises(ValueError):
        run.to("promoting")
    assert run.to("approved").to("promoting").to("complete").to("rolled_back").state == "rolled_back"


@pytest.mark.parametrize(("day", "end", "due"), [
    (date(2026, 1, 5), date(2025, 12, 31), date(2026, 2, 14)), (date(2026, 2, 15), date(2025, 12, 31), date(2026, 5, 15)),
    (date(2026, 3, 31), date(2026, 3, 31), date(2026, 5, 15)), (date(2026, 12, 30), date(2026, 9, 30), date(2027, 2, 14))])
def test_calendar(day, end, due):
    assert control.last_quarter_end(day) == end and control.next_13f_deadline(day) == due


def test_staleness():
    assert control.is_stale(None, date(2026, 1, 1), 9) and not control.is_stale(date(2026, 1, 1), date(2026, 1, 10), 9) and control.is_stale(date(2026, 1, 1), date(2026, 1, 11), 9)


def test_security_types(spark):
    rows = [
        ("x", "DE", None, "OPTION"), ("x", "LON", None, "BOND"), (None, "STIV", None, "CASH"), ("CL A", None, None, "COM"), ("SHS CL B", "EC", None, "COM"), ("Common Stock", "EC", None, "COM"), ("PFD SER A", "EC", None, "PREF"),
        ("SPDR ETF COM", "EC", None, "ETF"), ("WARRANT EXP", "EC", None, "WARRANT"), ("mystery", "EC", None, "COM"), (None, "EP", None, "PREF"), (None, None, None, "OTHER"), ("MF Closed and MF Open", None, None, "CEF"),
        ("SPAC / REIT", None, None, "REIT"), ("mystery", None, "Govt", "BOND"), ("FOREIGN", None, None, "FOREIGN"), ("ADR", "EC", "Equity", "ADR"), ("UNIT 01/02/2003", None, None, "OTHER"),
    ]
    df = spark.createDataFrame(rows, "raw string, category string, sector string, want string")
    got = df.select(rules.classify_security(F.col("raw"), F.col("category"), F.col("sector"), F.lit("GR")).alias("c")).select("c.*").collect()
    assert [r.canonical_type for r in got] == [w for *_, w in rows]
    assert got[15].is_equity and not got[15].is_priceable and got[0].confidence == "high" and got[0].is_permanent and got[16].source == "market_sector"


def test_adviser_strategies(spark):
    rows = [
        ("Big Index", 90.0, None, None, None, "passive"), ("Plain", 5.0, None, None, None, "passive"), ("Plain", 90.0, "Y", None, None, "hedge_fund"), ("Cayman One", 90.0, "N", None, None, "hedge_fund"), ("Quant Lab", 90.0, "N", None, None, "quantitative"),
        ("Diversified", 90.0, None, None, None, "multi_strategy"), ("Plain", 50.0, None, "y", None, "private_equity"), ("Plain", 50.0, None, None, "Y", "private_equity"), ("Plain", 80.0, None, None, None, "active"), (None, 50.0, None, None, None, "unknown"),
    ]
    df = spark.createDataFrame(rows, "n string, p double, h string, e string, v string, want string")
    c = F.col
    assert [r[0] for r in df.select(rules.adviser_strategy(c("n"), c("p"), c("h"), c("e"), c("v"))).collect()] == [w for *_, w in rows]
    assert df.select(rules.is_activist(F.lit("The STARBOARD VALUE fund"))).first()[0] and not df.select(rules.is_activist(F.lit(None).cast("string"))).first()[0]


def test_filing_texts(spark):
    rows = [
        ("Date of Event: 3/5/2001 Item 4. Purpose of Transaction. To hold. Item 5 NAME OF REPORTING PERSON: Alpha LP CHECK", "SC 13D"), ("Date of Event: 31/31/2001 Item 4 Purpose", "SC 13D/A"), ("", "SC 13G"), (None, None)]
    df = spark.createDataFrame(rows, "t string, k string")
    got = df.select(X.event_date(F.col("t")).cast("string"), X.purpose(F.col("t"), F.col("k")), X.reporting_person(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("2001-03-05", "To hold.", "Alpha LP"), (None, None, None), (None, None, None), (None, None, None)]
