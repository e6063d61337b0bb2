"""Derived tables, ingest and promotion steps, as queries over the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LATEST, QUARTERS, SUMMARY_ACTIVE, sql_list
from ..functions import text as X
from ..operators import promote
from ..operators.relational import as_of, open_rows, ratio, top_n
from ..sources.canonical import Tables, statement
from .common import S

desc = F.desc_nulls_last


def quarter_end(column: str):
    """The last day of a YYYYQn quarter, null for other text."""
    q = F.col(column)
    day = F.last_day(F.make_date(F.substring(q, 1, 4).try_cast("int"), F.substring(q, 6, 1).try_cast("int") * 3, F.lit(1)))
    return F.when(q.rlike("^[0-9]{4}Q[1-4]$"), day)


_QEND = "last_day(make_date(CAST(substring(quarter, 1, 4) AS BIGINT), CAST(substring(quarter, 6, 1) AS BIGINT) * 3, 1))"


def pct_of_so_as_of(t: Tables) -> DataFrame:
    """Shares held of shares outstanding by ticker and quarter, with the source of the denominator.

    Tiers: the history's latest value at or before quarter end, the current
    shares outstanding, the float, none; each only if positive.
    """
    rows = t.latest.groupBy("ticker", "quarter").agg(F.sum("shares").alias("shares")).withColumn("quarter_end", quarter_end("quarter"))
    rows = as_of(rows, t.soh.withColumnRenamed("shares", "so"), "ticker", "quarter_end", "as_of_date", "so", "soh_shares")
    rows = rows.join(t.market_data.select("ticker", "shares_outstanding", "float_shares"), "ticker", "left")
    tiers = [("soh_shares", "soh_period_accurate"), ("shares_outstanding", "market_data_so_latest"), ("float_shares", "market_data_float_latest")]
    value = source = None
    for c, name in tiers:
        value = F.when(F.col(c) > 0, F.col(c)) if value is None else value.when(F.col(c) > 0, F.col(c))
        source = F.when(F.col(c) > 0, name) if source is None else source.when(F.col(c) > 0, name)
    return rows.select("ticker", "quarter", "shares", ratio(F.col("shares"), value, 100).alias("pct_of_so"), source.alias("pct_of_so_source"))


PCT_OF_SO = f"""r AS (SELECT ticker, quarter, {_QEND} AS qe, {S("shares")} AS shares FROM holdings WHERE is_latest GROUP BY 1, 2, 3),
j AS (SELECT r.*, s.shares AS soh FROM r ASOF LEFT JOIN soh s ON s.ticker = r.ticker AND s.as_of_date <= r.qe)
SELECT j.ticker, quarter, shares, shares * 100.0::DOUBLE / CASE WHEN soh > 0 THEN soh WHEN shares_outstanding > 0 THEN shares_outstanding WHEN float_shares > 0 THEN float_shares END AS pct_of_so,
  CASE WHEN soh > 0 THEN 'soh_period_accurate' WHEN shares_outstanding > 0 THEN 'market_data_so_latest' WHEN float_shares > 0 THEN 'market_data_float_latest' END AS pct_of_so_source
FROM j LEFT JOIN market_data m ON j.ticker = m.ticker"""


def summary_by_ticker(t: Tables) -> DataFrame:
    """Holders, shares, value and active share of each ticker and quarter."""
    by = t.latest.groupBy("quarter", "ticker").agg(F.count_distinct("cik").alias("holder_count"), F.sum("shares").alias("total_shares"), F.sum("market_value_usd").alias("total_value"), F.sum(F.when(F.col("manager_type").isin(*SUMMARY_ACTIVE), F.col("market_value_usd")).otherwise(0)).alias("active_value"))
    return by.withColumn("active_pct", ratio(F.col("active_value"), F.col("total_value"), 100))


BY_TICKER = f"""b AS (SELECT quarter, ticker, count(DISTINCT cik) AS holder_count, {S("shares")} AS total_shares, {S("market_value_usd")} AS total_value,
  {S(f"CASE WHEN manager_type IN {sql_list(SUMMARY_ACTIVE)} THEN market_value_usd ELSE 0 END")} AS active_value FROM holdings WHERE is_latest GROUP BY 1, 2)
SELECT *, active_value * 100.0::DOUBLE / nullif(total_value, 0) AS active_pct FROM b"""


def summary_by_parent(t: Tables) -> DataFrame:
    """13F value of each rollup parent and quarter, its funds' value at each fund's latest month, and coverage of at most 100 %."""
    held = t.latest.where("rollup_entity_id is not null").groupBy("quarter", F.col("rollup_entity_id").alias("rid")).agg(F.max("rollup_name").alias("parent"), F.sum("market_value_usd").alias("total_aum"), F.count_distinct("ticker").alias("tickers"))
    f = t.fund_latest.groupBy("quarter", "series_id", "report_month", F.col("rollup_entity_id").alias("rid")).agg(F.sum("market_value_usd").alias("v"))
    last = f.groupBy("quarter", "series_id", "rid").agg(F.max_by("v", "report_month").alias("v"))
    funds = last.groupBy("quarter", "rid").agg(F.sum("v").alias("fund_aum"))
    return held.join(funds, ["quarter", "rid"], "left").withColumn("coverage_pct", F.least(F.lit(100.0), ratio(F.col("fund_aum"), F.col("total_aum"), 100)))


BY_PARENT = f"""h AS (SELECT quarter, rollup_entity_id AS rid, max(rollup_name) AS parent, {S("market_value_usd")} AS total_aum, count(DISTINCT ticker) AS tickers FROM holdings WHERE is_latest AND rollup_entity_id IS NOT NULL GROUP BY 1, 2),
f AS (SELECT quarter, series_id, report_month, rollup_entity_id AS rid, {S("market_value_usd")} AS v FROM fund_holdings WHERE is_latest GROUP BY 1, 2, 3, 4),
g AS (SELECT quarter, rid, {S("v")} AS fund_aum FROM (SELECT *, row_number() OVER (PARTITION BY quarter, series_id, rid ORDER BY report_month DESC) AS k FROM f) q WHERE k = 1 GROUP BY 1, 2)
SELECT h.*, fund_aum, least(100.0::DOUBLE, fund_aum * 100.0::DOUBLE / nullif(total_aum, 0)) AS coverage_pct FROM h LEFT JOIN g ON h.quarter = g.quarter AND h.rid = g.rid"""


def benchmark_weights(t: Tables, series: str = "S000001") -> DataFrame:
    """Sector weights of one fund at its latest month; tickers without a sector are out."""
    rows = t.fund_latest.where(F.col("series_id") == series)
    last = F.broadcast(rows.agg(F.max("report_month").alias("last")))
    by = rows.crossJoin(last).where("report_month = last").join(t.market_data.select("ticker", "sector"), "ticker").groupBy("report_month", "sector").agg(F.sum("market_value_usd").alias("value"))
    return by.withColumn("weight_pct", ratio(F.col("value"), F.sum("value").over(Window.partitionBy()), 100))


BENCHMARK = f"""r AS (SELECT * FROM fund_holdings WHERE is_latest AND series_id = 'S000001'),
b AS (SELECT report_month, sector, {S("market_value_usd")} AS value FROM r JOIN market_data m ON r.ticker = m.ticker WHERE report_month = (SELECT max(report_month) FROM r) GROUP BY 1, 2)
SELECT *, value * 100.0::DOUBLE / nullif(CAST(sum(value) OVER () AS DOUBLE), 0) AS weight_pct FROM b"""


def beneficial_ownership_current(t: Tables) -> DataFrame:
    """Each filer's latest filing on a subject, the number of its filings, the intent before, and whether it ever filed a 13G.

    The intent before is that of the next older filing.
    """
    intent = F.when(F.col("filing_type").startswith("SC 13D"), "activist").otherwise("passive")
    w = Window.partitionBy("filer_cik", "subject_ticker")
    order = w.orderBy(F.desc("filing_date"), F.desc("accession_number"))
    rows = t.beneficial.withColumn("intent", intent).withColumns({
        "prior_intent": F.lead("intent").over(order), "amendment_count": F.count("*").over(w), "crossed_5pct": F.bool_or(F.col("filing_type").startswith("SC 13G")).over(w), "rn": F.row_number().over(order)})
    return rows.where("rn = 1").select("filer_cik", "subject_ticker", "accession_number", "filing_type", "filing_date", "shares_owned", "intent", "prior_intent", "amendment_count", "crossed_5pct")


BOC = """i AS (SELECT *, CASE WHEN filing_type LIKE 'SC 13D%' THEN 'activist' ELSE 'passive' END AS intent FROM beneficial),
r AS (SELECT *, lead(intent) OVER o AS prior_intent, row_number() OVER o AS rn, count(*) OVER w AS amendment_count, bool_or(filing_type LIKE 'SC 13G%') OVER w AS crossed_5pct
  FROM i WINDOW o AS (PARTITION BY filer_cik, subject_ticker ORDER BY filing_date DESC, accession_number DESC), w AS (PARTITION BY filer_cik, subject_ticker))
SELECT filer_cik, subject_ticker, accession_number, filing_type, filing_date, shares_owned, intent, prior_intent, amendment_count, crossed_5pct FROM r WHERE rn = 1"""


def parent_fund_map(t: Tables) -> DataFrame:
    """Funds whose family matches a parent's pattern, but those of excluded strategies.

    Families are reduced to their distinct names before the patterns meet
    them, so the pattern join never sees a holding.
    """
    patterns = t.base("nation").select(F.col("n_name").alias("parent_name"), F.concat(F.lit("family\\_"), F.col("n_nationkey").cast("string")).alias("pattern"))
    families = t.fund_universe.select("family_name").distinct()
    matched = families.join(patterns, F.expr("family_name ilike pattern"))
    excluded = t.fund_holdings.where("fund_strategy in ('excluded', 'final_filing')").select("series_id").distinct()
    return t.fund_universe.select("series_id", "fund_name", "family_name").join(matched, "family_name").join(excluded, "series_id", "left_anti").select("parent_name", "series_id", "fund_name")


FUND_MAP = r"""p AS (SELECT n_name AS parent_name, 'family\_' || CAST(n_nationkey AS VARCHAR) AS pattern FROM nation)
SELECT parent_name, series_id, fund_name FROM fund_universe u JOIN p ON u.family_name ILIKE p.pattern ESCAPE '\'
WHERE NOT EXISTS (SELECT 1 FROM fund_holdings f WHERE f.series_id = u.series_id AND fund_strategy IN ('excluded', 'final_filing'))"""


def managers_build(t: Tables) -> DataFrame:
    """Filers with their quarters, positions and a strategy by ladder: activist flag, then assets, else by segment."""
    filed = t.holdings.groupBy("cik").agg(F.max("manager_name").alias("manager_name"), F.count_distinct("quarter").alias("num_filings"), F.count("*").alias("total_positions"), F.max("manager_type").alias("filed_type"))
    strategy = F.when(F.col("is_activist"), "activist").when(F.coalesce("filed_type", F.lit("")) != "", F.col("filed_type")).when(F.col("aum_total") >= 5_000_000_000, "mixed").otherwise(F.lit(None).cast("string"))
    return filed.join(t.managers.drop("manager_name"), "cik", "left").withColumn("strategy_type", strategy).drop("filed_type")


MANAGERS_BUILD = """f AS (SELECT cik, max(manager_name) AS manager_name, count(DISTINCT quarter) AS num_filings, count(*) AS total_positions, max(manager_type) AS ft FROM holdings GROUP BY 1)
SELECT f.cik, f.manager_name, num_filings, total_positions, parent_name, aum_total, is_activist, CASE WHEN is_activist THEN 'activist' WHEN coalesce(ft, '') <> '' THEN ft WHEN aum_total >= 5000000000 THEN 'mixed' END AS strategy_type
FROM f LEFT JOIN managers m ON f.cik = m.cik"""


def amendment_resolution(t: Tables) -> DataFrame:
    """One line of each (order, line number): the last by ship date and a total order over the rest."""
    li = t.base("lineitem")
    order = [F.desc("l_shipdate"), F.desc("l_partkey"), F.desc("l_suppkey"), F.desc("l_extendedprice"), F.desc("l_quantity"), F.desc("l_discount"), F.desc("l_tax")]
    return promote.latest_by(li, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


AMENDMENTS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC) AS k FROM lineitem) q WHERE k = 1"""


def _prod(t: Tables) -> tuple[DataFrame, DataFrame]:
    o = t.base("orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice").cast("bigint").alias("price"))
    prod = o.where("o_orderkey % 3 <> 0")
    staged = o.where("o_orderkey % 5 = 0").withColumn("price", F.col("price") + 1)
    return prod, staged


_PROD = """o AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(round(o_totalprice) AS BIGINT) AS price FROM orders),
prod AS (SELECT * FROM o WHERE o_orderkey % 3 <> 0), staged AS (SELECT o_orderkey, o_custkey, o_orderstatus, price + 1 AS price FROM o WHERE o_orderkey % 5 = 0)"""


def promote_append_latest(t: Tables) -> DataFrame:
    """Promotion that keeps superseded rows: rows of staged customers turn stale, staged rows are added as latest."""
    prod, staged = _prod(t)
    return promote.append_is_latest(prod.withColumn("is_latest", F.lit(True)), staged, ["o_orderkey"])


APPEND = f"""{_PROD} SELECT *, o_orderkey NOT IN (SELECT o_orderkey FROM staged) AS is_latest FROM prod UNION ALL SELECT *, TRUE FROM staged"""


def promote_scd2(t: Tables) -> DataFrame:
    """Promotion with validity ranges: the open row of a staged key closes, the staged row opens."""
    prod, staged = _prod(t)
    return promote.scd_type2(prod.withColumn("valid_from", F.lit("2000-01-01").cast("date")).withColumn("valid_to", F.lit("9999-12-31").cast("date")), staged, ["o_orderkey"], F.lit("2001-10-01").cast("date"))


SCD2 = f"""{_PROD} SELECT *, DATE '2000-01-01' AS valid_from, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM staged) THEN DATE '2001-10-01' ELSE DATE '9999-12-31' END AS valid_to FROM prod
UNION ALL SELECT *, DATE '2001-10-01', DATE '9999-12-31' FROM staged"""


def promote_direct(t: Tables) -> DataFrame:
    """Promotion that replaces the rows of staged keys."""
    prod, staged = _prod(t)
    return promote.direct_write(prod, staged, ["o_orderkey"])


DIRECT = f"""{_PROD} SELECT * FROM prod WHERE o_orderkey NOT IN (SELECT o_orderkey FROM staged) UNION ALL SELECT * FROM staged"""


def pk_diff(t: Tables) -> DataFrame:
    """Rows added, changed, unchanged and absent between two versions of a table, by count."""
    prod, staged = _prod(t)
    return promote.diff_counts(prod, staged, ["o_orderkey"])


DIFF = f"""{_PROD}
SELECT CASE WHEN p.o_orderkey IS NULL THEN 'added' WHEN s.o_orderkey IS NULL THEN 'absent' WHEN p.price IS DISTINCT FROM s.price OR p.o_custkey IS DISTINCT FROM s.o_custkey OR p.o_orderstatus IS DISTINCT FROM s.o_orderstatus THEN 'changed' ELSE 'unchanged' END AS status,
  count(*) AS n FROM prod p FULL JOIN staged s ON p.o_orderkey = s.o_orderkey GROUP BY 1"""


def merge_fill(t: Tables) -> DataFrame:
    """Merge that only fills nulls of the old rows and adds new ones."""
    prod, staged = _prod(t)
    return promote.merge_nulls(prod.withColumn("price", F.when(F.col("o_orderkey") % 2 == 0, F.col("price"))), staged, ["o_orderkey"])


MERGE = f"""{_PROD}
SELECT coalesce(p.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(p.o_custkey, s.o_custkey) AS o_custkey, coalesce(p.o_orderstatus, s.o_orderstatus) AS o_orderstatus,
  coalesce(CASE WHEN p.o_orderkey % 2 = 0 THEN p.price END, s.price) AS price FROM prod p FULL JOIN staged s ON p.o_orderkey = s.o_orderkey"""


def entity_gate(t: Tables) -> DataFrame:
    """Why filers can't be promoted: no entity, no rollup in both worldviews, no type; by reason."""
    rows = t.holdings.groupBy("cik", "entity_id").agg(F.max("entity_type").alias("entity_type"))
    views = open_rows(t.rollup_history).groupBy("entity_id").agg(F.count_distinct("rollup_type").alias("views"))
    known = t.entities.select("entity_id", F.lit(True).alias("known"))
    joined = rows.join(known, "entity_id", "left").join(views, "entity_id", "left")
    reason = F.when(F.col("known").isNull(), "no_entity").when(F.coalesce("views", F.lit(0)) < 2, "no_rollup").when(F.col("entity_type").isNull(), "no_classification").otherwise("passed")
    return joined.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


GATE = """r AS (SELECT cik, entity_id, max(entity_type) AS entity_type FROM holdings GROUP BY 1, 2), v AS (SELECT entity_id, count(DISTINCT rollup_type) AS views FROM rollup_history WHERE valid_to = DATE '9999-12-31' GROUP BY 1)
SELECT CASE WHEN e.entity_id IS NULL THEN 'no_entity' WHEN coalesce(views, 0) < 2 THEN 'no_rollup' WHEN r.entity_type IS NULL THEN 'no_classification' ELSE 'passed' END AS reason, count(*) AS n
FROM r LEFT JOIN entities e ON r.entity_id = e.entity_id LEFT JOIN v ON v.entity_id = r.entity_id GROUP BY 1"""


def finra_upsert(t: Tables) -> DataFrame:
    """Daily short volume with its share; a (ticker, date) that is loaded already keeps its first row."""
    old = t.short_interest.where("day(report_date) % 2 = 0").withColumn("batch", F.lit("old"))
    new = t.short_interest.withColumn("short_volume", F.col("short_volume") + 1).withColumn("batch", F.lit("new"))
    rows = promote.insert_or_ignore(old, new, ["ticker", "report_date"])
    return rows.withColumn("short_pct", F.coalesce(ratio(F.col("short_volume"), F.col("total_volume"), 100), F.lit(0.0)))


FINRA = """u AS (SELECT *, 'old' AS batch FROM short_interest WHERE day(report_date) % 2 = 0 UNION ALL SELECT ticker, report_date, short_volume + 1, total_volume, 'new' FROM short_interest WHERE day(report_date) % 2 <> 0)
SELECT *, coalesce(short_volume * 100.0::DOUBLE / nullif(total_volume, 0), 0) AS short_pct FROM u"""


def admin_manager_changes(t: Tables) -> DataFrame:
    """Filers and tickers that appeared or went between consecutive quarters, by pair."""
    rows = t.latest.where(F.col("quarter").isin(*QUARTERS)).select("quarter", "cik").distinct()
    k = F.array_position(F.array(*[F.lit(q) for q in QUARTERS]), F.col("quarter"))
    here = rows.select("cik", k.alias("k"), F.lit(1).alias("now"), F.lit(0).alias("was"))
    ahead = rows.select("cik", (k + 1).alias("k"), F.lit(0).alias("now"), F.lit(1).alias("was"))
    cells = here.unionByName(ahead).where(f"k between 2 and {len(QUARTERS)}").groupBy("cik", "k").agg(F.max("now").alias("now"), F.max("was").alias("was"))
    return cells.groupBy(F.element_at(F.array(*[F.lit(q) for q in QUARTERS]), F.col("k").cast("int")).alias("quarter")).agg(F.count_if(F.expr("now = 1 and was = 0")).alias("new_managers"), F.count_if(F.expr("now = 0 and was = 1")).alias("gone_managers"), F.count_if(F.expr("now = 1 and was = 1")).alias("stayed"))


_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in zip(QUARTERS, QUARTERS[1:], strict=False))
CHANGES = f"""d AS (SELECT DISTINCT quarter, cik FROM holdings WHERE is_latest), p AS (SELECT * FROM (VALUES {_PAIRS}) x(f, q))
SELECT p.q AS quarter, (SELECT count(*) FROM d WHERE quarter = p.q AND cik NOT IN (SELECT cik FROM d WHERE quarter = p.f)) AS new_managers,
  (SELECT count(*) FROM d WHERE quarter = p.f AND cik NOT IN (SELECT cik FROM d WHERE quarter = p.q)) AS gone_managers,
  (SELECT count(*) FROM d WHERE quarter = p.f AND cik IN (SELECT cik FROM d WHERE quarter = p.q)) AS stayed FROM p"""


def clean_pages(t: Tables) -> DataFrame:
    """Web pages without tags, entities decoded, white space collapsed: length and digest."""
    return t.base("pages").select("page_id", X.clean_text(F.col("html")).alias("text")).select("page_id", F.length("text").cast("bigint").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def _clean_sql(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for old, new in X.ENTITIES:
        out = f"replace({out}, '{old}', '{new.replace(chr(39), chr(39) * 2)}')"
    out = rf"regexp_replace({out}, '&(#x[0-9a-fA-F]+|#[0-9]+|\w+);', ' ', 'g')"
    for pattern, to in ((r"(\d)\s+(\d)", r"\1\2"), (r"(\d)\s+(\d)", r"\1\2"), (r"(\d)\s*\.\s*(\d)", r"\1.\2"), (r"\s+", " ")):
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return out


CLEAN = f"SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, {_clean_sql('html')} AS t FROM pages) q"


def normalise_names(t: Tables) -> DataFrame:
    """Entity names with legal suffixes in one form."""
    odd = F.concat(F.lower("canonical_name"), F.lit("  Corporation  l.l.c.,"))
    return t.entities.select("entity_id", X.normal_name(odd).alias("normal"))


NAMES = r"""SELECT entity_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(trim(lower(canonical_name) || '  Corporation  l.l.c.,')), '\bCORPORATION\b', 'CORP', 'g'), '\bL\.L\.C\.', 'LLC', 'g'), '[.,;]+$', ''), '\s+', ' ', 'g')) AS normal FROM entities"""


QUERIES = {
    "pct_of_so_as_of": (pct_of_so_as_of, statement(PCT_OF_SO)),
    "summary_by_ticker": (summary_by_ticker, statement(BY_TICKER)),
    "summary_by_parent": (summary_by_parent, statement(BY_PARENT)),
    "benchmark_weights": (benchmark_weights, statement(BENCHMARK)),
    "beneficial_ownership_current": (beneficial_ownership_current, statement(BOC)),
    "parent_fund_map": (parent_fund_map, statement(FUND_MAP)),
    "managers_build": (managers_build, statement(MANAGERS_BUILD)),
    "amendment_resolution": (amendment_resolution, statement(AMENDMENTS)),
    "promote_append_latest": (promote_append_latest, statement(APPEND)),
    "promote_scd2": (promote_scd2, statement(SCD2)),
    "promote_direct": (promote_direct, statement(DIRECT)),
    "pk_diff": (pk_diff, statement(DIFF)),
    "merge_fill": (merge_fill, statement(MERGE)),
    "entity_gate": (entity_gate, statement(GATE)),
    "finra_upsert": (finra_upsert, statement(FINRA)),
    "admin_manager_changes": (admin_manager_changes, statement(CHANGES)),
    "clean_pages": (clean_pages, statement(CLEAN)),
    "normalise_names": (normalise_names, statement(NAMES)),
}
