"""Sectors, short interest, market summary and who holds what together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EQUITY_CATEGORIES, LATEST, OTHER, QUARTERS, SUMMARY_ACTIVE, TICKER, sql_list
from ..functions.categories import fund_label, fund_label_sql
from ..operators.relational import ratio, top_n
from ..sources.canonical import Tables, statement
from .common import NAMED, S, at, named

desc = F.desc_nulls_last


def sector_summary(t: Tables, quarter: str = LATEST) -> DataFrame:
    """Value, holders, tickers and active value by sector."""
    rows = t.latest.where(F.col("quarter") == quarter).join(t.market_data.select("ticker", "sector"), "ticker")
    return rows.groupBy("sector").agg(F.sum("market_value_usd").alias("total_aum"), F.count_distinct("cik").alias("holders"), F.count_distinct("ticker").alias("tickers"), F.sum(F.when(F.col("manager_type").isin(*SUMMARY_ACTIVE), F.col("market_value_usd")).otherwise(0)).alias("active_aum"))


SECTOR_SUMMARY = f"""SELECT sector, {S("market_value_usd")} AS total_aum, count(DISTINCT cik) AS holders, count(DISTINCT h.ticker) AS tickers,
  {S(f"CASE WHEN manager_type IN {sql_list(SUMMARY_ACTIVE)} THEN market_value_usd ELSE 0 END")} AS active_aum
  FROM holdings h JOIN market_data m ON h.ticker = m.ticker WHERE is_latest AND quarter = '{LATEST}' GROUP BY 1"""


def fund_quarter_completeness(t: Tables) -> DataFrame:
    """Whether a quarter has all three of its months."""
    by = t.fund_latest.groupBy("quarter").agg(F.count_distinct("report_month").alias("months"), F.count_distinct("series_id").alias("funds"))
    return by.withColumn("complete", F.col("months") == 3)


COMPLETENESS = """SELECT quarter, count(DISTINCT report_month) AS months, count(DISTINCT series_id) AS funds, count(DISTINCT report_month) = 3 AS complete
  FROM fund_holdings WHERE is_latest GROUP BY 1"""


def sector_monthly_flows(t: Tables) -> DataFrame:
    """Change in shares at the implied price by sector and month, of positions held in both of two consecutive months."""
    by = t.fund_latest.where(F.col("asset_category").isin(*EQUITY_CATEGORIES) & (F.col("shares") > 0)).groupBy("series_id", "ticker", "report_month").agg(F.sum("shares").alias("shares"), F.sum("market_value_usd").alias("value"))
    month = F.to_date(F.concat("report_month", F.lit("-01")))
    w = Window.partitionBy("series_id", "ticker").orderBy("report_month")
    step = by.withColumn("p_month", F.lag("report_month").over(w)).withColumn("p_shares", F.lag("shares").over(w))
    paired = step.where(F.date_format(F.add_months(month, -1), "yyyy-MM") == F.col("p_month"))
    flow = (F.col("shares") - F.col("p_shares")) * ratio(F.col("value"), F.col("shares"))
    return paired.join(t.market_data.select("ticker", "sector"), "ticker").groupBy("sector", "report_month").agg((F.sum(F.round(flow * 100)) / 100).alias("net_flow"), F.count("*").alias("pairs"))


SECTOR_MONTHLY = f"""b AS (SELECT series_id, ticker, report_month, {S("shares")} AS shares, {S("market_value_usd")} AS value FROM fund_holdings
  WHERE is_latest AND asset_category IN ('EC', 'EP') AND shares > 0 GROUP BY 1, 2, 3)
SELECT sector, c.report_month, sum(round((c.shares - p.shares) * (c.value::DOUBLE / nullif(c.shares, 0)) * 100)) / 100 AS net_flow, count(*) AS pairs
FROM b c JOIN b p ON p.series_id = c.series_id AND p.ticker = c.ticker AND p.report_month = strftime((c.report_month || '-01')::DATE - INTERVAL 1 MONTH, '%Y-%m')
JOIN market_data m ON c.ticker = m.ticker GROUP BY 1, 2"""


def short_trend(t: Tables, ticker: str = TICKER) -> DataFrame:
    """Short positions of funds by quarter: funds, shares, and value at the live price."""
    rows = at(t.fund_latest, ticker).where("shares < 0").groupBy("quarter").agg(F.count_distinct("fund_name").alias("fund_count"), F.sum(F.abs("shares")).alias("short_shares"))
    price = t.market_data.where(F.col("ticker") == ticker).select("price_live")
    return rows.crossJoin(price).withColumn("short_value", F.col("short_shares") * F.col("price_live")).drop("price_live")


SHORT_TREND = f"""SELECT quarter, count(DISTINCT fund_name) AS fund_count, {S("abs(shares)")} AS short_shares, {S("abs(shares)")} * (SELECT price_live FROM market_data WHERE ticker = '{TICKER}') AS short_value
  FROM fund_holdings WHERE is_latest AND ticker = '{TICKER}' AND shares < 0 GROUP BY 1"""


def short_detail(t: Tables, ticker: str = TICKER) -> DataFrame:
    """Each fund's short position; a value whose implied price is over 3 times off the live price is recomputed."""
    rows = at(t.fund_latest, ticker).where("shares < 0").groupBy("quarter", "series_id", "fund_name").agg(F.sum(F.abs("shares")).alias("short_shares"), F.sum(F.abs("market_value_usd")).alias("filed_value"), F.max("fund_strategy").alias("strategy"))
    rows = rows.join(t.fund_universe.select("series_id", "total_net_assets"), "series_id", "left")
    rows = rows.crossJoin(F.broadcast(t.market_data.where(F.col("ticker") == ticker).select("price_live")))
    implied = ratio(F.col("filed_value"), F.col("short_shares"))
    off = (implied == 0) | (implied > F.col("price_live") * 3) | (implied < F.col("price_live") / 3)
    value = F.when(off, F.col("short_shares") * F.col("price_live")).otherwise(F.col("filed_value").cast("double"))
    return rows.select("quarter", "series_id", "fund_name", "short_shares", value.alias("short_value"), off.alias("recomputed"), fund_label("strategy").alias("label"), F.when(F.col("total_net_assets") > 0, value * 100.0 / F.col("total_net_assets")).alias("pct_of_nav"))


SHORT_DETAIL = f"""b AS (SELECT quarter, f.series_id, f.fund_name, {S("abs(shares)")} AS short_shares, {S("abs(market_value_usd)")} AS fv, max(fund_strategy) AS strategy
  FROM fund_holdings f WHERE is_latest AND ticker = '{TICKER}' AND shares < 0 GROUP BY 1, 2, 3),
c AS (SELECT b.*, total_net_assets, price_live AS p, fv::DOUBLE / nullif(short_shares, 0) AS i FROM b LEFT JOIN fund_universe u ON b.series_id = u.series_id, market_data m WHERE m.ticker = '{TICKER}'),
d AS (SELECT *, i = 0 OR i > p * 3 OR i < p / 3 AS recomputed FROM c),
e AS (SELECT *, CASE WHEN recomputed THEN short_shares * p ELSE fv::DOUBLE END AS short_value FROM d)
SELECT quarter, series_id, fund_name, short_shares, short_value, recomputed, {fund_label_sql("strategy")} AS label, CASE WHEN total_net_assets > 0 THEN short_value * 100.0::DOUBLE / total_net_assets END AS pct_of_nav FROM e"""


def short_long_cross(t: Tables, ticker: str = TICKER) -> DataFrame:
    """Funds that are both long and short of a ticker, and those only short, over all quarters."""
    rows = at(t.fund_latest, ticker).groupBy("series_id").agg(F.sum(F.when(F.col("shares") > 0, F.col("shares")).otherwise(0)).alias("long_shares"), F.sum(F.when(F.col("shares") < 0, -F.col("shares")).otherwise(0)).alias("short_shares"))
    return rows.where("short_shares > 0").withColumn("side", F.when(F.col("long_shares") > 0, "both").otherwise("short_only")).withColumn("net_shares", F.col("long_shares") - F.col("short_shares"))


SHORT_LONG = f"""b AS (SELECT series_id, {S("CASE WHEN shares > 0 THEN shares ELSE 0 END")} AS long_shares, {S("CASE WHEN shares < 0 THEN -shares ELSE 0 END")} AS short_shares FROM fund_holdings WHERE is_latest AND ticker = '{TICKER}' GROUP BY 1)
SELECT *, CASE WHEN long_shares > 0 THEN 'both' ELSE 'short_only' END AS side, long_shares - short_shares AS net_shares FROM b WHERE short_shares > 0"""


def short_position_pct(t: Tables, ticker: str = TICKER) -> DataFrame:
    """Short share of shares outstanding by quarter: the ticker's, and the averages over its sector's and industry's tickers."""
    md = t.market_data.where("shares_outstanding > 0").select("ticker", "sector", "industry", "shares_outstanding")
    own = F.broadcast(md.where(F.col("ticker") == ticker).select(F.col("sector").alias("s"), F.col("industry").alias("i")))
    by = t.fund_latest.where("payoff_profile = 'Short'").join(F.broadcast(md), "ticker").groupBy("quarter", "ticker", "sector", "industry").agg(F.sum(F.abs("shares")).alias("short"), F.max("shares_outstanding").alias("so")).where("short > 0").crossJoin(own)
    pct = ratio(F.col("short"), F.col("so"), 100)
    series = F.array_compact(F.array(F.when(F.col("ticker") == ticker, F.lit("ticker")), F.when(F.col("sector") == F.col("s"), F.lit("sector")), F.when(F.col("industry") == F.col("i"), F.lit("industry"))))
    return by.select("quarter", F.explode(series).alias("series"), pct.alias("pct")).groupBy("series", "quarter").agg(F.round(F.avg("pct"), 8).alias("pct"))


SHORT_PCT = f"""b AS (SELECT quarter, f.ticker, sector, industry, {S("abs(shares)")} * 100.0::DOUBLE / max(shares_outstanding) AS pct FROM fund_holdings f JOIN market_data m ON f.ticker = m.ticker
  WHERE is_latest AND payoff_profile = 'Short' AND shares_outstanding > 0 GROUP BY 1, 2, 3, 4 HAVING sum(abs(shares)) > 0),
o AS (SELECT sector AS s, industry AS i FROM market_data WHERE ticker = '{TICKER}'),
u AS (SELECT 'ticker' AS series, b.* FROM b WHERE ticker = '{TICKER}' UNION ALL SELECT 'sector', b.* FROM b, o WHERE sector = s UNION ALL SELECT 'industry', b.* FROM b, o WHERE industry = i)
SELECT series, quarter, round(avg(pct), 8) AS pct FROM u GROUP BY 1, 2"""


def short_volume_comparison(t: Tables, ticker: str = TICKER) -> DataFrame:
    """Daily short share of volume of a ticker and the medians of its sector and industry."""
    md = t.market_data.select("ticker", "sector", "industry")
    own = t.market_data.where(F.col("ticker") == ticker).select(F.col("sector").alias("s"), F.col("industry").alias("i"))
    rows = t.short_interest.withColumn("short_pct", F.coalesce(ratio(F.col("short_volume"), F.col("total_volume"), 100), F.lit(0.0))).join(md, "ticker").crossJoin(own)
    return rows.groupBy("report_date").agg(F.max(F.when(F.col("ticker") == ticker, F.col("short_pct"))).alias("pct"), F.median(F.when(F.col("sector") == F.col("s"), F.col("short_pct"))).alias("sector_median"), F.median(F.when(F.col("industry") == F.col("i"), F.col("short_pct"))).alias("industry_median"))


SHORT_VOLUME = f"""r AS (SELECT s.*, coalesce(short_volume * 100.0::DOUBLE / nullif(total_volume, 0), 0) AS short_pct, sector, industry FROM short_interest s JOIN market_data m ON s.ticker = m.ticker),
o AS (SELECT sector AS s, industry AS i FROM market_data WHERE ticker = '{TICKER}')
SELECT report_date, max(CASE WHEN ticker = '{TICKER}' THEN short_pct END) AS pct, quantile_cont(CASE WHEN sector = s THEN short_pct END, 0.5) AS sector_median,
  quantile_cont(CASE WHEN industry = i THEN short_pct END, 0.5) AS industry_median FROM r, o GROUP BY 1"""


def short_volume_trailing(t: Tables) -> DataFrame:
    """Each ticker's latest short share of volume and its average over the 20 latest days it has."""
    rows = t.short_interest.withColumn("short_pct", F.coalesce(ratio(F.col("short_volume"), F.col("total_volume"), 100), F.lit(0.0)))
    last = top_n(rows, ["ticker"], [F.desc("report_date")], 20)
    return last.groupBy("ticker").agg(F.max(F.when(F.col("rank") == 1, F.col("short_pct"))).alias("latest_pct"), F.round(F.avg("short_pct"), 8).alias("avg_20"), F.count("*").alias("days"))


SHORT_TRAILING = """r AS (SELECT *, coalesce(short_volume * 100.0::DOUBLE / nullif(total_volume, 0), 0) AS p, row_number() OVER (PARTITION BY ticker ORDER BY report_date DESC) AS k FROM short_interest)
SELECT ticker, max(CASE WHEN k = 1 THEN p END) AS latest_pct, round(avg(p), 8) AS avg_20, count(*) AS days FROM r WHERE k <= 20 GROUP BY 1"""


def market_summary(t: Tables, quarter: str = LATEST, n: int = 25) -> DataFrame:
    """The n largest top parents with value, filers, tickers, and the fund value that sponsors' funds report."""
    rows = named(t, t.latest.where(F.col("quarter") == quarter))
    best = top_n(rows.groupBy("parent_name").agg(F.sum("market_value_usd").alias("total_aum"), F.count_distinct("cik").alias("filers"), F.count_distinct("ticker").alias("tickers")), [], [desc("total_aum"), F.asc("parent_name")], n)
    funds = named(t, t.fund_latest.where(F.col("quarter") == quarter).withColumn("inst_parent_name", F.lit(None).cast("string")).withColumn("manager_name", F.col("fund_name")).withColumn("entity_id", F.col("rollup_entity_id")))
    funds = funds.groupBy("parent_name").agg(F.sum("market_value_usd").alias("fund_aum"), F.count_distinct("series_id").alias("funds"))
    return best.join(funds, "parent_name", "left").withColumn("coverage_pct", F.least(F.lit(100.0), ratio(F.col("fund_aum"), F.col("total_aum"), 100)))


MARKET_SUMMARY = f"""{NAMED},
b AS (SELECT * FROM (SELECT parent_name, {S("market_value_usd")} AS total_aum, count(DISTINCT cik) AS filers, count(DISTINCT ticker) AS tickers, row_number() OVER (ORDER BY sum(market_value_usd) DESC, parent_name) AS rank
  FROM named WHERE quarter = '{LATEST}' GROUP BY 1) q WHERE rank <= 25),
f AS (SELECT coalesce(e.canonical_name, x.fund_name) AS parent_name, {S("market_value_usd")} AS fund_aum, count(DISTINCT series_id) AS funds FROM fund_holdings x LEFT JOIN tops t ON x.rollup_entity_id = t.entity_id
  LEFT JOIN entities e ON e.entity_id = t.top_parent_entity_id WHERE is_latest AND quarter = '{LATEST}' GROUP BY 1)
SELECT b.*, fund_aum, funds, least(100.0::DOUBLE, fund_aum * 100.0::DOUBLE / nullif(total_aum, 0)) AS coverage_pct FROM b LEFT JOIN f ON b.parent_name = f.parent_name"""


def crowding(t: Tables, ticker: str = TICKER, quarter: str = LATEST) -> DataFrame:
    """Top 20 (holder, type) pairs by share of shares outstanding."""
    by = at(named(t, t.latest), ticker, quarter).groupBy("parent_name", "manager_type", "ticker").agg(F.sum("shares").alias("shares"), F.sum("market_value_live").alias("value"))
    best = top_n(by, [], [desc("shares"), F.asc("parent_name"), F.asc_nulls_last("manager_type")], 20)
    return best.join(t.market_data.select("ticker", "shares_outstanding"), "ticker", "left").select("rank", F.col("parent_name").alias("holder"), "manager_type", ratio(F.col("shares"), F.col("shares_outstanding"), 100).alias("pct_so"), "value")


CROWDING = f"""{NAMED}, b AS (SELECT parent_name AS holder, manager_type, {S("shares")} AS shares, {S("market_value_live")} AS value FROM named WHERE ticker = '{TICKER}' AND quarter = '{LATEST}' GROUP BY 1, 2)
SELECT rank, holder, manager_type, shares * 100.0::DOUBLE / (SELECT shares_outstanding FROM market_data WHERE ticker = '{TICKER}') AS pct_so, value FROM
 (SELECT *, row_number() OVER (ORDER BY shares DESC NULLS LAST, holder, manager_type NULLS LAST) AS rank FROM b) q WHERE rank <= 20"""


def smart_money(t: Tables, ticker: str = TICKER, quarter: str = LATEST) -> DataFrame:
    """Long holdings by manager type against the latest short volume."""
    longs = at(t.latest, ticker, quarter).groupBy("ticker", "manager_type").agg(F.count_distinct("cik").alias("holders"), F.sum("shares").alias("long_shares"), F.sum("market_value_live").alias("long_value"))
    last = t.short_interest.where(F.col("ticker") == ticker).groupBy("ticker").agg(F.max_by("short_volume", "report_date").alias("short_volume"), F.max("report_date").alias("short_date"))
    return longs.join(last, "ticker", "left")


SMART_MONEY = f"""l AS (SELECT ticker, manager_type, count(DISTINCT cik) AS holders, {S("shares")} AS long_shares, {S("market_value_live")} AS long_value FROM holdings WHERE is_latest AND ticker = '{TICKER}' AND quarter = '{LATEST}' GROUP BY 1, 2),
s AS (SELECT ticker, arg_max(short_volume, report_date) AS short_volume, max(report_date) AS short_date FROM short_interest WHERE ticker = '{TICKER}' GROUP BY 1)
SELECT l.*, short_volume, short_date FROM l LEFT JOIN s ON l.ticker = s.ticker"""


def peer_tickers(t: Tables, ticker: str = TICKER) -> DataFrame:
    """Tickers of the same sector, and whether of the same industry too."""
    md = t.market_data.select("ticker", "sector", "industry")
    own = F.broadcast(md.where(F.col("ticker") == ticker).select(F.col("sector").alias("s"), F.col("industry").alias("i")))
    return md.where(F.col("ticker") != ticker).join(own, F.col("sector") == F.col("s")).select("ticker", "sector", "industry", (F.col("industry") == F.col("i")).alias("same_industry"))


PEERS = f"""SELECT m.ticker, m.sector, m.industry, m.industry = o.industry AS same_industry FROM market_data m JOIN market_data o ON m.sector = o.sector WHERE o.ticker = '{TICKER}' AND m.ticker <> '{TICKER}'"""


# --- common ownership -----------------------------------------------------

_GROUP = (TICKER, OTHER, "P15")


def cross_ownership(t: Tables, group: tuple[str, ...] = _GROUP, quarter: str = LATEST) -> DataFrame:
    """Investors by tickers of a group, with their total over the group and its share of the book; passive ones, and those of unknown type, are out."""
    rows = t.latest.where((F.col("quarter") == quarter) & (F.col("manager_type") != "passive"))
    wide = rows.where(F.col("ticker").isin(*group)).groupBy("cik").pivot("ticker", list(group)).agg(F.sum("market_value_live"))
    sums = F.lit(0).cast("bigint")
    for x in group:
        sums = sums + F.coalesce(x, F.lit(0))
    best = top_n(wide.withColumn("total_across", sums), [], [desc("total_across"), F.asc("cik")], 25)
    books = rows.join(F.broadcast(best.select("cik")), "cik", "left_semi").groupBy("cik").agg(F.sum("market_value_live").alias("book"), F.max("manager_name").alias("manager_name"))
    return best.join(books, "cik").withColumn("pct_of_portfolio", ratio(F.col("total_across"), F.col("book"), 100)).drop("book")


_CO = ", ".join(f"{S(f'''CASE WHEN ticker = '{x}' THEN market_value_live END''')} AS {x}" for x in _GROUP)
CROSS = f"""h AS (SELECT * FROM holdings WHERE is_latest AND quarter = '{LATEST}' AND manager_type <> 'passive'),
w AS (SELECT cik, {_CO}, {S("market_value_live")} AS total_across FROM h WHERE ticker IN {sql_list(_GROUP)} GROUP BY 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY total_across DESC, cik) AS rank FROM w) q WHERE rank <= 25),
k AS (SELECT cik, {S("market_value_live")} AS book, max(manager_name) AS manager_name FROM h GROUP BY 1)
SELECT b.*, manager_name, total_across * 100.0::DOUBLE / nullif(book, 0) AS pct_of_portfolio FROM b JOIN k ON b.cik = k.cik"""


def cross_fund_detail(t: Tables, group: tuple[str, ...] = _GROUP, quarter: str = LATEST) -> DataFrame:
    """The top five funds of each family over a group of tickers, with their values by ticker."""
    rows = t.fund_latest.where((F.col("quarter") == quarter) & F.col("ticker").isin(*group))
    by = rows.groupBy("family_name", "series_id", "ticker").agg(F.sum("market_value_usd").alias("value"))
    funds = by.groupBy("family_name", "series_id").agg(F.sum("value").alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("ticker", "value")))).alias("values"))
    best = top_n(funds, ["family_name"], [desc("total"), F.asc("series_id")], 5)
    return best.select("family_name", "rank", "series_id", "total", *[F.col("values")[x].alias(x) for x in group])


_CF = ", ".join(f"{S(f'''CASE WHEN ticker = '{x}' THEN market_value_usd END''')} AS {x}" for x in _GROUP)
CROSS_FUND = f"""f AS (SELECT family_name, series_id, {S("market_value_usd")} AS total, {_CF} FROM fund_holdings WHERE is_latest AND quarter = '{LATEST}' AND ticker IN {sql_list(_GROUP)} GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family_name ORDER BY total DESC, series_id) AS rank FROM f) q WHERE rank <= 5"""


def two_company_overlap(t: Tables, a: str = TICKER, b: str = OTHER, quarter: str = LATEST) -> DataFrame:
    """The 50 largest holders of one company with their position in another; is_active is null where the type is."""
    rows = t.latest.where((F.col("quarter") == quarter) & F.col("ticker").isin(a, b))
    pick = lambda x, c: F.sum(F.when(F.col("ticker") == x, F.col(c)))
    both = rows.groupBy("cik").agg(F.max("manager_name").alias("manager_name"), F.max("manager_type").alias("type"), pick(a, "shares").alias("a_shares"), pick(a, "market_value_live").alias("a_value"), pick(b, "shares").alias("b_shares"), pick(b, "market_value_live").alias("b_value")).where("a_shares is not null")
    best = top_n(both, [], [desc("a_value"), F.asc("cik")], 50)
    return best.withColumn("is_overlap", F.col("b_shares").isNotNull()).withColumn("is_active", F.col("type") != "passive")


_P = lambda x, c: S(f"CASE WHEN ticker = '{x}' THEN {c} END")
OVERLAP = f"""b AS (SELECT cik, max(manager_name) AS manager_name, max(manager_type) AS type, {_P(TICKER, "shares")} AS a_shares, {_P(TICKER, "market_value_live")} AS a_value, {_P(OTHER, "shares")} AS b_shares, {_P(OTHER, "market_value_live")} AS b_value
  FROM holdings WHERE is_latest AND quarter = '{LATEST}' AND ticker IN ('{TICKER}', '{OTHER}') GROUP BY 1)
SELECT *, b_shares IS NOT NULL AS is_overlap, type <> 'passive' AS is_active FROM (SELECT *, row_number() OVER (ORDER BY a_value DESC NULLS LAST, cik) AS rank FROM b WHERE a_shares IS NOT NULL) q WHERE rank <= 50"""


def overlap_institution_detail(t: Tables, a: str = TICKER, b: str = OTHER, quarter: str = LATEST) -> DataFrame:
    """Funds of each family that hold both companies, only the one or only the other: five of each."""
    rows = t.fund_latest.where((F.col("quarter") == quarter) & F.col("ticker").isin(a, b))
    pick = lambda x: F.sum(F.when(F.col("ticker") == x, F.col("market_value_usd")))
    both = rows.groupBy("family_name", "series_id").agg(pick(a).alias("a_value"), pick(b).alias("b_value"))
    bucket = F.when(F.col("a_value").isNull(), "b_only").when(F.col("b_value").isNull(), "a_only").otherwise("overlap")
    return top_n(both.withColumn("bucket", bucket), ["family_name", "bucket"], [F.desc(F.coalesce("a_value", F.lit(0)) + F.coalesce("b_value", F.lit(0))), F.asc("series_id")], 5)


OVERLAP_DETAIL = f"""b AS (SELECT family_name, series_id, {_P(TICKER, "market_value_usd")} AS a_value, {_P(OTHER, "market_value_usd")} AS b_value FROM fund_holdings WHERE is_latest AND quarter = '{LATEST}' AND ticker IN ('{TICKER}', '{OTHER}') GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN a_value IS NULL THEN 'b_only' WHEN b_value IS NULL THEN 'a_only' ELSE 'overlap' END AS bucket FROM b)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family_name, bucket ORDER BY coalesce(a_value, 0) + coalesce(b_value, 0) DESC, series_id) AS rank FROM c) q WHERE rank <= 5"""


def fund_portfolio_managers(t: Tables, ticker: str = TICKER, quarter: str = LATEST) -> DataFrame:
    """The 50 largest filers of a ticker that aren't passive (unknown types stay)."""
    rows = at(t.latest, ticker, quarter).where(F.coalesce("manager_type", F.lit("unknown")) != "passive")
    by = rows.groupBy("cik", "manager_name").agg(F.max("manager_type").alias("manager_type"), F.sum("market_value_live").alias("value"))
    return top_n(by, [], [desc("value"), F.asc("cik"), F.asc("manager_name")], 50)


MANAGERS = f"""b AS (SELECT cik, manager_name, max(manager_type) AS manager_type, {S("market_value_live")} AS value FROM holdings WHERE is_latest AND ticker = '{TICKER}' AND quarter = '{LATEST}' AND coalesce(manager_type, 'unknown') <> 'passive' GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY value DESC NULLS LAST, cik, manager_name) AS rank FROM b) q WHERE rank <= 50"""


def portfolio_context(t: Tables, ticker: str = TICKER, quarter: str = LATEST, benchmark: float = 20.0) -> DataFrame:
    """Conviction of the 25 largest holders: the subject's sector weight in their books against a benchmark, its ranks, and a score.

    Score: 40 points for the weight's excess over the benchmark (all at 50
    points over), 20, 10 or 5 for the sector's rank in the book, 15, 10 or 5
    each for the company's rank in its sector and in its industry.
    """
    rows = t.latest.where(F.col("quarter") == quarter)
    best = top_n(at(rows, ticker).groupBy("cik").agg(F.sum("market_value_live").alias("value")), [], [desc("value"), F.asc("cik")], 25)
    md = t.market_data.select("ticker", "sector", "industry")
    own = t.market_data.where(F.col("ticker") == ticker).select(F.col("sector").alias("s"), F.col("industry").alias("i"))
    book = rows.where("market_value_live > 0").join(F.broadcast(best.select("cik")), "cik", "left_semi").groupBy("cik", "ticker").agg(F.sum("market_value_live").alias("v")).join(md, "ticker", "left").crossJoin(own)
    book = book.withColumn("co_rank", F.row_number().over(Window.partitionBy("cik", "sector").orderBy(F.desc("v"), "ticker"))).withColumn("ind_rank", F.row_number().over(Window.partitionBy("cik", "industry").orderBy(F.desc("v"), "ticker")))
    subject = book.where(F.col("ticker") == ticker).select("cik", "co_rank", "ind_rank")
    sectors = book.where("sector is not null").groupBy("cik", "sector", "s").agg(F.sum("v").alias("sv"))
    sectors = sectors.withColumn("sector_rank", F.row_number().over(Window.partitionBy("cik").orderBy(F.desc("sv"), "sector"))).withColumn("diversity", F.count("*").over(Window.partitionBy("cik")))
    totals = book.groupBy("cik").agg(F.sum("v").alias("total"))
    out = best.join(subject, "cik").join(sectors.where("sector = s").select("cik", "sv", "sector_rank", "diversity"), "cik").join(totals, "cik")
    pct = ratio(F.col("sv"), F.col("total"), 100)
    points = lambda c, a, b, d: F.when(F.col(c) == 1, a).when(F.col(c) == 2, b).when(F.col(c) == 3, d).otherwise(0)
    score = F.greatest(F.lit(0.0), F.least((pct - benchmark) / 50 * 40, F.lit(40.0))) + points("sector_rank", 20, 10, 5) + points("co_rank", 15, 10, 5) + points("ind_rank", 15, 10, 5)
    return out.select("rank", "cik", "value", pct.alias("sector_pct"), (pct - benchmark).alias("vs_benchmark"), F.col("sector_rank").cast("bigint"), F.col("co_rank").cast("bigint"), F.col("ind_rank").cast("bigint"), "diversity", F.round(score, 6).alias("conviction_score"))


CONTEXT = f"""h AS (SELECT * FROM holdings WHERE is_latest AND quarter = '{LATEST}'),
x AS (SELECT * FROM (SELECT cik, {S("market_value_live")} AS value, row_number() OVER (ORDER BY sum(market_value_live) DESC, cik) AS rank FROM h WHERE ticker = '{TICKER}' GROUP BY 1) q WHERE rank <= 25),
b AS (SELECT h.cik, h.ticker, sector, industry, {S("market_value_live")} AS v FROM h JOIN x ON h.cik = x.cik LEFT JOIN market_data m ON h.ticker = m.ticker WHERE market_value_live > 0 GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY cik, sector ORDER BY v DESC, ticker) AS co_rank, row_number() OVER (PARTITION BY cik, industry ORDER BY v DESC, ticker) AS ind_rank FROM b),
s AS (SELECT cik, sector, {S("v")} AS sv, row_number() OVER (PARTITION BY cik ORDER BY sum(v) DESC, sector) AS sector_rank, count(*) OVER (PARTITION BY cik) AS diversity FROM b WHERE sector IS NOT NULL GROUP BY 1, 2),
j AS (SELECT rank, x.cik, value, sv * 100.0::DOUBLE / (SELECT sum(v) FROM b WHERE b.cik = x.cik)::DOUBLE AS sector_pct, sector_rank, co_rank, ind_rank, diversity
  FROM x JOIN r ON x.cik = r.cik AND r.ticker = '{TICKER}' JOIN s ON x.cik = s.cik AND s.sector = (SELECT sector FROM market_data WHERE ticker = '{TICKER}'))
SELECT *, sector_pct - 20 AS vs_benchmark, round(greatest(0, least((sector_pct - 20) / 50 * 40, 40)) + CASE sector_rank WHEN 1 THEN 20 WHEN 2 THEN 10 WHEN 3 THEN 5 ELSE 0 END
  + CASE co_rank WHEN 1 THEN 15 WHEN 2 THEN 10 WHEN 3 THEN 5 ELSE 0 END + CASE ind_rank WHEN 1 THEN 15 WHEN 2 THEN 10 WHEN 3 THEN 5 ELSE 0 END, 6) AS conviction_score FROM j"""

QUERIES = {
    "sector_summary": (sector_summary, statement(SECTOR_SUMMARY)),
    "fund_quarter_completeness": (fund_quarter_completeness, statement(COMPLETENESS)),
    "sector_monthly_flows": (sector_monthly_flows, statement(SECTOR_MONTHLY)),
    "short_trend": (short_trend, statement(SHORT_TREND)),
    "short_detail": (short_detail, statement(SHORT_DETAIL)),
    "short_long_cross": (short_long_cross, statement(SHORT_LONG)),
    "short_position_pct": (short_position_pct, statement(SHORT_PCT)),
    "short_volume_comparison": (short_volume_comparison, statement(SHORT_VOLUME)),
    "short_volume_trailing": (short_volume_trailing, statement(SHORT_TRAILING)),
    "market_summary": (market_summary, statement(MARKET_SUMMARY)),
    "crowding": (crowding, statement(CROWDING)),
    "smart_money": (smart_money, statement(SMART_MONEY)),
    "peer_tickers": (peer_tickers, statement(PEERS)),
    "cross_ownership": (cross_ownership, statement(CROSS)),
    "cross_fund_detail": (cross_fund_detail, statement(CROSS_FUND)),
    "two_company_overlap": (two_company_overlap, statement(OVERLAP)),
    "overlap_institution_detail": (overlap_institution_detail, statement(OVERLAP_DETAIL)),
    "fund_portfolio_managers": (fund_portfolio_managers, statement(MANAGERS)),
    "portfolio_context": (portfolio_context, statement(CONTEXT)),
}
