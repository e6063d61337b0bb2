"""The shareholder register: who holds a company, and how that changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONVICTION_ACTIVE, FIRST, LATEST, PREVIOUS, QUARTERS, SECTOR_MIX_ACTIVE, SUMMARY_ACTIVE, TICKER, sql_list
from ..functions.categories import fund_label, fund_label_sql, holder_bucket, holder_bucket_sql
from ..operators.relational import ratio, top_n
from ..sources.canonical import Tables, statement
from .common import NAMED, S, at, named

desc = F.desc_nulls_last


def query1_register(t: Tables, ticker: str = TICKER, quarter: str = LATEST) -> DataFrame:
    """Top 25 top-parents (level 0) with their first 5 funds (level 1), all-holder and per-type totals (level -1, -2)."""
    rows = at(named(t, t.latest), ticker, quarter).withColumn("type", F.coalesce("manager_type", F.lit("unknown")))
    rows = rows.groupBy("parent_name", "fund_name", "type").agg(F.sum("market_value_live").alias("value_live"), F.sum("shares").alias("shares"))
    parents = rows.groupBy("parent_name").agg(F.max("type").alias("type"), F.sum("value_live").alias("value_live"), F.sum("shares").alias("shares"), F.count_distinct("fund_name").alias("child_count"))
    best = top_n(parents, [], [desc("value_live"), F.asc("parent_name")], 25)
    funds = rows.groupBy("parent_name", "fund_name").agg(F.max("type").alias("type"), F.sum("value_live").alias("value_live"), F.sum("shares").alias("shares"))
    funds = top_n(funds.join(best.select("parent_name"), "parent_name", "left_semi"), ["parent_name"], [desc("value_live"), F.asc("fund_name")], 5)
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    level0 = best.select(F.lit(0).alias("level"), "rank", "parent_name", F.col("parent_name").alias("institution"), "type", "value_live", "shares", "child_count")
    level1 = funds.select(F.lit(1).alias("level"), "rank", "parent_name", F.col("fund_name").alias("institution"), "type", "value_live", "shares", zero.alias("child_count"))
    # type None: all holders
    totals = parents.rollup("type").agg(F.grouping("type").alias("all"), F.sum("value_live").alias("value_live"), F.sum("shares").alias("shares"), F.count("*").alias("child_count"))
    totals = totals.select((F.col("all") - 2).cast("int").alias("level"), none.alias("rank"), F.lit(None).cast("string").alias("parent_name"), F.lit("total").alias("institution"), "type", "value_live", "shares", "child_count")
    return level0.unionByName(level1).unionByName(totals)


QUERY1 = f"""{NAMED},
r AS (SELECT parent_name, fund_name, coalesce(manager_type, 'unknown') AS type, {S("market_value_live")} AS value_live, {S("shares")} AS shares
      FROM named WHERE ticker = '{TICKER}' AND quarter = '{LATEST}' GROUP BY ALL),
p AS (SELECT parent_name, max(type) AS type, {S("value_live")} AS value_live, {S("shares")} AS shares, count(DISTINCT fund_name) AS child_count FROM r GROUP BY 1),
b AS (SELECT *, row_number() OVER (ORDER BY value_live DESC NULLS LAST, parent_name) AS rank FROM p),
f AS (SELECT parent_name, fund_name, max(type) AS type, {S("value_live")} AS value_live, {S("shares")} AS shares FROM r
      WHERE parent_name IN (SELECT parent_name FROM b WHERE rank <= 25) GROUP BY 1, 2),
g AS (SELECT *, row_number() OVER (PARTITION BY parent_name ORDER BY value_live DESC NULLS LAST, fund_name) AS rank FROM f)
SELECT CAST(0 AS INTEGER) AS level, rank, parent_name, parent_name AS institution, type, value_live, shares, child_count FROM b WHERE rank <= 25
UNION ALL SELECT 1, rank, parent_name, fund_name, type, value_live, shares, 0 FROM g WHERE rank <= 5
UNION ALL SELECT CASE WHEN grouping(type) = 1 THEN -1 ELSE -2 END, NULL, NULL, 'total', type, {S("value_live")}, {S("shares")}, count(*) FROM p GROUP BY GROUPING SETS ((type), ())"""


def query2_holder_changes(t: Tables, ticker: str = TICKER, first: str = FIRST, last: str = LATEST, least: int = 40) -> DataFrame:
    """First against last quarter by filer: change, entries and exits of at least ``least`` shares (top 15 each), holders of the top 25 parents."""
    rows = at(named(t, t.latest), ticker).where(F.col("quarter").isin(first, last))
    by = rows.groupBy("cik", "manager_name", "parent_name").agg(
        F.max(F.coalesce("manager_type", F.lit("unknown"))).alias("type"),
        F.sum(F.when(F.col("quarter") == first, F.col("shares"))).alias("q1_shares"),
        F.sum(F.when(F.col("quarter") == last, F.col("shares"))).alias("q4_shares"),
        F.sum(F.when(F.col("quarter") == last, F.col("market_value_live"))).alias("v4"),
    )
    by = by.withColumn("change_shares", F.coalesce("q4_shares", F.lit(0)) - F.coalesce("q1_shares", F.lit(0)))
    pct = F.when((F.col("q1_shares") > 0) & F.col("q4_shares").isNotNull(), ratio(F.col("q4_shares") - F.col("q1_shares"), F.col("q1_shares"), 100)).when(F.col("q1_shares").isNotNull(), F.lit(-100.0))
    by = by.withColumn("change_pct", pct)
    best = top_n(by.groupBy("parent_name").agg(F.sum("v4").alias("v")).where("v is not null"), [], [desc("v"), F.asc("parent_name")], 25)
    kept = by.where("q1_shares is not null and q4_shares is not null").join(best.select("parent_name"), "parent_name", "left_semi").withColumn("section", F.lit("holders")).withColumn("rank", F.lit(None).cast("bigint"))
    entries = top_n(by.where(f"q1_shares is null and q4_shares >= {least}"), [], [F.desc("q4_shares"), F.asc("cik")], 15).withColumn("section", F.lit("entries"))
    exits = top_n(by.where(f"q4_shares is null and q1_shares >= {least}"), [], [F.desc("q1_shares"), F.asc("cik")], 15).withColumn("section", F.lit("exits"))
    return kept.unionByName(entries).unionByName(exits).select("section", "rank", "cik", "manager_name", "parent_name", "type", "q1_shares", "q4_shares", "change_shares", "change_pct")


QUERY2 = f"""{NAMED},
b AS (SELECT cik, manager_name, parent_name, max(coalesce(manager_type, 'unknown')) AS type,
        {S(f"CASE WHEN quarter = '{FIRST}' THEN shares END")} AS q1_shares, {S(f"CASE WHEN quarter = '{LATEST}' THEN shares END")} AS q4_shares,
        {S(f"CASE WHEN quarter = '{LATEST}' THEN market_value_live END")} AS v4
      FROM named WHERE ticker = '{TICKER}' AND quarter IN ('{FIRST}', '{LATEST}') GROUP BY 1, 2, 3),
c AS (SELECT *, coalesce(q4_shares, 0) - coalesce(q1_shares, 0) AS change_shares,
        CASE WHEN q1_shares > 0 AND q4_shares IS NOT NULL THEN (q4_shares - q1_shares) * 100.0::DOUBLE / q1_shares WHEN q1_shares IS NOT NULL THEN -100.0::DOUBLE END AS change_pct FROM b),
p AS (SELECT parent_name FROM (SELECT parent_name, sum(v4) AS v FROM c GROUP BY 1 HAVING sum(v4) IS NOT NULL) q ORDER BY v DESC, parent_name LIMIT 25),
u AS (SELECT 'holders' AS section, CAST(NULL AS BIGINT) AS rank, * FROM c WHERE q1_shares IS NOT NULL AND q4_shares IS NOT NULL AND parent_name IN (SELECT parent_name FROM p)
  UNION ALL SELECT * FROM (SELECT 'entries', row_number() OVER (ORDER BY q4_shares DESC, cik) AS rank, * FROM c WHERE q1_shares IS NULL AND q4_shares >= 40) e WHERE rank <= 15
  UNION ALL SELECT * FROM (SELECT 'exits', row_number() OVER (ORDER BY q1_shares DESC, cik) AS rank, * FROM c WHERE q4_shares IS NULL AND q1_shares >= 40) e WHERE rank <= 15)
SELECT section, rank, cik, manager_name, parent_name, type, q1_shares, q4_shares, change_shares, change_pct FROM u"""


def query3_conviction(t: Tables, ticker: str = TICKER, quarter: str = LATEST, first: str = FIRST) -> DataFrame:
    """Top 15 active filers: the target's market-cap percentile in each book, quarters held, direction of the position."""
    caps = t.market_data.where("market_cap > 0").select("ticker", "market_cap")
    target = F.broadcast(t.market_data.where(F.col("ticker") == ticker).select(F.coalesce("market_cap", F.lit(0)).alias("target")))
    rows = t.latest
    best = at(rows, ticker, quarter).where(F.col("entity_type").isin(*CONVICTION_ACTIVE)).groupBy("cik").agg(F.max("manager_name").alias("manager_name"), F.max("manager_type").alias("manager_type"), F.sum("market_value_live").alias("position_value"), F.sum("shares").alias("shares"))
    best = top_n(best, [], [desc("position_value"), F.asc("cik")], 15)
    book = rows.where((F.col("quarter") == quarter) & F.col("security_type_inferred").isin("equity", "etf")).join(best.select("cik"), "cik", "left_semi").join(caps, "ticker").crossJoin(target)
    book = book.groupBy("cik").agg(F.count_if(F.col("market_cap") <= F.col("target")).alias("below"), F.count("*").alias("held"))
    past = at(rows, ticker).where(F.col("quarter").isin(*QUARTERS) & (F.col("shares") > 0)).join(best.select("cik"), "cik", "left_semi").groupBy("cik", "quarter").agg(F.sum("shares").alias("s"))
    past = past.groupBy("cik").agg(F.min("quarter").alias("since"), F.count("*").alias("held_count"), F.max(F.when(F.col("quarter") == first, F.col("s"))).alias("from_shares"))
    change = ratio(F.col("shares") - F.col("from_shares"), F.col("from_shares"))
    direction = F.when(F.col("from_shares").isNull(), "NEW").when(change > 0.05, "ADDING").when(change < -0.05, "TRIMMING").otherwise("STABLE")
    return best.join(book, "cik", "left").join(past, "cik", "left").select("rank", "cik", "manager_name", "manager_type", "position_value", ratio(F.col("below"), F.col("held"), 100).alias("mktcap_percentile"), "since", "held_count", direction.alias("direction"))


QUERY3 = f"""h AS (SELECT * FROM holdings WHERE is_latest),
b AS (SELECT * FROM (SELECT cik, max(manager_name) AS manager_name, max(manager_type) AS manager_type, {S("market_value_live")} AS position_value, {S("shares")} AS shares,
        row_number() OVER (ORDER BY sum(market_value_live) DESC NULLS LAST, cik) AS rank FROM h
      WHERE ticker = '{TICKER}' AND quarter = '{LATEST}' AND entity_type IN {sql_list(CONVICTION_ACTIVE)} GROUP BY cik) q WHERE rank <= 15),
k AS (SELECT h.cik, count(*) FILTER (WHERE m.market_cap <= (SELECT coalesce(market_cap, 0) FROM market_data WHERE ticker = '{TICKER}')) AS below, count(*) AS held
      FROM h JOIN market_data m ON h.ticker = m.ticker WHERE m.market_cap > 0 AND h.quarter = '{LATEST}' AND h.security_type_inferred IN ('equity', 'etf') GROUP BY 1),
p AS (SELECT cik, min(quarter) AS since, count(*) AS held_count, max(CASE WHEN quarter = '{FIRST}' THEN s END) AS from_shares FROM
      (SELECT cik, quarter, {S("shares")} AS s FROM h WHERE ticker = '{TICKER}' AND shares > 0 AND quarter IN {sql_list(QUARTERS)} GROUP BY 1, 2) q GROUP BY 1)
SELECT rank, b.cik, manager_name, manager_type, position_value, below * 100.0::DOUBLE / nullif(held, 0) AS mktcap_percentile, since, held_count,
  CASE WHEN from_shares IS NULL THEN 'NEW' WHEN (shares - from_shares)::DOUBLE / from_shares > 0.05 THEN 'ADDING'
       WHEN (shares - from_shares)::DOUBLE / from_shares < -0.05 THEN 'TRIMMING' ELSE 'STABLE' END AS direction
FROM b LEFT JOIN k ON b.cik = k.cik LEFT JOIN p ON b.cik = p.cik"""


def query4_active_passive(t: Tables, ticker: str = TICKER, quarter: str = LATEST) -> DataFrame:
    """Holdings of a ticker by holder bucket, with the share of all."""
    rows = at(t.latest, ticker, quarter).groupBy(holder_bucket().alias("category")).agg(F.count_distinct("cik").alias("num_holders"), F.sum("shares").alias("total_shares"), F.sum("market_value_live").alias("total_value"))
    return rows.withColumn("pct_of_inst", ratio(F.col("total_value"), F.sum("total_value").over(Window.partitionBy()), 100))


QUERY4 = f"""r AS (SELECT {holder_bucket_sql()} AS category, count(DISTINCT cik) AS num_holders, {S("shares")} AS total_shares, {S("market_value_live")} AS total_value
      FROM holdings WHERE ticker = '{TICKER}' AND quarter = '{LATEST}' AND is_latest GROUP BY 1)
SELECT *, total_value * 100.0::DOUBLE / nullif(CAST(sum(total_value) OVER () AS DOUBLE), 0) AS pct_of_inst FROM r"""


def query5_heatmap(t: Tables, ticker: str = TICKER) -> DataFrame:
    """Shares of the top 25 filers over four quarters, and the changes."""
    rows = at(t.latest, ticker).where(F.col("quarter").isin(*QUARTERS))
    names = [f"q{k + 1}_shares" for k in range(4)]
    wide = rows.groupBy("cik", "manager_name").pivot("quarter", list(QUARTERS)).agg(F.sum("shares")).withColumnsRenamed(dict(zip(QUARTERS, names, strict=True)))
    wide = top_n(wide, [], [desc(names[3]), F.asc("cik"), F.asc("manager_name")], 25)
    return wide.withColumns({f"q{k + 1}_change": F.col(names[k]) - F.col(names[k - 1]) for k in (1, 2, 3)})


_Q5 = ", ".join(f"{S(f'''CASE WHEN quarter = '{q}' THEN shares END''')} AS q{k + 1}_shares" for k, q in enumerate(QUARTERS))
QUERY5 = f"""w AS (SELECT cik, manager_name, {_Q5} FROM holdings WHERE ticker = '{TICKER}' AND quarter IN {sql_list(QUARTERS)} AND is_latest GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY q4_shares DESC NULLS LAST, cik, manager_name) AS rank,
  q2_shares - q1_shares AS q2_change, q3_shares - q2_shares AS q3_change, q4_shares - q3_shares AS q4_change FROM w) q WHERE rank <= 25"""


def query6_activist(t: Tables, ticker: str = TICKER) -> DataFrame:
    """Filings of each kind against a ticker: the latest of every filer, by section."""
    rows = t.beneficial.where(F.col("subject_ticker") == ticker)
    kind = F.when(F.col("filing_type").startswith("SC 13D"), "13d").otherwise("13g")
    last = top_n(rows.withColumn("section", kind), ["section", "filer_cik"], [F.desc("filing_date"), F.desc("accession_number")], 1).drop("rank")
    return last.select("section", "filer_cik", "accession_number", "filing_type", "filing_date", "shares_owned")


QUERY6 = f"""k AS (SELECT CASE WHEN filing_type LIKE 'SC 13D%' THEN '13d' ELSE '13g' END AS section, * FROM beneficial WHERE subject_ticker = '{TICKER}')
SELECT section, filer_cik, accession_number, filing_type, filing_date, shares_owned FROM
  (SELECT *, row_number() OVER (PARTITION BY section, filer_cik ORDER BY filing_date DESC, accession_number DESC) AS n FROM k) q WHERE n = 1"""


def query7_portfolio(t: Tables, ticker: str = TICKER, quarter: str = LATEST) -> DataFrame:
    """The book of a ticker's largest non-passive holder by ticker, with sector and share of the book."""
    rows = t.latest.where(F.col("quarter") == quarter)
    holder = at(rows, ticker).where("manager_type <> 'passive'").groupBy("cik").agg(F.sum("market_value_live").alias("v")).orderBy(F.desc("v"), "cik").limit(1).select("cik")
    book = rows.join(F.broadcast(holder), "cik", "left_semi").groupBy("cik", "ticker").agg(F.sum("shares").alias("shares"), F.sum("market_value_live").alias("value"))
    book = book.join(t.market_data.select("ticker", "sector", "market_cap"), "ticker", "left")
    book = book.withColumn("pct_of_portfolio", ratio(F.col("value"), F.sum("value").over(Window.partitionBy("cik")), 100))
    w = Window.partitionBy("cik").orderBy(desc("value"), "ticker")
    return book.withColumn("rank", F.row_number().over(w).cast("bigint"))


QUERY7 = f"""h AS (SELECT * FROM holdings WHERE is_latest AND quarter = '{LATEST}'),
x AS (SELECT cik FROM (SELECT cik, sum(market_value_live) AS v FROM h WHERE ticker = '{TICKER}' AND manager_type <> 'passive' GROUP BY 1) q ORDER BY v DESC, cik LIMIT 1),
b AS (SELECT h.cik, ticker, {S("shares")} AS shares, {S("market_value_live")} AS value FROM h JOIN x ON h.cik = x.cik GROUP BY 1, 2)
SELECT b.*, sector, market_cap, value * 100.0::DOUBLE / nullif(CAST(sum(value) OVER () AS DOUBLE), 0) AS pct_of_portfolio,
  row_number() OVER (ORDER BY value DESC NULLS LAST, b.ticker) AS rank FROM b LEFT JOIN market_data m ON b.ticker = m.ticker"""


def query8_overlap(t: Tables, ticker: str = TICKER, quarter: str = LATEST) -> DataFrame:
    """Other tickers that the holders of a ticker hold: top 20 by shared holders."""
    rows = t.latest.where(F.col("quarter") == quarter).select("cik", "ticker", "market_value_live")
    holders = at(rows, ticker).select("cik").distinct()
    shared = rows.where(F.col("ticker") != ticker).join(holders, "cik", "left_semi").groupBy("ticker").agg(F.count_distinct("cik").alias("shared_holders"), F.sum("market_value_live").alias("total_value"))
    count = F.broadcast(holders.agg(F.count("*").alias("n")))
    best = top_n(shared, [], [F.desc("shared_holders"), F.asc("ticker")], 20)
    return best.crossJoin(count).withColumn("overlap_pct", ratio(F.col("shared_holders"), F.col("n"), 100)).drop("n")


QUERY8 = f"""h AS (SELECT * FROM holdings WHERE is_latest AND quarter = '{LATEST}'), x AS (SELECT DISTINCT cik FROM h WHERE ticker = '{TICKER}'),
s AS (SELECT ticker, count(DISTINCT cik) AS shared_holders, {S("market_value_live")} AS total_value FROM h WHERE ticker <> '{TICKER}' AND cik IN (SELECT cik FROM x) GROUP BY 1)
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY shared_holders DESC, ticker) AS rank, shared_holders * 100.0::DOUBLE / (SELECT count(*) FROM x) AS overlap_pct FROM s) q WHERE rank <= 20"""


def query9_sector_rotation(t: Tables, ticker: str = TICKER, quarter: str = LATEST) -> DataFrame:
    """Sector mix of the active holders of a ticker."""
    rows = t.latest.where(F.col("quarter") == quarter)
    holders = at(rows, ticker).where(F.col("entity_type").isin(*SECTOR_MIX_ACTIVE)).select("cik").distinct()
    mix = rows.join(holders, "cik", "left_semi").join(t.market_data.select("ticker", "sector"), "ticker").groupBy("sector").agg(F.count_distinct("ticker").alias("num_stocks"), F.sum("market_value_live").alias("total_value"))
    return mix.withColumn("pct_of_total", ratio(F.col("total_value"), F.sum("total_value").over(Window.partitionBy()), 100))


QUERY9 = f"""h AS (SELECT * FROM holdings WHERE is_latest AND quarter = '{LATEST}'),
m AS (SELECT d.sector, count(DISTINCT h.ticker) AS num_stocks, {S("market_value_live")} AS total_value FROM h JOIN market_data d ON h.ticker = d.ticker
      WHERE cik IN (SELECT cik FROM h WHERE ticker = '{TICKER}' AND entity_type IN {sql_list(SECTOR_MIX_ACTIVE)}) GROUP BY 1)
SELECT *, total_value * 100.0::DOUBLE / nullif(CAST(sum(total_value) OVER () AS DOUBLE), 0) AS pct_of_total FROM m"""


def _only_in(t: Tables, ticker: str, here: str, gone: str) -> DataFrame:
    a = at(t.latest, ticker, here).groupBy("cik", "manager_name").agg(F.max("manager_type").alias("manager_type"), F.sum("shares").alias("shares"), F.sum("market_value_live").alias("value"))
    return top_n(a.join(at(t.latest, ticker, gone).select("cik").distinct(), "cik", "left_anti"), [], [desc("value"), F.asc("cik"), F.asc("manager_name")], 25)


def query10_new_positions(t: Tables, ticker: str = TICKER) -> DataFrame:
    """Holders of the latest quarter that held nothing in the one before."""
    return _only_in(t, ticker, LATEST, PREVIOUS)


def query11_exits(t: Tables, ticker: str = TICKER) -> DataFrame:
    """Holders of the previous quarter that are gone in the latest."""
    return _only_in(t, ticker, PREVIOUS, LATEST)


def _only_in_sql(here: str, gone: str) -> str:
    return f"""h AS (SELECT * FROM holdings WHERE is_latest AND ticker = '{TICKER}')
SELECT * FROM (SELECT cik, manager_name, max(manager_type) AS manager_type, {S("shares")} AS shares, {S("market_value_live")} AS value,
  row_number() OVER (ORDER BY sum(market_value_live) DESC NULLS LAST, cik, manager_name) AS rank FROM h
  WHERE quarter = '{here}' AND NOT EXISTS (SELECT 1 FROM h g WHERE g.quarter = '{gone}' AND g.cik = h.cik) GROUP BY 1, 2) q WHERE rank <= 25"""


def query12_concentration(t: Tables, ticker: str = TICKER, quarter: str = LATEST) -> DataFrame:
    """Top 20 parents with their share of all held shares and the running share."""
    by = at(named(t, t.latest), ticker, quarter).groupBy("parent_name").agg(F.sum("shares").alias("shares"))
    whole = F.broadcast(by.agg(F.sum("shares").alias("whole")))
    best = top_n(by, [], [desc("shares"), F.asc("parent_name")], 20).crossJoin(whole)
    run = F.sum("shares").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return best.select("rank", "parent_name", "shares", ratio(F.col("shares"), F.col("whole"), 100).alias("pct"), ratio(run, F.col("whole"), 100).alias("cumulative_pct"))


QUERY12 = f"""{NAMED}, b AS (SELECT parent_name, {S("shares")} AS shares FROM named WHERE ticker = '{TICKER}' AND quarter = '{LATEST}' GROUP BY 1)
SELECT * FROM (SELECT row_number() OVER o AS rank, parent_name, shares, shares * 100.0::DOUBLE / (SELECT sum(shares) FROM b)::DOUBLE AS pct,
  CAST(sum(shares) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) * 100.0::DOUBLE / (SELECT sum(shares) FROM b)::DOUBLE AS cumulative_pct
  FROM b WINDOW o AS (ORDER BY shares DESC NULLS LAST, parent_name)) q WHERE rank <= 20"""


def query14_aum_position(t: Tables, ticker: str = TICKER, quarter: str = LATEST) -> DataFrame:
    """Top 25 holders with their managed assets and the position's share of them."""
    by = at(t.latest, ticker, quarter).groupBy("cik", "manager_name").agg(F.max("manager_type").alias("manager_type"), F.sum("market_value_live").alias("position_value"))
    best = top_n(by, [], [desc("position_value"), F.asc("cik"), F.asc("manager_name")], 25)
    return best.join(t.managers.select("cik", "is_activist", "aum_total"), "cik", "left").withColumn("pct_of_aum", ratio(F.col("position_value"), F.col("aum_total"), 100))


QUERY14 = f"""b AS (SELECT * FROM (SELECT cik, manager_name, max(manager_type) AS manager_type, {S("market_value_live")} AS position_value,
  row_number() OVER (ORDER BY sum(market_value_live) DESC NULLS LAST, cik, manager_name) AS rank FROM holdings
  WHERE is_latest AND ticker = '{TICKER}' AND quarter = '{LATEST}' GROUP BY 1, 2) q WHERE rank <= 25)
SELECT b.*, is_activist, aum_total, position_value * 100.0::DOUBLE / nullif(aum_total::DOUBLE, 0) AS pct_of_aum FROM b LEFT JOIN managers m ON b.cik = m.cik"""


def query15_db_stats(t: Tables) -> DataFrame:
    """Rows, filers, tickers, value and coverage of each quarter, all rows counted (superseded ones too)."""
    return t.holdings.groupBy("quarter").agg(
        F.count("*").alias("n_rows"), F.count_if("is_latest").alias("n_latest"), F.count_distinct("cik").alias("filers"), F.count_distinct("ticker").alias("tickers"),
        F.sum("market_value_usd").alias("total_value"), ratio(F.count("manager_type"), F.count("*"), 100).alias("typed_pct"))


QUERY15 = f"""SELECT quarter, count(*) AS n_rows, count(*) FILTER (WHERE is_latest) AS n_latest, count(DISTINCT cik) AS filers, count(DISTINCT ticker) AS tickers,
  {S("market_value_usd")} AS total_value, count(manager_type) * 100.0::DOUBLE / count(*) AS typed_pct FROM holdings GROUP BY 1"""


def query16_fund_register(t: Tables, ticker: str = TICKER, quarter: str = LATEST) -> DataFrame:
    """Top 25 funds (level 0), all-fund (-1) and per-label totals (-2)."""
    by = at(t.fund_latest, ticker, quarter).groupBy("series_id", "fund_name").agg(F.max("fund_strategy").alias("s"), F.sum("market_value_usd").alias("value"), F.sum("shares").alias("shares"))
    by = by.withColumn("label", fund_label("s")).drop("s")
    best = top_n(by, [], [desc("value"), F.asc("series_id")], 25).withColumn("level", F.lit(0)).withColumn("n", F.lit(1).cast("bigint"))
    totals = by.rollup("label").agg((F.grouping("label") - 2).cast("int").alias("level"), F.sum("value").alias("value"), F.sum("shares").alias("shares"), F.count("*").alias("n"))
    return best.unionByName(totals, allowMissingColumns=True).select("level", "rank", "series_id", "fund_name", "label", "value", "shares", "n")


QUERY16 = f"""b AS (SELECT series_id, fund_name, {fund_label_sql("max(fund_strategy)")} AS label, {S("market_value_usd")} AS value, {S("shares")} AS shares
      FROM fund_holdings WHERE is_latest AND ticker = '{TICKER}' AND quarter = '{LATEST}' GROUP BY 1, 2)
SELECT 0 AS level, rank, series_id, fund_name, label, value, shares, CAST(1 AS BIGINT) AS n FROM (SELECT *, row_number() OVER (ORDER BY value DESC NULLS LAST, series_id) AS rank FROM b) q WHERE rank <= 25
UNION ALL SELECT CASE WHEN grouping(label) = 1 THEN -1 ELSE -2 END, NULL, NULL, NULL, label, {S("value")}, {S("shares")}, count(*) FROM b GROUP BY GROUPING SETS ((label), ())"""


def summary_card(t: Tables, ticker: str = TICKER, quarter: str = LATEST) -> DataFrame:
    """A ticker's header: holders, shares, value, active and passive value, share of shares outstanding."""
    rows = at(t.latest, ticker, quarter).groupBy("ticker").agg(
        F.count_distinct("cik").alias("num_holders"), F.sum("shares").alias("total_shares"), F.sum("market_value_live").alias("total_value"),
        F.sum(F.when(F.col("manager_type").isin(*SUMMARY_ACTIVE), F.col("market_value_live")).otherwise(0)).alias("active_value"),
        F.sum(F.when(F.col("manager_type") == "passive", F.col("market_value_live")).otherwise(0)).alias("passive_value"))
    return rows.join(t.market_data.select("ticker", "issuer_name", "shares_outstanding"), "ticker", "left").withColumn("pct_of_so", ratio(F.col("total_shares"), F.col("shares_outstanding"), 100))


SUMMARY = f"""r AS (SELECT ticker, count(DISTINCT cik) AS num_holders, {S("shares")} AS total_shares, {S("market_value_live")} AS total_value,
  {S(f"CASE WHEN manager_type IN {sql_list(SUMMARY_ACTIVE)} THEN market_value_live ELSE 0 END")} AS active_value,
  {S("CASE WHEN manager_type = 'passive' THEN market_value_live ELSE 0 END")} AS passive_value
  FROM holdings WHERE is_latest AND ticker = '{TICKER}' AND quarter = '{LATEST}' GROUP BY 1)
SELECT r.*, issuer_name, shares_outstanding, total_shares * 100.0::DOUBLE / nullif(shares_outstanding::DOUBLE, 0) AS pct_of_so FROM r LEFT JOIN market_data m ON r.ticker = m.ticker"""


def tickers(t: Tables) -> DataFrame:
    """Every ticker with its most frequent manager type, ties to the first by name (unlike a plain mode)."""
    counts = t.latest.where("manager_type is not null").groupBy("ticker", "manager_type").agg(F.count("*").alias("n"))
    return top_n(counts, ["ticker"], [F.desc("n"), F.asc("manager_type")], 1).select("ticker", F.col("manager_type").alias("modal_type"), "n")


TICKERS = """c AS (SELECT ticker, manager_type AS modal_type, count(*) AS n FROM holdings WHERE is_latest AND manager_type IS NOT NULL GROUP BY 1, 2)
SELECT ticker, modal_type, n FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY n DESC, modal_type) AS k FROM c) q WHERE k = 1"""

QUERIES = {
    "query1_register": (query1_register, statement(QUERY1)),
    "query2_holder_changes": (query2_holder_changes, statement(QUERY2)),
    "query3_conviction": (query3_conviction, statement(QUERY3)),
    "query4_active_passive": (query4_active_passive, statement(QUERY4)),
    "query5_heatmap": (query5_heatmap, statement(QUERY5)),
    "query6_activist": (query6_activist, statement(QUERY6)),
    "query7_portfolio": (query7_portfolio, statement(QUERY7)),
    "query8_overlap": (query8_overlap, statement(QUERY8)),
    "query9_sector_rotation": (query9_sector_rotation, statement(QUERY9)),
    "query10_new_positions": (query10_new_positions, statement(_only_in_sql(LATEST, PREVIOUS))),
    "query11_exits": (query11_exits, statement(_only_in_sql(PREVIOUS, LATEST))),
    "query12_concentration": (query12_concentration, statement(QUERY12)),
    "query14_aum_position": (query14_aum_position, statement(QUERY14)),
    "query15_db_stats": (query15_db_stats, statement(QUERY15)),
    "query16_fund_register": (query16_fund_register, statement(QUERY16)),
    "summary_card": (summary_card, statement(SUMMARY)),
    "tickers": (tickers, statement(TICKERS)),
}
