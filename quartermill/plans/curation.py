"""Curation of dimensions: universes, classification, merges, overrides, gates and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LATEST, PREVIOUS, QUARTERS, TICKER, sql_list
from ..operators import promote
from ..operators.relational import open_rows, ratio, top_n
from ..sources.canonical import Tables, statement
from .common import S

desc = F.desc_nulls_last


def query13_sector_movers(t: Tables, sector: str = "ECONOMY", least: int = 5) -> DataFrame:
    """Buyers, sellers and new holders of each stock of a sector between the last two quarters, of stocks with enough movers."""
    rows = t.latest.where(F.col("quarter").isin(PREVIOUS, LATEST)).join(t.market_data.where(F.col("sector") == sector).select("ticker"), "ticker", "left_semi")
    pick = lambda q: F.sum(F.when(F.col("quarter") == q, F.col("shares")))
    by = rows.groupBy("ticker", "cik").agg(pick(PREVIOUS).alias("p"), pick(LATEST).alias("c")).where("c is not null")
    out = by.groupBy("ticker").agg(F.count_if(F.expr("p is not null and c > p")).alias("buyers"), F.count_if(F.expr("p is not null and c < p")).alias("sellers"), F.count_if(F.expr("p is null")).alias("new"))
    return out.where(f"buyers + sellers + new >= {least}")


QUERY13 = f"""b AS (SELECT h.ticker, cik, {S(f"CASE WHEN quarter = '{PREVIOUS}' THEN shares END")} AS p, {S(f"CASE WHEN quarter = '{LATEST}' THEN shares END")} AS c FROM holdings h JOIN market_data m ON h.ticker = m.ticker
  WHERE is_latest AND sector = 'ECONOMY' AND quarter IN ('{PREVIOUS}', '{LATEST}') GROUP BY 1, 2)
SELECT ticker, count(*) FILTER (WHERE p IS NOT NULL AND c > p) AS buyers, count(*) FILTER (WHERE p IS NOT NULL AND c < p) AS sellers, count(*) FILTER (WHERE p IS NULL) AS new
FROM b WHERE c IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (WHERE p IS NULL OR c <> p) >= 5"""


def nport_position(t: Tables, ticker: str = TICKER, quarter: str = LATEST) -> DataFrame:
    """Shares and value that each fund family reports of a ticker: the largest report of each series, then summed."""
    one = t.fund_latest.where((F.col("ticker") == ticker) & (F.col("quarter") == quarter)).groupBy("family_name", "series_id").agg(F.max("shares").alias("shares"), F.max("market_value_usd").alias("value"))
    return one.groupBy("family_name").agg(F.sum("shares").alias("shares"), F.sum("value").alias("value"), F.count("*").alias("funds"))


NPORT_POSITION = f"""o AS (SELECT family_name, series_id, max(shares) AS shares, max(market_value_usd) AS value FROM fund_holdings WHERE is_latest AND ticker = '{TICKER}' AND quarter = '{LATEST}' GROUP BY 1, 2)
SELECT family_name, {S("shares")} AS shares, {S("value")} AS value, count(*) AS funds FROM o GROUP BY 1"""


def fund_children_of_parents(t: Tables, ticker: str = TICKER, quarter: str = LATEST, least: float = 10.0) -> DataFrame:
    """Children of each parent in a ticker: its sponsored funds if they cover at least ``least`` percent of its shares, else its 13F filers; five of each.

    The sub-advised are left out. One pass for all parents.
    """
    sponsor = open_rows(t.relationships).where("relationship_type = 'fund_sponsor'").select(F.col("child_entity_id").alias("entity_id"), F.col("parent_entity_id").alias("rid"))
    at = (F.col("ticker") == ticker) & (F.col("quarter") == quarter)
    filers = t.latest.where(at & F.col("rollup_entity_id").isNotNull()).groupBy(F.col("rollup_entity_id").alias("rid"), F.col("manager_name").alias("institution")).agg(F.sum("shares").alias("shares"), F.sum("market_value_usd").alias("value"))
    funds = t.fund_latest.where(at).join(sponsor, "entity_id").groupBy("rid", F.col("fund_name").alias("institution")).agg(F.sum("shares").alias("shares"), F.sum("market_value_usd").alias("value"))
    a, b = filers.groupBy("rid").agg(F.sum("shares").alias("held")), funds.groupBy("rid").agg(F.sum("shares").alias("reported"))
    choice = a.join(b, "rid", "left").select("rid", (F.coalesce(ratio(F.col("reported"), F.col("held"), 100), F.lit(0.0)) >= least).alias("by_fund"))
    rows = funds.withColumn("source", F.lit("N-PORT")).unionByName(filers.withColumn("source", F.lit("13F"))).join(choice, "rid")
    kept = rows.where((F.col("source") == "N-PORT") == F.col("by_fund"))
    return top_n(kept, ["rid"], [desc("value"), F.asc("institution")], 5).drop("by_fund")


CHILDREN = f"""a AS (SELECT rollup_entity_id AS rid, manager_name AS institution, {S("shares")} AS shares, {S("market_value_usd")} AS value, '13F' AS source FROM holdings WHERE is_latest AND ticker = '{TICKER}' AND quarter = '{LATEST}' AND rollup_entity_id IS NOT NULL GROUP BY 1, 2),
b AS (SELECT r.parent_entity_id AS rid, fund_name AS institution, {S("shares")} AS shares, {S("market_value_usd")} AS value, 'N-PORT' AS source FROM fund_holdings f JOIN relationships r ON r.child_entity_id = f.entity_id
  WHERE is_latest AND ticker = '{TICKER}' AND quarter = '{LATEST}' AND relationship_type = 'fund_sponsor' AND valid_to = DATE '9999-12-31' GROUP BY 1, 2),
c AS (SELECT x.rid, coalesce((SELECT sum(shares) FROM b WHERE b.rid = x.rid) * 100.0::DOUBLE / nullif(held, 0), 0) >= 10 AS by_fund FROM (SELECT rid, sum(shares) AS held FROM a GROUP BY 1) x),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT rid, institution, shares, value, source, rank FROM (SELECT u.*, row_number() OVER (PARTITION BY u.rid ORDER BY value DESC NULLS LAST, institution) AS rank FROM u JOIN c ON u.rid = c.rid WHERE (source = 'N-PORT') = by_fund) q WHERE rank <= 5"""


def cusip_universe(t: Tables) -> DataFrame:
    """Every security of both fact tables with its most frequent issuer name (ties: the longer, then the first) and category seed."""
    parts = t.base("part").select((F.col("p_partkey") % 40).alias("k"), F.col("p_name").alias("name"))
    cusip = F.lpad(F.col("k").cast("string"), 9, "0")
    names = parts.groupBy(cusip.alias("cusip"), "name").agg(F.count("*").alias("n"))
    pick = top_n(names, ["cusip"], [F.desc("n"), F.desc(F.length("name")), F.asc("name")], 1).select("cusip", F.col("name").alias("issuer_name"))
    seeds = t.holdings.select("cusip", F.lit(None).cast("string").alias("seed")).unionByName(t.fund_holdings.select("cusip", F.col("asset_category").alias("seed"))).where("length(cusip) = 9")
    return seeds.groupBy("cusip").agg(F.max("seed").alias("asset_category_seed"), F.count("*").alias("n_rows")).join(pick, "cusip", "left")


UNIVERSE = """n AS (SELECT lpad(CAST(p_partkey % 40 AS VARCHAR), 9, '0') AS cusip, p_name AS name, count(*) AS n FROM part GROUP BY 1, 2),
k AS (SELECT cusip, name AS issuer_name FROM (SELECT *, row_number() OVER (PARTITION BY cusip ORDER BY n DESC, length(name) DESC, name) AS r FROM n) q WHERE r = 1),
u AS (SELECT cusip, NULL AS seed FROM holdings UNION ALL SELECT cusip, asset_category FROM fund_holdings),
s AS (SELECT cusip, max(seed) AS asset_category_seed, count(*) AS n_rows FROM u WHERE length(cusip) = 9 GROUP BY 1)
SELECT s.*, issuer_name FROM s LEFT JOIN k ON s.cusip = k.cusip"""


def parent_bridge(t: Tables) -> DataFrame:
    """Each filer's parent: the first seed, in stated order, whose text its name holds; else itself."""
    seeds = [("#00000001", "Alpha"), ("#0000001", "Beta"), ("7", "Gamma")]
    name = F.col("manager_name")
    parent = F.when(name.contains(seeds[0][0]), seeds[0][1])
    for part, owner in seeds[1:]:
        parent = parent.when(name.contains(part), owner)
    return t.managers.select("cik", "manager_name", parent.otherwise(name).alias("parent"))


BRIDGE = """SELECT cik, manager_name, CASE WHEN contains(manager_name, '#00000001') THEN 'Alpha' WHEN contains(manager_name, '#0000001') THEN 'Beta' WHEN contains(manager_name, '7') THEN 'Gamma' ELSE manager_name END AS parent FROM managers"""


def market_data_merge(t: Tables) -> DataFrame:
    """New market data over prior: new values where known, market cap as shares times price, else as before."""
    prior = t.market_data.select("ticker", F.col("price_live").alias("p0"), "shares_outstanding", F.col("market_cap").alias("cap0"))
    fresh = t.market_data.where("right(ticker, 1) in ('1', '3', '5', '9')").select("ticker", (F.col("price_live") + 1).alias("p1"))
    rows = prior.join(fresh, "ticker", "left")
    price = F.coalesce("p1", "p0")
    cap = F.when(F.col("p1").isNotNull() & F.col("shares_outstanding").isNotNull(), F.round(F.col("shares_outstanding") * F.col("p1")).cast("bigint")).otherwise(F.col("cap0"))
    return rows.select("ticker", price.alias("price_live"), "shares_outstanding", cap.alias("market_cap"))


MARKET_MERGE = """SELECT ticker, CASE WHEN right(ticker, 1) IN ('1', '3', '5', '9') THEN price_live + 1 ELSE price_live END AS price_live, shares_outstanding,
  CASE WHEN right(ticker, 1) IN ('1', '3', '5', '9') THEN CAST(round(shares_outstanding * (price_live + 1)) AS BIGINT) ELSE market_cap END AS market_cap FROM market_data"""


def securities_insert_missing(t: Tables) -> DataFrame:
    """Tickers held but not in a security list are added, the list's rows kept."""
    known = t.market_data.where("right(ticker, 1) <> '7'").select("ticker", "issuer_name")
    held = t.latest.where(F.col("quarter") == LATEST).select("ticker").distinct()
    return promote.insert_or_ignore(known, held.withColumn("issuer_name", F.lit(None).cast("string")), ["ticker"])


INSERT_MISSING = f"""k AS (SELECT ticker, issuer_name FROM market_data WHERE right(ticker, 1) <> '7')
SELECT * FROM k UNION ALL SELECT DISTINCT ticker, NULL FROM holdings WHERE is_latest AND quarter = '{LATEST}' AND ticker NOT IN (SELECT ticker FROM k)"""


def retry_queue(t: Tables, most: int = 3) -> DataFrame:
    """One more attempt for pending rows; those that reach the limit can't be mapped."""
    q = t.base("customer").select("c_custkey", (F.col("c_custkey") % 4).cast("int").alias("attempts"), F.when(F.col("c_custkey") % 5 == 0, "resolved").otherwise("pending").alias("status"))
    pending = F.col("status") == "pending"
    n = F.when(pending, F.col("attempts") + 1).otherwise(F.col("attempts"))
    return q.select("c_custkey", n.alias("attempts"), F.when(pending & (n >= most), "unmappable").otherwise(F.col("status")).alias("status"))


RETRY = """q AS (SELECT c_custkey, CAST(c_custkey % 4 AS INTEGER) AS a, CASE WHEN c_custkey % 5 = 0 THEN 'resolved' ELSE 'pending' END AS s FROM customer)
SELECT c_custkey, CASE WHEN s = 'pending' THEN a + 1 ELSE a END AS attempts, CASE WHEN s = 'pending' AND a + 1 >= 3 THEN 'unmappable' ELSE s END AS status FROM q"""


def override_replay(t: Tables) -> DataFrame:
    """Classifications after overrides, in their order: of one entity and field the last valid one counts."""
    base = t.base("customer").select((F.col("c_custkey") + 1000000).alias("entity_id"), F.lower("c_mktsegment").alias("classification"))
    over = t.base("orders").where("o_orderstatus <> 'F'").select((F.col("o_custkey") + 1000000).alias("e"), "o_orderkey", F.lower("o_orderpriority").alias("v"))
    last = over.groupBy("e").agg(F.max_by("v", "o_orderkey").alias("v"), F.count("*").alias("overrides"))
    return base.join(last, F.col("entity_id") == F.col("e"), "left").select("entity_id", F.coalesce("v", "classification").alias("classification"), F.coalesce("overrides", F.lit(0)).cast("bigint").alias("overrides"))


OVERRIDES = """l AS (SELECT o_custkey + 1000000 AS e, arg_max(lower(o_orderpriority), o_orderkey) AS v, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT c_custkey + 1000000 AS entity_id, coalesce(v, lower(c_mktsegment)) AS classification, coalesce(n, 0) AS overrides FROM customer LEFT JOIN l ON e = c_custkey + 1000000"""


def id_allocation(t: Tables) -> DataFrame:
    """Ids for names without an entity: after the greatest in use, in name order.

    Names are numbered within hash buckets and the buckets' counts added up,
    so no task orders all of them.
    """
    names = t.base("part").select(F.col("p_name").alias("name")).distinct().withColumn("bucket", F.crc32("name") % 16)
    counts = names.groupBy("bucket").agg(F.count("*").alias("n"))
    before = counts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("base"))
    top = t.entities.agg(F.max("entity_id").alias("top"))
    rows = names.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("name"))).join(before, "bucket").crossJoin(top)
    return rows.agg(F.count("*").alias("n"), F.count_distinct(F.col("top") + F.col("base") + F.col("k")).alias("ids"), F.min(F.col("top") + F.col("base") + F.col("k")).alias("first_id"), F.max(F.col("top") + F.col("base") + F.col("k")).alias("last_id"))


IDS = """SELECT count(DISTINCT p_name) AS n, count(DISTINCT p_name) AS ids, (SELECT max(entity_id) FROM entities) + 1 AS first_id, (SELECT max(entity_id) FROM entities) + count(DISTINCT p_name) AS last_id FROM part"""


def validation_gates(t: Tables) -> DataFrame:
    """Structural checks, each with its number of offending rows."""
    rel, hist = t.relationships, t.rollup_history
    live = open_rows(rel)
    gates = {
        "two_open_rollups": open_rows(hist).groupBy("entity_id", "rollup_type").count().where("count > 1"),
        "edge_to_itself": live.where("parent_entity_id = child_entity_id"),
        "edge_without_parent": live.join(t.entities.select(F.col("entity_id").alias("parent_entity_id")), "parent_entity_id", "left_anti"),
        "several_control_parents": live.where("control_type in ('control', 'mutual', 'merge')").groupBy("child_entity_id").count().where("count > 1"),
        "unnamed_entity": t.entities.where("coalesce(canonical_name, '') = ''"),
        "filer_without_entity": t.holdings.select("entity_id").distinct().join(t.entities, "entity_id", "left_anti"),
    }
    out = None
    for name, bad in gates.items():
        row = bad.agg(F.lit(name).alias("gate"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


GATES = """l AS (SELECT * FROM relationships WHERE valid_to = DATE '9999-12-31')
SELECT 'two_open_rollups' AS gate, count(*) AS n FROM (SELECT 1 FROM rollup_history WHERE valid_to = DATE '9999-12-31' GROUP BY entity_id, rollup_type HAVING count(*) > 1) q
UNION ALL SELECT 'edge_to_itself', count(*) FROM l WHERE parent_entity_id = child_entity_id
UNION ALL SELECT 'edge_without_parent', count(*) FROM l WHERE parent_entity_id NOT IN (SELECT entity_id FROM entities)
UNION ALL SELECT 'several_control_parents', count(*) FROM (SELECT 1 FROM l WHERE control_type IN ('control', 'mutual', 'merge') GROUP BY child_entity_id HAVING count(*) > 1) q
UNION ALL SELECT 'unnamed_entity', count(*) FROM entities WHERE coalesce(canonical_name, '') = ''
UNION ALL SELECT 'filer_without_entity', count(DISTINCT entity_id) FROM holdings WHERE entity_id NOT IN (SELECT entity_id FROM entities)"""


def latest_coverage(t: Tables) -> DataFrame:
    """Rows by quarter and currency of version, and how much of each is typed: the rollback report."""
    return t.holdings.groupBy("quarter", "is_latest").agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("tickers"), ratio(F.count("entity_type"), F.count("*"), 100).alias("typed_pct"))


COVERAGE = """SELECT quarter, is_latest, count(*) AS n, count(DISTINCT ticker) AS tickers, count(entity_type) * 100.0::DOUBLE / count(*) AS typed_pct FROM holdings GROUP BY 1, 2"""


def worldview_divergence(t: Tables, quarter: str = LATEST) -> DataFrame:
    """Value by rollup entity in both worldviews, where they differ."""
    rows = t.latest.where(F.col("quarter") == quarter).groupBy("entity_id").agg(F.sum("market_value_usd").alias("v"))
    views = open_rows(t.rollup_history).select("entity_id", F.col("rollup_entity_id").alias("rid"), "rollup_type")
    wide = rows.join(views, "entity_id").groupBy("rid").pivot("rollup_type", ["economic_control_v1", "decision_maker_v1"]).agg(F.sum("v"))
    return wide.toDF("rid", "ec_value", "dm_value").where("not (ec_value <=> dm_value)")


DIVERGENCE = f"""r AS (SELECT entity_id, {S("market_value_usd")} AS v FROM holdings WHERE is_latest AND quarter = '{LATEST}' GROUP BY 1),
w AS (SELECT rollup_entity_id AS rid, {S("CASE WHEN rollup_type = 'economic_control_v1' THEN v END")} AS ec_value, {S("CASE WHEN rollup_type = 'decision_maker_v1' THEN v END")} AS dm_value FROM r JOIN rollup_history x ON r.entity_id = x.entity_id WHERE valid_to = DATE '9999-12-31' GROUP BY 1)
SELECT * FROM w WHERE ec_value IS DISTINCT FROM dm_value"""


def new_companies(t: Tables) -> DataFrame:
    """Filer and ticker pairs first seen in each quarter of the window."""
    first = t.latest.where(F.col("quarter").isin(*QUARTERS)).groupBy("cik", "ticker").agg(F.min("quarter").alias("first_quarter"))
    return first.groupBy("first_quarter").agg(F.count("*").alias("pairs"), F.count_distinct("ticker").alias("tickers"))


NEW = f"""f AS (SELECT cik, ticker, min(quarter) AS first_quarter FROM holdings WHERE is_latest AND quarter IN {sql_list(QUARTERS)} GROUP BY 1, 2) SELECT first_quarter, count(*) AS pairs, count(DISTINCT ticker) AS tickers FROM f GROUP BY 1"""

QUERIES = {
    "query13_sector_movers": (query13_sector_movers, statement(QUERY13)),
    "nport_position": (nport_position, statement(NPORT_POSITION)),
    "fund_children_of_parents": (fund_children_of_parents, statement(CHILDREN)),
    "cusip_universe": (cusip_universe, statement(UNIVERSE)),
    "parent_bridge": (parent_bridge, statement(BRIDGE)),
    "market_data_merge": (market_data_merge, statement(MARKET_MERGE)),
    "securities_insert_missing": (securities_insert_missing, statement(INSERT_MISSING)),
    "retry_queue": (retry_queue, statement(RETRY)),
    "override_replay": (override_replay, statement(OVERRIDES)),
    "id_allocation": (id_allocation, statement(IDS)),
    "validation_gates": (validation_gates, statement(GATES)),
    "latest_coverage": (latest_coverage, statement(COVERAGE)),
    "worldview_divergence": (worldview_divergence, statement(DIVERGENCE)),
    "new_companies": (new_companies, statement(NEW)),
}
