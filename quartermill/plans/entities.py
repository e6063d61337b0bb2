"""The entity graph: climbs, descents, search and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LATEST, QUARTERS
from ..operators.relational import climb, descend, open_rows, top_n
from ..sources.canonical import Tables, statement
from .common import CLIMB, S

desc = F.desc_nulls_last
ROOT = 3


def inst_to_top_parent(t: Tables) -> DataFrame:
    """Every entity's farthest owner and its distance."""
    return climb(t.entities, t.relationships)


def _edges(t: Tables) -> DataFrame:
    """Open edges but those to sub-advised entities."""
    return open_rows(t.relationships).where("relationship_type <> 'sub_adviser'").select(F.col("parent_entity_id").alias("parent"), F.col("child_entity_id").alias("child"))


_EDGES = "ed AS (SELECT parent_entity_id AS p, child_entity_id AS c FROM relationships WHERE valid_to = DATE '9999-12-31' AND relationship_type <> 'sub_adviser')"


def _down_sql(roots: str, depth: int) -> str:
    return f"""down AS (WITH RECURSIVE r AS (SELECT entity_id AS root, entity_id, CAST(0 AS BIGINT) AS depth FROM ({roots}) x
  UNION SELECT r.root, e.c, r.depth + 1 FROM r JOIN ed e ON r.entity_id = e.p WHERE r.depth < {depth}) SELECT root, entity_id, min(depth) AS depth FROM r GROUP BY 1, 2)"""


def aum_for_subtree(t: Tables, quarter: str = LATEST) -> DataFrame:
    """Value held by the filers of each region's subtree (fewer than four edges down)."""
    roots = t.entities.where("entity_id <= 5").select("entity_id")
    tree = descend(roots, _edges(t), 4)
    ciks = tree.select("root", F.lpad((F.col("entity_id") - 1000000).cast("string"), 10, "0").alias("cik")).where("entity_id between 1000000 and 1999999").distinct()
    held = t.latest.where(F.col("quarter") == quarter).groupBy("cik").agg(F.sum("market_value_usd").alias("value"))
    return ciks.join(held, "cik").groupBy("root").agg(F.sum("value").alias("aum"), F.count("*").alias("filers"))


AUM_SUBTREE = f"""{_EDGES}, {_down_sql("SELECT entity_id FROM entities WHERE entity_id <= 5", 4)},
k AS (SELECT DISTINCT root, lpad(CAST(entity_id - 1000000 AS VARCHAR), 10, '0') AS cik FROM down WHERE entity_id BETWEEN 1000000 AND 1999999),
v AS (SELECT cik, {S("market_value_usd")} AS value FROM holdings WHERE is_latest AND quarter = '{LATEST}' GROUP BY 1)
SELECT root, {S("value")} AS aum, count(*) AS filers FROM k JOIN v ON k.cik = v.cik GROUP BY 1"""


def filer_children(t: Tables, root: int = ROOT) -> DataFrame:
    """The filers nearest below an entity: those at the least depth that has any, within three edges."""
    tree = descend(t.entities.where(F.col("entity_id") == root).select("entity_id"), _edges(t), 3)
    filers = tree.where("entity_id between 1000000 and 1999999 and depth > 0")
    least = F.broadcast(filers.agg(F.min("depth").alias("least")))
    return filers.crossJoin(least).where("depth = least").join(t.entities, "entity_id").select("entity_id", "canonical_name", "depth")


FILER_CHILDREN = f"""{_EDGES}, {_down_sql(f"SELECT {ROOT} AS entity_id", 3)},
f AS (SELECT * FROM down WHERE entity_id BETWEEN 1000000 AND 1999999 AND depth > 0)
SELECT f.entity_id, canonical_name, depth FROM f JOIN entities e ON f.entity_id = e.entity_id WHERE depth = (SELECT min(depth) FROM f)"""


def fund_children(t: Tables, n: int = 5) -> DataFrame:
    """The n largest funds of every sponsor by net assets, and how many it has."""
    edges = open_rows(t.relationships).where("control_type = 'advisory'").select(F.col("parent_entity_id").alias("entity_id"), F.col("child_entity_id").alias("fund_entity_id"))
    funds = t.fund_universe.select("series_id", "fund_name", "total_net_assets", (F.substring("series_id", 2, 6).cast("bigint") + 2000000).alias("fund_entity_id"))
    all_funds = edges.join(funds, "fund_entity_id").withColumn("total_count", F.count("*").over(Window.partitionBy("entity_id")))
    return top_n(all_funds, ["entity_id"], [desc("total_net_assets"), F.asc("series_id")], n).drop("fund_entity_id")


FUND_CHILDREN = """a AS (SELECT parent_entity_id AS entity_id, series_id, fund_name, total_net_assets, count(*) OVER (PARTITION BY parent_entity_id) AS total_count,
  row_number() OVER (PARTITION BY parent_entity_id ORDER BY total_net_assets DESC NULLS LAST, series_id) AS rank
  FROM relationships r JOIN fund_universe f ON child_entity_id = 2000000 + CAST(substring(series_id, 2, 6) AS BIGINT) WHERE control_type = 'advisory' AND valid_to = DATE '9999-12-31')
SELECT * FROM a WHERE rank <= 5"""


def sub_advisers(t: Tables) -> DataFrame:
    """Who sub-advises each fund, with the fund's latest reported value."""
    edges = open_rows(t.relationships).where("relationship_type = 'sub_adviser'").select(F.col("child_entity_id").alias("entity_id"), F.col("parent_entity_id").alias("adviser"))
    held = t.fund_latest.where(F.col("quarter") == LATEST).groupBy("entity_id").agg(F.sum("market_value_usd").alias("value"))
    names = t.entities.select(F.col("entity_id").alias("adviser"), F.col("canonical_name").alias("adviser_name"))
    return edges.join(names, "adviser").join(held, "entity_id", "left")


SUB_ADVISERS = f"""v AS (SELECT entity_id, {S("market_value_usd")} AS value FROM fund_holdings WHERE is_latest AND quarter = '{LATEST}' GROUP BY 1)
SELECT child_entity_id AS entity_id, parent_entity_id AS adviser, canonical_name AS adviser_name, value FROM relationships r JOIN entities e ON e.entity_id = r.parent_entity_id
LEFT JOIN v ON v.entity_id = r.child_entity_id WHERE relationship_type = 'sub_adviser' AND valid_to = DATE '9999-12-31'"""


def entity_search(t: Tables, pattern: str = "%00001%") -> DataFrame:
    """The first 20 entities whose name matches a pattern, whatever the case."""
    found = t.entities.where(F.col("canonical_name").ilike(pattern))
    return top_n(found, [], [F.asc("canonical_name"), F.asc("entity_id")], 20)


SEARCH = """SELECT * FROM (SELECT *, row_number() OVER (ORDER BY canonical_name, entity_id) AS rank FROM entities WHERE canonical_name ILIKE '%00001%') q WHERE rank <= 20"""


def entity_graph(t: Tables, root: int = ROOT) -> DataFrame:
    """Nodes and edges within two edges of an entity, in one frame by kind."""
    tree = descend(t.entities.where(F.col("entity_id") == root).select("entity_id"), _edges(t), 2)
    none = F.lit(None).cast("bigint")
    nodes = tree.join(t.entities, "entity_id").select(F.lit("node").alias("kind"), F.col("entity_id").alias("id"), none.alias("target"), F.col("canonical_name").alias("label"), "depth")
    edges = tree.where("depth < 2").join(_edges(t), F.col("entity_id") == F.col("parent")).select(F.lit("edge").alias("kind"), F.col("parent").alias("id"), F.col("child").alias("target"), F.lit(None).cast("string").alias("label"), (F.col("depth") + 1).alias("depth"))
    return nodes.unionByName(edges)


GRAPH = f"""{_EDGES}, {_down_sql(f"SELECT {ROOT} AS entity_id", 2)}
SELECT 'node' AS kind, d.entity_id AS id, CAST(NULL AS BIGINT) AS target, canonical_name AS label, depth FROM down d JOIN entities e ON d.entity_id = e.entity_id
UNION ALL SELECT 'edge', p, c, NULL, depth + 1 FROM down JOIN ed ON entity_id = p WHERE depth < 2"""


def institution_hierarchy(t: Tables) -> DataFrame:
    """Each top parent's filers with their value and number of funds held through, and the whole."""
    top = t.top_parents.select("entity_id", "top_parent_entity_id")
    held = t.latest.where(F.col("quarter") == LATEST).groupBy("entity_id", "cik").agg(F.sum("market_value_usd").alias("value"), F.count_distinct("fund_name").alias("funds"))
    rows = held.join(top, "entity_id").groupBy("top_parent_entity_id", F.col("cik")).agg(F.sum("value").alias("value"), F.sum("funds").alias("funds"))
    return rows.withColumn("parent_value", F.sum("value").over(Window.partitionBy("top_parent_entity_id"))).withColumn("filers", F.count("*").over(Window.partitionBy("top_parent_entity_id")))


HIERARCHY = f"""{CLIMB}, h AS (SELECT entity_id, cik, {S("market_value_usd")} AS value, count(DISTINCT fund_name) AS funds FROM holdings WHERE is_latest AND quarter = '{LATEST}' GROUP BY 1, 2)
SELECT top_parent_entity_id, cik, value, funds, CAST(sum(value) OVER w AS BIGINT) AS parent_value, count(*) OVER w AS filers FROM h JOIN tops t ON h.entity_id = t.entity_id WINDOW w AS (PARTITION BY top_parent_entity_id)"""


def unified_holdings(t: Tables) -> DataFrame:
    """13F and fund values of each top parent, quarter and security side by side; the greater counts, ties to 13F.

    The legs meet by plain equality: a null key never matches and gives rows of its own.
    """
    top = t.top_parents.select("entity_id", F.col("top_parent_entity_id").alias("top"))
    quarters = F.col("quarter").isin(*QUARTERS)
    keys = ["top", "quarter", "cusip", "ticker"]
    a = t.latest.where(quarters).join(top, "entity_id").groupBy(*keys).agg(F.sum("market_value_usd").alias("a"))
    view = open_rows(t.rollup_history).where("rollup_type = 'decision_maker_v1'").select("entity_id", F.col("rollup_entity_id").alias("rid"))
    b = t.fund_latest.where(quarters & (F.col("cusip") != "")).drop("rollup_entity_id").join(view, "entity_id").join(top.withColumnRenamed("entity_id", "rid"), "rid").groupBy(*keys).agg(F.sum("market_value_usd").alias("b"))
    both = a.join(b, keys, "full")
    names = t.entities.select(F.col("entity_id").alias("top"), F.col("canonical_name").alias("top_parent_name"))
    zero = F.lit(0).cast("bigint")
    x, y = F.coalesce("a", zero), F.coalesce("b", zero)
    return both.join(names, "top").select(F.col("top").alias("top_parent_entity_id"), "top_parent_name", "quarter", "cusip", "ticker", x.alias("thirteen_f"), y.alias("fund_tier"), F.greatest(x, y).alias("r5"), F.when(x >= y, "13F").otherwise("fund_tier").alias("source_winner"))


_QL = "('" + "', '".join(QUARTERS) + "')"
UNIFIED = f"""{CLIMB},
a AS (SELECT top_parent_entity_id AS top, quarter, cusip, ticker, {S("market_value_usd")} AS a FROM holdings h JOIN tops t ON h.entity_id = t.entity_id WHERE is_latest AND quarter IN {_QL} GROUP BY 1, 2, 3, 4),
b AS (SELECT top_parent_entity_id AS top, quarter, cusip, ticker, {S("market_value_usd")} AS b FROM fund_holdings f JOIN rollup_history r ON r.entity_id = f.entity_id AND r.rollup_type = 'decision_maker_v1' AND r.valid_to = DATE '9999-12-31'
  JOIN tops t ON t.entity_id = r.rollup_entity_id WHERE is_latest AND cusip <> '' AND quarter IN {_QL} GROUP BY 1, 2, 3, 4)
SELECT coalesce(a.top, b.top) AS top_parent_entity_id, canonical_name AS top_parent_name, coalesce(a.quarter, b.quarter) AS quarter, coalesce(a.cusip, b.cusip) AS cusip, coalesce(a.ticker, b.ticker) AS ticker,
  coalesce(a, 0) AS thirteen_f, coalesce(b, 0) AS fund_tier, greatest(coalesce(a, 0), coalesce(b, 0)) AS r5, CASE WHEN coalesce(a, 0) >= coalesce(b, 0) THEN '13F' ELSE 'fund_tier' END AS source_winner
FROM a FULL JOIN b ON a.top = b.top AND a.quarter = b.quarter AND a.cusip = b.cusip AND a.ticker = b.ticker JOIN entities e ON e.entity_id = coalesce(a.top, b.top)"""

QUERIES = {
    "inst_to_top_parent": (inst_to_top_parent, statement(f"{CLIMB} SELECT entity_id, top_parent_entity_id, hops FROM tops")),
    "aum_for_subtree": (aum_for_subtree, statement(AUM_SUBTREE)),
    "filer_children": (filer_children, statement(FILER_CHILDREN)),
    "fund_children": (fund_children, statement(FUND_CHILDREN)),
    "sub_advisers": (sub_advisers, statement(SUB_ADVISERS)),
    "entity_search": (entity_search, statement(SEARCH)),
    "entity_graph": (entity_graph, statement(GRAPH)),
    "institution_hierarchy": (institution_hierarchy, statement(HIERARCHY)),
    "unified_holdings": (unified_holdings, statement(UNIFIED)),
}
