"""Flows between quarters: investor flows, momentum, cohorts, trends and rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DM, EC, FIRST, LATEST, PREVIOUS, QUARTERS, ROTATION_ACTIVE, TICKER, sql_list
from ..operators.relational import full_null_safe, open_rows, ratio, top_n
from ..sources.canonical import Tables, statement
from .common import NAMED, S, at, named

desc = F.desc_nulls_last
#: Periods: label -> first quarter; all end with the latest. 4Q and 3Q are the same with four quarters, so 3Q is left out.
PERIODS = {"4Q": FIRST, "2Q": QUARTERS[1], "1Q": PREVIOUS}


def cents(x: Column) -> Column:
    """An amount in whole cents, as a double: sums of these are exact in any order of addition."""
    return F.round(x * 100)


def dollars(x: Column) -> Column:
    return x / 100


# --- investor flows -------------------------------------------------------


def _sides(t: Tables, worldview: str) -> DataFrame:
    """Shares and value by quarter, ticker and rollup entity (rid, null kept)."""
    rows = t.latest.where(F.col("quarter").isin(*QUARTERS))
    if worldview == EC:
        rows = rows.withColumn("rid", F.col("rollup_entity_id"))
    else:
        view = open_rows(t.rollup_history).where(F.col("rollup_type") == worldview).select(F.col("entity_id").alias("e"), F.col("rollup_entity_id").alias("rid"))
        rows = rows.join(view, rows["entity_id"] == view["e"], "left")
    return rows.groupBy("quarter", "ticker", "rid").agg(F.max("manager_type").alias("manager_type"), F.sum("shares").alias("shares"), F.sum("market_value_usd").alias("value"))


def investor_flows(t: Tables, worldview: str = EC) -> DataFrame:
    """Flows of every ticker and rollup entity over each period: net, price-adjusted and raw, entry and exit flags, momentum.

    One aggregate of the four quarters serves all periods; ids match null with
    null. flow_4q is the 4Q price-adjusted flow and flow_2q, by the
    definition that the signal's thresholds assume, that of 1Q.
    """
    sides = _sides(t, worldview)
    parts = []
    for period, first in PERIODS.items():
        a = sides.where(F.col("quarter") == LATEST).select("ticker", "rid", F.col("manager_type").alias("to_type"), F.col("shares").alias("s2"), F.col("value").alias("v2"))
        b = sides.where(F.col("quarter") == first).select("ticker", "rid", F.col("manager_type").alias("from_type"), F.col("shares").alias("s1"), F.col("value").alias("v1"))
        parts.append(full_null_safe(a, b, ["ticker"], ["rid"]).withColumn("period", F.lit(period)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    zero = F.lit(0).cast("bigint")
    rows = rows.withColumns({c: F.coalesce(c, zero) for c in ("s1", "s2", "v1", "v2")}).where("s1 > 0 or s2 > 0")
    price = F.when((F.col("s1") > 0) & (F.col("v1") > 0), ratio(F.col("v1"), F.col("s1")))
    adjusted = (F.col("s2") - F.col("s1")) * price
    rows = rows.select(
        "ticker", "period", F.col("rid").alias("rollup_entity_id"), F.coalesce("to_type", "from_type").alias("manager_type"),
        F.nullif("s1", zero).alias("from_shares"), F.nullif("s2", zero).alias("to_shares"), F.nullif(F.col("s2") - F.col("s1"), zero).alias("net_shares"),
        F.when(F.col("s1") > 0, ratio(F.col("s2") - F.col("s1"), F.col("s1"))).alias("pct_change"),
        F.nullif("v1", zero).alias("from_value"), F.nullif("v2", zero).alias("to_value"), price.alias("from_price"), adjusted.alias("price_adj_flow"),
        F.nullif(F.col("v2") - F.col("v1"), zero).alias("raw_flow"), ((F.col("v2") - F.col("v1")) - adjusted).alias("price_effect"),
        (F.col("s1") == 0).alias("is_new_entry"), (F.col("s2") == 0).alias("is_exit"))
    w = Window.partitionBy("ticker", "rollup_entity_id")
    rows = rows.withColumn("flow_4q", F.max(F.when(F.col("period") == "4Q", F.col("price_adj_flow"))).over(w)).withColumn("flow_2q", F.max(F.when(F.col("period") == "1Q", F.col("price_adj_flow"))).over(w))
    m = F.col("flow_2q") / F.nullif("flow_4q", F.lit(0.0))
    signal = F.when(F.col("manager_type") == "passive", F.lit(None).cast("string")).when(F.col("is_new_entry"), "NEW").when(F.col("is_exit"), "EXIT").when(m.isNull(), F.lit(None).cast("string"))
    return rows.withColumn("momentum_ratio", m).withColumn("momentum_signal", signal.when(m > 0.65, "ACCEL").when(m >= 0.35, "STEADY").when(m >= 0.10, "FADING").when(m >= 0, "MINIMAL").otherwise("REVERSING"))


def investor_flows_dm(t: Tables) -> DataFrame:
    """Investor flows in the decision-maker worldview."""
    return investor_flows(t, DM)


def _flows_sql(worldview: str) -> str:
    if worldview == EC:
        rows = "SELECT *, rollup_entity_id AS rid FROM holdings WHERE is_latest"
    else:
        rows = f"SELECT h.*, r.rollup_entity_id AS rid FROM holdings h LEFT JOIN rollup_history r ON h.entity_id = r.entity_id AND r.rollup_type = '{worldview}' AND r.valid_to = DATE '9999-12-31' WHERE h.is_latest"
    return f"""rows AS ({rows}),
sides AS (SELECT quarter, ticker, rid, max(manager_type) AS mt, {S("shares")} AS s, {S("market_value_usd")} AS v FROM rows WHERE quarter IN {sql_list(QUARTERS)} GROUP BY 1, 2, 3),
periods AS (SELECT * FROM (VALUES {", ".join(f"('{p}', '{q}')" for p, q in PERIODS.items())}) x(period, first)),
f1 AS (SELECT p.period, s.* FROM periods p JOIN sides s ON s.quarter = p.first), f2 AS (SELECT p.period, s.* FROM periods p JOIN sides s ON s.quarter = '{LATEST}'),
j AS (SELECT coalesce(b.period, a.period) AS period, coalesce(b.ticker, a.ticker) AS ticker, coalesce(b.rid, a.rid) AS rid, coalesce(b.mt, a.mt) AS manager_type,
        coalesce(a.s, 0) AS s1, coalesce(b.s, 0) AS s2, coalesce(a.v, 0) AS v1, coalesce(b.v, 0) AS v2
      FROM f2 b FULL JOIN f1 a ON a.period = b.period AND a.ticker = b.ticker AND a.rid IS NOT DISTINCT FROM b.rid),
k AS (SELECT *, CASE WHEN s1 > 0 AND v1 > 0 THEN v1::DOUBLE / s1 END AS from_price FROM j WHERE s1 > 0 OR s2 > 0),
l AS (SELECT *, (s2 - s1) * from_price AS price_adj_flow FROM k),
m AS (SELECT *, max(CASE WHEN period = '4Q' THEN price_adj_flow END) OVER w AS flow_4q, max(CASE WHEN period = '1Q' THEN price_adj_flow END) OVER w AS flow_2q FROM l WINDOW w AS (PARTITION BY ticker, rid)),
investor AS (SELECT ticker, period, rid AS rollup_entity_id, manager_type, nullif(s1, 0) AS from_shares, nullif(s2, 0) AS to_shares, nullif(s2 - s1, 0) AS net_shares,
  CASE WHEN s1 > 0 THEN (s2 - s1)::DOUBLE / s1 END AS pct_change, nullif(v1, 0) AS from_value, nullif(v2, 0) AS to_value, from_price, price_adj_flow,
  nullif(v2 - v1, 0) AS raw_flow, (v2 - v1) - price_adj_flow AS price_effect, s1 = 0 AS is_new_entry, s2 = 0 AS is_exit, flow_4q, flow_2q,
  flow_2q / nullif(flow_4q, 0) AS momentum_ratio,
  CASE WHEN manager_type = 'passive' THEN NULL WHEN s1 = 0 THEN 'NEW' WHEN s2 = 0 THEN 'EXIT' WHEN flow_2q / nullif(flow_4q, 0) IS NULL THEN NULL
       WHEN flow_2q / flow_4q > 0.65 THEN 'ACCEL' WHEN flow_2q / flow_4q >= 0.35 THEN 'STEADY' WHEN flow_2q / flow_4q >= 0.10 THEN 'FADING'
       WHEN flow_2q / flow_4q >= 0 THEN 'MINIMAL' ELSE 'REVERSING' END AS momentum_signal FROM m)"""


def ticker_flow_stats(t: Tables) -> DataFrame:
    """Flow intensity (of market cap) and churn of each ticker and period; by period, so none is counted twice."""
    f = investor_flows(t).join(t.market_data.select("ticker", "market_cap"), "ticker", "left")
    stays = ~F.col("is_new_entry") & ~F.col("is_exit")
    other, passive = F.col("manager_type") != "passive", F.col("manager_type") == "passive"
    part = lambda cond: F.sum(F.when(cond, F.col("price_adj_flow")).otherwise(0.0))
    cap = F.max("market_cap")
    moved = F.sum(F.when(F.col("is_new_entry") & other, F.col("to_value")).otherwise(0)) + F.sum(F.when(F.col("is_exit") & other, F.col("from_value")).otherwise(0))
    held = F.sum(F.when(~F.col("is_new_entry") & other, F.col("from_value")).otherwise(0)) + F.sum(F.when(~F.col("is_exit") & other, F.col("to_value")).otherwise(0))
    return f.groupBy("ticker", "period").agg(
        F.round(ratio(part(stays), cap), 8).alias("intensity_total"), F.round(ratio(part(stays & other), cap), 8).alias("intensity_active"),
        F.round(ratio(part(stays & passive), cap), 8).alias("intensity_passive"), (moved.cast("double") / F.nullif(held / F.lit(2.0), F.lit(0.0))).alias("churn"))


TICKER_FLOW_STATS = f"""{_flows_sql(EC)},
g AS (SELECT i.*, market_cap, NOT is_new_entry AND NOT is_exit AS stays FROM investor i LEFT JOIN market_data d ON i.ticker = d.ticker)
SELECT ticker, period, round(sum(CASE WHEN stays THEN price_adj_flow ELSE 0 END) / nullif(max(market_cap), 0)::DOUBLE, 8) AS intensity_total,
  round(sum(CASE WHEN stays AND manager_type <> 'passive' THEN price_adj_flow ELSE 0 END) / nullif(max(market_cap), 0)::DOUBLE, 8) AS intensity_active,
  round(sum(CASE WHEN stays AND manager_type = 'passive' THEN price_adj_flow ELSE 0 END) / nullif(max(market_cap), 0)::DOUBLE, 8) AS intensity_passive,
  (sum(CASE WHEN is_new_entry AND manager_type <> 'passive' THEN to_value ELSE 0 END) + sum(CASE WHEN is_exit AND manager_type <> 'passive' THEN from_value ELSE 0 END))::DOUBLE
   / nullif((sum(CASE WHEN NOT is_new_entry AND manager_type <> 'passive' THEN from_value ELSE 0 END) + sum(CASE WHEN NOT is_exit AND manager_type <> 'passive' THEN to_value ELSE 0 END))::DOUBLE / 2, 0) AS churn
FROM g GROUP BY 1, 2"""


# --- cohorts and trends ---------------------------------------------------


def _two(t: Tables, ticker: str, first: str, last: str) -> DataFrame:
    """Each parent's shares and value in two quarters, and its cohort."""
    rows = at(named(t, t.latest), ticker).where(F.col("quarter").isin(first, last))
    pick = lambda q, c: F.sum(F.when(F.col("quarter") == q, F.col(c)))
    both = rows.groupBy("parent_name").agg(pick(first, "shares").alias("s1"), pick(last, "shares").alias("s4"), pick(first, "market_value_usd").alias("v1"), pick(last, "market_value_usd").alias("v4"))
    cohort = F.when(F.col("s1").isNull(), "New Entries").when(F.col("s4").isNull(), "Exits").when(F.col("s4") > F.col("s1"), "Increased").when(F.col("s4") < F.col("s1"), "Decreased").otherwise("Unchanged")
    return both.withColumn("cohort", cohort)


def _two_sql(ticker: str, first: str, last: str) -> str:
    pick = lambda q, c: S(f"CASE WHEN quarter = '{q}' THEN {c} END")
    return f"""{NAMED},
b AS (SELECT parent_name, {pick(first, "shares")} AS s1, {pick(last, "shares")} AS s4, {pick(first, "market_value_usd")} AS v1, {pick(last, "market_value_usd")} AS v4
      FROM named WHERE ticker = '{ticker}' AND quarter IN ('{first}', '{last}') GROUP BY 1),
two AS (SELECT *, CASE WHEN s1 IS NULL THEN 'New Entries' WHEN s4 IS NULL THEN 'Exits' WHEN s4 > s1 THEN 'Increased' WHEN s4 < s1 THEN 'Decreased' ELSE 'Unchanged' END AS cohort FROM b)"""


def cohort_analysis(t: Tables, ticker: str = TICKER, first: str = FIRST, last: str = LATEST) -> DataFrame:
    """Rows of each cohort, of all retained and of the total: holders, shares, value and their changes."""
    rows = _two(t, ticker, first, last)
    gone = F.col("cohort") == "Exits"
    rows = rows.select("cohort", "parent_name", F.when(gone, F.col("s1")).otherwise(F.col("s4")).alias("shares"), F.when(gone, F.col("v1")).otherwise(F.col("v4")).alias("value"), (F.coalesce("s4", F.lit(0)) - F.coalesce("s1", F.lit(0))).alias("delta_shares"), (F.coalesce("v4", F.lit(0)) - F.coalesce("v1", F.lit(0))).alias("delta_value"))
    kinds = F.array(F.col("cohort"), F.when(F.col("cohort").isin("Increased", "Decreased", "Unchanged"), F.lit("Retained")), F.lit("Total"))
    spread = rows.withColumn("category", F.explode(F.array_compact(kinds)))
    held = (F.col("category") != "Total") | (F.col("cohort") != "Exits")
    return spread.groupBy("category").agg(F.count_if(held).alias("holders"), F.sum(F.when(held, F.col("shares")).otherwise(0)).alias("shares"), F.sum(F.when(held, F.col("value")).otherwise(0)).alias("value"), F.sum("delta_shares").alias("delta_shares"), F.sum("delta_value").alias("delta_value"))


COHORT = f"""{_two_sql(TICKER, FIRST, LATEST)},
c AS (SELECT cohort, CASE WHEN cohort = 'Exits' THEN s1 ELSE s4 END AS shares, CASE WHEN cohort = 'Exits' THEN v1 ELSE v4 END AS value,
        coalesce(s4, 0) - coalesce(s1, 0) AS ds, coalesce(v4, 0) - coalesce(v1, 0) AS dv FROM two),
u AS (SELECT cohort AS category, * FROM c UNION ALL SELECT 'Retained', * FROM c WHERE cohort IN ('Increased', 'Decreased', 'Unchanged') UNION ALL SELECT 'Total', * FROM c)
SELECT category, count(*) FILTER (WHERE category <> 'Total' OR cohort <> 'Exits') AS holders, {S("CASE WHEN category <> 'Total' OR cohort <> 'Exits' THEN shares ELSE 0 END")} AS shares,
  {S("CASE WHEN category <> 'Total' OR cohort <> 'Exits' THEN value ELSE 0 END")} AS value, {S("ds")} AS delta_shares, {S("dv")} AS delta_value FROM u GROUP BY 1"""


def cohort_summary(t: Tables, ticker: str = TICKER, first: str = FIRST, last: str = LATEST) -> DataFrame:
    """Retention by holders and by shares (each capped at what it held), and net changes."""
    rows = _two(t, ticker, first, last)
    kept = F.col("cohort").isin("Increased", "Decreased", "Unchanged")
    return rows.agg(
        ratio(F.count_if(kept), F.count("s1"), 100).alias("retention_rate"),
        ratio(F.sum(F.least(F.when(F.col("s1") > 0, F.coalesce("s4", F.lit(0))), F.col("s1"))), F.sum(F.when(F.col("s1") > 0, F.col("s1"))), 100).alias("econ_retention"),
        (F.count_if(F.col("cohort") == "New Entries") - F.count_if(F.col("cohort") == "Exits")).alias("net_holders"),
        (F.coalesce(F.sum("s4"), F.lit(0)) - F.coalesce(F.sum("s1"), F.lit(0))).alias("net_shares"), (F.coalesce(F.sum("v4"), F.lit(0)) - F.coalesce(F.sum("v1"), F.lit(0))).alias("net_value"))


COHORT_SUMMARY = f"""{_two_sql(TICKER, FIRST, LATEST)}
SELECT count(*) FILTER (WHERE cohort IN ('Increased', 'Decreased', 'Unchanged')) * 100.0::DOUBLE / nullif(count(s1), 0) AS retention_rate,
  {S("least(CASE WHEN s1 > 0 THEN coalesce(s4, 0) END, s1)")} * 100.0::DOUBLE / nullif({S("CASE WHEN s1 > 0 THEN s1 END")}, 0) AS econ_retention,
  count(*) FILTER (WHERE cohort = 'New Entries') - count(*) FILTER (WHERE cohort = 'Exits') AS net_holders,
  coalesce({S("s4")}, 0) - coalesce({S("s1")}, 0) AS net_shares, coalesce({S("v4")}, 0) - coalesce({S("v1")}, 0) AS net_value FROM two"""


def cohort_top5(t: Tables, ticker: str = TICKER, first: str = FIRST, last: str = LATEST) -> DataFrame:
    """The five parents of each cohort that moved (or hold) the most value."""
    rows = _two(t, ticker, first, last)
    weight = F.when(F.col("cohort").isin("Increased", "Decreased"), F.abs(F.col("v4") - F.col("v1"))).when(F.col("cohort") == "Exits", F.col("v1")).otherwise(F.col("v4"))
    return top_n(rows.withColumn("weight", weight), ["cohort"], [desc("weight"), F.asc("parent_name")], 5).select("cohort", "rank", "parent_name", "weight")


COHORT_TOP5 = f"""{_two_sql(TICKER, FIRST, LATEST)},
w AS (SELECT cohort, parent_name, CASE WHEN cohort IN ('Increased', 'Decreased') THEN abs(v4 - v1) WHEN cohort = 'Exits' THEN v1 ELSE v4 END AS weight FROM two)
SELECT cohort, rank, parent_name, weight FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY weight DESC NULLS LAST, parent_name) AS rank FROM w) q WHERE rank <= 5"""


def flows_live(t: Tables, ticker: str = TICKER, first: str = PREVIOUS, last: str = LATEST) -> DataFrame:
    """Buyers, sellers, new holders and exits of a ticker, 25 of each."""
    rows = at(t.latest, ticker).where(F.col("quarter").isin(first, last))
    pick = lambda q, c: F.sum(F.when(F.col("quarter") == q, F.col(c)))
    both = rows.groupBy("cik").agg(F.max("manager_name").alias("manager_name"), pick(first, "shares").alias("s1"), pick(last, "shares").alias("s2"))
    kind = F.when(F.col("s1").isNull(), "new").when(F.col("s2").isNull(), "exit").when(F.col("s2") > F.col("s1"), "buyer").when(F.col("s2") < F.col("s1"), "seller")
    moved = both.withColumn("kind", kind).where("kind is not null").withColumn("net_shares", F.coalesce("s2", F.lit(0)) - F.coalesce("s1", F.lit(0)))
    return top_n(moved, ["kind"], [F.desc(F.abs("net_shares")), F.asc("cik")], 25)


FLOWS_LIVE = f"""b AS (SELECT cik, max(manager_name) AS manager_name, {S(f"CASE WHEN quarter = '{PREVIOUS}' THEN shares END")} AS s1, {S(f"CASE WHEN quarter = '{LATEST}' THEN shares END")} AS s2
  FROM holdings WHERE is_latest AND ticker = '{TICKER}' AND quarter IN ('{PREVIOUS}', '{LATEST}') GROUP BY 1),
k AS (SELECT *, CASE WHEN s1 IS NULL THEN 'new' WHEN s2 IS NULL THEN 'exit' WHEN s2 > s1 THEN 'buyer' WHEN s2 < s1 THEN 'seller' END AS kind, coalesce(s2, 0) - coalesce(s1, 0) AS net_shares FROM b)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY abs(net_shares) DESC, cik) AS rank FROM k WHERE kind IS NOT NULL) q WHERE rank <= 25"""


def flow_analysis(t: Tables, ticker: str = TICKER, period: str = "1Q") -> DataFrame:
    """A ticker's flows over a period by direction: entities, shares and value moved."""
    rows = investor_flows(t).where((F.col("ticker") == ticker) & (F.col("period") == period))
    kind = F.when(F.col("is_new_entry"), "new").when(F.col("is_exit"), "exit").when(F.col("net_shares") > 0, "buyer").when(F.col("net_shares") < 0, "seller").otherwise("unchanged")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("entities"), F.sum("net_shares").alias("net_shares"), dollars(F.sum(cents(F.col("price_adj_flow")))).alias("price_adj_flow"), F.sum("raw_flow").alias("raw_flow"))


FLOW_ANALYSIS = f"""{_flows_sql(EC)}
SELECT CASE WHEN is_new_entry THEN 'new' WHEN is_exit THEN 'exit' WHEN net_shares > 0 THEN 'buyer' WHEN net_shares < 0 THEN 'seller' ELSE 'unchanged' END AS kind,
  count(*) AS entities, {S("net_shares")} AS net_shares, sum(round(price_adj_flow * 100)) / 100 AS price_adj_flow, {S("raw_flow")} AS raw_flow
FROM investor WHERE ticker = '{TICKER}' AND period = '1Q' GROUP BY 1"""


def holder_momentum(t: Tables, ticker: str = TICKER) -> DataFrame:
    """Top 25 parents over the quarters; change from the first quarter that has them."""
    rows = at(named(t, t.latest), ticker).where(F.col("quarter").isin(*QUARTERS))
    names = [f"q{k + 1}" for k in range(4)]
    wide = rows.groupBy("parent_name").pivot("quarter", list(QUARTERS)).agg(F.sum("shares")).withColumnsRenamed(dict(zip(QUARTERS, names, strict=True)))
    first = F.coalesce(*names)
    wide = wide.withColumn("change", F.coalesce("q4", F.lit(0)) - first).withColumn("change_pct", ratio(F.coalesce("q4", F.lit(0)) - first, first, 100))
    return top_n(wide, [], [desc("q4"), F.asc("parent_name")], 25)


_HM = ", ".join(f"{S(f'''CASE WHEN quarter = '{q}' THEN shares END''')} AS q{k + 1}" for k, q in enumerate(QUARTERS))
HOLDER_MOMENTUM = f"""{NAMED}, w AS (SELECT parent_name, {_HM} FROM named WHERE ticker = '{TICKER}' AND quarter IN {sql_list(QUARTERS)} GROUP BY 1)
SELECT * FROM (SELECT *, coalesce(q4, 0) - coalesce(q1, q2, q3, q4) AS change, (coalesce(q4, 0) - coalesce(q1, q2, q3, q4)) * 100.0::DOUBLE / nullif(coalesce(q1, q2, q3, q4), 0) AS change_pct,
  row_number() OVER (ORDER BY q4 DESC NULLS LAST, parent_name) AS rank FROM w) q WHERE rank <= 25"""


def ownership_trend(t: Tables, ticker: str = TICKER) -> DataFrame:
    """Per quarter: holders, shares, active share, net change on the quarter before and its direction (0.5 % either way is flat)."""
    rows = at(t.latest, ticker).where(F.col("quarter").isin(*QUARTERS))
    by = rows.groupBy("quarter").agg(F.count_distinct("cik").alias("holders"), F.sum("shares").alias("shares"), F.sum(F.when(~F.col("manager_type").isin("passive", "unknown"), F.col("shares")).otherwise(0)).alias("active_shares"))
    before = F.lag("shares").over(Window.orderBy("quarter"))
    change = ratio(F.col("shares") - before, before, 100)
    arrow = F.when(change.isNull(), F.lit(None).cast("string")).when(change > 0.5, "up").when(change < -0.5, "down").otherwise("flat")
    return by.select("quarter", "holders", "shares", ratio(F.col("active_shares"), F.col("shares"), 100).alias("active_pct"), (F.col("shares") - before).alias("net_shares"), change.alias("change_pct"), arrow.alias("direction"))


OWNERSHIP_TREND = f"""b AS (SELECT quarter, count(DISTINCT cik) AS holders, {S("shares")} AS shares, {S("CASE WHEN manager_type NOT IN ('passive', 'unknown') THEN shares ELSE 0 END")} AS a
  FROM holdings WHERE is_latest AND ticker = '{TICKER}' AND quarter IN {sql_list(QUARTERS)} GROUP BY 1),
l AS (SELECT *, lag(shares) OVER (ORDER BY quarter) AS p FROM b)
SELECT quarter, holders, shares, a * 100.0::DOUBLE / nullif(shares, 0) AS active_pct, shares - p AS net_shares, (shares - p) * 100.0::DOUBLE / nullif(p, 0) AS change_pct,
  CASE WHEN p IS NULL THEN NULL WHEN (shares - p) * 100.0::DOUBLE / p > 0.5 THEN 'up' WHEN (shares - p) * 100.0::DOUBLE / p < -0.5 THEN 'down' ELSE 'flat' END AS direction FROM l"""


# --- pair flows: sector flows and peer rotation ---------------------------


def pair_flows(rows: DataFrame, entity: str, kind: Column | None = None) -> DataFrame:
    """Active flows of each entity and ticker between consecutive quarters, all pairs in one pass.

    A held position counts its change in shares at the quarter's implied
    price; one that is gone counts minus its last value; both in whole cents. A missing quarter is
    an exit, so each position is laid on the quarters by one union of its own
    rows and their successors instead of a self join.
    """
    rows = rows.where(F.col("quarter").isin(*QUARTERS))
    agg = rows.groupBy(entity, "ticker", "quarter").agg(F.sum("shares").alias("shares"), F.sum("market_value_usd").alias("value"), F.max(kind if kind is not None else F.lit(None).cast("string")).alias("entity_type"))
    number = F.array_position(F.array(*[F.lit(q) for q in QUARTERS]), F.col("quarter")).cast("int")
    here = agg.withColumn("k", number).withColumn("own", F.lit(True))
    ahead = here.where(F.col("k") < len(QUARTERS)).withColumn("k", F.col("k") + 1).withColumn("own", F.lit(False))
    cells = here.unionByName(ahead).groupBy(F.col(entity).alias("entity"), "ticker", "k").agg(
        *[F.max(F.when(F.col("own") == own, F.col(c))).alias(f"{p}{c}") for own, p in ((True, ""), (False, "p_")) for c in ("shares", "value", "entity_type")])
    cells = cells.where("k > 1")
    flow = F.when(F.col("value").isNotNull(), (F.col("shares") - F.coalesce("p_shares", F.lit(0))) * ratio(F.col("value"), F.col("shares"))).otherwise(-F.col("p_value").cast("double"))
    labels = F.array(*[F.lit(q) for q in QUARTERS])
    return cells.select("entity", "ticker", F.element_at(labels, F.col("k") - 1).alias("quarter_from"), F.element_at(labels, F.col("k")).alias("quarter_to"), F.coalesce("entity_type", "p_entity_type").alias("entity_type"), cents(flow).alias("active_flow"),
                        F.when(F.col("value").isNull(), "exit").when(F.col("p_value").isNull(), "new").otherwise("change").alias("flow_type"))


def _pairs_sql(source: str, entity: str, kind: str) -> str:
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in zip(QUARTERS, QUARTERS[1:], strict=False))
    return f"""pa AS (SELECT {entity} AS entity, ticker, quarter, {S("shares")} AS shares, {S("market_value_usd")} AS v, max({kind}) AS entity_type FROM {source} WHERE is_latest GROUP BY 1, 2, 3),
pq AS (SELECT * FROM (VALUES {pairs}) x(qf, qt)),
pair AS (SELECT c.entity, c.ticker, qf AS quarter_from, qt AS quarter_to, c.entity_type, round((c.shares - coalesce(p.shares, 0)) * (c.v::DOUBLE / nullif(c.shares, 0)) * 100) AS active_flow,
    CASE WHEN p.entity IS NULL THEN 'new' ELSE 'change' END AS flow_type
  FROM pq JOIN pa c ON c.quarter = qt LEFT JOIN pa p ON p.quarter = qf AND p.entity = c.entity AND p.ticker = c.ticker
  UNION ALL SELECT p.entity, p.ticker, qf, qt, p.entity_type, round(-p.v::DOUBLE * 100), 'exit' FROM pq JOIN pa p ON p.quarter = qf
  LEFT JOIN pa c ON c.quarter = qt AND c.entity = p.entity AND c.ticker = p.ticker WHERE c.entity IS NULL)"""


_HPAIRS, _FPAIRS = _pairs_sql("holdings", "cik", "entity_type"), _pairs_sql("fund_holdings", "series_id", "CAST(NULL AS VARCHAR)")


def sector_flows_rollup(t: Tables) -> DataFrame:
    """Net, in and out flows, new and exited positions and managers by sector and quarter pair, for all and for active holders."""
    rows = pair_flows(t.latest, "cik", F.col("entity_type")).join(t.market_data.select("ticker", "sector"), "ticker")
    views = rows.withColumn("active_only", F.explode(F.when(F.col("entity_type").isin(*ROTATION_ACTIVE), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    flow, pair = F.col("active_flow"), F.concat("entity", F.lit("|"), "ticker")
    return views.groupBy("active_only", "sector", "quarter_from", "quarter_to").agg(
        dollars(F.sum(flow)).alias("net"), dollars(F.sum(F.when(flow > 0, flow).otherwise(0.0))).alias("inflow"), dollars(F.sum(F.when(flow < 0, flow).otherwise(0.0))).alias("outflow"),
        F.count_distinct(F.when(F.col("flow_type") == "new", pair)).alias("new_positions"), F.count_distinct(F.when(F.col("flow_type") == "exit", pair)).alias("exits"), F.count_distinct("entity").alias("managers"))


SECTOR_FLOWS = f"""{_HPAIRS},
v AS (SELECT p.*, sector, FALSE AS active_only FROM pair p JOIN market_data m ON p.ticker = m.ticker UNION ALL
      SELECT p.*, sector, TRUE FROM pair p JOIN market_data m ON p.ticker = m.ticker WHERE entity_type IN {sql_list(ROTATION_ACTIVE)})
SELECT active_only, sector, quarter_from, quarter_to, sum(active_flow) / 100 AS net, sum(CASE WHEN active_flow > 0 THEN active_flow ELSE 0 END) / 100 AS inflow,
  sum(CASE WHEN active_flow < 0 THEN active_flow ELSE 0 END) / 100 AS outflow, count(DISTINCT CASE WHEN flow_type = 'new' THEN entity || '|' || ticker END) AS new_positions,
  count(DISTINCT CASE WHEN flow_type = 'exit' THEN entity || '|' || ticker END) AS exits, count(DISTINCT entity) AS managers FROM v GROUP BY 1, 2, 3, 4"""


def sector_flow_movers(t: Tables, sector: str = "ECONOMY") -> DataFrame:
    """Institutions by net flow into a sector over the last pair: top 5 and bottom 5 (none twice)."""
    rows = pair_flows(t.latest, "cik").where(F.col("quarter_to") == LATEST).join(t.market_data.where(F.col("sector") == sector).select("ticker"), "ticker", "left_semi")
    flow = F.col("active_flow")
    net = rows.groupBy("entity").agg(dollars(F.sum(flow)).alias("net"), dollars(F.sum(F.when(flow > 0, flow).otherwise(0.0))).alias("buying"), dollars(F.sum(F.when(flow < 0, flow).otherwise(0.0))).alias("selling")).where("net is not null")
    up = top_n(net, [], [F.desc("net"), F.asc("entity")], 5).withColumn("side", F.lit("top"))
    down = top_n(net.join(F.broadcast(up.select("entity")), "entity", "left_anti"), [], [F.asc("net"), F.asc("entity")], 5).withColumn("side", F.lit("bottom"))
    return up.unionByName(down)


SECTOR_MOVERS = f"""{_HPAIRS},
n AS (SELECT entity, sum(active_flow) / 100 AS net, sum(CASE WHEN active_flow > 0 THEN active_flow ELSE 0 END) / 100 AS buying, sum(CASE WHEN active_flow < 0 THEN active_flow ELSE 0 END) / 100 AS selling
  FROM pair p JOIN market_data m ON p.ticker = m.ticker WHERE quarter_to = '{LATEST}' AND sector = 'ECONOMY' GROUP BY 1 HAVING sum(active_flow) IS NOT NULL),
u AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY net DESC, entity) AS rank FROM n) q WHERE rank <= 5),
d AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY net, entity) AS rank FROM n WHERE entity NOT IN (SELECT entity FROM u)) q WHERE rank <= 5)
SELECT *, 'top' AS side FROM u UNION ALL SELECT *, 'bottom' FROM d"""


def peer_rotation_flows(t: Tables) -> DataFrame:
    """Flows by level, sector, entity, ticker and quarter pair: 13F parents and funds; positions without an implied price are left out."""
    sectors = t.market_data.select("ticker", "sector")
    a = pair_flows(t.latest.withColumn("parent", F.coalesce("rollup_name", "inst_parent_name", "manager_name")), "parent").withColumn("level", F.lit("parent"))
    b = pair_flows(t.fund_latest, "series_id").withColumn("level", F.lit("fund"))
    both = a.unionByName(b).join(sectors, "ticker")
    return both.groupBy("level", "sector", "entity", "ticker", "quarter_from", "quarter_to").agg(dollars(F.sum("active_flow")).alias("active_flow")).where("active_flow is not null")


_PEER = _pairs_sql("holdings", "coalesce(rollup_name, inst_parent_name, manager_name)", "CAST(NULL AS VARCHAR)")
_PEER_F = _FPAIRS.replace("pa AS", "fpa AS").replace("JOIN pa ", "JOIN fpa ").replace("pair AS", "fpair AS").replace("pq AS", "fpq AS").replace("FROM pq", "FROM fpq")
PEER_ROTATION = f"""{_PEER}, {_PEER_F},
u AS (SELECT *, 'parent' AS level FROM pair UNION ALL SELECT *, 'fund' FROM fpair)
SELECT level, sector, entity, u.ticker, quarter_from, quarter_to, sum(active_flow) / 100 AS active_flow FROM u JOIN market_data m ON u.ticker = m.ticker
GROUP BY 1, 2, 3, 4, 5, 6 HAVING sum(active_flow) IS NOT NULL"""


def _entity_ticker(t: Tables, ticker: str) -> DataFrame:
    """Parent-level flow of each entity and ticker of the subject's sector, over all pairs; and the subject's flow of the entity."""
    sector = t.market_data.where(F.col("ticker") == ticker).select(F.col("sector").alias("own"))
    rows = pair_flows(t.latest.withColumn("parent", F.coalesce("rollup_name", "inst_parent_name", "manager_name")), "parent")
    rows = rows.join(t.market_data.select("ticker", "sector", "industry"), "ticker").join(sector, F.col("sector") == F.col("own"))
    flows = rows.groupBy("entity", "ticker", "industry").agg(F.sum("active_flow").alias("flow")).where("flow is not null")
    return flows.withColumn("subject", F.coalesce(F.sum(F.when(F.col("ticker") == ticker, F.col("flow"))).over(Window.partitionBy("entity")), F.lit(0.0)))


_ENTITY_TICKER = f"""{_PEER},
et AS (SELECT entity, p.ticker, industry, sum(active_flow) AS flow FROM pair p JOIN market_data m ON p.ticker = m.ticker
  WHERE sector = (SELECT sector FROM market_data WHERE ticker = '{TICKER}') GROUP BY 1, 2, 3 HAVING sum(active_flow) IS NOT NULL),
es AS (SELECT *, coalesce(sum(CASE WHEN ticker = '{TICKER}' THEN flow END) OVER (PARTITION BY entity), 0) AS subject FROM et)"""


def peer_substitutions(t: Tables, ticker: str = TICKER) -> DataFrame:
    """Peers that entities moved into as they moved out of the subject, or the reverse, by the lesser of the two flows."""
    rows = _entity_ticker(t, ticker).where((F.col("ticker") != ticker) & (F.col("flow") * F.col("subject") < 0))
    out = rows.groupBy("ticker", "industry").agg(dollars(F.sum("flow")).alias("net_peer_flow"), dollars(F.sum("subject")).alias("contra_subject_flow"), F.count("*").alias("num_entities"), dollars(F.sum(F.least(F.abs("flow"), F.abs("subject")))).alias("magnitude"))
    return out.withColumn("direction", F.when(F.col("net_peer_flow") > 0, "replacing").otherwise("replaced_by"))


PEER_SUBS = f"""{_ENTITY_TICKER}
SELECT ticker, industry, sum(flow) / 100 AS net_peer_flow, sum(subject) / 100 AS contra_subject_flow, count(*) AS num_entities, sum(least(abs(flow), abs(subject))) / 100 AS magnitude,
  CASE WHEN sum(flow) > 0 THEN 'replacing' ELSE 'replaced_by' END AS direction FROM es WHERE ticker <> '{TICKER}' AND flow * subject < 0 GROUP BY 1, 2"""


def peer_rotation_stories(t: Tables, ticker: str = TICKER) -> DataFrame:
    """The ten entities that moved most in the subject, each with its three largest opposite peers."""
    rows = _entity_ticker(t, ticker)
    best = rows.groupBy("entity").agg(dollars(F.max("subject")).alias("subject_flow"), dollars(F.sum("flow")).alias("sector_flow")).where("subject_flow <> 0 or sector_flow <> 0")
    best = top_n(best, [], [F.desc(F.abs("subject_flow")), F.asc("entity")], 10, "story")
    contra = rows.where((F.col("ticker") != ticker) & (F.col("flow") * F.col("subject") < 0)).select("entity", F.col("ticker").alias("peer"), dollars(F.col("flow")).alias("peer_flow"))
    contra = top_n(contra, ["entity"], [F.desc(F.abs("peer_flow")), F.asc("peer")], 3, "peer_rank")
    return best.join(contra, "entity", "left")


STORIES = f"""{_ENTITY_TICKER},
b AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY abs(subject_flow) DESC, entity) AS story FROM (SELECT entity, max(subject) / 100 AS subject_flow, sum(flow) / 100 AS sector_flow FROM es GROUP BY 1) q
      WHERE subject_flow <> 0 OR sector_flow <> 0) q WHERE story <= 10),
c AS (SELECT * FROM (SELECT entity, ticker AS peer, flow / 100 AS peer_flow, row_number() OVER (PARTITION BY entity ORDER BY abs(flow) DESC, ticker) AS peer_rank FROM es WHERE ticker <> '{TICKER}' AND flow * subject < 0) q WHERE peer_rank <= 3)
SELECT b.*, peer, peer_flow, peer_rank FROM b LEFT JOIN c ON b.entity = c.entity"""


def peer_rotation_detail(t: Tables, ticker: str = TICKER, peer: str = "P17") -> DataFrame:
    """Entities with flows in a subject and a peer, the 20 largest in sum of sizes."""
    rows = pair_flows(t.latest.withColumn("parent", F.coalesce("rollup_name", "inst_parent_name", "manager_name")), "parent").where(F.col("ticker").isin(ticker, peer))
    pick = lambda x: dollars(F.sum(F.when(F.col("ticker") == x, F.col("active_flow")).otherwise(0.0)))
    by = rows.groupBy("entity").agg(pick(ticker).alias("subject_flow"), pick(peer).alias("peer_flow"))
    return top_n(by, [], [F.desc(F.abs("subject_flow") + F.abs("peer_flow")), F.asc("entity")], 20)


DETAIL = f"""{_PEER},
b AS (SELECT entity, sum(CASE WHEN ticker = '{TICKER}' THEN active_flow ELSE 0 END) / 100 AS subject_flow, sum(CASE WHEN ticker = 'P17' THEN active_flow ELSE 0 END) / 100 AS peer_flow
  FROM pair WHERE ticker IN ('{TICKER}', 'P17') GROUP BY 1)
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY abs(subject_flow) + abs(peer_flow) DESC, entity) AS rank FROM b) q WHERE rank <= 20"""

QUERIES = {
    "investor_flows": (investor_flows, statement(_flows_sql(EC) + " SELECT * FROM investor")),
    "investor_flows_dm": (investor_flows_dm, statement(_flows_sql(DM) + " SELECT * FROM investor")),
    "ticker_flow_stats": (ticker_flow_stats, statement(TICKER_FLOW_STATS)),
    "cohort_analysis": (cohort_analysis, statement(COHORT)),
    "cohort_summary": (cohort_summary, statement(COHORT_SUMMARY)),
    "cohort_top5": (cohort_top5, statement(COHORT_TOP5)),
    "flows_live": (flows_live, statement(FLOWS_LIVE)),
    "flow_analysis": (flow_analysis, statement(FLOW_ANALYSIS)),
    "holder_momentum": (holder_momentum, statement(HOLDER_MOMENTUM)),
    "ownership_trend": (ownership_trend, statement(OWNERSHIP_TREND)),
    "sector_flows_rollup": (sector_flows_rollup, statement(SECTOR_FLOWS)),
    "sector_flow_movers": (sector_flow_movers, statement(SECTOR_MOVERS)),
    "peer_rotation_flows": (peer_rotation_flows, statement(PEER_ROTATION)),
    "peer_substitutions": (peer_substitutions, statement(PEER_SUBS)),
    "peer_rotation_stories": (peer_rotation_stories, statement(STORIES)),
    "peer_rotation_detail": (peer_rotation_detail, statement(DETAIL)),
}
