"""Rule ladders and filing-text extraction as queries, over rows that reach each of their branches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as X
from ..operators.relational import ratio
from ..sources.canonical import Tables, pick, statement
from .common import S


def _any(x: str, words: tuple[str, ...], whole: bool = False) -> str:
    """DuckDB: whether ``x`` has any of the words."""
    parts = "|".join("".join("\\" + c if c in ".&$-()+*?[]{}|^/" else c for c in w.upper()) for w in words).replace("'", "''")
    return rf"regexp_matches({x}, '\b(?:{parts})\b')" if whole else f"regexp_matches({x}, '{parts}')"


def _in(x: str, words: tuple[str, ...]) -> str:
    return f"{x} IN (" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


# --- securities -----------------------------------------------------------


def classify_securities(t: Tables) -> DataFrame:
    """Canonical type of each security row, with its source, confidence and flags."""
    rows = t.security_rows
    return rows.select("row_id", rules.classify_security(F.col("raw"), F.col("category"), F.col("sector"), F.col("exchange")).alias("c")).select("row_id", "c.*")


def _classify_sql() -> str:
    text = "upper(coalesce(raw, ''))"
    text = rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"
    bare = "up"
    for mark in rules.MARKS:
        bare = f"regexp_replace({bare}, '{mark}', ' ', 'g')"
    bare = rf"regexp_replace(regexp_replace({bare}, '\s+', ' ', 'g'), '^[ ,-]+|[ ,-]+$', '', 'g')"
    last = len(rules.TYPE_RULES) - 1
    rule = lambda x: f"CASE WHEN {x} = '' THEN {last} " + " ".join(f"WHEN {_in(x, r[0])} OR {_any(x, r[0], True)} THEN {k}" for k, r in enumerate(rules.TYPE_RULES)) + " END"
    rank = "CASE " + " ".join(f"WHEN rule = {k} THEN {rules.PRECEDENCE.index(r[1])}" for k, r in enumerate(rules.TYPE_RULES) if r[1] in rules.PRECEDENCE) + f" ELSE {len(rules.PRECEDENCE)} END"
    b = lambda x: "TRUE" if x else "FALSE"
    columns = lambda f: {c: f(k) for k, c in enumerate(("kind", "equity", "priced", "permanent"))}
    by_rule = {c: "CASE rule " + " ".join(f"WHEN {k} THEN {repr(r[j + 1]) if j == 0 else b(r[j + 1])}" for k, r in enumerate(rules.TYPE_RULES)) + " END" for j, c in enumerate(("kind", "equity", "priced", "permanent", "expected"))}
    sector = columns(lambda j: "CASE sector " + " ".join(f"WHEN '{k}' THEN {repr(v[j]) if j == 0 else b(v[j])}" for k, v in rules.SECTOR_TYPES.items()) + " END")
    seeded = columns(lambda j: "CASE seed " + " ".join(f"WHEN '{k}' THEN {repr(v[j]) if j == 0 else b(v[j])}" for k, v in rules.SEED_TYPES.items()) + " END")
    seed = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.SEEDS.items()) + " END"
    step = lambda deriv, c, stock, loose: f"CASE step WHEN 1 THEN {deriv} WHEN 2 THEN {sector[c]} WHEN 3 THEN {seeded[c]} WHEN 4 THEN {stock} WHEN 5 THEN {by_rule[c]} ELSE {loose} END"
    hint = "coalesce(sector = 'Equity', FALSE)"
    priced = f"coalesce({_in('exchange', rules.PRICED_EXCHANGES)}, FALSE)"
    return rf"""u AS (SELECT *, {text} AS up FROM security_rows),
v AS (SELECT *, {bare} AS bare FROM u),
w AS (SELECT *, CASE WHEN regexp_matches(up, '^(CL|CLASS)\s+[A-Z]$') OR (bare = '' AND regexp_matches(up, '\b(CL|CLASS|SHS|ORD)\b')) THEN 'COM' ELSE bare END AS text,
        {seed} AS seed FROM v),
parts AS (SELECT row_id, list_filter(list_transform(string_split_regex(text, '(?i)\s+(?:and|&|/)\s+'), lambda y: trim(y)), lambda y: y <> '') AS p FROM w),
each AS (SELECT row_id, len(p) AS n, unnest(CASE WHEN len(p) = 0 THEN [''] ELSE p END) AS y, generate_subscripts(CASE WHEN len(p) = 0 THEN [''] ELSE p END, 1) AS pos FROM parts),
ruled AS (SELECT row_id, n, pos, {rule("y")} AS rule FROM each),
best AS (SELECT row_id, rule FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY n > 1 AND (rule IS NULL OR rule = {last}), {rank}, pos) AS k FROM ruled) q
         WHERE k = 1 AND NOT (n > 1 AND (rule IS NULL OR rule = {last}))),
x AS (SELECT w.*, best.rule FROM w LEFT JOIN best ON w.row_id = best.row_id),
y AS (SELECT *, coalesce({_in("category", rules.DERIVATIVE_CATEGORIES)}, FALSE) AS by_category, CASE WHEN coalesce({_in("category", rules.DERIVATIVE_CATEGORIES)}, FALSE) OR {_any("text", rules.DERIVATIVE_WORDS, True)} THEN 1
        WHEN {_in("sector", tuple(rules.SECTOR_TYPES))} THEN 2 WHEN {_in("seed", tuple(rules.SEED_TYPES))} THEN 3 WHEN seed = 'equity' AND coalesce(rule, {last}) = {last} THEN 4 WHEN rule IS NOT NULL THEN 5 ELSE 6 END AS step FROM x),
z AS (SELECT *, {step(f"CASE WHEN {_any('text', rules.WARRANT_WORDS, True)} THEN 'WARRANT' ELSE 'OPTION' END", "kind", "CASE WHEN category = 'EP' THEN 'PREF' ELSE 'COM' END", "'OTHER'")} AS kind,
        {step("FALSE", "equity", "TRUE", hint)} AS equity, {step("FALSE", "priced", "TRUE", hint)} AS priced, {step("TRUE", "permanent", "FALSE", "FALSE")} AS permanent,
        CASE step WHEN 2 THEN {sector["equity"]} AND {sector["priced"]} WHEN 4 THEN TRUE WHEN 5 THEN {by_rule["expected"]} ELSE FALSE END AS expected FROM y)
SELECT row_id, kind AS canonical_type, CASE step WHEN 1 THEN CASE WHEN by_category THEN 'asset_category' ELSE 'raw_type' END WHEN 2 THEN 'market_sector' WHEN 3 THEN 'asset_category' WHEN 4 THEN 'asset_category'
         ELSE CASE WHEN {hint} THEN 'market_sector' ELSE 'inferred' END END AS source,
       CASE step WHEN 1 THEN CASE WHEN by_category THEN 'high' ELSE 'medium' END WHEN 2 THEN 'high' WHEN 3 THEN 'medium' WHEN 4 THEN 'medium' WHEN 5 THEN CASE WHEN kind = 'OTHER' THEN 'low' ELSE 'medium' END ELSE 'low' END AS confidence,
       NOT permanent AND equity AS is_equity, NOT permanent AND CASE WHEN kind = 'FOREIGN' THEN {priced} ELSE priced END AS is_priceable, permanent AS is_permanent,
       NOT permanent AND CASE WHEN kind = 'FOREIGN' THEN {priced} ELSE expected END AS ticker_expected, coalesce({_in("exchange", rules.GREY_EXCHANGES)}, FALSE) AS is_otc FROM z"""


# --- filing texts ---------------------------------------------------------


def extract_13dg(t: Tables) -> DataFrame:
    """Every field of ownership filings by the ordered cascades over their cleaned texts."""
    rows = t.filing_rows
    text = X.clean_text(F.col("html"))
    rows = rows.select("filing_id", "filing_type", text.alias("text"))
    x = F.col("text")
    return rows.select("filing_id", X.cusip(x).alias("cusip"), X.pct_owned(x).alias("pct"), X.shares_owned(x).alias("shares"), X.event_date(x).cast("string").alias("event_date"), X.purpose(x, F.col("filing_type")).alias("purpose"), X.reporting_person(x).alias("person"))


#: What the texts were made to say: statement of its own, without patterns.
EXTRACT = """SELECT o_orderkey AS filing_id, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 9, '0') AS cusip,
  CASE WHEN o_orderkey % 10 = 9 OR o_orderkey % 120 > 99 THEN NULL ELSE CAST(o_orderkey % 120 AS DOUBLE) + 0.5 END AS pct,
  CASE WHEN o_orderkey % 9 = 8 THEN NULL WHEN o_orderkey % 9 = 3 AND 10 + o_orderkey % 977 * 7 < 1000 THEN NULL WHEN 10 + o_orderkey % 977 * 7 < 100 THEN NULL ELSE CAST(10 + o_orderkey % 977 * 7 AS BIGINT) END AS shares,
  CASE WHEN o_orderkey % 5 < 3 THEN CAST(make_date(2001, 3, 1 + o_orderkey % 28) AS VARCHAR) END AS event_date,
  CASE WHEN o_orderkey % 4 >= 2 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'The filer bought lot ' || o_orderkey || '.' WHEN o_orderkey % 3 = 1 THEN ': to hold lot ' || o_orderkey || ' and nothing else' END AS purpose,
  CASE o_orderkey % 7 WHEN 0 THEN 'Alpha Partners' WHEN 1 THEN 'Beta Capital' WHEN 2 THEN 'Gamma Fund' WHEN 3 THEN 'Delta Trust' END AS person FROM orders"""


def parse_13dg(t: Tables) -> DataFrame:
    """Filings as rows of the ownership table, with the checks' verdicts: percent out of range is blocked, under 100 shares flagged."""
    rows = extract_13dg(t).join(t.filing_rows.select("filing_id", "filing_type", "filer"), "filing_id")
    kind = F.col("filing_type")
    return rows.select("filing_id", F.lpad("filer", 10, "0").alias("filer_cik"), F.coalesce("person", "filer").alias("filer_name"), F.when(kind.contains("13D"), "activist").otherwise("passive").alias("intent"), kind.contains("/A").alias("is_amendment"), X.ownership_check(F.col("pct"), F.col("shares")).alias("verdict"))


PARSE = f"""e AS ({EXTRACT}), f AS (SELECT o_orderkey AS filing_id, CAST(o_custkey AS VARCHAR) AS filer, CASE o_orderkey % 4 WHEN 0 THEN 'SC 13D' WHEN 1 THEN 'SC 13D/A' WHEN 2 THEN 'SC 13G' ELSE 'SC 13G/A' END AS filing_type FROM orders)
SELECT e.filing_id, lpad(filer, 10, '0') AS filer_cik, coalesce(person, filer) AS filer_name, CASE WHEN filing_type LIKE '%13D%' THEN 'activist' ELSE 'passive' END AS intent, filing_type LIKE '%/A%' AS is_amendment,
  CASE WHEN pct < 0 OR pct > 100 THEN 'pct_out_of_range' WHEN shares > 0 AND shares < 100 THEN 'shares_tiny' ELSE 'ok' END AS verdict FROM e JOIN f ON e.filing_id = f.filing_id"""


# --- advisers, funds, industries, tickers ---------------------------------


def adviser_strategies(t: Tables) -> DataFrame:
    """Strategy and activist flag of every adviser."""
    c = F.col
    return t.advisers.select("crd_number", "firm_name", rules.adviser_strategy(c("firm_name"), c("pct"), c("hedge"), c("private"), c("venture")).alias("strategy"), rules.is_activist(c("firm_name")).alias("is_activist"))


ADVISERS = f"""SELECT crd_number, firm_name, CASE WHEN {_any("upper(firm_name)", rules.PASSIVE_ADVISERS)} OR pct < 10 THEN 'passive' WHEN hedge = 'Y' OR {_any("upper(firm_name)", rules.HEDGE_ADVISERS)} THEN 'hedge_fund'
  WHEN {_any("upper(firm_name)", rules.QUANT_ADVISERS)} THEN 'quantitative' WHEN {_any("upper(firm_name)", rules.MULTI_ADVISERS)} THEN 'multi_strategy'
  WHEN private = 'Y' OR venture = 'Y' OR {_any("upper(firm_name)", rules.PRIVATE_ADVISERS)} THEN 'private_equity' WHEN pct >= 80 THEN 'active' ELSE 'unknown' END AS strategy,
  {_any("upper(firm_name)", rules.ACTIVISTS)} AS is_activist FROM advisers"""


def fund_classify(t: Tables) -> DataFrame:
    """Fund strategies: by name, then final filing, then no positions, then the equity share of value (0.90, 0.60, 0.30)."""
    held = t.fund_latest.where("series_id not like '%13'").groupBy("series_id").agg(F.count("*").alias("positions"), F.sum(F.when(F.col("asset_category").isin("EC", "EP"), F.col("market_value_usd")).otherwise(0)).alias("eq"), F.sum("market_value_usd").alias("total"))
    rows = t.fund_names.join(held, "series_id", "left")
    share = F.coalesce(ratio(F.col("eq"), F.col("total")), F.lit(0.0))
    return rows.select("series_id", "fund_name", X.fund_strategy(F.col("fund_name"), share, F.col("positions"), F.col("is_final")).alias("strategy"), rules.fund_by_keywords(F.col("fund_name")).alias("by_keywords"))


_PASSIVE, _EXCLUDED = (p.replace("'", "''") for p in (X.PASSIVE_NAME, X.EXCLUDED_NAME))
FUND_CLASSIFY = f"""h AS (SELECT series_id, count(*) AS n, {S("CASE WHEN asset_category IN ('EC', 'EP') THEN market_value_usd ELSE 0 END")}::DOUBLE / nullif({S("market_value_usd")}, 0) AS s FROM fund_holdings WHERE is_latest AND series_id NOT LIKE '%13' GROUP BY 1)
SELECT f.series_id, fund_name, CASE WHEN regexp_matches(lower(fund_name), '{_PASSIVE}') THEN 'passive' WHEN regexp_matches(lower(fund_name), '{_EXCLUDED}') THEN 'excluded' WHEN is_final THEN 'final_filing' WHEN n IS NULL THEN 'empty'
  WHEN s >= 0.90 THEN 'active' WHEN s >= 0.60 THEN 'balanced' WHEN s >= 0.30 THEN 'multi_asset' ELSE 'bond_or_other' END AS strategy,
  CASE WHEN {_any("upper(fund_name)", rules.INDEX_WORDS)} OR {" OR ".join(f"(contains(upper(fund_name), '{a}') AND contains(upper(fund_name), '{b}'))" for a, b in rules.INDEX_PAIRS)} THEN 'passive' ELSE 'active' END AS by_keywords
FROM fund_names f LEFT JOIN h ON f.series_id = h.series_id"""


def industry_classes(t: Tables) -> DataFrame:
    """Class of each industry code, and why a ticker has no quote."""
    return t.code_rows.select("row_id", rules.industry_class(F.col("sic")).alias("industry"), rules.unfetchable(F.col("ticker")).alias("reason"))


INDUSTRY = """SELECT row_id, CASE WHEN TRY_CAST(sic AS INTEGER) IS NULL THEN 'unknown' WHEN sic = '6726' THEN 'hedge_fund' WHEN TRY_CAST(sic AS INTEGER) BETWEEN 6020 AND 6036 OR sic IN ('6211', '6282', '6199') OR TRY_CAST(sic AS INTEGER) BETWEEN 6310 AND 6399 OR TRY_CAST(sic AS INTEGER) BETWEEN 6710 AND 6725 THEN 'active' ELSE 'unknown' END AS industry,
  CASE row_id % 12 WHEN 0 THEN 'empty' WHEN 1 THEN 'empty' WHEN 2 THEN 'bond' WHEN 3 THEN 'warrant' WHEN 4 THEN 'warrant' WHEN 5 THEN 'preferred' WHEN 6 THEN 'preferred' WHEN 7 THEN 'class_marker' WHEN 8 THEN 'fx_suffix' END AS reason FROM code_rows"""


def manager_types(t: Tables) -> DataFrame:
    """Holders' types filled from a curated list of names, where none is known; the list's first entry of a name counts."""
    curated = t.curated_types.groupBy("name").agg(F.min_by("kind", "pos").alias("kind"))
    rows = t.latest.groupBy("cik").agg(F.max("manager_name").alias("manager_name"), F.max("manager_type").alias("manager_type"))
    rows = rows.join(curated, F.lower(F.trim("manager_name")) == F.col("name"), "left")
    known = F.nullif(F.nullif("manager_type", F.lit("")), F.lit("unknown"))
    return rows.select("cik", "manager_name", F.coalesce(known, "kind", F.lit("unknown")).alias("manager_type"), (known.isNull() & F.col("kind").isNotNull()).alias("filled"))


MANAGER_TYPES = """c AS (SELECT name, arg_min(kind, pos) AS kind FROM curated_types GROUP BY 1),
m AS (SELECT cik, max(manager_name) AS manager_name, max(manager_type) AS mt FROM holdings WHERE is_latest GROUP BY 1)
SELECT cik, manager_name, coalesce(nullif(nullif(mt, ''), 'unknown'), kind, 'unknown') AS manager_type, nullif(nullif(mt, ''), 'unknown') IS NULL AND kind IS NOT NULL AS filled FROM m LEFT JOIN c ON lower(trim(manager_name)) = name"""

QUERIES = {
    "classify_securities": (classify_securities, statement(_classify_sql())),
    "extract_13dg": (extract_13dg, statement(EXTRACT)),
    "parse_13dg": (parse_13dg, statement(PARSE)),
    "adviser_strategies": (adviser_strategies, statement(ADVISERS)),
    "fund_classify": (fund_classify, statement(FUND_CLASSIFY)),
    "industry_classes": (industry_classes, statement(INDUSTRY)),
    "manager_types": (manager_types, statement(MANAGER_TYPES)),
}
