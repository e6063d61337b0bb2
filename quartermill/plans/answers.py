"""Whole answers made of several parts, security lookups, guards, name matching and rollback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LATEST, OTHER, TICKER
from ..operators import promote
from ..operators.relational import not_in, ratio
from ..sources.canonical import Tables, statement
from .builders import BOC, beneficial_ownership_current
from .common import S
from .register import QUERY7, query7_portfolio

#: The day that ages of filings are counted from.
AS_OF = "2001-09-30"
# Fixed value: the form of a ticker.
TICKER_FORM = r"^[A-Z]{1,6}(\.[A-Z])?$"
#: Default parameter: name parts of parents, in order, with the family terms of each.
FAMILIES = (("land &", ("LAND", "BUILDINGS")), ("index", ("FAMILY_1", "FAMILY_2")), ("third", ("POINT",)), ("sigma", ("FAMILY_3", "two sig")))

_SECTION = {
    "filer": "string", "quarter": "string", "filing_type": "string", "on_date": "date", "pct_owned": "double", "shares_owned": "bigint", "value": "bigint", "prior_intent": "string",
    "amendment_count": "bigint", "days_since": "int", "is_current": "boolean",
}


def _section(df: DataFrame, name: str, **columns: str | Column) -> DataFrame:
    cell = lambda c: F.col(columns[c]) if isinstance(columns.get(c), str) else columns.get(c, F.lit(None))
    return df.select(F.lit(name).alias("section"), *[cell(c).cast(kind).alias(c) for c, kind in _SECTION.items()])


def query6_sections(t: Tables, ticker: str = TICKER, as_of: str = AS_OF) -> DataFrame:
    """The activism page of a ticker: current 13D and 13G filers, all filings, positions of known activists, the latest short volume."""
    day = F.lit(as_of).cast("date")
    filings = t.beneficial.where(F.col("subject_ticker") == ticker)
    now = beneficial_ownership_current(t).where(F.col("subject_ticker") == ticker).join(filings.select("accession_number", "pct_owned"), "accession_number")
    sides = [
        _section(now.where(F.col("intent") == intent), name, filer="filer_cik", filing_type="filing_type", on_date="filing_date", pct_owned="pct_owned", shares_owned="shares_owned", prior_intent="prior_intent",
                 amendment_count="amendment_count", days_since=F.date_diff(day, "filing_date"), is_current=F.col("filing_date") >= F.add_months(day, -24))
        for intent, name in (("activist", "activist_13d"), ("passive", "passive_5pct"))
    ]
    history = _section(filings, "history", filer="filer_cik", filing_type="filing_type", on_date="filing_date", pct_owned="pct_owned", shares_owned="shares_owned")
    held = t.latest.where(F.col("ticker") == ticker).join(t.managers.where("is_activist").select("cik"), "cik", "left_semi")
    held = _section(held, "activist_13f", filer="manager_name", quarter="quarter", shares_owned="shares", value="market_value_live")
    last = t.short_interest.where(F.col("ticker") == ticker).orderBy(F.desc("report_date")).limit(1)
    short = _section(last, "short_interest", on_date="report_date", shares_owned="short_volume", value="total_volume")
    return sides[0].unionByName(sides[1]).unionByName(history).unionByName(held).unionByName(short)


QUERY6 = f"""boc AS (WITH {BOC}),
n AS (SELECT boc.*, b.pct_owned FROM boc JOIN beneficial b ON boc.accession_number = b.accession_number WHERE boc.subject_ticker = '{TICKER}')
SELECT CASE WHEN intent = 'activist' THEN 'activist_13d' ELSE 'passive_5pct' END AS section, filer_cik AS filer, NULL AS quarter, filing_type, filing_date AS on_date, pct_owned, shares_owned, CAST(NULL AS BIGINT) AS value, prior_intent, amendment_count,
  CAST(date_diff('day', filing_date, DATE '{AS_OF}') AS INTEGER) AS days_since, filing_date >= DATE '{AS_OF}' - INTERVAL 24 MONTH AS is_current FROM n
UNION ALL SELECT 'history', filer_cik, NULL, filing_type, filing_date, pct_owned, shares_owned, NULL, NULL, NULL, NULL, NULL FROM beneficial WHERE subject_ticker = '{TICKER}'
UNION ALL SELECT 'activist_13f', manager_name, quarter, NULL, NULL, NULL, shares, market_value_live, NULL, NULL, NULL, NULL FROM holdings WHERE is_latest AND ticker = '{TICKER}' AND cik IN (SELECT cik FROM managers WHERE is_activist)
UNION ALL SELECT * FROM (SELECT 'short_interest', NULL, NULL, NULL, report_date, NULL, short_volume, total_volume, NULL, NULL, NULL, NULL FROM short_interest WHERE ticker = '{TICKER}' ORDER BY report_date DESC LIMIT 1) s"""


def query7_stats(t: Tables, ticker: str = TICKER, quarter: str = LATEST) -> DataFrame:
    """The head of a portfolio page: whose book, its value, number of positions and the ten largest ones' share."""
    book = query7_portfolio(t, ticker, quarter).groupBy("cik").agg(F.sum("value").alias("total_value"), F.count("*").alias("num_positions"), F.sum(F.when(F.col("rank") <= 10, F.col("value"))).alias("top10"))
    who = t.latest.where(F.col("quarter") == quarter).groupBy("cik").agg(F.max("manager_name").alias("manager_name"), F.max("manager_type").alias("manager_type"))
    return book.join(who, "cik").select("cik", "manager_name", "manager_type", "total_value", "num_positions", ratio(F.col("top10"), F.col("total_value"), 100).alias("top10_concentration_pct"))


QUERY7_STATS = f"""book AS (WITH {QUERY7})
SELECT cik, (SELECT max(manager_name) FROM holdings h WHERE h.cik = k.cik AND is_latest AND quarter = '{LATEST}') AS manager_name, (SELECT max(manager_type) FROM holdings h WHERE h.cik = k.cik AND is_latest AND quarter = '{LATEST}') AS manager_type,
  total_value, num_positions, top10 * 100.0::DOUBLE / nullif(total_value, 0) AS top10_concentration_pct
FROM (SELECT cik, {S("value")} AS total_value, count(*) AS num_positions, {S("CASE WHEN rank <= 10 THEN value END")} AS top10 FROM book GROUP BY 1) k"""


def query15_totals(t: Tables, quarter: str = LATEST) -> DataFrame:
    """Sizes of all tables and the coverage of a quarter's columns, in one row."""
    rows = t.holdings.agg(F.count("*").alias("total_holdings"), F.count_distinct("cik").alias("unique_filers"), F.count_distinct("cusip").alias("unique_securities"), F.count_distinct("quarter").alias("quarters_loaded"))
    sizes = {"manager_records": t.managers, "securities_mapped": t.security_rows, "market_data_tickers": t.market_data, "adv_records": t.advisers}
    for name, df in sizes.items():
        rows = rows.crossJoin(df.agg(F.count("*").alias(name)))  # one row each
    now = t.latest.where(F.col("quarter") == quarter).join(t.market_data.select("ticker", "shares_outstanding"), "ticker", "left")
    share = lambda c: ratio(F.count(c), F.count("*"), 100)
    return rows.crossJoin(now.agg(F.count("*").alias("total"), share("ticker").alias("ticker_pct"), share("manager_type").alias("manager_type_pct"), share("market_value_live").alias("live_value_pct"), share("shares_outstanding").alias("so_pct_pct")))


QUERY15_TOTALS = f"""n AS (SELECT h.*, m.shares_outstanding FROM holdings h LEFT JOIN market_data m ON h.ticker = m.ticker WHERE is_latest AND quarter = '{LATEST}')
SELECT (SELECT count(*) FROM holdings) AS total_holdings, (SELECT count(DISTINCT cik) FROM holdings) AS unique_filers, (SELECT count(DISTINCT cusip) FROM holdings) AS unique_securities, (SELECT count(DISTINCT quarter) FROM holdings) AS quarters_loaded,
  (SELECT count(*) FROM managers) AS manager_records, (SELECT count(*) FROM security_rows) AS securities_mapped, (SELECT count(*) FROM market_data) AS market_data_tickers, (SELECT count(*) FROM advisers) AS adv_records,
  count(*) AS total, count(ticker) * 100.0::DOUBLE / count(*) AS ticker_pct, count(manager_type) * 100.0::DOUBLE / count(*) AS manager_type_pct, count(market_value_live) * 100.0::DOUBLE / count(*) AS live_value_pct,
  count(shares_outstanding) * 100.0::DOUBLE / count(*) AS so_pct_pct FROM n"""


def security_positions(t: Tables, ticker: str = TICKER, cusip: str = "000000011") -> DataFrame:
    """Holders and shares by quarter of a security that its ticker or its cusip names."""
    rows = t.latest.where((F.col("ticker") == ticker) | (F.col("cusip") == cusip))
    return rows.groupBy("quarter").agg(F.count_distinct("cik").alias("holders"), F.sum("shares").alias("shares"))


SECURITY = f"""SELECT quarter, count(DISTINCT cik) AS holders, {S("shares")} AS shares FROM holdings WHERE is_latest AND (ticker = '{TICKER}' OR cusip = '000000011') GROUP BY 1"""


def type_breakdown(t: Tables, ticker: str = TICKER, quarter: str = LATEST) -> DataFrame:
    """A ticker's value by manager type, positive ones."""
    rows = t.latest.where((F.col("ticker") == ticker) & (F.col("quarter") == quarter)).groupBy(F.coalesce("manager_type", F.lit("unknown")).alias("type"))
    return rows.agg(F.sum("market_value_live").alias("value")).where("value > 0")


BREAKDOWN = f"""SELECT coalesce(manager_type, 'unknown') AS type, {S("market_value_live")} AS value FROM holdings WHERE is_latest AND ticker = '{TICKER}' AND quarter = '{LATEST}' GROUP BY 1 HAVING sum(market_value_live) > 0"""


def ticker_guards(t: Tables, quarter: str = LATEST, form: str = TICKER_FORM) -> DataFrame:
    """What a lookup of each asked ticker answers: malformed, unknown, historical (some quarter) or current. Digits stand as letters A to J here."""
    letters = lambda c: F.translate(c, "0123456789", "ABCDEFGHIJ")
    part = letters(F.concat(F.lit("P"), F.lpad((F.col("p_partkey") % 60).cast("string"), 2, "0")))
    asked = t.code_rows.select("ticker").where("ticker is not null").unionByName(t.base("part").select(part.alias("ticker"))).distinct()
    late = (F.col("quarter") == quarter) & (F.right("ticker", F.lit(1)) != "3")
    known = t.latest.groupBy(letters("ticker").alias("ticker")).agg(F.bool_or(late).alias("now"))
    status = F.when(~F.col("ticker").rlike(form), "malformed").when(F.col("now").isNull(), "unknown").when(F.col("now"), "current").otherwise("historical")
    return asked.join(known, "ticker", "left").select("ticker", status.alias("status"))


GUARDS = f"""a AS (SELECT ticker FROM code_rows WHERE ticker IS NOT NULL UNION SELECT translate('P' || lpad(CAST(p_partkey % 60 AS VARCHAR), 2, '0'), '0123456789', 'ABCDEFGHIJ') FROM part),
k AS (SELECT translate(ticker, '0123456789', 'ABCDEFGHIJ') AS ticker, bool_or(quarter = '{LATEST}' AND right(ticker, 1) <> '3') AS now FROM holdings WHERE is_latest GROUP BY 1)
SELECT a.ticker, CASE WHEN NOT regexp_matches(a.ticker, '{TICKER_FORM}') THEN 'malformed' WHEN now IS NULL THEN 'unknown' WHEN now THEN 'current' ELSE 'historical' END AS status FROM a LEFT JOIN k ON a.ticker = k.ticker"""


def common_holders(t: Tables, ticker: str = TICKER, other: str = OTHER) -> DataFrame:
    """Filers that have held both tickers."""
    rows = t.latest
    return rows.where(F.col("ticker") == ticker).select("cik").intersect(rows.where(F.col("ticker") == other).select("cik"))


COMMON = f"""SELECT cik FROM holdings WHERE is_latest AND ticker = '{TICKER}' INTERSECT SELECT cik FROM holdings WHERE is_latest AND ticker = '{OTHER}'"""


def unlisted_codes(t: Tables) -> DataFrame:
    """Rows whose ticker is NOT IN a list, as SQL means it: by a list without nulls, with one, and an empty one."""
    rows, out = t.code_rows.select("row_id", "ticker"), None
    lists = {"plain": "row_id % 12 in (2, 3)", "with_null": "row_id % 12 in (0, 2)", "empty": "row_id < 0"}
    for name, rule in lists.items():
        part = not_in(rows, "ticker", rows.where(rule).select(F.col("ticker").alias("key")), "key").withColumn("list", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


UNLISTED = " UNION ALL ".join(f"SELECT row_id, ticker, '{name}' AS list FROM code_rows WHERE ticker NOT IN (SELECT ticker FROM code_rows WHERE {rule})" for name, rule in (("plain", "row_id % 12 IN (2, 3)"), ("with_null", "row_id % 12 IN (0, 2)"), ("empty", "row_id < 0")))


def adviser_links(t: Tables) -> DataFrame:
    """Filers and advisers that share a filer number or, where they don't, a registration number: two equality joins instead of one OR."""
    n = F.col("cik").cast("bigint")
    m = t.managers.select("cik", n.cast("string").alias("plain"), F.when(n % 2 == 0, F.lpad((n + 100000).cast("string"), 9, "0")).alias("crd"))
    a = t.advisers.select("crd_number", "adv_cik")
    first = m.join(a, m["plain"] == a["adv_cik"]).withColumn("how", F.lit("cik"))
    second = m.join(a, m["crd"] == a["crd_number"]).where(~F.col("plain").eqNullSafe(F.col("adv_cik"))).withColumn("how", F.lit("crd"))
    return first.unionByName(second).select("cik", "crd_number", "how")


LINKS = """m AS (SELECT cik, CAST(CAST(cik AS BIGINT) AS VARCHAR) AS plain, CASE WHEN CAST(cik AS BIGINT) % 2 = 0 THEN lpad(CAST(CAST(cik AS BIGINT) + 100000 AS VARCHAR), 9, '0') END AS crd FROM managers)
SELECT cik, crd_number, CASE WHEN plain = adv_cik THEN 'cik' ELSE 'crd' END AS how FROM m JOIN advisers a ON plain = adv_cik OR crd = crd_number"""


def match_families(t: Tables, families: tuple = FAMILIES) -> DataFrame:
    """Family terms of each parent name: those of the first entry whose key or any term the name holds, else the name up to / or ( if longer than two."""
    n = F.col("k")
    name = F.concat("firm_name", F.when(n % 3 == 0, " / Holdings").when(n % 3 == 1, " (US)").otherwise(""))
    names = t.advisers.select(F.col("crd_number").cast("bigint").alias("k"), "firm_name").select("k", name.alias("name"))
    names = names.unionByName(t.base("region").select((-F.col("r_regionkey").cast("bigint") - 1).alias("k"), F.when(F.col("r_regionkey") == 0, "AB/C").when(F.col("r_regionkey") == 1, "").otherwise(F.col("r_name")).alias("name")))
    low, terms = F.lower("name"), None
    for key, words in families:
        holds = low.contains(key)
        for w in words:
            holds = holds | low.contains(w.lower())
        value = F.lit("|".join(words))
        terms = F.when(holds, value) if terms is None else terms.when(holds, value)
    head = F.trim(F.substring_index(F.substring_index("name", "/", 1), "(", 1))
    return names.select("k", "name", terms.when(F.length(head) > 2, head).alias("terms"))


_HOLDS = " ".join("WHEN " + " OR ".join(f"contains(lower(name), '{w.lower()}')" for w in (key, *words)) + f" THEN '{'|'.join(words)}'" for key, words in FAMILIES)
MATCH = f"""n AS (SELECT CAST(crd_number AS BIGINT) AS k, firm_name || CASE CAST(crd_number AS BIGINT) % 3 WHEN 0 THEN ' / Holdings' WHEN 1 THEN ' (US)' ELSE '' END AS name FROM advisers
  UNION ALL SELECT -CAST(r_regionkey AS BIGINT) - 1, CASE r_regionkey WHEN 0 THEN 'AB/C' WHEN 1 THEN '' ELSE r_name END FROM region),
h AS (SELECT *, trim(split_part(split_part(name, '/', 1), '(', 1)) AS head FROM n)
SELECT k, name, CASE {_HOLDS} WHEN length(head) > 2 THEN head END AS terms FROM h"""


def rollback_run(t: Tables) -> DataFrame:
    """A promotion of changed and new rows, then its rollback: the table as it was."""
    rows = t.base("orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    before = rows.where("o_orderkey % 11 <> 0").withColumn("is_latest", F.lit(True))
    staged = rows.where("o_orderkey % 7 = 0 or o_orderkey % 11 = 0").withColumn("price", F.col("price") + 1)
    after = promote.append_is_latest(before, staged, ["o_orderkey"])
    flips = staged.select("o_orderkey").join(before, "o_orderkey", "left_semi").withColumn("action", F.lit("flip_is_latest"))
    return promote.rollback(after, staged.select("o_orderkey").withColumn("action", F.lit("insert")).unionByName(flips), ["o_orderkey"])


ROLLBACK = """SELECT o_orderkey, o_totalprice AS price, TRUE AS is_latest FROM orders WHERE o_orderkey % 11 <> 0"""

QUERIES = {
    "query6_sections": (query6_sections, statement(QUERY6)),
    "query7_stats": (query7_stats, statement(QUERY7_STATS)),
    "query15_totals": (query15_totals, statement(QUERY15_TOTALS)),
    "security_positions": (security_positions, statement(SECURITY)),
    "type_breakdown": (type_breakdown, statement(BREAKDOWN)),
    "ticker_guards": (ticker_guards, statement(GUARDS)),
    "common_holders": (common_holders, statement(COMMON)),
    "unlisted_codes": (unlisted_codes, statement(UNLISTED)),
    "adviser_links": (adviser_links, statement(LINKS)),
    "match_families": (match_families, statement(MATCH)),
    "rollback_run": (rollback_run, statement(ROLLBACK)),
}
