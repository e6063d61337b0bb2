"""The canonical ownership tables, derived from the star-schema tables.

Each definition is SQL that Spark and DuckDB read alike, so the statements
that check a query can inline it. In production these tables are stored;
``store`` writes them, the two fact tables partitioned by quarter so that a
query's quarter filter prunes directories.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import climb
from ..session import scratch

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

_TYPE = """CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'active' WHEN 'BUILDING' THEN 'passive' WHEN 'FURNITURE' THEN 'hedge_fund'
         WHEN 'HOUSEHOLD' THEN 'activist' ELSE 'quantitative' END"""
_TICKER = "'P' || lpad(CAST({} % 40 AS STRING), 2, '0')"
_QUARTER = "CAST(year(l.l_shipdate) AS STRING) || 'Q' || CAST(quarter(l.l_shipdate) AS STRING)"



def pick(x: str, values: list[str | None]) -> str:
    """SQL: the value whose place is ``x`` modulo their number."""
    return f"CASE {x} % {len(values)} " + " ".join(f"WHEN {k} THEN {'NULL' if v is None else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39)}" for k, v in enumerate(values)) + " END"


# Type texts, categories, sectors and exchanges that together reach each branch of the security ladder.
_RAW = [
    None, "", "COM", "cl a", "SHS CL B", "Common Stock", "PFD SER A", "SPDR ETF COM", "Warrants exp", "CALL", "put option", "MF Closed and MF Open", "REIT / COM", "BANK LOAN", "CONV CVT", "US TREAS", "NTF BOND FUNDS", "CASH", "FOREIGN",
    "COMMON STOCK - FOREIGN", "SPONSORED ADR", "SPON ADS", "UIT 01/02/2003", "UNIT 01/02/2003", "SPAC & REIT", "mystery", "mystery and riddle", "0", "CLO", "ORD SHS", "COM NEW", "CL A SHS", "RIGHTS & WARRANTS", "equity fund / bond", "PS", " , - ", "money market",
]
_CATEGORY = [None, "EC", "EP", "RE", "DBT", "ABS-O", "LON", "DE", "DFE", "STIV", "RA", "COMM", "OTHER", "WAR", None, "EC", None, None, None]
_SECTOR = [None, "Equity", None, "Corp", "Pfd", None, "Comdty", "Curncy", "Elsewhere", None, "Equity", None, None]
_EXCHANGE = ["US", None, "OTC US", "GR", "NYQ"]
_FIRMS = [
    "Index House", "S&P Watchers", "Cayman Holdings", "Plain Advisers", "Quant Lab", "Two Sigma Friends", "Diversified Advisers", "Multi-Strategy Group", "Buyout Partners", "Venture Co", "Starboard Value LP", "Third Point LLC", "Engine No. 1", "Capital Partners",
    "Growth Equity Office", "Land & Buildings", "Algorithmic Trading", "Old Family Office", "Renaissance",
]
_FUNDS = [" Growth", " S&P 500 Index", " Money Market", " Target Date", " 2x Inverse", " Income", " Russell Fund 2000", " Exchange Traded", " Feeder Fund", " Balanced", " Select Sector", " Broad Market", " Value"]
_TICKERS = [None, "", "ABC 4.5", "ABC-WT", "ABC/WS", "ABC-PA", "ABC-P", "ABC*", "ABCUSD", "USD", "ABC", "BRK.B"]
_K = "o_orderkey"

DEFINITIONS = {
    "holdings": f"""
  SELECT lpad(CAST(l.l_orderkey AS STRING), 12, '0') AS accession_number, lpad(CAST(o.o_custkey AS STRING), 10, '0') AS cik,
         c.c_name AS manager_name, c.c_name || ' Fund ' || CAST(l.l_linenumber % 3 AS STRING) AS fund_name,
         n.n_name AS inst_parent_name, CAST(1000000 + c.c_custkey AS BIGINT) AS entity_id,
         CASE WHEN c.c_custkey % 19 = 0 THEN NULL ELSE CAST(1000 + n.n_nationkey AS BIGINT) END AS rollup_entity_id,
         CASE WHEN c.c_custkey % 19 = 0 THEN NULL ELSE n.n_name END AS rollup_name,
         CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE {_TYPE} END AS manager_type,
         CASE WHEN c.c_custkey % 13 = 0 THEN NULL ELSE {_TYPE} END AS entity_type,
         {_TICKER.format("l.l_partkey")} AS ticker, lpad(CAST(l.l_partkey % 40 AS STRING), 9, '0') AS cusip,
         {_QUARTER} AS quarter, CAST(l.l_quantity AS BIGINT) AS shares,
         CAST(round(l.l_extendedprice) AS BIGINT) AS market_value_usd,
         CAST(round(l.l_extendedprice * 1.125) AS BIGINT) AS market_value_live,
         CASE WHEN l.l_linenumber % 5 = 0 THEN 'other' ELSE 'equity' END AS security_type_inferred,
         l.l_discount <= 0.09 AS is_latest
  FROM {{lineitem}} l JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey JOIN {{customer}} c ON o.o_custkey = c.c_custkey
  JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey""",
    "fund_holdings": f"""
  SELECT 'S' || lpad(CAST(l.l_suppkey AS STRING), 6, '0') AS series_id, s.s_name AS fund_name, 'FAMILY_' || CAST(s.s_nationkey AS STRING) AS family_name,
         {_QUARTER} AS quarter,
         CAST(year(l.l_shipdate) AS STRING) || '-' || lpad(CAST(month(l.l_shipdate) AS STRING), 2, '0') AS report_month,
         {_TICKER.format("l.l_partkey")} AS ticker, lpad(CAST(l.l_partkey % 40 AS STRING), 9, '0') AS cusip,
         CASE WHEN l.l_linenumber % 4 = 0 THEN 'DBT' WHEN l.l_linenumber % 4 = 1 THEN 'EP' ELSE 'EC' END AS asset_category,
         CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber = 7 THEN -CAST(l.l_quantity AS BIGINT) ELSE CAST(l.l_quantity AS BIGINT) END AS shares,
         CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber = 7 THEN 'Short' ELSE 'Long' END AS payoff_profile,
         CAST(round(l.l_extendedprice) AS BIGINT) AS market_value_usd,
         CASE l.l_suppkey % 9 WHEN 0 THEN 'active' WHEN 1 THEN 'passive' WHEN 2 THEN 'balanced' WHEN 3 THEN 'multi_asset'
              WHEN 4 THEN 'bond_or_other' WHEN 5 THEN 'excluded' WHEN 6 THEN 'final_filing' WHEN 7 THEN 'active' END AS fund_strategy,
         CAST(2000000 + l.l_suppkey AS BIGINT) AS entity_id, CAST(1000 + s.s_nationkey AS BIGINT) AS rollup_entity_id,
         l.l_discount <= 0.09 AS is_latest
  FROM {{lineitem}} l JOIN {{supplier}} s ON l.l_suppkey = s.s_suppkey""",
    "market_data": f"""
  SELECT {_TICKER.format("p_partkey")} AS ticker, p_name AS issuer_name, p_type AS sector, p_brand AS industry, p_retailprice AS price_live,
         CAST(1000000 + p_partkey * 1000 AS BIGINT) AS shares_outstanding,
         CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(900000 + p_partkey * 1000 AS BIGINT) END AS float_shares,
         CASE WHEN p_partkey % 10 = 9 THEN NULL ELSE CAST(round(p_retailprice * (1000000 + p_partkey * 1000)) AS BIGINT) END AS market_cap
  FROM {{part}} WHERE p_partkey < 40""",
    "soh": f"""
  SELECT ticker, as_of_date, CAST(5000 + sum(quantity) OVER (PARTITION BY ticker ORDER BY as_of_date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS shares
  FROM (SELECT {_TICKER.format("l_partkey")} AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS as_of_date,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
        FROM {{lineitem}} WHERE l_partkey % 40 <> 39 AND month(l_shipdate) IN (2, 5, 8, 11) GROUP BY 1, 2) m""",
    "short_interest": f"""
  SELECT {_TICKER.format("user_id")} AS ticker, CAST(ts AS DATE) AS report_date,
         CAST(sum(CASE WHEN event_type IN ('error', 'purchase') THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS short_volume,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total_volume
  FROM {{events}} GROUP BY 1, 2""",
    "fund_universe": """
  SELECT 'S' || lpad(CAST(s_suppkey AS STRING), 6, '0') AS series_id, s_name AS fund_name, 'FAMILY_' || CAST(s_nationkey AS STRING) AS family_name,
         CAST(round(s_acctbal * 100000) AS BIGINT) AS total_net_assets
  FROM {supplier}""",
    "managers": """
  SELECT lpad(CAST(c_custkey AS STRING), 10, '0') AS cik, c_name AS manager_name, n_name AS parent_name,
         CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(round(c_acctbal * 1000000) AS BIGINT) END AS aum_total,
         c_mktsegment = 'HOUSEHOLD' AS is_activist
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "entities": """
  SELECT CAST(1 + r_regionkey AS BIGINT) AS entity_id, 'institution' AS entity_type, r_name AS canonical_name FROM {region}
  UNION ALL SELECT CAST(1000 + n_nationkey AS BIGINT), 'institution', n_name FROM {nation}
  UNION ALL SELECT CAST(1000000 + c_custkey AS BIGINT), 'institution', c_name FROM {customer}
  UNION ALL SELECT CAST(2000000 + s_suppkey AS BIGINT), 'fund', s_name FROM {supplier}""",
    "relationships": """
  SELECT CAST(1000 + n_nationkey AS BIGINT) AS parent_entity_id, CAST(1000000 + c_custkey AS BIGINT) AS child_entity_id,
         'wholly_owned' AS relationship_type, CASE WHEN c_custkey % 2 = 0 THEN 'control' ELSE 'merge' END AS control_type,
         CASE WHEN c_custkey % 29 = 0 THEN DATE '2001-06-30' ELSE DATE '9999-12-31' END AS valid_to
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
  UNION ALL SELECT CAST(1 + n_regionkey AS BIGINT), CAST(1000 + n_nationkey AS BIGINT), 'parent_brand', 'mutual', DATE '9999-12-31' FROM {nation}
  UNION ALL SELECT CAST(1000 + s_nationkey AS BIGINT), CAST(2000000 + s_suppkey AS BIGINT),
         CASE WHEN s_suppkey % 4 = 0 THEN 'sub_adviser' ELSE 'fund_sponsor' END, 'advisory', DATE '9999-12-31' FROM {supplier}""",
    "rollup_history": """
  SELECT CAST(1000000 + c_custkey AS BIGINT) AS entity_id, CAST(1000 + c_nationkey AS BIGINT) AS rollup_entity_id,
         'economic_control_v1' AS rollup_type, DATE '9999-12-31' AS valid_to FROM {customer}
  UNION ALL SELECT CAST(1000000 + c_custkey AS BIGINT), CASE WHEN c_custkey % 5 = 0 THEN CAST(1000000 + c_custkey AS BIGINT) ELSE CAST(1000 + c_nationkey AS BIGINT) END,
         'decision_maker_v1', DATE '9999-12-31' FROM {customer}
  UNION ALL SELECT CAST(2000000 + s_suppkey AS BIGINT), CAST(1000 + s_nationkey AS BIGINT), 'decision_maker_v1', DATE '9999-12-31' FROM {supplier}
  UNION ALL SELECT CAST(2000000 + s_suppkey AS BIGINT), CAST(1000 + s_nationkey AS BIGINT), 'decision_maker_v1', DATE '2000-12-31' FROM {supplier}""",
    "beneficial": f"""
  SELECT lpad(CAST(o_orderkey AS STRING), 12, '0') AS accession_number, lpad(CAST(o_custkey % 60 AS STRING), 10, '0') AS filer_cik,
         {_TICKER.format("o_orderkey")} AS subject_ticker,
         CASE WHEN o_orderpriority LIKE '1%' THEN 'SC 13D' WHEN o_orderpriority LIKE '2%' THEN 'SC 13D/A'
              WHEN o_orderpriority LIKE '4%' THEN 'SC 13G/A' ELSE 'SC 13G' END AS filing_type,
         CAST(o_orderdate AS DATE) AS filing_date, o_totalprice / 50000 AS pct_owned, CAST(round(o_totalprice) AS BIGINT) AS shares_owned
  FROM {{orders}}""",
    "security_rows": f"""
  SELECT p_partkey AS row_id, {pick("p_partkey", _RAW)} AS raw, {pick("p_partkey", _CATEGORY)} AS category, {pick("p_partkey", _SECTOR)} AS sector, {pick("p_partkey", _EXCHANGE)} AS exchange FROM {{part}}""",
    "filing_rows": f"""
  SELECT {_K} AS filing_id, CAST(o_custkey AS STRING) AS filer, {pick(_K, ["SC 13D", "SC 13D/A", "SC 13G", "SC 13G/A"])} AS filing_type,
    '<p>CUSIP No. ' || lpad(CAST({_K} % 1000 AS STRING), 9, '0') || '</p>&nbsp; ' ||
    {pick(_K, ["NAME OF REPORTING PERSON: Alpha Partners CHECK THE BOX", "Item 1: Reporting Person - Beta Capital Item 2", "NAMES OF REPORTING PERSONS I.R.S. (12) Gamma Fund 2 x", "NAME OF REPORTING PERSON (1) Delta Trust Item", "none named", "", "no one"])} || ' ; ' ||
    replace({pick(_K, ["PERCENT OF CLASS REPRESENTED BY AMOUNT IN ROW (9): @%", "13. PERCENT OF CLASS REPRESENTED BY AMOUNT IN ROW (11) @%", "Percent of class represented by row 11 is about @ %", "Item 11. Percent of Class Owned: @%", "Item 11: @%", "Percentage of the Class: @%", "percent of class held in all @%", "New percentage after the sale @%", "PERCENT OF CLASS REPRESENTED BY AMOUNT IN ROW (11) about @", "no share is named"])}, '@', CAST({_K} % 120 AS STRING) || '.5') || ' ; ' ||
    replace({pick(_K, ["AGGREGATE AMOUNT BENEFICIALLY OWNED BY EACH REPORTING PERSON @", "11. AGGREGATE AMOUNT BENEFICIALLY OWNED (all): @", "Item 9. Aggregate Amount Owned: @", "Aggregate Amount Owned by Each Reporting Person, in all @ shares", "Item 9: @", "Amount Beneficially Owned: @", "SHARED VOTING POWER @", "SOLE VOTING POWER @", "no amount is named"])}, '@', CAST(10 + {_K} % 977 * 7 AS STRING)) || ' ; ' ||
    replace({pick(_K, ["Date of Event Which Requires Filing of this Statement) March @, 2001", "Date of Event: 3/@/2001", "Date of Event: 2001-03-0@", "Date of Event: 13/45/2001", "no date"])}, CASE WHEN {_K} % 5 = 2 THEN '0@' ELSE '@' END, CASE WHEN {_K} % 5 = 2 THEN lpad(CAST(1 + {_K} % 28 AS STRING), 2, '0') ELSE CAST(1 + {_K} % 28 AS STRING) END) || ' ; ' ||
    replace({pick(_K, ["Item 4. Purpose of Transaction. The filer bought lot @. <b>Item 5</b> Interest", "Item 4 Purpose: to hold lot @ and nothing else", "Item 3 is all"])}, '@', CAST({_K} AS STRING)) AS html
  FROM {{orders}}""",
    "advisers": f"""
  SELECT lpad(CAST(c_custkey + 100000 AS STRING), 9, '0') AS crd_number, {pick("c_custkey", _FIRMS)} || ' ' || CAST(c_custkey AS STRING) AS firm_name,
         CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS STRING) END AS adv_cik, CAST(c_custkey % 101 AS DOUBLE) AS pct, {pick("c_custkey", ["N", "N", "Y", None, "N", "N", "N"])} AS hedge, {pick("c_custkey", ["N", None, "N", "N", "Y"])} AS private,
         {pick("c_custkey", ["N", "N", "N", "N", "N", "N", "N", "N", "Y", "N", "N"])} AS venture, CAST(round(c_acctbal * 1000) AS BIGINT) AS raum, {pick("c_nationkey", ["NY", "CA", None, "TX"])} AS state FROM {{customer}}""",
    "fund_names": f"""
  SELECT 'S' || lpad(CAST(s_suppkey AS STRING), 6, '0') AS series_id, s_name || {pick("s_suppkey", _FUNDS)} AS fund_name, s_suppkey % 31 = 5 AS is_final FROM {{supplier}}""",
    "code_rows": f"""
  SELECT p_partkey AS row_id, CASE WHEN p_partkey % 7 = 3 THEN 'x' WHEN p_partkey % 7 = 5 THEN NULL ELSE CAST(6000 + p_partkey % 800 AS STRING) END AS sic, {pick("p_partkey", _TICKERS)} AS ticker FROM {{part}}""",
    "curated_types": """
  SELECT lower(c_name) AS name, CASE WHEN c_custkey % 2 = 0 THEN 'wealth_management' ELSE 'endowment' END AS kind, c_custkey AS pos FROM {customer} WHERE c_custkey % 11 = 0 AND c_custkey % 4 < 3""",
}


#: What was stored, by application, folder, table and the state of the files it is made of.
_stored: dict[tuple, DataFrame] = {}
#: Facts are written by quarter, sorted by ticker, so a query's quarter and ticker prune files and row groups.
FACTS = ("holdings", "fund_holdings")


class Tables:
    """The canonical tables of a folder as DataFrames.

    A table is derived and written to the shared folder when it is first asked
    for, and read from there by every later query of the session, until the
    files it is made of change. ``stored=False`` derives it in each query.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, stored: bool = True):
        self.spark, self.sf_dir, self.stored = spark, sf_dir, stored
        self._made: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        return self._once(f"base {name}", (name,), lambda: self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))

    def __getattr__(self, name: str) -> DataFrame:
        if name not in DEFINITIONS:
            raise AttributeError(name)
        made = self.__dict__["_made"]
        if name not in made:
            text = DEFINITIONS[name]
            used = tuple(b for b in BASE if f"{{{b}}}" in text)
            made[name] = self.derived(name, used, lambda: self.spark.sql(text, **{b: self.base(b) for b in used}))
        return made[name]

    def derived(self, name: str, bases: tuple[str, ...], make: Callable[[], DataFrame]) -> DataFrame:
        """The table that ``make`` gives, stored under ``name`` while the files of ``bases`` stay as they are."""
        if not self.stored:
            return make()
        return self._once(name, bases, lambda: self._write(name, make()))

    def _write(self, name: str, df: DataFrame) -> DataFrame:
        to = scratch(self.spark, f"table-{name}")
        write(df, name, to)
        return self.spark.read.schema(df.schema).parquet(to)

    def _once(self, name: str, bases: tuple[str, ...], make: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name, tuple(map(self._state, bases)))
        if key not in _stored:
            _stored[key] = make()
        return _stored[key]

    def _state(self, base: str) -> tuple[int, int]:
        """When a base table was written, and its size."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{base}.parquet")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.getFileStatus(path).getModificationTime(), fs.getContentSummary(path).getLength()

    @cached_property
    def latest(self) -> DataFrame:
        """Current rows of the 13F facts."""
        return self.holdings.where("is_latest")

    @cached_property
    def fund_latest(self) -> DataFrame:
        """Current rows of the fund facts."""
        return self.fund_holdings.where("is_latest")

    @cached_property
    def top_parents(self) -> DataFrame:
        """entity_id, its climbed top parent, the hops to it and its name: stored, since most queries name holders by it."""

        def make() -> DataFrame:
            top = climb(self.entities, self.relationships)
            names = self.entities.select(F.col("entity_id").alias("top_parent_entity_id"), F.col("canonical_name").alias("top_name"))
            return top.join(names, "top_parent_entity_id", "left").select("entity_id", "top_parent_entity_id", "hops", "top_name")

        return self.derived("top_parents", ("region", "nation", "customer", "supplier"), make)


def write(df: DataFrame, name: str, to: str) -> None:
    """Writes a canonical table; facts by quarter, in ranges of quarter and ticker."""
    if name in FACTS:
        df.repartitionByRange("quarter", "ticker").sortWithinPartitions("quarter", "ticker").write.mode("overwrite").partitionBy("quarter").parquet(to)
    else:
        df.write.mode("overwrite").parquet(to)


def statement(body: str) -> str:
    """A DuckDB statement: the canonical tables that ``body`` names (and those they need), then ``body``.

    ``body`` is ``[name AS (...), ...] SELECT ...`` behind the tables.
    """
    names = {b: b for b in BASE}
    used = [f"{n} AS ({text.format(**names)})" for n, text in DEFINITIONS.items() if n in body]
    body = body.strip()
    joint = "" if body.upper().startswith("SELECT") else ", "
    return "WITH " + ", ".join(used) + joint + ("\n" if not joint else "") + body if used else (body if not joint else f"WITH {body}")


def store(tables: Tables, to: str) -> None:
    """Writes all canonical tables to ``to``."""
    for name in DEFINITIONS:
        write(getattr(tables, name), name, f"{to}/{name}")
