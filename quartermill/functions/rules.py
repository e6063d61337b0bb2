"""Rule ladders: security types, adviser strategies, fund names, industry codes, tickers that have no quote.

Each ladder is one column expression; its words are fixed values and stand in
order of precedence.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- security types -------------------------------------------------------

# Asset category -> seed.
SEEDS = {
    "EC": "equity", "EP": "equity", "RE": "equity",
    "DBT": "debt", "ABS-MBS": "debt", "ABS-CBDO": "debt", "ABS-O": "debt", "ABS-APCP": "debt", "LON": "debt", "SN": "debt",
    "DE": "derivative", "DIR": "derivative", "DCO": "derivative", "DCR": "derivative", "DO": "derivative", "DFE": "derivative",
    "STIV": "money_market", "RA": "money_market",
}
# Seed, and market sector -> (type, equity, priceable, permanent). Sector Equity only hints.
SEED_TYPES = {"derivative": ("OPTION", False, False, True), "money_market": ("CASH", False, False, True), "debt": ("BOND", False, False, True)}
SECTOR_TYPES = {
    "Corp": ("BOND", False, False, True), "Govt": ("BOND", False, False, True), "Muni": ("BOND", False, False, True), "M-Mkt": ("CASH", False, False, True), "Pfd": ("PREF", True, True, False),
    "Comdty": ("OTHER", False, False, False), "Index": ("OTHER", False, False, False), "Curncy": ("CASH", False, False, True), "Mtge": ("BOND", False, False, True),
}
# Fixed values: (words, type, equity, priceable, permanent, ticker expected); the first rule with a word in the text counts.
TYPE_RULES = (
    (("PUT", "CALL", "OPT", "OPTION", "OPTIONS"), "OPTION", False, False, True, False),
    (("WARRANT", "RIGHT", "WRT", "WT", "RT", "RIGHTS & WARRANTS"), "WARRANT", False, False, True, False),
    (("CLO", "COLLATERALIZED LOAN"), "CLO", False, False, True, False),
    (("BANK LOAN", "BANK_LOAN", "LOAN"), "BANK_LOAN", False, False, True, False),
    (("CONVERT", "CVT", "CONVERTIBLE", "CONVERTIBLE BOND"), "CONVERT", False, False, True, False),
    (("BOND", "NOTE", "DEBENTURE", "MUNI", "MUNICIPAL", "TREASURY", "TREAS", "GOVT", "GOVERNMENT", "AGENCY", "FIXED", "FIX", "NTF BOND FUNDS", "BOND FUNDS", "FIXED INCOME", "US DOMESTIC", "CORPORATE BOND - DOMESTIC", "CORPORATE BOND - FOREIGN US$"), "BOND", False, False, True, False),
    (("USD", "CASH", "FX", "CURRENCY", "MONEY MARKET"), "CASH", False, False, True, False),
    (("COMMON STOCK - FOREIGN", "FOREIGN", "FOREIGN CANADIAN", "COMMON STOCK-FO"), "FOREIGN", True, False, False, False),
    (("ADR", "ADS", "AMERICAN DEPOSITARY", "SPON ADS", "SPON ADR NEW", "SPONSORED ADS", "SPONSORED ADR"), "ADR", True, True, False, True),
    (("ETF", "ETP", "EXCHANGE TRADED", "EXCHANGE-TRADED", "NTF EQUITY FUNDS", "EQUITY FUNDS", "INDX FD", "LEVERAGE SHS 2X"), "ETF", True, True, False, True),
    (("CEF", "CLOSED-END", "CLOSED END", "MF CLOSED"), "CEF", True, True, False, True),
    (("MUTUAL FUND", "MF", "MFC", "MF OPEN", "FUND", "MUTUAL", "UNIT INVESTMENT TRUST", "UIT EXCHANGE TRADED", "UIT", "UIE", "UNIT", "NTF EQUITY"), "MUTUAL_FUND", True, True, False, True),
    (("REIT", "REAL ESTATE INVESTMENT TRUST"), "REIT", True, True, False, True),
    (("SPAC", "SPACS", "SPECIAL PURPOSE", "SPAC COMBINATION"), "SPAC", True, True, False, True),
    (("PREF", "PREFERRED", "PFD", "PS", "PREFERREDSTK", "PREFERRED STOCK"), "PREF", True, True, False, True),
    (("COM", "COMMON", "COMMON STOCK", "CS", "MC", "STOCK", "SHS", "SHARES", "ORDINARY SHARES", "EQUITY", "EQUITIES", "EQUIT", "CLASS A COM", "CL A COM", "COM SHS", "SHS NEW CL A", "ORD SHS CL A", "CL A SHS"), "COM", True, True, False, True),
    (("0",), "OTHER", False, False, False, False),
)
# Of several types in one text the first of these counts, others last.
PRECEDENCE = ("CEF", "ETF", "ADR", "REIT", "SPAC", "PREF", "MUTUAL_FUND", "COM")
DERIVATIVE_WORDS = ("PUT", "CALL", "OPT", "OPTION", "OPTIONS", "WARRANT", "WARRANTS", "RIGHT", "RIGHTS", "WRT", "WT", "RT")
WARRANT_WORDS = ("WARRANT", "WARRANTS", "RIGHT", "RIGHTS", "WRT", "WT", "RT")
DERIVATIVE_CATEGORIES = ("DE", "DIR", "DCO", "DCR", "DO", "DFE", "OPT", "WAR")
PRICED_EXCHANGES = ("NMS", "NYQ", "NGM", "NCM", "PCX", "BATS", "ARCX", "ASE", "NYS", "NAS", "OBB", "PNK", "US")
GREY_EXCHANGES = ("OTC US", "NOT LISTED")
# Share-class marks and dates that say nothing of the type.
MARKS = (
    r"\b(?:CL|CLASS)\s+[A-Z]\b", r"\b(?:SHS\s+CL|ORD\s+SHS\s+CL|SHS\s+NEW\s+CL|CL\s+[A-Z]\s+SHS)\b", r"\bCOM\s+NEW\b", r"\bSHS\s+NEW\b", r"\bORD\s+SHS\b", r"\b(?:SHS|ORD|NEW)\b",
    r"\bUNIT\s+\d{2}/\d{2}/\d{4}\b", r"\b\d{2}/\d{2}/\d{4}\b",
)


def _word(words: tuple[str, ...]) -> str:
    """A pattern of any of the words, whole."""
    return r"\b(?:" + "|".join(map(re.escape, words)) + r")\b"


def type_text(raw: Column) -> Column:
    """A type's text in upper case without share-class marks; a bare share class is COM, null is empty."""
    up = F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), r"^\s+|\s+$", "")
    bare = up
    for mark in MARKS:
        bare = F.regexp_replace(bare, mark, " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"^[ ,-]+|[ ,-]+$", "")
    return _let(F.struct(up.alias("up"), bare.alias("bare")), lambda x: F.when(x["up"].rlike(r"^(CL|CLASS)\s+[A-Z]$") | ((x["bare"] == "") & x["up"].rlike(r"\b(CL|CLASS|SHS|ORD)\b")), "COM").otherwise(x["bare"]))


def _rule(text: Column) -> Column:
    """The number of the first rule with a word in the text, or that it equals; an empty text is the last rule's. Null without one."""
    out = F.when(text == "", len(TYPE_RULES) - 1)
    for k, (words, *_) in enumerate(TYPE_RULES):
        out = out.when(text.isin(*words) | text.rlike(_word(words)), k)
    return out


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _matched(text: Column) -> Column:
    """The rule of a text, which may name several types between "and", "&" or "/"."""
    ranks = F.array(*[F.lit(PRECEDENCE.index(rule[1]) if rule[1] in PRECEDENCE else len(PRECEDENCE)) for rule in TYPE_RULES])
    other = len(TYPE_RULES) - 1
    ruled = lambda parts: F.transform(parts, lambda x, i: _let(_rule(x), lambda r: F.struct(F.get(ranks, r).alias("rank"), i.alias("at"), r.alias("rule"))))
    parts = F.filter(F.transform(F.split(text, r"(?i)\s+(?:and|&|/)\s+"), lambda x: F.trim(x)), lambda x: x != "")
    several = lambda found: F.when(F.size(found) > 1, F.array_min(F.filter(found, lambda x: x["rule"] != other))["rule"]).otherwise(F.get(found, F.lit(0))["rule"])
    return _let(ruled(_let(parts, lambda x: F.when(F.size(x) == 0, F.array(F.lit(""))).otherwise(x))), several)


_FIELDS = ("type", "equity", "priced", "permanent", "expected", "source", "sure")


def _verdict(*values: Column | str | bool) -> Column:
    return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in zip(_FIELDS, values, strict=True)])


def _lookup(table: dict[str, Column], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), v)]), key)


def classify_security(raw: Column, category: Column, sector: Column, exchange: Column) -> Column:
    """A struct: canonical_type, source, confidence, is_equity, is_priceable, is_permanent, ticker_expected, is_otc.

    Steps: derivatives by type text or asset category; the market sector;
    the category's seed; an equity seed makes a text without a rule common or
    preferred stock; the type text's rules. Foreign stock is priceable on a US
    exchange; permanent types are never equity.
    """
    by_category = F.coalesce(category.isin(*DERIVATIVE_CATEGORIES), F.lit(False))
    by_sector = _lookup({k: _verdict(*v, v[1] and v[2], "market_sector", "high") for k, v in SECTOR_TYPES.items()}, sector)
    seed = _lookup({k: F.lit(v) for k, v in SEEDS.items()}, category)
    by_seed = _lookup({k: _verdict(*v, v[1] and v[2], "asset_category", "medium") for k, v in SEED_TYPES.items()}, seed)
    hint = F.coalesce(sector == "Equity", F.lit(False))
    source = F.when(hint, "market_sector").otherwise("inferred")
    other = len(TYPE_RULES) - 1
    priced = F.coalesce(exchange.isin(*PRICED_EXCHANGES), F.lit(False))

    def derivative(text: Column) -> Column:
        kind = F.when(text.rlike(_word(WARRANT_WORDS)), "WARRANT").otherwise("OPTION")
        found = _verdict(kind, False, False, True, False, F.when(by_category, "asset_category").otherwise("raw_type"), F.when(by_category, "high").otherwise("medium"))
        return F.when(by_category | text.rlike(_word(DERIVATIVE_WORDS)), found)

    def by_rule(rule: Column) -> Column:
        stock = _verdict(F.when(category == "EP", "PREF").otherwise("COM"), True, True, False, True, "asset_category", "medium")
        rules = F.array(*[_verdict(*r[1:6], source, "low" if r[1] == "OTHER" else "medium") for r in TYPE_RULES])
        unknown = _verdict("OTHER", hint, hint, False, False, source, "low")
        return F.coalesce(F.when((seed == "equity") & (rule.isNull() | (rule == other)), stock), F.get(rules, rule), unknown)

    def flags(got: Column) -> Column:
        foreign, loose = got["type"] == "FOREIGN", ~got["permanent"]
        return F.struct(
            got["type"].alias("canonical_type"), got["source"].alias("source"), got["sure"].alias("confidence"), (loose & got["equity"]).alias("is_equity"), (loose & F.when(foreign, priced).otherwise(got["priced"])).alias("is_priceable"),
            got["permanent"].alias("is_permanent"), (loose & F.when(foreign, priced).otherwise(got["expected"])).alias("ticker_expected"), F.coalesce(exchange.isin(*GREY_EXCHANGES), F.lit(False)).alias("is_otc"),
        )

    return _let(type_text(raw), lambda text: _let(F.coalesce(derivative(text), by_sector, by_seed, _let(_matched(text), by_rule)), flags))


# --- advisers -------------------------------------------------------------

# Words of adviser names by strategy, and known activists.
PASSIVE_ADVISERS = ("INDEX", "ETF", "S&P", "RUSSELL", "MSCI", "PASSIVE")
HEDGE_ADVISERS = ("CAPITAL PARTNERS", "MASTER FUND", "OFFSHORE", "CAYMAN")
QUANT_ADVISERS = ("QUANT", "SYSTEMATIC", "ALGORITHMIC", "AQR", "TWO SIGMA", "RENAISSANCE", "DE SHAW", "WINTON")
MULTI_ADVISERS = ("MULTI-STRATEGY", "MULTI STRATEGY", "DIVERSIFIED")
PRIVATE_ADVISERS = ("PRIVATE EQUITY", "BUYOUT", "VENTURE", "GROWTH EQUITY")
ACTIVISTS = (
    "Elliott Investment Management", "Elliott Management", "Icahn Capital", "Icahn Enterprises", "Starboard Value", "ValueAct Capital", "ValueAct Holdings", "Jana Partners", "Engine No. 1", "Engine No 1",
    "Third Point", "Pershing Square", "Corvex Management", "Legion Partners", "Land & Buildings", "Land and Buildings", "Sachem Head", "Barington Capital", "Blue Harbour", "Blue Harbor", "Ancora Holdings", "Ancora Advisors",
)


def _holds(name: Column, words: tuple[str, ...]) -> Column:
    """Whether an upper-case name has any of the words, as parts of others too."""
    return name.rlike("|".join(re.escape(w.upper()) for w in words))


def adviser_strategy(name: Column, pct_discretionary: Column, hedge: Column, private: Column, venture: Column) -> Column:
    """passive, hedge_fund, quantitative, multi_strategy, private_equity, active or unknown, in that order of tests."""
    up, pct = F.upper(F.coalesce(name, F.lit(""))), F.coalesce(pct_discretionary, F.lit(0.0))
    yes = lambda c: F.upper(F.coalesce(c, F.lit(""))) == "Y"
    return (
        F.when(_holds(up, PASSIVE_ADVISERS) | (pct < 10), "passive").when(yes(hedge) | _holds(up, HEDGE_ADVISERS), "hedge_fund").when(_holds(up, QUANT_ADVISERS), "quantitative")
        .when(_holds(up, MULTI_ADVISERS), "multi_strategy").when(yes(private) | yes(venture) | _holds(up, PRIVATE_ADVISERS), "private_equity").when(pct >= 80, "active").otherwise("unknown")
    )


def is_activist(name: Column) -> Column:
    """Whether a name holds that of a known activist."""
    return _holds(F.upper(F.coalesce(name, F.lit(""))), ACTIVISTS)


# --- funds, industries, tickers -------------------------------------------

# Words of index funds, and pairs of words that make one together.
INDEX_WORDS = (
    "INDEX", "ETF", "EXCHANGE-TRADED", "EXCHANGE TRADED", "MSCI", "FTSE", "STOXX", "NIKKEI", "TOTAL STOCK", "TOTAL MARKET", "TOTAL BOND", "TOTAL INTERNATIONAL", "BROAD MARKET", "TRACKER", "NASDAQ", "DOW JONES",
    "WILSHIRE", "BARCLAYS AGGREGATE", "BLOOMBERG AGGREGATE", "SPDR", "ISHARES", "PROSHARES", "SECTOR SELECT", "SELECT SECTOR", "SELECT SPDR",
)
INDEX_PAIRS = (("S&P", "500"), ("S&P", "400"), ("S&P", "600"), ("S&P", "100"), ("RUSSELL", "1000"), ("RUSSELL", "2000"), ("RUSSELL", "3000"), ("BLOOMBERG", "500"), ("BLOOMBERG", "AGGREGATE"))
# Ranges of industry codes, first and last.
INDUSTRIES = ((6726, 6726, "hedge_fund"), (6020, 6029, "active"), (6030, 6036, "active"), (6211, 6211, "active"), (6282, 6282, "active"), (6199, 6199, "active"), (6310, 6399, "active"), (6710, 6726, "active"))


def fund_by_keywords(name: Column) -> Column:
    """active or passive by the words of a fund's name."""
    up = F.upper(F.coalesce(name, F.lit("")))
    pair = F.lit(False)
    for a, b in INDEX_PAIRS:
        pair = pair | (up.contains(a) & up.contains(b))
    return F.when(_holds(up, INDEX_WORDS) | pair, "passive").otherwise("active")


def industry_class(code: Column) -> Column:
    """active, hedge_fund or unknown by industry code, as text."""
    n = code.try_cast("int")
    out = F.when(n.isNull(), "unknown")
    for first, last, kind in INDUSTRIES:
        out = out.when(n.between(first, last), kind)
    return out.otherwise("unknown")


def unfetchable(ticker: Column) -> Column:
    """Why a ticker has no quote (empty, bond, warrant, preferred, class_marker, fx_suffix); null if it may have one."""
    t = F.coalesce(ticker, F.lit(""))
    return (
        F.when(t == "", "empty").when(t.rlike(r"\s"), "bond").when(t.rlike(r"(?:^|[^A-Z])(WT|WTS|WS|/WS|-WT|-W)$"), "warrant").when(t.rlike(r"-P[A-Z]?$|^.*-P$"), "preferred")
        .when(t.rlike(r"\*$"), "class_marker").when(t.rlike(r"(?:USD|EUR|GBP|JPY|CAD|CHF|AUD)$") & (F.length(t) >= 6), "fx_suffix")
    )
