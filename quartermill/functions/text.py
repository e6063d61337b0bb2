"""Rules over names and filing texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities and what they are written as; then patterns over cleaned filing text, first match first.
ENTITIES = (
    ("&nbsp;", " "), ("&#160;", " "), ("&#xa0;", " "), ("&amp;", "&"), ("&#38;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&ldquo;", '"'), ("&rdquo;", '"'), ("&lsquo;", "'"), ("&rsquo;", "'"),
    ("&sect;", "§"), ("&#x2013;", "-"), ("&#x2014;", "-"), ("&#x2610;", " "), ("&#xA0;", " "),
)
CUSIP_PATTERN = r"CUSIP\s*(?:No\.?|Number|#)?\s*[:\s]*([A-Z0-9]{6,9})"
PCT_PATTERNS = (
    r"PERCENT\s+OF\s+CLASS\s+REPRESENTED\s+BY\s+AMOUNT\s+IN\s+ROW\s*[\(\[]?9[\)\]]?[\s.:]*(\d+[\.,]?\d*)\s*%",
    r"13[\.\s]*PERCENT\s+OF\s+CLASS\s+REPRESENTED\s+BY\s+(?:AMOUNT\s+IN\s+)?ROW\s*[\(\[]?11[\)\]]?\s*(\d+[\.,]?\d*)\s*%",
    r"PERCENT\s+OF\s+CLASS\s+REPRESENTED\s+BY\s+(?:AMOUNT\s+IN\s+)?ROW\s*[\(\[]?(?:9|11)[\)\]]?\D{0,80}?(\d{1,3}[\.,]?\d*)\s*%",
    r"Item\s*11[\s.:]+(?:Percent|Pct)\s+of\s+Class\s+(?:Owned|Represented)\D{0,20}?(\d+[\.,]?\d*)\s*%",
    r"Item\s*11[\s.:]+(\d+[\.,]?\d*)\s*%",
    r"(?:Percent|PERCENT|Pct|Percentage)\s+of\s+(?:the\s+)?Class\s*(?:Owned|Represented)?[\s.:]*(\d+[\.,]?\d*)\s*%",
    r"Percentage\s+of\s+Class\s+Represented\s+by\s+Amount\s+in\s+Row\s*[\(\[]?(?:9|11)[\)\]]?[\s.:]*(\d+[\.,]?\d*)\s*%",
    r"percent\s+of\s+class\D{0,60}?(\d{1,3}\.\d+)\s*%",
    r"(?:Resulting|New)\s+(?:situation|percentage)[^%]{0,100}?(\d+[\.,]\d+)\s*%",
    r"PERCENT\s+OF\s+CLASS\s+REPRESENTED\s+BY\s+(?:AMOUNT\s+IN\s+)?ROW\s*[\(\[]?(?:9|11)[\)\]]?\D{0,60}?(\d{1,3}[\.,]\d+)",
    r"(?:Percent|Percentage)\s+of\s+Class\s+Represented\s+by\s+Amount\s+in\s+Row\s*[\(\[]?(?:9|11)[\)\]]?\D{5,80}?(\d+[\.,]\d+)\s*%",
)
SHARE_PATTERNS = (
    r"AGGREGATE\s+AMOUNT\s+BENEFICIALLY\s+OWNED\s+BY\s+EACH\s+REPORTING\s+PERSON[\s.:]*(?:\(\d+\)\s*)?(\d[\d,]+)",
    r"(?:9|11)[\.\s]+AGGREGATE\s+AMOUNT\s+BENEFICIALLY\s+OWNED[^0-9]{0,60}?(\d[\d,]+)",
    r"Item\s*9[\s.:]+Aggregate\s+Amount\s+(?:Beneficially\s+)?Owned[\s.:]*(\d[\d,]*)",
    r"Aggregate\s+Amount\s+(?:Beneficially\s+)?Owned\s+by\s+Each\s+Reporting\s+Person\D{0,80}?([\d,]{4,})\s*(?:shares)?",
    r"Item\s*9[\s.:]+(\d[\d,]{2,})",
    r"Amount\s+(?:Beneficially\s+)?Owned[\s.:]*(\d[\d,]+)",
    r"SHARED\s+(?:VOTING|DISPOSITIVE)\s+POWER[\s.:]*(\d[\d,]+)",
    r"SOLE\s+VOTING\s+POWER[\s.:]*(\d[\d,]+)",
)
DATE_PATTERNS = (
    r"Date\s+of\s+Event\s+Which\s+Requires\s+Filing[^)]*\)\s*([A-Za-z]+\s+\d{1,2},?\s+\d{4})",
    r"Date\s+of\s+Event[:\s]*(\d{1,2}/\d{1,2}/\d{4})",
    r"Date\s+of\s+Event[:\s]*(\d{4}-\d{2}-\d{2})",
)
DATE_FORMATS = ("MMMM d, yyyy", "MMMM d yyyy", "M/d/yyyy", "yyyy-MM-dd")
PERSON_PATTERNS = (
    r"(?:1\s+)?NAMES?\s+OF\s+REPORTING\s+PERSONS?\s*[:\s]*([A-Z][A-Za-z.'&,\s/-]+?)(?=\s*(?:\d\s|CHECK|2\s|Item\s*2|SEC\s+USE))",
    r"Item\s*1[:\s]+Reporting\s+Person\s*[-–—:\s]*([\w\s.,&'/-]+?)(?=\s*(?:Item\s*2|CHECK|\n|2\.))",
    r"NAMES?\s+OF\s+REPORTING\s+PERSONS?\s+I\.?R\.?S\.?[^A-Z]{0,50}([A-Z][A-Za-z.'&,\s/-]{3,80}?)(?=\s*(?:\d\s|CHECK|2\s))",
    r"NAME\s+OF\s+REPORTING\s+PERSON[^A-Z]{0,30}([A-Z][A-Za-z.'&,\(\)\s/-]{3,80}?)(?=\s*(?:\d\s|CHECK|2\s|Item|SEC))",
)
PASSIVE_NAME = r"\b(index|idx|s&p\s*500|russell\s*\d|nasdaq|dow\s*jones|total\s*(stock|bond|market)|wilshire|msci|ftse|barclays|aggregate|broad\s*market|qqq|target\s*retirement|target\s*date|\d+(?:\.\d+)?x|proshares|profund|direxion|daily\s*inverse|inverse)\b"
EXCLUDED_NAME = r"\b(etf|exchange[\s-]*traded|money\s*market|treasury|government\s*money|prime\s*money|fund\s*of\s*funds|master\s*fund|feeder\s*fund)\b"
SUFFIXES = ((r"\bINCORPORATED\b", "INC"), (r"\bCORPORATION\b", "CORP"), (r"\bCOMPANY\b", "CO"), (r"\bLIMITED\b", "LTD"), (r"\bL\.L\.C\.", "LLC"), (r"\bL\.P\.", "LP"))


def clean_text(html: Column) -> Column:
    """Text without tags; known entities decoded, others blank; digits that blanks had split rejoined; white space collapsed."""
    x = F.regexp_replace(html, r"<[^>]+>", " ")
    for old, new in ENTITIES:
        x = F.replace(x, F.lit(old), F.lit(new))
    x = F.regexp_replace(x, r"&(?:#x[0-9a-fA-F]+|#[0-9]+|\w+);", " ")
    for _ in range(2):
        x = F.regexp_replace(x, r"(\d)\s+(\d)", "$1$2")
    x = F.regexp_replace(x, r"(\d)\s*\.\s*(\d)", "$1.$2")
    return F.regexp_replace(x, r"\s+", " ")


def first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    """Group 1 of the first pattern that matches; null where none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, f"(?i){p}", 1), F.lit("")) for p in patterns])


def cusip(text: Column) -> Column:
    return first_match(text, (CUSIP_PATTERN,))


def pct_owned(text: Column) -> Column:
    """A percentage from 0 to 100. A first match outside gives null; no later pattern is tried."""
    value = F.replace(first_match(text, PCT_PATTERNS), F.lit(","), F.lit("")).try_cast("double")
    return F.when(value.between(0, 100), value)


def shares_owned(text: Column) -> Column:
    """0, or 100 and more shares; a first match between gives null."""
    value = F.replace(first_match(text, SHARE_PATTERNS), F.lit(","), F.lit("")).try_cast("bigint")
    return F.when((value == 0) | (value >= 100), value)


def event_date(text: Column) -> Column:
    """The date of the event, from the first pattern that matches; null if that isn't a date."""
    found = F.trim(first_match(text, DATE_PATTERNS))
    return F.coalesce(*[F.to_date(F.try_to_timestamp(found, F.lit(f))) for f in DATE_FORMATS])


def purpose(text: Column, filing_type: Column) -> Column:
    """What a 13D says under Item 4: up to Item 5 within 3,000 characters, else 600; at most 500 are kept. Null for others."""
    after = F.regexp_extract(text, r"(?is)Item\s*4\.?\s*(?:Purpose\s+of\s+Transaction|Purpose)[.\s]*(.{0,3000})", 1)
    said = F.when(after.rlike(r"(?i)Item\s*5"), F.regexp_extract(after, r"(?is)^(.*?)Item\s*5", 1)).otherwise(F.substring(after, 1, 600))
    said = F.substring(F.trim(F.regexp_replace(said, r"\s+", " ")), 1, 500)
    return F.when(filing_type.contains("13D"), F.nullif(said, F.lit("")))


def reporting_person(text: Column) -> Column:
    """Who reports, from the first pattern whose match reads like a name; looks at 8,000 characters, where the cover page is."""
    head = F.substring(text, 1, 8000)

    def name(pattern: str) -> Column:
        got = F.trim(F.regexp_replace(F.trim(F.regexp_extract(head, f"(?i){pattern}", 1)), r"\s+(I\.?R\.?S|S\.?S\.?|Check|CHECK).*$", ""))
        fine = (F.length(got) > 3) & (F.length(got) < 100) & got.rlike(r"^\p{L}") & ~got.contains("I.R.S.") & ~F.upper(got).contains("CHECK")
        return F.when(fine, got)

    return F.coalesce(*map(name, PERSON_PATTERNS))


def ownership_check(pct: Column, shares: Column) -> Column:
    """ok, pct_out_of_range (blocked) or shares_tiny (flagged)."""
    return F.when((pct < 0) | (pct > 100), "pct_out_of_range").when((shares > 0) & (shares < 100), "shares_tiny").otherwise("ok")


def fund_strategy(name: Column, equity_share: Column, positions: Column, is_final: Column | None = None) -> Column:
    """passive or excluded by name, final_filing, empty without positions, else by the equity share of value."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(low.rlike(PASSIVE_NAME), "passive").when(low.rlike(EXCLUDED_NAME), "excluded").when(F.lit(False) if is_final is None else F.coalesce(is_final, F.lit(False)), "final_filing").when(F.coalesce(positions, F.lit(0)) == 0, "empty")
        .when(equity_share >= 0.90, "active").when(equity_share >= 0.60, "balanced").when(equity_share >= 0.30, "multi_asset").otherwise("bond_or_other")
    )


def normal_name(name: Column) -> Column:
    """Upper case, legal suffixes in one form, no marks at the end, single blanks."""
    x = F.trim(F.upper(F.trim(name)))
    for pattern, short in SUFFIXES:
        x = F.regexp_replace(x, pattern, short)
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[.,;]+$", ""), r"\s+", " "))


def aum_label(value: Column) -> Column:
    """$1.2T, B, M or K; a dash for null and zero."""
    def step(size: float, mark: str) -> Column:
        return F.concat(F.lit("$"), F.format_number(value / size, 1), F.lit(mark))

    return F.when(F.coalesce(value, F.lit(0)) == 0, "—").when(value >= 1e12, step(1e12, "T")).when(value >= 1e9, step(1e9, "B")).when(value >= 1e6, step(1e6, "M")).otherwise(step(1e3, "K"))
