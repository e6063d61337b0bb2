"""Readers of filing data: 13F and N-PORT sets in TSV, N-PORT and N-CEN XML, adviser CSV, short-volume files, XBRL share facts.

All schemas are stated; nothing is inferred. Values are cast with try_cast, so
a bad value is null and the row stays, unless the row itself is malformed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.promote import latest_by

# File columns.
SUBMISSION = "ACCESSION_NUMBER FILING_DATE SUBMISSIONTYPE CIK PERIODOFREPORT".split()
COVERPAGE = "ACCESSION_NUMBER REPORTCALENDARORQUARTER ISAMENDMENT AMENDMENTNO FILINGMANAGER_NAME FILINGMANAGER_CITY FILINGMANAGER_STATEORCOUNTRY CRDNUMBER SECFILENUMBER".split()
INFOTABLE = "ACCESSION_NUMBER NAMEOFISSUER TITLEOFCLASS CUSIP FIGI VALUE SSHPRNAMT SSHPRNAMTTYPE PUTCALL INVESTMENTDISCRETION OTHERMANAGER VOTING_AUTH_SOLE VOTING_AUTH_SHARED VOTING_AUTH_NONE".split()
OTHERMANAGER = "ACCESSION_NUMBER SEQUENCENUMBER CIK FORM13FFILENUMBER CRDNUMBER SECFILENUMBER NAME".split()
ADV_COLUMNS = {
    "Organization CRD#": "crd_number", "SEC#": "sec_file_number", "CIK#": "cik", "Primary Business Name": "firm_name", "Legal Name": "legal_name", "Main Office City": "city",
    "Main Office State": "state", "Main Office Street Address 1": "address", "5F(2)(a)": "adv_5f_raum_discrtnry", "5F(2)(b)": "adv_5f_raum_non_discrtnry", "5F(2)(c)": "adv_5f_raum",
    "5F(2)(f)": "adv_5f_num_accts", "Any Hedge Funds": "has_hedge_funds", "Any PE Funds": "has_pe_funds", "Any VC Funds": "has_vc_funds",
}
SHARE_TAGS = (("dei", "EntityCommonStockSharesOutstanding"), ("us-gaap", "CommonStockSharesOutstanding"), ("us-gaap", "EntityCommonStockSharesOutstanding"), ("us-gaap", "WeightedAverageNumberOfSharesOutstandingBasic"))


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A tab-separated file with a header, all columns text; malformed rows are dropped."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).csv(path, sep="\t", header=True, mode="DROPMALFORMED", quote='"')


def filings_13f(submissions: DataFrame, covers: DataFrame, quarter: str) -> DataFrame:
    """One filing of each filer and quarter: amendments before originals, then the latest filing date (as text)."""
    cover = covers.select(F.col("ACCESSION_NUMBER").alias("a"), F.col("FILINGMANAGER_NAME").alias("manager_name"), F.col("CRDNUMBER").alias("crd_number"))
    rows = submissions.join(cover, submissions["ACCESSION_NUMBER"] == cover["a"], "left").select(
        F.col("ACCESSION_NUMBER").alias("accession_number"), F.lpad("CIK", 10, "0").alias("cik"), "manager_name", "crd_number", F.lit(quarter).alias("quarter"),
        F.col("PERIODOFREPORT").alias("report_date"), F.col("SUBMISSIONTYPE").alias("filing_type"), F.col("SUBMISSIONTYPE").endswith("/A").alias("amended"), F.col("FILING_DATE").alias("filed_date"))
    return latest_by(rows, ["cik", "quarter"], [F.desc("amended"), F.desc("filed_date"), F.desc("accession_number")])


def holdings_13f(filings: DataFrame, info: DataFrame, multiplier: int = 1000) -> DataFrame:
    """Holdings of the kept filings; pct_of_portfolio is a fraction of the filing's value."""
    rows = info.select(
        F.col("ACCESSION_NUMBER").alias("accession_number"), F.col("CUSIP").alias("cusip"), F.col("NAMEOFISSUER").alias("issuer_name"), F.col("VALUE").try_cast("bigint").alias("value"),
        F.col("SSHPRNAMT").try_cast("bigint").alias("shares"), F.col("INVESTMENTDISCRETION").alias("discretion"), F.col("VOTING_AUTH_SOLE").try_cast("bigint").alias("vote_sole"),
        F.col("VOTING_AUTH_SHARED").try_cast("bigint").alias("vote_shared"), F.col("VOTING_AUTH_NONE").try_cast("bigint").alias("vote_none"), F.col("PUTCALL").alias("put_call"))
    total = F.sum("value").over(Window.partitionBy("accession_number")).cast("double")
    rows = rows.withColumn("pct_of_portfolio", F.col("value") / F.nullif(total, F.lit(0.0))).withColumn("market_value_usd", F.col("value") * multiplier).drop("value")
    return rows.join(filings.select("accession_number", "cik", "manager_name", "quarter", "report_date"), "accession_number").withColumn("is_latest", F.lit(True))


def read_13f(spark: SparkSession, folder: str, quarter: str) -> DataFrame:
    """Holdings of a quarter's folder of SUBMISSION, COVERPAGE and INFOTABLE files."""
    filings = filings_13f(read_tsv(spark, f"{folder}/SUBMISSION.tsv", SUBMISSION), read_tsv(spark, f"{folder}/COVERPAGE.tsv", COVERPAGE), quarter)
    return holdings_13f(filings, read_tsv(spark, f"{folder}/INFOTABLE.tsv", INFOTABLE))


def nport_submissions(registrants: DataFrame, submissions: DataFrame, info: DataFrame) -> DataFrame:
    """One row for each dated submission; without a series id one is made of the filer's number and the accession.

    registrants: ACCESSION_NUMBER, CIK, REGISTRANT_NAME; submissions:
    ACCESSION_NUMBER, REPORT_DATE (dd-MMM-yyyy), IS_LAST_FILING, SUB_TYPE; info:
    ACCESSION_NUMBER, SERIES_ID, SERIES_NAME, NET_ASSETS. Series are amended:
    of one series and month the greatest accession stays.
    """
    key = "ACCESSION_NUMBER"
    day = F.to_date(F.try_to_timestamp(F.initcap(F.col("REPORT_DATE")), F.lit("dd-MMM-yyyy")))
    rows = submissions.withColumn("report_date", day).where("report_date is not null").join(registrants, key, "left").join(info, key, "left")
    cik = F.lpad(F.coalesce(F.trim("CIK"), F.lit("")), 10, "0")
    bare = F.ltrim(cik, F.lit("0"))
    series = F.coalesce(F.nullif(F.trim("SERIES_ID"), F.lit("")), F.concat(F.when(bare == "", "0").otherwise(bare), F.lit("_"), F.col(key)))
    out = rows.select(
        F.col(key).alias("accession_number"), series.alias("series_id"), cik.alias("fund_cik"), F.coalesce(F.nullif(F.trim("SERIES_NAME"), F.lit("")), F.col("REGISTRANT_NAME")).alias("fund_name"),
        F.col("REGISTRANT_NAME").alias("family_name"), "report_date", F.date_format("report_date", "yyyy-MM").alias("report_month"), F.concat(F.year("report_date"), F.lit("Q"), F.quarter("report_date")).alias("quarter"),
        (F.coalesce(F.trim("IS_LAST_FILING"), F.lit("")) == "Y").alias("is_final"), F.coalesce("SUB_TYPE", F.lit("NPORT-P")).alias("sub_type"), F.col("NET_ASSETS").try_cast("double").alias("total_net_assets"))
    return latest_by(out, ["series_id", "report_month"], [F.desc("accession_number")])


_VALUE = "struct<_value: string>"
_NPORT = f"""genInfo struct<regName: string, regCik: string, seriesName: string, seriesId: string, repPdEnd: string, repPdDate: string, isFinalFiling: string>,
fundInfo struct<totAssets: string, netAssets: string>,
invstOrSecs struct<invstOrSec: array<struct<name: string, cusip: string, identifiers: struct<isin: {_VALUE}, ticker: {_VALUE}>, balance: string, units: string, curCd: string, valUSD: string, pctVal: string,
  payoffProfile: string, assetCat: string, assetConditional: struct<_assetCat: string>, fairValLevel: string, isRestrictedSec: string>>>"""


def read_nport_xml(spark: SparkSession, path: str) -> DataFrame:
    """Holdings of N-PORT files with their filing's fields. Files without general information give no rows."""
    rows = spark.read.format("xml").schema(_NPORT).option("rowTag", "formData").load(path).where("genInfo is not null")
    h = rows.select("genInfo", "fundInfo", F.explode_outer("invstOrSecs.invstOrSec").alias("h"))
    text = lambda c: F.trim(F.col(c))
    return h.select(
        text("genInfo.regName").alias("reg_name"), text("genInfo.regCik").alias("reg_cik"), text("genInfo.seriesName").alias("series_name"), text("genInfo.seriesId").alias("series_id"), text("genInfo.repPdEnd").alias("rep_pd_end"),
        text("genInfo.isFinalFiling").alias("is_final"), F.col("fundInfo.netAssets").try_cast("double").alias("net_assets"), text("h.name").alias("issuer_name"), text("h.cusip").alias("cusip"),
        F.coalesce("h.identifiers.isin._value", F.lit("")).alias("isin"), F.coalesce("h.identifiers.ticker._value", F.lit("")).alias("ticker"), F.col("h.balance").try_cast("double").alias("shares"),
        F.col("h.valUSD").try_cast("double").alias("market_value_usd"), F.col("h.pctVal").try_cast("double").alias("pct_of_nav"), text("h.payoffProfile").alias("payoff_profile"),
        F.coalesce(F.nullif(text("h.assetCat"), F.lit("")), F.col("h.assetConditional._assetCat"), F.lit("")).alias("asset_category"), F.coalesce(F.nullif(text("h.curCd"), F.lit("")), F.lit("USD")).alias("currency"))


_PERSON = "struct<{p}Name: string, {p}FileNo: string, {p}CrdNo: string, {p}Lei: string>"
_SERIES = f"""array<struct<mgmtInvSeriesId: string, mgmtInvFundName: string, investmentAdvisers: struct<investmentAdviser: array<{_PERSON.format(p="investmentAdviser")}>>, subAdvisers: struct<subAdviser: array<{_PERSON.format(p="subAdviser")}>>>>"""


def read_ncen_xml(spark: SparkSession, path: str) -> DataFrame:
    """Advisers of fund series from N-CEN files: the i-th series with the i-th adviser and, apart from that, the i-th sub-adviser of the file."""
    schema = f"reportPeriodDate string, managementInvestmentQuestionSeriesInfo struct<managementInvestmentQuestion: {_SERIES}>"
    rows = spark.read.format("xml").schema(schema).option("rowTag", "formData").load(path)
    q = F.col("managementInvestmentQuestionSeriesInfo.managementInvestmentQuestion")
    people = lambda group, one: F.flatten(F.transform(q, lambda x: F.coalesce(x[group][one], F.array())))

    def paired(role: str, group: str, one: str) -> Column:
        who = people(group, one)
        return F.transform(q, lambda x, i: F.struct(F.lit(role).alias("role"), x["mgmtInvSeriesId"].alias("series_id"), x["mgmtInvFundName"].alias("series_name"), F.get(who, i)[f"{one}Name"].alias("adviser_name"), F.get(who, i)[f"{one}CrdNo"].alias("adviser_crd"), F.get(who, i)[f"{one}FileNo"].alias("adviser_sec_file"), F.get(who, i)[f"{one}Lei"].alias("adviser_lei")))

    both = rows.select("reportPeriodDate", F.explode(F.concat(paired("adviser", "investmentAdvisers", "investmentAdviser"), paired("subadviser", "subAdvisers", "subAdviser"))).alias("r"))
    return both.select(F.col("reportPeriodDate").alias("report_date"), "r.*").where("coalesce(adviser_name, '') <> ''")


def read_adv(spark: SparkSession, path: str) -> DataFrame:
    """Advisers from a Latin-1 CSV: amounts without $ and commas, bad ones 0, and the discretionary share in percent to 2 places."""
    rows = spark.read.csv(path, header=True, encoding="ISO-8859-1", inferSchema=False)
    rows = rows.select(*[F.col(f"`{a}`").alias(b) if a in rows.columns else F.lit(None).cast("string").alias(b) for a, b in ADV_COLUMNS.items()])
    amount = lambda c: F.coalesce(F.trim(F.regexp_replace(c, "[$,]", "")).try_cast("double"), F.lit(0.0))
    rows = rows.withColumns({c: amount(c) for c in ("adv_5f_raum", "adv_5f_raum_discrtnry", "adv_5f_raum_non_discrtnry")}).withColumn("adv_5f_num_accts", amount("adv_5f_num_accts").cast("bigint"))
    return rows.withColumn("pct_discretionary", F.when(F.col("adv_5f_raum") > 0, F.round(F.col("adv_5f_raum_discrtnry") / F.col("adv_5f_raum") * 100, 2)).otherwise(0.0))


def read_short_volume(spark: SparkSession, path: str) -> DataFrame:
    """Daily short volume from pipe-separated files; rows without a ticker of at most 10 characters or with bad numbers are left out."""
    rows = spark.read.schema("d string, ticker string, short string, exempt string, total string, market string").csv(path, sep="|", header=True, mode="PERMISSIVE")
    number = lambda c: F.col(c).try_cast("double").cast("bigint")
    out = rows.select(F.trim("ticker").alias("ticker"), number("short").alias("short_volume"), number("exempt").alias("short_exempt_volume"), number("total").alias("total_volume"), F.to_date(F.try_to_timestamp("d", F.lit("yyyyMMdd"))).alias("report_date"))
    out = out.where("ticker <> '' and length(ticker) <= 10 and short_volume is not null and short_exempt_volume is not null and total_volume is not null")
    return out.withColumn("report_month", F.date_format("report_date", "yyyy-MM"))


def read_share_facts(spark: SparkSession, path: str) -> DataFrame:
    """Shares outstanding by date from XBRL fact files: of facts with one end date the tag of highest priority counts, of one tag the first."""
    fact = "array<struct<end: string, val: bigint, form: string, filed: string>>"
    tag = f"struct<units: struct<shares: {fact}>>"
    by_space: dict[str, list[str]] = {}
    for space, name in SHARE_TAGS:
        by_space.setdefault(space, []).append(f"`{name}`: {tag}")
    schema = "cik bigint, facts struct<" + ", ".join(f"`{s}`: struct<{', '.join(t)}>" for s, t in by_space.items()) + ">"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    parts = [rows.select("cik", F.lit(k).alias("priority"), F.lit(f"{s}:{n}").alias("source_tag"), F.posexplode(F.col(f"facts.`{s}`.`{n}`.units.shares"))) for k, (s, n) in enumerate(SHARE_TAGS)]
    facts = parts[0]
    for p in parts[1:]:
        facts = facts.unionByName(p)
    facts = facts.select(F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"), "priority", "source_tag", "pos", F.to_date("col.end").alias("as_of_date"), F.col("col.val").alias("shares"), F.col("col.form").alias("form"), F.to_date("col.filed").alias("filed_date"))
    return latest_by(facts.where("as_of_date is not null and coalesce(shares, 0) <> 0"), ["cik", "as_of_date"], [F.asc("priority"), F.asc("pos")]).drop("priority", "pos")


def read_13dg(spark: SparkSession, path: str) -> DataFrame:
    """Ownership filings from whole text files: cleaned text, cusip, percent, shares, intent (13D: activist) and amendment flag by file name."""
    rows = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    text = X.clean_text(F.col("value"))
    is_13d = F.col("file").rlike("(?i)13d")
    return rows.select("file", X.cusip(text).alias("cusip"), X.pct_owned(text).alias("pct_owned"), X.shares_owned(text).alias("shares_owned"), F.when(is_13d, "activist").otherwise("passive").alias("intent"), F.col("file").rlike("(?i)13[dg][-_]?a").alias("is_amendment"))


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinite values of floating columns as null."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumns({f.name: F.when(~bad(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")) for f in df.schema if f.dataType.simpleString() in ("double", "float")})
