"""Fuzzy name matching: blocks by tokens, scored by a vectorised UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from ..operators.relational import top_n

# Words that don't tell names apart.
COMMON = ("CAPITAL", "MANAGEMENT", "ASSET", "ADVISORS", "ADVISERS", "PARTNERS", "INVESTMENT", "INVESTMENTS", "GROUP", "FUND", "FUNDS", "TRUST", "INC", "LLC", "LP", "LTD", "CO", "CORP", "THE", "AND", "OF")


def token_sort_ratio(a: str, b: str) -> float:
    """100 times the similarity of two names with their words sorted: twice the longest common subsequence's length over both lengths."""
    x, y = (" ".join(sorted((s or "").upper().split())) for s in (a, b))
    if not x or not y:
        return 0.0
    if x == y:
        return 100.0
    row = [0] * (len(y) + 1)
    for c in x:
        before = 0
        for k, d in enumerate(y, start=1):
            before, row[k] = row[k], before + 1 if c == d else max(row[k], row[k - 1])
    return 200.0 * row[-1] / (len(x) + len(y))


@F.pandas_udf(DoubleType())
def score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_sort_ratio(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(IntegerType())
def sorted_length(a: pd.Series) -> pd.Series:
    """The length that token_sort_ratio sees."""
    return pd.Series([len(" ".join((x or "").upper().split())) for x in a], dtype="int32")


def brand_tokens(name: str):
    """A name's words but the common ones and those of one letter."""
    words = F.split(F.regexp_replace(F.upper(name), "[^A-Z0-9 ]", ""), " +")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*COMMON)))


def best_matches(left: DataFrame, right: DataFrame, least: float = 85.0, most_common: int = 1000) -> DataFrame:
    """left_id, right_id, score: each left name's best right name of at least ``least``; ties to the smaller id.

    left: left_id, left_name; right: right_id, right_name. Only names that
    share a brand token are compared, and names of equal sorted words. A token
    that over ``most_common`` right names have is dealt to blocks of about so
    many; pairs whose lengths can't reach ``least`` are not scored.
    """
    a = left.withColumn("size_a", sorted_length("left_name")).withColumn("token", F.explode(brand_tokens("left_name")))
    b = right.withColumn("size_b", sorted_length("right_name")).withColumn("token", F.explode(brand_tokens("right_name")))
    parts = b.groupBy("token").agg(F.ceil(F.count("*") / most_common).cast("int").alias("parts"))
    a = a.join(parts, "token").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
    b = b.join(parts, "token").withColumn("part", F.expr("cast(pmod(xxhash64(right_id), parts) as int)")).drop("parts")
    reach = 200 * F.least("size_a", "size_b") >= (least - 1e-9) * (F.col("size_a") + F.col("size_b"))
    pairs = a.join(b, ["token", "part"]).where(reach).select("left_id", "left_name", "right_id", "right_name").distinct()
    key = lambda c: F.array_join(F.array_sort(F.split(F.upper(F.trim(c)), " +")), " ")
    equal = left.join(right, key("left_name") == key("right_name")).select("left_id", "left_name", "right_id", "right_name")
    scored = pairs.unionByName(equal).distinct().withColumn("score", score("left_name", "right_name")).where(F.col("score") >= least)
    return top_n(scored, ["left_id"], [F.desc("score"), F.asc("right_id")], 1).select("left_id", "right_id", "score")
