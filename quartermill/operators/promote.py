"""Versions of a table: amendments, promotion, diffs and merges, without MERGE.

Each function gives the whole new version; writing it with dynamic partition
overwrite replaces only the partitions that it has rows for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import OPEN_DATE


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def _keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[Column]]:
    marked = df.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_staged", F.lit(True))
    return marked, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]


def _all(on: list[Column]) -> Column:
    out = on[0]
    for c in on[1:]:
        out = out & c
    return out


def append_is_latest(prod: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of staged keys turn stale; staged rows are added as latest."""
    marked, on = _keys(staged, keys)
    old = prod.join(marked, _all(on), "left").withColumn("is_latest", F.col("is_latest") & F.col("_staged").isNull()).select(*prod.columns)
    return old.unionByName(staged.withColumn("is_latest", F.lit(True)), allowMissingColumns=True)


def scd_type2(prod: DataFrame, staged: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """The open row of a staged key closes ``now``; the staged row opens."""
    marked, on = _keys(staged, keys)
    is_open = F.col("valid_to") == F.lit(OPEN_DATE).cast("date")
    old = prod.join(marked, _all(on), "left").withColumn("valid_to", F.when(is_open & F.col("_staged"), now).otherwise(F.col("valid_to"))).select(*prod.columns)
    return old.unionByName(staged.withColumn("valid_from", now).withColumn("valid_to", F.lit(OPEN_DATE).cast("date")))


def direct_write(prod: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of staged keys are replaced."""
    marked, on = _keys(staged, keys)
    return prod.join(marked, _all(on), "left_anti").unionByName(staged)


def insert_or_ignore(prod: DataFrame, staged: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Only staged rows of new keys are added: of each key the first in ``order`` (by the other columns where none is given)."""
    marked, on = _keys(prod, keys)
    rest = order or [F.col(c).asc_nulls_last() for c in staged.columns if c not in keys] or [F.lit(1)]
    return prod.unionByName(latest_by(staged, keys, rest).join(marked, _all(on), "left_anti"))


def merge_nulls(prod: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """Nulls of old rows are filled from staged rows of their key; staged rows of new keys are added."""
    new = staged.select(*[F.col(c).alias(f"_{c}") for c in staged.columns])
    on = _all([F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return prod.join(new, on, "full").select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in prod.columns])


def diff_counts(prod: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of keys added, changed, unchanged and absent."""
    a = prod.select(*keys, F.struct(*[c for c in prod.columns if c not in keys]).alias("a"), F.lit(True).alias("in_a"))
    b = staged.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*[c for c in prod.columns if c not in keys]).alias("b"), F.lit(True).alias("in_b"))
    both = a.join(b, _all([F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "full")
    status = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "absent").when(~F.col("a").eqNullSafe(F.col("b")), "changed").otherwise("unchanged")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def downgrades(prod: DataFrame, staged: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys and columns that a promotion would take from known to null: column, keys and how many latest rows it would displace."""
    empty = staged.groupBy(*keys).agg(*[(F.count(c) == 0).alias(f"{c}_null") for c in columns])
    held = prod.where("is_latest").groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(*[F.count(c).alias(f"{c}_held") for c in columns])
    both = empty.join(held, _all([F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]))
    cases = F.array_compact(F.array(*[F.when(F.col(f"{c}_null") & (F.col(f"{c}_held") > 0), F.struct(F.lit(c).alias("column"), F.col(f"{c}_held").alias("displaced"))) for c in columns]))
    return both.select(*keys, F.explode(cases).alias("case")).select(*keys, "case.*")


def rollback(prod: DataFrame, impacts: DataFrame, keys: list[str]) -> DataFrame:
    """The version before a run of ``append_is_latest``, from its log: keys and ``action``.

    The log is undone last entry first: latest rows of inserted keys go, then
    stale rows of flipped keys turn latest. A log that names other actions
    can't be undone from itself; restore a snapshot then.
    """
    inserted = F.bool_or(F.col("action") == "insert").alias("_inserted")
    flipped = F.bool_or(F.col("action") == "flip_is_latest").alias("_flipped")
    log = impacts.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(inserted, flipped)
    rows = prod.join(log, _all([F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left")
    rows = rows.where(~(F.coalesce("_inserted", F.lit(False)) & F.col("is_latest")))
    return rows.withColumn("is_latest", F.col("is_latest") | F.coalesce("_flipped", F.lit(False))).select(*prod.columns)
