"""Pieces of the plans and of their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.canonical import Tables


def S(x: str) -> str:
    """DuckDB's sum of integers as BIGINT."""
    return f"CAST(sum({x}) AS BIGINT)"


def total(x: str | Column) -> Column:
    return F.sum(x)


def at(df: DataFrame, ticker: str | None = None, quarter: str | None = None) -> DataFrame:
    """Rows of a ticker (or, as in the register, its cusip) and quarter."""
    if quarter:
        df = df.where(F.col("quarter") == quarter)
    return df.where(F.col("ticker") == ticker) if ticker else df


def top_parents(t: Tables) -> DataFrame:
    """entity_id and top_name, the canonical name of its climbed top parent."""
    return t.top_parents.select("entity_id", "top_name")


def named(t: Tables, holdings: DataFrame) -> DataFrame:
    """``holdings`` with parent_name: the top parent's name, else the filed parent, else the manager."""
    return holdings.join(top_parents(t), "entity_id", "left").withColumn("parent_name", F.coalesce("top_name", "inst_parent_name", "manager_name")).drop("top_name")


#: DuckDB: the climb, and holdings with parent_name.
CLIMB = """edges AS (SELECT child_entity_id AS c, parent_entity_id AS p FROM relationships
          WHERE valid_to = DATE '9999-12-31' AND control_type IN ('control', 'mutual', 'merge')),
paths AS (WITH RECURSIVE r AS (
            SELECT entity_id, entity_id AS top, CAST(0 AS BIGINT) AS hops FROM entities
            UNION SELECT r.entity_id, e.p, r.hops + 1 FROM r JOIN edges e ON r.top = e.c WHERE r.hops < 10)
          SELECT * FROM r),
tops AS (SELECT entity_id, top AS top_parent_entity_id, hops FROM (
           SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY hops DESC, top) AS k FROM paths) q WHERE k = 1)"""
NAMED = (
    CLIMB
    + """,
named AS (SELECT h.*, coalesce(e.canonical_name, h.inst_parent_name, h.manager_name) AS parent_name
          FROM holdings h LEFT JOIN tops t ON h.entity_id = t.entity_id
          LEFT JOIN entities e ON e.entity_id = t.top_parent_entity_id WHERE h.is_latest)"""
)
