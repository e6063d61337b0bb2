"""All named queries of the library, whichever of the family modules they are in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.canonical import Tables
from . import answers, builders, curation, entities, flows, ladders, market, register

FAMILIES = (register, flows, market, entities, builders, curation, ladders, answers)


def _bound(plan: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(Tables(spark, sf_dir))

    run.__doc__ = plan.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bound(plan) for family in FAMILIES for name, (plan, _) in family.QUERIES.items()}


def statements() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, (_, sql) in family.QUERIES.items() if sql}
