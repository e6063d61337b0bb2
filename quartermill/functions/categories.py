"""Category ladders, each as a Spark column and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FUND_ACTIVE


def fund_label(column: str) -> Column:
    """active, passive, bond, excluded or unknown."""
    c = F.col(column)
    return F.when(c.isin(*FUND_ACTIVE), "active").when(c == "passive", "passive").when(c == "bond_or_other", "bond").when(c.isin("excluded", "final_filing"), "excluded").otherwise("unknown")


def fund_label_sql(x: str) -> str:
    return f"CASE WHEN {x} IN ('active', 'balanced', 'multi_asset') THEN 'active' WHEN {x} = 'passive' THEN 'passive' WHEN {x} = 'bond_or_other' THEN 'bond' WHEN {x} IN ('excluded', 'final_filing') THEN 'excluded' ELSE 'unknown' END"


def holder_bucket() -> Column:
    """Passive (Index), Activist, Active or Other/Unknown, by entity type, else manager type."""
    c = F.coalesce("entity_type", "manager_type")
    return F.when(c == "passive", "Passive (Index)").when(c == "activist", "Activist").when(c.isin("active", "hedge_fund", "quantitative"), "Active").otherwise("Other/Unknown")


def holder_bucket_sql() -> str:
    c = "coalesce(entity_type, manager_type)"
    return f"CASE WHEN {c} = 'passive' THEN 'Passive (Index)' WHEN {c} = 'activist' THEN 'Activist' WHEN {c} IN ('active', 'hedge_fund', 'quantitative') THEN 'Active' ELSE 'Other/Unknown' END"
