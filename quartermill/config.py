"""Periods and default parameters of the named queries."""

from __future__ import annotations

QUARTERS = ("2000Q4", "2001Q1", "2001Q2", "2001Q3")
FIRST, PREVIOUS, LATEST = QUARTERS[0], QUARTERS[-2], QUARTERS[-1]
OPEN_DATE = "9999-12-31"
EC, DM = "economic_control_v1", "decision_maker_v1"
WORLDVIEWS = (EC, DM)

#: Default subjects of ticker queries.
TICKER, OTHER = "P07", "P11"

# Category sets; they differ by query.
FUND_ACTIVE = ("active", "balanced", "multi_asset")
FUND_PASSIVE = ("passive", "bond_or_other", "excluded", "final_filing")
ROTATION_ACTIVE = ("active", "hedge_fund", "activist")
CONVICTION_ACTIVE = ("active", "hedge_fund", "activist", "quantitative")
SECTOR_MIX_ACTIVE = ("active", "hedge_fund")
SUMMARY_ACTIVE = ("active", "hedge_fund", "quantitative", "activist")
EQUITY_CATEGORIES = ("EC", "EP")
CLIMB_TYPES = ("control", "mutual", "merge")


def sql_list(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"
