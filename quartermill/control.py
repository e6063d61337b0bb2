"""The control plane: dataset registry and lineage, run states, filing calendar."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta


@dataclass(frozen=True)
class Dataset:
    """A table: its layer (0 control to 4 derived), how it is promoted, by which key, and what it is built from."""

    name: str
    layer: int
    promote: str
    key: tuple[str, ...] = ()
    built_from: tuple[str, ...] = ()


DATASETS = {
    d.name: d
    for d in (
        Dataset("holdings", 3, "append_is_latest", ("cik", "quarter")),
        Dataset("fund_holdings", 3, "append_is_latest", ("series_id", "report_month")),
        Dataset("beneficial", 3, "append_is_latest", ("accession_number",)),
        Dataset("short_interest", 3, "insert_or_ignore", ("ticker", "report_date")),
        Dataset("market_data", 3, "direct_write", ("ticker",)),
        Dataset("soh", 3, "direct_write", ("ticker", "as_of_date")),
        Dataset("entities", 2, "scd_type2", ("entity_id",)),
        Dataset("rollup_history", 2, "scd_type2", ("entity_id", "rollup_type"), ("entities",)),
        Dataset("investor_flows", 4, "partition_overwrite", ("period", "rollup_type"), ("holdings", "rollup_history")),
        Dataset("ticker_flow_stats", 4, "partition_overwrite", ("period",), ("investor_flows", "market_data")),
        Dataset("sector_flows_rollup", 4, "partition_overwrite", ("quarter_to",), ("holdings", "market_data")),
        Dataset("peer_rotation_flows", 4, "partition_overwrite", ("quarter_to",), ("holdings", "fund_holdings", "market_data")),
        Dataset("summary_by_ticker", 4, "partition_overwrite", ("quarter",), ("holdings",)),
        Dataset("summary_by_parent", 4, "partition_overwrite", ("quarter",), ("holdings", "fund_holdings")),
        Dataset("unified_holdings", 4, "partition_overwrite", ("quarter",), ("holdings", "fund_holdings", "rollup_history")),
        Dataset("beneficial_ownership_current", 4, "partition_overwrite", (), ("beneficial",)),
    )
}


def downstream_of(name: str) -> list[str]:
    """All tables to rebuild after ``name`` changed, each after what it is built from."""
    if name not in DATASETS:
        raise KeyError(name)
    touched, order = {name}, []
    while True:
        new = [d.name for d in DATASETS.values() if d.name not in touched and touched & set(d.built_from)]
        if not new:
            break
        touched |= set(new)
    left = touched - {name}
    while left:
        ready = sorted(n for n in left if not set(DATASETS[n].built_from) & left)
        order += ready
        left -= set(ready)
    return order


#: Run states and where each may go.
STATES = {
    "pending": {"fetching", "failed"},
    "fetching": {"parsing", "failed"},
    "parsing": {"validating", "failed"},
    "validating": {"pending_approval", "failed"},
    "pending_approval": {"approved", "rejected"},
    "approved": {"promoting", "failed"},
    "promoting": {"complete", "failed"},
    "complete": {"rolled_back"},
    "failed": set(),
    "rejected": set(),
    "rolled_back": set(),
}


class Run:
    """An ingest run. Halts for approval; moves only along ``STATES``."""

    def __init__(self, state: str = "pending"):
        self.state = state

    def to(self, state: str) -> Run:
        if state not in STATES.get(self.state, set()):
            raise ValueError(f"a run that is {self.state} can't become {state}")
        self.state = state
        return self


def quarter_end(day: date) -> date:
    month = (day.month - 1) // 3 * 3 + 3
    return date(day.year + month // 12, month % 12 + 1, 1) - timedelta(days=1)


def last_quarter_end(day: date) -> date:
    """The latest quarter end at or before a day."""
    end = quarter_end(day)
    return end if end <= day else date(day.year, (day.month - 1) // 3 * 3 + 1, 1) - timedelta(days=1)


def next_13f_deadline(day: date) -> date:
    """45 days after the latest quarter end; once passed, that of the running quarter."""
    due = last_quarter_end(day) + timedelta(days=45)
    return due if due >= day else quarter_end(day) + timedelta(days=45)


def is_stale(loaded: date | None, today: date, most_days: int) -> bool:
    """Whether a table that was loaded then is too old; one never loaded is."""
    return loaded is None or (today - loaded).days > most_days
