"""What one run asks for: dates, categories, owners, revenue cut and keyword."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

# First day with data, default window, default cuts.
DATA_START = date(2025, 10, 1)
DEFAULT_WINDOW_DAYS = 90
DEFAULT_MIN_MRR = 1000.0
DEFAULT_TOP_N = 10

# The names of the three revenue filters.
NO_FILTER = "No filter"
MINIMUM_MRR = "Minimum MRR"
TOP_N_ACCOUNTS = "Top N accounts"


@dataclass(frozen=True)
class RunSpec:
    start_date: date | None = None
    end_date: date | None = None
    subcategories: tuple[str, ...] = ()
    account_owners: tuple[str, ...] = ()
    mrr_filter: str = NO_FILTER
    min_mrr: float = 0.0
    top_n: int = 0
    keyword: str = ""

    def __post_init__(self):
        if self.mrr_filter not in (NO_FILTER, MINIMUM_MRR, TOP_N_ACCOUNTS):
            raise ValueError(f"unknown revenue filter: {self.mrr_filter!r}")
        object.__setattr__(self, "subcategories", tuple(self.subcategories))
        object.__setattr__(self, "account_owners", tuple(self.account_owners))

    @classmethod
    def last_days(cls, today: date, days: int = DEFAULT_WINDOW_DAYS, **fields) -> RunSpec:
        """The default window, never before the first day with data."""
        start = max(today - timedelta(days=days), DATA_START)
        return cls(start_date=start, end_date=max(today, DATA_START), **fields)

    def bounded(self) -> RunSpec:
        """The same run with both dates moved to the first day with data, if before it."""
        fields = dict(self.__dict__)
        for name in ("start_date", "end_date"):
            if fields[name] is not None:
                fields[name] = max(fields[name], DATA_START)
        return RunSpec(**fields)
