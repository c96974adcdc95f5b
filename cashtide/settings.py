"""Run parameters. Nothing here reads the clock: ``as_of`` is always passed in."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta


@dataclass(frozen=True)
class Settings:
    """Everything a run depends on apart from its data."""

    as_of: date
    series_start: date = date(2020, 8, 1)
    disruption_end: date = date(2021, 11, 1)  # first month after the disrupted opening period
    season: int = 12
    short_horizon: int = 12
    long_horizon: int = 24
    min_train: int = 24
    cv_windows: int = 8
    cv_step: int = 3
    most_outliers: int = 5  # a series; beyond it only flags among its largest values count
    home_currency: str = "aud"
    streams: tuple[str, ...] = ("league", "recurring", "one_time")

    @property
    def last_complete_month(self) -> date:
        """Start of the month before the one ``as_of`` lies in."""
        return (self.as_of.replace(day=1) - timedelta(days=1)).replace(day=1)
