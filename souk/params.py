"""Settings shared by every model."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    """Build settings.

    ``as_of_date`` stands in for "today" in tenure columns and ``loaded_at`` for the
    load timestamp; leave them unset to take the clock at run time.
    An incremental run takes every order that is new or has changed. With ``lookback_days``
    it takes only orders dated after the newest loaded one, less so many days; 0 is the strict
    rule that ignores same-day and late arrivals.
    """

    as_of_date: date | None = None
    loaded_at: datetime | None = None
    return_window_days: int = 30
    lookback_days: int | None = None
    approx_median: bool = False

    def today(self) -> Column:
        return F.current_date() if self.as_of_date is None else F.lit(self.as_of_date)

    def load_time(self) -> Column:
        if self.loaded_at is None:
            return F.localtimestamp()
        return F.lit(self.loaded_at.isoformat(sep=" ")).cast("timestamp_ntz")
