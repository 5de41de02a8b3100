"""Time buckets and numeric bands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from tallyglass.functions import fixed

UNITS = ("day", "week", "month", "quarter", "year")


def time_bucket(column: Column | str, unit: str) -> Column:
    """First day of the day, week (Monday), month, quarter or year a moment falls in."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}, not {unit!r}")
    source = F.col(column) if isinstance(column, str) else column
    return F.date_trunc(unit, source).cast("date")


def month_key(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM")


def year_key(column: Column | str) -> Column:
    return F.date_format(column, "yyyy")


@dataclass(frozen=True)
class Bands:
    """Equal-width integer bands: `lo` is the start of band 0."""

    lo: int
    width: int

    @staticmethod
    def between(lowest: float, highest: float, bands: int = fixed.BANDS) -> "Bands | None":
        if highest <= lowest:
            return None
        return Bands(lo=int(lowest), width=max(1, round((highest - lowest) / bands)))

    def index(self, column: Column) -> Column:
        return ((column.cast("double") - self.lo) / self.width).cast("bigint")

    def label(self, index: Column) -> Column:
        start = index * self.width + self.lo
        return F.concat(
            start.cast("string"), F.lit("–"), (start + (self.width - 1)).cast("string")
        )
