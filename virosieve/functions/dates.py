"""Dates: free-text collection dates, interval midpoints and date bins, as column expressions."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

DEFAULT_MAX_SPAN_DAYS = 366


# One side of a collection date: year, optional month, optional day, and a time that is ignored.
_SIDE = (
    r"^0*([1-9][0-9]{0,3})(?:-0*(1[0-2]|[1-9])(?:-0*([12][0-9]|3[01]|[1-9]))?)?(?:[T ][\s\S]*)?\z"
)


def _boundary(side: Column, is_end: bool) -> Column:
    """First or last day that one side of a collection date can mean."""
    year, month, day = (F.regexp_extract(side, _SIDE, i) for i in (1, 2, 3))
    month = F.when(month != "", month).otherwise("12" if is_end else "1")
    given_day = F.when(day != "", day).otherwise("1")
    date = F.concat_ws("-", F.lpad(year, 4, "0"), month, given_day).try_cast("date")
    if is_end:
        date = F.when(day == "", F.last_day(date)).otherwise(date)
    return F.when(year != "", date)


def collection_window(text: Column) -> Column:
    """Collection date text to ``struct<start, end>``; a null struct when it cannot be read.

    Accepts ``YYYY``, ``YYYY-MM``, ``YYYY-MM-DD``, each with a time part that is ignored, and a range
    ``a/b`` of these. A missing month or day opens the window to the whole year or month.
    """
    first = F.split_part(text, F.lit("/"), F.lit(1))
    last = F.when(text.contains("/"), F.split_part(text, F.lit("/"), F.lit(2))).otherwise(text)
    start, end = _boundary(first, is_end=False), _boundary(last, is_end=True)
    readable = text.rlike(r"^[^/]*(/[^/]*)?\z") & start.isNotNull() & end.isNotNull()
    return F.when(readable, F.struct(start.alias("start"), end.alias("end")))


def mid_collection_date(start="collection_start_date", end="collection_end_date") -> Column:
    """Middle of the collection interval; an odd span rounds towards the start."""
    start, end = _col(start), _col(end)
    return F.date_add(start, (F.datediff(end, start) / 2).cast("int"))


def max_span_filter(max_span_days: int = DEFAULT_MAX_SPAN_DAYS) -> Column:
    """Keeps intervals of at most this many days; rows without dates drop out."""
    return F.datediff("collection_end_date", "collection_start_date") <= max_span_days


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


@dataclass(frozen=True)
class DateBin:
    """A grouping of dates.

    ``month`` and ``week`` give ``year, chunk``: the calendar year with the month or the ISO week
    number. Days around New Year therefore show the calendar year next to an ISO week of the
    neighbouring year; ``iso_week`` gives the ISO year instead. ``day`` gives ``bin_start,
    bin_end``, tumbling bins of ``days`` days counted from ``origin`` (today when not given).
    """

    unit: str
    days: int = 1
    origin: dt.date | None = None

    def __post_init__(self):
        if self.unit not in ("month", "week", "iso_week", "day"):
            raise ValueError(f"unknown date bin: {self.unit}")
        if self.days < 1:
            raise ValueError("a bin needs at least one day")

    @property
    def names(self) -> list[str]:
        return ["bin_start", "bin_end"] if self.unit == "day" else ["year", "chunk"]

    @property
    def order(self) -> list[str]:
        return ["bin_start"] if self.unit == "day" else ["year", "chunk"]

    def group_columns(self, extra=(), prefix=()) -> list[str]:
        return [*prefix, *self.names, *extra]

    def columns(self, date) -> list[Column]:
        date = _col(date)
        if self.unit == "month":
            return [F.year(date).alias("year"), F.month(date).alias("chunk")]
        if self.unit == "week":
            return [F.year(date).alias("year"), F.weekofyear(date).alias("chunk")]
        if self.unit == "iso_week":
            return [F.extract(F.lit("YEAROFWEEK"), date).alias("year"), F.weekofyear(date).alias("chunk")]
        origin = F.current_date() if self.origin is None else F.lit(self.origin)
        start = F.date_add(origin, (F.floor(F.datediff(date, origin) / self.days) * self.days).cast("int"))
        return [start.alias("bin_start"), F.date_add(start, self.days).alias("bin_end")]

    def label(self) -> Column:
        """``2024-05``, ``2024-W05`` or ``2024-05-01/2024-05-08`` for a binned row."""
        if self.unit == "day":
            return F.concat(F.col("bin_start").cast("string"), F.lit("/"), F.col("bin_end").cast("string"))
        mark = "" if self.unit == "month" else "W"
        text = F.concat(
            F.col("year").cast("string"), F.lit(f"-{mark}"), F.lpad(F.col("chunk").cast("string"), 2, "0")
        )
        return text

    def labelled(self, df):
        """Put the label in front of a binned result."""
        return df.select(self.label().alias("label"), "*")


MONTH = DateBin("month")
WEEK = DateBin("week")


def every(days: int, origin: dt.date | None = None) -> DateBin:
    return DateBin("day", days, origin)
