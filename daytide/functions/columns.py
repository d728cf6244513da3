"""Small column expressions shared by the operators.

Missing values are NULL everywhere: NaN and infinities are turned into NULL where
data enters, because Spark compares NaN as larger than any number and averages
over it.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column | str) -> Column:
    """c as a double, with NaN and +-inf as NULL."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def numeric(c: Column | str) -> Column:
    """c coerced to a double; text that is not a number becomes NULL."""
    x = F.col(c) if isinstance(c, str) else c
    return finite(x.try_cast("double"))


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), None).otherwise(c)


def over_nonzero(num: Column, den: Column) -> Column:
    """num / den, missing where den is 0 or missing."""
    return num / F.nullif(den, F.lit(0.0))


def clip(c: Column, lo: Column, hi: Column) -> Column:
    """c limited to [lo, hi]; a missing c stays missing."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def utc_bounds(start_date: str, end_date: str, offset_hours: int) -> tuple[datetime, datetime]:
    """Local midnights of two ISO dates as naive UTC timestamps [start, end)."""

    def midnight(text: str) -> datetime:
        return datetime.combine(date.fromisoformat(text), datetime.min.time())

    shift = timedelta(hours=offset_hours)
    return midnight(start_date) - shift, midnight(end_date) - shift


def local_timestamp(c: Column, offset_hours: int) -> Column:
    return c + F.make_dt_interval(hours=F.lit(offset_hours))


def second_of_day(c: Column) -> Column:
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def second_steps(start: Column, end: Column) -> Column:
    """Whole-second boundaries crossed from start to end (not elapsed seconds)."""
    days = F.datediff(F.to_date(end), F.to_date(start)).cast("long")
    return days * 86400 + second_of_day(end) - second_of_day(start)


def _text(pattern: str, scale: float = 1.0):
    """Numbers as text, rounded from their exact binary value, halves to even; empty if missing.

    Spark's own formatting rounds the shortest decimal form instead: it prints 0.00375 as
    0.0038, though the double lies below that half. These columns belong to report tables,
    which have a row for each feature, pair or state.
    """

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        return values.map(lambda v: "" if pd.isna(v) else pattern.format(v * scale)).astype(object)

    return text


def fixed4(c: Column) -> Column:
    """Thousands separators and four decimals; empty when missing."""
    return _text("{:,.4f}")(c.cast("double"))


def plain4(c: Column) -> Column:
    return _text("{:.4f}")(c.cast("double"))


def percent2(c: Column) -> Column:
    """A share as a percentage with two decimals; empty when missing."""
    return _text("{:.2f}%", 100.0)(c.cast("double"))


def rounded(c: Column, digits: int) -> Column:
    """A number rounded from its exact binary value, halves to even; for report tables."""
    return F.nullif(_text(f"{{:.{digits}f}}")(c.cast("double")), F.lit("")).cast("double") + F.lit(0.0)
