"""Scalar expressions shared by the operators.

Two rounding rules are in use. Reports that follow dataframe-library semantics
round half to even on doubles (:func:`half_even`) and drop NULL group keys.
Reports that follow SQL semantics round half up on decimals (:func:`half_up`)
and keep a NULL group.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendtrace.schemas import CREDITS, NON_VERIFIED, REQUEST_CREDITS, VERIFIED, VERIFIED_PATH

Moment = str | dt.date | dt.datetime


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def credits(c: Column | str) -> Column:
    return col(c).cast(CREDITS)


def sum_credits(c: Column | str) -> Column:
    return F.sum(credits(c))


def sum_totals(c: Column | str) -> Column:
    """Sum of credits that are sums themselves, and so may exceed what one row can hold."""
    return F.sum(col(c).cast("decimal(38,9)"))


def dbl(c: Column | str) -> Column:
    return col(c).cast("double")


def half_even(c: Column | str, digits: int = 2) -> Column:
    scale = float(10**digits)
    return F.rint(dbl(c) * F.lit(scale)) / F.lit(scale)


def half_up(c: Column | str, digits: int = 2) -> Column:
    """SQL rounding. Give it a decimal: doubles near a tie depend on the engine."""
    return dbl(F.round(col(c), digits))


def divide(numerator: Column | str, denominator: Column | str) -> Column:
    """Double quotient, NULL where the denominator is 0 or NULL."""
    return F.try_divide(dbl(numerator), dbl(denominator))


def decimal_divide(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient of two decimals, exact far beyond the digits that get rounded."""
    return F.try_divide(
        col(numerator).cast("decimal(30,9)"), col(denominator).cast("decimal(30,9)")
    )


def percent_half_even(part: Column | str, whole: Column | str) -> Column:
    return half_even(divide(dbl(part) * F.lit(100.0), whole), 2)


def percent_half_up(part: Column | str, whole: Column | str) -> Column:
    scaled = col(part).cast("decimal(30,9)") * F.lit(Decimal(100))
    return half_up(F.try_divide(scaled, col(whole).cast("decimal(30,9)")), 2)


def query_type(path: Column | str, verified_path: str = VERIFIED_PATH) -> Column:
    return F.when(col(path).eqNullSafe(F.lit(verified_path)), F.lit(VERIFIED)).otherwise(
        F.lit(NON_VERIFIED)
    )


def request_credits(price: Decimal = REQUEST_CREDITS) -> Column:
    return F.lit(price).cast("double")


def ms_to_s(c: Column | str, digits: int | None = None) -> Column:
    seconds = dbl(c) / F.lit(1000.0)
    return seconds if digits is None else half_even(seconds, digits)


def total_latency(generation: Column | str, execution: Column | str) -> Column:
    """Report path: a missing part counts as 0."""
    zero = F.lit(0)
    return F.coalesce(col(generation), zero) + F.coalesce(col(execution), zero)


def total_time(execution: Column | str, generation: Column | str) -> Column:
    """Cost path: NULL if either part is NULL."""
    return col(execution) + col(generation)


def combined_credits(compute: Column | str, request: Column | str) -> Column:
    return dbl(credits(compute) + credits(request))


def moment(value: Moment | Column) -> Column:
    """Foldable NTZ timestamp, so comparisons with it reach the file scan."""
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime):
        value = value.replace(tzinfo=None).isoformat(sep=" ")
    elif isinstance(value, dt.date):
        value = f"{value.isoformat()} 00:00:00"
    return F.lit(value).cast("timestamp_ntz")


def as_date(value: Moment) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    return value if isinstance(value, dt.date) else dt.datetime.fromisoformat(value).date()


def as_datetime(value: Moment) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, dt.date):
        return dt.datetime.combine(value, dt.time())
    return dt.datetime.fromisoformat(value)


def up_to(c: Column | str, as_of: Moment) -> Column:
    """Not after ``as_of``: its whole day where it is a date, the instant where it has a time of day."""
    at = as_datetime(as_of)
    whole_day = not isinstance(as_of, dt.datetime) and (isinstance(as_of, dt.date) or len(as_of.strip()) <= 10)
    return col(c) < moment(at + dt.timedelta(days=1)) if whole_day else col(c) <= moment(at)


def days_before(as_of: Moment, days: int) -> dt.datetime:
    return as_datetime(as_of) - dt.timedelta(days=days)


PRESET_DAYS = (7, 14, 30, 60, 90, 365)


def last_days(days: int, as_of: Moment) -> tuple[dt.datetime, dt.datetime]:
    """(start, end) for a look-back window; the end is the last instant of the day."""
    end = dt.datetime.combine(as_date(as_of), dt.time.max)
    start = dt.datetime.combine(as_date(as_of) - dt.timedelta(days=days), dt.time())
    return start, end


def within(c: Column | str, start: Moment, end: Moment) -> Column:
    """Inclusive at both ends."""
    return col(c).between(moment(start), moment(end))


def day(c: Column | str) -> Column:
    return F.to_date(col(c))


PERIODS = ("DAY", "WEEK", "MONTH")


def period_start(period: str | Column, as_of: Moment) -> Column:
    """First day of the billing period that holds ``as_of``; weeks start on Monday."""
    today = F.lit(as_date(as_of))
    starts = {"DAY": today, "WEEK": F.trunc(today, "week"), "MONTH": F.trunc(today, "month")}
    if isinstance(period, str):
        if period.upper() not in starts:
            raise ValueError(f"invalid billing period {period!r}; use one of {PERIODS}")
        return starts[period.upper()].cast("date")
    name = F.upper(period)
    out = F.when(name == "DAY", starts["DAY"])
    out = out.when(name == "WEEK", starts["WEEK"]).when(name == "MONTH", starts["MONTH"])
    return out.otherwise(
        F.raise_error(F.concat(F.lit("invalid billing period: "), F.coalesce(name, F.lit("NULL")))).cast("date")
    )


def budget_status(used: Column | str, limit: Column | str, warn: float = 0.8) -> Column:
    share = divide(dbl(used) * F.lit(100.0), limit)
    return (
        F.when(dbl(used) >= dbl(limit), F.lit("EXCEEDED"))
        .when(share >= F.lit(warn * 100.0), F.lit("WARNING"))
        .otherwise(F.lit("OK"))
    )
