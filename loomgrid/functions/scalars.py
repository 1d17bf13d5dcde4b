"""Column expressions shared by the operators."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def no_nan(c: Column) -> Column:
    """Missing readings are null, never NaN (NaN compares as largest in Spark)."""
    return F.when(~F.isnan(c), c)


def is_finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(INF)), F.lit(False))


def finite_or_null(c: Column) -> Column:
    return F.when(is_finite(c), c)


def flag(c: Column) -> Column:
    """A mask: unknown counts as not flagged."""
    return F.coalesce(c, F.lit(False))


def text_or_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def close(a: Column, b: Column, rtol: float = 1e-10, atol: float = 1e-12) -> Column:
    """Equal within a tolerance relative to b; nulls are equal to nulls only."""
    near = F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
    return a.eqNullSafe(b) | flag(near)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def hours_between(later: Column, earlier: Column) -> Column:
    """Whole and part hours between two wall-clock timestamps."""
    return F.timestamp_diff("SECOND", earlier, later) / 3600


def plus_hours(ts: Column, hours: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), hours.cast("int"))


def hour_of_week(ts: Column) -> Column:
    return F.weekday(ts) * 24 + F.hour(ts)


def season(ts: Column) -> Column:
    m = F.month(ts)
    return (
        F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring")
        .when(m.isin(6, 7, 8), "summer").when(m.isin(9, 10, 11), "autumn").otherwise("unknown")
    )


def quarter_label(ts: Column) -> Column:
    return F.concat(F.year(ts), F.lit("Q"), F.quarter(ts))


def week_block(building: Column, ts: Column) -> Column:
    """Entity and ISO week, the block of the block bootstrap."""
    week = F.lpad(F.extract(F.lit("WEEK"), ts).cast("string"), 2, "0")
    return F.concat(building, F.lit("|"), F.extract(F.lit("YEAROFWEEK"), ts), F.lit("-W"), week)


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = 2 * F.pi() * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def federal_holidays(first_year: int, last_year: int) -> list[date]:
    """Observed US federal holidays: fixed dates on a weekend move to the nearest workday."""
    out = []
    for y in range(first_year, last_year + 1):
        fixed = [date(y, 1, 1), date(y, 7, 4), date(y, 11, 11), date(y, 12, 25)]
        if y >= 2021:
            fixed.append(date(y, 6, 19))
        for d in fixed:
            out.append(d + timedelta({5: -1, 6: 1}.get(d.weekday(), 0)))
        out += [_nth(y, 1, 0, 3)] if y >= 1986 else []
        out += [_nth(y, 2, 0, 3), _nth(y, 5, 0, -1), _nth(y, 9, 0, 1), _nth(y, 10, 0, 2), _nth(y, 11, 3, 4)]
    return sorted(set(out))


def is_federal_holiday(ts: Column, first_year: int, last_year: int) -> Column:
    """Membership in the list of observed holidays; eleven literals a year."""
    days = [F.lit(d) for d in federal_holidays(first_year - 1, last_year + 1)]
    return F.to_date(ts).isin(*days)
