"""Months, ISO weeks and returns as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_key(date: Column | str) -> Column:
    """yyyy-MM, which sorts as the calendar does."""
    return F.date_format(date, "yyyy-MM")


def week_key(date: Column | str) -> Column:
    """ISO year and week, as 2020-53 for 2021-01-01."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), col(date)).cast("string"), F.lit("-"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))


def week_start(date: Column | str) -> Column:
    """The Monday of a date's ISO week: groups and sorts as week_key does, without text."""
    return F.trunc(date, "week")


def month_id(month: Column | str) -> Column:
    """Months since year 0 of a yyyy-MM key."""
    return F.substring(col(month), 1, 4).cast("int") * 12 + F.substring(col(month), 6, 2).cast("int")


def month_gap(earlier: Column | str, later: Column | str) -> Column:
    """Months strictly between two keys."""
    return month_id(later) - month_id(earlier) - 1


def months_between(lo: Column, hi: Column) -> Column:
    """All yyyy-MM keys from one to the other, as an array."""
    first = lambda c: F.to_date(F.concat(c, F.lit("-01")))
    return F.transform(F.sequence(first(lo), first(hi), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))


def month_of_number(yyyymm: Column | str) -> Column:
    """yyyy-MM of a number or text such as 196201; null where it isn't of that form."""
    text = col(yyyymm).cast("string")
    return F.when(text.rlike("^[0-9]{6}$"), F.concat(F.substring(text, 1, 4), F.lit("-"), F.substring(text, 5, 2)))


def plain_number(text: Column | str) -> Column:
    """A number written with commas between thousands; null where it is none."""
    return F.regexp_replace(col(text).cast("string"), ",", "").try_cast("double")


def percent_return(later: Column, earlier: Column, digits: int | None = None) -> Column:
    """Percent change; null where the earlier value is null or 0."""
    out = (later - earlier) / F.nullif(earlier, F.lit(0.0)) * 100
    return out if digits is None else F.bround(out, digits)


def calendar_weeks(bounds: DataFrame) -> DataFrame:
    """(first, last) dates, one row -> (month, week): ISO weeks with a day in the month."""
    days = bounds.select(F.explode(F.sequence("first", "last")).alias("date"))
    return days.select(month_key("date").alias("month"), week_key("date").alias("week")).distinct()


def close_enough(a: Column, b: Column, atol: float = 1e-8, rtol: float = 1e-5) -> Column:
    """Whether two numbers agree within tolerance; nulls agree with each other."""
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b), F.lit(False))


def compare_lists(a: Column, b: Column) -> Column:
    """Struct of what only a has, only b has and both have."""
    return F.struct(F.array_except(a, b).alias("left_only"), F.array_except(b, a).alias("right_only"), F.array_intersect(a, b).alias("both"))


def arrays_equal(a: Column | str, b: Column | str) -> Column:
    """Aggregate: whether two columns hold the same values row by row, nulls agreeing; true of no rows."""
    return F.coalesce(F.bool_and(col(a).eqNullSafe(col(b))), F.lit(True))
