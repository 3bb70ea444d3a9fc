"""Time stamps, years and day counts of interval tables."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlark.model import INTERVALS, LeapYearMismatch, StartDayMismatch

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
DESIGN_DAY_YEAR = 2002


def interval_stamp(year: Column, month: Column, day: Column, hour: Column, end_minute: Column) -> Column:
    """Stamp of an interval's end: hours 1 to 24 with the minute in which it ends.
    24:60 is midnight of the next day, h:60 is h:00, hour 0 keeps its minute, and
    h:m otherwise lies in the hour before."""
    base = F.make_timestamp_ntz(year, month, day, F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"))
    minutes = F.when(hour == 0, end_minute).when(end_minute == 60, hour * 60).otherwise((hour - 1) * 60 + end_minute)
    return base + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"), F.lit(0).cast("decimal(18,6)"))


def database_stamp(year: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
    """Stamp of a database row: hour 24 is the next day's midnight; no or a zero
    year is 2002."""
    y = F.when(year.isNull() | (year == 0), F.lit(DESIGN_DAY_YEAR)).otherwise(year)
    base = F.make_timestamp_ntz(y, month, day, F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"))
    return base + F.make_dt_interval(F.lit(0), hour.cast("int"), minute.cast("int"), F.lit(0).cast("decimal(18,6)"))


def occurrence_stamp(step_ts: Column, month: Column, day: Column, hour: Column, end_minute: Column) -> Column:
    """When a peak occurred; month and day are the step's where not given."""
    return interval_stamp(F.year(step_ts), F.coalesce(month, F.month(step_ts)), F.coalesce(day, F.dayofmonth(step_ts)), hour, end_minute)


def wrapped_year(df: DataFrame, first_year: Column | int, by: list[str], order: str, coarse: Column | None = None) -> DataFrame:
    """Adds `year`: one more whenever a step does not come after the step before.
    `coarse` marks rows (time steps) that compare months and days only."""
    w = Window.partitionBy(*by).orderBy(order)
    full = F.struct("month", "day", "hour", "end_minute")
    before = F.lag(full).over(w)
    date, date_before = F.struct("month", "day"), F.lag(F.struct("month", "day")).over(w)
    back = F.when(before.isNull(), False).otherwise(full <= before)
    if coarse is not None:
        back = F.when(coarse, F.when(before.isNull(), False).otherwise(date < date_before)).otherwise(back)
    first = F.lit(first_year) if isinstance(first_year, int) else first_year
    return df.withColumn("__back", back.cast("int")).withColumn("year", first + F.sum("__back").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__back")


def days_between(cumulative: Column, order: Window) -> Column:
    """Days of each month from days counted up to its end."""
    return cumulative - F.coalesce(F.lag(cumulative).over(order), F.lit(0))


def days_of_year(ts: Column) -> Column:
    return F.dayofyear(F.make_date(F.year(ts), F.lit(12), F.lit(31)))


def annual_days(ts: Column, cumulative: Column, by: list[str]) -> Column:
    """Whole days a year of a count of days that runs over years, in each of `by`."""
    return F.floor(cumulative / (F.year(ts) - F.min(F.year(ts)).over(Window.partitionBy(*by)) + 1))


def n_days(table: Column, ts: Column, cumulative: Column, order: Window) -> Column:
    return F.when(table == "monthly", days_between(cumulative, order)).when(table == "annual", days_of_year(ts)).when(table == "runperiod", cumulative).cast("int")


def lowest_interval(tables: set[str]) -> str | None:
    return next((t for t in INTERVALS if t in tables), None)


def first_stamp_fixed(steps: DataFrame) -> DataFrame:
    """First stamps of monthly, annual and runperiod tables become midnight of
    the first stamp of the finest table present (of those up to monthly)."""
    fine = F.when(F.col("table") == "timestep", 0).when(F.col("table") == "hourly", 1).when(F.col("table") == "daily", 2).when(F.col("table") == "monthly", 3)
    first = steps.where(F.col("table").isin("timestep", "hourly", "daily", "monthly")).groupBy("file_id", "table").agg(F.min("ts").alias("ts")).groupBy("file_id").agg(F.min_by("ts", fine).alias("__first"))
    w = Window.partitionBy("file_id", "table").orderBy("row_ix")
    late = F.col("table").isin("monthly", "annual", "runperiod") & (F.row_number().over(w) == 1) & F.col("__first").isNotNull()
    return steps.join(first, "file_id", "left").withColumn("ts", F.when(late, F.date_trunc("day", F.col("__first")).cast("timestamp_ntz")).otherwise(F.col("ts"))).drop("__first")


def weekday(year: int, month: int, day: int) -> str:
    return WEEKDAYS[dt.date(year, month, day).weekday()]


def _fits(year: int, month: int, day: int, start_day: str | None, leap: bool) -> bool:
    if leap != calendar.isleap(year) or (month, day) == (2, 29) and not calendar.isleap(year):
        return False
    return start_day not in WEEKDAYS or weekday(year, month, day) == start_day


def allowed_years(month: int, day: int, start_day: str | None, leap: bool, most: int = 3, from_year: int = 2020) -> list[int]:
    out = []
    for year in range(from_year, 0, -1):
        if _fits(year, month, day, start_day, leap):
            out.append(year)
            if len(out) == most:
                break
    return out


def seek_year(month: int, day: int, start_day: str | None, leap: bool, from_year: int = 2020) -> int:
    """The latest year up to `from_year` in which the first date is such a
    weekday; a day type that is no weekday (design days) means 2002."""
    if start_day is not None and start_day not in WEEKDAYS:
        return DESIGN_DAY_YEAR
    found = allowed_years(month, day, start_day, leap, 1, from_year)
    if not found:
        raise ValueError(f"no year up to {from_year} fits {month}-{day} on a {start_day}")
    return found[0]


def validate_year(year: int, month: int, day: int, start_day: str | None, leap: bool) -> None:
    """Raises if the year's length or its first weekday doesn't fit the data."""
    if calendar.isleap(year) != leap:
        raise LeapYearMismatch(f"{year} is {'' if calendar.isleap(year) else 'no '}leap year; possible: {allowed_years(month, day, start_day, leap)}")
    if start_day in WEEKDAYS and weekday(year, month, day) != start_day:
        raise StartDayMismatch(f"{year}-{month}-{day} is a {weekday(year, month, day)}, not a {start_day}; possible: {allowed_years(month, day, start_day, leap)}")
