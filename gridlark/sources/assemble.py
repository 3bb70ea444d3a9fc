"""From raw steps, header and values of one environment to a Dataset."""

from __future__ import annotations

import calendar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlark.dataset import Dataset
from gridlark.functions import timeline as tl
from gridlark.operators.lookup import renamed_duplicates, without_empty

WEEKDAY = list(tl.WEEKDAYS)
SUBMONTHLY = ("timestep", "hourly", "daily")


def is_sizing(steps: DataFrame) -> bool:
    """Whether all day types of an environment are design days."""
    days = [r["day"] for r in steps.where(F.col("table").isin(*SUBMONTHLY)).select("day").distinct().limit(64).collect()]
    return bool(days) and all(d not in WEEKDAY and "Design" in (d or "") for d in days)


def start_year(steps: DataFrame, year: int | None) -> int:
    """The first year of an environment; see the rules in timeline."""
    fine = tl.lowest_interval({r["table"] for r in steps.select("table").distinct().collect()} & set(SUBMONTHLY))
    if fine is None:
        return year if year is not None else tl.DESIGN_DAY_YEAR
    own = steps.where(F.col("table") == fine).withColumn("kind", F.col("day")).withColumn("day", F.col("day_of_month"))
    own = tl.wrapped_year(own, 0, ["table"], "row_ix", F.col("table") == "timestep")
    first = own.orderBy("row_ix").select("month", "day_of_month", "kind").first()
    leaps = {r["year"] for r in own.where("month = 2 and day_of_month = 29").select("year").distinct().collect()}
    return chosen_year(first["month"], first["day_of_month"], first["kind"], leaps, year)


def chosen_year(month: int, day: int, kind: str | None, leaps: set[int], year: int | None) -> int:
    """The first year of an environment that begins on this date and day type. leaps:
    years, counted from the first one, that have a 29th of February."""
    if year is not None:
        tl.validate_year(year, month, day, kind, 0 in leaps)
        return year
    if kind is not None and kind not in WEEKDAY:
        return tl.DESIGN_DAY_YEAR
    if not leaps - {0}:
        return tl.seek_year(month, day, kind, 0 in leaps)
    for y in range(2020, 0, -1):
        if all(calendar.isleap(y + k) for k in leaps) and tl._fits(y, month, day, kind, calendar.isleap(y)):
            return y
    return tl.seek_year(month, day, kind, 0 in leaps)


def stamped(steps: DataFrame, year: int | None) -> DataFrame:
    """Raw steps `(file_id, table, row_ix, month, day_of_month, hour, end_minute, day,
    cumulative, given_year)` with ts and n_days."""
    return dated(steps, start_year(steps, year))


def dated(steps: DataFrame, first: int | Column) -> DataFrame:
    """`stamped` from the first year on, which may differ by file."""
    raw = steps.withColumn("__day", F.col("day")).withColumn("day", F.col("day_of_month"))
    rows = tl.wrapped_year(raw, first, ["file_id", "table"], "row_ix", F.col("table") == "timestep")
    rows = rows.withColumn("year", F.when(F.col("table") == "annual", F.coalesce("given_year", "year")).otherwise(F.col("year")))
    rows = rows.withColumn("ts", tl.interval_stamp(F.col("year"), F.col("month"), F.col("day"), F.col("hour"), F.col("end_minute"))).withColumn("day", F.col("__day"))
    w = Window.partitionBy("file_id", "table").orderBy("row_ix")
    fixed = tl.first_stamp_fixed(rows.select("file_id", "table", "row_ix", "ts", "day", "cumulative"))
    return fixed.withColumn("n_days", tl.n_days(F.col("table"), F.col("ts"), F.col("cumulative"), w)).select("file_id", "table", "row_ix", "ts", F.lit(None).cast("long").alias("range_ix"), F.lit(None).cast("string").alias("label"), "day", "n_days")


def assemble(spark: SparkSession, files: DataFrame, header: DataFrame, steps: DataFrame, values: DataFrame, peaks: DataFrame | None = None, dense: bool = True) -> Dataset:
    """header: VARIABLES without table_pos; steps: stamped; values `(file_id, table,
    id, row_ix, value)`. Every variable gets a row a step, or, not `dense`, only those
    with a value (`gaps` makes the others when they are wanted); all-null ones go."""
    live = steps.select("file_id", "table").distinct()
    header = header.join(live, ["file_id", "table"], "left_semi")
    order = Window.partitionBy("file_id").orderBy("first")
    tables = header.groupBy("file_id", "table").agg(F.min("pos").alias("first")).withColumn("table_pos", F.row_number().over(order) - 1).drop("first")
    variables = renamed_duplicates(header.join(tables, ["file_id", "table"]).select("file_id", "table", "table_pos", "id", "pos", "is_simple", "key", "type", "units"))
    if dense:
        grid = steps.select("file_id", "table", "row_ix", "ts").join(variables.select("file_id", "table", "id"), ["file_id", "table"])
        rows = grid.join(values, ["file_id", "table", "id", "row_ix"], "left")
    else:
        rows = values.join(steps.select("file_id", "table", "row_ix", "ts"), ["file_id", "table", "row_ix"]).where("value is not null and not isnan(value)")
    results = rows.select("file_id", "table", "id", "row_ix", "ts", F.nanvl("value", F.lit(None).cast("double")).alias("value"))
    out = {"files": files, "variables": variables, "steps": steps, "results": results}
    if peaks is not None:
        out["peaks"] = peaks
    return without_empty(Dataset.of(spark, **out))
