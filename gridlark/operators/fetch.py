"""Reading values: slices, selections in order, peaks, specials, weekdays."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.dataset import Dataset

Stamp = dt.datetime | str | None


def sliced(df: DataFrame, start: Stamp = None, end: Stamp = None) -> DataFrame:
    """Rows from start to end, both included; either may be left out."""
    if start is not None:
        df = df.where(F.col("ts") >= F.lit(str(start)).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col("ts") <= F.lit(str(end)).cast("timestamp_ntz"))
    return df


def values(ds: Dataset, table: str, ids: Sequence[int] | None = None, start: Stamp = None, end: Stamp = None, ordered: bool = True) -> DataFrame:
    """Long rows `(file_id, table, id, key, type, units, row_ix, ts, value)` and
    `ord`, the place of the id among those asked for."""
    rows = sliced(ds.results.where(F.col("table") == table), start, end)
    head = ds.variables.where(F.col("table") == table)
    if ids is not None:
        rows, head = rows.where(F.col("id").isin(list(ids))), head.where(F.col("id").isin(list(ids)))
    head = head.select("file_id", "id", "key", "type", "units", "pos")
    out = rows.join(ds.with_size(head), ["file_id", "id"])
    if ids is not None and ordered:
        return out.withColumn("ord", F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("id")).cast("int") - 1).drop("pos")
    return out.withColumnRenamed("pos", "ord")


def global_peak(df: DataFrame, largest: bool = True, by: Sequence[str] = ("file_id", "table", "id")) -> DataFrame:
    """Largest or smallest value of each variable, the stamp of its first occurrence and
    its row; a variable without values keeps a row of nulls."""
    micros = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.col("row_ix"))
    value = F.nanvl("value", F.lit(None).cast("double"))
    if largest:
        key = F.when(value.isNotNull(), F.struct(value.alias("v"), (-micros).alias("m")))
        pair = (F.max(value).alias("value"), F.max_by(F.struct("ts", "row_ix"), key).alias("at"))
    else:
        key = F.when(value.isNotNull(), F.struct(value.alias("v"), micros.alias("m")))
        pair = (F.min(value).alias("value"), F.min_by(F.struct("ts", "row_ix"), key).alias("at"))
    return df.groupBy(*by).agg(*pair).select(*by, "value", F.col("at.ts").alias("ts"), F.col("at.row_ix").alias("peak_row"))


def local_peaks(ds: Dataset, table: str, ids: Sequence[int] | None, largest: bool, start: Stamp = None, end: Stamp = None) -> DataFrame:
    """Peaks reported for each step: `(file_id, table, id, row stamp, value, peak stamp)`."""
    rows = sliced(ds.peaks.where(F.col("table") == table), start, end)
    if ids is not None:
        rows = rows.where(F.col("id").isin(list(ids)))
    side = "max" if largest else "min"
    return rows.select("file_id", "table", "id", "ts", F.col(f"{side}_value").alias("value"), F.col(f"{side}_ts").alias("peak_ts"))


def filled(ds: Dataset, table: str) -> DataFrame:
    """A row for each variable and step of a table, null where there is no value."""
    steps = ds.steps.where(F.col("table") == table).select("file_id", "table", "row_ix", "ts")
    head = ds.variables.where(F.col("table") == table).select("file_id", "table", "id")
    grid = steps.join(ds.with_size(head), ["file_id", "table"])
    rows = ds.results.where(F.col("table") == table).select("file_id", "table", "id", "row_ix", "value")
    return grid.join(rows, ["file_id", "table", "id", "row_ix"], "left").select("file_id", "table", "id", "row_ix", "ts", "value")


def weekday(ts: Column, day: Column | None = None) -> Column:
    """The stored day type, or else the weekday's name."""
    name = F.date_format(ts.cast("timestamp"), "EEEE")
    return name if day is None else F.coalesce(day, name)


def with_day(ds: Dataset, df: DataFrame) -> DataFrame:
    day = ds.steps.select("file_id", "table", "row_ix", F.col("day").alias("__day"))
    return df.join(day, ["file_id", "table", "row_ix"], "left").withColumn("day", weekday(F.col("ts"), F.col("__day"))).drop("__day")


def with_n_days(ds: Dataset, df: DataFrame) -> DataFrame:
    return df.join(ds.steps.select("file_id", "table", "row_ix", "n_days"), ["file_id", "table", "row_ix"], "left")


def range_index(df: DataFrame, label: str = "label", order: str = "row_ix", by: Sequence[str] = ("file_id", "table")) -> DataFrame:
    """Whether the labels of a table are a range: whole numbers, more than one,
    with one step: `(start, stop, step, is_range)`."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by).orderBy(order)
    number = F.expr(f"try_cast({label} as bigint)")
    rows = df.withColumn("__v", number).withColumn("__d", F.col("__v") - F.lag("__v").over(w))
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count("__v").alias("whole"), F.min_by("__v", order).alias("start"), F.max_by("__v", order).alias("last"), F.min("__d").alias("lo"), F.max("__d").alias("hi"))
    ok = (F.col("n") > 1) & (F.col("whole") == F.col("n")) & (F.col("lo") == F.col("hi")) & (F.col("lo") != 0)
    return out.select(*by, "start", (F.col("last") + F.col("lo")).alias("stop"), F.col("lo").alias("step"), F.coalesce(ok, F.lit(False)).alias("is_range"))
