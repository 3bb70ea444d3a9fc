"""Missing values as gaps instead of null rows.

A run is a stretch of rows of one variable that all have a value, `(file_id, table, id,
first, last, n)`; what lies between runs is a gap. Counts of values, variables without any
and the rows that are missing follow from runs, of which there are as many as there are
interruptions, whatever the number of steps. Null rows are made only where they are asked
for, and only those.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlark.dataset import Dataset

_ID = ("file_id", "table", "id")


def reported(ds: Dataset) -> Dataset:
    """Only the values that there are: what a file of results itself reports."""
    return replace(ds, results=ds.results.where("value is not null"))


def places(steps: DataFrame) -> DataFrame:
    """`(file_id, table, row_ix, ts, place)`: rows of each table counted from 0, so that
    neighbours differ by one whatever their own numbers. A row a step, of no variable."""
    order = Window.partitionBy("file_id", "table").orderBy("row_ix")
    return steps.select("file_id", "table", "row_ix", "ts", (F.row_number().over(order) - 1).cast("long").alias("place"))


def runs(ds: Dataset) -> DataFrame:
    """Runs of `results`, by places; nulls are gaps, as are rows that aren't there. A
    variable without values has no run. A row that repeats counts once."""
    at = places(ds.steps).select("file_id", "table", "row_ix", "place")
    have = ds.results.where("value is not null").select(*_ID, "row_ix").join(at, ["file_id", "table", "row_ix"]).select(*_ID, "place").distinct()
    # within a run, place and rank grow alike
    rank = F.row_number().over(Window.partitionBy(*_ID).orderBy("place"))
    return have.withColumn("__run", F.col("place") - rank).groupBy(*_ID, "__run").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("n")).drop("__run")


def counts(runs: DataFrame) -> DataFrame:
    """`(file_id, table, id, n_values, n_runs)` of variables that have a value."""
    return runs.groupBy(*_ID).agg(F.sum("n").alias("n_values"), F.count("*").alias("n_runs"))


def gaps(ds: Dataset, runs: DataFrame) -> DataFrame:
    """`(file_id, table, id, first, last)`: the stretches without a value of each variable
    of the header, before, between and after its runs; all rows, where it has none."""
    ends = ds.steps.groupBy("file_id", "table").agg(F.count("*").alias("n_steps"))  # a row a table
    # a stretch begins behind each run, and at the start; it ends before the next run
    start = ds.variables.select(*_ID, F.lit(-1).cast("long").alias("first"), F.lit(-1).cast("long").alias("last"))
    every = runs.select(*_ID, "first", "last").unionByName(start)
    after = F.lead("first").over(Window.partitionBy(*_ID).orderBy("last"))
    between = every.withColumn("next", after).join(ends, ["file_id", "table"])
    return between.select(*_ID, (F.col("last") + 1).alias("first"), (F.coalesce("next", "n_steps") - 1).alias("last")).where("first <= last")


def filled(ds: Dataset, runs: DataFrame) -> DataFrame:
    """A row for each variable and step, as `fetch.filled` gives it: the values that there
    are, and a null row for each place of a gap. Only the null rows meet the steps."""
    known = ds.results.where("value is not null").select(*_ID, "row_ix", "ts", "value")
    lacking = gaps(ds, runs)
    lacking = lacking.select(*_ID, F.explode(F.sequence("first", "last")).alias("place"))
    nulls = lacking.join(places(ds.steps), ["file_id", "table", "place"]).select(*_ID, "row_ix", "ts", F.lit(None).cast("double").alias("value"))
    return known.unionByName(nulls)


def without_empty(ds: Dataset, runs: DataFrame) -> Dataset:
    """As `lookup.without_empty`, from runs and texts; values are not read for it, and rows
    that are left are the reported ones."""
    texts = ds.texts.where("value is not null").select(*_ID).distinct()
    live = runs.select(*_ID).distinct().unionByName(texts).distinct()
    keep = lambda df: df.join(live, list(_ID), "left_semi")
    return replace(reported(ds), variables=keep(ds.variables), texts=keep(ds.texts), peaks=keep(ds.peaks))
