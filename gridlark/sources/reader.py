"""Loading a results file by its suffix."""

from __future__ import annotations

import contextlib
import os

from pyspark.sql import SparkSession

from gridlark.dataset import Dataset
from gridlark.model import FormatNotSupported, MultiEnvFileRequired
from gridlark.operators import derive
from gridlark.sources import eso, sheet, sqlite, store
from gridlark.sources.progress import StatusTracker

SUFFIXES = (".eso", ".sql", ".xlsx", ".csv", ".cff")


def load_all(spark: SparkSession, path: str, **options) -> list[Dataset]:
    """A Dataset of each environment of a simulation's file."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".eso":
        return eso.read_eso(spark, path, **options)
    if suffix == ".sql":
        options.pop("year", None)
        options.pop("ignore_peaks", None)
        return sqlite.read_sqlite(spark, path, **options)
    raise FormatNotSupported(f"{suffix} is no simulation's format")


def load(spark: SparkSession, path: str, tracker: StatusTracker | None = None, **options) -> Dataset:
    """A Dataset of one file; several environments need `load_all`. A tracker is told of
    the sections of the work and of Spark's tasks."""
    task = (tracker or StatusTracker("load")).task(f"load {os.path.basename(path)}")
    with task, tracker.watching(spark) if tracker else contextlib.nullcontext():
        return _load(spark, path, tracker, **options)


def _load(spark: SparkSession, path: str, tracker: StatusTracker | None, **options) -> Dataset:
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".eso":
        options["tracker"] = tracker
    if suffix in (".eso", ".sql"):
        found = load_all(spark, path, **options)
        if len(found) != 1:
            raise MultiEnvFileRequired(f"{path} has {len(found)} environments")
        return found[0]
    if suffix == ".xlsx":
        return sheet.read_excel(spark, path, **options)
    if suffix == ".csv":
        return sheet.read_csv(spark, path, **options)
    if suffix == ".cff":
        return store.load_file(spark, path)
    raise FormatNotSupported(f"{suffix} is none of {SUFFIXES}")


def from_totals(ds: Dataset) -> Dataset:
    return derive.totals(ds)


def from_diff(a: Dataset, b: Dataset) -> Dataset:
    from pyspark.sql import functions as F

    number = lambda d, i: Dataset(*(df.withColumn("file_id", F.lit(i)) for df in (d.files, d.variables, d.steps, d.results, d.texts, d.peaks)))
    return derive.diff(number(a, 1).union(number(b, 2)), 1, 2)
