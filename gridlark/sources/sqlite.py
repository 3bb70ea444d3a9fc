"""SQLite result databases, read by a partitioned Python data source.

Ranges and lists of whole numbers go into the statements that the readers issue, as do the
columns asked for; where an index begins with a compared column, partitions are made of
the rows that it finds. So some ids of one environment read their rows and no others.

They are options of the source, not filters that Spark hands over: a Python source keeps
what was pushed for one scan for all others of its DataFrame, which then lack rows.
"""

from __future__ import annotations

import datetime as dt
import os
import sqlite3
from collections.abc import Sequence

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from gridlark import model
from gridlark.dataset import Dataset
from gridlark.functions import timeline as tl
from gridlark.sources.assemble import assemble
from gridlark.sources.files import Files

# Columns that are read, and codes of the database.
TABLES = {
    "Time": "TimeIndex int, Year int, Month int, Day int, Hour int, Minute int, Interval int, IntervalType int, SimulationDays int, DayType string, EnvironmentPeriodIndex int, WarmupFlag int",
    "EnvironmentPeriods": "EnvironmentPeriodIndex int, EnvironmentName string, EnvironmentType int",
    "ReportData": "ReportDataIndex long, TimeIndex int, ReportDataDictionaryIndex int, Value double",
    "ReportDataDictionary": "ReportDataDictionaryIndex int, IsMeter int, Type string, KeyValue string, Name string, ReportingFrequency string, Units string",
}
INTERVAL_TYPES = {-1: "timestep", 1: "hourly", 2: "daily", 3: "monthly", 4: "runperiod", 5: "annual"}
FREQUENCIES = {
    "Zone Timestep": "timestep",
    "HVAC System Timestep": "timestep",
    "Hourly": "hourly",
    "Daily": "daily",
    "Monthly": "monthly",
    "Run Period": "runperiod",
    "Annual": "annual",
}


def _local(path: str) -> str:
    """Where a database lies on this machine: the path itself or, of other file systems,
    the copy that Spark has brought to each executor."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return SparkFiles.get(os.path.basename(path)) if "://" in path else path


_MOST = 900  # numbers of one list, below the least limit of a statement


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns, self.path, self.table = schema, options["path"], options["table"]
        self.rows = int(options.get("rows", 1_000_000))
        self.tests: list[tuple[str, str, list[int]]] = []  # column, comparison, numbers
        for column in ("TimeIndex", "ReportDataDictionaryIndex"):
            if span := options.get(f"range.{column}"):
                self.tests.append((column, "between ? and ?", [int(x) for x in span.split(",")]))
            if (some := options.get(f"in.{column}")) is not None:
                values = [int(x) for x in some.split(",") if x]
                if len(values) <= _MOST:  # of more, all rows are read; who asks compares anyway
                    self.tests.append((column, f"in ({', '.join('?' * len(values))})", values))

    def _open(self):
        return sqlite3.connect(f"file:{_local(self.path)}?mode=ro", uri=True)

    def where(self) -> tuple[str, list[int]]:
        """The comparisons as SQL and the numbers in it."""
        return " and ".join(f'"{c}" {test}' for c, test, _ in self.tests), [x for _, _, values in self.tests for x in values]

    def statement(self, part) -> tuple[str, list[int]]:
        """What is asked of the database for a partition."""
        names = ", ".join(f'"{f.name}"' for f in self.columns)
        tests, values = self.where()
        return f'select {names} from "{self.table}" where rowid between ? and ?' + (f" and {tests}" if tests else ""), [part.low, part.high, *values]

    def _bounds(self, db) -> tuple[str, list[int]]:
        """The first and the last row that are of use; without an index that tells, of all."""
        indexed = {row[2] for name in [r[1] for r in db.execute(f'pragma index_list("{self.table}")')] for row in db.execute(f'pragma index_info("{name}")') if row[0] == 0}
        tests, values = self.where()
        use = tests and any(c in indexed for c, _, _ in self.tests)
        return f'select min(rowid), max(rowid) from "{self.table}"' + (f" where {tests}" if use else ""), values if use else []

    def partitions(self):
        with self._open() as db:
            low, high = db.execute(*self._bounds(db)).fetchone()
        if low is None:
            return [_Rows(0, 0)]
        return [_Rows(a, min(a + self.rows - 1, high)) for a in range(low, high + 1, self.rows)]

    def read(self, part):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(self.columns)
        with self._open() as db:
            cursor = db.execute(*self.statement(part))
            while rows := cursor.fetchmany(50_000):
                yield pa.RecordBatch.from_arrays([pa.array([_typed(x, k.type) for x in c], k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def _typed(x, kind):
    if x is None or x == "":
        return None
    return int(x) if pa.types.is_integer(kind) else float(x) if pa.types.is_floating(kind) else str(x)


class SqliteTable(DataSource):
    """`spark.read.format("gridlark_sqlite")` with options path, table, rows (a partition),
    columns (by commas; all if left out), `range.<column>` (first and last number) and
    `in.<column>` (numbers by commas), for TimeIndex and ReportDataDictionaryIndex."""

    @classmethod
    def name(cls):
        return "gridlark_sqlite"

    def schema(self):
        named = self.options.get("columns")
        fields = TABLES[self.options["table"]].split(", ")
        return ", ".join(f for f in fields if named is None or f.split()[0] in named.split(","))

    def reader(self, schema):
        return _Reader(schema, self.options)


def read_sqlite(spark: SparkSession, path: str, warmup: bool = True, environments: Sequence[str] | None = None, ids: Sequence[int] | None = None) -> list[Dataset]:
    """A Dataset of each environment, the last first; of all or of some environments, all or
    some ids. Only rows of these are asked of the database."""
    if "://" in path and not path.startswith("file:"):
        spark.sparkContext.addFile(path)
    with sqlite3.connect(f"file:{_local(path)}?mode=ro", uri=True) as db:
        there = {r[0] for r in db.execute("select name from sqlite_master where type = 'table'")}
    if missing := {"Time", "ReportData", "ReportDataDictionary"} - there:
        raise model.NoResults(f"{path} lacks {sorted(missing)}")
    spark.dataSource.register(SqliteTable)
    asked = {} if ids is None else {"in.ReportDataDictionaryIndex": ",".join(map(str, ids))}

    def load(name: str, **options: str) -> DataFrame:
        return spark.read.format("gridlark_sqlite").options(path=path, table=name, **options).load()

    time, words = load("Time"), load("ReportDataDictionary", **asked)
    if ids is not None:
        words = words.where(F.col("ReportDataDictionaryIndex").isin(list(ids)))
    envs = {r["EnvironmentPeriodIndex"]: r["EnvironmentName"] for r in load("EnvironmentPeriods").collect()} if "EnvironmentPeriods" in there else {None: ""}
    chosen = [e for e in envs if environments is None or envs[e] in environments]
    if environments is not None and (lost := set(environments) - set(envs.values())):
        raise KeyError(f"no environments {sorted(lost)}")
    if not warmup:
        time = time.where(F.coalesce("WarmupFlag", F.lit(0)) == 0)
    unknown = [r["IntervalType"] for r in time.select("IntervalType").distinct().collect() if r["IntervalType"] not in INTERVAL_TYPES]
    if unknown:
        raise KeyError(f"unknown interval types {unknown}")
    meter = F.col("IsMeter") == 1
    hvac = F.col("ReportingFrequency") == "HVAC System Timestep"
    table = F.element_at(F.create_map(*[F.lit(x) for kv in FREQUENCIES.items() for x in kv]), F.col("ReportingFrequency"))
    cumulative = F.when(F.col("Name").contains("Cumulative"), "Cumulative Meter").otherwise("Meter")
    head = words.select(F.col("ReportDataDictionaryIndex").alias("id"), F.col("ReportDataDictionaryIndex").alias("pos"), F.when(meter, cumulative).otherwise(F.col("KeyValue")).alias("key"), F.when(hvac, F.concat(F.lit("System - "), F.col("Name"))).otherwise(F.col("Name")).alias("type"), F.coalesce("Units", F.lit("")).alias("units"), table.alias("table"))
    kind = F.element_at(F.create_map(*[F.lit(x) for k, v in INTERVAL_TYPES.items() for x in (k, v)]), F.col("IntervalType"))
    lowest = time.groupBy("EnvironmentPeriodIndex").agg(F.min(F.when(F.col("Year") > 0, F.col("Year"))).alias("low_year"))
    rows = time.withColumn("table", kind).join(lowest, time["EnvironmentPeriodIndex"].eqNullSafe(lowest["EnvironmentPeriodIndex"]), "left").drop(lowest["EnvironmentPeriodIndex"])
    long = F.col("table").isin("runperiod", "annual")
    coarse = F.col("table").isin("daily", "monthly", "runperiod", "annual")
    ts = tl.database_stamp(F.when(F.col("table") == "runperiod", F.col("low_year")).otherwise(F.col("Year")), F.when(long, F.lit(1)).otherwise(F.col("Month")), F.when(long | (F.col("table") == "monthly"), F.lit(1)).otherwise(F.col("Day")), F.when(coarse, F.lit(0)).otherwise(F.col("Hour")), F.when(coarse, F.lit(0)).otherwise(F.col("Minute")))
    rows = rows.withColumn("ts", ts)
    out = []
    n_words = words.count()
    name = os.path.splitext(os.path.basename(path))[0]
    created = dt.datetime.fromtimestamp(Files(spark).time(path), dt.timezone.utc).replace(tzinfo=None)
    # steps of an environment follow each other: a row for each
    spans = {r["EnvironmentPeriodIndex"]: (r["a"], r["b"]) for r in time.groupBy("EnvironmentPeriodIndex").agg(F.min("TimeIndex").alias("a"), F.max("TimeIndex").alias("b")).collect()}
    for n, env in enumerate(sorted(envs, key=lambda e: (e is not None, e), reverse=True)):
        if env not in chosen:
            continue
        low, high = spans.get(env, (0, -1))
        mine = load("ReportData", columns="TimeIndex,ReportDataDictionaryIndex,Value", **asked, **{"range.TimeIndex": f"{low},{high}"})
        own = rows.where(F.col("EnvironmentPeriodIndex").eqNullSafe(F.lit(env)))
        w = Window.partitionBy("table").orderBy("TimeIndex")
        own = own.withColumn("row_ix", (F.row_number().over(w) - 1).cast("long")).withColumn("file_id", F.lit(0))
        fixed = tl.first_stamp_fixed(own.select("file_id", "table", "row_ix", "ts", F.col("DayType").alias("day"), "SimulationDays", "TimeIndex"))
        order = Window.partitionBy("file_id", "table").orderBy("row_ix")
        steps = fixed.select("file_id", "table", "row_ix", "ts", F.lit(None).cast("long").alias("range_ix"), F.lit(None).cast("string").alias("label"), F.when(F.col("table").isin("timestep", "hourly", "daily"), F.col("day")).alias("day"), tl.n_days(F.col("table"), F.col("ts"), F.col("SimulationDays"), order).alias("n_days"))
        of = head.select("id", F.col("table").alias("of"))
        of = F.broadcast(of) if n_words <= 1_000_000 else of
        values = mine.join(own.select("TimeIndex", "table", "row_ix", "file_id"), "TimeIndex").join(of, mine["ReportDataDictionaryIndex"] == F.col("id")).where(F.col("of") == F.col("table")).groupBy("file_id", "table", "id", "row_ix").agg(F.avg("Value").alias("value"))
        files = spark.createDataFrame([(0, path, name if n == 0 else f"{name} - {envs[env]}", created, "sql")], model.FILES)
        header = head.select(F.lit(0).alias("file_id"), "table", "id", "pos", F.lit(False).alias("is_simple"), "key", "type", "units")
        out.append(assemble(spark, files, header, steps, values))
    return out
