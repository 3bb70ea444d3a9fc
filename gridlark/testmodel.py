"""The driver's tables seen as results files.

File 1 has `hourly` (events), `daily` and `monthly` (line items), `orders` (a
simple table) and `parts` (a range table with text); file 2 has `daily` and
`monthly` of open line items only. All is lazy: a query reads the tables it uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark import model
from gridlark.dataset import Dataset

EVENTS = {"click": (201, "W"), "error": (202, "J"), "purchase": (203, "W/m2"), "signup": (204, "C"), "view": (205, "")}
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
FLAGS = {"A": (1, "J"), "N": (2, "W"), "R": (3, "C")}


def _header() -> list[tuple]:
    rows = [(1, "hourly", 0, i, n, False, "SITE", kind, units) for n, (kind, (i, units)) in enumerate(EVENTS.items())]
    for file in (1, 2):
        for table, place, first in (("daily", 1, 100), ("monthly", 2, 0)):
            rows += [(file, table, place, first + b * 3 + i, b * 3 + i - 1, False, f"BLOCK{b}:ZONE1", flag, units) for b in range(4) for flag, (i, units) in FLAGS.items()]
    rows += [(1, "orders", 3, 301 + i, i, True, p, None, "") for i, p in enumerate(PRIORITIES)]
    return rows + [(1, "parts", 4, 401 + i, i, False, "PART", kind, "") for i, kind in enumerate(("p_type", "p_size", "p_retailprice"))]


def _exact(c: str) -> Column:
    """Exact sums: cents as decimals, a double at the end."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def _grid(df: DataFrame, ts: str, unit: str) -> DataFrame:
    step = {"hour": "interval 1 hour", "day": "interval 1 day", "month": "interval 1 month"}[unit]
    span = df.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).where("a is not null")
    return span.select(F.explode(F.sequence("a", "b", F.expr(step))).alias("ts")).select(F.col("ts").cast("timestamp_ntz").alias("ts"))


def _ix(ts: Column, unit: str) -> Column:
    if unit == "month":
        return (F.year(ts) * 12 + F.month(ts) - 1).cast("long")
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (3_600_000_000 if unit == "hour" else 86_400_000_000)).cast("long")


def _steps(file: int, table: str, grid: DataFrame, unit: str) -> DataFrame:
    day = F.when(F.dayofmonth("ts") == 1, F.lit("Holiday")) if unit == "day" else F.lit(None).cast("string")
    days = F.dayofmonth(F.last_day(F.col("ts").cast("date"))) if unit == "month" else F.lit(None).cast("int")
    return grid.select(F.lit(file).alias("file_id"), F.lit(table).alias("table"), _ix(F.col("ts"), unit).alias("row_ix"), "ts", F.lit(None).cast("long").alias("range_ix"), F.lit(None).cast("string").alias("label"), day.alias("day"), days.alias("n_days"))


def _values(file: int, table: str, steps: DataFrame, ids: list[int], sums: DataFrame) -> DataFrame:
    """Every variable in every step; null where nothing was summed."""
    grid = steps.select("row_ix", "ts", F.explode(F.array(*[F.lit(i) for i in ids])).alias("id"))
    return grid.join(sums, ["ts", "id"], "left").select(F.lit(file).alias("file_id"), F.lit(table).alias("table"), "id", "row_ix", "ts", "value")


def load(spark: SparkSession, sf_dir: str) -> Dataset:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    header = _header()
    ids = lambda file, table: [h[3] for h in header if h[0] == file and h[1] == table]
    steps, results, peaks = [], [], []
    items = read("lineitem")
    flag = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    for file in (1, 2):
        rows = items if file == 1 else items.where("l_linestatus = 'O'")
        for table, unit, first in (("daily", "day", 100), ("monthly", "month", 0)):
            at = rows.select(F.date_trunc(unit, "l_shipdate").cast("timestamp_ntz").alias("ts"), (F.lit(first) + (F.col("l_suppkey") % 4) * 3 + flag).cast("int").alias("id"), "l_extendedprice")
            step = _steps(file, table, _grid(at, "ts", unit), unit)
            steps.append(step)
            results.append(_values(file, table, step, ids(file, table), at.groupBy("ts", "id").agg(_exact("l_extendedprice").alias("value"))))
            if file == 1 and unit == "day":
                day = at.groupBy("ts", "id").agg(_exact("l_extendedprice").alias("v"))
                micros = F.unix_micros(F.col("ts").cast("timestamp"))
                month = F.date_trunc("month", "ts").cast("timestamp_ntz")
                peaks.append(day.withColumn("m", month).groupBy("m", "id").agg(F.min("v").alias("min_value"), F.min_by("ts", F.struct("v", micros)).alias("min_ts"), F.max("v").alias("max_value"), F.max_by("ts", F.struct("v", -micros)).alias("max_ts")).select(F.lit(1).alias("file_id"), F.lit("monthly").alias("table"), (F.col("id") - 100).alias("id"), F.col("m").alias("ts"), "min_value", "min_ts", "max_value", "max_ts"))
    kind = F.element_at(F.create_map(*[F.lit(x) for k, (i, _) in EVENTS.items() for x in (k, i)]), F.col("event_type"))
    events = read("events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), kind.alias("id"), "value")
    step = _steps(1, "hourly", _grid(events, "ts", "hour"), "hour")
    steps.append(step)
    results.append(_values(1, "hourly", step, ids(1, "hourly"), events.groupBy("ts", "id").agg(_exact("value").alias("value"))))
    priority = F.element_at(F.create_map(*[F.lit(x) for i, p in enumerate(PRIORITIES) for x in (p, 301 + i)]), F.col("o_orderpriority"))
    orders = read("orders").select(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ts"), priority.alias("id"), "o_totalprice")
    step = _steps(1, "orders", _grid(orders, "ts", "day"), "day").withColumn("day", F.lit(None).cast("string"))
    steps.append(step)
    results.append(_values(1, "orders", step, ids(1, "orders"), orders.groupBy("ts", "id").agg(_exact("o_totalprice").alias("value"))))
    parts = read("part")
    null_ts = F.lit(None).cast("timestamp_ntz")
    steps.append(parts.select(F.lit(1).alias("file_id"), F.lit("parts").alias("table"), F.col("p_partkey").alias("row_ix"), null_ts.alias("ts"), F.col("p_partkey").alias("range_ix"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("day"), F.lit(None).cast("int").alias("n_days")))
    results.append(parts.selectExpr("1 as file_id", "'parts' as table", "p_partkey as row_ix", "cast(null as timestamp_ntz) as ts", "stack(2, 402, cast(p_size as double), 403, p_retailprice) as (id, value)").select("file_id", "table", "id", "row_ix", "ts", "value"))
    texts = parts.select(F.lit(1).alias("file_id"), F.lit("parts").alias("table"), F.lit(401).alias("id"), F.col("p_partkey").alias("row_ix"), null_ts.alias("ts"), F.col("p_type").alias("value"))
    files = spark.createDataFrame([(i, f"file{i}", f"file{i}", None, "sql") for i in (1, 2)], model.FILES)

    def union(dfs: list[DataFrame]) -> DataFrame:
        out = dfs[0]
        for df in dfs[1:]:
            out = out.unionByName(df)
        return out

    return Dataset(files, spark.createDataFrame(header, model.VARIABLES), union(steps), union(results), texts, union(peaks))
