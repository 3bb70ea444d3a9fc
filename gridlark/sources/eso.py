"""Simulation result text files (`.eso`).

Lines are read in splits of any size. Each split's last step line and its number
of environment lines are carried to the next by a window over the splits (one
row a split), and inside a split by a window over its lines; so a file of any
size is parsed in parallel although a value belongs to the step line before it.
"""

from __future__ import annotations

import datetime as dt
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlark import model
from gridlark.dataset import Dataset
from gridlark.functions.timeline import occurrence_stamp
from gridlark.sources.assemble import assemble, is_sizing, stamped
from gridlark.sources.files import workspace
from gridlark.sources.progress import StatusTracker

_END_OF_HEADER, _END = "End of Data Dictionary", "End of Data"
_ENTRY = re.compile(r"^(\d+),(\d+),(.*?) ?\[(.*?)\] ?!(Each Call|\w+)")


def statement(line: str) -> tuple[int, dt.datetime]:
    """Program version as a whole number and the time of creation."""
    v = re.search(r"Version (\d+)\.(\d+)\.(\d+)", line)
    t = re.search(r"YMD=(\d+)\.(\d+)\.(\d+) (\d+):(\d+)", line)
    if not v or not t:
        raise model.InvalidLineSyntax(f"no statement line: {line!r}")
    return int("".join(v.groups())), dt.datetime(*map(int, t.groups()))


def header_entry(line: str) -> tuple[int, str, str, str, str]:
    """(id, key, type, units, interval) of a line of the dictionary."""
    if not line.strip():
        raise model.BlankLineError("blank line in the dictionary")
    m = _ENTRY.match(line.strip())
    if not m:
        raise model.InvalidLineSyntax(f"no dictionary line: {line!r}")
    number, _, name, units, interval = m.groups()
    key, comma, kind = name.rpartition(",")
    if not comma:
        key, kind = ("Cumulative Meter" if "Cumulative" in name else "Meter"), name
    if interval == "Each Call":
        kind, interval = f"System - {kind}", "TimeStep"
    return int(number), key, kind.strip(), units, interval.lower()


def header_entries(df: DataFrame, line: str = "line") -> DataFrame:
    """The same as `header_entry` for a column of lines, by expressions: `id, key, type,
    units, table`; null where a line is no entry."""
    part = lambda i: F.regexp_extract(line, _ENTRY.pattern, i)
    name, called = part(3), part(5)
    meter = ~name.contains(",")
    key = F.when(meter, F.when(name.contains("Cumulative"), "Cumulative Meter").otherwise("Meter")).otherwise(F.regexp_extract(name, "^(.*),", 1))
    kind = F.when(meter, name).otherwise(F.trim(F.substring_index(name, ",", -1)))
    call = called == "Each Call"
    ok = F.trim(F.col(line)).rlike(_ENTRY.pattern)
    made = {"id": F.expr("try_cast(__id as int)"), "key": key, "type": F.when(call, F.concat(F.lit("System - "), kind)).otherwise(kind), "units": part(4), "table": F.when(call, "timestep").otherwise(F.lower(called))}
    rows = df.withColumn(line, F.trim(F.col(line))).withColumn("__id", part(1))
    return rows.select(*[c for c in df.columns if c != line], *[F.when(ok, v).alias(k) for k, v in made.items()])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """`(blk, mid, line)`: split, place in it and text. The parts of a folder follow
    each other in the order of their names."""
    text = spark.read.text(path)
    blk = F.col("_metadata.file_block_start")
    parts = sorted(text.inputFiles())
    if len(parts) > 1:
        # metadata: a row a file; a split's place is below 2^40
        number = F.broadcast(spark.createDataFrame([(f.rsplit("/", 1)[-1], n) for n, f in enumerate(parts)], "part string, n long"))
        text = text.select("value", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("part"), blk.alias("at")).join(number, "part")
        blk = F.col("n") * F.lit(1 << 40) + F.col("at")
    return text.select(blk.alias("blk"), F.monotonically_increasing_id().alias("mid"), F.trim("value").alias("line"))


def _before(at: tuple[int, int]) -> Column:
    return (F.col("blk") < at[0]) | ((F.col("blk") == at[0]) & (F.col("mid") < at[1]))


def _after(at: tuple[int, int]) -> Column:
    return (F.col("blk") > at[0]) | ((F.col("blk") == at[0]) & (F.col("mid") > at[1]))


def _read_head(spark: SparkSession, path: str, text: DataFrame) -> tuple[int, dt.datetime, list[tuple], tuple[int, int]]:
    """Version, time, dictionary and where it ends. The dictionary is metadata."""
    end = text.where(F.col("line") == _END_OF_HEADER).orderBy("blk", "mid").limit(1).collect()
    if not end:
        raise model.IncompleteFile(f"{path} ends in its dictionary")
    at = (end[0]["blk"], end[0]["mid"])
    top = [r["line"] for r in text.where(_before(at)).orderBy("blk", "mid").collect()]
    version, created = statement(top[0])
    skip = 6 if version >= 890 else 5
    return version, created, [header_entry(x) for x in top[1 + skip :]], at


def with_steps(body: DataFrame, highest: int) -> DataFrame:
    """Adds to each line its id, environment number and the latest step line."""
    f = F.split("line", ",")
    rows = body.withColumn("f", f).withColumn("no", F.expr("try_cast(f[0] as int)"))
    step = F.when(F.col("no").between(2, highest), F.struct("blk", "mid", "f"))
    env = (F.col("no") == 1).cast("int")
    rows = rows.withColumn("own_step", step).withColumn("own_env", F.coalesce(env, F.lit(0)))
    # what a split leaves to those after it: one row a split
    left = rows.groupBy("blk").agg(F.max_by("own_step", F.when(F.col("own_step").isNotNull(), F.col("mid"))).alias("s"), F.sum("own_env").alias("e"))
    before = Window.partitionBy(F.lit(0)).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    left = left.select("blk", F.last("s", ignorenulls=True).over(before).alias("carry"), F.coalesce(F.sum("e").over(before), F.lit(0)).alias("envs"))
    here = Window.partitionBy("blk").orderBy("mid").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("here", F.last("own_step", ignorenulls=True).over(here)).withColumn("env_here", F.sum("own_env").over(here)).join(F.broadcast(left), "blk")
    return out.select("blk", "mid", "line", "f", "no", F.coalesce("here", "carry").alias("step"), (F.col("env_here") + F.col("envs")).cast("int").alias("env"))


def _number(field: Column) -> Column:
    return field.try_cast("double")


def step_rows(rows: DataFrame, highest: int) -> DataFrame:
    """Step lines as `(env, blk, mid, table, month, day_of_month, hour, end_minute,
    day, cumulative, given_year)`, with the number `fno` of the file where rows have one."""
    f = lambda i: F.get("f", F.lit(i))
    whole = lambda i: F.round(_number(f(i))).cast("int")
    no = F.col("no")
    hourly = (F.round(_number(f(6))) == 0) & (F.round(_number(f(7))) == 60)
    table = F.when(no == 2, F.when(hourly, "hourly").otherwise("timestep")).when(no == 3, "daily").when(no == 4, "monthly").when(no == 5, "runperiod").when(no == 6, "annual")
    one, zero = F.lit(1), F.lit(0)
    return rows.where(no.between(2, highest)).select(
        *[c for c in ("fno",) if c in rows.columns],
        "env",
        "blk",
        "mid",
        table.alias("table"),
        F.when(no.isin(2, 3, 4), whole(2)).otherwise(one).alias("month"),
        F.when(no.isin(2, 3), whole(3)).otherwise(one).alias("day_of_month"),
        F.when(no == 2, whole(5)).otherwise(zero).alias("hour"),
        F.when(no == 2, whole(7)).otherwise(zero).alias("end_minute"),
        F.when(no == 2, F.trim(f(8))).when(no == 3, F.trim(f(5))).alias("day"),
        F.when(no.isin(4, 5), whole(1)).alias("cumulative"),
        F.when(no == 6, whole(1)).alias("given_year"),
    )


#: Places of month, day, hour and minute in one side's peak payload (None: the step's).
_PEAK_FIELDS = {"daily": (None, None, 1, 2), "monthly": (None, 1, 2, 3), "annual": (1, 2, 3, 4), "runperiod": (1, 2, 3, 4)}


def peak_rows(values: DataFrame, steps: DataFrame) -> DataFrame:
    """Reported peaks of each value line: value and stamp of both sides."""
    rows = values.where(F.col("table").isin(*_PEAK_FIELDS) & (F.size("f") > 2)).join(steps.select("file_id", "table", "row_ix", "ts"), ["file_id", "table", "row_ix"])
    out = {}
    for side, k in (("min", 0), ("max", 1)):
        value = stamp = None
        for table, places in _PEAK_FIELDS.items():
            size = 1 + sum(p is not None for p in places)
            get = lambda p, size=size: F.lit(None).cast("int") if p is None else F.round(_number(F.get("f", F.lit(2 + k * size + p)))).cast("int")  # noqa: B023, E731
            mine = F.col("table") == table
            v, s = _number(F.get("f", F.lit(2 + k * size))), occurrence_stamp(F.col("ts"), *(get(p) for p in places))
            value = F.when(mine, v) if value is None else value.when(mine, v)
            stamp = F.when(mine, s) if stamp is None else stamp.when(mine, s)
        out |= {f"{side}_value": value, f"{side}_ts": stamp}
    return rows.select("file_id", "table", "id", "ts", *[c.alias(n) for n, c in out.items()])


def read_eso(spark: SparkSession, path: str, year: int | None = None, ignore_peaks: bool = True, tracker: StatusTracker | None = None, dense: bool = True) -> list[Dataset]:
    """A Dataset of each environment, the last first; it has the bare file name,
    the others `name - environment`. Not `dense`, only reported values are rows."""
    tracker = tracker or StatusTracker("eso")
    tracker.section("read lines")
    text = lines(spark, path)
    version, created, entries, at = _read_head(spark, path, text)
    highest = 6 if version >= 890 else 5
    body = text.where(_after(at) & (F.col("line") != _END))
    if text.where((F.col("line") == _END) & _after(at)).limit(1).count() == 0:
        raise model.IncompleteFile(f"{path} ends before its end mark")
    # what follows the end mark (counts of the program) is no data
    last = text.where(F.col("line") == _END).agg(F.min(F.struct("blk", "mid")).alias("m")).first()["m"]
    body = body.where(_before((last["blk"], last["mid"])))
    # every part of the Dataset is made of these rows: parsed once, into a table that
    # outlives executors and changes of the file
    parsed = f"{workspace(spark)}/lines"
    rows = with_steps(body, highest)
    tracker.counted(rows).write.parquet(parsed)
    tracker.settle()
    rows = spark.read.schema(rows.schema).parquet(parsed)
    blank, bad = rows.agg(F.count_if(F.col("line") == ""), F.count_if((F.col("line") != "") & (F.col("no").isNull() | (F.size("f") < 2)))).first()
    if blank:
        raise model.BlankLineError(f"{path} has {blank} blank lines")
    if bad:
        raise model.InvalidLineSyntax(f"{path} has {bad} lines that can't be read")
    envs = {r["env"]: r["name"] for r in rows.where("no = 1").select("env", F.trim(F.get("f", F.lit(1))).alias("name")).collect()}
    head = spark.createDataFrame([(i, pos, key, kind, units, interval) for pos, (i, key, kind, units, interval) in enumerate(entries)], "id int, pos int, key string, type string, units string, table string")
    steps = step_rows(rows, highest)
    order = Window.partitionBy("env", "table").orderBy("blk", "mid")
    steps = steps.withColumn("row_ix", (F.row_number().over(order) - 1).cast("long"))
    values = rows.where(F.col("no") > highest).select("env", F.col("no").alias("id"), F.col("step.blk").alias("blk"), F.col("step.mid").alias("mid"), "f")
    of = head.select("id", F.col("table").alias("of"))
    values = values.join(F.broadcast(of) if len(entries) <= 1_000_000 else of, "id", "left").join(steps.select("blk", "mid", "table", "row_ix"), ["blk", "mid"], "left")
    if values.where(F.col("of").isNull() | F.col("table").isNull() | (F.col("of") != F.col("table"))).limit(1).count():
        raise model.InvalidLineSyntax(f"{path} has values outside of their interval")
    out = []
    tracker.section("assemble environments")
    tracker.set_maximum(len(envs))
    name = os.path.splitext(os.path.basename(path))[0]
    for n, env in enumerate(sorted(envs, reverse=True)):
        own = steps.where(F.col("env") == env).withColumn("file_id", F.lit(0))
        if is_sizing(own):
            own = own.where(~F.col("table").isin("monthly", "annual", "runperiod"))
        dated = stamped(own, year)
        mine = values.where(F.col("env") == env).withColumn("file_id", F.lit(0)).join(dated.select("table").distinct(), "table", "left_semi")
        result = mine.select("file_id", "table", "id", "row_ix", _number(F.get("f", F.lit(1))).alias("value"))
        files = spark.createDataFrame([(0, path, name if n == 0 else f"{name} - {envs[env]}", created, "eso")], model.FILES)
        header = head.select(F.lit(0).alias("file_id"), "table", "id", "pos", F.lit(False).alias("is_simple"), "key", "type", "units")
        tracker.increment()
        out.append(assemble(spark, files, header, dated, result, None if ignore_peaks else peak_rows(mine, dated), dense))
    return out
