"""Many simulation result text files read at once.

All files of a folder (or of several paths) become one Dataset by a number of jobs that
does not depend on how many they are: marks of all files (statement, end of the
dictionary, end of the data) are found in one pass, dictionaries are rows keyed by their
file, and environments are numbered over all files (`file_id`).

Values belong to the step line before them. A split's lines lie together in one task, so
the latest step and the number of environments are carried along the lines there, in
Arrow batches and without a shuffle; what a split leaves to the next ones of its file is
a row a split.

A file is a path that ends in `.eso`: a text file, or a folder whose parts follow each
other in the order of their names. Faults name the first few files that have them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlark import model
from gridlark.dataset import Dataset
from gridlark.functions import timeline as tl
from gridlark.sources.assemble import SUBMONTHLY, WEEKDAY, assemble, chosen_year, dated
from gridlark.sources.eso import _END, _END_OF_HEADER, _number, header_entries, peak_rows, step_rows
from gridlark.sources.files import workspace
from gridlark.sources.progress import StatusTracker

_KNOWN = 1_000_000  # rows of metadata that all tasks may be given
_FILE = r"^(.*?\.[eE][sS][oO])(/.*)?$"


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= _KNOWN else df


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:/")


def _lines(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame, int]:
    """`(fno, blk, mid, line)` of all files, and `(fno, file)`. blk is the place of a split
    in its file; mid numbers all lines, in order inside a split."""
    text = spark.read.option("recursiveFileLookup", "true").text(list(paths))
    parts = sorted(re.sub("^file:/+", "file:/", f) for f in text.inputFiles())
    of = [(m.group(1), p) for p in parts if (m := re.match(_FILE, p))]
    if not of:
        raise model.NoResults(f"no .eso files in {list(paths)}")
    number, seen = {f: n for n, f in enumerate(dict.fromkeys(f for f, _ in of))}, {}
    rows = []
    for f, p in of:
        seen[f] = seen.get(f, -1) + 1
        rows.append((p, number[f], seen[f] << 40))
    known = _small(spark.createDataFrame(rows, "__part string, fno int, __from long"), len(rows))
    text = text.select(_plain(F.col("_metadata.file_path")).alias("__part"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("mid"), F.trim("value").alias("line"))
    files = spark.createDataFrame([(n, f) for f, n in number.items()], "fno int, file string")
    return text.join(known, "__part").select("fno", (F.col("__from") + F.col("at")).alias("blk"), "mid", "line"), files, len(number)


def _fault(kind: type[model.GridlarkError], rows: DataFrame, files: DataFrame, what: str) -> None:
    bad = [r["file"] for r in rows.select("fno").distinct().limit(5).join(files, "fno").collect()]
    if bad:
        raise kind(f"{what}: {sorted(bad)}")


_CARRIED = "fno int, blk long, mid long, line string, no int, highest int, smid long, env_here int"


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each line the latest step line of its split (null before the first one) and
    the number of environment lines of the split up to it."""
    key, step, env = (-1, -1), -1, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        fno, blk, mid, no, highest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fno", "blk", "mid", "no", "highest"))
        new = np.ones(n, bool)
        new[1:] = (fno[1:] != fno[:-1]) | (blk[1:] != blk[:-1])
        new[0] = (fno[0], blk[0]) != key
        no = np.nan_to_num(no, nan=-1).astype(np.int64)
        is_step = (no >= 2) & (no <= highest)
        first = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: goes on from the batch before
        last = np.maximum.accumulate(np.where(is_step, np.arange(n), -1))
        smid = np.where((last >= 0) & (last >= first), mid[last], np.where(first < 0, step, -1))
        count = np.cumsum(no == 1)
        envs = np.where(first < 0, env + count, count - np.where(first > 0, count[np.maximum(first, 1) - 1], 0))
        key, step, env = (fno[-1], blk[-1]), int(smid[-1]), int(envs[-1])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("fno", "blk", "mid", "line", "no", "highest")), pa.array(smid, mask=smid < 0), pa.array(envs, pa.int32())], [x.split()[0] for x in _CARRIED.split(", ")])


def _before(mark: str) -> Column:
    return F.struct("blk", "mid") < F.col(mark)


def read_eso_files(spark: SparkSession, paths: str | Sequence[str], year: int | None = None, ignore_peaks: bool = True, tracker: StatusTracker | None = None, dense: bool = True) -> Dataset:
    """One Dataset of all files and environments. `file_id` counts files by path and, in a
    file, environments from the last one, which has the bare file name; the others are
    called `name - environment`. `year` holds for all; else each environment has its own.
    Not `dense`, only reported values are rows."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    tracker = tracker or StatusTracker("eso")
    tracker.section("read marks and dictionaries")
    at = workspace(spark)
    text, files, n_files = _lines(spark, paths)
    # marks of all files
    place = F.struct("blk", "mid")
    is_mark = (F.col("line") == _END_OF_HEADER) | (F.col("line") == _END) | F.col("line").startswith("Program Version")
    seen = lambda mark: F.min(F.when(F.col("line") == mark, place))
    marks = text.where(is_mark).groupBy("fno").agg(seen(_END_OF_HEADER).alias("head"), F.max(F.when(F.col("line") == _END, place)).alias("last"), seen(_END).alias("tail"), F.min_by("line", F.when(F.col("line").startswith("Program Version"), place)).alias("top"))
    v = lambda i: F.regexp_extract("top", r"Version (\d+)\.(\d+)\.(\d+)", i)
    t = r"YMD=(\d+)\.(\d+)\.(\d+) (\d+):(\d+)"
    made = F.to_timestamp(F.regexp_replace(F.regexp_extract("top", t, 0), t, "$1-$2-$3 $4:$5"), "y-M-d H:m")
    marks = files.join(marks, "fno", "left").withColumn("version", F.concat(v(1), v(2), v(3)).try_cast("int")).withColumn("created", F.when(F.col("top").rlike(t), made))
    marks.write.parquet(f"{at}/marks")
    marks = spark.read.parquet(f"{at}/marks").withColumn("highest", F.when(F.col("version") >= 890, 6).otherwise(5))
    _fault(model.IncompleteFile, marks.where("head is null or tail is null or last <= head"), files, "files that end before their end mark")
    _fault(model.InvalidLineSyntax, marks.where("version is null or created is null"), files, "files without a statement line")
    own = _small(marks.select("fno", "head", "tail", "highest"), n_files)
    known = text.join(own, "fno")
    # dictionaries; the statement and the definitions of intervals come first
    order = Window.partitionBy("fno").orderBy("blk", "mid")
    head = known.where(_before("head")).withColumn("pos", F.row_number().over(order) - 2 - F.col("highest")).where("pos >= 0")
    header_entries(head.select("fno", "pos", "line")).write.parquet(f"{at}/head")
    head = spark.read.parquet(f"{at}/head")
    _fault(model.InvalidLineSyntax, head.where("id is null"), files, "files with lines in their dictionary that are no entries")
    entries = head.count()
    # data
    body = known.where((place > F.col("head")) & _before("tail") & (F.col("line") != _END))
    body = body.select("fno", "blk", "mid", "line", F.expr("try_cast(split(line, ',', 2)[0] as int)").alias("no"), "highest")
    tracker.section("read lines")
    tracker.counted(body.mapInArrow(_carry, _CARRIED)).write.parquet(f"{at}/lines")
    tracker.settle()
    tracker.section("assemble environments")
    rows = spark.read.schema(_CARRIED).parquet(f"{at}/lines")
    bad = F.col("no").isNull() | ~F.col("line").contains(",")
    _fault(model.BlankLineError, rows.where("line = ''"), files, "files with blank lines")
    _fault(model.InvalidLineSyntax, rows.where(bad), files, "files with lines that can't be read")
    upto = Window.partitionBy("fno").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("no").between(2, F.col("highest")), F.col("mid"))
    left = rows.groupBy("fno", "blk").agg(F.max(step).alias("s"), F.max("env_here").alias("e"))  # a row a split
    left = left.select("fno", "blk", F.last("s", ignorenulls=True).over(upto).alias("carry"), F.coalesce(F.sum("e").over(upto), F.lit(0)).alias("envs"))
    left.write.parquet(f"{at}/splits")
    left = spark.read.parquet(f"{at}/splits")
    rows = rows.join(_small(left, left.count()), ["fno", "blk"]).withColumns({"smid": F.coalesce("smid", "carry"), "env": (F.col("env_here") + F.col("envs")).cast("int"), "f": F.split("line", ",")})
    # environments of all files, numbered
    envs = rows.where("no = 1").select("fno", "env", F.trim(F.get("f", F.lit(1))).alias("env_name"))
    envs = envs.join(files, "fno").withColumn("file_id", (F.row_number().over(Window.orderBy("fno", F.col("env").desc())) - 1).cast("int")).withColumn("is_last", F.row_number().over(Window.partitionBy("fno").orderBy(F.col("env").desc())) == 1)  # a row an environment
    steps = step_rows(rows.where(F.col("no") <= F.col("highest")), 6)
    steps = steps.withColumn("row_ix", (F.row_number().over(Window.partitionBy("fno", "env", "table").orderBy("blk", "mid")) - 1).cast("long"))
    design = F.bool_and(~F.coalesce(F.col("day").isin(*WEEKDAY), F.lit(False)) & F.coalesce(F.col("day").contains("Design"), F.lit(False)))
    sub = F.col("table").isin(*SUBMONTHLY)
    sizing = steps.where(sub).groupBy("fno", "env").agg(design.alias("sizing"))
    envs.join(sizing, ["fno", "env"], "left").withColumn("sizing", F.coalesce("sizing", F.lit(False))).write.parquet(f"{at}/envs")
    envs = spark.read.parquet(f"{at}/envs")
    n_envs = envs.count()
    number = _small(envs.select("fno", "env", "file_id", "sizing"), n_envs)
    steps = steps.join(number, ["fno", "env"]).where(~(F.col("sizing") & F.col("table").isin("monthly", "annual", "runperiod")))
    steps.write.parquet(f"{at}/steps")
    steps = spark.read.parquet(f"{at}/steps")
    # first years: by the finest table of each environment
    rank = F.array_position(F.array(*[F.lit(x) for x in SUBMONTHLY]), F.col("table"))
    fine = steps.where(sub).withColumn("__rank", rank).withColumn("__least", F.min("__rank").over(Window.partitionBy("file_id"))).where("__rank = __least")
    fine = fine.withColumn("kind", F.col("day")).withColumn("day", F.col("day_of_month"))
    fine = tl.wrapped_year(fine, 0, ["file_id"], "row_ix", F.col("table") == "timestep")
    facts = fine.groupBy("file_id").agg(F.min_by(F.struct("month", "day_of_month", "kind"), "row_ix").alias("d"), F.collect_set(F.when((F.col("month") == 2) & (F.col("day_of_month") == 29), F.col("year"))).alias("leaps"))
    years = [(r["file_id"], chosen_year(*r["d"], set(r["leaps"]), year)) for r in facts.collect()]  # a row an environment
    first = spark.createDataFrame(years, "file_id int, first_year int")
    whole = year if year is not None else tl.DESIGN_DAY_YEAR  # of environments without such tables
    stamped = dated(steps.join(_small(first, n_envs), "file_id", "left").withColumn("first_year", F.coalesce("first_year", F.lit(whole))), F.col("first_year"))
    # values
    of = head.select("fno", "id", F.col("table").alias("of"))
    place = steps.select(F.col("mid").alias("smid"), "file_id", "table", "row_ix")
    values = rows.where(F.col("no") > F.col("highest")).select("fno", "env", F.col("no").alias("id"), "smid", "f").join(number, ["fno", "env"], "left")
    values = values.join(_small(of, entries), ["fno", "id"], "left").where(~(F.coalesce("sizing", F.lit(False)) & F.coalesce(F.col("of").isin("monthly", "annual", "runperiod"), F.lit(False))))
    values = values.join(place.drop("file_id"), "smid", "left")
    _fault(model.InvalidLineSyntax, values.where("of is null or table is null or of <> table or file_id is null"), files, "files with values outside of their interval")
    result = values.select("file_id", "table", "id", "row_ix", _number(F.get("f", F.lit(1))).alias("value"))
    base = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[eE][sS][oO]$", "")
    table = envs.join(marks.select("fno", "created"), "fno").select("file_id", F.col("file").alias("file_path"), F.when(F.col("is_last"), base).otherwise(F.concat(base, F.lit(" - "), "env_name")).alias("file_name"), F.col("created").alias("file_created"), F.lit("eso").alias("file_type"))
    header = head.join(_small(envs.select("fno", "file_id"), n_envs), "fno").select("file_id", "table", "id", "pos", F.lit(False).alias("is_simple"), "key", "type", "units")
    return assemble(spark, table, header, stamped, result, None if ignore_peaks else peak_rows(values, stamped), dense)

