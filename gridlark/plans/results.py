"""Results of files for variables: slices or peaks, converted and laid out."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.dataset import Dataset
from gridlark.functions import units as u
from gridlark.model import OUTPUT_TYPES, InvalidOutputType, InvalidUnitsSystem, PeaksNotIncluded
from gridlark.operators import fetch, lookup

log = logging.getLogger(__name__)
#: Directives of strftime and their date_format patterns.
DIRECTIVES = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%H": "HH",
    "%I": "hh",
    "%M": "mm",
    "%S": "ss",
    "%f": "SSSSSS",
    "%p": "a",
    "%j": "DDD",
    "%A": "EEEE",
    "%a": "EEE",
    "%B": "MMMM",
    "%b": "MMM",
}


@dataclass(frozen=True)
class TableFormatter:
    """How results are laid out; file_name_position is row, column or None."""

    file_name_position: str | None = "row"
    include_table_name: bool = False
    include_day: bool = False
    include_id: bool = False
    timestamp_format: str = "default"

    def __post_init__(self):
        where = self.file_name_position
        if where in (None, "None"):
            object.__setattr__(self, "file_name_position", None)
        elif where not in ("row", "column"):
            log.warning("no such position: %s; row is taken", where)
            object.__setattr__(self, "file_name_position", "row")


def stamp_text(ts: Column, pattern: str) -> Column:
    """A stamp in a strftime pattern."""
    if pattern == "default":
        return ts
    out, i, plain = "", 0, ""

    def flushed(text: str) -> str:
        return "'" + text.replace("'", "''") + "'" if text else ""

    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in DIRECTIVES or two == "%%":
            if two == "%%":
                plain += "%"
            else:
                out, plain = out + flushed(plain) + DIRECTIVES[two], ""
            i += 2
        else:
            plain += pattern[i]
            i += 1
    return F.date_format(ts.cast("timestamp"), out + flushed(plain))


def processed(ds: Dataset, variables, start_date=None, end_date=None, output_type: str = "standard", part_match: bool = False, units_system: str = "SI", rate_units: str = "W", energy_units: str = "J", rate_to_energy: bool = False) -> DataFrame | None:
    """Long rows of one file: `file_id, table, table_ord, id, key, type, units, ord,
    row_ix, ts, value` and, of peaks, `peak_ts`. None if nothing is found."""
    if output_type not in OUTPUT_TYPES:
        raise InvalidOutputType(f"{output_type} is none of {OUTPUT_TYPES}")
    if units_system not in ("SI", "IP"):
        raise InvalidUnitsSystem(f"{units_system} is neither SI nor IP")
    table = u.conversions(units_system, rate_units, energy_units)
    by_table = lookup.table_ids(ds, variables, part_match)
    parts = []
    for n, (name, ids) in enumerate(by_table.items()):
        ids = list(dict.fromkeys(ids))
        if (start_date is not None or end_date is not None) and not ds.is_datetime(name):
            raise ValueError(f"table {name} has no dates to slice by")
        head = ds.variables.where((F.col("table") == name) & F.col("id").isin(ids)).select("file_id", "id", "key", "type", "units")
        order = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("id")).cast("int") - 1
        peak_ts = F.lit(None).cast("timestamp_ntz")
        if output_type.startswith("local"):
            if ds.peaks.where(F.col("table") == name).limit(1).count() == 0:
                raise PeaksNotIncluded(f"table {name} has no peaks")
            df = fetch.local_peaks(ds, name, ids, output_type == "local_max", start_date, end_date).join(ds.with_size(head), ["file_id", "id"]).withColumn("row_ix", F.lit(None).cast("long"))
        elif output_type.startswith("global"):
            df = fetch.global_peak(fetch.values(ds, name, ids, start_date, end_date), output_type == "global_max").withColumnRenamed("ts", "peak_ts").join(ds.with_size(head), ["file_id", "id"]).withColumn("row_ix", F.lit(0).cast("long")).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
        else:
            df = fetch.values(ds, name, ids, start_date, end_date).withColumn("peak_ts", peak_ts)
            if rate_to_energy:
                kind = u.step_kinds(ds.steps.where(F.col("table") == name)).first()
                if kind is not None and (kind["is_timestep"] or kind["is_hourly"] or kind["is_daily"]):
                    df = u.rate_to_energy(df, kind["step_s"])
                elif ds.steps.where((F.col("table") == name) & F.col("n_days").isNotNull()).limit(1).count():
                    df = u.rate_to_energy(fetch.with_n_days(ds, df), None)
                else:
                    log.warning("the steps of %s have no known length; rates stay", name)
        df = u.convert(df, table)
        parts.append(df.withColumn("table_ord", F.lit(n)).withColumn("ord", order).select("file_id", "table", "table_ord", "id", "key", "type", "units", "ord", "row_ix", "ts", "value", "peak_ts"))
    return reduce(DataFrame.unionByName, parts) if parts else None


def label(formatter: TableFormatter, row, file_name: str | None = None, data: str | None = None) -> str:
    """A flat column name; levels are parted by `|`."""
    levels = [file_name if formatter.file_name_position == "column" else None, str(row["id"]) if formatter.include_id else None, row["table"] if formatter.include_table_name else None, row["key"], row["type"], row["units"], data]
    return "|".join(x for x in levels if x is not None)


def wide(ds: Dataset, long: DataFrame, formatter: TableFormatter, peaks: bool) -> DataFrame:
    """One column a variable (two with peaks: value and timestamp), one row a
    stamp; tables and files are aligned by their stamps, gaps are null."""
    names = {r["file_id"]: r["file_name"] for r in ds.files.collect()}
    heads = long.select("file_id", "table_ord", "table", "ord", "id", "key", "type", "units").distinct().orderBy("file_id", "table_ord", "ord").collect()
    by_row = formatter.file_name_position == "row"
    index = (["file"] if by_row else []) + ["at"]
    at = F.coalesce(stamp_text(F.col("ts"), formatter.timestamp_format).cast("string") if formatter.timestamp_format != "default" else F.col("ts").cast("string"), F.col("row_ix").cast("string"))
    rows = long.withColumn("at", at).withColumn("file", F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("file_id")))
    if formatter.include_day:
        day = ds.steps.select("file_id", "table", "row_ix", F.col("day").alias("__day"))
        rows = rows.join(day, ["file_id", "table", "row_ix"], "left").withColumn("day", fetch.weekday(F.col("ts"), F.col("__day")))
        index.append("day")
    # which column the values of a variable go to: a row a variable
    kinds = ("value", "timestamp") if peaks else (None,)
    owner, order, places = {}, [], []
    for h in heads:
        level = (h["table"], h["key"], h["type"], h["units"], h["id"] if formatter.include_id else None)
        for data in kinds:
            name = label(formatter, h, names.get(h["file_id"]), data)
            if name not in owner:
                owner[name] = level
                order.append((name, data))
            elif not by_row or owner[name] != level:
                continue
            places.append((h["file_id"], h["table"], h["id"], name, data or "value"))
    to = ds.spark.createDataFrame(places, "file_id int, table string, id int, __name string, __data string")
    rows = rows.join(F.broadcast(to) if len(places) <= 1_000_000 else to, ["file_id", "table", "id"])
    default = formatter.timestamp_format == "default"
    # stamps of rows are as good as their texts, unless a format makes texts of several alike
    by = [*index, *(["ts"] if default else [])]
    parts = []
    for data, source in (("value", F.col("value")), ("timestamp", F.col("peak_ts") if default else stamp_text(F.col("peak_ts"), formatter.timestamp_format))):
        mine = [n for n, d in order if (d or "value") == data]
        if mine:
            # a pivot goes through the rows once, whatever the number of columns
            parts.append(rows.where(F.col("__data") == data).withColumn("__v", source).groupBy(*by).pivot("__name", mine).agg(F.max("__v")))
    out = parts[0]
    if len(parts) > 1:
        other = parts[1].toDF(*[f"__{c}" if c in by else c for c in parts[1].columns])
        same = F.lit(True)
        for c in by:
            same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
        out = out.join(other, same)
    columns = [F.col(f"`{n}`") for n, _ in order]
    lead = [F.col("file")] if by_row else []
    day = [F.col("day")] if formatter.include_day else []
    return out.select(*lead, *day, (F.col("ts") if default else F.col("at")).alias("timestamp"), *columns)


def get_results(files: Dataset | Sequence[Dataset], variables, start_date=None, end_date=None, output_type: str = "standard", part_match: bool = False, table_formatter: TableFormatter | None = None, units_system: str = "SI", rate_units: str = "W", energy_units: str = "J", rate_to_energy: bool = False, layout: str = "wide", loader=None, **load_kwargs) -> DataFrame | None:
    """Results of one or more files. Paths among `files` are loaded first.

    layout `long` gives rows instead of one column a variable. Nothing found is
    a warning and None.
    """
    many = files if isinstance(files, list | tuple) else [files]
    loaded = []
    for f in many:
        if not isinstance(f, Dataset):
            if loader is None:
                raise TypeError("a path needs a loader (gridlark.sources.reader.load)")
            f = loader(f, **load_kwargs)
        loaded.append(f)
    parts, sets = [], []
    for i, ds in enumerate(loaded):
        part = processed(ds, variables, start_date, end_date, output_type, part_match, units_system, rate_units, energy_units, rate_to_energy)
        if part is not None:
            number = F.lit(i) if len(loaded) > 1 else F.col("file_id")
            parts.append(part.withColumn("file_id", number))
            sets.append(Dataset(*(df.withColumn("file_id", number) for df in (ds.files, ds.variables, ds.steps, ds.results, ds.texts, ds.peaks))))
    if not parts:
        log.warning("none of the variables was found: %s", variables)
        return None
    long, ds = reduce(DataFrame.unionByName, parts), reduce(Dataset.union, sets)
    if layout == "long":
        return long
    return wide(ds, long, table_formatter or TableFormatter(), output_type != "standard")
