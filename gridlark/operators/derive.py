"""Files derived from others: totals over groups of variables, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlark import model
from gridlark.dataset import Dataset
from gridlark.model import NoResults

# Units that are averaged, units and types that are left out.
AVERAGED_UNITS = ("W", "W/m2", "C", "deltaC", "", "W/m2-K", "ppm", "ach", "hr", "%", "kgWater/kgDryAir")
IGNORED_UNITS = ("kg/s", "m3/s")
IGNORED_TYPES = ("Performance Curve Input Variable", "Performance Curve Output Value")
# Parts of keys and the groups that they stand for, by precedence.
SUBGROUPS = {
    "_WIN": "Windows",
    "_HOLE": "Holes",
    "_DOOR": "Doors",
    "_VENT": "Vents",
    "_PARTITION_": "Partitions",
    "_WALL_": "Walls",
    "_ROOF_": "Roofs",
    "_FLOOR_": "Floors",
    "_EXTFLOOR_": "External floors",
    "_GROUNDFLOOR_": "Ground floors",
    "_CEILING_": "Ceilings",
}
# Beginnings of types that make a group.
PREFIXES = (
    "AFN Zone",
    "Air System",
    "Baseboard",
    "Boiler",
    "Chilled Water Thermal Storage Tank",
    "Chiller",
    "Cooling Coil",
    "Cooling Tower",
    "Debug Surface Solar Shading Model",
    "Earth Tube",
    "Electric Load Center",
    "Environmental Impact",
    "Exterior Lights",
    "Facility",
    "Facility Total",
    "Fan",
    "Generator",
    "HVAC System",
    "Heat Exchanger",
    "Heating Coil",
    "Humidifier",
    "Inverter",
    "Lights",
    "Other Equipment",
    "People",
    "Pump",
    "Refrigeration Air Chiller System",
    "Refrigeration Zone Air Chiller",
    "Refrigeration Zone Case and Walk In",
    "Schedule",
    "Site",
    "Surface",
    "System Node",
    "VRF Heat Pump",
    "Water Heater",
    "Water Use Equipment",
    "Water to Water Heat Pump",
    "Zone",
)
METERS = ("Meter", "Cumulative Meter")


def keyword(text: Column, table: dict[str, str]) -> Column:
    """The value of the first word of a table that is in the text, or null."""
    out = F.lit(None).cast("string")
    for word, value in reversed(table.items()):
        out = F.when(text.contains(word), value).otherwise(out)
    return out


def prefix(text: Column, words: tuple[str, ...]) -> Column:
    """The longest of the words that the text begins with, or null."""
    out = F.lit(None).cast("string")
    for word in sorted(words, key=len):
        out = F.when(F.startswith(text, F.lit(word)), word).otherwise(out)
    return out


def grouped(variables: DataFrame) -> DataFrame:
    """Adds `group_key`, `group_type` and `group_name` of totals."""
    sub = keyword(F.upper("key"), SUBGROUPS)
    meter = F.col("key").isin(*METERS)
    kind = F.when(meter, F.substring_index("type", "#", -1)).otherwise(F.coalesce(prefix(F.col("type"), PREFIXES), F.substring_index("type", " ", 1)))
    key = F.when(sub.isNotNull(), sub).when(meter, F.col("key")).otherwise(kind)
    name = F.concat(F.when(sub.isNotNull() & ~meter, F.concat(sub, F.lit(" "))).otherwise(""), F.when(meter, kind).otherwise(F.col("type")), F.lit(" "), F.col("units"))
    return variables.withColumn("group_key", key).withColumn("group_type", F.when(meter, kind).otherwise(F.col("type"))).withColumn("group_name", name)


def valid(variables: DataFrame) -> DataFrame:
    bad = F.col("units").isin(*IGNORED_UNITS)
    for t in IGNORED_TYPES:
        bad |= F.col("type").contains(t)
    return variables.where(~F.coalesce(bad, F.lit(False)))


def totals(ds: Dataset) -> Dataset:
    """Means (intensive units) or sums of groups of variables, table by table.
    Simple tables and variables of text are left out; ids run from 1."""
    head = grouped(valid(ds.variables.where("not is_simple")))
    head = head.join(ds.texts.select("file_id", "table", "id").distinct(), ["file_id", "table", "id"], "left_anti")
    keys = ["file_id", "table", "group_name", "group_key", "group_type", "units"]
    groups = head.groupBy(*keys).agg(F.min("table_pos").alias("table_pos"), F.min("pos").alias("pos"))
    # metadata: a row a group
    order = Window.partitionBy("file_id").orderBy("table_pos", "table", "pos")
    groups = groups.withColumn("new_id", F.row_number().over(order))
    if groups.limit(1).count() == 0:
        raise NoResults("no variables to make totals of")
    of = head.select("file_id", "table", "id", *keys[2:]).join(groups.select(*keys, "new_id"), keys)
    averaged = F.col("units").isin(*AVERAGED_UNITS)
    made = ds.results.join(ds.with_size(of), ["file_id", "table", "id"]).groupBy("file_id", "table", "new_id", "row_ix", "ts").agg(F.avg("value").alias("mean"), F.sum("value").alias("sum"), F.max(averaged).alias("averaged"))
    results = made.select("file_id", "table", F.col("new_id").alias("id"), "row_ix", "ts", F.when(F.col("averaged"), F.col("mean")).otherwise(F.coalesce("sum", F.lit(0.0))).alias("value"))
    variables = groups.select("file_id", "table", "table_pos", F.col("new_id").alias("id"), F.col("pos").cast("int").alias("pos"), F.lit(False).alias("is_simple"), F.col("group_key").alias("key"), F.col("group_type").alias("type"), "units")
    live = variables.select("file_id", "table").distinct()
    files = ds.files.withColumn("file_name", F.concat("file_name", F.lit(" - totals"))).withColumn("file_type", F.lit("totals"))
    return Dataset.of(ds.spark, files=files, variables=variables, results=results, steps=ds.steps.join(live, ["file_id", "table"], "left_semi"))


def diff(ds: Dataset, first: int, second: int, file_id: int = 0) -> Dataset:
    """File `first` minus file `second`: rows and variables of both, in tables of
    one kind; variables without a difference left go. Ids run from 0. Special
    columns stay if both files have them equal on the shared rows."""
    a, b = ds.file(first), ds.file(second)
    level = ("table", "is_simple", "key", "type", "units")
    # headers are metadata; pairs and ids are made of what has been read
    other: dict[tuple, list[int]] = {}
    for r in b.header():
        other.setdefault(tuple(r[c] for c in level), []).append(r["id"])
    pairs = [(r, i) for r in a.header() for i in other.get(tuple(r[c] for c in level), [])]
    small = len(pairs) <= 1_000_000
    ids = ds.spark.createDataFrame([(r["table"], r["id"], i) for r, i in pairs], "table string, id int, id_b int")
    ra = a.results.select("table", "id", "row_ix", "ts", F.col("value").alias("x")).withColumn("at", row_key("ts", "row_ix"))
    rb = b.results.select("table", F.col("id").alias("id_b"), row_key("ts", "row_ix").alias("at"), F.col("value").alias("y"))
    rows = ra.join(F.broadcast(ids) if small else ids, ["table", "id"]).join(rb, ["table", "id_b", "at"]).select("table", "id", "id_b", "row_ix", "ts", (F.col("x") - F.col("y")).alias("value"))
    live = {(r["table"], r["id"], r["id_b"]) for r in rows.where("value is not null").select("table", "id", "id_b").distinct().collect()}
    kept = [(n, r, i) for n, (r, i) in enumerate((r, i) for r, i in pairs if (r["table"], r["id"], i) in live)]
    if not kept:
        raise NoResults("the files share no variables and rows")
    new = ds.spark.createDataFrame([(r["table"], r["id"], i, n) for n, r, i in kept], "table string, id int, id_b int, new_id int")
    results = rows.join(F.broadcast(new) if small else new, ["table", "id", "id_b"]).select(F.lit(file_id).alias("file_id"), "table", F.col("new_id").alias("id"), "row_ix", "ts", "value")
    variables = ds.spark.createDataFrame([(file_id, r["table"], r["table_pos"], n, r["pos"], r["is_simple"], r["key"], r["type"], r["units"]) for n, r, _ in kept], model.VARIABLES)
    tables = ds.spark.createDataFrame([(t,) for t in sorted({r["table"] for _, r, _ in kept})], "table string")
    named = {r["file_id"]: r["file_name"] for r in ds.files.where(F.col("file_id").isin(first, second)).collect()}
    name = f"{named.get(first)} - {named.get(second)} - diff"
    files = ds.files.where(F.col("file_id") == first).withColumn("file_id", F.lit(file_id)).withColumn("file_name", F.lit(name)).withColumn("file_type", F.lit("diff"))
    return Dataset.of(ds.spark, files=files, variables=variables, results=results, steps=shared_steps(a, b, tables, file_id))


def row_key(ts: str, row_ix: str) -> Column:
    """What rows of two files are matched by: the stamp, else the place."""
    return F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.col(row_ix))


def special_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether special columns of two files agree on the rows that both have:
    `(table, rows, day, n_days)`."""
    x = a.select("table", row_key("ts", "row_ix").alias("at"), "day", "n_days")
    y = b.select("table", row_key("ts", "row_ix").alias("at"), F.col("day").alias("day_b"), F.col("n_days").alias("n_days_b"))
    same = lambda c: (F.count_if(~F.col(c).eqNullSafe(F.col(f"{c}_b"))) == 0).alias(c)
    return x.join(y, ["table", "at"]).groupBy("table").agg(F.count("*").alias("rows"), same("day"), same("n_days"))


def shared_steps(a: Dataset, b: Dataset, tables: DataFrame, file_id: int) -> DataFrame:
    agree = special_equal(a.steps, b.steps).select("table", F.col("day").alias("__d"), F.col("n_days").alias("__n"))
    there = b.steps.select("table", row_key("ts", "row_ix").alias("__at"))
    rows = a.steps.withColumn("__at", row_key("ts", "row_ix")).join(there, ["table", "__at"], "left_semi").join(tables, "table", "left_semi").join(agree, "table")
    return rows.withColumn("file_id", F.lit(file_id)).withColumn("day", F.when(F.col("__d"), F.col("day"))).withColumn("n_days", F.when(F.col("__n"), F.col("n_days"))).select(*a.steps.columns)
