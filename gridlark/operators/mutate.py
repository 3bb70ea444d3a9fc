"""Changes of header and values; each gives a new Dataset."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.dataset import Dataset
from gridlark.functions.naming import ids as free_ids
from gridlark.functions.naming import unique_name
from gridlark.model import SimpleVariable, Variable
from gridlark.operators import lookup

log = logging.getLogger(__name__)
FIRST_NEW_ID = 100


def _one_file(ds: Dataset) -> int:
    found = [r["file_id"] for r in ds.files.select("file_id").limit(2).collect()]
    if len(found) != 1:
        raise ValueError("the change needs a Dataset of one file")
    return found[0]


def insert_variable(ds: Dataset, variable: Variable | SimpleVariable, rows: DataFrame) -> tuple[Dataset, int, Variable | SimpleVariable] | None:
    """Add a variable with values `(row_ix, value)`, one a step of its table.

    A key that is taken gets a number; the id is the first free one from 100. A
    wrong number of rows is a warning and changes nothing.
    """
    file_id, table = _one_file(ds), variable.table
    head = [r for r in ds.header() if r["table"] == table]
    if not head:
        raise KeyError(f"no table {table}")
    simple = head[0]["is_simple"]
    if simple != isinstance(variable, SimpleVariable):
        raise TypeError(f"table {table} takes {'SimpleVariable' if simple else 'Variable'}")
    n_steps, n_rows = ds.steps.where(F.col("table") == table).count(), rows.count()
    if n_rows != n_steps:
        log.warning("table %s has %s rows, not %s", table, n_steps, n_rows)
        return None
    kind = getattr(variable, "type", None)
    taken = {(r["key"] or "").lower() for r in head if ((r["type"] or "").lower(), (r["units"] or "").lower()) == ((kind or "").lower(), (variable.units or "").lower())}
    key = variable.key
    if key.lower() in taken:
        key = key + unique_name(key.lower(), taken)[len(key) :]
    new_id = next(free_ids(FIRST_NEW_ID, {r["id"] for r in ds.header()}))
    new = variable._replace(key=key)
    entry = ds.spark.createDataFrame([(file_id, table, head[0]["table_pos"], new_id, max(r["pos"] for r in head) + 1, simple, key, kind, variable.units)], ds.variables.schema)
    steps = ds.steps.where(F.col("table") == table).select("row_ix", "ts")
    values = rows.select("row_ix", F.col("value").cast("double").alias("value")).join(steps, "row_ix").select(F.lit(file_id).alias("file_id"), F.lit(table).alias("table"), F.lit(new_id).alias("id"), "row_ix", "ts", "value")
    return replace(ds, variables=ds.variables.unionByName(entry), results=ds.results.unionByName(values)), new_id, new


def insert_special(ds: Dataset, table: str, name: str, rows: DataFrame) -> Dataset:
    """Add or replace a special column of a table by `(row_ix, value)`."""
    if rows.count() != ds.steps.where(F.col("table") == table).count():
        log.warning("the special column %s doesn't fit table %s", name, table)
        return ds
    new = rows.select(F.lit(table).alias("table"), "row_ix", F.col("value").alias("__v"))
    steps = ds.steps.join(new, ["table", "row_ix"], "left")
    kind = ds.steps.schema[name].dataType if name in ds.steps.columns else rows.schema["value"].dataType
    old = F.col(name) if name in ds.steps.columns else F.lit(None)
    steps = steps.withColumn(name, F.when(F.col("table") == table, F.col("__v").cast(kind)).otherwise(old.cast(kind))).drop("__v")
    return replace(ds, steps=steps.select(*ds.steps.columns, *([] if name in ds.steps.columns else [name])))


def update_values(ds: Dataset, table: str, variable_id: int, rows: DataFrame) -> Dataset:
    """Replace the values of a variable by `(row_ix, value)`."""
    if variable_id not in ds.ids(table):
        raise KeyError(f"no variable {variable_id} in {table}")
    if rows.count() != ds.steps.where(F.col("table") == table).count():
        log.warning("the values don't fit table %s", table)
        return ds
    own = (F.col("table") == table) & (F.col("id") == variable_id)
    file_id = _one_file(ds)
    steps = ds.steps.where(F.col("table") == table).select("row_ix", "ts")
    new = rows.select("row_ix", F.col("value").cast("double").alias("value")).join(steps, "row_ix").select(F.lit(file_id).alias("file_id"), F.lit(table).alias("table"), F.lit(variable_id).alias("id"), "row_ix", "ts", "value")
    return replace(ds, results=ds.results.where(~own).unionByName(new))


def rename_variable(ds: Dataset, variable: Variable | SimpleVariable, new_key: str | None = None, new_type: str | None = None) -> tuple[Dataset, int, Variable | SimpleVariable]:
    if new_key is None and new_type is None:
        raise ValueError("a new key or a new type is needed")
    found = lookup.find_ids(ds, variable)
    if len(found) != 1:
        raise KeyError(f"{variable} matches {len(found)} variables, not one")
    [i] = found
    row = next(r for r in ds.header() if r["id"] == i and r["table"].lower() == variable.table.lower())
    old = ds.variable(row)
    key = row["key"] if new_key is None else new_key
    kind = row["type"] if new_type is None or row["is_simple"] else new_type
    if (key, kind) == (row["key"], row["type"]):
        return ds, i, old
    taken = {(r["key"] or "").lower() for r in ds.header() if r["table"] == row["table"] and r["id"] != i and (r["type"], r["units"]) == (kind, row["units"])}
    if key.lower() in taken:
        key = key + unique_name(key.lower(), taken)[len(key) :]
    own = (F.col("table") == row["table"]) & (F.col("id") == i)
    variables = ds.variables.withColumn("key", F.when(own, F.lit(key)).otherwise(F.col("key"))).withColumn("type", F.when(own, F.lit(kind)).otherwise(F.col("type")))
    new = SimpleVariable(row["table"], key, row["units"]) if row["is_simple"] else Variable(row["table"], key, kind, row["units"])
    return replace(ds, variables=variables), i, new


def remove_variables(ds: Dataset, variables: Sequence[Variable | SimpleVariable | int]) -> Dataset:
    """Remove what is matched; a request that matches nothing changes nothing, an
    unknown id is a KeyError."""
    by_table = lookup.table_ids(ds, variables)
    pairs = [(t, i) for t, ids in by_table.items() for i in set(ids)]
    if not pairs:
        return ds
    gone = F.broadcast(ds.spark.createDataFrame(pairs, "table string, id int"))  # a row a removed header entry
    less = lambda df: df.join(gone, ["table", "id"], "left_anti").select(*df.columns)
    return replace(ds, variables=less(ds.variables), results=less(ds.results), texts=less(ds.texts), peaks=less(ds.peaks))


def rename_file(ds: Dataset, name: str) -> Dataset:
    return replace(ds, files=ds.files.withColumn("file_name", F.lit(name)))


def drop_table(ds: Dataset, table: str) -> Dataset:
    less = lambda df: df.where(F.col("table") != table)
    return replace(ds, variables=less(ds.variables), steps=less(ds.steps), results=less(ds.results), texts=less(ds.texts), peaks=less(ds.peaks))


def replace_table(ds: Dataset, other: Dataset, table: str) -> Dataset:
    return extend(drop_table(ds, table), other.table(table))


def extend(ds: Dataset, other: Dataset) -> Dataset:
    """Add the tables of another Dataset to the file."""
    file_id = _one_file(ds)
    own = lambda df: df.withColumn("file_id", F.lit(file_id))
    return replace(ds, **{k: getattr(ds, k).unionByName(own(getattr(other, k)), allowMissingColumns=True) for k in ("variables", "steps", "results", "texts", "peaks")})


def equal(a: Dataset, b: Dataset, relative: float = 1e-5, absolute: float = 1e-8) -> bool:
    """Same tables, headers (ids aside, any order), rows and values, the latter
    up to a tolerance."""
    level = ["table", "is_simple", "key", "type", "units"]
    ha, hb = (sorted(tuple(r[c] if r[c] is not None else "" for c in level) for r in x.header()) for x in (a, b))
    if ha != hb:
        return False

    def named(x: Dataset, side: str) -> DataFrame:
        head = x.variables.select("table", "id", F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in level]).alias("name"))
        at = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.col("row_ix"))
        rows = x.results.where("value is not null").select("table", "id", at.alias("at"), F.col("value").alias(side))
        return rows.join(x.with_size(head), ["table", "id"]).select("name", "at", side)

    both = named(a, "x").join(named(b, "y"), ["name", "at"], "full")
    apart = F.col("x").isNull() | F.col("y").isNull() | (F.abs(F.col("x") - F.col("y")) > absolute + relative * F.abs("y"))
    if both.where(apart).limit(1).count():
        return False
    special = lambda x: x.steps.select("table", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.col("row_ix")).alias("at"), "day", "n_days")
    s, t = special(a), special(b)
    return s.exceptAll(t).limit(1).count() == 0 and t.exceptAll(s).limit(1).count() == 0
