"""Aggregation over variables, row by row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.dataset import Dataset
from gridlark.functions.units import rate_like, rate_to_energy, step_kinds
from gridlark.model import CannotAggregateVariables, SimpleVariable, Variable
from gridlark.operators import fetch, lookup, mutate
from gridlark.operators.median import medians


def _ordered(pick) -> Callable[[Column], Column]:
    return lambda v: pick(F.when(v.isNotNull(), v), F.when(v.isNotNull(), F.col("ord")))


#: Named functions; nulls are left out, the sum of none is 0 and the product 1.
NAMED: dict[str, Callable[[Column], Column]] = {
    "sum": lambda v: F.coalesce(F.sum(v), F.lit(0.0)),
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "median": F.median,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "count": lambda v: F.count(v).cast("double"),
    "prod": lambda v: F.coalesce(F.product(v), F.lit(1.0)),
    "first": _ordered(F.min_by),
    "last": _ordered(F.max_by),
}


#: Variables up to which the median of a row is taken from one buffer.
MEDIAN_BUFFER = 100_000


def row_wise(df: DataFrame, func: str | Callable, variables: int | None = None) -> DataFrame:
    """`(file_id, table, row_ix, ts, value)` over the variables of long rows. `variables` is
    how many there are, where it is known; medians of many or of an unknown number are
    selected in passes instead of from a buffer, and are the same."""
    by = ["file_id", "table", "row_ix", "ts"]
    if func == "median" and (variables is None or variables > MEDIAN_BUFFER):
        return medians(df, by).select(*by, F.col("median").alias("value"))
    if callable(func):
        # only a caller's own function runs in Python, a batch of groups at a time
        @F.pandas_udf("double")
        def own(v: pd.Series) -> float:
            return float(func(v.to_numpy()))

        return df.groupBy(*by).agg(own("value").alias("value"))
    if func not in NAMED:
        raise CannotAggregateVariables(f"no such function: {func}")
    return df.groupBy(*by).agg(NAMED[func](F.col("value")).alias("value"))


def names(rows: Sequence, func: str | Callable, new_key: str = "Custom Key", new_type: str = "Custom Type") -> tuple[str, str]:
    called = func if isinstance(func, str) else getattr(func, "__name__", "func")
    key = f"{new_key} - {called}" if new_key == "Custom Key" else new_key
    kinds = {r["type"] for r in rows}
    return key, kinds.pop() if new_type == "Custom Type" and len(kinds) == 1 else new_type


def aggregate_variables(ds: Dataset, variables, func: str | Callable, new_key: str = "Custom Key", new_type: str = "Custom Type", part_match: bool = False) -> tuple[Dataset, int, Variable | SimpleVariable]:
    """A new variable made row by row from several of one table of one file.

    Rates and energies mixed (W with J, W/m2 with J/m2) become energy first.
    """
    by_table = lookup.table_ids(ds, variables, part_match)
    if not by_table:
        raise CannotAggregateVariables("no variables found")
    if len(by_table) > 1:
        raise CannotAggregateVariables(f"variables of several tables: {list(by_table)}")
    [(table, ids)] = by_table.items()
    ids = list(dict.fromkeys(ids))
    if len(ids) == 1:
        raise CannotAggregateVariables("a single variable can't be aggregated")
    rows = [r for r in ds.header() if r["id"] in ids]
    units = {r["units"] for r in rows}
    df = fetch.values(ds, table, ids)
    if len(units) > 1:
        if not rate_like(units):
            raise CannotAggregateVariables(f"mixed units: {sorted(units)}")
        df = energy_of(ds, table, df)
        units = {u for u in units if u.startswith("J")}
    made = row_wise(df, func, len(ids))
    key, kind = names(rows, func, new_key, new_type)
    simple = rows[0]["is_simple"]
    unit = units.pop()
    new = SimpleVariable(table, key, unit) if simple else Variable(table, key, kind, unit)
    return mutate.insert_variable(ds, new, made.select("file_id", "row_ix", "ts", "value"))


def energy_of(ds: Dataset, table: str, df: DataFrame) -> DataFrame:
    """Rates of long rows as energies, by the step of the whole table."""
    kind = step_kinds(ds.steps.where(F.col("table") == table)).first()
    if kind is not None and (kind["is_timestep"] or kind["is_hourly"] or kind["is_daily"]):
        return rate_to_energy(df, kind["step_s"])
    if ds.steps.where((F.col("table") == table) & F.col("n_days").isNotNull()).limit(1).count() == 0:
        raise CannotAggregateVariables(f"the length of the steps of {table} is not known")
    return rate_to_energy(fetch.with_n_days(ds, df), None)
