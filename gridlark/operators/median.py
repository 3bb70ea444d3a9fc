"""Exact medians of groups of any size, without a group in one buffer.

Three passes: a sketch of each group gives cuts that lie close about its middle; the
values between two cuts are counted, exactly, which says between which cuts the middle
values lie; those values alone are counted one by one and picked from. The sketch decides
how many values the last pass has (about a thousandth of a group), never which are picked.
Each pass combines before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Shares of a group at which it is cut.
CUTS = (0.05, 0.25, 0.4, 0.47, 0.49, 0.495, 0.498, 0.499, 0.4995, 0.5005, 0.501, 0.502, 0.505, 0.51, 0.53, 0.6, 0.75, 0.95)
_ACCURACY = 10_000


def medians(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """`by`, `n` (values that are not null), `lower` and `upper` (the two middle values,
    equal where n is odd) and `median` (their mean) of each group.

    Groups without a value have n 0 and nulls; null keys are a group. NaN counts as larger
    than any number. No rows give no rows. Names that begin with `__` are the function's.
    """
    keys = [F.col(c).alias(f"__{i}") for i, c in enumerate(by)]
    on = [f"__{i}" for i in range(len(by))]
    rows = df.select(*keys, F.col(value).cast("double").alias("__v"))
    cuts = rows.groupBy(*on).agg(F.count("__v").alias("__n"), F.percentile_approx("__v", list(CUTS), _ACCURACY).alias("__cuts"))
    cuts = cuts.withColumn("__cuts", F.array_distinct(F.coalesce("__cuts", F.array().cast("array<double>"))))
    # a bin is the number of cuts that a value has reached
    left, right = rows.where("__v is not null").alias("l"), cuts.alias("r")
    placed = left.join(right, _same(on), "left").select(*[F.col(f"l.{c}") for c in on], "__v", F.size(F.filter("__cuts", lambda c: c <= F.col("__v"))).alias("__bin"))
    counts = placed.groupBy(*on, "__bin").agg(F.count("*").alias("__k"))
    # bins are few, so a group's counts are one small array
    counts = counts.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("__bin", "__k"))).alias("__bins"), F.sum("__k").alias("__n"))
    first, last = F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)
    upto = F.transform("__bins", lambda b: F.struct(b["__bin"].alias("bin"), F.aggregate(F.filter("__bins", lambda x: x["__bin"] < b["__bin"]), F.lit(0).cast("long"), lambda s, x: s + x["__k"]).alias("below"), b["__k"].alias("k")))
    holds = lambda rank: F.filter("__upto", lambda b: (b["below"] <= rank) & (rank < b["below"] + b["k"]))[0]
    middle = counts.withColumn("__upto", upto).select(*on, first.alias("__first"), last.alias("__last"), holds(first).alias("__a"), holds(last).alias("__b"))
    middle = middle.select(*on, "__first", "__last", F.col("__a.bin").alias("__low"), F.col("__b.bin").alias("__high"), F.col("__a.below").alias("__below"))
    near = placed.alias("l").join(middle.alias("r"), _same(on), "inner").where("__bin between __low and __high")
    near = near.groupBy(*[F.col(f"l.{c}").alias(c) for c in on], "__first", "__last", "__below", "__v").agg(F.count("*").alias("__k"))
    upto = F.sum("__k").over(Window.partitionBy(*on).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = near.withColumn("__end", F.col("__below") + upto)
    pick = lambda rank: F.min(F.when(F.col("__end") > F.col(rank), F.col("__v")))
    picked = near.groupBy(*on).agg(pick("__first").alias("lower"), pick("__last").alias("upper"))
    out = cuts.alias("l").join(picked.alias("r"), _same(on), "left")
    # halves are added, so that the mean of two large values is no infinity
    mean = F.when(F.col("lower") == F.col("upper"), F.col("lower")).otherwise(F.col("lower") * 0.5 + F.col("upper") * 0.5)
    return out.select(*[F.col(f"l.{c}").alias(name) for c, name in zip(on, by, strict=True)], F.col("__n").alias("n"), "lower", "upper", mean.alias("median"))


def _same(on: list[str]) -> Column:
    out = F.lit(True)
    for c in on:
        out &= F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return out
