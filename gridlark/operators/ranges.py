"""Running sums over all rows of a table without one task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running(df: DataFrame, order: Sequence[str], amount: str, at: str, out: str = "before", per_range: int = 1_000_000) -> DataFrame:
    """`df` with `out`: the sum of the long column `amount` over all rows before, in the
    order of the columns `order`, which tell all rows apart.

    Rows are dealt to ranges of about `per_range` rows and written below the folder `at`,
    which the caller deletes. A range is summed up by a task of its own, the ranges' totals
    (a row each) by one. Rows that make one range only are not written.
    """
    parts = -(-df.count() // per_range)
    if parts <= 1:
        return df.withColumn(out, F.sum(amount).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(amount))
    df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()).write.parquet(f"{at}/ranges")
    placed = df.sparkSession.read.parquet(f"{at}/ranges")
    upto = lambda w: F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(amount)
    inside = placed.withColumn("__here", upto(Window.partitionBy("__range").orderBy(*order)))
    totals = placed.groupBy("__range").agg(F.sum(amount).alias(amount)).withColumn("__first", upto(Window.orderBy("__range"))).drop(amount)
    return inside.join(F.broadcast(totals), "__range").withColumn(out, F.col("__here") + F.col("__first")).drop("__range", "__here", "__first")
