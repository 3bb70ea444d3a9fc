"""Selected medians against sorted values."""

import random

import pytest
from pyspark.sql import functions as F

from gridlark.operators import aggregate
from gridlark.operators.median import medians


def middle(values):
    values = sorted(values)
    return (None, None) if not values else (values[(len(values) - 1) // 2], values[len(values) // 2])


def test_small_groups(spark):
    rng = random.Random(5)
    groups = {"ties": [1.0] * 40 + [2.0] * 41, "even": [1.0, 2.0, 4.0, 8.0], "one": [-0.5], "far": [1e300, -1e300, 1e-300, 0.0, 5.0], "none": [None, None], None: [3.0, None, 9.0]}
    groups |= {f"g{n}": [rng.gauss(0, 1) for _ in range(rng.randrange(1, 400))] for n in range(30)}
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    rng.shuffle(rows)
    out = {r["k"]: r for r in medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert set(out) == set(groups)
    for k, vs in groups.items():
        known = [v for v in vs if v is not None]
        a, b = middle(known)
        assert (out[k]["n"], out[k]["lower"], out[k]["upper"]) == (len(known), a, b)
        assert out[k]["median"] == (None if a is None else a if a == b else a * 0.5 + b * 0.5)


def test_nan_is_largest_and_no_rows(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("a", 2.0)], "k string, v double")
    assert medians(df, ["k"], "v").first()["median"] == 2.0
    assert medians(df.where("false"), ["k"], "v").count() == 0


@pytest.mark.parametrize(("shape", "rows"), [("v * v", 2_000_001), ("floor(v * 3)", 100_000), ("case when v < 0.7 then 7 else v end", 100_001)])
def test_a_million_values_a_group(spark, shape, rows):
    df = spark.range(rows).select((F.col("id") % 2).alias("k"), (F.xxhash64("id") / 2.0**64 + 0.5).alias("v")).select("k", F.expr(f"cast({shape} as double)").alias("v")).persist()
    want = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert {r["k"]: r["median"] for r in medians(df, ["k"], "v").collect()} == want
    df.unpersist()


def test_median_of_a_row_is_the_same_either_way(spark):
    rows = [(0, "t", i, r, float((i * 7 + r) % 13)) for i in range(11) for r in range(9)]
    df = spark.createDataFrame(rows, "file_id int, table string, id int, row_ix long, value double").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    plain, passes = (sorted((r["row_ix"], r["value"]) for r in aggregate.row_wise(df, "median", n).collect()) for n in (11, None))
    assert plain == passes
