"""Runs and gaps against rows written out."""

import datetime as dt
import random

from gridlark import model
from gridlark.dataset import Dataset
from gridlark.operators import fetch, gaps, lookup


def a_file(spark, steps, values):
    """Table `t` whose rows have numbers with holes; values by (id, row_ix)."""
    at = lambda r: dt.datetime(2020, 1, 1) + dt.timedelta(hours=r)
    head = [(0, "t", 0, i, i, False, f"K{i}", "T", "C") for i in range(6)]
    rows = [(0, "t", i, r, at(r), v) for (i, r), v in values.items()]
    return Dataset.of(spark, variables=spark.createDataFrame(head, model.VARIABLES), steps=spark.createDataFrame([(0, "t", r, at(r), None, None, None, None) for r in steps], model.STEPS), results=spark.createDataFrame(rows, model.RESULTS))


def shown(df):
    return sorted((r["id"], r["row_ix"], str(r["ts"]), "-" if r["value"] is None else str(r["value"])) for r in df.collect())


def test_as_rows_written_out(spark):
    rng = random.Random(3)
    steps = sorted(rng.sample(range(400), 120))
    values = {(i, r): float(r) for i in range(4) for r in steps if rng.random() < (0.97, 0.5, 1.0, 0.03)[i]}
    values |= {(4, r): None for r in steps}  # all null; 5 has no row at all
    ds = a_file(spark, steps, values)
    runs = gaps.runs(ds)
    got = {}
    for r in runs.collect():
        got.setdefault(r["id"], []).append((r["first"], r["last"], r["n"]))
    for i in range(6):
        have = [n for n, r in enumerate(steps) if values.get((i, r)) is not None]
        want = []
        for n in have:
            if want and want[-1][1] == n - 1:
                want[-1] = (want[-1][0], n, want[-1][2] + 1)
            else:
                want.append((n, n, 1))
        assert sorted(got.get(i, [])) == want
        lacks = {n for n in range(len(steps))} - set(have)
        stretches = gaps.gaps(ds, runs).where(f"id = {i}").collect()
        assert sorted(n for s in stretches for n in range(s["first"], s["last"] + 1)) == sorted(lacks)
    assert shown(gaps.filled(gaps.reported(ds), runs)) == shown(fetch.filled(ds, "t"))
    assert {r["id"]: r["n_values"] for r in gaps.counts(runs).collect()} == {i: sum(v is not None for (j, _), v in values.items() if j == i) for i in range(4)}
    live = gaps.without_empty(ds, runs)
    assert {r["id"] for r in live.header()} == {r["id"] for r in lookup.without_empty(ds).header()} == {0, 1, 2, 3}
    assert shown(live.results) == [x for x in shown(ds.results) if x[3] != "-"]


def test_no_values_no_steps(spark):
    ds = a_file(spark, [3, 9], {})
    assert gaps.runs(ds).count() == 0
    assert len(shown(gaps.filled(ds, gaps.runs(ds)))) == 12
    none = a_file(spark, [], {})
    assert shown(gaps.filled(none, gaps.runs(none))) == []
