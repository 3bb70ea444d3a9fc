"""Files in buckets: joins without an exchange, differences as those of plain files."""

import datetime as dt
import re

import pytest

from gridlark import model
from gridlark.dataset import Dataset
from gridlark.model import NoResults
from gridlark.operators import derive
from gridlark.sources.aligned import AlignedStore


def two_files(spark):
    """Table `hourly` of both files: A in both, B in both with no value shared, C in one
    only, A once more in the second file (two entries of the same levels)."""
    at = lambda h: dt.datetime(2020, 1, 1, h)
    head = [(1, "hourly", 0, 1, 0, False, "A", "T", "C"), (1, "hourly", 0, 2, 1, False, "B", "T", "C"), (1, "hourly", 0, 3, 2, False, "C", None, ""), (1, "sheet", 1, 9, 0, True, "A", None, "C")]
    head += [(2, "hourly", 0, 11, 0, False, "B", "T", "C"), (2, "hourly", 0, 12, 1, False, "A", "T", "C"), (2, "hourly", 0, 13, 2, False, "A", "T", "C"), (2, "sheet", 1, 19, 0, True, "A", None, "C")]
    rows = [(1, "hourly", i, h, at(h), float(i * h)) for i in (1, 3) for h in range(20)] + [(1, "hourly", 2, h, at(h), 1.0 if h < 10 else None) for h in range(20)]
    rows += [(2, "hourly", 11, h - 5, at(h), None if h < 10 else 2.0) for h in range(5, 23)] + [(2, "hourly", i, h - 5, at(h), float(i)) for i in (12, 13) for h in range(5, 23)]
    rows += [(f, "sheet", i, n, None, float(f * n)) for f, i in ((1, 9), (2, 19)) for n in range(4)]
    steps = [(1, "hourly", h, at(h), None, None, "Monday" if h < 10 else "Tuesday", None) for h in range(20)] + [(2, "hourly", h - 5, at(h), None, None, "Monday" if h < 10 else "Tuesday", None) for h in range(5, 23)]
    steps += [(f, "sheet", n, None, n, None, None, None) for f in (1, 2) for n in range(4)]
    files = [(1, "a", "a", None, "eso"), (2, "b", "b", None, "eso")]
    return Dataset.of(spark, files=spark.createDataFrame(files, model.FILES), variables=spark.createDataFrame(head, model.VARIABLES), steps=spark.createDataFrame(steps, model.STEPS), results=spark.createDataFrame(rows, model.RESULTS))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shown(ds):
    names = {r["id"]: (r["table"], r["key"], r["type"], r["units"]) for r in ds.header()}
    return sorted((names[r["id"]], str(r["ts"]), r["row_ix"], -1e9 if r["value"] is None else r["value"]) for r in ds.results.collect())


def test_no_exchange_and_the_same_difference(spark, tmp_path):
    ds = two_files(spark)
    box = AlignedStore(spark, f"file:{tmp_path}/s", buckets=4)
    box.store(ds, 1)
    box.store(ds, 2)
    both = box.aligned(1, 2)
    assert "SortMergeJoin" in plan(both) and "Exchange" not in plan(both)
    full = box.aligned(1, 2, "full")
    assert not re.search("Exchange", plan(full))
    # A meets both entries of A on 15 rows, B one of B on 15, the sheet's A its own on 4
    assert both.count() == 15 * 2 + 15 + 4
    assert full.count() == 49 + (20 - 15) * 2 + 20 + (18 - 15) * 3
    want, got = derive.diff(ds, 1, 2), box.diff(1, 2, 5)
    assert shown(got) == shown(want) and len(shown(got)) == 34
    assert sorted(map(str, got.steps.drop("file_id").collect())) == sorted(map(str, want.steps.drop("file_id").collect()))
    assert got.files.first()["file_name"] == want.files.first()["file_name"] == "a - b - diff"
    assert "B" not in {r["key"] for r in got.header()}
    # a difference is a file like any
    assert box.aligned(5, 1).count() == 15 * 2 + 15 + 4


def test_another_session_and_a_change(spark, tmp_path):
    ds = two_files(spark)
    box = AlignedStore(spark, f"file:{tmp_path}/s", buckets=4)
    box.store(ds, 1)
    want = shown(box.dataset(1))
    spark.sql(f"drop table {box.name}_1")
    again = AlignedStore(spark, f"file:{tmp_path}/s", buckets=4)
    assert shown(again.dataset(1)) == want == shown(ds.file(1))
    box.store(Dataset.of(spark, files=ds.files, variables=ds.variables, steps=ds.steps, results=ds.results.where("row_ix < 3")), 1)
    assert len(shown(box.dataset(1))) == 3 * 3 + 3
    with pytest.raises(KeyError):
        box.dataset(8)
    with pytest.raises(KeyError):
        AlignedStore(spark, f"file:{tmp_path}/s", buckets=8).rows(1)


def test_nothing_shared(spark, tmp_path):
    ds = two_files(spark)
    box = AlignedStore(spark, f"file:{tmp_path}/s", buckets=2)
    box.store(ds.table("sheet"), 1)
    box.store(ds.table("hourly"), 2)
    with pytest.raises(NoResults):
        box.diff(1, 2, 3)
    with pytest.raises(ValueError):
        box.diff(1, 2, 2)
