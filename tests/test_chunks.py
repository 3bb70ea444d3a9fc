"""Versioned storage in chunks: layout, changes, failures, writers at once, summaries."""

import datetime as dt
import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from gridlark import model
from gridlark.dataset import Dataset
from gridlark.model import Variable
from gridlark.operators import mutate
from gridlark.operators.ranges import running
from gridlark.sources import chunks

T0 = dt.datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def ds(spark):
    head = [(0, t, tp, i, i, False, f"K{i}", "A", "J") for t, tp, ids in (("hourly", 0, range(1, 5)), ("text", 1, [9])) for i in ids]
    steps = [(0, "hourly", n, T0 + dt.timedelta(hours=n), None, None, None, None) for n in range(200)] + [(0, "text", n, None, n, str(n), None, None) for n in range(20)]
    values = [(0, "hourly", i, n, T0 + dt.timedelta(hours=n), None if (n + i) % 11 == 0 else float((n * 37 + i * 5) % 101)) for i in range(1, 5) for n in range(200)]
    texts = [(0, "text", 9, n, None, "x" * (5000 if n == 7 else 10)) for n in range(20)]
    files = spark.createDataFrame([(0, "/a.eso", "a", dt.datetime(2023, 1, 1), "eso")], model.FILES)
    make = spark.createDataFrame
    return Dataset.of(spark, files=files, variables=make(head, model.VARIABLES), steps=make(steps, model.STEPS), results=make(values, model.RESULTS), texts=make(texts, model.TEXTS))


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_layout_and_round_trip(spark, ds, tmp_path):
    box = chunks.ChunkStore(spark, str(tmp_path), chunk_bytes=2000, block_rows=40)
    plan = {(r["kind"], r["table"]): r["chunks"] for r in box.planned(ds).collect()}
    assert box.store(ds) == 0
    found = box.manifest(0).collect()
    made = {}
    for r in found:
        made[r["kind"], r["table"]] = made.get((r["kind"], r["table"]), 0) + 1
        assert len(glob.glob(f"{tmp_path}/{r['path']}/*.parquet")) == 1
        assert r["bytes"] <= 2000 or r["rows"] == 1  # a row is never cut
    assert made == plan and made["results", "hourly"] > 10
    assert mutate.equal(box.load(0), ds)
    assert sum(r["rows"] for r in found if r["kind"] == "results") == 800
    part = box.dataset(0, tables=["hourly"], ids=[2])
    assert part.results.count() == 200 and len(part.results.inputFiles()) < made["results", "hourly"]
    os.remove(glob.glob(f"{tmp_path}/{found[0]['path']}/*.parquet")[0])
    with pytest.raises(model.CorruptedData):
        box.load(0)


def test_small_chunks_share_tasks(spark, ds, tmp_path):
    box = chunks.ChunkStore(spark, str(tmp_path), chunk_bytes=500, block_rows=4)
    box.store(ds)
    found = [r["path"] for r in box.manifest(0).where("kind = 'results'").collect()]
    files = [glob.glob(f"{tmp_path}/{p}/part-*.parquet") for p in found]
    assert len(found) > 60 and all(len(f) == 1 for f in files)
    tasks = {os.path.basename(f).split("-")[1] for f, in files}
    assert 1 < len(tasks) <= 4 * spark.sparkContext.defaultParallelism < len(found)
    assert box.load(0).results.count() == 800


def test_changes_write_few_chunks(spark, ds, tmp_path):
    box = chunks.ChunkStore(spark, str(tmp_path), chunk_bytes=2000, block_rows=40)
    box.store(ds)
    before = rows_of(box.dataset(0, 1).results)
    new = spark.createDataFrame([(150, -7.0), (151, None)], "row_ix long, value double")
    change = box.set_values(0, "hourly", 3, new)
    assert change.version == 2 and change.written <= 2 and change.before > 20
    got = {r["row_ix"]: r["value"] for r in box.dataset(0).results.where("id = 3").collect()}
    assert got[150] == -7 and got[151] is None and len(got) == 200
    assert rows_of(box.dataset(0, 1).results) == before  # a reader of the first version sees no change
    low = box.range_summary(0, T0 + dt.timedelta(hours=149)).where("id = 3").first()
    assert (low["least"], low["least_row"], low["n_rows"]) == (-7, 150, 51)  # summaries change with their chunks
    i, put = box.put_variable(0, Variable("hourly", "NEW", "A", "J"), new)
    assert (i, put.dropped) == (10, 0) and box.dataset(0).results.where("id = 10").count() == 2
    drop = box.drop_variables(0, [2])
    assert drop.written < drop.before and box.load(0).ids() == [1, 3, 4, 10, 9]
    assert box.dataset(0).results.where("id = 2").count() == 0
    with pytest.raises(KeyError):
        box.put_variable(0, Variable("none", "X", "A", "J"), new)
    assert box.vacuum() > 0
    assert box.dataset(0).results.count() == 602 and box.vacuum() == 0
    with pytest.raises(KeyError):
        box.dataset(0, 1)


def test_failed_write_leaves_the_old_version(spark, ds, tmp_path, monkeypatch):
    box = chunks.ChunkStore(spark, str(tmp_path), chunk_bytes=4000)
    box.store(ds)
    before = rows_of(box.load(0).results)
    new = spark.createDataFrame([(1, 5.0)], "row_ix long, value double")
    for step in ("_manifest_of", "_commit"):

        def fail(*_, **__):
            raise OSError("the disk is full")

        with monkeypatch.context() as m:
            m.setattr(chunks.ChunkStore, step, fail)
            with pytest.raises(OSError, match="full"):
                box.set_values(0, "hourly", 1, new)
        assert box.version() == 1 and rows_of(box.load(0).results) == before
    box.vacuum()
    assert rows_of(box.load(0).results) == before


def test_writers_at_once(spark, ds, tmp_path):
    box = chunks.ChunkStore(spark, str(tmp_path))
    box.store(ds)
    box.copy_file(0)
    new = spark.createDataFrame([(1, 5.0)], "row_ix long, value double")
    base = box.version()
    entry = box._state()
    box.set_values(0, "hourly", 1, new)
    # another writer that began at the same version: the other file can still be changed
    assert box._commit(base, lambda s: s | {1: s[1] | {"name": "b"}}, [1]) == base + 2
    assert box.names() == {0: "a", 1: "b"} and box._state()[0] != entry[0]
    with pytest.raises(chunks.Conflict):
        box._commit(base, lambda s: s | {0: s[0] | {"name": "c"}}, [0])
    with pytest.raises(FileExistsError):
        box.files.put_new(f"{tmp_path}/versions/{base}.json", b"{}")


def test_copies_share_chunks(spark, ds, tmp_path):
    box = chunks.ChunkStore(spark, str(tmp_path / "a"), chunk_bytes=4000)
    box.store(ds)
    files = len(glob.glob(f"{tmp_path}/a/data/*/*/*/*.parquet"))
    assert box.copy_file(0) == 1 and len(glob.glob(f"{tmp_path}/a/data/*/*/*/*.parquet")) == files
    box.rename_file(1, "b")
    box.drop_variables(1, [1])
    assert box.load(0).ids() == [1, 2, 3, 4, 9] and box.load(1).ids() == [2, 3, 4, 9]
    other = box.copy_to(str(tmp_path / "b"))
    assert other.names() == {0: "a", 1: "b"} and mutate.equal(other.load(0), ds)
    assert other.merge_with(box) == {0: 2, 1: 3} and other.names() == {0: "a", 1: "b", 2: "a (1)", 3: "b (1)"}
    other.delete(0)
    assert other.load(2).results.count() == 800
    with pytest.raises(KeyError):
        other.load(0)
    shutil.move(str(tmp_path / "b"), str(tmp_path / "c"))
    assert chunks.ChunkStore(spark, str(tmp_path / "c")).load(3).results.count() == 600


def test_inner_cells_are_not_read(spark, ds, tmp_path):
    """Rows of cells inside a range are gone, and their summaries still say what they were."""
    box = chunks.ChunkStore(spark, str(tmp_path), chunk_bytes=1000, block_rows=20)
    box.store(ds)
    a, b = T0 + dt.timedelta(hours=30), T0 + dt.timedelta(hours=170)
    want = {}
    for r in ds.results.where(F.col("ts").between(F.lit(a), F.lit(b))).collect():
        want.setdefault(r["id"], []).append((r["value"], r["row_ix"], r["ts"]))
    for r in box.chunks(0, "results", rows=(60, 139)).where("row_low >= 60 and row_high < 140").collect():
        shutil.rmtree(f"{tmp_path}/{r['path']}")
    got = box.range_summary(0, a, b, tables=["hourly"]).collect()
    assert len(got) == 4
    for r in got:
        rows = want[r["id"]]
        some = [x for x in rows if x[0] is not None]
        low, high = min(some, key=lambda x: (x[0], x[1])), max(some, key=lambda x: (x[0], -x[1]))
        assert (r["n_rows"], r["n_values"], r["total"]) == (len(rows), len(some), sum(x[0] for x in some))
        assert (r["least"], r["least_row"], r["least_ts"]) == low and (r["most"], r["most_row"], r["most_ts"]) == high
    with pytest.raises(KeyError):
        box.dataset(5)


def test_running_over_ranges(spark, tmp_path):
    df = spark.range(500).select((F.col("id") * 77 % 500).alias("x"), (F.col("id") % 4).alias("w"))
    got = {r["x"]: (r["w"], r["before"]) for r in running(df, ["x"], "w", str(tmp_path), per_range=90).collect()}
    total = 0
    for x in range(500):
        assert got[x][1] == total
        total += got[x][0]


def test_empty_file(spark, ds, tmp_path):
    box = chunks.ChunkStore(spark, str(tmp_path))
    box.store(Dataset.of(spark, files=ds.files))
    assert box.load(0).results.count() == 0 and box.manifest(0).count() == 0
    assert box.range_summary(0).count() == 0
