"""Many result text files at once: the same as one by one, in as many jobs for any number."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from simulation import write_eso

from gridlark import model
from gridlark.sources import eso, eso_files


def rows(df, *cols):
    return sorted(str(tuple(r[c] for c in cols)) for r in df.collect())


COLUMNS = {"variables": ("table", "table_pos", "id", "pos", "key", "type", "units"), "steps": ("table", "row_ix", "ts", "day", "n_days"), "results": ("table", "id", "row_ix", "ts", "value"), "peaks": ("table", "id", "ts", "min_value", "min_ts", "max_value", "max_ts")}


def test_files_are_as_one_by_one(spark, tmp_path):
    write_eso(tmp_path / "a.eso")
    write_eso(tmp_path / "b.eso", start=dt.datetime(2016, 2, 28), days=4, extra_header=((21, "ZONE9", "New Output", "J", "daily"),), skip={(8, 3), (9, 0)})
    write_eso(tmp_path / "c.eso", environments=("SUMMER", "RUN 1"), design=("SUMMER",))
    (tmp_path / "notes.txt").write_text("no results\n")
    many = eso_files.read_eso_files(spark, str(tmp_path), ignore_peaks=False)
    names = {r["file_id"]: (r["file_name"], r["file_created"]) for r in many.files.collect()}
    at = 0
    for f in ("a", "b", "c"):
        for one in eso.read_eso(spark, str(tmp_path / f"{f}.eso"), ignore_peaks=False):
            head = one.files.first()
            assert names[at] == (head["file_name"], head["file_created"])
            for kind, columns in COLUMNS.items():
                assert rows(getattr(many, kind).where(F.col("file_id") == at), *columns) == rows(getattr(one, kind), *columns), (f, at, kind)
            at += 1
    assert len(names) == at == 4


def test_splits_of_any_size(spark, tmp_path):
    """Step lines and environments are carried over splits and batches."""
    for i in range(3):
        write_eso(tmp_path / f"{i}.eso", environments=("A", "B"), days=5)
    want = rows(eso_files.read_eso_files(spark, str(tmp_path)).results, "file_id", *COLUMNS["results"])
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for k, v in zip(old, ("1500", "1", "7"), strict=True):
            spark.conf.set(k, v)
        assert rows(eso_files.read_eso_files(spark, str(tmp_path)).results, "file_id", *COLUMNS["results"]) == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    def jobs(n):
        (tmp_path / str(n)).mkdir()
        for i in range(n):
            write_eso(tmp_path / str(n) / f"{i}.eso", days=1)
        spark.sparkContext.setJobGroup(f"files-{n}", "files")
        eso_files.read_eso_files(spark, str(tmp_path / str(n))).results.count()
        spark.sparkContext.setJobGroup("other", "other")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"files-{n}"))

    few, many = jobs(2), jobs(24)
    assert 0 < many <= few + 2


def test_faults_name_their_file(spark, tmp_path):
    write_eso(tmp_path / "good.eso")
    write_eso(tmp_path / "short.eso", end=False)
    with pytest.raises(model.IncompleteFile, match="short.eso"):
        eso_files.read_eso_files(spark, str(tmp_path))
    text = (tmp_path / "good.eso").read_text()
    (tmp_path / "short.eso").write_text(text.replace("\n3,1,", "\n\n3,1,", 1))
    with pytest.raises(model.BlankLineError, match="short.eso"):
        eso_files.read_eso_files(spark, str(tmp_path))
    (tmp_path / "short.eso").write_text(text.replace("\n9,90", "\nnine,90", 1))
    with pytest.raises(model.InvalidLineSyntax, match="short.eso"):
        eso_files.read_eso_files(spark, str(tmp_path))
    (tmp_path / "short.eso").write_text(text.replace(" !Daily", " Daily", 1))
    with pytest.raises(model.InvalidLineSyntax, match="short.eso"):
        eso_files.read_eso_files(spark, str(tmp_path))
    with pytest.raises(model.LeapYearMismatch):
        eso_files.read_eso_files(spark, str(tmp_path / "good.eso"), year=2020)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.txt").write_text("x\n")
    with pytest.raises(model.NoResults):
        eso_files.read_eso_files(spark, str(tmp_path / "none"))
