import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F
from simulation import HEADER, value, write_eso, write_sql

from gridlark import model
from gridlark.model import Variable
from gridlark.operators import mutate
from gridlark.plans.results import get_results
from gridlark.sources import eso, reader, sheet, store


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy(*cols).collect()]


def test_statement_and_header_lines():
    assert eso.statement("Program Version,Simulator, Version 9.1.0-x, YMD=2020.05.01 12:30") == (910, dt.datetime(2020, 5, 1, 12, 30))
    assert eso.header_entry("7,1,ZONE1,Zone Mean Air Temperature [C] !Hourly") == (7, "ZONE1", "Zone Mean Air Temperature", "C", "hourly")
    assert eso.header_entry("10,9,Electricity:Facility [J] !Monthly [Value,Min]") == (10, "Meter", "Electricity:Facility", "J", "monthly")
    assert eso.header_entry("11,1,Cumulative Electricity [J] !Annual") == (11, "Cumulative Meter", "Cumulative Electricity", "J", "annual")
    assert eso.header_entry("12,1,X,Pump Power [W] !Each Call") == (12, "X", "System - Pump Power", "W", "timestep")
    with pytest.raises(model.InvalidLineSyntax):
        eso.header_entry("nothing")
    with pytest.raises(model.BlankLineError):
        eso.header_entry("  ")


def test_eso(spark, tmp_path):
    write_eso(tmp_path / "run.eso")
    [ds] = eso.read_eso(spark, str(tmp_path / "run.eso"), ignore_peaks=False)
    assert ds.table_names() == ["hourly", "daily", "monthly", "runperiod"]
    assert len(ds.header()) == len(HEADER)
    hourly = ds.steps.where("table = 'hourly'").orderBy("row_ix").collect()
    assert (len(hourly), hourly[0]["ts"], hourly[23]["ts"], hourly[0]["day"]) == (72, dt.datetime(2019, 1, 30, 1), dt.datetime(2019, 1, 31), "Wednesday")
    assert rows(ds.steps.where("table = 'monthly'"), "ts", "n_days") == [(dt.datetime(2019, 1, 30), 2), (dt.datetime(2019, 2, 1), 1)]
    assert rows(ds.steps.where("table = 'runperiod'"), "ts", "n_days") == [(dt.datetime(2019, 1, 30), 3)]
    got = {(r["id"], r["row_ix"]): r["value"] for r in ds.results.collect()}
    assert got == {(i, n): value(i, n) for i, _, _, _, t in HEADER for n in range({"hourly": 72, "daily": 3, "monthly": 2, "runperiod": 1}[t])}
    peak = ds.peaks.where("table = 'daily' and id = 9").orderBy("ts").first()
    assert (peak["min_ts"], peak["max_ts"], peak["max_value"]) == (dt.datetime(2019, 1, 30, 3), dt.datetime(2019, 1, 30, 13, 30), value(9, 0) + 1)


def test_splits_do_not_matter(spark, tmp_path):
    write_eso(tmp_path / "run.eso", days=5)
    one = eso.read_eso(spark, str(tmp_path / "run.eso"))[0]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert eso.lines(spark, str(tmp_path / "run.eso")).select("blk").distinct().count() > 5
        many = eso.read_eso(spark, str(tmp_path / "run.eso"))[0]
        assert mutate.equal(one, many)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_missing_values_and_duplicates(spark, tmp_path):
    write_eso(tmp_path / "run.eso", extra_header=[(20, "ZONE1", "Zone Mean Air Temperature", "C", "daily"), (21, "NEVER", "X", "C", "daily")], skip={(9, 1), (21, 0), (21, 1), (21, 2)})
    [ds] = eso.read_eso(spark, str(tmp_path / "run.eso"))
    head = ds.header_dict("daily")
    assert head == {9: Variable("daily", "ZONE1", "Zone Mean Air Temperature", "C"), 20: Variable("daily", "ZONE1 (1)", "Zone Mean Air Temperature", "C")}
    assert [r["value"] for r in ds.results.where("id = 9").orderBy("row_ix").collect()] == [value(9, 0), None, value(9, 2)]


def test_environments(spark, tmp_path):
    path = str(tmp_path / "run.eso")
    write_eso(path, ("DESIGN DAY", "RUN PERIOD 1"), design=("DESIGN DAY",))
    with pytest.raises(model.MultiEnvFileRequired):
        reader.load(spark, path)
    last, first = reader.load_all(spark, path)
    assert [d.files.first()["file_name"] for d in (last, first)] == ["run", "run - DESIGN DAY"]
    assert (first.table_names(), len(last.table_names())) == (["hourly", "daily"], 4)
    assert first.steps.first()["ts"].year == 2002


def test_bad_files(spark, tmp_path):
    path = str(tmp_path / "run.eso")
    write_eso(path, end=False)
    with pytest.raises(model.IncompleteFile):
        eso.read_eso(spark, path)
    text = open(path).read()
    for bad, error in (("12,x,y\nnonsense\n", model.InvalidLineSyntax), ("\n", model.BlankLineError), ("99,1.0\n", model.InvalidLineSyntax)):
        with open(path, "w") as f:
            f.write(text + bad + "End of Data\n")
        with pytest.raises(error):
            eso.read_eso(spark, path)
    with open(path, "w") as f:
        f.write("\n".join(text.splitlines()[:9]))
    with pytest.raises(model.IncompleteFile):
        eso.read_eso(spark, path)
    with pytest.raises(model.FormatNotSupported):
        reader.load(spark, "a.txt")


def test_database_equals_text(spark, tmp_path):
    envs = ("ENV A", "ENV B")
    write_eso(tmp_path / "x.eso", envs)
    write_sql(tmp_path / "x.sql", envs)
    for a, b in zip(reader.load_all(spark, str(tmp_path / "x.eso")), reader.load_all(spark, str(tmp_path / "x.sql")), strict=True):
        assert mutate.equal(a, b)
        assert a.files.first()["file_name"] == b.files.first()["file_name"]


def test_database_without_tables(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "x.sql") as db:
        db.execute("create table Time (x)")
    with pytest.raises(model.NoResults):
        reader.load(spark, str(tmp_path / "x.sql"))


TEMPLATE = """id,1,2,3,4
table,daily,daily,daily,other
key,day,A,B,A
type,,T1,T2,T1
units,,C,J,C
timestamp,,,,
2002-01-01 00:00:00,Monday,1.5,2,7

2002-01-02 00:00:00,Tuesday,2.5,,8
2002-01-02 23:59:59.7,Sunday,3.5,4,9
"""


def test_csv_template(spark, tmp_path):
    (tmp_path / "a.csv").write_text(TEMPLATE)
    ds = reader.load(spark, str(tmp_path / "a.csv"))
    assert ds.table_names() == ["daily", "other"]
    assert ds.header_dict() == {1: Variable("daily", "A", "T1", "C"), 2: Variable("daily", "B", "T2", "J"), 3: Variable("other", "A", "T1", "C")}
    assert rows(ds.steps.where("table = 'daily'"), "ts", "day")[-1] == (dt.datetime(2002, 1, 3), "Sunday")
    assert [r["value"] for r in ds.results.where("id = 2").orderBy("row_ix").collect()] == [2.0, None, 4.0]
    sheet.write_csv(ds, str(tmp_path / "out"))
    import glob

    [part] = glob.glob(str(tmp_path / "out/other/*.txt"))
    again = sheet.read_csv(spark, part)
    assert [r["value"] for r in again.results.orderBy("row_ix").collect()] == [7.0, 8.0, 9.0]


def test_csv_shapes(spark, tmp_path):
    def load(text, **options):
        (tmp_path / "b.csv").write_text(text)
        return sheet.read_csv(spark, str(tmp_path / "b.csv"), **options)

    two = load("A;B;A\nC;J;C\n1;x;1\n2;y;2\n")
    assert two.levels("b") == ("id", "table", "key", "units") and len(two.header()) == 2
    assert two.texts.count() == 2 and rows(two.steps, "range_ix") == [(0,), (1,)]
    three = load("i,A,B\ni,T,U\ni,C,J\n10,1,2\n20,3,4\n30,5,6\n", force_index=True)
    assert rows(three.steps, "range_ix") == [(10,), (20,), (30,)]
    with pytest.raises(model.InsuficientHeaderInfo):
        load("A,B\n1,2\n")
    with pytest.raises(model.InsuficientHeaderInfo):
        load("a,b\nc,d\ne,f\ng,h\n1,2\n")
    with pytest.raises(model.NoResults):
        load(",,\n,,\n")


def test_workbook_frames(spark):
    book = {"s": pd.DataFrame([["key", "A", "B"], ["units", "C", "J"], ["range", None, None], [1, 2, 3], [2, 4, 5]]), "empty": pd.DataFrame(), "t": pd.DataFrame([["A", "B"], ["C", "J"], [1, 2], [3, 4]])}
    ds = sheet.from_frames(spark, "x.xlsx", book)
    assert ds.table_names() == ["s", "t"] and ds.ids() == [1, 2, 3, 4]
    with pytest.raises(model.NoResults):
        sheet.from_frames(spark, "x.xlsx", {"a": pd.DataFrame()})


def test_storage(spark, tmp_path):
    write_eso(tmp_path / "run.eso")
    [ds] = eso.read_eso(spark, str(tmp_path / "run.eso"), ignore_peaks=False)
    box = store.Storage(spark, str(tmp_path / "box"))
    assert (box.store(ds), box.store(mutate.rename_file(ds, "b"))) == (0, 1)
    assert box.names() == {0: "run", 1: "b"} and box.parts(0) > 0
    assert mutate.equal(box.load(0), ds)
    with pytest.raises(OSError):
        box.save_as(str(tmp_path / "box.zip"))
    with pytest.raises(FileNotFoundError):
        box.save()
    box.save_as(str(tmp_path / "box.cfs"))
    other = store.load_storage(spark, str(tmp_path / "box.cfs"), str(tmp_path / "other"))
    assert mutate.equal(other.load(1), ds)
    assert box.merge_with(other) == {0: 2, 1: 3} and set(box.names().values()) == {"run", "b", "run (1)", "b (1)"}
    box.delete(0)
    with pytest.raises(KeyError):
        box.load(0)
    store.save_file(ds, str(tmp_path / "run.cff"))
    assert mutate.equal(reader.load(spark, str(tmp_path / "run.cff")), ds)
    import glob
    import os

    os.remove(glob.glob(str(tmp_path / "other/results/file_id=0/table=hourly/*.parquet"))[0])
    with pytest.raises(model.CorruptedData):
        other.load(0)


def test_totals_and_diff_of_files(spark):
    book = {"s": pd.DataFrame([["key", "A", "B"], ["type", "Fan Power", "Fan Power"], ["units", "W", "W"], ["range", None, None], [1, 2, 3], [2, 4, 5]])}
    a, b = (sheet.from_frames(spark, f"{x}.xlsx", book) for x in "ab")
    assert [r["value"] for r in reader.from_totals(a).results.orderBy("row_ix").collect()] == [2.5, 4.5]
    less = reader.from_diff(a, b)
    assert less.results.count() == 4 and less.results.agg(F.max(F.abs("value"))).first()[0] == 0
    assert less.ids() == [0, 1]
    with pytest.raises(model.NoResults):
        reader.from_diff(a, mutate.drop_table(b, "s"))


def test_results_of_a_path(spark, tmp_path):
    write_eso(tmp_path / "a.eso")
    out = get_results(str(tmp_path / "a.eso"), Variable("daily", None, None, None), loader=lambda p, **o: reader.load(spark, p, **o))
    assert [round(r[2], 3) for r in out.orderBy("timestamp").collect()] == [value(9, n) for n in range(3)]


def test_files_of_a_session(spark, tmp_path):
    from gridlark.sources.files import Files

    files, root = Files(spark), f"file:{tmp_path}/a"
    files.write(f"{root}/x/y.txt", b"one")
    files.write(f"{root}/x/y.txt", b"two")
    assert files.read(f"{root}/x/y.txt") == b"two" and files.names(f"{root}/x") == ["y.txt"]
    files.move(f"{root}/x", f"{root}/z")
    files.copy(f"{root}/z/y.txt", f"{root}/w.txt")
    assert [p.rsplit("/", 1)[-1] for p in files.walk(root)] == ["w.txt", "y.txt"] and files.names(f"{root}/x") == []
    files.delete(root)
    assert not files.exists(root)


def test_text_file_in_parts(spark, tmp_path):
    """A folder of parts reads like the one file that they are."""
    from simulation import write_eso

    from gridlark.sources import reader

    write_eso(tmp_path / "one.eso")
    lines = (tmp_path / "one.eso").read_text().splitlines()
    (tmp_path / "parts.eso").mkdir()
    for n, a in enumerate(range(0, len(lines), 37)):
        (tmp_path / "parts.eso" / f"part-{n:03}.txt").write_text("\n".join(lines[a : a + 37]) + "\n")
    rows = lambda p: sorted(map(str, reader.load(spark, str(tmp_path / p)).results.select("table", "id", "row_ix", "ts", "value").collect()))
    assert rows("one.eso") == rows("parts.eso")


def test_sheet_in_splits(spark, tmp_path):
    """Rows keep their places however the file is cut."""
    from gridlark.sources import reader

    rows = ["key,A,B", "type,x,y", "units,J,W", "range,,"] + [f"{i},{i * 2},{i * 3}" for i in range(3000)]
    (tmp_path / "s.csv").write_text("\n".join(rows) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        ds = reader.load(spark, str(tmp_path / "s.csv"))
        assert ds.steps.where("row_ix <> range_ix").count() == 0 and ds.steps.count() == 3000
        assert ds.results.where("id = 1 and value <> row_ix * 2").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
