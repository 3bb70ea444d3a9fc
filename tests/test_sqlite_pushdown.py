"""Comparisons and columns in the statements to databases."""

import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from simulation import write_sql

from gridlark.sources import sqlite


def a_reader(path, **options):
    columns = "TimeIndex int, ReportDataDictionaryIndex int, Value double"
    return sqlite._Reader(T._parse_datatype_string(columns), {"path": str(path), "table": "ReportData", "rows": "1000", **options})


def test_statements(spark, tmp_path):
    write_sql(tmp_path / "x.sql")
    r = a_reader(tmp_path / "x.sql", **{"range.TimeIndex": "11,30", "in.ReportDataDictionaryIndex": "7,9"})
    sql, values = r.statement(sqlite._Rows(1, 99))
    assert sql == 'select "TimeIndex", "ReportDataDictionaryIndex", "Value" from "ReportData" where rowid between ? and ? and "TimeIndex" between ? and ? and "ReportDataDictionaryIndex" in (?, ?)'
    assert values == [1, 99, 11, 30, 7, 9]
    many = a_reader(tmp_path / "x.sql", **{"in.ReportDataDictionaryIndex": ",".join(map(str, range(2000)))})
    assert many.tests == [] and a_reader(tmp_path / "x.sql", **{"in.TimeIndex": ""}).statement(sqlite._Rows(1, 2))[0].endswith('"TimeIndex" in ()')
    with sqlite3.connect(tmp_path / "x.sql") as db:
        every = r._bounds(db)
        assert every == ('select min(rowid), max(rowid) from "ReportData"', [])
        db.execute("create index at on ReportData (TimeIndex)")
        low, high = db.execute(*r._bounds(db)).fetchone()
        want = db.execute("select min(rowid), max(rowid) from ReportData where TimeIndex between 11 and 30 and ReportDataDictionaryIndex in (7, 9)").fetchone()
    assert (low, high) == want and [(p.low, p.high) for p in r.partitions()] == [want]
    found = [b.to_pydict() for b in r.read(r.partitions()[0])]
    assert {t for b in found for t in b["TimeIndex"]} <= set(range(11, 31)) and {i for b in found for i in b["ReportDataDictionaryIndex"]} == {7, 9}


def test_rows_of_others_are_never_read(spark, tmp_path):
    """Values that can't be numbers lie in other environments and ids; nobody meets them."""
    path = tmp_path / "x.sql"
    write_sql(path, ("A", "B"))
    whole = {d.files.first()["file_name"]: sorted(map(tuple, d.results.where("id in (7, 9)").collect())) for d in sqlite.read_sqlite(spark, str(path))}
    with sqlite3.connect(path) as db:
        db.execute("update ReportData set Value = 'broken' where ReportDataDictionaryIndex not in (7, 9) or TimeIndex in (select TimeIndex from Time where EnvironmentPeriodIndex = 2)")
    [a] = sqlite.read_sqlite(spark, str(path), environments=["A"], ids=[7, 9])
    assert sorted(map(tuple, a.results.collect())) == whole["x - A"] and a.ids() == [7, 9]
    [b] = sqlite.read_sqlite(spark, str(path), environments=["B"])
    with pytest.raises(Exception, match="broken"):
        b.results.agg(F.sum("value")).collect()
    with pytest.raises(KeyError):
        sqlite.read_sqlite(spark, str(path), environments=["C"])
