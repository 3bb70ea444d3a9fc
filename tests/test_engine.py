import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridlark import model
from gridlark.dataset import Dataset
from gridlark.functions import naming
from gridlark.functions import timeline as tl
from gridlark.functions import units as u
from gridlark.model import SimpleVariable, Variable
from gridlark.operators import aggregate, derive, fetch, lookup, mutate
from gridlark.plans.results import TableFormatter, get_results, stamp_text

HEAD = [
    (1, "daily", 0, 1, 0, False, "BLOCK1:ZONE1", "Zone Mean Air Temperature", "C"),
    (1, "daily", 0, 2, 1, False, "BLOCK1:ZONE2", "Zone Mean Air Temperature", "C"),
    (1, "daily", 0, 3, 2, False, "BLOCK1:ZONE1_WALL_2_WIN", "Surface Window Heat Gain Energy", "J"),
    (1, "daily", 0, 4, 3, False, "BLOCK1:ZONE2_WALL_1_WIN", "Surface Window Heat Gain Energy", "J"),
    (1, "daily", 0, 5, 4, False, "Meter", "BLOCK1:ZONE1#Electricity:Facility", "J"),
    (1, "daily", 0, 6, 5, False, "PUMP", "Pump Mass Flow Rate", "kg/s"),
    (1, "daily", 0, 7, 6, False, "LAMP", "Lights Electric Power", "W"),
    (1, "monthly", 1, 8, 0, False, "LAMP", "Lights Electric Power", "W"),
    (1, "simple", 2, 9, 0, True, "A", None, "J"),
    (1, "simple", 2, 10, 1, True, "B", None, "J"),
]
VALUES = {1: [10, 30, 30], 2: [20, 40, None], 3: [1, 2, 3], 4: [4, 5, 6], 5: [7, 7, 7], 6: [1, 1, 1], 7: [1, 2, 3], 8: [5, 6], 9: [1, 2], 10: [3, None]}


def make(spark, shift=0, name="one", values=VALUES):
    days = [dt.datetime(2019, 1, 1) + dt.timedelta(days=shift + n) for n in range(3)]
    months = [dt.datetime(2019, 1, 1), dt.datetime(2019, 2, 1)]
    steps = [(1, "daily", n, d, None, None, "Holiday" if n == 0 else None, None) for n, d in enumerate(days)]
    steps += [(1, "monthly", n, d, None, None, None, 31 if n == 0 else 28) for n, d in enumerate(months)]
    steps += [(1, "simple", n, None, n, None, None, None) for n in range(2)]
    stamp = {"daily": days, "monthly": months, "simple": [None, None]}
    table = {h[3]: h[1] for h in HEAD}
    rows = [(1, table[i], i, n, stamp[table[i]][n], None if v is None else float(v)) for i, vs in values.items() for n, v in enumerate(vs)]
    peaks = [(1, "monthly", 8, months[0], 1.0, dt.datetime(2019, 1, 3, 4), 9.0, dt.datetime(2019, 1, 20, 13, 30))]
    return Dataset.of(
        spark,
        files=spark.createDataFrame([(1, "p", name, None, "eso")], model.FILES),
        variables=spark.createDataFrame(HEAD, model.VARIABLES),
        steps=spark.createDataFrame(steps, model.STEPS),
        results=spark.createDataFrame(rows, model.RESULTS),
        peaks=spark.createDataFrame(peaks, model.PEAKS),
    )


@pytest.fixture(scope="module")
def ds(spark):
    return make(spark)


def test_lookup(ds):
    assert lookup.find_ids(ds, Variable("daily", "block1:zone1", None, None)) == [1]
    assert lookup.find_ids(ds, Variable(None, None, None, "j")) == [3, 4, 5]
    assert lookup.find_ids(ds, SimpleVariable(None, None, "J")) == [9, 10]
    assert lookup.find_ids(ds, Variable("dai", "zone", "temp", ""), part_match=True) == [1, 2]
    assert lookup.find_ids(ds, Variable("daily", "%", None, None), part_match=True) == []
    assert lookup.exists(ds, Variable("DAILY", "LAMP", "lights electric power", "w"))
    assert lookup.table_ids(ds, [Variable(None, "LAMP", None, None), Variable("daily", None, None, "C"), Variable("x", None, None, None)]) == {"daily": [7, 1, 2], "monthly": [8]}
    assert lookup.table_ids(ds, [8, 1]) == {"monthly": [8], "daily": [1]}
    with pytest.raises(KeyError):
        lookup.table_ids(ds, [77])
    with pytest.raises(TypeError):
        lookup.table_ids(ds, ["daily"])


def test_duplicates(spark):
    head = [(1, "t", 0, i, i, False, k, "x", "J") for i, k in enumerate(["A", "a", "A (1)", "A", "B"])]
    df = spark.createDataFrame(head, model.VARIABLES)
    assert [r["key"] for r in lookup.renamed_duplicates(df).orderBy("id").collect()] == ["A", "a (2)", "A (1)", "A (3)", "B"]
    with pytest.raises(model.DuplicateVariable) as e:
        lookup.assert_unique(Dataset.of(spark, variables=df))
    assert set(e.value.duplicates) == {1, 3} and set(e.value.clean) == {0, 2, 4}


def test_duplicates_without_the_driver(spark, monkeypatch):
    """Names as `unique_name` gives them one after the other; no row comes to the driver."""
    keys = ["A", "a (2)", None, "A", "a (1)", "", "A", "A (2)", "a", "a (1) (1)", "A (1)", "a (4)\n", "a (01)", "x (0)", "X (0)", "a", "A (5)", "x", "x", "", "a (2)", "a"] + ["b"] * 40
    head = [(f, t, 0, 100 * f + i, len(keys) - i, False, k, "x" if i % 13 else None, "J") for f, t in ((1, "t"), (1, "u"), (2, "t")) for i, k in enumerate(keys, 50 * (t == "u"))]
    low = lambda x: (x or "").lower()
    names, seen, want = {}, set(), []
    for h in head:
        names.setdefault((h[0], h[1], low(h[7])), set()).add(low(h[6]))
    for h in sorted(head, key=lambda h: (h[:2], h[4], h[3])):
        group, key = (h[0], h[1], low(h[7])), h[6]
        if (group, low(key)) in seen:
            name = naming.unique_name(low(key), names[group])
            names[group].add(name)
            key = (key or "") + name[len(key or "") :]
        seen.add((group, low(key)))
        want.append((h[0], h[1], h[3], key))
    df = spark.createDataFrame(head, model.VARIABLES)
    with monkeypatch.context() as m:
        m.setattr(type(df), "collect", lambda self: pytest.fail("rows on the driver"))
        out = lookup.renamed_duplicates(df)
    assert out.columns == df.columns
    assert sorted(map(str, out.select("file_id", "table", "id", "key").toPandas().replace({float("nan"): None}).itertuples(index=False, name=None))) == sorted(map(str, want))


def test_catalog(ds):
    assert ds.table_names() == ["daily", "monthly", "simple"] and ds.is_simple("simple") and not ds.is_simple("daily")
    assert ds.levels("simple") == ("id", "table", "key", "units") and ds.ids("simple") == [9, 10]
    assert ds.is_datetime("daily") and not ds.is_datetime("simple") and ds.datetime_index("simple") is None
    assert {r["table"]: r["n"] for r in ds.counts().collect()} == {"daily": 7, "monthly": 1, "simple": 2}
    assert [r["n_days"] for r in ds.special_column("monthly", "n_days").orderBy("row_ix").collect()] == [31, 28]
    for table, name in (("daily", "n_days"), ("daily", "nothing")):
        with pytest.raises(KeyError):
            ds.special_column(table, name)
    assert "daily: 7 variables" in repr(ds)


def test_slices_and_order(ds):
    out = fetch.values(ds, "daily", [3, 1], "2019-01-02", dt.datetime(2019, 1, 3)).orderBy("ord", "ts").collect()
    assert [(r["ord"], r["id"], r["value"]) for r in out] == [(0, 3, 2), (0, 3, 3), (1, 1, 30), (1, 1, 30)]
    with pytest.raises(ValueError):
        get_results(ds, SimpleVariable("simple", "A", None), start_date="2019-01-01")


def test_peaks(ds):
    rows = {r["id"]: (r["value"], r["ts"]) for r in fetch.global_peak(ds.results.where("table = 'daily'")).collect()}
    assert rows[1] == (30, dt.datetime(2019, 1, 2)) and rows[5] == (7, dt.datetime(2019, 1, 1))
    low = {r["id"]: (r["value"], r["ts"]) for r in fetch.global_peak(ds.results.where("table = 'daily'"), largest=False).collect()}
    assert low[2] == (20, dt.datetime(2019, 1, 1)) and low[5] == (7, dt.datetime(2019, 1, 1))
    out = get_results(ds, 8, output_type="local_max").first()
    assert (out["LAMP|Lights Electric Power|W|value"], out["LAMP|Lights Electric Power|W|timestamp"]) == (9.0, dt.datetime(2019, 1, 20, 13, 30))
    with pytest.raises(model.PeaksNotIncluded):
        get_results(ds, 1, output_type="local_min")
    peak = get_results(ds, [1, 2], output_type="global_max", table_formatter=TableFormatter(None)).collect()
    assert len(peak) == 1 and peak[0]["BLOCK1:ZONE2|Zone Mean Air Temperature|C|value"] == 40


def test_bad_options(ds):
    with pytest.raises(model.InvalidOutputType):
        get_results(ds, 1, output_type="x")
    with pytest.raises(model.InvalidUnitsSystem):
        get_results(ds, 1, units_system="x")
    with pytest.raises(ValueError):
        get_results(ds, 1, energy_units="x")
    with pytest.raises(ValueError):
        get_results(ds, 1, rate_units="x")
    assert get_results(ds, Variable("no", None, None, None)) is None


def test_units(spark, ds):
    table = u.conversions("IP", "kW", "kWh")
    df = spark.createDataFrame([("C", 10.0), ("W", 1000.0), ("J", 3.6e6), ("W/m2", 1.0), ("m", 1.0), ("?", 5.0), ("J/kg", 0.0)], "units string, value double")
    got = {r["units"]: round(r["value"], 6) for r in u.convert(df, table).collect()}
    assert got == {"F": 50.0, "kW": 1.0, "kWh": 1.0, "kW/m2": 0.001, "ft": 3.28084, "?": 5.0, "Btu/lb": 7.686}
    assert u.conversions()["W"] if "W" in u.conversions() else True
    assert u.conversions("IP")["W/m2"][0] == "W/sqf" and "W" not in u.conversions("IP")
    assert u.energy_table("Btu")["J/m2"][0] == "Btu/ft2" and u.rate_table("Btu/h")["W/m2"][0] == "Btu/h-ft2"
    # rates become energy before energies are converted
    out = get_results(ds, 7, rate_to_energy=True, energy_units="Wh", layout="long").orderBy("ts").collect()
    assert [(r["units"], round(r["value"], 6)) for r in out] == [("Wh", 24), ("Wh", 48), ("Wh", 72)]
    out = get_results(ds, 8, rate_to_energy=True, layout="long").orderBy("ts").collect()
    assert [r["value"] for r in out] == [5 * 31 * 86400, 6 * 28 * 86400]
    # the step is that of the whole table, also for a slice of one row
    one = get_results(ds, 7, "2019-01-02", "2019-01-02", rate_to_energy=True, layout="long").first()
    assert one["value"] == 2 * 86400
    kinds = {r["table"]: r for r in u.step_kinds(ds.steps).collect()}
    assert kinds["daily"]["is_daily"] and not kinds["daily"]["is_hourly"] and kinds["monthly"]["step_s"] is not None  # two months have one step


def test_layout(ds):
    out = get_results(ds, [1, 8], table_formatter=TableFormatter(None, include_table_name=True, include_id=True, include_day=True)).orderBy("timestamp")
    assert out.columns == ["day", "timestamp", "1|daily|BLOCK1:ZONE1|Zone Mean Air Temperature|C", "8|monthly|LAMP|Lights Electric Power|W"]
    days = {(r["timestamp"], r["day"]) for r in out.collect()}
    assert (dt.datetime(2019, 1, 1), "Holiday") in days and (dt.datetime(2019, 1, 2), "Wednesday") in days
    assert TableFormatter("None").file_name_position is None and TableFormatter("bad").file_name_position == "row"
    at = get_results(ds, 1, table_formatter=TableFormatter(None, timestamp_format="%d-%m %H o'clock")).select("timestamp").orderBy("timestamp").first()
    assert at[0] == "01-01 00 o'clock"


def test_stamp_pattern(spark):
    row = spark.sql("select timestamp_ntz'2019-03-04 15:06:07' as t").select(stamp_text(F.col("t"), "%Y/%y %b %B %A %a %j %I%p %M:%S.%f %% day")).first()[0]
    assert row == "2019/19 Mar March Monday Mon 063 03PM 06:07.000000 % day"


def test_files_align(spark, ds):
    other = make(spark, shift=1, name="two")
    out = get_results([ds, other], Variable("daily", "BLOCK1:ZONE1", None, None), table_formatter=TableFormatter("column")).orderBy("timestamp").collect()
    assert [tuple(r)[1:] for r in out] == [(10, None), (30, 10), (30, 30), (None, 30)]
    rows = get_results([ds, other], Variable("daily", "BLOCK1:ZONE1", None, None))
    assert rows.columns[0] == "file" and rows.count() == 6


def test_aggregate(ds):
    made, new, var = aggregate.aggregate_variables(ds, [1, 2], "sum")
    assert (new, var) == (100, Variable("daily", "Custom Key - sum", "Zone Mean Air Temperature", "C"))
    assert [r["value"] for r in made.results.where("id = 100").orderBy("row_ix").collect()] == [30, 70, 30]
    want = {"mean": [15, 35, 30], "min": [10, 30, 30], "max": [20, 40, 30], "median": [15, 35, 30], "count": [2, 2, 1], "prod": [200, 1200, 30], "first": [10, 30, 30], "last": [20, 40, 30]}
    df = fetch.values(ds, "daily", [1, 2])
    for f, w in want.items():
        assert [r["value"] for r in aggregate.row_wise(df, f).orderBy("row_ix").collect()] == w, f
    assert [round(r["value"], 6) if r["value"] is not None else None for r in aggregate.row_wise(df, "var").orderBy("row_ix").collect()] == [50, 50, None]
    _, _, mixed = aggregate.aggregate_variables(ds, [3, 7], "sum", new_key="K")
    assert (mixed.units, mixed.key, mixed.type) == ("J", "K", "Custom Type")
    simple, i, var = aggregate.aggregate_variables(ds, SimpleVariable("simple", None, None), "sum")
    assert var == SimpleVariable("simple", "Custom Key - sum", "J") and [r["value"] for r in simple.results.where(f"id = {i}").orderBy("row_ix").collect()] == [4, 2]
    for bad in ([1], [1, 3], [1, 8], Variable("no", None, None, None)):
        with pytest.raises(model.CannotAggregateVariables):
            aggregate.aggregate_variables(ds, bad, "sum")


def test_aggregate_by_function(ds):
    def spread(x):
        return max(x) - min(x)

    made, new, var = aggregate.aggregate_variables(ds, [3, 4], spread)
    assert var.key == "Custom Key - spread" and [r["value"] for r in made.results.where(f"id = {new}").orderBy("row_ix").collect()] == [3, 3, 3]


def test_totals(ds):
    out = derive.totals(ds)
    rows = {(r["key"], r["type"], r["units"]): r["id"] for r in out.header() if r["table"] == "daily"}
    assert set(rows) == {("Zone", "Zone Mean Air Temperature", "C"), ("Windows", "Surface Window Heat Gain Energy", "J"), ("Meter", "Electricity:Facility", "J"), ("Lights", "Lights Electric Power", "W")}
    value = lambda i: [r["value"] for r in out.results.where(f"id = {i}").orderBy("row_ix").collect()]
    assert value(rows["Zone", "Zone Mean Air Temperature", "C"]) == [15, 35, 30]
    assert value(rows["Windows", "Surface Window Heat Gain Energy", "J"]) == [5, 7, 9]
    assert min(rows.values()) == 1 and "simple" not in out.table_names()
    with pytest.raises(model.NoResults):
        derive.totals(ds.table("simple"))


def test_group_words(spark):
    df = spark.createDataFrame([("A_HOLE", "x y", "J"), ("A_FLOOR_1", "q", "J"), ("z", "Facility Total Power", "W"), ("z", "Facility Power", "W"), ("z", "Unknown Thing", "W"), ("Cumulative Meter", "a#b#Gas", "J")], "key string, type string, units string")
    got = [(r["group_key"], r["group_type"], r["group_name"]) for r in derive.grouped(df).collect()]
    assert got == [("Holes", "x y", "Holes x y J"), ("Floors", "q", "Floors q J"), ("Facility Total", "Facility Total Power", "Facility Total Power W"), ("Facility", "Facility Power", "Facility Power W"), ("Unknown", "Unknown Thing", "Unknown Thing W"), ("Cumulative Meter", "Gas", "Gas J")]


def test_diff(spark, ds):
    other = make(spark, shift=1, name="two", values=VALUES | {2: [None, None, None]})
    number = lambda d, i: Dataset(*(df.withColumn("file_id", F.lit(i)) for df in (d.files, d.variables, d.steps, d.results, d.texts, d.peaks)))
    out = derive.diff(number(ds, 1).union(number(other, 2)), 1, 2)
    head = {r["id"]: (r["table"], r["key"]) for r in out.header()}
    assert min(head) == 0 and ("daily", "BLOCK1:ZONE2") not in head.values() and ("simple", "A") in head.values()
    zone = next(i for i, h in head.items() if h == ("daily", "BLOCK1:ZONE1"))
    assert [(r["ts"].day, r["value"]) for r in out.results.where(f"table = 'daily' and id = {zone}").orderBy("ts").collect()] == [(2, 20), (3, 0)]
    steps = out.steps.where("table = 'daily'").collect()
    assert len(steps) == 2 and all(s["day"] is None for s in steps)  # the day types differ on shared rows
    assert {s["n_days"] for s in out.steps.where("table = 'monthly'").collect()} == {31, 28}


def test_insert_rename_remove(spark, ds):
    rows = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "row_ix long, value double")
    new, i, var = mutate.insert_variable(ds, Variable("daily", "LAMP", "Lights Electric Power", "W"), rows)
    assert (i, var.key) == (100, "LAMP (1)")
    assert mutate.insert_variable(new, Variable("daily", "x", "y", "J"), rows)[1] == 101
    assert mutate.insert_variable(ds, Variable("monthly", "x", "y", "J"), rows) is None
    with pytest.raises(TypeError):
        mutate.insert_variable(ds, SimpleVariable("daily", "x", "J"), rows)
    named, i, var = mutate.rename_variable(ds, Variable("daily", "LAMP", None, None), "LIGHT", "T")
    assert (i, var) == (7, Variable("daily", "LIGHT", "T", "W")) and named.header_dict()[7] == var
    assert mutate.rename_variable(ds, Variable("daily", "LAMP", None, None), "LAMP")[0] is ds
    with pytest.raises(ValueError):
        mutate.rename_variable(ds, Variable("daily", "LAMP", None, None))
    for bad in (Variable("daily", None, None, "C"), Variable("daily", "no", None, None)):
        with pytest.raises(KeyError):
            mutate.rename_variable(ds, bad, "x")
    less = mutate.remove_variables(ds, [Variable("daily", None, None, "J"), Variable("daily", "no", None, None)])
    assert less.ids("daily") == [1, 2, 6, 7] and less.results.where("id in (3, 4, 5)").count() == 0
    assert mutate.remove_variables(ds, Variable("daily", "no", None, None)) is ds
    with pytest.raises(KeyError):
        mutate.remove_variables(ds, [1234])


def test_updates_and_equality(spark, ds):
    rows = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "row_ix long, value double")
    new = mutate.update_values(ds, "daily", 1, rows)
    assert [r["value"] for r in new.results.where("id = 1").orderBy("row_ix").collect()] == [1, 2, 3]
    assert mutate.update_values(ds, "monthly", 8, rows) is ds
    days = mutate.insert_special(ds, "daily", "day", spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "row_ix long, value string"))
    assert [r["day"] for r in days.special_column("daily", "day").orderBy("row_ix").collect()] == ["a", "b", "c"]
    assert mutate.insert_special(ds, "monthly", "day", rows) is ds
    assert mutate.equal(ds, make(spark)) and not mutate.equal(ds, new) and not mutate.equal(ds, days)
    near = mutate.update_values(ds, "daily", 5, spark.createDataFrame([(n, 7.0 + 1e-7) for n in range(3)], "row_ix long, value double"))
    assert mutate.equal(ds, near)
    assert mutate.drop_table(ds, "simple").table_names() == ["daily", "monthly"]
    assert mutate.equal(mutate.extend(mutate.drop_table(ds, "simple"), ds.table("simple")), ds)
    assert mutate.rename_file(ds, "z").files.first()["file_name"] == "z"


def test_interval_stamps(spark):
    cases = {(1, 1, 1, 60): (1, 1, 1, 0), (1, 1, 24, 60): (1, 2, 0, 0), (12, 31, 24, 60): None, (1, 1, 5, 30): (1, 1, 4, 30), (1, 1, 1, 15): (1, 1, 0, 15), (1, 1, 0, 0): (1, 1, 0, 0)}
    df = spark.createDataFrame([(m, d, h, e) for m, d, h, e in cases], "m int, d int, h int, e int")
    got = {(r["m"], r["d"], r["h"], r["e"]): r["t"] for r in df.select("*", tl.interval_stamp(F.lit(2002), F.col("m"), F.col("d"), F.col("h"), F.col("e")).alias("t")).collect()}
    for k, want in cases.items():
        assert got[k] == (dt.datetime(2002, *want) if want else dt.datetime(2003, 1, 1))
    row = spark.range(1).select(tl.database_stamp(F.lit(0), F.lit(12), F.lit(31), F.lit(24), F.lit(0)), tl.occurrence_stamp(F.lit(dt.datetime(2019, 5, 6)).cast("timestamp_ntz"), F.lit(None).cast("int"), F.lit(9), F.lit(24), F.lit(60))).first()
    assert tuple(row) == (dt.datetime(2003, 1, 1), dt.datetime(2019, 5, 10))


def test_years(spark):
    days = [(12, 30), (12, 31), (1, 1), (1, 2), (12, 31), (1, 1)]
    df = spark.createDataFrame([(n, m, d, 0, 0) for n, (m, d) in enumerate(days)], "n int, month int, day int, hour int, end_minute int")
    assert [r["year"] for r in tl.wrapped_year(df, 2001, [], "n").orderBy("n").collect()] == [2001, 2001, 2002, 2002, 2002, 2003]
    assert tl.seek_year(1, 1, "Tuesday", False) == 2019 and tl.seek_year(1, 1, "SummerDesignDay", False) == 2002
    assert tl.seek_year(1, 1, "Wednesday", True) == 2020
    assert tl.allowed_years(1, 1, "Sunday", False) == [2017, 2006, 1995]
    tl.validate_year(2019, 1, 1, "Tuesday", False)
    with pytest.raises(model.LeapYearMismatch):
        tl.validate_year(2020, 1, 1, "Wednesday", False)
    with pytest.raises(model.StartDayMismatch):
        tl.validate_year(2019, 1, 1, "Monday", False)
    assert tl.lowest_interval({"monthly", "daily"}) == "daily" and tl.lowest_interval({"x"}) is None


def test_names():
    ids = naming.ids(0, {1, 2})
    assert [next(ids) for _ in range(3)] == [0, 3, 4]
    assert naming.unique_name("a", []) == "a" and naming.unique_name("a", ["a", "a (1)"]) == "a (2)"
    assert naming.unique_name("a", ["a"], start=5) == "a (5)" and naming.unique_name("a", ["a"], brackets=False) == "a 1"


def test_range_detection(spark):
    rows = [("r", 0, "5"), ("r", 1, "7"), ("r", 2, "9"), ("x", 0, "1"), ("x", 1, "3"), ("x", 2, "4"), ("t", 0, "a"), ("t", 1, "b"), ("o", 0, "1")]
    df = spark.createDataFrame([(1, t, n, v) for t, n, v in rows], "file_id int, table string, row_ix long, label string")
    got = {r["table"]: (r["is_range"], r["start"], r["stop"], r["step"]) for r in fetch.range_index(df).collect()}
    assert got["r"] == (True, 5, 11, 2) and not any(got[t][0] for t in "xto")


def test_progress():
    from gridlark.sources.progress import StatusTracker

    t = StatusTracker("x")
    t.set_maximum(3)
    with t.task("load"):
        t.increment(2)
        t.section("half")
    assert t.progress == 3 and [s for s, _ in t.sections] == ["load", "half"]
    with pytest.raises(KeyError), t.task("bad"):
        raise KeyError
