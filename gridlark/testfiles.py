"""The driver's events written as results files of each kind, to be read back.

Events are moved to the winter of 2023 (`_SHIFT`), so they fill two months. Text files
are written by Spark, as folders of parts in the order of their lines.
"""

from __future__ import annotations

import sqlite3
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.sources.files import Files, workspace

SHIFT = "interval 350 days"
#: id, key, type, units, interval; the last ones have a table of their own each.
TYPES = {"click": "W", "error": "J", "purchase": "W/m2", "signup": "C", "view": ""}
HEADER = [(7 + i, "SITE", t, u, "Hourly") for i, (t, u) in enumerate(TYPES.items())] + [(12 + i, "SITE", t, u, "Daily") for i, (t, u) in enumerate(TYPES.items())] + [(17, "Meter", "Electricity:Facility", "J", "Monthly"), (18, "SITE", "Total", "J", "RunPeriod"), (19, "SITE", "Total", "J", "Annual"), (30, "SITE", "Event Count", "", "Each Call")]
_MADE: dict[tuple, str] = {}

_LINES = f"""
with e as (select timestampadd(day, -350, cast(ts as timestamp_ntz)) as ts, event_type, cast(value as decimal(18,2)) as value from {{events}}),
span as (select cast(min(ts) as date) as a, cast(max(ts) as date) as b from e),
days as (select d, datediff(d, a) + 1 as n, b = d as is_last, month(d) <> month(d + 1) or b = d as ends from (select explode(sequence(a, b)) as d, a, b from span)),
hours as (select d, h from days lateral view explode(sequence(1, 24)) x as h),
kinds as (select * from values ('click', 0), ('error', 1), ('purchase', 2), ('signup', 3), ('view', 4) t(event_type, k)),
hourly as (select cast(ts as date) as d, hour(ts) + 1 as h, event_type, sum(value) as v from e group by 1, 2, 3),
daily as (select d, event_type, sum(v) as v, min(v) as lo, min_by(h, struct(v, h)) as lo_h, max(v) as hi, max_by(h, struct(v, -h)) as hi_h from hourly group by 1, 2),
monthly as (select trunc(d, 'month') as m, sum(v) as v, min(v) as lo, min_by(struct(d, h), struct(v, d, h)) as lo_at, max(v) as hi, max_by(struct(d, h), struct(v, -datediff(d, date'2000-01-01'), -h)) as hi_at from hourly where event_type = 'click' group by 1),
halves as (select cast(ts as date) as d, hour(ts) + 1 as h, cast(minute(ts) >= 30 as int) as half, count(*) as n from e group by 1, 2, 3),
grid as (select d, h, half from hours lateral view explode(array(0, 1)) x as half),
whole as (select sum(value) as v, count(distinct cast(ts as date)) as n from e),
dated as (select concat(month(d), ',', day(d)) as md, '{{day}}' as fixed, date_format(d, 'EEEE') as name, d.* from days d)
select d, h * 10 + half * 2 as o, 0 as i, concat('2,', n, ',', md, ',0,', h, ',', half * 30, '.00,', (half + 1) * 30, '.00,', if(fixed = '', name, fixed)) as line from grid join dated using (d)
union all select d, h * 10 + half * 2, 30, concat('30,', coalesce(x.n, 0)) from grid left join halves x using (d, h, half)
union all select d, h * 10 + 5, 0, concat('2,', n, ',', md, ',0,', h, ',0.00,60.00,', if(fixed = '', name, fixed)) from hours join dated using (d)
union all select d, h * 10 + 5, 7 + k, concat(7 + k, ',', v) from hourly join kinds using (event_type)
union all select d, 260, 0, concat('3,', n, ',', md, ',0,', if(fixed = '', name, fixed)) from dated
union all select d, 260, 12 + k, concat_ws(',', 12 + k, v, lo, lo_h, 60, hi, hi_h, 60) from daily join kinds using (event_type)
union all select d, 270, 0, concat('4,', n, ',', month(d)) from dated where ends
union all select d, 270, 17, concat_ws(',', 17, v, lo, day(lo_at.d), lo_at.h, 60, hi, day(hi_at.d), hi_at.h, 60) from dated join monthly on m = trunc(d, 'month') where ends
union all select d, 280, 0, concat('5,', n) from dated where is_last
union all select d, 280, 18, concat('18,', (select v from whole)) from dated where is_last
union all select d, 290, 0, concat('6,', year(d)) from dated where is_last
union all select d, 290, 19, concat('19,', (select v from whole)) from dated where is_last
"""


def _once(spark: SparkSession, sf_dir: str, kind: str, make) -> str:
    """The path of a file, made once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _MADE or not Files(spark).exists(_MADE[key]):
        path = f"{workspace(spark)}/{kind}"
        make(path)
        _MADE[key] = path
    return _MADE[key]


def _head() -> list[str]:
    out = ["Program Version,Simulator, Version 9.1.0-abc, YMD=2023.03.01 12:30"] + [f"{i},{i + 1},definition {i}" for i in range(1, 7)]
    for i, key, kind, units, table in HEADER:
        name = kind if key == "Meter" else f"{key},{kind}"
        out.append(f"{i},1,{name} [{units}] !{table}")
    return [*out, "End of Data Dictionary"]


def eso(spark: SparkSession, sf_dir: str, environments: tuple[tuple[str, str], ...] = (("RUN PERIOD 1", ""),), kind: str = "one.eso") -> str:
    """A text file; environments are names and their day type (empty: weekdays)."""

    def make(path: str) -> None:
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        fixed = lambda rows, e: spark.createDataFrame([(e, None, i, 0, x) for i, x in enumerate(rows)], "e int, d date, o int, i int, line string")
        out = fixed(_head(), -1)
        for e, (name, day) in enumerate(environments):
            body = spark.sql(_LINES.replace("{day}", day), events=events)
            out = out.unionByName(fixed([f"1,{name},51.0,0.0,0.0,10.0"], e)).unionByName(body.select(F.lit(e).alias("e"), "d", "o", "i", "line"))
        out = out.unionByName(fixed(["End of Data", "Number of Records Written=1"], len(environments)))
        order = ["e", "d", "o", "i"]
        out.repartitionByRange(4, *order).sortWithinPartitions(*order).select("line").write.text(path)

    return _once(spark, sf_dir, kind, make)


_SITES = """
with e as (select cast(timestampadd(day, -350, cast(ts as timestamp_ntz)) as date) as d, user_id % {sites} as site, cast(value as decimal(18,2)) as value from {events}),
span as (select min(d) as a, max(d) as b from e),
days as (select d, datediff(d, a) + 1 as n from (select explode(sequence(a, b)) as d, a from span)),
sites as (select explode(sequence(0, {sites} - 1)) as site)
select concat(site, '.eso') as site, cast(null as date) as d, pos as o, line from sites lateral view posexplode({head}) x as pos, line
union all select concat(site, '.eso'), d, 0, concat('3,', n, ',', month(d), ',', day(d), ',0,', date_format(d, 'EEEE')) from sites cross join days
union all select concat(site, '.eso'), d, 1, concat('12,', sum(value)) from e group by site, d
union all select concat(site, '.eso'), date'9999-01-01', pos, line from sites lateral view posexplode({foot}) x as pos, line
"""


def sites(spark: SparkSession, sf_dir: str, n: int = 200) -> str:
    """A folder of `n` text files, each with the daily sums of its users' events."""

    def make(path: str) -> None:
        top = [*_head()[:7], "12,1,SITE,Value [J] !Daily", "End of Data Dictionary", "1,RUN PERIOD 1,51.0,0.0,0.0,10.0"]
        texts = lambda rows: f"array({', '.join(repr(x) for x in rows)})"
        made = _SITES.replace("{sites}", str(n)).replace("{head}", texts(top)).replace("{foot}", texts(["End of Data", "Number of Records Written=1"]))
        body = spark.sql(made, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
        body.repartition(8, "site").sortWithinPartitions("site", F.col("d").asc_nulls_first(), "o").select("site", "line").write.partitionBy("site").text(path)

    return _once(spark, sf_dir, f"sites-{n}", make)


def sqlite(spark: SparkSession, sf_dir: str) -> str:
    """A database with hourly and daily sums and a monthly and a run period's; such a
    file is made by one process, so the sums come to the driver."""

    def make(path: str) -> None:
        events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("timestampadd(day, -350, cast(ts as timestamp_ntz)) as ts", "event_type", "cast(value as decimal(18,2)) as value")
        rows = [(r["d"], r["h"], r["event_type"], float(r["v"])) for r in events.groupBy(F.col("ts").cast("date").alias("d"), (F.hour("ts") + 1).alias("h"), "event_type").agg(F.sum("value").alias("v")).collect()]
        with tempfile.TemporaryDirectory() as here:
            _database(f"{here}/one.sql", rows)
            with open(f"{here}/one.sql", "rb") as f:
                Files(spark).write(path, f.read())

    return _once(spark, sf_dir, "one.sql", make)


def _database(path: str, rows: list) -> None:
    kinds = {t: i for i, t in enumerate(TYPES)}
    days = sorted({r[0] for r in rows})
    hourly, daily, total = {}, {}, 0
    for d, h, t, v in rows:
        cents = round(v * 100)
        hourly[d, h, t] = cents
        daily[d, t] = daily.get((d, t), 0) + cents
        total += cents
    with sqlite3.connect(path) as db:
        db.execute("create table Time (TimeIndex integer primary key, Year, Month, Day, Hour, Minute, Dst, Interval, IntervalType, SimulationDays, DayType, EnvironmentPeriodIndex, WarmupFlag)")
        db.execute("create table EnvironmentPeriods (EnvironmentPeriodIndex integer primary key, SimulationIndex, EnvironmentName, EnvironmentType)")
        db.execute("create table ReportData (ReportDataIndex integer primary key, TimeIndex, ReportDataDictionaryIndex, Value)")
        db.execute("create table ReportDataDictionary (ReportDataDictionaryIndex integer primary key, IsMeter, Type, IndexGroup, TimestepType, KeyValue, Name, ReportingFrequency, ScheduleName, Units)")
        db.execute("insert into EnvironmentPeriods values (1, 1, 'RUN PERIOD 1', 3)")
        names = {"Hourly": "Hourly", "Daily": "Daily", "Monthly": "Monthly", "RunPeriod": "Run Period", "Annual": "Annual", "Each Call": "HVAC System Timestep"}
        for i, key, kind, units, table in HEADER:
            db.execute("insert into ReportDataDictionary values (?,?,?,?,?,?,?,?,?,?)", (i, int(key == "Meter"), "Sum", "", "", "" if key == "Meter" else key, kind, names[table], None, units))
        at = 0

        def step(d, hour, code, sim, day, values):
            nonlocal at
            at += 1
            # the run period has no date of its own
            year = d.year if code != 4 else 0
            db.execute("insert into Time values (?,?,?,?,?,0,0,60,?,?,?,1,0)", (at, year, d.month, d.day, hour, code, sim, day))
            db.executemany("insert into ReportData (TimeIndex, ReportDataDictionaryIndex, Value) values (?,?,?)", [(at, i, v) for i, v in values])

        for n, d in enumerate(days, 1):
            name = d.strftime("%A")
            for h in range(1, 25):
                step(d, h, 1, None, name, [(7 + k, hourly[d, h, t] / 100) for t, k in kinds.items() if (d, h, t) in hourly])
            # a value that is reported twice is averaged
            step(d, 24, 2, n, name, [(12 + k, x) for t, k in kinds.items() if (d, t) in daily for x in (daily[d, t] / 100 - 1, daily[d, t] / 100 + 1)])
            if d == days[-1] or days[n].month != d.month:
                step(d, 24, 3, n, None, [(17, sum(v for (x, t), v in daily.items() if t == "click" and x.month == d.month) / 100)])
        step(days[-1], 24, 4, len(days), None, [(18, total / 100)])


def csv(spark: SparkSession, sf_dir: str, simple: bool = False) -> str:
    """Daily sums of each type as a sheet: rows of header, then of data."""

    def make(path: str) -> None:
        events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("cast(timestampadd(day, -350, cast(ts as timestamp_ntz)) as date) as d", "event_type", "cast(value as decimal(18,2)) as value")
        sums = events.groupBy("d").agg(*[F.sum(F.when(F.col("event_type") == t, F.col("value"))).alias(t) for t in TYPES])
        body = sums.select(F.datediff("d", F.lit("2000-01-01")).alias("o"), F.concat_ws(",", F.concat(F.col("d").cast("string"), F.lit(" 00:00:00")), *[F.coalesce(F.col(t).cast("string"), F.lit("")) for t in TYPES], F.concat(F.lit("day "), F.dayofmonth("d"))).alias("line"))
        top = [["key", *["SITE"] * 5, "note"], ["type", *TYPES, "text"], ["units", *TYPES.values(), ""], ["timestamp", *[""] * 6]]
        if simple:
            top = [["key", *TYPES, "note"], ["units", *TYPES.values(), ""], ["timestamp", *[""] * 6]]
        head = spark.createDataFrame([(i - 10, ",".join(x)) for i, x in enumerate(top)], "o int, line string")
        head.unionByName(body).repartitionByRange(3, "o").sortWithinPartitions("o").select("line").write.text(path)

    return _once(spark, sf_dir, "simple.csv" if simple else "sheet.csv", make)
