"""Registered queries of the sources, storage, changes and guards, each with its SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from gridlark import model, testfiles
from gridlark.dataset import Dataset
from gridlark.functions import naming
from gridlark.functions import timeline as tl
from gridlark.functions import units as u
from gridlark.model import SimpleVariable, Variable
from gridlark.operators import aggregate, derive, gaps, lookup, mutate
from gridlark.plans.results import TableFormatter, get_results
from gridlark.queries import ORACLES, _one, query
from gridlark.sources import aligned, chunks, eso, eso_files, reader, sheet, store
from gridlark.sources.files import workspace
from gridlark.sources.progress import StatusTracker
from gridlark.testmodel import load

#: The events of testfiles in SQL.
_EV = """
with e as (select cast(ts as timestamp) - interval 350 day as ts, event_type, cast(value as decimal(18,2)) as value from events),
k as (select * from (values ('click', 0, 'W'), ('error', 1, 'J'), ('purchase', 2, 'W/m2'), ('signup', 3, 'C'), ('view', 4, '')) t(event_type, k, units)),
hs as (select cast(date_trunc('hour', ts) + interval 1 hour as timestamp) as ts, cast(7 + k as int) as id, cast(sum(value) as double) as value from e join k using (event_type) group by 1, 2),
ds as (select cast(date_trunc('day', ts) as timestamp) as ts, cast(12 + k as int) as id, cast(sum(value) as double) as value from e join k using (event_type) group by 1, 2),
days as (select cast(unnest(generate_series((select min(date_trunc('day', ts)) from e), (select max(date_trunc('day', ts)) from e), interval 1 day)) as timestamp) as d),
hours as (select d, h, d + to_hours(cast(h as int)) as ts from days, range(1, 25) r(h)),
start as (select min(d) as d from days),
months as (select min(d) as ts, cast(count(*) as int) as n_days from days group by date_trunc('month', d)),
ms as (select min(ts) as ts, cast(17 as int) as id, cast(sum(v) as double) as value from (select ts, cast(0 as decimal(18,2)) as v from ds union all select date_trunc('day', ts), value from e where event_type = 'click') group by date_trunc('month', ts)),
total as (select cast(sum(value) as double) as value from e),
words as (select cast(7 + k as int) as id, 'hourly' as "table", 'SITE' as key, event_type as type, units from k union all select cast(12 + k as int), 'daily', 'SITE', event_type, units from k
  union all select 17, 'monthly', 'Meter', 'Electricity:Facility', 'J' union all select 18, 'runperiod', 'SITE', 'Total', 'J' union all select 19, 'annual', 'SITE', 'Total', 'J' union all select 30, 'timestep', 'SITE', 'System - Event Count', '')
"""


def files(sql: str):
    """A query on the files of testfiles."""
    return query(_EV + sql, model_sql=False)


def _eso(spark, sf_dir, **options) -> Dataset:
    return reader.load(spark, testfiles.eso(spark, sf_dir), year=2023, **options)


@files("select i.id, hours.ts, hs.value from hours cross join (select distinct cast(7 + k as int) as id from k) i left join hs on hs.ts = hours.ts and hs.id = i.id")
def eso_hourly(spark, sf_dir):
    return _eso(spark, sf_dir).results.where("table = 'hourly'").select("id", "ts", "value")


@files("""select h.ts + to_minutes(cast(x.m as int)) - interval 1 hour as ts, cast(coalesce(n, 0) as double) as value from hours h cross join (values (30), (60)) x(m)
 left join (select date_trunc('hour', ts) as b, case when minute(ts) >= 30 then 60 else 30 end as m, count(*) as n from e group by 1, 2) c on c.b = h.ts - interval 1 hour and c.m = x.m""")
def eso_timestep(spark, sf_dir):
    return _eso(spark, sf_dir).results.where("table = 'timestep'").select("ts", "value")


@files("select i.id, d as ts, dayname(d) as day, ds.value from days cross join (select distinct cast(12 + k as int) as id from k) i left join ds on ds.ts = d and ds.id = i.id")
def eso_daily(spark, sf_dir):
    ds = _eso(spark, sf_dir)
    return ds.results.where("table = 'daily'").join(ds.steps.select("table", "row_ix", "day"), ["table", "row_ix"]).select("id", "ts", "day", "value")


@files("""select 'monthly' as "table", ts, n_days from months union all select 'annual', d, 365 from start union all select 'runperiod', d, (select cast(count(*) as int) from days) from start""")
def eso_long_steps(spark, sf_dir):
    return _eso(spark, sf_dir).steps.where("table in ('monthly', 'annual', 'runperiod')").select("table", "ts", "n_days")


@files("""select id, ts, value from ms union all select 18, d, value from start, total union all select 19, d, value from start, total""")
def eso_long_values(spark, sf_dir):
    return _eso(spark, sf_dir).results.where("table in ('monthly', 'annual', 'runperiod')").select("id", "ts", "value")


@files("""select 'daily' as "table", cast(id + 5 as int) as id, cast(date_trunc('day', ts - interval 1 hour) as timestamp) as ts, min(value) as min_value, arg_min(ts, (value, ts)) as min_ts, max(value) as max_value, arg_max(ts, (value, -epoch(ts))) as max_ts from hs group by 1, 2, 3
 union all select 'monthly', 17, greatest(cast(date_trunc('month', ts - interval 1 hour) as timestamp), (select d from start)), min(value), arg_min(ts, (value, ts)), max(value), arg_max(ts, (value, -epoch(ts))) from hs where id = 7 group by 3""")
def eso_peaks(spark, sf_dir):
    return _eso(spark, sf_dir, ignore_peaks=False).peaks.where("table in ('daily', 'monthly')").select("table", "id", "ts", "min_value", "min_ts", "max_value", "max_ts")


@files('select "table", id, key, type, units from words')
def eso_dictionary(spark, sf_dir):
    return _eso(spark, sf_dir).variables.select("table", "id", "key", "type", "units")


@files("select 'one' as file_name, timestamp '2023-03-01 12:30:00' as file_created, 'eso' as file_type")
def eso_file(spark, sf_dir):
    return _eso(spark, sf_dir).files.select("file_name", F.col("file_created").cast("timestamp_ntz").alias("file_created"), "file_type")


@files("""select 'site=' || s.site as file_name, d as ts, v.value from (select distinct user_id % 200 as site from events) s cross join days
 left join (select user_id % 200 as site, cast(date_trunc('day', cast(ts as timestamp) - interval 350 day) as timestamp) as ts, cast(sum(cast(value as decimal(18,2))) as double) as value from events group by 1, 2) v on v.site = s.site and v.ts = days.d""")
def eso_many_files(spark, sf_dir):
    """A folder of 200 files, read as one Dataset."""
    ds = eso_files.read_eso_files(spark, testfiles.sites(spark, sf_dir), year=2023)
    return ds.results.join(F.broadcast(ds.files.select("file_id", "file_name")), "file_id").select("file_name", "ts", "value")  # 200 rows


def _envs(spark, sf_dir) -> list[Dataset]:
    path = testfiles.eso(spark, sf_dir, (("SUMMER", "SummerDesignDay"), ("RUN PERIOD 1", "")), "two.eso")
    return reader.load_all(spark, path, year=2023)


@files("select n as place, 'two' || s as file_name, id, ts, value from ds cross join (values (0, ''), (1, ' - SUMMER')) x(n, s)")
def eso_environments(spark, sf_dir):
    out = None
    for n, ds in enumerate(_envs(spark, sf_dir)):
        part = ds.results.where("table = 'daily' and value is not null").select(F.lit(n).alias("place"), F.lit(ds.files.first()["file_name"]).alias("file_name"), "id", "ts", "value")
        out = part if out is None else out.unionByName(part)
    return out


@files("""select 'two' as file_name, "table", count(*) as n from words group by 2 union all select 'two - SUMMER', "table", count(*) from words where "table" in ('timestep', 'hourly', 'daily') group by 2""")
def eso_sizing(spark, sf_dir):
    out = None
    for ds in _envs(spark, sf_dir):
        part = ds.variables.groupBy("table").agg(F.count("*").alias("n")).withColumn("file_name", F.lit(ds.files.first()["file_name"]))
        out = part if out is None else out.unionByName(part)
    return out.select("file_name", "table", "n")


@files("""select t as "table", cast(2017 as int) as year, case t when 'timestep' then timestamp '2017-01-16 00:30:00' when 'hourly' then timestamp '2017-01-16 01:00:00' else timestamp '2017-01-16' end as first from (values ('timestep'), ('hourly'), ('daily'), ('monthly'), ('runperiod')) x(t)""")
def eso_seek_year(spark, sf_dir):
    ds = reader.load(spark, testfiles.eso(spark, sf_dir))
    return ds.steps.where("table <> 'annual'").groupBy("table").agg(F.min(F.year("ts")).alias("year"), F.min("ts").alias("first"))


@query("""select n_nationkey as id, case n_nationkey % 5 when 0 then n_name when 1 then 'Meter' when 2 then 'Cumulative Meter' else n_name || ',X' end as key,
 case n_nationkey % 5 when 0 then 'Zone Mean Air Temperature' when 1 then n_name when 2 then 'Cumulative ' || n_name when 3 then 'System - Flow' else 'Flow' end as type,
 case n_nationkey % 5 when 0 then 'C' when 1 then 'J' when 2 then 'J' when 3 then 'm3/s' else '' end as units,
 case n_nationkey % 5 when 0 then 'hourly' when 1 then 'monthly' when 2 then 'runperiod' when 3 then 'timestep' else 'daily' end as "table" from nation""", model_sql=False)
def header_parse(spark, sf_dir):
    n = F.col("n_nationkey").cast("string")
    kind = F.col("n_nationkey") % 5
    line = F.when(kind == 0, F.concat(n, F.lit(",1,"), "n_name", F.lit(",Zone Mean Air Temperature [C] !Hourly"))).when(kind == 1, F.concat(n, F.lit(",9,"), "n_name", F.lit(" [J] !Monthly [Value,Min,Day,Hour,Minute]"))).when(kind == 2, F.concat(n, F.lit(",9,Cumulative "), "n_name", F.lit(" [J] !RunPeriod")))
    line = line.when(kind == 3, F.concat(n, F.lit(",1,"), "n_name", F.lit(",X,Flow [m3/s] !Each Call"))).otherwise(F.concat(n, F.lit(",1,"), "n_name", F.lit(",X,Flow [] !Daily [Value]")))
    rows = eso.header_entries(spark.read.parquet(f"{sf_dir}/nation.parquet").select(line.alias("line")))
    return rows.select(F.col("id").cast("long").alias("id"), "key", "type", "units", "table")


@files("""select 'hourly' as "table", i.id, hours.ts, hs.value from hours cross join (select distinct cast(7 + k as int) as id from k) i left join hs on hs.ts = hours.ts and hs.id = i.id where hours.ts - interval 1 hour in (select date_trunc('hour', ts) from e) or true
 union all select 'daily', i.id, d, round(ds.value, 6) from days cross join (select distinct cast(12 + k as int) as id from k) i left join ds on ds.ts = d and ds.id = i.id
 union all select 'monthly', id, ts, value from ms union all select 'runperiod', 18, d, value from start, total""")
def sqlite_values(spark, sf_dir):
    return reader.load(spark, testfiles.sqlite(spark, sf_dir)).results.select("table", "id", "ts", F.round("value", 6).alias("value"))


ORACLES["sqlite_values"] = ORACLES["sqlite_values"].replace("hs.value from hours", "round(hs.value, 6) as value from hours")


@files("""select 'hourly' as "table", 7 as id, hours.ts, round(hs.value, 6) as value from hours left join hs on hs.ts = hours.ts and hs.id = 7
 union all select 'daily', 13, d, round(ds.value, 6) from days left join ds on ds.ts = d and ds.id = 13""")
def sqlite_pushed(spark, sf_dir):
    """Two variables of one environment: no other rows leave the database."""
    [ds] = reader.load_all(spark, testfiles.sqlite(spark, sf_dir), environments=["RUN PERIOD 1"], ids=[7, 13])
    return ds.results.select("table", "id", "ts", F.round("value", 6).alias("value"))


@files("""select "table", id, key, type, units from words where "table" not in ('annual', 'timestep')""")
def sqlite_header(spark, sf_dir):
    return reader.load(spark, testfiles.sqlite(spark, sf_dir)).variables.select("table", "id", "key", "type", "units")


@files("""select 'hourly' as "table", ts, dayname(d) as day, cast(null as int) as n_days from hours union all select 'daily', d, dayname(d), null from days
 union all select 'monthly', ts, null, n_days from months union all select 'runperiod', d, null, (select cast(count(*) as int) from days) from start""")
def sqlite_steps(spark, sf_dir):
    return reader.load(spark, testfiles.sqlite(spark, sf_dir)).steps.select("table", "ts", "day", "n_days")


@files("select cast(k + 1 as int) as id, d as ts, ds.value from days cross join k left join ds on ds.ts = d and ds.id = 12 + k")
def csv_values(spark, sf_dir):
    return reader.load(spark, testfiles.csv(spark, sf_dir)).results.select("id", "ts", "value")


@files("""select 'sheet' as "table", cast(k + 1 as int) as id, 'SITE' as key, event_type as type, units, false as is_simple from k union all select 'sheet', 6, 'note', 'text', '', false
 union all select 'simple', cast(k + 1 as int), event_type, null, units, true from k union all select 'simple', 6, 'note', null, '', true""")
def csv_header(spark, sf_dir):
    both = reader.load(spark, testfiles.csv(spark, sf_dir)).variables.unionByName(reader.load(spark, testfiles.csv(spark, sf_dir, simple=True)).variables)
    return both.select("table", "id", "key", "type", "units", "is_simple")


@files("select cast(row_number() over (order by d) - 1 as bigint) as row_ix, d as ts, 'day ' || day(d) as value from days where d in (select ts from ds)")
def csv_texts(spark, sf_dir):
    return reader.load(spark, testfiles.csv(spark, sf_dir)).texts.select("row_ix", "ts", "value")


@query("select n_nationkey as id, n_nationkey % 2 = 0 as is_data from nation", model_sql=False)
def row_classifier(spark, sf_dir):
    """Rows of a sheet's top: two numbers of four cells are data, one is not."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").collect()  # a sheet's first rows
    return spark.createDataFrame([(r["n_nationkey"], sheet.is_data_row([r["n_name"], r["n_nationkey"], str(r["n_regionkey"]) if r["n_nationkey"] % 2 == 0 else "x", None, "y"])) for r in rows], "id long, is_data boolean")


@query("select 'nations' as \"table\", n_nationkey as label, 1 as id, cast(n_regionkey as double) as value from nation union all select 'nations', n_nationkey, 2, cast(n_regionkey * 2 as double) from nation", model_sql=False)
def workbook_values(spark, sf_dir):
    """A workbook's sheets as frames; a sheet's rows are bounded by its format."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()
    frame = pd.DataFrame([["key", "A", "B"], ["type", "x", "y"], ["units", "J", "W"], ["range", None, None], *[[r["n_nationkey"], r["n_regionkey"], r["n_regionkey"] * 2] for r in rows]])
    ds = sheet.from_frames(spark, "book.xlsx", {"nations": frame, "empty": pd.DataFrame()})
    return ds.results.join(ds.steps.select("table", "row_ix", "range_ix"), ["table", "row_ix"]).select("table", F.col("range_ix").alias("label"), "id", "value")


_M = """, grid as (select cast(b * 3 + f as int) as id, ts from (select * from range(4) x(b), (values (1), (2), (3)) y(f)), (select cast(unnest(generate_series(min(ts), max(ts), interval 1 month)) as timestamp) as ts from m1))"""


def _box(spark, sf_dir) -> store.Storage:
    """File 1's monthly and range tables, stored."""
    ds = _one(spark, sf_dir)
    keep = lambda df: df.where("table in ('monthly', 'parts')")
    box = store.Storage(spark, workspace(spark))
    box.store(Dataset(ds.files, *(keep(df) for df in (ds.variables, ds.steps, ds.results, ds.texts, ds.peaks))))
    return box


@query(_M + " select g.id, g.ts, m1.value from grid g left join m1 using (id, ts)")
def storage_values(spark, sf_dir):
    return _box(spark, sf_dir).load(0).results.where("table = 'monthly'").select("id", "ts", "value")


@query("select p_partkey as row_ix, p_type as value from part", model_sql=False)
def storage_archive(spark, sf_dir):
    """Saved as an archive, and that loaded."""
    box = _box(spark, sf_dir)
    box.save_as(f"{workspace(spark)}/all.cfs")
    return store.load_storage(spark, box.path).load(0).texts.select("row_ix", "value")


@query(_M + " select g.id, g.ts, m1.value from grid g left join m1 using (id, ts)")
def storage_one_file(spark, sf_dir):
    path = f"{workspace(spark)}/one.cff"
    store.save_file(_one(spark, sf_dir).table("monthly"), path)
    return reader.load(spark, path).results.select("id", "ts", "value")


@query("select * from (values ('stored', 0, 'file1'), ('stored', 1, 'file1'), ('copied', 0, 'file1'), ('copied', 1, 'file1'), ('merged', 0, 'file1'), ('merged', 1, 'file1'), ('merged', 2, 'file1 (1)'), ('merged', 3, 'file1 (2)'), ('deleted', 1, 'file1')) x(step, id, name)", model_sql=False)
def storage_files(spark, sf_dir):
    """Files of a storage after each change of it."""
    box = store.Storage(spark, workspace(spark))
    box.store(_one(spark, sf_dir).table("orders"))
    box.copy_file(0)
    seen = [("stored", *x) for x in box.names().items()]
    other = box.copy_to(workspace(spark))
    seen += [("copied", *x) for x in other.names().items()]
    other.merge_with(box)
    seen += [("merged", *x) for x in other.names().items()]
    box.delete(0)
    seen += [("deleted", *x) for x in box.names().items()]
    return spark.createDataFrame(seen, "step string, id int, name string")


@query("select true as within, true as none_after", model_sql=False)
def storage_parts(spark, sf_dir):
    """Parquet files are no more than predicted, and gone with their file."""
    ds = _one(spark, sf_dir).table("orders")
    box = store.Storage(spark, workspace(spark))
    box.store(ds)
    before = 0 < box.parts(0) <= store.predicted_parts(ds)
    box.delete(0)
    return spark.createDataFrame([(before, box.parts(0) == 0)], "within boolean, none_after boolean")


@query(_M + """ select g.id, g.ts, case when g.id = 1 then m1.value + 1 else m1.value end as value from grid g left join m1 using (id, ts) where g.id <> 2
 union all select 100, g.ts, m1.value * 2 from grid g left join m1 using (id, ts) where g.id = 1""")
def storage_change(spark, sf_dir):
    """Values set, a variable put in and one dropped, in what is stored."""
    box = _box(spark, sf_dir)
    one = lambda ds, by: ds.results.where("table = 'monthly' and id = 1").select("row_ix", by.alias("value"))
    box.change(0, lambda ds: mutate.insert_variable(ds, Variable("monthly", "TWICE", "A", "J"), one(ds, F.col("value") * 2))[0])
    box.change(0, lambda ds: mutate.update_values(ds, "monthly", 1, one(ds, F.col("value") + 1)))
    box.change(0, lambda ds: mutate.remove_variables(ds, [2]))
    return box.load(0).results.where("table = 'monthly'").select("id", "ts", "value")


def _chunked(spark, sf_dir, tables: str, chunk_bytes: int = 8_192, block_rows: int = 50) -> chunks.ChunkStore:
    """Tables of file 1 in chunks, small ones, so that there are many."""
    ds = _one(spark, sf_dir)
    keep = lambda df: df.where(f"table in ({tables})")
    box = chunks.ChunkStore(spark, workspace(spark), chunk_bytes, block_rows)
    box.store(Dataset(ds.files, *(keep(df) for df in (ds.variables, ds.steps, ds.results, ds.texts, ds.peaks))))
    return box


@query("""select g.id, g.ts, case when g.id = 1 and month(g.ts) = 6 then coalesce(g.value, 0) + 1 else g.value end as value, g.value as value_before, true as few from m1g g where g.id <> 2
 union all select 13, g.ts, coalesce(g.value, 0) * 2, null, true from m1g g where g.id = 1""")
def storage_chunk_change(spark, sf_dir):
    """Some values of a variable set, one variable put in and one dropped, by chunks: what
    is stored now, what a reader of the version before still sees, and whether fewer
    chunks were written than there are."""
    box = _chunked(spark, sf_dir, "'monthly', 'hourly'")
    first = box.version()
    own = box.dataset(0, tables=["monthly"], ids=[1]).results.select("row_ix", F.month("ts").alias("m"), F.coalesce("value", F.lit(0.0)).alias("value"))
    _, put = box.put_variable(0, Variable("monthly", "TWICE", "A", "J"), own.select("row_ix", (F.col("value") * 2).alias("value")))
    was = box.dataset(0, first, tables=["monthly"]).results
    new = box.dataset(0, tables=["monthly"]).results
    last = new.agg(F.max("id")).first()[0]
    sets = box.set_values(0, "monthly", 1, own.where("m = 6").select("row_ix", (F.col("value") + 1).alias("value")))
    drop = box.drop_variables(0, [2])
    few = put.dropped == 0 and all(0 < x.written < x.before for x in (sets, drop))
    now = box.load(0).results.where("table = 'monthly'").select(F.when(F.col("id") == last, 13).otherwise(F.col("id")).alias("id"), "row_ix", "ts", "value")
    return now.join(was.select("id", "row_ix", F.col("value").alias("value_before")), ["id", "row_ix"], "left").select("id", "ts", "value", "value_before", F.lit(few).alias("few"))


@query("""select 'results' as kind, 'monthly' as "table", (select count(*) from m1g) as n_rows, true as as_planned, true as within union all select 'results', 'daily', (select count(*) from d1g), true, true
 union all select 'results', 'hourly', (select count(*) from hg), true, true union all select 'texts', 'parts', (select count(*) from part), true, true""")
def storage_layout(spark, sf_dir):
    """Rows of each table in chunks: as many chunks as planned, none above its size."""
    limit = 16_384
    ds = _one(spark, sf_dir)
    box = chunks.ChunkStore(spark, workspace(spark), limit, 100)
    plan = box.planned(ds).select("kind", "table", F.col("chunks").alias("planned"))
    made = box.manifest(box.store(ds)).groupBy("kind", "table").agg(F.count("*").alias("chunks"), F.sum("rows").alias("n_rows"), F.max("bytes").alias("most"))
    out = made.join(plan, ["kind", "table"], "full").where("kind = 'results' and table in ('monthly', 'daily', 'hourly') or kind = 'texts'")
    return out.select("kind", "table", "n_rows", F.col("chunks").eqNullSafe(F.col("planned")).alias("as_planned"), (F.col("most") <= limit).alias("within"))


@query("""select id, count(*) as n_rows, count(value) as n_values, round(sum(value), 2) as total, min(value) as least, arg_min(ts, (value, ts)) filter (value is not null) as least_ts, max(value) as most, arg_max(ts, (value, -epoch(ts))) filter (value is not null) as most_ts
 from hg where ts between (select date_trunc('day', min(ts)) + interval 3 day + interval 5 hour from hg) and (select date_trunc('day', max(ts)) - interval 2 day + interval 7 hour from hg) group by id""")
def peak_by_blocks(spark, sf_dir):
    """Sums and peaks of a range of time from summaries of blocks of rows."""
    box = _chunked(spark, sf_dir, "'hourly'", 65_536, 100)
    steps = box.dataset(0).steps
    a, b = steps.agg(F.date_trunc("day", F.min("ts")) + F.expr("interval '3 05' day to hour"), F.date_trunc("day", F.max("ts")) - F.expr("interval '1 17' day to hour")).first()
    out = box.range_summary(0, a.replace(tzinfo=None), b.replace(tzinfo=None), tables=["hourly"])
    return out.select("id", "n_rows", "n_values", F.round("total", 2).alias("total"), "least", "least_ts", "most", "most_ts")


@query("""select w."table", x.ts, w.key, w.type, round(x.value, 2) as value from (
  select a.ts, a.id, a.value - b.value as value from m1g a join m2g b on a.id = b.id and a.ts = b.ts union all select a.ts, a.id, a.value - b.value from d1g a join d2g b on a.id = b.id and a.ts = b.ts) x
 join (select * from v where file_id = 1 and "table" in ('daily', 'monthly')) w using (id)
 where id in (select a.id from m1 a join m2 b on a.id = b.id and a.ts = b.ts union select a.id from d1 a join d2 b on a.id = b.id and a.ts = b.ts)""")
def diff_stored(spark, sf_dir):
    """The difference of two files that are stored by row, in buckets."""
    ds = load(spark, sf_dir)
    box = aligned.AlignedStore(spark, workspace(spark), buckets=8)
    for file in (1, 2):
        box.store(ds, file)
    out = box.diff(1, 2, 3)
    return out.results.join(out.with_size(out.variables.select("table", "id", "key", "type")), ["table", "id"]).select("table", "ts", "key", "type", F.round("value", 2).alias("value"))


def _all_units() -> list[tuple[str, str, str, float, float]]:
    """(asked, from, to, factor, offset) of every conversion there is."""
    out = [("IP", k, *v) for k, v in u.conversions("IP").items()]
    for e in u.ENERGY:
        out += [(e, k, *v) for k, v in u.energy_table(e).items()]
    for r in u.RATE:
        out += [(r, k, *v) for k, v in u.rate_table(r).items()]
    return out


@query("with c(asked, units, new_units, f, o) as (values " + ", ".join(f"('{a}', '{k}', '{to}', cast('{f!r}' as double), cast('{o!r}' as double))" for a, k, to, f, o in _all_units()) + ") select n_nationkey, asked, units, new_units, round((n_nationkey + 0.5) * f + o, 9) as value from c, nation", model_sql=False)
def units_all(spark, sf_dir):
    """Every unit to every target, on a value of each nation."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", (F.col("n_nationkey") + F.lit(0.5)).alias("value"))
    pairs = _all_units()
    out = None
    for asked in dict.fromkeys(p[0] for p in pairs):
        table = u.conversions("IP") if asked == "IP" else u.conversions(energy_units=asked) if asked in u.ENERGY else u.conversions(rate_units=asked)
        some = rows.withColumn("units", F.explode(F.array(*[F.lit(p[1]) for p in pairs if p[0] == asked]))).withColumn("was", F.col("units"))
        part = u.convert(some, table).select("n_nationkey", F.lit(asked).alias("asked"), F.col("was").alias("units"), F.col("units").alias("new_units"), F.round("value", 9).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query("select 'hourly' as \"table\", cast(1 as double) as n_steps union all select 'daily', null union all select 'monthly', null union all select 'orders', null", model_sql=False)
def steps_an_hour(spark, sf_dir):
    return u.step_kinds(_one(spark, sf_dir).steps).select("table", "n_steps")


_AGG = {
    "min": "min(value)",
    "max": "max(value)",
    "median": "median(value)",
    "std": "stddev_samp(value / 1e6)",
    "var": "var_samp(value / 1e6)",
    "count": "cast(count(value) as double)",
    "first": "arg_min(value, id)",
    "last": "arg_max(value, id)",
    "prod": "product(value / 1e6)",
    "spread": "max(value) - min(value)",
}


@query(_M + ", j as (select g.ts, g.id, m1.value from grid g left join m1 using (id, ts) where g.id in (1, 4, 7, 10)) " + " union all ".join(f"select ts, '{n}' as func, round({x}, 4) as value from j group by ts" for n, x in _AGG.items()))
def aggregate_all(spark, sf_dir):
    """Every named function and one of the caller's, on rows with gaps too."""
    ds = _one(spark, sf_dir)

    def spread(v):
        some = v[~pd.isna(v)]
        return some.max() - some.min() if len(some) else None

    rows = ds.results.where("table = 'monthly' and id in (1, 4, 7, 10)").withColumn("ord", F.col("id"))
    out = None
    for name in _AGG:
        some = rows.withColumn("value", F.col("value") / 1e6) if name in ("prod", "std", "var") else rows
        made = aggregate.row_wise(some, spread if name == "spread" else name).select("ts", F.lit(name).alias("func"), F.round("value", 4).alias("value"))
        out = made if out is None else out.unionByName(made)
    return out


ORACLES["aggregate_all"] = ORACLES["aggregate_all"].replace("product(value / 1e6)", "coalesce(product(value / 1e6), 1)")


@query("""select * from (values ('one variable', 'CannotAggregateVariables'), ('two tables', 'CannotAggregateVariables'), ('mixed units', 'CannotAggregateVariables'), ('nothing found', 'CannotAggregateVariables'), ('unknown function', 'CannotAggregateVariables'),
 ('output type', 'InvalidOutputType'), ('units system', 'InvalidUnitsSystem'), ('no peaks', 'PeaksNotIncluded'), ('energy units', 'ValueError'), ('unknown id', 'KeyError'), ('no dates', 'ValueError'), ('blank line', 'BlankLineError'), ('no entry', 'InvalidLineSyntax'),
 ('no statement', 'InvalidLineSyntax'), ('leap year', 'LeapYearMismatch'), ('first day', 'StartDayMismatch'), ('header rows', 'InsuficientHeaderInfo'), ('suffix', 'FormatNotSupported'), ('environments', 'MultiEnvFileRequired'), ('duplicates', 'DuplicateVariable'), ('no totals', 'NoResults')) x(what, error)""", model_sql=False)
def guards(spark, sf_dir):
    """What each wrong request raises."""
    ds = _one(spark, sf_dir)
    monthly = Variable("monthly", None, "A", "J")
    twice = ds.table("monthly")
    twice = Dataset(twice.files, twice.variables.unionByName(twice.variables.where("id = 1").withColumn("id", F.lit(99)).withColumn("pos", F.lit(99))), twice.steps, twice.results, twice.texts, twice.peaks)
    tries = {
        "one variable": lambda: aggregate.aggregate_variables(ds, [Variable("monthly", "BLOCK0:ZONE1", "A", "J")], "sum"),
        "two tables": lambda: aggregate.aggregate_variables(ds, [monthly, Variable("daily", None, "A", "J")], "sum"),
        "mixed units": lambda: aggregate.aggregate_variables(ds, [monthly, Variable("monthly", None, "R", "C")], "sum"),
        "nothing found": lambda: aggregate.aggregate_variables(ds, [Variable("monthly", "none", None, None)], "sum"),
        "unknown function": lambda: aggregate.aggregate_variables(ds, [monthly], "smallest"),
        "output type": lambda: get_results(ds, [monthly], output_type="some"),
        "units system": lambda: get_results(ds, [monthly], units_system="XX"),
        "no peaks": lambda: get_results(ds, [Variable("daily", None, "A", None)], output_type="local_max"),
        "energy units": lambda: get_results(ds, [monthly], energy_units="cal"),
        "unknown id": lambda: get_results(ds, [12345]),
        "no dates": lambda: get_results(ds, [Variable("parts", None, "p_size", None)], "2020-01-01"),
        "blank line": lambda: eso.header_entry("  "),
        "no entry": lambda: eso.header_entry("7,1,nothing"),
        "no statement": lambda: eso.statement("Program"),
        "leap year": lambda: tl.validate_year(2020, 1, 1, "Wednesday", False),
        "first day": lambda: tl.validate_year(2019, 1, 1, "Monday", False),
        "header rows": lambda: sheet.validate_levels([["a"]]),
        "suffix": lambda: reader.load(spark, "a.txt"),
        "environments": lambda: reader.load(spark, testfiles.eso(spark, sf_dir, (("SUMMER", "SummerDesignDay"), ("RUN PERIOD 1", "")), "two.eso"), year=2023),
        "duplicates": lambda: lookup.assert_unique(twice),
        "no totals": lambda: derive.totals(ds.table("orders")),
    }
    seen = []
    for what, f in tries.items():
        try:
            f()
            seen.append((what, "none"))
        except (model.GridlarkError, KeyError, ValueError) as e:
            seen.append((what, type(e).__name__))
    return spark.createDataFrame(seen, "what string, error string")


@query("""select cast(date_trunc('month', ts) as timestamp) as ts, id - 100 as id, min(value) as value, min(ts) filter (value = low) as peak_ts
 from (select *, min(value) over (partition by id, date_trunc('month', ts)) as low from d1) group by 1, 2""")
def local_min(spark, sf_dir):
    out = get_results(_one(spark, sf_dir), [Variable("monthly", None, None, None)], output_type="local_min", layout="long")
    return out.select("ts", "id", "value", "peak_ts")


_D = """, gd as (select cast(unnest(generate_series(min(ts), max(ts), interval 1 day)) as timestamp) as ts from d1)"""


@query(_D + " select gd.ts, case when day(gd.ts) = 1 then 'Holiday' else dayname(gd.ts) end as day, a.value as v102, b.value as v105 from gd left join (select * from d1 where id = 102) a using (ts) left join (select * from d1 where id = 105) b using (ts)")
def wide_with_ids_and_days(spark, sf_dir):
    out = get_results(_one(spark, sf_dir), [102, 105], table_formatter=TableFormatter(None, include_id=True, include_day=True))
    return out.select(F.col("timestamp").alias("ts"), "day", F.col("`102|BLOCK0:ZONE1|N|W`").alias("v102"), F.col("`105|BLOCK1:ZONE1|N|W`").alias("v105"))


@query("select max(value) as value, arg_max(ts, (value, -epoch(ts))) as at, (select min(value) from m1 where id = 4) as low, (select arg_min(ts, (value, ts)) from m1 where id = 4) as low_at from m1 where id = 4")
def peaks_side_by_side(spark, sf_dir):
    """Values and stamps of peaks as neighbouring columns."""
    ask = lambda kind: get_results(_one(spark, sf_dir), [4], output_type=kind, table_formatter=TableFormatter(None))
    value, at = "`BLOCK1:ZONE1|A|J|value`", "`BLOCK1:ZONE1|A|J|timestamp`"
    high, low = ask("global_max").select(F.col(value).alias("value"), F.col(at).alias("at"), F.lit(1).alias("one")), ask("global_min").select(F.col(value).alias("low"), F.col(at).alias("low_at"), F.lit(1).alias("one"))
    return high.join(low, "one").drop("one")


@query("select p_partkey as id from part where p_size % 4 not in (0, 1) and p_size % 5 not in (0, 1)", model_sql=False)
def totals_valid(spark, sf_dir):
    """Variables that totals are made of: no flows, no performance curves."""
    size = F.col("p_size")
    units = F.when(size % 4 == 0, "kg/s").when(size % 4 == 1, "m3/s").otherwise("J")
    kind = F.when(size % 5 == 0, "Performance Curve Input Variable 1 Value").when(size % 5 == 1, "Performance Curve Output Value").otherwise(F.col("p_type"))
    return derive.valid(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), kind.alias("type"), units.alias("units"))).select("id")


@query("select p_partkey as id from (select *, row_number() over (partition by lower(p_brand), lower(p_type) order by p_partkey) as n from part) where n > 1", model_sql=False)
def duplicates_found(spark, sf_dir):
    head = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit(1).alias("file_id"), F.lit("t").alias("table"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos"), F.lit(False).alias("is_simple"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand")).alias("key"), F.col("p_type").alias("type"), F.lit("J").alias("units"))
    return lookup.duplicates(head).select("id")


@query("""select 'monthly' as "table", false as is_simple, 12 as n, 1 as first_id, true as dated, 'id,table,key,type,units' as levels union all select 'daily', false, 12, 101, true, 'id,table,key,type,units'
 union all select 'hourly', false, 5, 201, true, 'id,table,key,type,units' union all select 'orders', true, 5, 301, true, 'id,table,key,units' union all select 'parts', false, 3, 401, false, 'id,table,key,type,units'""", model_sql=False)
def catalog(spark, sf_dir):
    """What the getters of a file say of its tables, whose columns are in order."""
    ds = _one(spark, sf_dir)
    rows = [(t, ds.is_simple(t), len(ds.header_dict(t)), ds.ids(t)[0], ds.datetime_index(t) is not None, ",".join(ds.levels(t))) for t in ds.table_names()]
    return spark.createDataFrame(rows, '"table" string, is_simple boolean, n int, first_id int, dated boolean, levels string'.replace('"', ""))


@query("select \"table\", cast(row_number() over (partition by \"table\" order by id) - 1 as int) as by_id, cast(row_number() over (partition by \"table\" order by key, type, units, id) - 1 as int) as by_key, id from v where file_id = 1")
def column_order(spark, sf_dir):
    ds = _one(spark, sf_dir)
    places = lambda rows: {r["id"]: n for n, r in enumerate(rows)}
    out = []
    for t in ds.table_names():
        a, b = places(ds.sorted_header(t, "id")), places(ds.sorted_header(t, "key", "type", "units"))
        out += [(t, a[i], b[i], i) for i in a]
    return spark.createDataFrame(out, "table string, by_id int, by_key int, id int")


@query("select o_orderkey, cast(floor(o_totalprice / (year(o_orderdate) - min(year(o_orderdate)) over (partition by o_custkey) + 1)) as bigint) as days from orders", model_sql=False)
def annual_days(spark, sf_dir):
    d = F.col("o_orderdate")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", tl.annual_days(d, F.col("o_totalprice"), ["o_custkey"]).cast("long").alias("days"))


@query("select * from (values ('free', 'b'), ('taken', 'a (2)'), ('started', 'b (5)'), ('plain', 'a 1'), ('ids', '0,2,4')) x(what, name)", model_sql=False)
def names_and_ids(spark, sf_dir):
    ids = naming.ids(0, {1, 3})
    made = {"free": naming.unique_name("b", {"a"}), "taken": naming.unique_name("a", {"a", "a (1)"}), "started": naming.unique_name("b", set(), start=5), "plain": naming.unique_name("a", {"a"}, brackets=False), "ids": ",".join(str(next(ids)) for _ in range(3))}
    return spark.createDataFrame(list(made.items()), "what string, name string")


@query("select gt.ts, strftime(gt.ts, '%Y') as season, cast(null as varchar) as other from (select cast(unnest(generate_series(min(ts), max(ts), interval 1 month)) as timestamp) as ts from m1) gt")
def insert_special(spark, sf_dir):
    """A new special column of one table; other tables have none of it."""
    ds = _one(spark, sf_dir)
    rows = ds.steps.where("table = 'monthly'").select("row_ix", F.year("ts").cast("string").alias("value"))
    ds = mutate.insert_special(ds, "monthly", "season", rows)
    other = ds.steps.where("table = 'hourly'").agg(F.max("season").alias("other"))
    return ds.special_column("monthly", "season").select("ts", "season").crossJoin(F.broadcast(other))  # one row


@query("""select 'renamed' as step, 'new name' as file_name, "table", count(*) as n from v where file_id = 1 group by 3
 union all select 'dropped', 'file1', "table", count(*) from v where file_id = 1 and "table" <> 'hourly' group by 3
 union all select 'replaced', 'file1', "table", count(*) from v where file_id = 1 group by 3
 union all select 'extended', 'file2', "table", count(*) from v where (file_id = 2) or (file_id = 1 and "table" in ('orders')) group by 3""")
def file_changes(spark, sf_dir):
    ds = load(spark, sf_dir)
    one, two = ds.file(1), ds.file(2)
    steps = {"renamed": mutate.rename_file(one, "new name"), "dropped": mutate.drop_table(one, "hourly"), "replaced": mutate.replace_table(one, two, "monthly"), "extended": mutate.extend(two, one.table("orders"))}
    out = None
    for step, x in steps.items():
        part = x.variables.groupBy("table").agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), F.lit(x.files.first()["file_name"]).alias("file_name"), "table", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("select ts, value * cast('1e-6' as double) as value, 'MJ' as units from m1 where id = 1 union all select ts, cast(sum(cast(value as decimal(18,2))) as double), 'J' from m1 where id in (1, 4, 7, 10) group by ts")
def file_delegates(spark, sf_dir):
    """The file's own get_results and aggregate_variables."""
    ds = _one(spark, sf_dir).copy()
    a = ds.get_results([1], energy_units="MJ", layout="long").where("value is not null").select("ts", "value", "units")
    made, new, _ = ds.aggregate_variables(Variable("monthly", None, "A", "J"), "sum")
    b = made.results.where((F.col("id") == new) & (F.col("value") != 0)).select("ts", F.col("value").cast("decimal(18,2)").cast("double").alias("value"), F.lit("J").alias("units"))
    return a.unionByName(b)


@query("select * from (values (0, 'load one.eso'), (1, 'read lines'), (2, 'assemble environments')) x(n, section)", model_sql=False)
def progress_sections(spark, sf_dir):
    tracker = StatusTracker("load")
    reader.load(spark, testfiles.eso(spark, sf_dir), year=2023, tracker=tracker)
    return spark.createDataFrame([(n, s) for n, (s, _) in enumerate(tracker.sections)], "n int, section string")


@files("""select 'read lines' as section, 1 + 5 * (select count(*) from hours) + (select count(*) from hs) + (select count(*) from days) + (select count(*) from ds) + (select count(*) from months)
  + (select count(distinct date_trunc('month', ts)) from e where event_type = 'click') + 4 as lines, true as all_tasks""")
def progress_lines(spark, sf_dir):
    """Lines of data that went through a load, as its tracker was told, and whether
    every task of Spark that it saw came to an end."""
    tracker = StatusTracker("load")
    reader.load(spark, testfiles.eso(spark, sf_dir), year=2023, tracker=tracker)
    last = {e.section: e for e in tracker.events if e.what == "tasks"}
    done = bool(last) and all(e.done == e.maximum > 0 for e in last.values())
    return spark.createDataFrame([(e.section, e.done, done) for e in tracker.events if e.what == "lines"], "section string, lines long, all_tasks boolean")


@query("""select g.id, g.ts, d1.value, r.n_values, r.n_runs from (select id, ts from (select id from v where file_id = 1 and "table" = 'daily') i, d1t) g left join d1 using (id, ts)
 left join (select id, count(*) as n_values, count(distinct ts - to_days(cast(n as int))) as n_runs from (select id, ts, row_number() over (partition by id order by ts) as n from d1) group by id) r using (id)""")
def filled_from_runs(spark, sf_dir):
    """Values and null rows of a table made from runs of what is reported, and how many
    values and runs each variable has."""
    ds = gaps.reported(_one(spark, sf_dir).table("daily"))
    runs = gaps.runs(ds)
    return gaps.filled(ds, runs).join(ds.with_size(gaps.counts(runs)), ["file_id", "table", "id"], "left").select("id", "ts", "value", "n_values", "n_runs")


@files("""select id, ts, value from hs where value is not null""")
def eso_reported(spark, sf_dir):
    """A text file read without null rows: as many rows as values are reported."""
    [ds] = eso.read_eso(spark, testfiles.eso(spark, sf_dir), year=2023, dense=False)
    return ds.results.where("table = 'hourly'").select("id", "ts", "value")


@query("""select 'daily' as "table", count(*) as "rows", false as day, true as n_days from (select unnest(generate_series(min(ts), max(ts), interval 1 day)) as ts from d1) join (select unnest(generate_series(min(ts), max(ts), interval 1 day)) as ts from d2) using (ts)
 union all select 'monthly', count(*), true, false from (select unnest(generate_series(min(ts), max(ts), interval 1 month)) as ts from m1) join (select unnest(generate_series(min(ts), max(ts), interval 1 month)) as ts from m2) using (ts)""")
def diff_special_unequal(spark, sf_dir):
    """Special columns that differ in one shared row each."""
    ds = load(spark, sf_dir)
    last = ds.file(2).steps.groupBy("table").agg(F.max("row_ix").alias("m"))
    other = ds.file(2).steps.join(last, "table")
    end = F.col("row_ix") == F.col("m")
    other = other.withColumn("day", F.when(end & (F.col("table") == "daily"), "Other").otherwise(F.col("day"))).withColumn("n_days", F.when(end & (F.col("table") == "monthly"), 1).otherwise(F.col("n_days"))).drop("m")
    return derive.special_equal(ds.file(1).steps, other)


@query("select id, key, ts, value from o join v using (id) where is_simple and key like '%HIGH%'")
def simple_part_match(spark, sf_dir):
    out = get_results(_one(spark, sf_dir), [SimpleVariable("orders", "high", None)], part_match=True, layout="long")
    return out.where("value is not null").select("id", "key", "ts", "value")

