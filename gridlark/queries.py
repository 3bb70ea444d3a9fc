"""Registered queries of the engine's own operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlark.dataset import Dataset
from gridlark.functions import timeline as tl
from gridlark.functions import units as u
from gridlark.model import SimpleVariable, Variable
from gridlark.operators import aggregate, derive, fetch, lookup, mutate, postings
from gridlark.operators.median import medians
from gridlark.plans.results import TableFormatter, get_results
from gridlark.sources import eso
from gridlark.testmodel import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The model of testmodel in SQL.
_MODEL = """
with li as (select cast(l_shipdate as date) as d, l_suppkey % 4 as b, case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end as f,
                   l_linestatus as s, cast(l_extendedprice as decimal(18,2)) as p from lineitem),
v0 as (select cast(b as int) as b, f, t, un from range(4) x(b), (values (1, 'A', 'J'), (2, 'N', 'W'), (3, 'R', 'C')) y(f, t, un)),
v as (select fi as file_id, tb as "table", tp as table_pos, cast(fo + b * 3 + f as int) as id, 'BLOCK' || b || ':ZONE1' as key, t as type, un as units, false as is_simple
        from v0, (values (1), (2)) z(fi), (values ('daily', 1, 100), ('monthly', 2, 0)) w(tb, tp, fo)
      union all select 1, 'hourly', 0, i, 'SITE', t, un, false from (values (201, 'click', 'W'), (202, 'error', 'J'), (203, 'purchase', 'W/m2'), (204, 'signup', 'C'), (205, 'view', '')) e(i, t, un)
      union all select 1, 'orders', 3, i, k, null, '', true from (values (301, '1-URGENT'), (302, '2-HIGH'), (303, '3-MEDIUM'), (304, '4-NOT SPECIFIED'), (305, '5-LOW')) o(i, k)
      union all select 1, 'parts', 4, i, 'PART', t, '', false from (values (401, 'p_type'), (402, 'p_size'), (403, 'p_retailprice')) q(i, t)),
m1 as (select cast(date_trunc('month', d) as timestamp) as ts, cast(b * 3 + f as int) as id, cast(sum(p) as double) as value from li group by 1, 2),
m2 as (select cast(date_trunc('month', d) as timestamp) as ts, cast(b * 3 + f as int) as id, cast(sum(p) as double) as value from li where s = 'O' group by 1, 2),
d1 as (select cast(d as timestamp) as ts, cast(100 + b * 3 + f as int) as id, cast(sum(p) as double) as value from li group by 1, 2),
d2 as (select cast(d as timestamp) as ts, cast(100 + b * 3 + f as int) as id, cast(sum(p) as double) as value from li where s = 'O' group by 1, 2),
h as (select cast(date_trunc('hour', ts) as timestamp) as ts, case event_type when 'click' then 201 when 'error' then 202 when 'purchase' then 203 when 'signup' then 204 else 205 end as id,
             cast(sum(cast(value as decimal(18,2))) as double) as value from events group by 1, 2),
o as (select cast(cast(o_orderdate as date) as timestamp) as ts, 300 + cast(substr(o_orderpriority, 1, 1) as int) as id, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as value from orders group by 1, 2),
mi as (select 1 + unnest(range(12)) as id), di as (select 101 + unnest(range(12)) as id), hi as (select 201 + unnest(range(5)) as id), oi as (select 301 + unnest(range(5)) as id),
m1t as (select cast(unnest(generate_series(min(ts), max(ts), interval 1 month)) as timestamp) as ts from m1), m2t as (select cast(unnest(generate_series(min(ts), max(ts), interval 1 month)) as timestamp) as ts from m2),
d1t as (select cast(unnest(generate_series(min(ts), max(ts), interval 1 day)) as timestamp) as ts from d1), d2t as (select cast(unnest(generate_series(min(ts), max(ts), interval 1 day)) as timestamp) as ts from d2),
ht as (select cast(unnest(generate_series(min(ts), max(ts), interval 1 hour)) as timestamp) as ts from h), ot as (select cast(unnest(generate_series(min(ts), max(ts), interval 1 day)) as timestamp) as ts from o),
m1g as (select ts, cast(id as int) as id, value from m1t cross join mi left join m1 using (ts, id)), m2g as (select ts, cast(id as int) as id, value from m2t cross join mi left join m2 using (ts, id)),
d1g as (select ts, cast(id as int) as id, value from d1t cross join di left join d1 using (ts, id)), d2g as (select ts, cast(id as int) as id, value from d2t cross join di left join d2 using (ts, id)),
hg as (select ts, cast(id as int) as id, value from ht cross join hi left join h using (ts, id)), og as (select ts, cast(id as int) as id, value from ot cross join oi left join o using (ts, id)),
pg as (select p_partkey as row_ix, 402 as id, cast(p_size as double) as value from part union all select p_partkey, 403, p_retailprice from part)
"""


def query(sql: str, model_sql: bool = True):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = (_MODEL if model_sql else "") + sql
        return f

    return add


def _one(spark: SparkSession, sf_dir: str, file: int = 1) -> Dataset:
    return load(spark, sf_dir).file(file)


_HEAD = ("table", "id", "key", "type", "units")


@query("select \"table\", id, key, type, units from v where file_id = 1 and \"table\" = 'monthly' and key = 'BLOCK1:ZONE1' and type = 'A'")
def lookup_exact(spark, sf_dir):
    return lookup.find(_one(spark, sf_dir), [Variable("Monthly", "block1:zone1", "a", None)]).select(*_HEAD)


@query('select "table", id, key, type, units from v where file_id = 1 and type = \'A\'')
def lookup_wildcard(spark, sf_dir):
    return lookup.find(_one(spark, sf_dir), [Variable(None, None, "A", None)]).select(*_HEAD)


@query("select \"table\", id, key, type, units from v where file_id = 1 and contains(\"table\", 'month') and contains(key, 'BLOCK1') and contains(units, 'J')")
def lookup_part_match(spark, sf_dir):
    return lookup.find(_one(spark, sf_dir), [Variable("month", "block1", None, "j")], part_match=True).select(*_HEAD)


@query("select count(*) > 0 as there, false as missing from v where file_id = 1 and \"table\" = 'hourly' and key = 'SITE' and type = 'click'")
def variable_exists(spark, sf_dir):
    ds = _one(spark, sf_dir)
    return spark.createDataFrame([(lookup.exists(ds, Variable("hourly", "site", "click", None)), lookup.exists(ds, Variable("hourly", "site", "none", None)))], "there boolean, missing boolean")


@query("""select "table", cast(row_number() over (partition by "table" order by r, id) - 1 as int) as pos, id from (
  select 0 as r, * from v where file_id = 1 and type = 'R' and units = 'C' union all select 1, * from v where file_id = 1 and "table" = 'monthly' and key = 'BLOCK2:ZONE1')""")
def table_id_map(spark, sf_dir):
    found = lookup.table_ids(_one(spark, sf_dir), [Variable(None, None, "R", "C"), Variable("monthly", "BLOCK2:ZONE1", None, None)])
    return spark.createDataFrame([(t, n, i) for t, ids in found.items() for n, i in enumerate(ids)], "table string, pos int, id int")


@query("""select 'exact' as how, r.req_no, p.p_partkey as id from (select l_orderkey * 8 + l_linenumber as req_no, 'brand#' || (1 + l_suppkey % 25) as brand, case l_linestatus when 'O' then 'small' end as kind, cast(l_quantity as int) as size from lineitem where l_quantity <= 20) r
  join part p on lower(p_brand) = r.brand and (r.kind is null or lower(p_type) = r.kind) and p_size = r.size
 union all select 'part', r.req_no, p.p_partkey from (select cast(s_suppkey as bigint) as req_no, 'D#' || (s_suppkey % 30) as brand, case s_suppkey % 3 when 0 then 'all' when 1 then 'O' end as kind, cast(s_suppkey % 50 as varchar) as size from supplier) r
  join part p on contains(lower(p_brand), lower(r.brand)) and (r.kind is null or contains(lower(p_type), lower(r.kind))) and contains(cast(p_size as varchar), r.size)""", model_sql=False)
def lookup_index(spark, sf_dir):
    """A header of all parts, asked by line items (exact) and by suppliers (by part)."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    header = read("part").select(F.lit(0).alias("file_id"), F.col("p_brand").alias("table"), F.lit(0).alias("table_pos"), F.col("p_partkey").cast("int").alias("id"), F.lit(0).alias("pos"), F.lit(False).alias("is_simple"), F.col("p_name").alias("key"), F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("units"))
    index = postings.HeaderIndex(header)
    no, none = F.lit(False).alias("is_simple"), F.lit(None).cast("string").alias("key")
    items = read("lineitem").where("l_quantity <= 20")
    exact = items.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("req_no"), no, F.format_string("BRAND#%d", 1 + F.col("l_suppkey") % 25).alias("table"), none, F.when(F.col("l_linestatus") == "O", "Small").alias("type"), F.col("l_quantity").cast("int").cast("string").alias("units"))
    n = F.col("s_suppkey")
    part = read("supplier").select(n.cast("long").alias("req_no"), no, F.format_string("D#%d", n % 30).alias("table"), none, F.when(n % 3 == 0, "all").when(n % 3 == 1, "O").alias("type"), (n % 50).cast("string").alias("units"))
    found = lambda how, asked: index.find(asked, how == "part").select(F.lit(how).alias("how"), "req_no", F.col("id").cast("long").alias("id"))
    return found("exact", exact).unionByName(found("part", part))


@query("""select l_returnflag, l_linestatus, max(n) as n, min(p) filter (i = (n - 1) // 2) as lower, min(p) filter (i = n // 2) as upper, min(p) filter (i = (n - 1) // 2) * 0.5::double + min(p) filter (i = n // 2) * 0.5::double as median
 from (select l_returnflag, l_linestatus, l_extendedprice as p, row_number() over (partition by l_returnflag, l_linestatus order by l_extendedprice) - 1 as i, count(*) over (partition by l_returnflag, l_linestatus) as n from lineitem) group by 1, 2""", model_sql=False)
def aggregate_median(spark, sf_dir):
    """Exact medians of a few large groups."""
    return medians(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


@query("""select ts, key, type, 'kWh' as units, value * cast('0.000277777777777778e-3' as double) as value from m1g join v using (id)
 where file_id = 1 and "table" = 'monthly' and contains(key, 'BLOCK1') and units = 'J' and ts between timestamp '1996-04-10' and timestamp '1996-08-10'""")
def date_slice(spark, sf_dir):
    out = get_results(_one(spark, sf_dir), [Variable("monthly", "block1", None, "J")], "1996-04-10", "1996-08-10", part_match=True, energy_units="kWh", layout="long")
    return out.select("ts", "key", "type", "units", "value")


@query("select cast(list_position([7, 1, 4], id) - 1 as int) as ord, id, ts, value from m1g where id in (7, 1, 4)")
def select_ids_ordered(spark, sf_dir):
    return fetch.values(_one(spark, sf_dir), "monthly", [7, 1, 4]).select("ord", "id", "ts", "value")


@query("select ts, cast(day(last_day(ts)) as int) as n_days from (select cast(unnest(generate_series(min(ts), max(ts), interval 1 month)) as timestamp) as ts from m1)")
def special_columns(spark, sf_dir):
    return _one(spark, sf_dir).special_column("monthly", "n_days").select("ts", "n_days")


_ALL = """, a as (select 'monthly' as "table", *, cast(null as bigint) as row_ix from m1 union all select 'daily', *, null from d1 union all select 'hourly', *, null from h union all select 'orders', *, null from o
 union all select 'parts', cast(null as timestamp), id, value, row_ix from pg)"""


def _global(spark, sf_dir, largest):
    peaks = fetch.global_peak(_one(spark, sf_dir).results, largest)
    # tables without stamps have the place of a peak in their index
    return peaks.select("table", "id", "value", "ts", F.when(F.col("ts").isNull(), F.col("peak_row")).alias("peak_row"))


@query(_ALL + """ select "table", id, value, ts, row_ix as peak_row from (select *, row_number() over (partition by "table", id order by value desc, ts, row_ix) as n from a) where n = 1""")
def global_max(spark, sf_dir):
    return _global(spark, sf_dir, True)


@query(_ALL + """ select "table", id, value, ts, row_ix as peak_row from (select *, row_number() over (partition by "table", id order by value, ts, row_ix) as n from a) where n = 1""")
def global_min(spark, sf_dir):
    return _global(spark, sf_dir, False)


@query("""select cast(date_trunc('month', ts) as timestamp) as ts, id - 100 as id, max(value) as value, min(ts) filter (value = top) as peak_ts
 from (select *, max(value) over (partition by id, date_trunc('month', ts)) as top from d1) group by 1, 2""")
def local_peaks(spark, sf_dir):
    ds = _one(spark, sf_dir)
    return get_results(ds, [Variable("monthly", None, None, None)], output_type="local_max", layout="long").select("ts", "id", "value", "peak_ts")


def _hourly(spark, sf_dir, **options):
    return get_results(_one(spark, sf_dir), [Variable("hourly", None, None, None)], layout="long", **options).select("id", "ts", "units", "value")


@query("""select id, ts, case units when 'J' then 'MJ' else units end as units, case units when 'J' then value * cast('1e-6' as double) else value end as value
 from hg join v using (id)""")
def convert_energy(spark, sf_dir):
    return _hourly(spark, sf_dir, energy_units="MJ")


@query("""select id, ts, case units when 'W' then 'kBtu/h' when 'W/m2' then 'kBtu/h-ft2' else units end as units,
 case units when 'W' then value * cast('3.4121412858518e-3' as double) when 'W/m2' then value * (cast('3.4121412858518e-3' as double) / cast('10.7639104167097' as double)) else value end as value from hg join v using (id)""")
def convert_rate(spark, sf_dir):
    return _hourly(spark, sf_dir, rate_units="kBtu/h")


@query("""select id, ts, case units when 'C' then 'F' when 'W/m2' then 'W/sqf' else units end as units,
 case units when 'C' then value * cast('1.8' as double) + 32 when 'W/m2' then value * (cast(1 as double) / cast('10.7639104167097' as double)) else value end as value from hg join v using (id)""")
def convert_ip(spark, sf_dir):
    return _hourly(spark, sf_dir, units_system="IP")


@query("""select id, ts, case units when 'W' then 'J' when 'W/m2' then 'J/m2' else units end as units, case when units in ('W', 'W/m2') then value * 3600 else value end as value
 from hg join v using (id)""")
def rate_to_energy_hourly(spark, sf_dir):
    return _hourly(spark, sf_dir, rate_to_energy=True)


@query("""select id, ts, case units when 'W' then 'J' else units end as units, case when units = 'W' then value * (day(last_day(ts)) * cast(86400 as double)) else value end as value
 from m1g join v using (id) where file_id = 1 and "table" = 'monthly'""")
def rate_to_energy_monthly(spark, sf_dir):
    out = get_results(_one(spark, sf_dir), [Variable("monthly", None, None, None)], rate_to_energy=True, layout="long")
    return out.select("id", "ts", "units", "value")


@query("""select coalesce(a.ts, b.ts) as ts, a.value as monthly_value, b.value as daily_value from
 (select * from d1g where id = 101) b
 full join (select * from m1g where id = 1) a on a.ts = b.ts""")
def align_tables(spark, sf_dir):
    out = get_results(_one(spark, sf_dir), [Variable("monthly", "BLOCK0:ZONE1", "A", "J"), Variable("daily", "BLOCK0:ZONE1", "A", "J")], table_formatter=TableFormatter(None, include_table_name=True))
    a, b = (F.col(f"`{t}|BLOCK0:ZONE1|A|J`") for t in ("monthly", "daily"))
    return out.select(F.col("timestamp").alias("ts"), a.alias("monthly_value"), b.alias("daily_value"))


@query("select coalesce(a.ts, b.ts) as ts, a.value as value1, b.value as value2 from (select * from m1g where id = 5) a full join (select * from m2g where id = 5) b on a.ts = b.ts")
def align_files(spark, sf_dir):
    ds = load(spark, sf_dir)
    out = get_results([ds.file(1), ds.file(2)], [Variable("monthly", "BLOCK1:ZONE1", "N", "W")], table_formatter=TableFormatter("column"))
    out = out.select(F.col("timestamp").alias("ts"), F.col("`file1|BLOCK1:ZONE1|N|W`").alias("value1"), F.col("`file2|BLOCK1:ZONE1|N|W`").alias("value2"))
    return out


@query("select ts, case when day(ts) = 1 then 'Holiday' else dayname(ts) end as day, value from d1g where id = 102")
def include_day(spark, sf_dir):
    ds = _one(spark, sf_dir)
    return fetch.with_day(ds, fetch.values(ds, "daily", [102])).select("ts", "day", "value")


@query("select strftime(ts, '%d/%m/%Y at %H:%M') as at, value from hg where id = 201")
def timestamp_format(spark, sf_dir):
    out = get_results(_one(spark, sf_dir), [Variable("hourly", "SITE", "click", "W")], table_formatter=TableFormatter(None, timestamp_format="%d/%m/%Y at %H:%M"))
    return out.select(F.col("timestamp").alias("at"), F.col("`SITE|click|W`").alias("value"))


@query("select 'file1' as file, ts, value from m1g where id = 3 union all select 'file2', ts, value from m2g where id = 3")
def file_name_row(spark, sf_dir):
    ds = load(spark, sf_dir)
    out = get_results([ds.file(1), ds.file(2)], [Variable("monthly", "BLOCK0:ZONE1", "R", "C")])
    return out.select("file", F.col("timestamp").alias("ts"), F.col("`BLOCK0:ZONE1|R|C`").alias("value"))


def _aggregated(spark, sf_dir, request, func):
    ds, new, _ = aggregate.aggregate_variables(_one(spark, sf_dir), [request], func)
    return ds.results.where(F.col("id") == new), ds.variables.where(F.col("id") == new)


@query("select ts, 100 as id, coalesce(cast(sum(cast(value as decimal(18,2))) as double), 0) as value from m1g where id in (1, 4, 7, 10) group by ts")
def aggregate_sum(spark, sf_dir):
    rows, _ = _aggregated(spark, sf_dir, Variable("monthly", None, "A", "J"), "sum")
    return rows.select("ts", "id", F.col("value").cast("decimal(18,2)").cast("double").alias("value"))


@query("select ts, round(avg(value), 6) as value from m1g where id in (3, 6, 9, 12) group by ts")
def aggregate_mean(spark, sf_dir):
    rows, _ = _aggregated(spark, sf_dir, Variable("monthly", None, "R", "C"), "mean")
    return rows.select("ts", F.round("value", 6).alias("value"))


@query("""select ts, max(case when id = 201 then value * 3600 else value end) as value, 'J' as units, 'Custom Key - max' as key, 'Custom Type' as type from hg where id in (201, 202) group by ts""")
def aggregate_energy_rate(spark, sf_dir):
    ds, new, _ = aggregate.aggregate_variables(_one(spark, sf_dir), [Variable("hourly", "SITE", "click", "W"), Variable("hourly", "SITE", "error", "J")], "max")
    head = ds.variables.where(F.col("id") == new).select("id", "units", "key", "type")
    return ds.results.where(F.col("id") == new).join(F.broadcast(head), "id").select("ts", "value", "units", "key", "type")


@query("""select cast(g.new_id as int) as id, x."table", x.ts, x.row_ix, w.type as key, w.units, round(case when w.units = 'J' then coalesce(sum(x.value), 0) else avg(x.value) end, 4) as value from (
  select 'monthly' as "table", *, cast(null as bigint) as row_ix from m1g union all select 'daily', *, null from d1g union all select 'hourly', *, null from hg union all select 'parts', null, id, value, row_ix from pg) x
 join (select id, "table", type, units from v where file_id = 1) w using (id)
 join (select "table", type, row_number() over (order by table_pos, min(id)) as new_id from v where file_id = 1 and not is_simple and id <> 401 group by "table", table_pos, type) g on g."table" = x."table" and g.type = w.type
 where w."table" = x."table" group by 1, 2, 3, 4, 5, 6""")
def totals(spark, sf_dir):
    ds = derive.totals(_one(spark, sf_dir))
    rows = ds.results.join(F.broadcast(ds.variables.select("table", "id", "key", "units")), ["table", "id"])  # a row a group
    return rows.select("id", "table", "ts", F.when(F.col("ts").isNull(), F.col("row_ix")).alias("row_ix"), "key", "units", F.round("value", 4).alias("value"))


@query("""select p_partkey as id, case when p_brand = 'Brand#1' then 'Windows' when split_part(p_type, ' ', 1) = 'ECONOMY' then 'Meter' else split_part(p_type, ' ', 1) end as group_key,
  case when p_brand <> 'Brand#1' and split_part(p_type, ' ', 1) = 'ECONOMY' then split_part(p_type, '#', -1) else p_type end as group_type from part""", model_sql=False)
def totals_grouping(spark, sf_dir):
    kind = F.substring_index("p_type", " ", 1)
    key = F.when(F.col("p_brand") == "Brand#1", F.concat(F.lit("X_WIN"), F.col("p_partkey"))).when(kind == "ECONOMY", "Meter").otherwise("A")
    head = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), key.alias("key"), F.col("p_type").alias("type"), F.lit("J").alias("units"))
    return derive.grouped(head).select("id", "group_key", "group_type")


@query("""select cast(n.new_id as int) as id, w."table", x.ts, w.key, w.type, round(x.value, 2) as value from (
  select a.ts, a.id, a.value - b.value as value from m1g a join m2g b on a.id = b.id and a.ts = b.ts union all select a.ts, a.id, a.value - b.value from d1g a join d2g b on a.id = b.id and a.ts = b.ts) x
 join (select * from v where file_id = 1 and "table" in ('daily', 'monthly')) w using (id)
 join (select id, row_number() over (order by id <= 100, id) - 1 as new_id from (select distinct a.id from m1 a join m2 b on a.id = b.id and a.ts = b.ts union select distinct a.id from d1 a join d2 b on a.id = b.id and a.ts = b.ts)) n using (id)""")
def diff(spark, sf_dir):
    ds = derive.diff(load(spark, sf_dir), 1, 2)
    rows = ds.results.join(F.broadcast(ds.variables.select("table", "id", "key", "type")), ["table", "id"])  # a row a variable
    return rows.select("id", "table", "ts", "key", "type", F.round("value", 2).alias("value"))


@query("""select 'monthly' as "table", count(*) as "rows", true as day, true as n_days from (select unnest(generate_series(min(ts), max(ts), interval 1 month)) as ts from m1)
  join (select unnest(generate_series(min(ts), max(ts), interval 1 month)) as ts from m2) using (ts) union all
 select 'daily', count(*), true, true from (select unnest(generate_series(min(ts), max(ts), interval 1 day)) as ts from d1) join (select unnest(generate_series(min(ts), max(ts), interval 1 day)) as ts from d2) using (ts)""")
def diff_special(spark, sf_dir):
    ds = load(spark, sf_dir)
    return derive.special_equal(ds.file(1).steps, ds.file(2).steps)


@query("""select p_partkey as id, case when n = 0 then p_brand else p_brand || ' (' || n || ')' end as key from (
  select *, row_number() over (partition by lower(p_brand), lower(p_type) order by p_partkey) - 1 as n from part)""", model_sql=False)
def duplicate_rename(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    head = part.select(F.lit(1).alias("file_id"), F.lit("t").alias("table"), F.lit(0).alias("table_pos"), F.col("p_partkey").cast("int").alias("id"), F.col("p_partkey").cast("int").alias("pos"), F.lit(False).alias("is_simple"), F.col("p_brand").alias("key"), F.col("p_type").alias("type"), F.lit("J").alias("units"))
    return lookup.renamed_duplicates(head).select(F.col("id").cast("long").alias("id"), "key")


@query("select distinct 'monthly' as \"table\", id from m2 union all select distinct 'daily', id from d2")
def all_null_drop(spark, sf_dir):
    return lookup.without_empty(_one(spark, sf_dir, 2)).variables.select("table", "id")


@query("select g.id, g.ts, d1.value from (select id, ts from (select id from v where file_id = 1 and \"table\" = 'daily') i, (select cast(unnest(generate_series(min(ts), max(ts), interval 1 day)) as timestamp) as ts from d1) t) g left join d1 using (id, ts)")
def missing_step_fill(spark, sf_dir):
    ds = _one(spark, sf_dir)
    some = Dataset(ds.files, ds.variables, ds.steps, ds.results.where("value is not null"), ds.texts, ds.peaks)
    return fetch.filled(some, "daily").select("id", "ts", "value")


@query("""select event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (order by event_id rows between unbounded preceding and current row) as step,
  cast(sum(case when event_type = 'error' then 1 else 0 end) over (order by event_id rows between unbounded preceding and current row) as int) as env from events""", model_sql=False)
def forward_fill_parse(spark, sf_dir):
    kind = F.col("event_type")
    line = F.when(kind == "error", "1,env,0,0,0,0").when(kind == "signup", "3,1,1,1,0,Monday").otherwise(F.concat(F.lit("77,"), F.col("value").cast("string")))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(F.col("event_id") / 1000).alias("blk"), F.col("event_id").alias("mid"), line.alias("line"))
    return eso.with_steps(rows, 6).select(F.col("mid").alias("event_id"), F.col("step.mid").alias("step"), "env")


@query("""select l_orderkey, l_linenumber, cast(cast(l_shipdate as date) as timestamp) + to_minutes(cast(case when h = 0 then mi when mi = 60 then h * 60 else (h - 1) * 60 + mi end as int)) as ts
 from (select *, l_partkey % 25 as h, 1 + l_suppkey % 60 as mi from lineitem)""", model_sql=False)
def interval_timestamp(spark, sf_dir):
    d = F.col("l_shipdate")
    ts = tl.interval_stamp(F.year(d), F.month(d), F.dayofmonth(d), F.col("l_partkey") % 25, 1 + F.col("l_suppkey") % 60)
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", ts.alias("ts"))


@query("""select o_orderkey, make_timestamp(case when o_custkey % 3 = 0 then 2002 else year(o_orderdate) end, month(o_orderdate), day(o_orderdate), 0, 0, 0) + to_hours(cast(o_orderkey % 25 as int)) as ts from orders""", model_sql=False)
def database_timestamp(spark, sf_dir):
    d = F.col("o_orderdate")
    year = F.when(F.col("o_custkey") % 3 == 0, F.lit(0)).otherwise(F.year(d))
    # leap days of rows without year would not exist in 2002
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", tl.database_stamp(year, F.month(d), F.least(F.dayofmonth(d), F.when(F.month(d) == 2, 28).otherwise(31)), F.col("o_orderkey") % 25, F.lit(0)).alias("ts"))


ORACLES["database_timestamp"] = ORACLES["database_timestamp"].replace("day(o_orderdate), 0", "least(day(o_orderdate), case when month(o_orderdate) = 2 then 28 else 31 end), 0")


@query("""select o_orderkey, cast(2002 + sum(case when md <= prev then 1 else 0 end) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and current row) as int) as year from (
  select *, lag(md) over (partition by o_custkey order by o_orderkey) as prev from (select *, month(o_orderdate) * 100 + day(o_orderdate) as md from orders))""", model_sql=False)
def year_wrap(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.month("o_orderdate").alias("month"), F.dayofmonth("o_orderdate").alias("day"), F.lit(0).alias("hour"), F.lit(0).alias("end_minute"))
    return tl.wrapped_year(rows, 2002, ["o_custkey"], "o_orderkey").select("o_orderkey", "year")


@query("select \"table\", ts, n_days from (select 'monthly' as \"table\", ts, cast(day(last_day(ts)) as int) as n_days from m1t union all select 'annual', ts, case when year(ts) % 4 = 0 and (year(ts) % 100 <> 0 or year(ts) % 400 = 0) then 366 else 365 end from m1t union all select 'runperiod', ts, cast(date_diff('day', (select min(ts) from m1t), last_day(ts)) + 1 as int) from m1t)")
def n_days_monthly(spark, sf_dir):
    """Days of steps of each kind from days counted since the first stamp, as files give them."""
    steps = _one(spark, sf_dir).steps.where("table = 'monthly'").select("row_ix", "ts")
    start = steps.agg(F.min("ts").alias("start"))
    rows = steps.crossJoin(F.broadcast(start)).withColumn("c", F.datediff(F.last_day("ts"), "start") + 1)  # one row
    rows = rows.withColumn("table", F.explode(F.array(*[F.lit(t) for t in ("monthly", "annual", "runperiod")])))
    w = Window.partitionBy("table").orderBy("row_ix")
    return rows.select("table", "ts", tl.n_days(F.col("table"), F.col("ts"), F.col("c"), w).alias("n_days"))


@query("select 'monthly' as \"table\", ts, case when rn = 1 then (select min(ts) from h) else ts end as fixed from (select *, row_number() over (order by ts) as rn from (select cast(unnest(generate_series(min(ts), max(ts), interval 1 month)) as timestamp) as ts from m1))")
def first_stamp(spark, sf_dir):
    steps = _one(spark, sf_dir).steps.where("table in ('monthly', 'hourly')")
    fixed = tl.first_stamp_fixed(steps).where("table = 'monthly'").select("table", "row_ix", F.col("ts").alias("fixed"))
    return fixed.join(steps.select("table", "row_ix", "ts"), ["table", "row_ix"]).select("table", "ts", "fixed")


ORACLES["first_stamp"] = ORACLES["first_stamp"].replace("(select min(ts) from h)", "(select cast(date_trunc('day', min(ts)) as timestamp) from h)")


@query("""select 'hourly' as "table", 3600.0::double as step_s, true as is_hourly, false as is_daily, false as is_timestep union all select 'daily', 86400.0, false, true, false
 union all select 'orders', 86400.0, false, true, false union all select 'monthly', null, false, false, false""", model_sql=False)
def interval_kinds(spark, sf_dir):
    return u.step_kinds(_one(spark, sf_dir).steps).select("table", "step_s", "is_hourly", "is_daily", "is_timestep")


@query("select 100 as id, 'TWICE' as key, ts, value * 2 as value from m1g where id = 1")
def insert_variable(spark, sf_dir):
    ds = _one(spark, sf_dir)
    rows = ds.results.where("table = 'monthly' and id = 1").select("row_ix", (F.col("value") * 2).alias("value"))
    ds, new, var = mutate.insert_variable(ds, Variable("monthly", "TWICE", "A", "J"), rows)
    return ds.results.where(F.col("id") == new).select("id", F.lit(var.key).alias("key"), "ts", "value")


@query("select \"table\", id, case when \"table\" = 'hourly' and type = 'view' then 'PLACE' else key end as key, type, units from v where file_id = 1")
def rename_variable(spark, sf_dir):
    ds, _, _ = mutate.rename_variable(_one(spark, sf_dir), Variable("hourly", "SITE", "view", ""), new_key="PLACE")
    return ds.variables.select(*_HEAD)


@query("""select "table", id, ts, value from (select 'monthly' as "table", * from m1g union all select 'hourly', * from hg union all select 'daily', * from d1g union all select 'orders', * from og union all select 'parts', null, id, value from pg) where not ("table" = 'monthly' and id in (1, 4, 7, 10)) and id <> 203""")
def remove_variables(spark, sf_dir):
    ds = mutate.remove_variables(_one(spark, sf_dir), [Variable("monthly", None, "A", None), Variable("hourly", None, "purchase", None)])
    return ds.results.select("table", "id", "ts", "value")


@query("select \"table\", ts, value from (select 'hourly' as \"table\", id, ts, value + 1 as value from hg where id = 205)")
def update_values(spark, sf_dir):
    ds = _one(spark, sf_dir)
    rows = ds.results.where("id = 205").select("row_ix", (F.col("value") + 1).alias("value"))
    return mutate.update_values(ds, "hourly", 205, rows).results.where("id = 205").select("table", "ts", "value")


@query('select file_id, "table", count(*) as n from v group by 1, 2')
def counts(spark, sf_dir):
    return load(spark, sf_dir).counts()


@query("select min(p_partkey) as start, max(p_partkey) + 1 as stop, cast(1 as bigint) as step, true as is_range from part", model_sql=False)
def range_detect(spark, sf_dir):
    steps = _one(spark, sf_dir).steps.where("table = 'parts'").withColumn("label", F.col("range_ix").cast("string"))
    return fetch.range_index(steps).select("start", "stop", "step", "is_range")


@query("select id, key, ts, value from og join v using (id) where is_simple and key in ('1-URGENT', '5-LOW')")
def simple_table(spark, sf_dir):
    ds = _one(spark, sf_dir)
    out = get_results(ds, [SimpleVariable("orders", "1-urgent", None), SimpleVariable("orders", "5-low", None)], layout="long")
    return out.select("id", "key", "ts", "value")


@query("select p_partkey as row_ix, p_type as text, p_retailprice as value from part", model_sql=False)
def text_variables(spark, sf_dir):
    ds = _one(spark, sf_dir)
    rows = ds.full_table("parts")
    return rows.groupBy("row_ix").agg(F.max(F.when(F.col("id") == 401, F.col("text"))).alias("text"), F.max(F.when(F.col("id") == 403, F.col("value"))).alias("value"))


@query("select true as same, false as other", model_sql=False)
def equality(spark, sf_dir):
    ds = load(spark, sf_dir)
    one = ds.file(1).table("monthly")
    return spark.createDataFrame([(mutate.equal(one, one), mutate.equal(one, ds.file(2).table("monthly")))], "same boolean, other boolean")

