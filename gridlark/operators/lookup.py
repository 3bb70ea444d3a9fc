"""Finding variables: exact, by wildcard and by part, without regard to case."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlark.dataset import Dataset, with_ids
from gridlark.model import DuplicateVariable, SimpleVariable, Variable
from gridlark.operators.postings import HeaderIndex

log = logging.getLogger(__name__)
Request = Variable | SimpleVariable


def matches(request: Request, part_match: bool = False) -> Column:
    """The condition on `variables` that a request stands for."""
    out = F.col("is_simple") == isinstance(request, SimpleVariable)
    for level, value in request._asdict().items():
        if value is None:
            continue
        text = str(value).lower()
        low = F.lower(F.coalesce(F.col(level), F.lit("")))
        out &= low.contains(text) if part_match else low == text
    return out


def find(ds: Dataset, requests: Sequence[Request], part_match: bool = False) -> DataFrame:
    """`variables` rows of all requests with `req_no`; a row is given once for
    each request that it matches. To be ordered by req_no and id. Above a few requests
    the posting lists are asked instead of every row."""
    if not requests:
        return ds.variables.where("false").withColumn("req_no", F.lit(0))
    if len(requests) > 100:
        return HeaderIndex(ds.variables).find(requests, part_match).withColumn("req_no", F.col("req_no").cast("int"))
    hit = F.filter(F.array(*[F.when(matches(r, part_match), F.lit(i)) for i, r in enumerate(requests)]), lambda x: x.isNotNull())
    return ds.variables.withColumn("req_no", F.explode(hit))


def find_ids(ds: Dataset, request: Request, part_match: bool = False) -> list[int]:
    return sorted(r["id"] for r in find(ds, [request], part_match).select("id").collect())


def exists(ds: Dataset, request: Request) -> bool:
    return ds.variables.where(matches(request)).limit(1).count() > 0


def table_ids(ds: Dataset, wanted: Sequence[Request | int] | Request | int, part_match: bool = False) -> dict[str, list[int]]:
    """Ids by table for requests or ids of one file. An unknown id is a KeyError,
    a request that finds nothing a warning."""
    wanted = [wanted] if isinstance(wanted, int | Variable | SimpleVariable) else list(wanted)
    if all(isinstance(w, int) and not isinstance(w, bool) for w in wanted):
        by_id = {r["id"]: r for r in ds.header()}
        if unknown := [w for w in wanted if w not in by_id]:
            raise KeyError(f"no variables with ids {unknown}")
        return with_ids(by_id[w] for w in wanted)
    if not all(isinstance(w, Variable | SimpleVariable) for w in wanted):
        raise TypeError("variables are asked for by Variable, SimpleVariable or id, all of one kind")
    found = [(i, r) for i, w in enumerate(wanted) for r in ds.postings.find(w, part_match)]
    for i in sorted(set(range(len(wanted))) - {i for i, _ in found}):
        log.warning("not found: %s", wanted[i])
    return with_ids(r for _, r in found)


def renamed_duplicates(variables: DataFrame) -> DataFrame:
    """Header entries that repeat (case aside) get `key (1)`, `key (2)`, ... in
    order of pos; a number whose name is taken already is passed over.

    Names made of different keys differ, so each key has numbers of its own: the nth
    repeat gets the nth number that no entry of the header has taken. An entry that is
    called `key (7)` comes among the repeats of `key`, where six numbers are before it,
    and moves those after it on by one."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    of = ["file_id", "table", "__key", "__type", "__units"]
    rows = variables.withColumns({"__key": low("key"), "__type": low("type"), "__units": low("units")})
    numbered = r"(?s)\A(.*) \(([1-9][0-9]{0,17})\)\z"
    taken = rows.where(F.col("__key").rlike(numbered)).select("file_id", "table", F.regexp_extract("__key", numbered, 1).alias("__key"), "__type", "__units", F.regexp_extract("__key", numbered, 2).cast("long").alias("__number")).distinct()
    # free numbers below a taken one, so that it comes before the repeat that would have it
    taken = taken.withColumn("__n", F.col("__number") - F.row_number().over(Window.partitionBy(*of).orderBy("__number")) + 1)
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*of).orderBy("pos", "id")) - 1)
    both = rows.select(*of, "__n", F.lit(0).alias("__taken"), F.struct(*variables.columns).alias("__row")).unionByName(taken.select(*of, "__n", F.lit(1).alias("__taken")), allowMissingColumns=True)
    passed = F.sum("__taken").over(Window.partitionBy(*of).orderBy("__n", F.desc("__taken")).rowsBetween(Window.unboundedPreceding, 0))
    key = F.when(F.col("__n") == 0, F.col("__row.key")).otherwise(F.concat(F.coalesce("__row.key", F.lit("")), F.lit(" ("), (F.col("__n") + F.col("__passed")).cast("string"), F.lit(")")))
    named = both.withColumn("__passed", passed).where("__taken = 0").select("__row.*", key.alias("__new"))
    return named.withColumn("key", F.col("__new")).select(*variables.columns)


def duplicates(variables: DataFrame) -> DataFrame:
    """Header entries that repeat one with a smaller pos, case aside."""
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("key", "type", "units")]
    w = Window.partitionBy("file_id", "table", "is_simple", *low).orderBy("pos", "id")
    return variables.withColumn("__n", F.row_number().over(w)).where("__n > 1").drop("__n")


def assert_unique(ds: Dataset) -> None:
    double = {r["id"]: ds.variable(r) for r in duplicates(ds.variables).collect()}
    if double:
        clean = {i: v for i, v in ds.header_dict().items() if i not in double}
        raise DuplicateVariable(f"duplicate variables: {sorted(double)}", clean, double)


def without_empty(ds: Dataset) -> Dataset:
    """Variables that have a value in some row; the others leave header and values."""
    some = ds.results.where("value is not null").select("file_id", "table", "id").distinct()
    texts = ds.texts.where("value is not null").select("file_id", "table", "id").distinct()
    live = some.unionByName(texts)
    on = ["file_id", "table", "id"]
    return Dataset(ds.files, ds.variables.join(live, on, "left_semi"), ds.steps, ds.results.join(live, on, "left_semi"), ds.texts.join(live, on, "left_semi"), ds.peaks.join(live, on, "left_semi"))
