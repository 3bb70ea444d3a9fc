"""Results kept so that files meet row by row without a shuffle.

Each file is a bucketed table: rows lie in buckets by variable and row and are sorted
within them. Every file of a store has the same number of buckets, so a join of two files
by variable and row reads bucket beside bucket: a merge join with no exchange. A variable
is known by a hash of its header levels, and pairs of ids from both headers confirm it, so
different variables never meet. A bucket has rows of all variables, so one long variable
is spread like all others.
"""

from __future__ import annotations

import hashlib
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark import model
from gridlark.dataset import Dataset
from gridlark.model import NoResults
from gridlark.operators.derive import row_key, shared_steps
from gridlark.sources.files import Files

LEVELS = ("table", "is_simple", "key", "type", "units")
_ROWS = "table string, id int, row_ix long, ts timestamp_ntz, value double, var long, at long"
_SMALL = 1_000_000


def _variable() -> Column:
    return F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in LEVELS])


class AlignedStore:
    """Files by number under `root`, a path that all executors see. Each has a table in the
    session's catalog, named after the root; those that it lacks (in another session) are
    made known again from the folder. A store is opened with the buckets it was made with
    (KeyError otherwise); a bucket should hold some 100 MB of the largest file."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.name = f"aligned_{hashlib.sha256(self.root.encode()).hexdigest()[:16]}_{buckets}"

    def _path(self, file_id: int, kind: str) -> str:
        return f"{self.root}/{self.buckets}/{file_id}/{kind}"

    def store(self, ds: Dataset, file_id: int) -> None:
        """Keeps one file of a Dataset; a file of that number is replaced."""
        one = ds.file(file_id)
        var = one.variables.select("table", "id", _variable().alias("var"))
        rows = one.results.select("table", "id", "row_ix", "ts", "value", row_key("ts", "row_ix").alias("at"))
        rows = rows.join(one.with_size(var), ["table", "id"]).select("table", "id", "row_ix", "ts", "value", "var", "at")
        for kind in ("files", "variables", "steps"):
            getattr(one, kind).write.mode("overwrite").parquet(self._path(file_id, kind))
        table = f"{self.name}_{file_id}"
        self.spark.sql(f"drop table if exists {table}")
        Files(self.spark).delete(self._path(file_id, "results"))
        # dealt out as the buckets are, so each is written by one task, as one sorted file
        dealt = rows.repartition(self.buckets, "var", "at")
        dealt.write.bucketBy(self.buckets, "var", "at").sortBy("var", "at").option("path", self._path(file_id, "results")).format("parquet").saveAsTable(table)

    def rows(self, file_id: int) -> DataFrame:
        """`(table, id, row_ix, ts, value, var, at)` of a file."""
        table, at = f"{self.name}_{file_id}", self._path(file_id, "results")
        if not self.spark.catalog.tableExists(table):
            if not Files(self.spark).exists(at):
                raise KeyError(f"no file {file_id}")
            columns = ", ".join(f"`{c.split()[0]}` {c.split()[1]}" for c in _ROWS.split(", "))
            self.spark.sql(f"create table {table} ({columns}) using parquet clustered by (var, at) sorted by (var, at) into {self.buckets} buckets location '{at}'")
        return self.spark.table(table)

    def dataset(self, file_id: int) -> Dataset:
        rows = self.rows(file_id).select(F.lit(file_id).alias("file_id"), "table", "id", "row_ix", "ts", "value")
        kept = {kind: self.spark.read.parquet(self._path(file_id, kind)) for kind in ("files", "variables", "steps")}
        out = Dataset.of(self.spark, results=rows, **kept)
        # a difference has rows of variables that left its header
        return replace(out, results=rows.join(out.with_size(out.variables.select("table", "id")), ["table", "id"], "left_semi").select(*rows.columns))

    def aligned(self, first: int, second: int, how: str = "inner") -> DataFrame:
        """Rows of both files side by side, `(var, at, l.*, r.*)` as structs `l` and `r`;
        with `how` full, left or right also those that one of them lacks."""
        side = lambda i, name: self.rows(i).select("var", "at", F.struct("table", "id", "row_ix", "ts", "value").alias(name))
        return side(first, "l").hint("merge").join(side(second, "r"), ["var", "at"], how)

    def diff(self, first: int, second: int, to: int) -> Dataset:
        """File `first` minus file `second`, kept as file `to`, as `derive.diff` makes it
        but for ids, which are the numbers of the pairs of variables. The files are joined once: rows are written as they come, and which variables
        have a difference is read from what was written."""
        if to in (first, second):
            raise ValueError("a difference needs a number of its own")
        a, b = self.dataset(first), self.dataset(second)
        other: dict[tuple, list[int]] = {}
        for r in b.header():
            other.setdefault(tuple(r[c] for c in LEVELS), []).append(r["id"])
        pairs = [(r, i) for r in a.header() for i in other.get(tuple(r[c] for c in LEVELS), [])]
        ids = self.spark.createDataFrame([(r["id"], i, n) for n, (r, i) in enumerate(pairs)], "id int, id_b int, pair int")
        ids = F.broadcast(ids) if len(pairs) <= _SMALL else ids
        both = self.aligned(first, second).select("var", "at", "l.*", F.col("r.id").alias("id_b"), F.col("r.value").alias("y"))
        rows = both.join(ids, ["id", "id_b"]).select("table", F.col("pair").alias("id"), "row_ix", "ts", (F.col("value") - F.col("y")).alias("value"), "var", "at")
        table, path = f"{self.name}_{to}", self._path(to, "results")
        self.spark.sql(f"drop table if exists {table}")
        Files(self.spark).delete(path)
        # rows are in the buckets of both files already; they are written without a shuffle
        rows.write.bucketBy(self.buckets, "var", "at").sortBy("var", "at").option("path", path).format("parquet").saveAsTable(table)
        live = {r["id"] for r in self.rows(to).where("value is not null").select("id").distinct().collect()}  # metadata
        kept = [(n, r) for n, (r, _) in enumerate(pairs) if n in live]
        if not kept:
            raise NoResults("the files share no variables and rows")
        new = [(to, r["table"], r["table_pos"], n, r["pos"], r["is_simple"], r["key"], r["type"], r["units"]) for n, r in kept]
        self.spark.createDataFrame(new, model.VARIABLES).write.mode("overwrite").parquet(self._path(to, "variables"))
        named = [x.files.first()["file_name"] for x in (a, b)]
        made = a.files.withColumn("file_id", F.lit(to)).withColumn("file_name", F.lit(f"{named[0]} - {named[1]} - diff")).withColumn("file_type", F.lit("diff"))
        made.write.mode("overwrite").parquet(self._path(to, "files"))
        tables = self.spark.createDataFrame([(t,) for t in sorted({r["table"] for _, r in kept})], "table string")
        shared_steps(a, b, tables, to).write.mode("overwrite").parquet(self._path(to, "steps"))
        return self.dataset(to)
