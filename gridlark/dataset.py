"""The immutable facade over the tables of one or more results files.

Values are kept long: a row for each variable and step. `files` and `variables`
are metadata (a row a file, a row a header entry) and may come to the driver;
values never do. Every change makes a new Dataset.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridlark import model
from gridlark.model import SimpleVariable, Variable
from gridlark.operators.postings import Postings


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class Dataset:
    files: DataFrame
    variables: DataFrame
    steps: DataFrame
    results: DataFrame
    texts: DataFrame
    peaks: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, **tables: DataFrame) -> Dataset:
        """A Dataset of the given tables; the others are empty."""
        schemas = {"files": model.FILES, "variables": model.VARIABLES, "steps": model.STEPS, "results": model.RESULTS, "texts": model.TEXTS, "peaks": model.PEAKS}
        return cls(**{k: tables[k] if k in tables else empty(spark, s) for k, s in schemas.items()})

    @property
    def spark(self) -> SparkSession:
        return self.variables.sparkSession

    def file(self, file_id: int) -> Dataset:
        """The part of one file; filters reach the scans."""
        return self._each(lambda df: df.where(F.col("file_id") == file_id))

    def _each(self, f) -> Dataset:
        return Dataset(*(f(getattr(self, k)) for k in ("files", "variables", "steps", "results", "texts", "peaks")))

    def table(self, name: str) -> Dataset:
        only = lambda df: df.where(F.col("table") == name)
        return replace(self, variables=only(self.variables), steps=only(self.steps), results=only(self.results), texts=only(self.texts), peaks=only(self.peaks))

    def union(self, other: Dataset) -> Dataset:
        return Dataset(*(getattr(self, k).unionByName(getattr(other, k), allowMissingColumns=True) for k in ("files", "variables", "steps", "results", "texts", "peaks")))

    # what a file is asked for directly ---------------------------------------

    def get_results(self, variables, *args, **options) -> DataFrame | None:
        from gridlark.plans import results

        return results.get_results(self, variables, *args, **options)

    def aggregate_variables(self, variables, func, **options):
        from gridlark.operators import aggregate

        return aggregate.aggregate_variables(self, variables, func, **options)

    def copy(self) -> Dataset:
        """Another Dataset of the same rows; changes of either leave the other alone."""
        return replace(self)

    # catalog -----------------------------------------------------------------

    def header(self) -> list[Row]:
        """Header entries in order of files, tables and columns; read once."""
        return list(self._header)

    @cached_property
    def _header(self) -> list[Row]:
        return self.variables.orderBy("file_id", "table_pos", "table", "pos", "id").collect()

    @cached_property
    def postings(self) -> Postings:
        """Posting lists of the header, in order of ids."""
        return Postings(sorted(self.header(), key=lambda r: r["id"]))

    @cached_property
    def _dated(self) -> set[str]:
        """Tables whose rows have stamps."""
        return {r["table"] for r in self.steps.groupBy("table").agg(F.count("ts").alias("n")).where("n > 0").collect()}

    def with_size(self, head: DataFrame, bound: int = 1_000_000) -> DataFrame:
        """A part of the header, to be broadcast if the whole is within the bound."""
        return F.broadcast(head) if len(self._header) <= bound else head

    def sorted_header(self, table: str, *by: str) -> list[Row]:
        """Columns of a table in the order of header levels, ids last."""
        rows = [r for r in self.header() if r["table"] == table]
        return sorted(rows, key=lambda r: ([(r[c] is not None, r[c]) for c in by], r["id"]))

    def table_names(self) -> list[str]:
        return list(dict.fromkeys(r["table"] for r in self.header()))

    def is_simple(self, table: str) -> bool:
        return any(r["is_simple"] for r in self.header() if r["table"] == table)

    def levels(self, table: str) -> tuple[str, ...]:
        return ("id", "table", "key", "units") if self.is_simple(table) else ("id", "table", "key", "type", "units")

    def is_datetime(self, table: str) -> bool:
        return table in self._dated

    def datetime_index(self, table: str) -> DataFrame | None:
        """Stamps of a table's rows, in order of row_ix; None if it has none."""
        return self.steps.where(F.col("table") == table).select("file_id", "row_ix", "ts") if self.is_datetime(table) else None

    def ids(self, table: str | None = None) -> list[int]:
        return [r["id"] for r in self.header() if table in (None, r["table"])]

    def variable(self, row: Row) -> Variable | SimpleVariable:
        return SimpleVariable(row["table"], row["key"], row["units"]) if row["is_simple"] else Variable(row["table"], row["key"], row["type"], row["units"])

    def header_dict(self, table: str | None = None) -> dict[int, Variable | SimpleVariable]:
        return {r["id"]: self.variable(r) for r in self.header() if table in (None, r["table"])}

    def counts(self) -> DataFrame:
        """Number of variables of each table."""
        return self.variables.groupBy("file_id", "table").agg(F.count("*").alias("n"))

    def special_table(self, table: str) -> DataFrame:
        return self.steps.where(F.col("table") == table)

    def special_column(self, table: str, name: str) -> DataFrame:
        """`(file_id, row_ix, ts, name)` of a special column; KeyError without it."""
        if name not in self.steps.columns or name in ("file_id", "table", "row_ix", "ts", "range_ix", "label"):
            raise KeyError(f"no special column {name}")
        out = self.steps.where(F.col("table") == table).select("file_id", "row_ix", "ts", name)
        if out.where(F.col(name).isNotNull()).limit(1).count() == 0:
            raise KeyError(f"table {table} has no special column {name}")
        return out

    def numeric_table(self, table: str) -> DataFrame:
        return self.results.where(F.col("table") == table)

    def full_table(self, table: str) -> DataFrame:
        """Long rows with header, specials and values, texts included as strings."""
        head = self.variables.where(F.col("table") == table).select("file_id", "table", "id", "key", "type", "units")
        value = self.results.where(F.col("table") == table).select("file_id", "table", "id", "row_ix", "value", F.lit(None).cast("string").alias("text"))
        text = self.texts.where(F.col("table") == table).select("file_id", "table", "id", "row_ix", F.lit(None).cast("double").alias("value"), F.col("value").alias("text"))
        return self.steps.where(F.col("table") == table).join(value.unionByName(text), ["file_id", "table", "row_ix"]).join(self.with_size(head), ["file_id", "table", "id"])

    def __repr__(self) -> str:
        rows = self.header()
        files = {r["file_id"]: r["file_name"] for r in self.files.collect()}
        lines = [f"{i}: {name}" for i, name in files.items()]
        for t in dict.fromkeys(r["table"] for r in rows):
            lines.append(f"  {t}: {sum(r['table'] == t for r in rows)} variables")
        return "\n".join(lines)


def with_ids(found: Iterable[Row]) -> dict[str, list[int]]:
    """Ids by table, tables in order of first sight."""
    out: dict[str, list[int]] = {}
    for r in found:
        out.setdefault(r["table"], []).append(r["id"])
    return out
