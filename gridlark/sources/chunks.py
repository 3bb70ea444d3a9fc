"""Versioned storage of results files in immutable chunks.

A chunk is one Parquet file with the rows of a range of ids and rows of one table. What
belongs to a stored file says its manifest, a table with a row a chunk: kind, table,
ranges of ids and rows, number of rows and of bytes. A version of the storage is a small
file that names the files' manifests. Nothing is ever written over:

* a change writes anew the chunks that it touches, then a manifest that has them in place
  of the old ones, then the next version. A version appears by one rename onto a name that
  must be free, so readers see all of a change or nothing, and of two writers one takes
  the other's version as its base and goes on, or gives up if both changed one file;
* readers stay with the version that they have opened. `vacuum` deletes what no version
  kept refers to; until then what a failed write has left does no harm.

**Layout.** Rows are counted by cells (a table, an id and a block of rows), with the bytes
that they take before compression. Running sums over the cells cut the order (table, id,
row) where a chunk is full, so no chunk has more than `chunk_bytes` (but a single row may),
and the number of chunks is known before one is written. A task writes a chunk at a
time, small ones one after the other; none has a table as a whole.

**Summaries.** Beside each chunk of results lies one with a row a cell: number of values,
sum, least and largest and where these are first. Peaks and sums of a range of time come
from these, and only the cells at its borders are read as rows.

Copies, merges and renames of files write no rows. Paths are relative to the root, so a
storage can be moved.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark import model
from gridlark.dataset import Dataset
from gridlark.functions.naming import ids as free_ids
from gridlark.functions.naming import unique_name
from gridlark.model import SimpleVariable, Variable
from gridlark.operators.ranges import running
from gridlark.sources.files import Files, workspace

KINDS = {"variables": model.VARIABLES, "steps": model.STEPS, "results": model.RESULTS, "texts": model.TEXTS, "peaks": model.PEAKS}
MANIFEST = "kind string, table string, path string, id_low int, id_high int, row_low long, row_high long, rows long, bytes long"
_CELL = "table string, cid int, block long, n long, bytes long, row_low long, row_high long"
#: Of a cell of results: values (neither null nor NaN), their sum, the extremes and their first places.
_SUMMARY = "n_values long, total double, least double, least_row long, least_ts timestamp_ntz, most double, most_row long, most_ts timestamp_ntz, ts_low timestamp_ntz, ts_high timestamp_ntz"
#: Chunks of less share a task up to these bytes, before compression, while all cores have tasks.
TASK_BYTES = 64 << 20
_WIDTH = {"int": 4, "bigint": 8, "double": 8, "boolean": 1, "timestamp_ntz": 8, "timestamp": 8}


class Conflict(model.GridlarkError):
    """Another writer has changed the same file."""


@dataclass(frozen=True)
class Change:
    """What a change did: the version it made, chunks of the file before, those written
    anew or added, and those that went."""

    version: int
    before: int
    written: int
    dropped: int


def _own(schema: str) -> str:
    return schema.removeprefix("file_id int, ")


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _keys(df: DataFrame) -> DataFrame:
    """Rows with their place in the order: an id (0 without) and a row (days, of peaks)."""
    cid = F.col("id") if "id" in df.columns else F.lit(0)
    row = F.col("row_ix") if "row_ix" in df.columns else F.unix_date(F.to_date("ts")) if "ts" in df.columns else F.lit(0)
    return df.withColumn("cid", cid.cast("int")).withColumn("crow", F.coalesce(row, F.lit(0)).cast("long"))


def _bytes(df: DataFrame) -> Column:
    """Bytes of a row before compression."""
    fixed = sum(_WIDTH.get(f.dataType.simpleString(), 0) for f in df.schema.fields)
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) + 4 for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return reduce(lambda a, b: a + b, texts, F.lit(fixed)).cast("long")


class ChunkStore:
    def __init__(self, spark: SparkSession, root: str, chunk_bytes: int = 64 << 20, block_rows: int = 1_000):
        self.spark, self.root, self.chunk_bytes, self.block_rows = spark, root.rstrip("/"), chunk_bytes, block_rows
        self.files = Files(spark)
        self.files.make(f"{self.root}/versions")

    # versions ----------------------------------------------------------------

    def version(self) -> int:
        """The number of the latest version; 0 if there is none."""
        return max((int(n[:-5]) for n in self.files.names(f"{self.root}/versions") if n.endswith(".json")), default=0)

    def _state(self, version: int | None = None) -> dict[int, dict]:
        version = self.version() if version is None else version
        if not version:
            return {}
        at = f"{self.root}/versions/{version}.json"
        if not self.files.exists(at):
            raise KeyError(f"no version {version}")
        return {int(k): v for k, v in json.loads(self.files.read(at)).items()}

    def _commit(self, base: int, edit: Callable[[dict], dict], touched: Iterable[int], tries: int = 20) -> int:
        """Make the next version of `edit` of the latest one; files in `touched` have to be
        as they were in version `base`."""
        was = self._state(base)
        for _ in range(tries):
            latest = self.version()
            state = self._state(latest)
            if any(state.get(i) != was.get(i) for i in touched):
                raise Conflict(f"files {sorted(touched)} were changed by another writer")
            try:
                self.files.put_new(f"{self.root}/versions/{latest + 1}.json", json.dumps(edit(dict(state))).encode())
                return latest + 1
            except FileExistsError:
                continue
        raise Conflict("other writers were always quicker")

    def names(self, version: int | None = None) -> dict[int, str]:
        return {i: x["name"] for i, x in self._state(version).items()}

    def manifest(self, file_id: int, version: int | None = None) -> DataFrame:
        """A row a chunk of a stored file."""
        state = self._state(version)
        if file_id not in state:
            raise KeyError(f"no file {file_id}")
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/{state[file_id]['manifest']}")

    # layout ------------------------------------------------------------------

    def _plan(self, frames: dict[str, DataFrame], at: str) -> tuple[DataFrame, dict[str, int], dict[str, int], dict[str, int]]:
        """Cells of all rows with the chunk of each; and by kind how many rows a block has,
        and how many cells and chunks there are."""
        block, limit = dict.fromkeys(frames, self.block_rows), self.chunk_bytes
        value = F.nanvl("value", F.lit(None).cast("double"))
        here = F.struct("crow", "ts")
        aggs = [F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("crow").alias("row_low"), F.max("crow").alias("row_high"), F.count(value).alias("n_values"), F.sum(value).alias("total"), F.min(value).alias("least"), F.min_by(here, F.when(value.isNotNull(), F.struct(value, "crow"))).alias("lo"), F.max(value).alias("most"), F.max_by(here, F.when(value.isNotNull(), F.struct(value, -F.col("crow")))).alias("hi"), F.min("ts").alias("ts_low"), F.max("ts").alias("ts_high")]
        parts = []
        for kind, df in frames.items():
            ts, v = (("ts", "value") if kind == "results" else (F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("double").alias("value")))
            parts.append(_keys(df).select(F.lit(kind).alias("kind"), "table", "cid", "crow", _bytes(df).alias("size"), ts, v))
        keyed = reduce(DataFrame.unionByName, parts)
        for n in range(64):
            size = reduce(lambda c, k: c.when(F.col("kind") == k, block[k]), frames, F.when(F.lit(False), 1))
            folder = f"{at}/cells-{n}"
            keyed.groupBy("kind", "table", "cid", F.floor(F.col("crow") / size).alias("block")).agg(*aggs).write.parquet(folder)
            cells = self.spark.read.parquet(folder)
            seen = {r["kind"]: r for r in cells.groupBy("kind").agg(F.max("bytes").alias("most"), F.count(F.lit(1)).alias("n")).collect()}
            large = [k for k, r in seen.items() if 2 * r["most"] > limit and block[k] > 1]
            if not large:
                break
            for k in large:  # smaller blocks, so that chunks can be filled
                block[k] = max(1, min(block[k] // 2, block[k] * limit // (2 * seen[k]["most"])))
        width = reduce(lambda c, k: c.when(F.col("kind") == k, max(1, limit - seen[k]["most"])), seen, F.when(F.lit(False), 1))
        cells = running(cells, ["kind", "table", "cid", "block"], "bytes", at)
        chunk = F.sha2(F.concat_ws("-", "kind", "table", F.floor(F.col("before") / width).cast("string")), 256).substr(1, 24)
        cells.withColumn("chunk", chunk).drop("before").write.parquet(f"{at}/plan")
        cells = self.spark.read.parquet(f"{at}/plan")
        chunks = {r["kind"]: r["n"] for r in cells.groupBy("kind").agg(F.countDistinct("chunk").alias("n")).collect()}
        return cells, block, {k: r["n"] for k, r in seen.items()}, chunks

    def planned(self, ds: Dataset) -> DataFrame:
        """`(kind, table, chunks, rows, bytes)` that `store` will write, without writing any."""
        cells, *_ = self._plan({k: getattr(ds, k).select(*_names(_own(s))) for k, s in KINDS.items()}, workspace(self.spark))
        return cells.groupBy("kind", "table").agg(F.countDistinct("chunk").alias("chunks"), F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"))

    def _write(self, frames: dict[str, DataFrame], at: str) -> None:
        """Write rows of each kind as chunks, and their part of the manifest below `at`."""
        frames = {k: df.select(*_names(_own(KINDS[k]))) for k, df in frames.items()}
        cells, block, n, chunks = self._plan(frames, at)
        path = f"data/{uuid.uuid4().hex}"
        folder = F.concat(F.lit(f"{path}/"), "kind", F.lit("/chunk="), "chunk")
        made = cells.groupBy("kind", "table", folder.alias("path")).agg(F.min("cid").alias("id_low"), F.max("cid").alias("id_high"), F.min("row_low").alias("row_low"), F.max("row_high").alias("row_high"), F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"))
        made.select(*_names(MANIFEST)).write.parquet(f"{at}/manifest")
        for kind, df in frames.items():
            if kind not in n:
                continue
            own = cells.where(F.col("kind") == kind)
            where = own.select("table", "cid", "block", "chunk")
            rows = _keys(df).withColumn("block", F.floor(F.col("crow") / block[kind]))
            rows = rows.join(F.broadcast(where) if n[kind] <= 1_000_000 else where, ["table", "cid", "block"])
            self._chunked(rows, chunks[kind], "crow", df.columns, f"{path}/{kind}")
            if kind == "results":
                short = own.withColumns({"least_row": F.col("lo.crow"), "least_ts": F.col("lo.ts"), "most_row": F.col("hi.crow"), "most_ts": F.col("hi.ts")})
                self._chunked(short, chunks[kind], "block", _names(f"{_CELL}, {_SUMMARY}"), f"{path}/blocks")

    def _chunked(self, rows: DataFrame, chunks: int, last: str, columns: Sequence[str], path: str) -> None:
        """A file a chunk: all of its rows are in one task. Small chunks share tasks, which
        write one after the other, so that tasks and what they fetch grow with the bytes."""
        full = -(-chunks * self.chunk_bytes // TASK_BYTES)
        tasks = min(chunks, max(full, 4 * self.spark.sparkContext.defaultParallelism))
        rows.repartition(tasks, "chunk").sortWithinPartitions("chunk", "cid", last).select(*columns, "chunk").write.partitionBy("chunk").parquet(f"{self.root}/{path}")

    def _manifest_of(self, at: str, kept: DataFrame | None = None) -> tuple[str, int]:
        new = self.spark.read.schema(MANIFEST).parquet(f"{at}/manifest")
        path = f"manifests/{uuid.uuid4().hex}"
        (new if kept is None else kept.unionByName(new)).coalesce(1).write.parquet(f"{self.root}/{path}")
        return path, new.count()

    # files -------------------------------------------------------------------

    def store(self, ds: Dataset, file_id: int | None = None) -> int:
        """Write a Dataset of one file under the next free id."""
        base, at = self.version(), workspace(self.spark)
        self._write({k: getattr(ds, k) for k in KINDS}, at)
        path, _ = self._manifest_of(at)
        self.files.delete(at)
        row = ds.files.first()
        made = row["file_created"].isoformat() if row["file_created"] is not None else None
        return self._add({"name": row["file_name"], "path": row["file_path"], "created": made, "type": row["file_type"], "manifest": path}, base, file_id)

    def _add(self, entry: dict, base: int, file_id: int | None) -> int:
        chosen: list[int] = []

        def edit(state: dict) -> dict:
            chosen[:] = [next(free_ids(0, state)) if file_id is None else file_id]
            return state | {chosen[0]: entry}

        self._commit(base, edit, [] if file_id is None else [file_id])
        return chosen[0]

    def copy_file(self, file_id: int) -> int:
        """One stored file again, under the next free id; chunks are shared."""
        base = self.version()
        return self._add(self._state(base)[file_id], base, None)

    def rename_file(self, file_id: int, name: str) -> int:
        base = self.version()
        return self._commit(base, lambda s: s | {file_id: s[file_id] | {"name": name}}, [file_id])

    def delete(self, file_id: int) -> int:
        base = self.version()
        if file_id not in self._state(base):
            raise KeyError(f"no file {file_id}")
        return self._commit(base, lambda s: {i: x for i, x in s.items() if i != file_id}, [file_id])

    def copy_to(self, root: str) -> ChunkStore:
        """The latest version below another root."""
        out = ChunkStore(self.spark, root, self.chunk_bytes, self.block_rows)
        out.merge_with(self)
        return out

    def merge_with(self, other: ChunkStore) -> dict[int, int]:
        """Add another storage's files; ids that clash get the next free one, names that
        clash a number. Gives the new id of each."""
        moved, theirs = {}, other._state()
        for i, entry in theirs.items():
            folders = {f"data/{r['p'].split('/')[1]}" for r in other.manifest(i).select(F.col("path").alias("p")).distinct().collect()}
            for folder in [*sorted(folders), entry["manifest"]]:
                if not self.files.exists(f"{self.root}/{folder}"):
                    self.files.copy(f"{other.root}/{folder}", f"{self.root}/{folder}")
            base = self.version()
            mine = self._state(base)
            moved[i] = self._add(entry | {"name": unique_name(entry["name"], {x["name"] for x in mine.values()})}, base, None if i in mine else i)
        return moved

    # reading -----------------------------------------------------------------

    def _rows(self, kind: str, paths: Sequence[str], schema: str | None = None) -> DataFrame:
        schema = schema or _own(KINDS[kind])
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths])

    def chunks(self, file_id: int, kind: str, version: int | None = None, tables: Sequence[str] | None = None, ids: Sequence[int] | None = None, rows: tuple[int, int] | None = None) -> DataFrame:
        """Chunks that can hold rows of these tables, ids and range of rows."""
        out = self.manifest(file_id, version).where(F.col("kind") == kind)
        if tables is not None:
            out = out.where(F.col("table").isin(list(tables)))
        if ids is not None and kind != "steps":
            within = [F.lit(i).between(F.col("id_low"), F.col("id_high")) for i in ids]
            out = out.where(reduce(lambda a, b: a | b, within, F.lit(False)))
        if rows is not None and kind != "variables":
            out = out.where((F.col("row_low") <= rows[1]) & (F.col("row_high") >= rows[0]))
        return out

    def dataset(self, file_id: int, version: int | None = None, tables: Sequence[str] | None = None, ids: Sequence[int] | None = None) -> Dataset:
        """A stored file, or some tables and ids of it, as of a version (the latest): only
        their chunks are opened, and later changes are not seen."""
        version = self.version() if version is None else version
        entry = self._state(version).get(file_id)
        if entry is None:
            raise KeyError(f"no file {file_id}")
        made = dt.datetime.fromisoformat(entry["created"]) if entry["created"] else None
        out = {"files": self.spark.createDataFrame([(file_id, entry["path"], entry["name"], made, entry["type"])], model.FILES)}
        for kind, schema in KINDS.items():
            paths = [r["path"] for r in self.chunks(file_id, kind, version, tables, ids).select("path").collect()]  # a row a chunk
            df = self._rows(kind, paths)
            if tables is not None:
                df = df.where(F.col("table").isin(list(tables)))
            if ids is not None and "id" in df.columns:
                df = df.where(F.col("id").isin(list(ids)))
            out[kind] = df.withColumn("file_id", F.lit(file_id)).select(*_names(schema))
        return Dataset(**out)

    def load(self, file_id: int) -> Dataset:
        """A stored file; all of its chunks have to be there."""
        there = {f[f.rindex("/data/") + 1 : f.rindex("/")] for f in self.files.walk(f"{self.root}/data") if f.endswith(".parquet")}
        lost = [r["path"] for r in self.manifest(file_id).select("path").collect() if r["path"] not in there]
        if lost:
            raise model.CorruptedData(f"file {file_id} lacks {len(lost)} chunks")
        return self.dataset(file_id)

    # changes -----------------------------------------------------------------

    def _rewrite(self, file_id: int, edits: dict[str, tuple[DataFrame, Callable[[DataFrame], DataFrame]]], added: dict[str, DataFrame] | None = None) -> Change:
        """Write anew, by kind, the chunks given as rows of the manifest, as `edit` makes
        their rows, and add further rows as chunks of their own."""
        base, at = self.version(), workspace(self.spark)
        all_ = self.manifest(file_id, base)
        gone: list[str] = []
        frames = dict(added or {})
        for kind, (touched, edit) in edits.items():
            paths = [r["path"] for r in touched.select("path").collect()]  # chunks of one change
            if paths:
                gone += paths
                frames[kind] = edit(self._rows(kind, paths))
        before = all_.count()
        if not frames:
            return Change(base, before, 0, 0)
        self._write(frames, at)
        names = self.spark.createDataFrame([(p,) for p in gone], "path string")
        path, new = self._manifest_of(at, all_.join(names, "path", "left_anti").select(*_names(MANIFEST)))
        self.files.delete(at)
        number = self._commit(base, lambda s: s | {file_id: s[file_id] | {"manifest": path}}, [file_id])
        return Change(number, before, new, len(gone))

    def set_values(self, file_id: int, table: str, id: int, rows: DataFrame) -> Change:
        """Give a variable's rows `(row_ix, value)` new values. Chunks without any of these
        rows stay as they are."""
        low, high, n = rows.agg(F.min("row_ix"), F.max("row_ix"), F.count(F.lit(1))).first()
        if not n:
            return Change(self.version(), self.manifest(file_id).count(), 0, 0)
        new = rows.select(F.col("row_ix"), F.lit(id).alias("id"), F.lit(table).alias("table"), F.col("value").alias("__new"), F.lit(True).alias("__set"))
        new = F.broadcast(new) if n <= 1_000_000 else new
        value = F.when(F.col("__set"), F.col("__new")).otherwise(F.col("value"))
        edit = lambda df: df.join(new, ["table", "id", "row_ix"], "left").withColumn("value", value)
        return self._rewrite(file_id, {"results": (self.chunks(file_id, "results", None, [table], [id], (low, high)), edit)})

    def drop_variables(self, file_id: int, ids: Sequence[int]) -> Change:
        """Take variables out; of the chunks those that can hold one of them are written anew."""
        edit = lambda df: df.where(~F.col("id").isin(list(ids)))
        return self._rewrite(file_id, {k: (self.chunks(file_id, k, None, None, ids), edit) for k in ("variables", "results", "texts", "peaks")})

    def put_variable(self, file_id: int, variable: Variable | SimpleVariable, rows: DataFrame) -> tuple[int, Change]:
        """Add a variable with rows `(row_ix, value)` to a table that is there; no chunk is
        written anew. Gives its id."""
        head = self.dataset(file_id).variables
        own = head.where(F.col("table") == variable.table).agg(F.max("pos").alias("pos"), F.max("table_pos").alias("table_pos")).first()
        if own["pos"] is None:
            raise KeyError(f"no table {variable.table}")
        new = (head.agg(F.max("id")).first()[0] or 0) + 1
        kind = getattr(variable, "type", None)
        entry = self.spark.createDataFrame([(variable.table, own["table_pos"], new, own["pos"] + 1, kind is None, variable.key, kind, variable.units)], _own(model.VARIABLES))
        steps = self.dataset(file_id, tables=[variable.table]).steps.select("table", "row_ix", "ts")
        values = steps.join(rows.select("row_ix", "value"), "row_ix").withColumn("id", F.lit(new))
        return new, self._rewrite(file_id, {}, {"variables": entry, "results": values})

    def vacuum(self, keep: int = 1) -> int:
        """Delete all versions but the last `keep`, and chunks and manifests that none of
        these refers to. Gives the number of folders deleted. No writer may be at work."""
        last = self.version()
        used: set[str] = set()
        for v in range(max(1, last - keep + 1), last + 1):
            for i, entry in self._state(v).items():
                used.add(entry["manifest"])
                for r in self.manifest(i, v).select("path").collect():
                    used |= {r["path"], r["path"].replace("/results/", "/blocks/")}
        gone = 0
        for name in self.files.names(f"{self.root}/versions"):
            if int(name.split(".")[0]) <= last - keep:
                self.files.delete(f"{self.root}/versions/{name}")
        for write in self.files.names(f"{self.root}/data"):
            kinds = [(k, c) for k in self.files.names(f"{self.root}/data/{write}") for c in self.files.names(f"{self.root}/data/{write}/{k}") if c.startswith("chunk=")]
            lost = [p for k, c in kinds if (p := f"data/{write}/{k}/{c}") not in used]
            for p in [f"data/{write}"] if len(lost) == len(kinds) else lost:
                self.files.delete(f"{self.root}/{p}")
                gone += 1
        for name in self.files.names(f"{self.root}/manifests"):
            if f"manifests/{name}" not in used:
                self.files.delete(f"{self.root}/manifests/{name}")
                gone += 1
        return gone

    # summaries ---------------------------------------------------------------

    def blocks(self, file_id: int, tables: Sequence[str] | None = None, ids: Sequence[int] | None = None, version: int | None = None) -> DataFrame:
        """Summaries of cells: `(table, id, block, n, n_values, total, least, ..., ts_high)`."""
        paths = [r["path"].replace("/results/", "/blocks/") for r in self.chunks(file_id, "results", version, tables, ids).select("path").collect()]
        out = self._rows("results", paths, f"{_CELL}, {_SUMMARY}").withColumnRenamed("cid", "id")
        if tables is not None:
            out = out.where(F.col("table").isin(list(tables)))
        return out if ids is None else out.where(F.col("id").isin(list(ids)))

    def range_summary(self, file_id: int, start: dt.datetime | str | None = None, end: dt.datetime | str | None = None, tables: Sequence[str] | None = None, ids: Sequence[int] | None = None) -> DataFrame:
        """Of each variable, between two stamps (both included): rows, values, sum, least
        and largest value and where these are first. Cells that lie inside come from their
        summaries; rows are read of those at the borders alone."""
        version = self.version()
        cells = self.blocks(file_id, tables, ids, version)
        stamp = lambda x: F.lit(str(x)).cast("timestamp_ntz")
        low = F.lit(True) if start is None else F.col("ts_low") >= stamp(start)
        high = F.lit(True) if end is None else F.col("ts_high") <= stamp(end)
        touches = (F.lit(True) if start is None else F.col("ts_high") >= stamp(start)) & (F.lit(True) if end is None else F.col("ts_low") <= stamp(end))
        inner = cells.where(low & high)
        border = cells.where(touches & ~(low & high))
        edges = border.groupBy("table", "row_low", "row_high").agg(F.min("id").alias("id_low"), F.max("id").alias("id_high"))
        value = F.nanvl("value", F.lit(None).cast("double"))
        near = self.chunks(file_id, "results", version, tables, ids).alias("c").join(edges.alias("e"), (F.col("c.table") == F.col("e.table")) & (F.col("c.row_low") <= F.col("e.row_high")) & (F.col("c.row_high") >= F.col("e.row_low")) & (F.col("c.id_low") <= F.col("e.id_high")) & (F.col("c.id_high") >= F.col("e.id_low")), "left_semi")
        rows = self._rows("results", [r["path"] for r in near.select("path").collect()])
        keys = border.select("table", "id", F.col("row_low").alias("__low"), F.col("row_high").alias("__high"))
        rows = rows.join(keys, ["table", "id"]).where(F.col("row_ix").between(F.col("__low"), F.col("__high")))
        rows = rows.where((F.lit(True) if start is None else F.col("ts") >= stamp(start)) & (F.lit(True) if end is None else F.col("ts") <= stamp(end)))
        single = rows.select("table", "id", F.lit(1).cast("long").alias("n"), value.isNotNull().cast("long").alias("n_values"), value.alias("total"), value.alias("least"), F.col("row_ix").alias("least_row"), F.col("ts").alias("least_ts"), value.alias("most"), F.col("row_ix").alias("most_row"), F.col("ts").alias("most_ts"))
        all_ = inner.select(*single.columns).unionByName(single)
        lo, hi = F.when(F.col("least").isNotNull(), F.struct("least", "least_row")), F.when(F.col("most").isNotNull(), F.struct("most", -F.col("most_row")))
        out = all_.groupBy("table", "id").agg(F.sum("n").alias("n_rows"), F.sum("n_values").alias("n_values"), F.sum("total").alias("total"), F.min("least").alias("least"), F.min_by(F.struct("least_row", "least_ts"), lo).alias("lo"), F.max("most").alias("most"), F.max_by(F.struct("most_row", "most_ts"), hi).alias("hi"))
        return out.select("table", "id", "n_rows", "n_values", "total", "least", F.col("lo.least_row").alias("least_row"), F.col("lo.least_ts").alias("least_ts"), "most", F.col("hi.most_row").alias("most_row"), F.col("hi.most_ts").alias("most_ts"))
