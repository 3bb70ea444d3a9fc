"""Parquet storage of results files.

A storage is a directory with a folder for each kind of rows, partitioned by
file_id and, where there are tables, by table; values are sorted by id inside a
partition, so a query for few variables skips row groups. `info.json` counts the
rows that must be there. All goes through the file system of the session, so a
storage can lie on any that Spark can write to.
"""

from __future__ import annotations

import io
import json
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gridlark import model
from gridlark.dataset import Dataset
from gridlark.functions.naming import ids as free_ids
from gridlark.functions.naming import unique_name
from gridlark.sources.files import Files, workspace

KINDS = {"files": model.FILES, "variables": model.VARIABLES, "steps": model.STEPS, "results": model.RESULTS, "texts": model.TEXTS, "peaks": model.PEAKS}


class Storage:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.path = spark, root, None
        self.files = Files(spark)
        self.files.make(root)

    def _info(self) -> dict:
        at = f"{self.root}/info.json"
        return {int(k): v for k, v in json.loads(self.files.read(at)).items()} if self.files.exists(at) else {}

    def _save_info(self, info: dict) -> None:
        self.files.write(f"{self.root}/info.json", json.dumps(info).encode())

    def names(self) -> dict[int, str]:
        return {i: x["name"] for i, x in self._info().items()}

    def _write(self, ds: Dataset, root: str, file_id: int) -> dict[str, int]:
        """Rows of each kind, counted while they are written."""
        rows = {}
        for kind in KINDS:
            df = getattr(ds, kind).withColumn("file_id", F.lit(file_id))
            by = ["file_id"] if kind == "files" else ["file_id", "table"]
            sort = [c for c in ("id", "row_ix") if c in df.columns]
            df = df.repartition(*by, *([F.pmod(F.col("id"), F.lit(16))] if "id" in df.columns else [])).sortWithinPartitions(*by, *sort)
            seen = Observation(f"rows-{uuid.uuid4().hex}")
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy(*by).parquet(f"{root}/{kind}")
            rows[kind] = seen.get["n"]
        return rows

    def store(self, ds: Dataset, file_id: int | None = None) -> int:
        """Write a Dataset of one file under the next free id."""
        info = self._info()
        new = next(free_ids(0, info)) if file_id is None else file_id
        rows = self._write(ds, self.root, new)
        self._save_info(info | {new: {"name": ds.files.first()["file_name"], "rows": rows}})
        return new

    def change(self, file_id: int, edit: Callable[[Dataset], Dataset]) -> Dataset:
        """Replace a stored file by what `edit` makes of it: values set, variables put in
        or dropped. The new rows are written beside the old ones, which go afterwards."""
        ds = edit(self.load(file_id))
        stage = f"{self.root}/stage-{uuid.uuid4().hex}"
        rows, name = self._write(ds, stage, file_id), ds.files.first()["file_name"]
        for kind in KINDS:
            old, new = (f"{root}/{kind}/file_id={file_id}" for root in (self.root, stage))
            if self.files.exists(new):
                self.files.move(new, old)
            else:
                self.files.delete(old)
        self.files.delete(stage)
        self._save_info(self._info() | {file_id: {"name": name, "rows": rows}})
        return self.dataset().file(file_id)

    def copy_file(self, file_id: int) -> int:
        """One stored file again, under the next free id."""
        return self.store(self.load(file_id))

    def _read(self, kind: str):
        try:
            # columns of partitions come last; the model has an order
            names = [x.split()[0] for x in KINDS[kind].split(", ")]
            return self.spark.read.schema(KINDS[kind]).parquet(f"{self.root}/{kind}").select(*names)
        except AnalysisException:
            return self.spark.createDataFrame([], KINDS[kind])

    def dataset(self) -> Dataset:
        return Dataset(*(self._read(k) for k in KINDS))

    def load(self, file_id: int) -> Dataset:
        """A stored file; the rows that should be there are counted from footers."""
        info = self._info()
        if file_id not in info:
            raise KeyError(f"no file {file_id}")
        for kind, n in info[file_id]["rows"].items():
            if self._read(kind).where(F.col("file_id") == file_id).count() != n:
                raise model.CorruptedData(f"file {file_id} lacks {kind}")
        return self.dataset().file(file_id)

    def delete(self, file_id: int) -> None:
        info = self._info()
        if file_id not in info:
            raise KeyError(f"no file {file_id}")
        for kind in KINDS:
            self.files.delete(f"{self.root}/{kind}/file_id={file_id}")
        del info[file_id]
        self._save_info(info)

    def parts(self, file_id: int | None = None) -> int:
        """How many parquet files there are."""
        at = "" if file_id is None else f"file_id={file_id}/"
        return sum(f.endswith(".parquet") and at in f for f in self.files.walk(self.root))

    def copy_to(self, root: str) -> Storage:
        self.files.make(root)
        for name in self.files.names(self.root):
            self.files.copy(f"{self.root}/{name}", f"{root}/{name}")
        return Storage(self.spark, root)

    def merge_with(self, other: Storage) -> dict[int, int]:
        """Add another storage's files; ids that clash get the next free one from
        1, names that clash a number. Gives the new id of each."""
        moved = {}
        for i, name in other.names().items():
            mine = self._info()
            new = i if i not in mine else next(free_ids(1, mine))
            ds = other.load(i)
            free = unique_name(name, set(self.names().values()))
            if free != name:
                ds = Dataset(ds.files.withColumn("file_name", F.lit(free)), ds.variables, ds.steps, ds.results, ds.texts, ds.peaks)
            moved[i] = self.store(ds, new)
        return moved

    def save_as(self, path: str) -> None:
        _pack(self.files, self.root, path, ".cfs")
        self.path = path

    def save(self) -> None:
        if self.path is None:
            raise FileNotFoundError("the storage was never saved; save_as takes a path")
        self.save_as(self.path)


def predicted_parts(ds: Dataset) -> int:
    """How many parquet files `store` will write at most: one for each file, table and
    sixteenth of ids that has rows."""
    part = lambda df, *more: df.select("file_id", "table", *more).distinct().count()
    ids = F.pmod(F.col("id"), F.lit(16))
    return ds.files.select("file_id").distinct().count() + part(ds.steps) + sum(part(df, ids) for df in (ds.variables, ds.results, ds.texts, ds.peaks))


def _pack(files: Files, root: str, path: str, suffix: str) -> None:
    """An archive of a storage; it is one file, so it goes through the driver."""
    if not path.endswith(suffix):
        raise OSError(f"{path} doesn't end with {suffix}")
    base = files._at(root)[0].makeQualified(files._at(root)[1]).toString()
    with tempfile.TemporaryFile() as local:
        with zipfile.ZipFile(local, "w", zipfile.ZIP_STORED) as z:
            for f in files.walk(root):
                if not f.endswith(".crc"):
                    z.writestr(f[len(base) + 1 :], files.read(f))
        local.seek(0)
        files.write(path, local.read())


def _unpack(files: Files, path: str, suffix: str, root: str) -> str:
    if not path.endswith(suffix):
        raise OSError(f"{path} doesn't end with {suffix}")
    with zipfile.ZipFile(io.BytesIO(files.read(path))) as z:
        for name in z.namelist():
            if not name.endswith("/"):
                files.write(f"{root}/{name}", z.read(name))
    return root


def load_storage(spark: SparkSession, path: str, root: str | None = None) -> Storage:
    out = Storage(spark, _unpack(Files(spark), path, ".cfs", root or workspace(spark)))
    out.path = path
    return out


def save_file(ds: Dataset, path: str, root: str | None = None) -> None:
    """One file as a `.cff` archive."""
    box = Storage(ds.spark, root or workspace(ds.spark))
    box.store(ds)
    _pack(box.files, box.root, path, ".cff")


def load_file(spark: SparkSession, path: str, root: str | None = None) -> Dataset:
    box = Storage(spark, _unpack(Files(spark), path, ".cff", root or workspace(spark)))
    return box.load(next(iter(box.names())))
