"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import inspect
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder the session names.

    Only on a local master, and only where neither the context nor
    `spark.checkpoint.dir` names a folder (tests), is a temporary one set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints, which all executors and the driver see.

    On more than one machine the session has to name it; a folder of this machine's
    own would lose what executors write.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridlark-checkpoint-"))
    return sc.getCheckpointDir()


def give_back() -> None:
    """Give memory that this process has freed but keeps back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """`run`, for mapInArrow or for applyInArrow with one argument, leaves no freed memory
    with its worker. Workers live on beside the next tasks and stages, and what they keep
    counts as the executor's."""
    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def out(rows):
            try:
                yield from run(rows)
            finally:
                give_back()
    else:

        @functools.wraps(run)
        def out(rows):
            try:
                return run(rows)
            finally:
                give_back()

    return out


def written(df: DataFrame) -> DataFrame:
    """Cut lineage by a Parquet table in the folder of checkpoints. It takes a quarter
    of a checkpoint's space or less, but its rows come back in any order."""
    return written_at(df)[0]


def written_at(df: DataFrame) -> tuple[DataFrame, str]:
    """`written`, and the table's folder, for who deletes it when it has been used."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like `wanted` that no column of `df` has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def has_rows_below(df: DataFrame, limit: int) -> bool:
    """Whether `df` has at most `limit` rows; counts no further than that."""
    return df.limit(limit + 1).count() <= limit


def running(df: DataFrame, order: list[Column], amount: str, rows: int, out: str = "before", per_range: int = 1_000_000) -> DataFrame:
    """`df` with `out`: the sum of the long column `amount` over all rows before, in `order`.

    Rows are dealt to ranges of the order of about `per_range` rows (`rows` is how many
    there are), summed up in each, and the ranges' totals (a row each) are summed up
    after that; no task has more than a range. Rows that tie in `order` come in any order.
    """
    pid, = free_names(df, "range")
    schema = T.StructType([*df.schema.fields, T.StructField(pid, T.IntegerType()), T.StructField(out, T.LongType())])

    def sums(batches):
        number, total = TaskContext.get().partitionId(), 0
        for b in batches:
            x = np.asarray(b.column(b.schema.get_field_index(amount)).to_numpy(zero_copy_only=False), np.int64)
            ends = total + np.cumsum(x)
            if len(x):
                total = int(ends[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(x), number, np.int32)), pa.array(ends - x)], names=[*b.schema.names, pid, out])

    placed = written(df.repartitionByRange(max(1, -(-rows // per_range)), *order).sortWithinPartitions(*order).mapInArrow(sums, schema))
    ranges = placed.groupBy(pid).agg(F.sum(amount).alias("all"))
    ranges = ranges.select(pid, (F.sum("all").over(Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, 0)) - F.col("all")).alias("first"))
    ranges = F.broadcast(ranges)  # a row a range
    return placed.join(ranges, pid).withColumn(out, F.col(out) + F.col("first")).drop("first", pid)


def copied(df: DataFrame, times: str, number: str, piece: int = 8_192) -> DataFrame:
    """Every row as often as its long column `times` says (0: not), numbered from 0 in
    the column `number`; great numbers are dealt out in pieces."""
    k, = free_names(df, "piece")
    df = df.where(F.col(times) > 0)
    df = df.withColumn(k, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / piece))))
    return df.withColumn(number, F.explode(F.sequence(F.col(k) * piece, F.least(F.col(times), (F.col(k) + 1) * piece) - 1))).drop(k)


def semi_join(df: DataFrame, ids: DataFrame, key: str, bound: int = 2_000_000) -> DataFrame:
    """Rows of `df` whose key is in `ids`: broadcast while the checked count of
    ids stays under `bound`, a shuffled semi join beyond it."""
    ids = ids.select(key).distinct()
    if has_rows_below(ids, bound):
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_semi")


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components of `edges(u long, v long)` as `(node, comp)`.

    comp is the smallest node of the component. Minimum labels travel along
    edges and are shortened by pointer jumping; each round is checkpointed, so a
    lost executor costs one round at most. Labels and edges stay distributed.
    """
    e = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    both = stable(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    lab = stable(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("comp")))
    for _ in range(max_rounds):
        near = both.join(lab.select(F.col("node").alias("v"), F.col("comp").alias("c")), "v").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("c"))
        own = lab.join(near, "node", "left").select("node", "comp", F.least("comp", F.coalesce("c", "comp")).alias("c"))
        # a root that any of its members can leave moves with that member
        roots = own.groupBy(F.col("comp").alias("node")).agg(F.min("c").alias("r"))
        moved = own.join(roots, "node", "left").select("node", "comp", F.least("c", F.coalesce("r", "c")).alias("c"))
        moved = stable(moved)
        up = moved.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        new = stable(moved.join(up, "c", "left").select("node", F.col("comp").alias("old"), F.least("c", F.coalesce("cc", "c")).alias("comp")))
        if new.where("old <> comp").limit(1).count() == 0:
            return new.select("node", "comp")
        lab = new.select("node", "comp")
    raise RuntimeError("components did not settle")
