"""Approximate nearest neighbours by cross-polytope hashing.

A hash turns unit vectors by three rounds of random signs and fast Hadamard
transforms and takes the signed axis nearest to each. A table concatenates two
such hashes, so a table of dimension 64 has 128 ** 2 buckets. Each vector lies in one
bucket a table. A query probes the buckets with the least sum of squared gaps between
its nearest axis and the bucket's axis over the hashes; what it finds there is ranked
by the exact cosine in double precision, so only the choice of candidates is
approximate. How far it probes follows from what it finds, not from the number of
rows: a first look at some buckets of one table gives the score that an answer has to
beat, and the nearer that is, the smaller the gaps in which better ones lie (see
`radius`). So rows that are farther than that never change an answer.

Rows travel once a table, with their vector as it was given. A cell is all buckets
of a table with one hash value, so it holds about `block` rows; a bucket of more
than that is cut into cells by the row's id. Cells that many queries ask are cut on
the query's side too. Of equal vectors only as many ids as an answer can need are
sent and scored (the smallest ones, as they win ties), and no pair leaves a task but
the best few of each query.

Edge cases: vectors that are null, zero or hold null or non-finite components
take no part, nor do rows without id; vectors of other lengths are other
spaces; equal scores are ordered by the smaller id; rows of one id count as one
candidate with its best score and never answer their own id; a query id with
several vectors takes the best of them; extra columns are ignored; an empty table
or query set gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridlark.llm import _text as tx
from gridlark.llm._spark import has_rows_below, stable


def rotations(dim: int, tables: int, hashes: int, seed: int = 11) -> np.ndarray:
    """Random signs `(tables, hashes, 3, d)` with d the power of two from `dim` on."""
    d = 1 << max(0, (dim - 1).bit_length())
    rng = np.random.Generator(np.random.PCG64([seed, dim]))
    return rng.choice(np.array([-1.0, 1.0]), size=(tables, hashes, 3, d))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def turned(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Pseudo-random rotation of each row: three rounds of signs and transforms."""
    y = np.zeros((len(x), signs.shape[1]))
    y[:, : x.shape[1]] = x
    for s in signs:
        y = hadamard(y * s)
    return y


def width(dim: int) -> int:
    """Signed axes of a hash."""
    return 2 << max(0, (dim - 1).bit_length())


HASHES = 2  # concatenated in a table


def radius(score: np.ndarray, dim: int, reach: float) -> np.ndarray:
    """The sum of squared gaps up to which a query that has `score` to beat probes.

    A unit vector of cosine s is s times the query and a rest of length sqrt(1 - s^2),
    so its gaps are about as large as that rest's coordinates against s times the
    query's: their squares grow with (1 - s^2) / s^2 over the axes. Without a positive
    score (fewer than k found) every bucket is probed.
    """
    s = np.clip(np.nan_to_num(score, nan=0.0), 0.0, 1.0)
    with np.errstate(divide="ignore"):
        return reach * (1 - s * s) / (s * s) / (width(dim) // 2)


def _axes(unit: np.ndarray, signs: np.ndarray) -> list[np.ndarray]:
    """For each hash of a table, the coordinates along all signed axes; axis i is
    i for the positive direction and d + i for the negative one."""
    turns = [turned(unit, s) for s in signs]
    return [np.concatenate([y, -y], axis=1) for y in turns]


def buckets(unit: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The bucket of each unit vector in a table of the hashes `signs`."""
    code = np.zeros(len(unit), np.int64)
    for y in _axes(unit, signs):
        code = code * y.shape[1] + y.argmax(1)
    return code


def probed(unit: np.ndarray, signs: np.ndarray, most: int) -> np.ndarray:
    """The `most` buckets of the least sum of squared gaps for each unit vector."""
    gaps = [(y.max(1, keepdims=True) - y) ** 2 for y in _axes(unit, signs)]
    out = []
    for i in range(len(unit)):
        code, gap = np.zeros(1, np.int64), np.zeros(1)
        for g in gaps:
            w = len(g[i])
            gap = (gap[:, None] + g[i][None, :]).ravel()
            code = (code[:, None] * w + np.arange(w)[None, :]).ravel()
            if len(gap) > most:
                near = np.argpartition(gap, most - 1)[:most]
                code, gap = code[near], gap[near]
        out.append(code)
    return np.stack(out)


def _gaps(unit: np.ndarray, signs: np.ndarray) -> list[np.ndarray]:
    """For each hash, squared gaps between each vector's nearest axis and all axes."""
    return [(y.max(1, keepdims=True) - y) ** 2 for y in _axes(unit, signs)]


def _gap_of(gaps: list[np.ndarray], i: int, code: np.ndarray) -> np.ndarray:
    """The sum of squared gaps of vector i to each bucket."""
    w = gaps[0].shape[1]
    return sum(g[i][code // w ** (len(gaps) - 1 - j) % w] for j, g in enumerate(gaps))


def _within(gaps: list[np.ndarray], i: int, most: float) -> np.ndarray:
    """The buckets up to a sum of squared gaps from vector i."""
    code, gap = np.zeros(1, np.int64), np.zeros(1)
    for g in gaps:
        w = g.shape[1]
        gap, code = (gap[:, None] + g[i][None, :]).ravel(), (code[:, None] * w + np.arange(w)[None, :]).ravel()
        code, gap = code[gap <= most], gap[gap <= most]
    return code


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors and places of the rows that take part, by length of the vectors."""
    vec, ids = batch.column("vec"), batch.column("vid")
    size = pc.fill_null(pc.list_value_length(vec), 0).to_numpy(zero_copy_only=False)
    live = pc.is_valid(ids).to_numpy(zero_copy_only=False) & (size > 0)
    for d in np.unique(size[live]):
        at = np.flatnonzero(live & (size == d))
        some = vec.take(pa.array(at))
        x = pc.fill_null(some.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(len(at), d)
        with np.errstate(over="ignore", invalid="ignore"):
            ok = np.isfinite(x).all(1) & (np.abs(x).max(1) > 0)
        yield ids.take(pa.array(at[ok])).to_numpy(zero_copy_only=False).astype(np.int64), x[ok], at[ok]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@dataclass
class Grid:
    """Where buckets go: cells by table, and what is cut further."""

    groups: dict[int, int]  # cells a table, by dimension
    hot: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]  # sorted buckets of too many rows and their cuts

    def cells(self, dim: int, tab: int, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell and number of cuts of each bucket."""
        g = (tx.mix(bucket.astype(np.uint64)) % np.uint64(self.groups[dim])).astype(np.int64)
        cuts = np.ones(len(bucket), np.int64)
        hot, n = self.hot.get((dim, tab), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        if len(hot):
            at = np.minimum(np.searchsorted(hot, bucket), len(hot) - 1)
            own = hot[at] == bucket
            g, cuts = np.where(own, -1 - bucket, g), np.where(own, n[at], 1)
        return g, cuts

    def every(self, dim: int, tab: int) -> tuple[np.ndarray, np.ndarray]:
        """All cells of a table and their numbers of cuts."""
        hot, n = self.hot.get((dim, tab), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        return np.concatenate([np.arange(self.groups[dim]), -1 - hot]), np.concatenate([np.ones(self.groups[dim], np.int64), n])


def _fewer(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows to keep so that equal vectors have their k + 1 smallest ids."""
    order = np.lexsort((ids, *x.T))
    s, v = ids[order], x[order]
    new = np.concatenate([[True], (v[1:] != v[:-1]).any(1)])
    fresh = new | np.concatenate([[True], s[1:] != s[:-1]])
    nth = np.cumsum(fresh)
    keep = fresh & (nth - nth[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))] <= k)
    return np.sort(order[keep])


def _codes(df: DataFrame, tables: int) -> DataFrame:
    """`(dim, tab, bucket, n)`: rows of a batch in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x, _ in _matrices(batch):
                if not len(x):
                    continue
                unit, d = _unit(x), x.shape[1]
                for t, signs in enumerate(rotations(d, tables, HASHES)):
                    b, n = np.unique(buckets(unit, signs), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), d), pa.int32()), pa.array(np.full(len(b), t), pa.int32()), pa.array(b), pa.array(n)], ["dim", "tab", "bucket", "n"])

    return df.mapInArrow(run, "dim int, tab int, bucket long, n long")


def _index(df: DataFrame, tables: int, asked: range, grid: Grid, k: int, kind: str) -> DataFrame:
    """A row for each vector and table that is asked, with its cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, _ in _matrices(batch):
                if not len(ids):
                    continue
                keep = _fewer(ids, x, k)
                ids, x = ids[keep], x[keep]
                unit, d, n = _unit(x), x.shape[1], len(ids)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d), pa.int32()), pa.array(x.ravel()).cast(pa.float32() if kind == "float" else pa.float64()))
                turns = rotations(d, tables, HASHES)
                for t in asked:
                    b = buckets(unit, turns[t])
                    g, cuts = grid.cells(d, t, b)
                    r = (tx.mix(ids.astype(np.uint64)) % cuts.astype(np.uint64)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d), pa.int32()), pa.array(np.full(n, t), pa.int32()), pa.array(g), pa.array(r), pa.array(ids), pa.array(b), vec], ["dim", "tab", "g", "r", "vid", "bucket", "vec"])

    return df.mapInArrow(run, f"dim int, tab int, g long, r int, vid long, bucket long, vec array<{kind}>")


def _asked(df: DataFrame, tables: int, asked: range, first: int, reach: float, grid: Grid, kind: str) -> DataFrame:
    """A row for each query and cell that it asks, with the sum of squared gaps up to
    which it asks: that of its `first` nearest buckets, or, of queries with a column
    `least`, what that score to beat says."""
    known = "least" in df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for every, all_x, place in _matrices(batch):
                for a in range(0, len(every), 256):
                    ids, x = every[a : a + 256], all_x[a : a + 256]
                    d = x.shape[1]
                    if d not in grid.groups:
                        continue
                    unit, turns = _unit(x), rotations(d, tables, HASHES)
                    if known:
                        least = pc.fill_null(batch.column("least").take(pa.array(place[a : a + 256])), 0.0).to_numpy(zero_copy_only=False)
                        near = radius(least, d, reach) + 1e-12
                    for t in asked:
                        gaps = _gaps(unit, turns[t])
                        if not known:
                            near = np.array([_gap_of(gaps, i, b).max() for i, b in enumerate(probed(unit, turns[t], first))])
                        row, g, r = [], [], []
                        whole = grid.every(d, t)
                        for i in range(len(ids)):
                            # where there are few cells, they are all asked
                            cell, cuts = whole if len(whole[0]) == 1 or near[i] >= sum(y[i].max() for y in gaps) else grid.cells(d, t, _within(gaps, i, near[i]))
                            cell, at = np.unique(cell, return_index=True)
                            cuts = cuts[at]
                            g.append(np.repeat(cell, cuts))
                            r.append(np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
                            row.append(np.full(cuts.sum(), i))
                        row, g, r = np.concatenate(row), np.concatenate(g), np.concatenate(r)
                        n = len(row)
                        flat = pa.array(x[row].ravel()).cast(pa.float32() if kind == "float" else pa.float64())
                        vec = pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d), pa.int32()), flat)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d), pa.int32()), pa.array(np.full(n, t), pa.int32()), pa.array(g), pa.array(r.astype(np.int32)), pa.array(ids[row]), pa.array(near[row]), vec], ["dim", "tab", "g", "r", "vid", "near", "vec"])

    return df.mapInArrow(run, f"dim int, tab int, g long, r int, vid long, near double, vec array<{kind}>")


def _vectors(t: pa.Table, d: int) -> np.ndarray:
    return t.column("vec").combine_chunks().flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)


def _best(k: int, tables: int):
    """Best k ids of a cell for each query that asks it, of the buckets it asks."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if queries.num_rows and rows.num_rows:
            d = queries.column("dim")[0].as_py()
            qi, q = queries.column("vid").to_numpy(), _vectors(queries, d)
            ri, r, rb = rows.column("vid").to_numpy(), _vectors(rows, d), rows.column("bucket").to_numpy()
            keep = _fewer(ri, r, k)
            keep = keep[np.argsort(rb[keep], kind="stable")]
            ri, r, rb = ri[keep], r[keep], rb[keep]
            # scaled first, so that squares neither overflow nor vanish
            q, r = (x / np.abs(x).max(1, keepdims=True) for x in (q, r))
            qn, rn = np.sqrt((q * q).sum(1)), np.sqrt((r * r).sum(1))
            ru = r / rn[:, None]
            signs, near = rotations(d, tables, HASHES)[queries.column("tab")[0].as_py()], queries.column("near").to_numpy()
            held, lo, size_of = np.unique(rb, return_index=True, return_counts=True)
            for i in range(len(qi)):
                if i % 256 == 0:
                    gaps = _gaps(_unit(q[i : i + 256]), signs)
                hit = _gap_of(gaps, i % 256, held) <= near[i]
                a, size = lo[hit], size_of[hit]
                at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
                at = at[ri[at] != qi[i]]
                if not len(at):
                    continue
                seen = len(at)
                rough = ru[at] @ (q[i] / qn[i])
                m = 4 * k
                while m < len(at):  # until the best m rows have k ids
                    top = np.argpartition(-rough, m)[:m]
                    top = top[np.argsort(-rough[top])]
                    _, first = np.unique(ri[at[top]], return_index=True)
                    if len(first) >= k:
                        at = at[rough >= rough[top[np.sort(first)[k - 1]]] - 1e-9]
                        break
                    m *= 4
                score = (r[at] * q[i]).sum(1) / (rn[at] * qn[i])
                order = np.lexsort((-score, ri[at]))
                ids, score = ri[at][order], score[order]
                new = np.concatenate([[True], ids[1:] != ids[:-1]])
                ids, score = ids[new], score[new]
                top = np.argsort(-score, kind="stable")[:k]
                out[0].append(np.full(len(top), qi[i]))
                out[1].append(ids[top])
                out[2].append(score[top])
                out[3].append(np.where(np.arange(len(top)) == 0, seen, 0))
        q, v, s, n = (np.concatenate(x) if x else np.zeros(0) for x in out)
        return pa.table({"query_id": pa.array(q.astype(np.int64)), "vec_id": pa.array(v.astype(np.int64)), "score": pa.array(s.astype(np.float64)), "scored": pa.array(n.astype(np.int64))})

    return run


def nearest(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, tables: int = 6, first: int = 512, reach: float = 0.8, block: int = 65_536) -> DataFrame:
    """The k nearest found of each query: `(query_id, rank, vec_id, score, n_scored)`.

    `queries` has the same two columns. The `first` nearest buckets of one table give the
    score to beat, `radius` with `reach` what is probed of each of the `tables` tables
    then. A task has about `block` rows, and a quarter of it in queries; n_scored counts
    the rows that the query was compared with, once for each look at a table that found
    them.
    """
    one = df.schema[vec_col].dataType
    kind = "float" if isinstance(one, T.ArrayType) and isinstance(one.elementType, T.FloatType) else "double"
    as_rows = lambda x: x.select(F.col(f"`{id_col}`").cast("long").alias("vid"), F.col(f"`{vec_col}`").alias("vec"))
    rows = {r["d"]: r["n"] for r in df.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.size(F.col(f"`{vec_col}`")).alias("d")).agg(F.count("*").alias("n")).collect() if (r["d"] or 0) > 0}
    # cells of more rows for huge tables, so that the cuts that the driver knows are
    # at most 100,000 a table
    block = max(block, max(rows.values(), default=0) // 100_000)
    grid = Grid({d: -(-n // block) for d, n in rows.items()}, {})
    large = _codes(as_rows(df), tables).groupBy("dim", "tab", "bucket").agg(F.sum("n").alias("n")).where(F.col("n") > block).collect()
    for key in {(r["dim"], r["tab"]) for r in large}:
        mine = sorted((r["bucket"], -(-r["n"] // block)) for r in large if (r["dim"], r["tab"]) == key)
        grid.hot[key] = (np.array([b for b, _ in mine]), np.array([n for _, n in mine]))
    asking = as_rows(queries)
    own = Window.partitionBy("query_id")
    by_score = F.row_number().over(own.orderBy(F.desc("score"), "vec_id"))

    def look(asking: DataFrame, asked: range) -> DataFrame:
        return _look(_asked(asking, tables, asked, first, reach, grid, kind), _index(as_rows(df), tables, asked, grid, k, kind), _best(k, tables), block)

    seen = stable(look(asking, range(1)))
    least = seen.withColumn("rank", by_score).where(F.col("rank") == k).select(F.col("query_id").alias("vid"), F.col("score").alias("least"))
    found = seen.unionByName(look(asking.join(least, "vid", "left"), range(tables)))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("scored").alias("scored"))
    found = found.withColumn("n_scored", F.sum("scored").over(own)).withColumn("rank", by_score)
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_scored")


def _look(left: DataFrame, right: DataFrame, best: Callable[[pa.Table, pa.Table], pa.Table], block: int) -> DataFrame:
    """`(query_id, vec_id, score, scored)`: the best rows that queries find in their cells."""
    cell = ["dim", "tab", "g", "r"]
    # cells that many queries ask: as few as asking queries divided by the bound
    busy = stable(left.groupBy(*cell).agg(F.ceil(F.count("*") * 4 / block).cast("int").alias("qb")).where("qb > 1"))
    one = F.lit(1)
    if not busy.isEmpty():
        # a shuffled join, beyond the bound of a broadcast, would send the vectors twice
        known = F.broadcast(busy) if has_rows_below(busy, 1_000_000) else busy
        left, right, one = left.join(known, cell, "left"), right.join(known, cell, "left"), F.coalesce("qb", one)
    left = left.withColumn("q", F.pmod(F.xxhash64("vid"), one).cast("int"))
    right = right.withColumn("q", F.explode(F.sequence(F.lit(0), one - 1)))
    found = left.select(*cell, "q", "vid", "near", "vec").groupBy(*cell, "q").cogroup(right.select(*cell, "q", "vid", "bucket", "vec").groupBy(*cell, "q")).applyInArrow(best, "query_id long, vec_id long, score double, scored long")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("scored").alias("scored"))


def op1_ann(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
