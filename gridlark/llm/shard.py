"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `points` points of a ring of 64-bit hashes. A row falls on the
arc before the next point clockwise; its position is that of its text, so equal
texts lie together, or, under the law `key`, that of its id. A shard that is full passes on the rows that
come later clockwise, so loads are bounded and few rows move when a shard is
added. Laws:

* `rows`: capacities are the row counts of an even split (at most one apart), so
  all shards end exactly full;
* `bytes`: sizes count instead, up to (1 + slack) times the mean and one row;
* `key`: no bound; id and shard count alone decide, and one more shard takes
  rows only into itself.

Equal texts stay in one shard, but where a capacity ends: a group of copies can be
cut there, and one that is larger than a shard has to be.

Arcs are few, whatever the data: only their loads come to the driver, which
deals each arc's load to shards; rows find their place by their rank in the arc.
An arc is cut into cells by the position, and a cell that has more rows than
others by the id, so ranks are made in many small groups; rows that are alike are
counted before they are ranked and written out again afterwards, in pieces.

Edge cases: null ids and null texts are values like any other (a null text has
no bytes); repeated rows are rows of their own, alike ones interchangeable; only the size and
checksum of a text travel, so very long texts are like any; with fewer rows than
shards some shards stay empty; an empty table gives no rows; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlark.llm._spark import stable

_CELLS = 16  # of an arc, by position
_SPLITS = 20_000  # further cells at most
_PIECE = 8_192  # alike rows that are written out at once


def ring(shards: int, points: int) -> list[tuple[int, int]]:
    """Sorted `(position, shard)`; a shard's points don't depend on the others."""
    out = []
    for s in range(shards):
        for p in range(points):
            out.append((int.from_bytes(hashlib.sha256(f"{s}/{p}".encode()).digest()[:8], "big", signed=True), s))
    return sorted(out)


def _arc(pos, where: list[tuple[int, int]]):
    """Index of the first point at or after a position, by a search over a literal
    array of the bounded ring; past the last one it is the first."""
    bounds = F.array(*[F.lit(p) for p, _ in where])
    n = len(where)
    lo, hi = F.lit(0), F.lit(n)
    at = F.struct(lo.alias("lo"), hi.alias("hi"))
    steps = F.sequence(F.lit(1), F.lit(max(1, n.bit_length())))

    def half(acc, _):
        mid = ((acc["lo"] + acc["hi"]) / 2).cast("int")
        go = F.get(bounds, mid) < pos
        return F.when(acc["lo"] >= acc["hi"], acc).otherwise(F.struct(F.when(go, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(go, acc["hi"]).otherwise(mid).alias("hi")))

    return F.pmod(F.aggregate(steps, at, half)["lo"], F.lit(n))


def deal(loads: list[list[int]], owners: list[int], shards: int, capacity: list[float]) -> list[list[tuple[int, int, int]]]:
    """For each arc, clockwise: `(from, shard, base)` by the load before a row in
    its arc. A full shard's rest goes on to the next shard clockwise with room.

    loads: of arcs. base: what the shard had before this piece.
    """
    left, used = list(capacity), [0] * shards
    n = len(owners)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    for take_own in (True, False):  # rows on a shard's own arcs come before those passed on
        for a in range(n):
            total = loads[a][0]
            begun = sum(x[3] for x in out[a])
            if begun >= total:
                continue
            for step in range(1 if take_own else n):
                s = owners[(a + step) % n]
                give = min(total - begun, left[s])
                if give > 0:
                    out[a].append((begun, s, used[s], give))
                    left[s] -= give
                    used[s] += give
                    begun += give
                if begun >= total:
                    break
    return [[x[:3] for x in arc] for arc in out]


def shard(df: DataFrame, shards: int, law: str = "rows", id_col: str = "doc_id", text_col: str = "text", points: int = 64, slack: float = 0.0) -> DataFrame:
    """`(doc_id, size, text_crc32, law, shard, slot, grown_shard)`."""
    if law not in ("bytes", "rows", "key"):
        raise ValueError(f"no such law: {law}")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    where = ring(shards, points)
    spot = F.xxhash64(F.lit(17), F.col(f"`{id_col}`") if law == "key" else text)
    base = df.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), spot.alias("pos"))
    base = base.groupBy("doc_id", "size", "text_crc32", "pos").agg(F.count("*").alias("n"))
    base = stable(base.withColumn("arc", _arc(F.col("pos"), where).cast("int")).withColumn("part", F.pmod(F.col("pos"), F.lit(_CELLS)).cast("int")))
    spark = df.sparkSession
    weight = F.col("size") * F.col("n") if law == "bytes" else F.col("n")
    # both collected tables are bounded by arcs, cells and _SPLITS
    count = base.groupBy("arc", "part").agg(F.count("*").alias("n")).collect()
    fair = max(64, sum(r["n"] for r in count) // _SPLITS)
    splits = [(r["arc"], r["part"], -(-r["n"] // fair)) for r in count if r["n"] > fair]
    cut = F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit(5)), F.coalesce("cuts", F.lit(1)))
    base = base.join(F.broadcast(spark.createDataFrame(splits or [(-1, -1, 1)], "arc int, part int, cuts int")), ["arc", "part"], "left").withColumn("cell", F.struct("part", cut.cast("int").alias("cut")))
    loads = {(r["arc"], (r["cell"]["part"], r["cell"]["cut"])): r["w"] for r in base.groupBy("arc", "cell").agg(F.sum(weight).alias("w")).collect()}
    before, run = {}, [0] * len(where)
    for a, c in sorted(loads):
        before[a, c] = run[a]
        run[a] += loads[a, c]
    arcs = [[x] for x in run]
    total = sum(x[0] for x in arcs)
    if law == "rows":
        capacity = [total // shards + (s < total % shards) for s in range(shards)]
    elif law == "bytes":
        capacity = [(1 + slack) * total / shards] * shards
    else:
        capacity = [float("inf")] * shards
    pieces = deal(arcs, [s for _, s in where], shards, capacity)
    cells = spark.createDataFrame([(a, c, int(before[a, c])) for a, c in loads] or [(-1, (-1, -1), 0)], "arc int, cell struct<part:int,cut:int>, before long")
    dealt = spark.createDataFrame([(a, [(int(x), s, int(y)) for x, s, y in p]) for a, p in enumerate(pieces) if p] or [(-1, [])], "arc int, pieces array<struct<start:long,shard:int,base:long>>")
    order = Window.partitionBy("arc", "cell").orderBy("pos", "doc_id", "text_crc32", "size")
    ranked = base.withColumn("w", F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0)) - weight)
    # both tables are bounded by arcs, cells and _SPLITS
    placed = ranked.join(F.broadcast(cells), ["arc", "cell"]).join(F.broadcast(dealt), "arc").withColumn("first", F.col("before") + F.col("w"))
    placed = _written_out(placed).withColumn("at", F.col("first") + F.col("i") * (F.col("size") if law == "bytes" else 1)).drop("first", "i", "n")
    piece = F.element_at(F.filter("pieces", lambda x: x["start"] <= F.col("at")), -1)
    placed = placed.withColumn("piece", piece).withColumn("shard", F.col("piece.shard"))
    slot = F.col("piece.base") + F.col("at") - F.col("piece.start")
    if law == "bytes":
        # sizes differ, so positions in a shard are ranks of what lies before
        placed = stable(placed.withColumn("lies", slot).select("doc_id", "size", "text_crc32", "pos", "shard", "lies"))
        band = F.floor(F.col("lies") / F.lit(max(1, total // shards // 256)))
        per = placed.groupBy("shard", band.alias("band")).agg(F.count("*").alias("n"))
        run = Window.partitionBy("shard").orderBy("band")
        per = per.withColumn("first", F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
        inner = Window.partitionBy("shard", "band").orderBy("lies", "pos", "doc_id", "text_crc32")
        placed = placed.withColumn("band", band).withColumn("i", F.row_number().over(inner) - 1).join(F.broadcast(per), ["shard", "band"])
        slot = F.col("first") + F.col("i")
    grown = F.lit(None).cast("int")
    if law == "key":
        more = ring(shards + 1, points)
        grown = F.get(F.array(*[F.lit(s) for _, s in more]), _arc(F.col("pos"), more).cast("int")).cast("int")
    return placed.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"), grown.alias("grown_shard"))


def _written_out(df: DataFrame) -> DataFrame:
    """A row for each of the `n` alike ones, numbered `i`; great numbers in pieces
    that are dealt out first."""
    pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _PIECE))
    if not df.where(F.col("n") > _PIECE).limit(1).isEmpty():
        df = df.withColumn("k", F.explode(pieces)).repartition("doc_id", "text_crc32", "k")
    else:
        df = df.withColumn("k", F.lit(0).cast("long"))
    return df.withColumn("i", F.explode(F.sequence(F.col("k") * _PIECE, F.least(F.col("n"), (F.col("k") + 1) * _PIECE) - 1))).drop("k")


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
