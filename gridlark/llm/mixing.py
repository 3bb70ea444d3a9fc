"""Mixing sources to target weights.

Words are counted for each source; weights, dealt to the sources in order of their
names, give each its target, and no target goes above `cap` times what the source
has: what is too much is shared again by weight. The target over the source's size is
the rate at which its documents repeat. Every document is emitted floor(rate) times, and
once more where a number hashed from its id falls below the fraction of the rate.

The seed of that number is one of `tries` (turns of one hash by a fixed step): each
source takes the one that brings its words nearest to the target. So sources of few or
very unequal documents come near it too, and a rerun takes the same documents.

Only sums for each source are made from the documents; sources stay a distributed table,
numbered by ranges of names, and the shares settle by sums over that table. Sources
with a thousandth of all rows (a thousand of them at most) are known to all tasks, as are
all sources where they are few; documents of the others meet theirs in a shuffle.

Edge cases: a null text has no words; a null source is a source, last in order; a source
without words has target and rate 0; documents without words are emitted at the rate of
their source; a null id is hashed by its text; rows with equal id get the same number;
an empty table gives no rows; extra columns stay, but for those that are made.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm._spark import copied, has_rows_below, running, stable, written

WORD = r"[^\x20\x09-\x0D]+"
STEP = 2654435761  # of turns, in 2 ** 32
MADE = ["size", "source_size", "target", "rate", "copies"]


def _sized(df: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    """`df` with `_size`, `_source` and `_h`, a number below 2 ** 32 hashed from the id."""
    text, key = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`").cast("string")
    # a letter a word: no array of words is made of a very long text
    size = F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "x"), " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key, F.concat(F.lit("text:"), text), F.lit(""))), 256)
    return df.withColumns({"_size": size, "_source": F.col(f"`{source_col}`").cast("string"), "_h": F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")})


def _extra(turn: object) -> str:
    """Whether the number of a document, turned, is below the fraction of its rate."""
    return f"(pmod(_h + {turn} * {STEP}, 4294967296) + 0.5D) / 4294967296D < rate - floor(rate)"


def shares(sources: DataFrame, weights: Sequence[int], cap: float, share: float, rows: int) -> DataFrame:
    """Targets of `(source, source_size)`: by weight, up to `cap` times the size."""
    ordered = running(sources.withColumn("one", F.lit(1).cast("long")), [F.col("_source").isNotNull().desc(), F.col("_source").asc()], "one", rows, "number").drop("one")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod("number", F.lit(len(weights))) + 1).cast("int"))
    ordered = stable(ordered.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(cap)).drop("number"))
    total, heavy = ordered.agg(F.sum("source_size"), F.sum("weight")).first()
    total = share * (total or 0)
    level, full = total / heavy if heavy else 0.0, -1
    while True:  # the level rises until no source is newly full
        over = F.col("limit") < F.lit(level) * F.col("weight")
        n, used, w = ordered.agg(F.count_if(over), F.sum(F.when(over, F.col("limit"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == full or not w:
            break
        full, level = n, (total - (used or 0.0)) / w
    return ordered.withColumn("target", F.least("limit", F.lit(level) * F.col("weight"))).drop("limit", "weight")


def _meet(rows: DataFrame, sources: DataFrame, known: int) -> DataFrame:
    """`rows` with the columns of their source. Large ones are known to all tasks."""
    sources = sources.withColumnRenamed("_source", "_other")
    same = F.col("_source").eqNullSafe(F.col("_other"))
    if has_rows_below(sources, known):
        return rows.join(F.broadcast(sources), same).drop("_other")
    least = max(1.0, (sources.agg(F.sum("source_rows")).first()[0] or 0) / 1000)
    large = sources.where(F.col("source_rows") >= least)  # a thousand at most
    names = F.broadcast(large.select("_other"))
    small = sources.where(F.col("source_rows") < least)
    hot = rows.join(F.broadcast(large), same)
    cold = rows.join(names, same, "left_anti").join(small, same)
    return hot.unionByName(cold).drop("_other")


def _rates(narrow: DataFrame, weights: Sequence[int], cap: float, share: float, tries: int, known: int) -> DataFrame:
    """A row a source: sizes, target, rate and the turn of its numbers."""
    sources = written(narrow.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("source_rows")))
    rows = sources.count()
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = stable(shares(sources, weights, cap, share, rows).withColumn("rate", rate))
    met = _meet(narrow, sources, known)
    sums = [F.expr(f"sum(if({_extra(t)}, _size, 0)) as t{t}") for t in range(tries)]
    offs = ", ".join(f"struct(abs(source_size * floor(rate) + t{t} - target) as off, {t} as turn)" for t in range(tries))
    best = F.expr(f"array_min(array({offs})).turn")
    return stable(met.groupBy("_source", "source_size", "source_rows", "target", "rate").agg(*sums).withColumn("turn", best).select("_source", "source_size", "source_rows", "target", "rate", "turn"))


def _copies() -> Column:
    return F.expr(f"cast(floor(rate) + if({_extra('turn')}, 1, 0) as long)")


def _names(df: DataFrame, *more: str) -> None:
    clash = {c.lower() for c in df.columns} & {*MADE, *more, "_size", "_source", "_h", "_other", "source_rows", "turn"}
    if clash:
        raise ValueError(f"columns made would clash: {sorted(clash)}")


def planned(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[int] = (1,), cap: float = 3, share: float = 1.0, seed: int = 11, tries: int = 32, known: int = 100_000) -> DataFrame:
    """How often each document is taken: `(id, source, size, source_size, target, rate,
    copies)`. The texts are read once; what is kept of them is written.

    weights: repeat over the sources in order of names (by code point, null last).
    cap: how often a source may be taken at most. share: words of the mix by words there are.
    """
    if not weights or min(weights) <= 0 or not cap > 0 or not math.isfinite(cap) or share < 0 or share > cap or tries < 1:
        raise ValueError("weights, cap and tries are positive, share is 0 to cap")
    narrow = written(_sized(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("s"), F.col(f"`{text_col}`").alias("text")), "id", "s", "text", seed).drop("s", "text"))
    rates = _rates(narrow, weights, cap, share, tries, known)
    out = _meet(narrow, rates, known)
    return out.select(F.col("id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias("size"), "source_size", "target", "rate", _copies().alias("copies"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[int] = (1,), cap: float = 3, share: float = 1.0, seed: int = 11, tries: int = 32, known: int = 100_000) -> DataFrame:
    """The mix itself: every document as often as `planned` says, with all of its columns
    and `copy` (from 0). Texts are read twice and never written."""
    _names(df, "copy")
    sized = _sized(df, id_col, source_col, text_col, seed)
    rates = _rates(written(sized.select("_source", "_size", "_h")), weights, cap, share, tries, known)
    out = _meet(sized, rates, known).withColumn("copies", _copies())
    return copied(out, "copies", "copy").select(*[F.col(f"`{c}`") for c in df.columns], F.col("copy").cast("int").alias("copy"))


def op11_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = planned(docs, weights=(5, 2, 1))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
