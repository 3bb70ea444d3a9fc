"""Importance resampling of documents towards a target distribution.

Features of a text are its runs of words, hashed into buckets. Counts of all documents and
of all target texts give each bucket a gain, the logarithm of how much likelier it is in
the target; a document's weight is the mean gain of its features. A number hashed from
the id adds noise of the Gumbel distribution, so that the k highest scores are a draw
without replacement by weight.

Buckets are a fixed number, so their counts (summed in each task, then by a shuffle) and
their gains are small arrays. The k-th score is found by radix selection on the digits of
the composite key (score, id, features, weight): each pass counts the next 16 bits of the
rows that agree with the digits found so far, and no rows come to the driver but
those counts. Only rows up to the k-th key are dealt to ranges, sorted and ranked.

Edge cases: a null text has no words; documents without features weigh 0; documents with
fewer than `min_words` words are scored and not drawn; a null id is hashed as the empty
text and comes last in ties; rows that agree in the whole key are counted, not sorted, so
any number of copies of a row may fall on the border (as many as are left are drawn);
very long texts are gone through like any; without documents there are no rows, without
target texts gains come from the documents alone; extra columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm import _text as tx
from gridlark.llm._spark import copied, running, semi_join, written

_DIGIT = 16  # bits of a pass
_TABLE = np.zeros(256, np.uint32)
for _k in range(256):
    _c = _k
    for _ in range(8):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _TABLE[_k] = _c
_LONG = 64  # bytes of a word from which it is summed by itself


def crc(data: np.ndarray, s: np.ndarray, e: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """crc32 of byte spans, going on from the values `after`; a byte of all spans at a time."""
    c = ~(np.zeros(len(s), np.uint32) if after is None else after.astype(np.uint32))
    size = e - s
    for i in np.flatnonzero(size > _LONG):
        c[i] = ~np.uint32(zlib.crc32(data[s[i] : e[i]].tobytes(), int(~c[i])))
    short = np.flatnonzero(size <= _LONG)
    short = short[np.argsort(-size[short], kind="stable")]
    x, begin, left = c[short], s[short], -size[short]
    for k in range(int(-left[0]) if len(short) else 0):
        n = int(np.searchsorted(left, -k, "left"))
        x[:n] = _TABLE[(x[:n] ^ data[begin[:n] + k]) & 255] ^ (x[:n] >> 8)
    c[short] = x
    return ~c


def features(column: pa.Array, low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every feature (runs of `low` to `high` words), the text it is in, and the
    number of words of each text."""
    data, off = tx.raw(column)
    data = tx._LOWER[data]
    s, e, doc = tx.spans(data, off, tx.PUNCT)
    space = np.array([32], np.uint8)
    state, found, where = None, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(1, high + 1):
        m = len(s) - n + 1
        if m < 1:
            break
        if state is not None:  # one word more, after a space
            zero = np.zeros(m, np.int64)
            state = crc(space, zero, zero + 1, state[:m])
        state = crc(data, s[n - 1 :], e[n - 1 :], state)
        if n >= low:
            whole = doc[n - 1 :] == doc[:m]
            found.append((state[whole] % np.uint32(buckets)).astype(np.int64))
            where.append(doc[:m][whole])
    return np.concatenate(found), np.concatenate(where), np.bincount(doc, minlength=len(off) - 1)


def bucket_counts(df: DataFrame, text_col: str, low: int, high: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket; an array for each task is summed in a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in tx.chunks(batch, "text"):
                total += np.bincount(features(part.column("text"), low, high, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in df.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier a bucket is in the target, floored."""
    b, big, all_ = len(docs), float(docs.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (big + b) / ((s + 1.0) * (all_ + b)))) for s, t in zip(docs.tolist(), target.tolist(), strict=True)], np.int64)


def scored(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, low: int, high: int, seed: int) -> DataFrame:
    """`(id, n_words, n_features, weight, score)` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.chunks(batch, "text"):
                found, where, words = features(part.column("text"), low, high, len(gain))
                n = np.bincount(where, minlength=len(words))
                if low < high:  # features of one length after another
                    found = found[np.argsort(where, kind="stable")]
                sums = np.concatenate([[0], np.cumsum(gain[found])])
                ends = np.cumsum(n)
                weight = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    return rows.withColumn("score", F.col("weight") + noise)


def _key() -> list[Column]:
    """The composite key in ascending order: highest score first, null ids last."""
    return [-F.col("score"), F.col("id").isNull().cast("long"), F.coalesce(F.col("id"), F.lit(0)).cast("long"), F.col("n_features"), F.col("weight")]


def kth_key(rows: DataFrame, key: list[Column], k: int) -> tuple[list[int], int]:
    """The k-th smallest (from 1) composite key of longs, and how many of the rows with
    exactly this key are among the first k. Radix selection: digits of 16 bits, from the
    first that differs in a field on; the counts of a digit come to the driver."""
    names = [f"f{i}" for i in range(len(key))]
    rows = rows.select(*[c.cast("long").alias(n) for c, n in zip(key, names, strict=True)])
    bounds = rows.agg(*[f(n) for n in names for f in (F.min, F.max)]).first()
    found: list[int] = []
    for i, name in enumerate(names):
        low, high = bounds[2 * i], bounds[2 * i + 1]
        width = 64 if (low < 0) != (high < 0) else (low ^ high).bit_length()
        value = low >> width if width < 64 else None
        while width:
            shift = max(0, width - _DIGIT)
            part = rows if value is None else rows.where(F.col(name).between(value << width, (value << width) + (1 << width) - 1))
            for r in sorted(part.groupBy(F.shiftright(name, shift).alias("digit")).count().collect()):
                if r["count"] >= k:
                    value, width = r["digit"], shift
                    if r["count"] == 1:  # no digit decides any more
                        return [int(x) for x in part.where(F.shiftright(name, shift) == value).first()], 1
                    break
                k -= r["count"]
            else:
                raise ValueError("fewer rows than asked for")
        found.append(low if value is None else value)
        rows = rows.where(F.col(name) == found[-1])
    return found, k


def _before(key: list[Column], bound: list[int]) -> Column:
    """Whether a key comes before the bound in order of its fields."""
    out = F.lit(False)
    for c, b in zip(reversed(key), reversed(bound), strict=True):
        out = (c < F.lit(b)) | ((c == F.lit(b)) & out)
    return out


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int], id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", words: tuple[int, int] = (1, 2), buckets: int = 10_000, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """`(id, n_words, n_features, weight, score, rank)` of every document; rank (from 1) of
    those drawn, which are floor(share of the documents with `min_words` words).

    share: numerator and denominator. words: least and greatest length of a feature. Ids
    are integers. `drawn` gives the documents themselves.
    """
    if not 1 <= words[0] <= words[1] or not 0 <= share[0] <= share[1] or buckets < 1:
        raise ValueError("words from 1 up, a share from 0 to 1 and one bucket at least")
    gain = gains(bucket_counts(docs, text_col, *words, buckets), bucket_counts(target, target_col, *words, buckets))
    rows = written(scored(docs, gain, id_col, text_col, *words, seed))
    can = F.col("n_words") >= min_words
    k = rows.where(can).count() * share[0] // share[1]
    fields = ["id", "n_words", "n_features", "weight", "score"]
    unranked = rows.withColumn("rank", F.lit(None).cast("long"))
    if k:
        key = _key()
        bound, left = kth_key(rows.where(can), key, k)
        same = can & _before(key, [*bound[:-1], bound[-1] + 1]) & ~_before(key, bound)
        above = rows.where(can & _before(key, bound)).groupBy(*fields).agg(F.count("*").alias("times"))
        border = rows.where(same).groupBy(*fields).agg(F.count("*").alias("times"))
        # rows of the border agree in the key, so in n_words with n_features of one length; else the shorter go first
        border = written(running(border, [F.col("n_words")], "times", 1, "b"))
        take = F.greatest(F.lit(0), F.least(F.col("times"), F.lit(left) - F.col("b"))).cast("long")
        taken = written(above.unionByName(border.withColumn("times", take).drop("b")).where("times > 0"))
        ranked = copied(running(taken, [*key, F.col("n_words")], "times", k), "times", "i").select(*fields, (F.col("before") + F.col("i") + 1).alias("rank"))
        rest = copied(border.withColumn("times", F.col("times") - take), "times", "i").select(*fields, F.lit(None).cast("long").alias("rank"))
        unranked = unranked.where(~(can & _before(key, bound)) & ~same).unionByName(rest).unionByName(ranked)
    return unranked.withColumnRenamed("id", id_col)


def drawn(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents of `docs` whose id is drawn, with all of their columns."""
    return semi_join(docs, chosen.where("rank is not null"), id_col)


def op13_resample(spark, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = resample(docs, target, (10, 100), words=(1, 1))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
