"""Quality classifier from weak labels.

Heuristic labellers look at the whole text and vote bad, good or not at all.
Expectation-maximisation over the counts of vote patterns estimates for each
class how often each labeller gives each vote (its accuracy) and how common the
classes are; no gold label is used. The posteriors label a bounded sample, on
which a hashed linear scorer is trained: word shapes, pairs of shapes and binned
rates. The scorer rates every text.

Votes of all documents are counted (at most 3^labellers patterns reach the
driver); `sample` bounds the documents that the scorer is trained on.

Edge cases: null texts and texts without a word get quality 0 and are not kept;
very long texts are read whole; repeated rows count each when votes are counted and
once in the sample; a quality of exactly one half is kept; an empty table gives an
empty result; in `keep_good` all columns of the input stay as they are, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm import _text as tx
from gridlark.llm._linear import ftrl, softmax
from gridlark.llm._spark import free_names

_DIM = 1 << 14
RATES = ("symbol", "upper", "repeat", "again", "pipe", "bang", "digit", "common", "stop", "length")
#: Labellers that vote bad from the first bound on, and good up to the second.
BAD_FROM = {"symbol": (0.25, 0.02), "upper": (0.5, 0.12), "repeat": (0.25, 0.03), "again": (0.3, 0.05), "pipe": (0.08, 0.005), "bang": (0.2, 0.02), "digit": (0.4, 0.1)}
LABELLERS = (*BAD_FROM, "prose")
#: Below so many words, rates say little: no vote for what is merely not bad.
FEW_WORDS = 30

_KIND = np.zeros(256, np.uint8)  # of a byte in a word's shape
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = ord("a") if _b >= 128 or _c.islower() else ord("A") if _c.isupper() else ord("0") if _c.isdigit() else _b
_ODD = np.zeros(256, bool)
_ODD[[ord(c) for c in "#$%&*@^~<>{}[]=+_\\|"]] = True
_UP, _LOW, _DIG = _KIND == ord("A"), _KIND == ord("a"), _KIND == ord("0")


def _per(doc: np.ndarray, n: int, weight=None) -> np.ndarray:
    return np.bincount(doc, weight, n)


def describe(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: words, rates by RATES; and hashed shape counts as (text, bucket, count)."""
    data, off = tx.raw(column)
    n = len(off) - 1
    s, e, doc = tx.spans(data, off, tx.SPACE)
    words = _per(doc, n)
    per = np.maximum(words, 1)
    rate = {}
    
    def span(flag: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flag) + 1, np.int32 if len(flag) < 2**31 else np.int64)
        np.cumsum(flag, out=total[1:])
        return total[e] - total[s]

    h = tx.span_hashes(data, s, e)
    odd, up, low = span(_ODD[data]), span(_UP[data]), span(_LOW[data])
    # the second byte of Latin capitals with accents tells the case
    wide = np.zeros(len(data), bool)
    if len(data) > 1:
        wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    cap = span(wide)
    rate["symbol"] = _per(doc, n, odd > 0) / per
    letters = np.maximum(_per(doc, n, up + low), 1)
    rate["upper"] = np.minimum(1, _per(doc, n, up + 2 * cap) / letters)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    rate["repeat"] = _per(doc, n, same) / per
    count = np.zeros(n)
    if len(h) > 2:
        with np.errstate(over="ignore"):
            g = tx.mix(h[:-2] * tx._SLOT[0] + h[1:-1] * tx._SLOT[1] + h[2:] * tx._SLOT[2])
        ok = doc[2:] == doc[:-2]
        key = tx.unique((doc[:-2][ok].astype(np.uint64) << np.uint64(44)) | (g[ok] >> np.uint64(20)))
        count = _per((key >> np.uint64(44)).astype(np.int64), n)
    grams = np.maximum(words - 2, 0)
    rate["again"] = np.where(grams > 0, 1 - count / np.maximum(grams, 1), 0)
    rate["pipe"] = _per(doc, n, (e - s == 1) & (data[s] == ord("|"))) / per if len(s) else np.zeros(n)
    rate["bang"] = _per(doc, n, data[e - 1] == ord("!")) / per if len(s) else np.zeros(n)
    rate["digit"] = _per(doc, n, span(_DIG[data]) > 0) / per
    rate["common"] = _per(doc, n, (e - s) <= 3) / per
    rate["stop"] = _per(doc, n, np.isin(data[e - 1], (ord("."), ord(","), ord("?"), ord(";"), ord(":")))) / per if len(s) else np.zeros(n)
    rate["length"] = _per(doc, n, e - s) / per
    # shapes: runs of one kind of byte count once
    kind = _KIND[data]
    stay = np.ones(len(kind), bool)
    stay[1:] = kind[1:] != kind[:-1]
    stay[s] = True
    at = np.concatenate([[0], np.cumsum(stay)])
    shape = tx.span_hashes(kind[stay], at[s], at[e], lower=False)
    with np.errstate(over="ignore"):
        shape = np.where(same, shape + np.uint64(1), shape)
        buckets, docs = [tx.mix(shape) % np.uint64(_DIM)], [doc]
        if len(shape) > 1:
            ok = doc[1:] == doc[:-1]
            buckets.append(tx.mix(shape[:-1] * tx._SLOT[3] + shape[1:] * tx._SLOT[4])[ok] % np.uint64(_DIM))
            docs.append(doc[:-1][ok])
    key, times = tx.unique_counts(np.concatenate(docs).astype(np.uint64) * np.uint64(_DIM) + np.concatenate(buckets))
    x = np.stack([rate[r] for r in RATES], 1) if n else np.zeros((0, len(RATES)))
    return words, x, (key // np.uint64(_DIM)).astype(np.int64), (key % np.uint64(_DIM)).astype(np.int64), times


def votes(words: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A vote of each labeller: 1 bad, 2 good, 0 none."""
    out = np.zeros((len(words), len(LABELLERS)), np.int8)
    for j, name in enumerate(LABELLERS):
        if name in BAD_FROM:
            v = x[:, RATES.index(name)]
            bad, good = BAD_FROM[name]
            few = words < (8 if name == "repeat" else FEW_WORDS)
            if name in ("again", "repeat", "digit", "upper"):
                v = np.where(few, 0.0, v)
            out[:, j] = np.where(v >= bad, 1, np.where((v <= good) | few, 2, 0))
        else:
            stop, length = x[:, RATES.index("stop")], x[:, RATES.index("length")]
            out[:, j] = np.where((stop >= 0.02) & (stop <= 0.5) & (length >= 2.5) & (length <= 12), 2, np.where((words >= FEW_WORDS) & ((stop < 0.005) | (length > 20) | (length < 1.8)), 1, np.where(words < FEW_WORDS, 2, 0)))
    return out


def expect(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, false_alarms: float = 0.002) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of `bad` for each vote pattern, P(vote | class) as
    (class, labeller, vote) and P(bad), by expectation-maximisation.

    It begins with patterns that hold a bad vote as bad; every labeller has a
    weak prior of being right, and is taken to cry wolf on at most `false_alarms`
    of the good texts.
    """
    post = np.where((patterns == 1).any(1), 0.9, 0.02)
    prior = np.array([[1.0, 0.2, 2.0], [1.0, 2.0, 0.5]])  # pseudo-counts of (none, bad, good) in good and bad texts
    scale = max(1.0, 0.001 * counts.sum())
    table, rate = np.zeros((2, patterns.shape[1], 3)), 0.0
    for _ in range(rounds):
        for c, p in ((0, 1 - post), (1, post)):
            w = p * counts
            for v in range(3):
                table[c, :, v] = (w[:, None] * (patterns == v)).sum(0) + scale * prior[c, v]
        table /= table.sum(2, keepdims=True)
        table[0, :, 1] = np.minimum(table[0, :, 1], false_alarms)
        rate = (post * counts).sum() / counts.sum()
        rate = min(max(rate, 1e-4), 0.5)
        score = [np.log(q) + np.log(table[c][np.arange(patterns.shape[1])[None, :], patterns]).sum(1) for c, q in ((0, 1 - rate), (1, rate))]
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, table, float(rate)


@dataclass
class Scorer:
    weights: np.ndarray
    table: np.ndarray
    bad_rate: float
    patterns: dict[int, float]

    def score(self, column: pa.Array) -> np.ndarray:
        words, x, doc, bucket, times = describe(column)
        n = len(words)
        w = self.weights
        z = _per(doc, n, np.sqrt(times / np.maximum(words, 1)[doc]) * w[bucket]) + w[-1]
        for j, b in enumerate(_binned(x).T):
            z += w[_DIM + j * _BINS + b]
        return np.where(words > 0, 1 / (1 + np.exp(-np.clip(z, -500, 500))), 0.0)


_BINS = 12


def _binned(x: np.ndarray) -> np.ndarray:
    top = np.array([1.0] * (len(RATES) - 1) + [24.0])
    return np.clip(np.sqrt(np.clip(x / top, 0, 1)) * _BINS, 0, _BINS - 1).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tx.chunks(batch, text):
            for a in range(0, part.num_rows, 1 << 15):
                yield part.slice(a, 1 << 15)


def _codes(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) @ (3 ** np.arange(v.shape[1]))


def fit(df: DataFrame, text_col: str = "text", sample: int = 6_000) -> Scorer:
    texts = df.select(F.col(f"`{text_col}`").cast("string").alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for part in _slices(batches):
            words, x, *_ = describe(part.column("text"))
            code, n = np.unique(_codes(votes(words, x))[words > 0], return_counts=True)
            for c, k in zip(code.tolist(), n.tolist(), strict=True):
                seen[c] = seen.get(c, 0) + k
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["code", "n"])

    got = [(r["code"], r["n"]) for r in texts.mapInArrow(vote, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()]
    dim = _DIM + len(RATES) * _BINS + 1
    if not got:
        return Scorer(np.zeros(dim), np.zeros((2, len(LABELLERS), 3)), 0.0, {})
    code, counts = np.array(got).T
    patterns = code[:, None] // 3 ** np.arange(len(LABELLERS))[None, :] % 3
    post, table, rate = expect(patterns, counts.astype(float))
    bad = dict(zip(code.tolist(), post.tolist(), strict=True))
    total = {c: float((counts * p).sum()) for c, p in ((1, post), (0, 1 - post))}
    # half of the sample from each class, as far as there are any
    share = [min(1.0, sample / 2 / max(1.0, total[c])) for c in (0, 1)]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every in _slices(batches):
            # the hash is known before anything else: most texts are not looked at
            data, off = tx.raw(every.column("text"))
            whole = tx.span_hashes(data, off[:-1], off[1:], lower=False)
            some = np.flatnonzero((whole >> np.uint64(11)).astype(np.float64) / 2**53 < max(share))
            if not len(some):
                continue
            part, whole = every.take(pa.array(some)), whole[some]
            words, x, doc, bucket, times = describe(part.column("text"))
            p = np.array([bad.get(c, 0.5) for c in _codes(votes(words, x)).tolist()])
            pick = (whole >> np.uint64(11)).astype(np.float64) / 2**53 < np.where(p > 0.5, share[1], share[0])
            at = np.flatnonzero(pick & (words > 0) & (np.abs(p - 0.5) > 0.2))
            cut = np.searchsorted(doc, np.arange(len(words) + 1))
            b = _binned(x) + _DIM + np.arange(len(RATES)) * _BINS
            xs = []
            for i in at:
                a, z = cut[i], cut[i + 1]
                xs.append(np.concatenate([bucket[a:z], b[i], [dim - 1]]).astype("<i4").tobytes() + np.concatenate([np.sqrt(times[a:z] / words[i]), np.ones(len(RATES) + 1)]).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(whole[at].view(np.int64)), pa.array(p[at]), pa.array(xs, pa.binary())], ["pick", "p", "x"])

    rows, y, weight = [], [], []
    drawn = texts.mapInArrow(features, "pick long, p double, x binary").dropDuplicates(["pick"])
    for _, p, x in sorted((r["pick"], r["p"], bytes(r["x"])) for r in drawn.collect()):
        half = len(x) // 2
        rows.append((np.frombuffer(x[:half], "<i4"), np.frombuffer(x[half:], "<f4").astype(float)))
        y.append(int(p < 0.5))
        weight.append(abs(2 * p - 1))
    w = ftrl(rows, np.array(y, np.int64), dim, 2, alpha=0.3, weight=np.array(weight), epochs=4) if rows else np.zeros((dim, 2))
    return Scorer(w[:, 1] - w[:, 0], table, rate, bad)


def score(df: DataFrame, model: Scorer, text_col: str = "text", keep: tuple[str, ...] | None = None, name: str = "quality") -> DataFrame:
    """The columns `keep` (all, by default) and the scorer's probability of good."""
    keep = tuple(df.columns if keep is None else keep)
    if name in keep:
        raise ValueError(f"column {name} would clash")
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").cast("string").alias("text"))
    kinds = [f"`{c}` {f.dataType.simpleString()}" for c, f in zip(keep, source.schema.fields, strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(part.num_columns - 1)] + [pa.array(model.score(part.column(part.num_columns - 1)))], [*keep, name])

    return source.mapInArrow(run, ", ".join([*kinds, f"`{name}` double"]))


def keep_good(df: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Rows whose text the scorer, fitted on `df` itself, finds good."""
    name, = free_names(df, "quality")
    return score(df, fit(df, text_col), text_col, name=name).where(F.col(name) >= least).drop(name)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, fit(docs), keep=("doc_id",))
    return out.select("doc_id", "quality", (F.col("quality") >= 0.5).alias("kept"))
