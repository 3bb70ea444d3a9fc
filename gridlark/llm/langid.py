"""Language identification by sparse logistic regression on character n-grams.

Texts are lower-cased, what is no letter becomes one space, and n-grams of one to
three characters are hashed. Document frequencies come from all learning
documents. The model is fitted on a bounded sample of them: of each language the
`sample / languages` rows whose texts come first by a hash, at most `sample` in
all (with more languages than that, of the languages with the most rows). It is
trained with follow-the-regularised-leader and an elastic-net penalty, and its
probabilities are calibrated by a temperature on a fifth of the sample, chosen by
the same hash, that the training has not seen. Nothing but text and language
decides which rows these are.

A prediction takes nothing but the text, the whole of it.

Edge cases: null texts and texts without a letter are `und` with score 0; rows
without language teach nothing; with no learning rows all is `und`; with a
single language its score is 1; repeated rows count each in frequencies and once in
the sample; ties between languages go to the first by name; ids take no part, so
null and repeated ones are like any; very long texts are counted in pieces; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlark.llm import _text as tx
from gridlark.llm._linear import ftrl, softmax, temperature

BITS = 16
_DIM = 1 << BITS
_LETTER: list[np.ndarray] = []
_PIECE = 1 << 20


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def _counted(key: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if times is None:
        key = np.sort(key)
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        return key[at], np.diff(np.append(at, len(key)))
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[at], np.add.reduceat(times, at)


def ngram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For up to 65536 texts: text, bucket and count of each distinct n-gram, and
    which texts have a letter."""
    cp = np.frombuffer("\0".join(texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32) if texts else np.zeros(0, np.uint32)
    some = np.zeros(len(texts), bool)
    cut = cp == 0
    if cut.sum() != len(texts) - 1:  # a text holds the separator
        cp = np.frombuffer("\0".join(t.replace("\0", " ") for t in texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        cut = cp == 0
    letter = _letters()[cp]
    keep = letter | cut
    keep[1:] |= letter[:-1]  # of other characters the first after a letter stays, as a space
    doc = np.cumsum(cut).astype(np.uint32)
    some[np.unique(doc[letter])] = True
    c, d = np.where(letter, cp, 0)[keep].astype(np.uint32), doc[keep]
    parts, times = [], []
    for a in range(0, len(c), _PIECE):
        keys = []
        with np.errstate(over="ignore"):
            for n in (1, 2, 3):
                b = min(a + _PIECE, len(c) - n + 1)
                if b <= a:
                    continue
                h = np.zeros(b - a, np.uint32)
                for k in range(n):
                    h = h * np.uint32(0x01000193) + c[a + k : b + k] * np.uint32(0x9E3779B1)
                h += np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                h ^= h >> np.uint32(12)
                ok = (d[a:b] == d[a + n - 1 : b + n - 1]) & ((c[a:b] > 0) if n == 1 else True)
                keys.append(((d[a:b] << np.uint32(BITS)) | (h & np.uint32(_DIM - 1)))[ok])
        k, t = _counted(np.concatenate(keys) if keys else np.zeros(0, np.uint32))
        parts.append(k)
        times.append(t)
    if len(parts) > 1:
        key, count = _counted(np.concatenate(parts), np.concatenate(times))
    else:
        key, count = (parts or [np.zeros(0, np.uint32)])[0], (times or [np.zeros(0, np.int64)])[0]
    return (key >> np.uint32(BITS)).astype(np.int64), (key & np.uint32(_DIM - 1)).astype(np.int64), count, some


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for part in tx.chunks(batch, "text"):
            for a in range(0, part.num_rows, 1 << 15):
                some = part.slice(a, 1 << 15)
                yield some, [t or "" for t in some.column("text").to_pylist()]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, doc: np.ndarray, bucket: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        x = (1 + np.log(count)) * self.idf[bucket]
        norm = np.sqrt(np.bincount(doc, x * x, n))
        return np.stack([np.bincount(doc, x * self.weights[bucket, c], n) for c in range(len(self.langs))], 1) / np.where(norm > 0, norm, 1)[:, None] + self.bias

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        doc, bucket, count, some = ngram_counts(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        p = softmax(self.logits(doc, bucket, count, len(texts)) / self.temperature)
        best = p.argmax(1)
        score = np.where(some, p[np.arange(len(texts)), best], 0.0)
        return [self.langs[b] if s else "und" for b, s in zip(best, some, strict=True)], score


def fit(learn: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = 4_000) -> Model:
    """Fit on rows of text and language. `sample` bounds the rows that come to the
    driver, and the languages that are learnt."""
    text = F.col(f"`{text_col}`").cast("string")
    learn = learn.select(text.alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.xxhash64(text).alias("pick")).where("lang is not null and text is not null")
    # bounded: the languages of the most rows
    sizes = learn.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return Model([], np.zeros(_DIM), np.zeros((_DIM, 0)), np.zeros(0), 1.0)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(_DIM, np.int64), 0
        for _, texts in _slices(batches):
            _, bucket, _, _ = ngram_counts(texts)
            total += np.bincount(bucket, minlength=_DIM)
            n += len(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(total[at], n), pa.int64())], ["bucket", "n"])

    df = np.zeros(_DIM)
    docs = 0
    # bounded: a row for each bucket
    for r in learn.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r["bucket"] < 0:
            docs = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    idf = np.log((1 + docs) / (1 + df)) + 1
    each = max(1, sample // len(langs))
    # the first texts of each language by their hash: a language's candidates are
    # taken by a share that its count makes twice as many as are needed or more, so the
    # ranking is of few rows; where copies leave too few distinct ones, of all rows
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(-(2**63) + min(2**64 - 1, 2**64 * 2 * (each + 50) // r["n"])))])
    first = Window.partitionBy("lang").orderBy("pick")
    ranked = lambda x: x.select("lang", "pick").distinct().withColumn("i", F.row_number().over(first)).where(F.col("i") <= each).groupBy("lang").agg(F.count("*").alias("n"), F.max("pick").alias("last"))
    known = learn.where(F.col("lang").isin(langs))
    last = {r["lang"]: (r["n"], r["last"]) for r in ranked(known.where(F.col("pick") <= share[F.col("lang")])).collect()}
    few = [r["lang"] for r in sizes if last.get(r["lang"], (0, 0))[0] < min(each, r["n"])]
    if few:
        last |= {r["lang"]: (r["n"], r["last"]) for r in ranked(known.where(F.col("lang").isin(few))).collect()}
    bound = F.create_map(*[x for k, (_, v) in last.items() for x in (F.lit(k), F.lit(v))])
    picked = known.where(F.col("pick") <= bound[F.col("lang")]).dropDuplicates(["lang", "pick"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, texts in _slices(batches):
            doc, bucket, count, _ = ngram_counts(texts)
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            pieces = [np.stack([bucket[a:b], count[a:b]]).astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([some.column("lang"), some.column("pick"), pa.array(pieces, pa.binary())], ["lang", "pick", "x"])

    got = sorted((r["pick"], r["lang"], bytes(r["x"])) for r in picked.mapInArrow(features, "lang string, pick long, x binary").collect())
    rows, y, aside = [], [], []
    for pick, lang, x in got:
        bucket, count = np.frombuffer(x, "<i4").reshape(2, -1)
        v = (1 + np.log(count)) * idf[bucket]
        rows.append((np.append(bucket, _DIM), np.append(v / max(np.sqrt((v * v).sum()), 1e-12), 1.0)))
        y.append(langs.index(lang))
        aside.append(pick % 5 == 0)
    y, aside = np.array(y), np.array(aside)
    use = np.flatnonzero(~aside) if (~aside).any() else np.arange(len(y))
    w = ftrl([rows[i] for i in use], y[use], _DIM + 1, len(langs))
    held = np.flatnonzero(aside)
    logits = np.array([rows[i][1] @ w[rows[i][0]] for i in held]).reshape(-1, len(langs))
    return Model(langs, idf, w[:_DIM].astype(np.float32), w[_DIM], temperature(logits, y[held]))


def predict(df: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, then lang_pred and score, whose names no kept column may have."""
    clash = {c.lower() for c in keep} & {"lang_pred", "score"}
    if clash:
        raise ValueError(f"columns made would clash: {sorted(clash)}")
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").cast("string").alias("text"))
    kinds = [f"`{c}` {f.dataType.simpleString()}" for c, f in zip(keep, source.schema.fields, strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, texts in _slices(batches):
            lang, score = model.predict(texts)
            yield pa.RecordBatch.from_arrays([some.column(i) for i in range(some.num_columns - 1)] + [pa.array(lang), pa.array(score)], [*keep, "lang_pred", "score"])

    return source.mapInArrow(run, ", ".join([*kinds, "lang_pred string", "score double"]))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # a null id has no remainder: it is not 2
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
