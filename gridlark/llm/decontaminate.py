"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages: windows of 64 and of 32 words, 16 apart. Passages and
benchmark items become TF-IDF vectors over the benchmark's terms (other terms
have no part in any product with an item); document frequencies count all
documents, and a term that every document has still weighs something. A randomised
SVD (range finder with power iterations, its products spread over the cluster) of
all passages of the benchmark and of all distinct texts of the corpus gives the latent
space, in which vectors are whitened and the mean of the corpus's passages that
are like no item is taken off; so the weight of an item does not fall with the
number of its copies. A passage is a candidate if its cosine with an item's
passage reaches `least_cosine` and it has half as much along the item as the item
itself. Candidates are checked on the words themselves: the longest common
subsequence of the item and the text around the passage must have `least_lcs` of
the item's words in a stretch of one and a half times its length, and most of the
answer's terms must be there. An item's answer is the column that `answer_col`
names or, without one, its most telling terms (highest inverse document frequency).

The benchmark is small by nature; the code takes at most `max_items` items and
about `max_words` of their words at a time and goes through larger ones in blocks.
To count and to fit, texts are shuffled once, each with the number of its copies, and read
once: documents of each term are counted, and what the passages have of the benchmark's
terms lies in a table until the space is fitted. The search shuffles nothing: every
passage is looked at where its text is read.

Edge cases: null and empty texts match nothing; items without a word or without id
are left out; items shorter than 8 words must occur as a whole; an empty benchmark
or corpus gives no rows; copies in either table give a row each; rows with a null
id are reported with it, and `drop_leaks` tells rows apart by id and text, so they
go like any other; texts are read to their ends, whatever their length; extra
columns are ignored or kept as they are, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm import _text as tx
from gridlark.llm._spark import free_names, shared_folder, stable
from gridlark.sources.files import Files

STEP, SPAN = 16, 4  # words of a block, blocks of a passage
SPANS = (4, 2)  # of the passages that are looked up


@dataclass
class Benchmark:
    ids: list[int]
    words: list[np.ndarray]  # hashes of each item's words
    answers: list[np.ndarray | None]
    vocab: np.ndarray


def _hashes(texts: list[str | None]) -> list[np.ndarray]:
    data, off = tx.raw(pa.array(texts, pa.string()))
    h, doc = tx.words(data, off, tx.PUNCT)
    return np.split(h, np.searchsorted(doc, np.arange(1, len(texts)))) if texts else []


def read_benchmark(rows: list) -> Benchmark:
    """From rows of id, text and, maybe, answer."""
    words = _hashes([r[1] for r in rows])
    answers = _hashes([r[2] for r in rows]) if rows and len(rows[0]) > 2 else [np.zeros(0, np.uint64)] * len(rows)
    use = [i for i, w in enumerate(words) if len(w) and rows[i][0] is not None]
    vocab = tx.unique(np.concatenate([np.zeros(0, np.uint64), *[words[i] for i in use]]))
    return Benchmark([int(rows[i][0]) for i in use], [words[i] for i in use], [answers[i] if len(answers[i]) else None for i in use], vocab)


def lookup(vocab: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash in the sorted vocabulary; -1 if it isn't there."""
    if not len(vocab):
        return np.full(len(h), -1)
    at = np.searchsorted(vocab, h)
    at[at == len(vocab)] = 0
    return np.where(vocab[at] == h, at, -1)


class Index:
    """`lookup` in one vocabulary: the top bits of a hash lead to its place."""

    def __init__(self, vocab: np.ndarray):
        self.vocab = vocab
        bits = (4 * len(vocab)).bit_length()
        self.shift = np.uint64(64 - bits)
        first = np.searchsorted(vocab >> self.shift, np.arange(1 << bits, dtype=np.uint64))
        self.crowded = np.diff(np.append(first, len(vocab))) > 1
        # beyond the last hash any will do: none there is equal
        self.first = np.minimum(first, max(0, len(vocab) - 1)).astype(np.int32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.vocab):
            return np.full(len(h), -1)
        slot = (h >> self.shift).astype(np.int64)
        at = self.first[slot].astype(np.int64)
        at[self.vocab[at] != h] = -1
        rest = np.flatnonzero(self.crowded[slot] & (at < 0))
        at[rest] = lookup(self.vocab, h[rest])
        return at


def _slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from tx.chunks(batch, text)


def item_passages(bench: Benchmark) -> list[tuple[int, np.ndarray]]:
    size = STEP * SPAN
    return [(i, w[a : a + size]) for i, w in enumerate(bench.words) for a in range(0, max(1, len(w) - size // 2), size // 2)]


@dataclass
class Passages:
    """Term counts of some passages, one after the other; words counts all words."""

    size: np.ndarray  # distinct terms of each passage
    words: np.ndarray
    term: np.ndarray
    n: np.ndarray

    def begins(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size

    def unit(self, idf: np.ndarray) -> np.ndarray:
        """Weight of each term in its passage's unit vector."""
        v = self.n * idf[self.term]
        return v / np.repeat(np.sqrt(np.add.reduceat(v * v, self.begins())), self.size)


_DENSE = 512  # terms


class Common:
    """The terms that most documents have."""

    def __init__(self, idf: np.ndarray):
        self.terms = np.argsort(idf, kind="stable")[:_DENSE]
        self.column = np.full(len(idf), -1)
        self.column[self.terms] = np.arange(len(self.terms))


class Matrix:
    """Passages by terms: common terms in dense columns, all others sparse."""

    def __init__(self, x: Passages, of_term: np.ndarray, common: Common):
        self.common = common.terms
        row, column = np.repeat(np.arange(len(x.size)), x.size), common.column[x.term]
        some = column >= 0
        self.dense = np.zeros((len(x.size), len(self.common)))
        self.dense[row[some], column[some]] = of_term[some]
        self.row, self.term, self.rest = row[~some], x.term[~some], of_term[~some, None]

    def times(self, m: np.ndarray) -> np.ndarray:
        out = self.dense @ m[self.common]
        if len(self.row):
            s = _runs(self.row)
            out[self.row[s]] += _sums(m, self.term, s, self.rest)
        return out

    def add_transposed(self, out: np.ndarray, z: np.ndarray, weight: float) -> None:
        """Adds weight times the product of the transposed matrix and z."""
        out[self.common] += weight * (self.dense.T @ z)
        if len(self.row):
            order = np.argsort(self.term, kind="stable")
            term = self.term[order]
            s = _runs(term)
            out[term[s]] += weight * _sums(z, self.row[order], s, self.rest[order])


def _runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def _sums(rows: np.ndarray, at: np.ndarray, begins: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Sum of the rows `at`, times their weights, of each run: first ones, second ones
    and so on of all runs at once, as runs are short."""
    size = np.diff(np.append(begins, len(at)))
    order = np.argsort(-size, kind="stable")
    begin, size = begins[order], size[order]
    total = np.zeros((len(begin), rows.shape[1]), rows.dtype)
    for k in range(size[0]):
        some = begin[: np.searchsorted(-size, -k, "left")] + k
        x = rows[at[some]]
        if weight is not None:
            x *= weight[some]
        total[: len(some)] += x
    out = np.empty_like(total)
    out[order] = total
    return out


def _add_product(out: np.ndarray, x: Passages, idf: np.ndarray, common: Common, q: np.ndarray, weight: float = 1.0) -> None:
    """Adds the sum over passages a of weight a' (a q)."""
    m = Matrix(x, x.unit(idf), common)
    m.add_transposed(out, m.times(q), weight)


_MANY = 1_024  # passages held at once


def _counted(passage: np.ndarray, at: np.ndarray, terms: int) -> Iterator[Passages]:
    """From each word's passage (ascending) and term (-1: none); passages without terms are left out."""
    use = at >= 0
    key, n = tx.unique_counts(passage[use] * terms + at[use])
    p, term = np.divmod(key, max(1, terms))
    rows, size = tx.unique_counts(p)
    words = np.bincount(passage)[rows]
    ends = np.cumsum(size)
    for a in range(0, len(rows), _MANY):
        b = min(a + _MANY, len(rows))
        some = slice(ends[a] - size[a], ends[b - 1])
        yield Passages(size[a:b], words[a:b], term[some], n[some])


# a passage has at most STEP * SPAN words, so a byte holds its counts
_STORED = {"size": "u1", "words": "u1", "term": "<i4", "n": "u1"}


_SUMS = "at long, task long, z binary"


def _counts(docs: DataFrame, vocab: np.ndarray) -> DataFrame:
    """The passages of all distinct texts, `_MANY` or fewer in a row; and in rows of
    `at` and `z` the documents that have each term and, after these, how many there are."""
    names = [*_STORED, "at", "task", "z"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = Index(vocab), np.zeros((len(vocab) + 1, 1))
        for part in _slices(batches):
            data, off = tx.raw(part.column("text"))
            h, doc = tx.words(data, off, tx.PUNCT)
            at = find(h)
            copies = np.asarray(part.column("copies"))
            seen = tx.unique(doc[at >= 0] * len(vocab) + at[at >= 0])
            total[:-1, 0] += np.bincount(seen % len(vocab), copies[seen // len(vocab)], len(vocab))
            total[-1] += copies.sum()
            count = np.bincount(doc, minlength=len(off) - 1)
            first_word = np.cumsum(count) - count
            here = -(-count // (STEP * SPAN))
            passage = (np.cumsum(here) - here)[doc] + (np.arange(len(h)) - first_word[doc]) // (STEP * SPAN)
            for x in _counted(passage, at, len(vocab)):
                yield pa.RecordBatch.from_arrays([*(pa.array([getattr(x, c).astype(kind).tobytes()], pa.binary()) for c, kind in _STORED.items()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())], names)
        for rows in _cut_rows(total):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.binary()) for _ in _STORED), *rows.columns], names)

    return docs.groupBy("text").agg(F.count("*").alias("copies")).mapInArrow(run, ", ".join(f"{c} binary" for c in _STORED) + f", {_SUMS}")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Passages]:
    for batch in batches:
        for row in zip(*(batch.column(c) for c in _STORED), strict=True):
            yield Passages(*(np.frombuffer(x.as_py(), kind).astype(np.int64) for x, kind in zip(row, _STORED.values(), strict=True)))


_ROWS = 256  # of a matrix, sent at once; added up by one task
_FAN = 64  # partial sums that one task adds up
_LIKE = 0.5  # cosine with an item from which a passage has no part in the mean


def _cut_rows(z: np.ndarray) -> Iterator[pa.RecordBatch]:
    task = pa.array([TaskContext.get().partitionId()], pa.int64())
    for a in range(0, len(z), _ROWS):
        yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), task, pa.array([z[a : a + _ROWS].tobytes()], pa.binary())], ["at", "task", "z"])


def _added(key: tuple, rows: pa.Table) -> pa.Table:
    total = np.zeros(len(rows.column("z")[0].as_py()) // 8)
    for x in rows.column("z"):
        total += np.frombuffer(x.as_py())
    return pa.table({"at": rows.column("at").slice(0, 1), "task": pa.array([key[1].as_py()], pa.int64()), "z": pa.array([total.tobytes()], pa.binary())})


def _total(rows: DataFrame, terms: int, wide: int) -> np.ndarray:
    """Sum of matrices cut into rows. They are added up where they are, as a tree in which no
    group has more than _FAN of the tasks' rows; the driver gets one."""
    out, tasks = np.zeros((terms, wide)), rows.rdd.getNumPartitions()
    while tasks > 1:
        rows = rows.groupBy("at", F.floor(F.col("task") / _FAN).alias("node")).applyInArrow(_added, _SUMS)
        tasks = -(-tasks // _FAN)
    for r in rows.collect():
        z = np.frombuffer(r["z"]).reshape(-1, wide)
        out[r["at"] : r["at"] + len(z)] += z
    return out


def latent_space(corpus: DataFrame, bench: Benchmark, idf: np.ndarray, rank: int = 64, rounds: int = 2, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Whitened term vectors `(terms, rank)`, idf included, and the mean vector
    of a word. Fitted on all passages of `corpus`, those of every distinct text."""
    terms, common = len(bench.vocab), Common(idf)
    items = [w for _, w in item_passages(bench)]
    own = list(_counted(np.repeat(np.arange(len(items)), [len(w) for w in items]), lookup(bench.vocab, np.concatenate(items)), terms))
    # as many rows of the benchmark as of the corpus would be too many copies: weights do
    weight = max(1.0, (corpus.agg(F.sum(F.length("size"))).first()[0] or 0) / len(items))

    def product(q: np.ndarray) -> np.ndarray:
        """Sum over rows a of a' (a q)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((terms, q.shape[1]))
            for x in _read(batches):
                _add_product(out, x, idf, common, q)
            yield from _cut_rows(out)

        got = _total(corpus.mapInArrow(run, _SUMS), terms, q.shape[1])
        for x in own:
            _add_product(got, x, idf, common, q, weight)
        return got

    wide = min(rank + 8, terms)
    q, _ = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((terms, wide)))
    for _ in range(rounds):
        q, _ = np.linalg.qr(product(q))
    value, turn = np.linalg.eigh(q.T @ product(q))
    best = np.argsort(-value)[: min(rank, wide)]
    best = best[value[best] > 1e-9 * max(value.max(), 1e-300)]
    vectors = (q @ turn[:, best]) / np.sqrt(value[best])[None, :]
    # of an item in most texts the plain mean would hold so much that nothing is left
    known = np.concatenate([Matrix(x, x.n * idf[x.term], common).times(vectors) for x in own])
    known /= np.maximum(np.linalg.norm(known, axis=1), 1e-12)[:, None]

    def calm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(vectors.shape[1]), 0
        for x in _read(batches):
            z = Matrix(x, x.n * idf[x.term], common).times(vectors)
            for a in range(0, len(z), 128):
                some = z[a : a + 128]
                like = (some @ known.T).max(1).clip(0) < _LIKE * np.linalg.norm(some, axis=1)
                total += some[like].sum(0)
                words += int(x.words[a : a + 128][like].sum())
        yield from _cut_rows(np.append(total, words)[None, :])

    mean = _total(corpus.mapInArrow(calm, _SUMS), 1, vectors.shape[1] + 1)[0]
    return vectors * idf[:, None], mean[:-1] / max(1.0, mean[-1])


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over `a`."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = where.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _verified(item: list[int], answer: set[int], text: list[int], at: int, span: int, least: float, least_answer: float) -> tuple[int, int, int] | None:
    """`(lcs, begin, end)` of the best stretch around a passage, if it counts."""
    n = len(item)
    if n < 8:
        least, least_answer = 1.0, 1.0
    lo, hi = max(0, at - n), min(len(text), at + span + n)
    region = text[lo:hi]
    if lcs(item, region) < least * n:
        return None
    size, best = n + n // 2 + 1, (0, 0, 0)
    for a in range(0, max(1, len(region) - size + max(1, n // 4)), max(1, n // 4)):
        stretch = region[a : a + size]
        k = lcs(item, stretch)
        if k > best[0]:
            best = (k, lo + a, lo + a + len(stretch))
    if best[0] < least * n or answer and len(answer.intersection(text[best[1] : best[2]])) < least_answer * len(answer):
        return None
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None, rank: int = 64, least_cosine: float = 0.12, least_lcs: float = 0.7, least_answer: float = 0.6, max_items: int = 20_000, max_words: int = 500_000) -> DataFrame:
    """`(doc_id, item_id, cosine, lcs, ratio, begin, end)`: a row for each text
    and item in it, with the best passage; begin and end count words."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.lower(F.col(f"`{text_col}`").cast("string")).alias("text"))
    given = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("id"), F.lower(F.col(f"`{item_text}`").cast("string")).alias("text"), *([F.lower(F.col(f"`{answer_col}`").cast("string")).alias("answer")] if answer_col else []))
    held = given.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0)).alias("words")).first()
    blocks = max(-(-held["items"] // max_items), -(-held["words"] // max_words))
    out = spark.createDataFrame([], "doc_id long, item_id long, cosine double, lcs int, ratio double, begin long, end long")
    for b in range(blocks):
        some = given if blocks == 1 else given.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        out = out.unionByName(_leaks(docs, read_benchmark(sorted(some.collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))), rank, least_cosine, least_lcs, least_answer))
    return out


# held at once
_PAIRS = 1 << 22  # of passages and items
_STRETCH = 1 << 19  # words of candidates


class Finder:
    """Candidate search and check on the texts of a batch."""

    def __init__(self, bench: Benchmark, idf: np.ndarray, vectors: np.ndarray, mean: np.ndarray, least_cosine: float, least_lcs: float, least_answer: float):
        self.bench, self.least, self.index = bench, (least_cosine, least_lcs, least_answer), Index(bench.vocab)
        self.vectors, self.mean = vectors.astype(np.float32), mean.astype(np.float32)
        self.live = self.vectors.any(1)
        own = item_passages(bench)
        self.of_item = np.array([i for i, _ in own])
        z = np.stack([self.vectors[lookup(bench.vocab, w)].sum(0) - len(w) * self.mean for _, w in own])
        norm = np.linalg.norm(z, axis=1)
        self.targets = (z / np.maximum(norm, 1e-12)[:, None]).astype(np.float32).T.copy()
        # a passage that holds an item, or all that its words can, has that much along it
        self.need = [(0.5 * norm * np.minimum(1, STEP * k / np.array([len(w) for _, w in own]))).astype(np.float32) for k in SPANS]
        self.items, self.size = [w.tolist() for w in bench.words], np.array([len(w) for w in bench.words])
        # how often each item has each of its terms, by a hash of both
        term, count = zip(*(tx.unique_counts(lookup(bench.vocab, w)) for w in bench.words), strict=True)
        key = self.pair(np.repeat(np.arange(len(term)), [len(x) for x in term]), np.concatenate(term))
        order = np.argsort(key)
        self.pairs, self.count = Index(key[order]), np.concatenate(count)[order]
        self.answers = []
        for w, a in zip(bench.words, bench.answers, strict=True):
            terms = tx.unique(w if a is None else a)
            if a is None:
                terms = terms[np.argsort(-idf[lookup(bench.vocab, terms)], kind="stable")][: max(1, len(terms) * 3 // 10)]
            self.answers.append(set(terms.tolist()))

    def pair(self, item: np.ndarray, term: np.ndarray) -> np.ndarray:
        return tx.mix((item * len(self.bench.vocab) + term).astype(np.uint64))

    def blocks(self, at: np.ndarray, doc: np.ndarray, first_word: np.ndarray, first_block: np.ndarray) -> np.ndarray:
        """Centred latent sums of blocks of STEP words."""
        gid = first_block[doc] + (np.arange(len(at)) - first_word[doc]) // STEP
        sums = np.bincount(gid, minlength=first_block[-1])[:, None].astype(np.float32) * -self.mean
        use = at >= 0
        use[use] = self.live[at[use]]
        g, at = gid[use], at[use]
        if len(g):
            begins = _runs(g)
            sums[g[begins]] += _sums(self.vectors, at, begins)
        return sums

    def shared(self, item: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Words that each item and its stretch of the terms have in common; no subsequence has more."""
        out, ends, a = np.zeros(len(item), np.int64), np.cumsum(hi - lo), 0
        while a < len(item):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _STRETCH, "right")))
            size = (hi - lo)[a:b]
            of = np.repeat(np.arange(a, b), size)
            term = at[np.arange(len(of)) + np.repeat(lo[a:b] - (np.cumsum(size) - size), size)]
            of, term = of[term >= 0], term[term >= 0]
            found = self.pairs(self.pair(item[of], term))
            key, n = tx.unique_counts(of[found >= 0] * len(self.count) + found[found >= 0])
            of, found = np.divmod(key, len(self.count))
            out += np.bincount(of, np.minimum(n, self.count[found]), len(item)).astype(np.int64)
            a = b
        return out

    def find(self, column: pa.Array) -> list[tuple[int, int, float, int, int, int]]:
        """(text, item, cosine, lcs, begin, end) of each text and item in it."""
        least_cosine, least_lcs, least_answer = self.least
        data, off = tx.raw(column)
        h, doc = tx.words(data, off, tx.PUNCT)
        at = self.index(h)
        n = len(off) - 1
        count = np.bincount(doc, minlength=n)
        nb = -(-count // STEP)
        first_word = np.concatenate([[0], np.cumsum(count)])
        first_block = np.concatenate([[0], np.cumsum(nb)])
        if not first_block[-1]:
            return []
        sums = self.blocks(at, doc, first_word, first_block)
        bdoc = np.repeat(np.arange(n), nb)
        place = np.arange(len(sums)) - first_block[bdoc]
        best: dict[tuple[int, int], tuple[int, float, int, int]] = {}
        for span, need in zip(SPANS, self.need, strict=True):
            # passages of span blocks, or the whole text if it is shorter
            begins = np.flatnonzero((place == 0) | (place + span <= nb[bdoc]))
            z = sums[begins]
            for k in range(1, span):
                ok = place[begins] + k < nb[bdoc[begins]]
                z[ok] += sums[begins[ok] + k]
            norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", z, z)), 1e-12)
            step = min(4096, max(1, _PAIRS // len(self.of_item)))
            for a in range(0, len(z), step):
                along = z[a : a + step] @ self.targets
                p, t = np.divmod(np.flatnonzero(along >= need), along.shape[1])
                far = along[p, t] >= least_cosine * norm[a + p]
                p, t = p[far], t[far]
                of, item = bdoc[begins[a + p]], self.of_item[t]
                size, begin = self.size[item], place[begins[a + p]] * STEP
                lo = first_word[of] + np.maximum(0, begin - size)
                hi = np.minimum(first_word[of + 1], first_word[of] + begin + STEP * span + size)
                for j in np.flatnonzero(self.shared(item, at, lo, hi) >= least_lcs * size).tolist():
                    d, i, start = int(of[j]), int(item[j]), int(lo[j] - first_word[of[j]])
                    old = best.get((d, i))
                    if old and old[0] == len(self.items[i]):
                        continue
                    found = _verified(self.items[i], self.answers[i], h[lo[j] : hi[j]].tolist(), int(begin[j]) - start, STEP * span, least_lcs, least_answer)
                    if found and (old is None or found[0] > old[0]):
                        best[d, i] = (found[0], float(along[p[j], t[j]] / norm[a + p[j]]), start + found[1], start + found[2])
        return [(d, i, v[1], v[0], v[2], v[3]) for (d, i), v in sorted(best.items())]


def _leaks(docs: DataFrame, bench: Benchmark, rank: int, least_cosine: float, least_lcs: float, least_answer: float) -> DataFrame:
    schema = "doc_id long, item_id long, cosine double, lcs int, ratio double, begin long, end long"
    if not bench.ids:
        return docs.sparkSession.createDataFrame([], schema)
    spark, terms = docs.sparkSession, len(bench.vocab)
    path = f"{shared_folder(spark)}/passages-{uuid.uuid4().hex}"
    counts = _counts(docs.select("text"), bench.vocab)
    counts.write.parquet(path)
    counts = spark.read.schema(counts.schema).parquet(path)
    total = _total(counts.where("at is not null").select("at", "task", "z"), terms + 1, 1)[:, 0]
    idf = np.log((1 + total[-1]) / (1 + total[:-1])) + 1
    finder = Finder(bench, idf, *latent_space(counts.where("at is null").select(*_STORED), bench, idf, rank), least_cosine, least_lcs, least_answer)
    Files(spark).delete(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            rows = finder.find(part.column("text"))
            if rows:
                d, i, cos, k, begin, end = zip(*rows, strict=True)
                size = [len(bench.words[x]) for x in i]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(d)), pa.array([bench.ids[x] for x in i], pa.int64()), pa.array(cos), pa.array(k, pa.int32()), pa.array([x / s for x, s in zip(k, size, strict=True)]), pa.array(begin, pa.int64()), pa.array(end, pa.int64())],
                    ["doc_id", "item_id", "cosine", "lcs", "ratio", "begin", "end"],
                )

    return docs.mapInArrow(run, schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of `docs` in which no item is found, with all their columns."""
    key, = free_names(docs, "key")
    own = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    found = leaks(docs.select(own.alias("key"), F.col(f"`{text_col}`").alias("text")), benchmark, "key", "text", **options)
    found = stable(found.select(F.col("doc_id").alias(key)).distinct())
    return docs.join(found, own == F.col(key), "left_anti")


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
