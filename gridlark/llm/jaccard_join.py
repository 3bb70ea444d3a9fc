"""N-gram Jaccard join: an exact size-aware heavy-light set similarity self-join.

Texts become sets of distinct word n-grams. Two texts link when
den * |A and B| >= num * |A or B|. No linked pair is missed:

* Equal sets are one node, so exact copies cost one row however many there are.
* Small sets enumerate fixed-size subsets. A pair of sizes s and t that links
  shares c(s, t) = ceil(num (s + t) / (den + num)) shingles, so both sets have a
  common c-subset, and each set emits the hashes of its c-subsets.
* Large sets scan inverted lists. The universe is cut into m ranges; a linked
  pair of a size class differs in at most k shingles, so with m > k + (empty
  ranges) the two sets agree on a whole non-empty range. A list is kept for each
  (class, range, content of the range). Such a list holds the texts that agree
  on several shingles at once, which a passage shared by many texts does not
  fill, unlike the list of a single shingle.
* The boundary between both is the one with the least expected cost on the
  histogram of set sizes.

Keys travel as packed arrays; a list that is long inside one task leaves a star
there and goes on as a single entry. Members of a list that cannot link by their
sizes or parity sketches (lower bounds of the difference, so nothing is lost) are
parted; the others form clusters. Clusters are verified exactly with blocked
matrix products, large ones by a grid of block pairs, and only spanning edges
leave a block.

Edge cases: null, empty and blank texts have the empty set and no link; null ids
keep their row and their links (component_id null unless another id of the class is
known); repeated rows are copies of each other; very long texts are sets like any,
with a sketch that grows with them (a quarter byte a shingle); extra columns are
ignored, whatever their names; an empty table gives no rows. A set is known by
64 bits and, where two sets share those, by 64 more from other hashes of its words;
shingles within a pair of sets are known by 52 bits.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm import _text as tx
from gridlark.llm._spark import components, free_names, lean, semi_join, stable

U = np.uint64
_C1, _C2, _C3, _C4 = U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3)
_BLOCK_ROWS, _BLOCK_ITEMS = 512, 1 << 20


class Scheme:
    """Size classes, ranges and subset sizes for the threshold num / den."""

    def __init__(self, num: int, den: int, boundary: int = 0):
        if not 0 < num <= den:
            raise ValueError("the threshold is over 0 and at most 1")
        self.num, self.den, self.boundary = num, den, boundary
        self.low, self.high = [1], []
        while self.low[-1] < 1 << 30:  # a string has fewer than 2^31 bytes, a word and what ends it two
            self.high.append(max(self.low[-1], int(self.low[-1] * 1.414)))
            self.low.append(self.high[-1] + 1)
        self.low = self.low[:-1]
        self.reach = [-(-num * x // den) for x in self.low]  # least size of the class's pairs
        self.k = [2 * r * (den - num) // (den + num) for r in self.high]
        self.spare, self.m = [], []
        for k, lo in zip(self.k, self.reach, strict=True):
            spare = need = 0
            for _ in range(40):  # a fixed point: more ranges, more of them empty
                empty = (k + 1 + spare) * math.exp(-lo / (k + 1 + spare))
                need = math.ceil(empty + 3 * math.sqrt(empty))
                if need <= spare:
                    break
                spare = min(need, k + 8)
            self.spare.append(spare)
            self.m.append(k + 1 + spare if k else 0)  # without a difference sets are equal

    def overlap(self, s: int, t: int) -> int:
        return -(-self.num * (s + t) // (self.den + self.num))

    def subset_sizes(self, s: int) -> list[int]:
        """Sizes of the subsets that a set of s shingles enumerates."""
        return sorted({self.overlap(s, t) for t in range(-(-self.num * s // self.den), self.den * s // self.num + 1) if min(s, t) <= self.boundary and t != s or t == s <= self.boundary and self.overlap(s, s) < s})

    def enumerated(self, s: int) -> int:
        return sum(math.comb(s, c) for c in self.subset_sizes(s))

    def scanned(self, s: int) -> int:
        i = int(np.searchsorted(self.high, s))
        return self.m[i] + (self.m[i + 1] if s >= self.reach[i + 1] else 0)

    @classmethod
    def by_cost(cls, num: int, den: int, sizes: dict[int, int], list_cost: float = 4.0, most: int = 16) -> Scheme:
        """The boundary of least cost; a list key costs `list_cost` times a
        subset key, for the entries that it brings together in vain."""
        best = None
        for b in range(most + 1):
            x = cls(num, den, b)
            cost = sum(n * (x.enumerated(s) + (list_cost * x.scanned(s) if s > b else 0)) for s, n in sizes.items())
            if best is None or cost < best[0]:
                best = (cost, x)
        return best[1]

    def keys(self, doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of sorted sets and the set that each is of."""
        size = np.bincount(doc, minlength=n_docs)
        mixed = tx.mix(h)
        first = np.concatenate([[0], np.cumsum(size)])
        at = np.searchsorted(np.array(self.high), size)
        m, reach = np.array(self.m + [0]), np.array(self.reach + [1 << 60])
        keys, owner = [], []
        large = size > self.boundary
        with np.errstate(over="ignore"):
            for step in (0, 1):
                cls = np.minimum(at + step, len(self.m))
                parts = np.where(large & (size >= reach[cls]), m[cls], 0)
                use = np.repeat(parts > 0, size)
                if not use.any():
                    continue
                d, x, v = doc[use], h[use], mixed[use]
                part = (x >> U(20)) * parts[d].astype(np.uint64) >> U(32)
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (part[1:] != part[:-1])
                s = np.flatnonzero(new)
                sig = np.add.reduceat(v, s) + part[s] * _C1 + cls[d[s]].astype(np.uint64) * _C2
                keys.append(tx.mix(sig))
                owner.append(d[s])
                filled = np.bincount(d[s], minlength=n_docs)
                spare = np.array(self.spare + [0])[cls]
                for i in np.flatnonzero((parts > 0) & (parts - filled > spare)):
                    e = np.setdiff1d(np.arange(parts[i]), part[s][d[s] == i].astype(np.int64)).astype(np.uint64)
                    keys.append(tx.mix(e * _C1 + U(int(cls[i])) * _C2 + _C3))
                    owner.append(np.full(len(e), i))
            most = self.den * self.boundary // self.num + 1
            for i in np.flatnonzero((size > 0) & (size <= most)):
                own = mixed[first[i] : first[i + 1]]
                total = own.sum(dtype=np.uint64)
                for c in self.subset_sizes(int(size[i])):
                    out = [total - sum((own[j] for j in gone), U(0)) for gone in itertools.combinations(range(len(own)), len(own) - c)]
                    keys.append(tx.mix(np.array(out, np.uint64) + U(c) * _C4))
                    owner.append(np.full(len(out), i))
        if not keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(keys), np.concatenate(owner)


_CHECK = 0x5851F42D4C957F2D  # salt of the second hashes


@dataclass(frozen=True)
class Naming:
    """How sets get their node ids: `bits` of a hash, and for those ids that several
    sets share (about the square of the number of sets in 2^65 at 64 bits) a second hash."""

    bits: int = 64
    shared: tuple[int, ...] = ()

    def checks(self, data: np.ndarray, off: np.ndarray, n_docs: int, n: int, doc: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The second hash of each set, which doesn't depend on the first."""
        h, of = tx.words(data, off)
        c = tx.shingle_checks(h, tx.words(data, off, salt=_CHECK)[0], of, n_docs, n)
        out = np.zeros(n_docs, np.uint64)
        s = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
        if len(s):
            with np.errstate(over="ignore"):
                out[doc[s]] = tx.mix(np.add.reduceat(tx.mix(c ^ _C1), s) + size[doc[s]].astype(np.uint64) * _C2)
        return out

    def parted(self, node: np.ndarray, checks) -> np.ndarray:
        hit = np.isin(node, np.array(self.shared, np.int64).view(np.uint64)) if self.shared else np.zeros(len(node), bool)
        return np.where(hit, tx.mix(node ^ tx.mix(checks())), node) if hit.any() else node


def _sets(batch: pa.RecordBatch, text: str, n: int, naming: Naming, checked: bool = False):
    """For slices of a batch: the slice, its sorted sets, their sizes, node ids and, if
    `checked`, second hashes."""
    for part in tx.chunks(batch, text):
        for a in range(0, part.num_rows, 4096):
            some = part.slice(a, 4096)
            data, off = tx.raw(some.column(text))
            doc, h = tx.shingle_sets(*tx.words(data, off), some.num_rows, n)
            size = np.bincount(doc, minlength=some.num_rows)
            node = np.zeros(some.num_rows, np.uint64)
            if len(doc):
                s = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                with np.errstate(over="ignore"):
                    node[doc[s]] = tx.mix(np.add.reduceat(tx.mix(h ^ _C3), s) + size[doc[s]].astype(np.uint64) * _C4)
                node &= U((1 << naming.bits) - 1)
            check = functools.cache(lambda: naming.checks(data, off, some.num_rows, n, doc, size))  # noqa: B023
            yield some, doc, h, size, naming.parted(node, check), check() if checked else None


_LEAST_BITS = 512
_WIDE, _FEW, _MANY = 64, 8, 4096


def _sketches(doc: np.ndarray, h: np.ndarray, size: np.ndarray) -> pa.ListArray:
    """Parities of the shingles in each of 512 hash cells or more (twice the
    shingles, up to a power of two), packed in words. Two sets differ in at least
    as many shingles as their sketches in bits, the longer one folded."""
    bits = np.maximum(_LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(size * 2, 1))).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(bits)])
    cell = (tx.mix(h ^ _C2)).astype(np.int64) & (bits[doc] - 1)
    odd = np.bincount(first[doc] + cell, minlength=first[-1]) & 1
    return pa.ListArray.from_arrays(pa.array(first // 64, pa.int32()), pa.array(np.packbits(odd.astype(np.uint8)).view(np.int64)))


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    while len(sketch) > words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def shingle_counts(docs: DataFrame, id_col: str, text_col: str, n: int, naming: Naming = Naming()) -> DataFrame:  # noqa: B008
    """`(doc_id, rk, n_shingles, node, sketch, check)`; rk is a hash of id and text, node
    null for the empty set, check another hash of the set."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, doc, h, size, node, check in _sets(batch, "text", n, naming, checked=True):
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("rk"), pa.array(size, pa.int64()), pa.array(node.view(np.int64), mask=size == 0), _sketches(doc, h, size), pa.array(check.view(np.int64))], ["doc_id", "rk", "n_shingles", "node", "sketch", "check"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("rk"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, rk long, n_shingles long, node long, sketch array<long>, check long")


def _runs(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, node) sorted by key, where each key begins and how often it comes."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[new], nodes[new]
    s = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys, nodes, s, np.diff(np.append(s, len(keys)))


def _lists(docs: DataFrame, text_col: str, n: int, scheme: Scheme, ranges: int, naming: Naming) -> DataFrame:
    """Inverted lists of two nodes or more: `(kind, a, b)`.

    kind 0: nodes a and b are in a list of a few nodes; 1: list a has node b;
    2: a and b are in a list that is too long to compare its nodes one by one.
    """

    def ranges_of(x: np.ndarray) -> np.ndarray:
        return ((x >> U(32)) * U(ranges) >> U(32)).astype(np.int64)

    def emit(keys: list, nodes: list):
        k, v, s, count = _runs(np.concatenate(keys), np.concatenate(nodes))
        # lists that are long within one task leave a star and a wildcard there
        long = np.repeat(count > _WIDE, count)
        hub = np.repeat(v[s], count)
        star = long & (hub != v)
        wk, wide = k[star], np.stack([hub[star], v[star]], 1)
        wild = k[s][count > _WIDE]
        k, v = k[~star], v[~star]
        cols = [(ranges_of(k), k), (ranges_of(k), v), (ranges_of(wk), wide), (ranges_of(wild), wild)]
        present = np.unique(cols[0][0])
        cut = [(np.searchsorted(r, present), np.searchsorted(r, present, "right"), x) for r, x in cols]
        return pa.RecordBatch.from_arrays([pa.array(present, pa.int32())] + [pa.array([x[i:j].tobytes() for i, j in zip(a, b, strict=True)], pa.binary()) for a, b, x in cut], ["rng", "keys", "nodes", "wide", "wild"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, held = [], [], 0
        for batch in batches:
            for some, doc, h, _, node, _ in _sets(batch, "text", n, naming):
                k, owner = scheme.keys(doc, h, some.num_rows)
                keys.append(k)
                nodes.append(node[owner])
                held += len(k)
                if held > 1_000_000:
                    yield emit(keys, nodes)
                    keys, nodes, held = [], [], 0
        if held:
            yield emit(keys, nodes)

    @lean
    def merge(rows: pa.Table) -> pa.Table:
        def joined(name):
            return np.frombuffer(b"".join(x.as_py() for x in rows.column(name)), np.uint64)

        k, v, s, count = _runs(joined("keys"), joined("nodes"))
        wild = np.isin(k[s], joined("wild"))
        out = [(2, np.unique(joined("wide").reshape(-1, 2), axis=0))]
        long = wild | (count > _MANY)
        at = np.repeat(long, count)
        out.append((2, np.stack([np.repeat(v[s], count)[at], v[at]], 1)))
        few = []
        for m in range(2, _FEW + 1):
            begin = s[(count == m) & ~long]
            few += [np.stack([v[begin + i], v[begin + j]], 1) for i in range(m) for j in range(i + 1, m)]
        out.append((0, np.unique(np.concatenate(few), axis=0) if few else np.zeros((0, 2), np.uint64)))
        at = np.repeat((count > _FEW) & ~long, count)
        out.append((1, np.stack([k[at], v[at]], 1)))
        kind = np.concatenate([np.full(len(x), c, np.int32) for c, x in out])
        ab = np.concatenate([x for _, x in out])
        return pa.table({"kind": pa.array(kind), "a": pa.array(ab[:, 0].copy().view(np.int64)), "b": pa.array(ab[:, 1].copy().view(np.int64))})

    packed = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "rng int, keys binary, nodes binary, wide binary, wild binary")
    return packed.groupBy("rng").applyInArrow(merge, "kind int, a long, b long")


def _possible(scheme: Scheme):
    """Edges of spanning forests of what can link in each list, by sketches."""
    num, den = scheme.num, scheme.den

    @lean
    def run(rows: pa.Table) -> pa.Table:
        key, node, size = (rows.column(x).to_numpy() for x in ("a", "node", "size"))
        sketch = [x.values.to_numpy().view(np.uint64) for x in rows.column("sketch")]
        order = np.lexsort((node, key))
        cuts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]]))
        out = [np.zeros((0, 2), np.int64)]
        for a, b in itertools.pairwise(cuts):
            at = order[a:b]
            words = min(len(sketch[i]) for i in at)
            k, z = np.stack([_folded(sketch[i], words) for i in at]), size[at]
            link = np.zeros((len(at), len(at)), bool)
            some = max(1, (1 << 22) // (words * len(at)))
            for i in range(0, len(at), some):
                apart = np.bitwise_count(k[i : i + some, None, :] ^ k[None, :, :]).sum(-1, dtype=np.int64)
                s, t = z[i : i + some, None], z[None, :]
                link[i : i + some] = (apart * (den + num) <= (s + t) * (den - num)) & (den * np.minimum(s, t) >= num * np.maximum(s, t))
            pairs = _spanning(link)
            if pairs:
                out.append(node[at][np.array(pairs)])
        e = np.unique(np.concatenate(out), axis=0)
        return pa.table({"u": pa.array(e[:, 0].copy()), "v": pa.array(e[:, 1].copy())})

    return run


def _candidate_edges(docs: DataFrame, text_col: str, n: int, scheme: Scheme, ranges: int, nodes: DataFrame, naming: Naming) -> DataFrame:
    """Edges `(u, v)` that join all nodes which have a key in common and can link
    by their sizes and sketches (lists too long for that: all their nodes)."""
    lists = stable(_lists(docs, text_col, n, scheme, ranges, naming).distinct())
    num, den = scheme.num, scheme.den
    of = lambda x: nodes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}"))

    @lean
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            sizes = batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy()
            for i, (x, y) in enumerate(zip(batch.column("sketch_a"), batch.column("sketch_b"), strict=True)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                words = min(len(x), len(y))
                apart = int(np.bitwise_count((_folded(x, words) ^ _folded(y, words)).view(np.uint64)).sum())
                keep[i] = apart * (den + num) <= int(sizes[i]) * (den - num)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["u", "v"])

    alike = den * F.least("size_a", "size_b") >= num * F.greatest("size_a", "size_b")
    few = lists.where("kind = 0").join(of("a"), "a").join(of("b"), "b").where(alike).mapInArrow(near, "u long, v long")
    many = lists.where("kind = 1").select("a", F.col("b").alias("node")).join(nodes.select("node", "size", "sketch"), "node")
    groups = max(512, math.ceil(lists.where("kind = 1").count() / 20_000))
    many = many.withColumn("g", F.pmod(F.xxhash64("a"), F.lit(groups))).groupBy("g").applyInArrow(_possible(scheme), "u long, v long")
    return few.unionByName(many).unionByName(lists.where("kind = 2").select(F.col("a").alias("u"), F.col("b").alias("v")))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices a few thousand
    shingles wide; shingles of a single set are left out."""
    both = left + (right or [])
    flat = np.concatenate(both)
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    _, col, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[col] > 1
    rank = np.cumsum(times > 1) - 1
    row, col = row[keep], rank[col[keep]]
    out = np.zeros((len(left), len(right or left)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        i, j = np.searchsorted(col, (a, a + 4096))
        m = np.zeros((len(both), 4096), np.float32)
        m[row[i:j], col[i:j] - a] = 1
        out += m[: len(left)] @ (m[len(left) :] if right else m).T
    return np.rint(out).astype(np.int64)


def _spanning(link: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    left, out = np.ones(len(link), bool), []
    for i in range(len(link)):
        if left[i]:
            left[i] = False
            todo = [i]
            while todo:
                x = todo.pop()
                near = np.flatnonzero(link[x] & left)
                left[near] = False
                out += [(i, int(y)) for y in near]
                todo += near.tolist()
    return out


def _verify(scheme: Scheme):
    num, den = scheme.num, scheme.den

    def linked(a: list, b: list | None) -> np.ndarray:
        over = _overlaps(a, b)
        s, t = np.array([len(x) for x in a]), np.array([len(x) for x in (b or a)])
        link = den * over >= num * (s[:, None] + t[None, :] - over)
        if b is None:
            np.fill_diagonal(link, False)
        return link

    @lean
    def run(rows: pa.Table) -> pa.Table:
        comp, node, blk = (rows.column(x).to_numpy() for x in ("comp", "node", "blk"))
        copies, bi, bj = rows.column("copies").to_numpy(), rows.column("bi")[0].as_py(), rows.column("bj")[0].as_py()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("items")]
        u, v, w, kind = [], [], [], []

        def edges(pairs, ids):
            for x, y in pairs:
                u.append(ids[x]), v.append(ids[y]), w.append(0), kind.append(0)

        def weights(ids, given):
            for x, g in zip(ids, given, strict=True):
                if g:
                    u.append(x), v.append(x), w.append(int(g)), kind.append(1)

        if bi < 0 or bi == bj:
            order = np.lexsort((node, comp))
            cuts = np.flatnonzero(np.concatenate([[True], comp[order][1:] != comp[order][:-1], [True]]))
            for a, b in itertools.pairwise(cuts):
                at = order[a:b]
                if b - a > 1:
                    link = linked([sets[i] for i in at], None)
                    edges(_spanning(link), node[at])
                    weights(node[at], link @ copies[at])
        else:
            x, y = np.flatnonzero(blk == bi), np.flatnonzero(blk == bj)
            if len(x) and len(y):
                link = linked([sets[i] for i in x], [sets[i] for i in y])
                whole = np.zeros((len(x) + len(y),) * 2, bool)
                whole[: len(x), len(x) :] = link
                whole[len(x) :, : len(x)] = link.T
                edges(_spanning(whole), np.concatenate([node[x], node[y]]))
                weights(node[x], link @ copies[y])
                weights(node[y], link.T @ copies[x])
        return pa.table({"kind": pa.array(kind, pa.int32()), "u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "w": pa.array(w, pa.int64())})

    return run


def _items(docs: DataFrame, n: int, naming: Naming) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, doc, h, size, node, _ in _sets(batch, "text", n, naming):
                first = np.concatenate([[0], np.cumsum(size)])
                at = np.flatnonzero(size)
                yield pa.RecordBatch.from_arrays([pa.array(node[at].view(np.int64)), pa.array([h[first[i] : first[i + 1]].tobytes() for i in at], pa.binary())], ["node", "items"])

    return docs.select("text").mapInArrow(run, "node long, items binary").dropDuplicates(["node"])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100, bits: int = 64) -> DataFrame:
    """Link texts whose shingle sets have a Jaccard similarity of num/den or more.

    Returns one row a row of `docs`: doc_id, n_shingles, component_id (smallest
    doc_id reachable by links), n_links (other rows that link with it, copies
    included), node (id of the distinct set, null for the empty one), cluster (the
    smallest node reachable) and rk (a hash of id and text). `bits` is the length of a
    set's first hash; the result does not depend on it.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    naming = Naming(bits)
    counted = stable(shingle_counts(docs, "doc_id", "text", n, naming))
    shared = counted.where("node is not null").groupBy("node").agg((F.min("check") < F.max("check")).alias("several")).where("several")
    # next to none at 64 bits, whatever the table: see Naming
    naming = Naming(bits, tuple(sorted(r["node"] for r in shared.collect())))
    if naming.shared:
        counted = stable(shingle_counts(docs, "doc_id", "text", n, naming))
    counted = counted.drop("check")
    nodes = counted.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("rk").alias("rk"), F.count("*").alias("copies"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"))
    total = counted.agg(F.sum("n_shingles")).first()[0] or 0
    small = {r["n_shingles"]: r["n"] for r in counted.where("n_shingles between 1 and 64").groupBy("n_shingles").agg(F.count("*").alias("n")).collect()}
    scheme = Scheme.by_cost(num, den, small)
    ranges = max(8, math.ceil(total * 0.35 / 1_000_000))
    nodes = stable(nodes)
    cluster = components(_candidate_edges(docs, "text", n, scheme, ranges, nodes, naming))
    nodes = nodes.drop("sketch")
    members = stable(cluster.join(nodes, "node"))
    stats = members.groupBy("comp").agg(F.count("*").alias("rows"), F.sum("size").alias("shingles"))
    stats = stats.withColumn("nb", F.ceil(F.greatest(F.col("rows") / _BLOCK_ROWS, F.col("shingles") / _BLOCK_ITEMS)).cast("int"))
    groups = max(1, math.ceil((stats.agg(F.sum("shingles")).first()[0] or 0) / _BLOCK_ITEMS))
    placed = members.join(stats.select("comp", "nb"), "comp").withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    single = placed.where("nb = 1").select(F.pmod(F.xxhash64("comp"), F.lit(groups)).alias("g"), F.lit(-1).alias("bi"), F.lit(-1).alias("bj"), "comp", "node", "blk", "copies")
    grid = placed.where("nb > 1").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(F.col("comp").alias("g"), F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"), "comp", "node", "blk", "copies")
    # one row of each set is read again, also where no row of it has an id
    items = _items(semi_join(docs.withColumn("rk", F.xxhash64("doc_id", "text")), members.select("rk"), "rk"), n, naming)
    found = stable(single.unionByName(grid).join(items, "node").groupBy("g", "bi", "bj").applyInArrow(_verify(scheme), "kind int, u long, v long, w long"))
    linked = components(found.where("kind = 0").select("u", "v"))
    least = linked.join(nodes, "node").groupBy("comp").agg(F.min("rep").alias("component_id"))
    weight = found.where("kind = 1").groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("w"))
    known = nodes.join(linked, "node", "left").join(least, "comp", "left").join(weight, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), F.coalesce("comp", "node").alias("cluster"))
    return counted.drop("sketch").join(known, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "node", "cluster", "rk")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows of `df`, with all their columns, of which linked ones are left out but for
    the one with the smallest id (rows with ids go before those without, equal ids
    by a hash of the text); of rows that share id and text one stays. Texts without
    words link with nothing and stay.
    """
    found = stable(jaccard_components(df, id_col, text_col, n, num, den).select("doc_id", "rk", "cluster"))
    best = found.where("cluster is not null").groupBy("cluster").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rk")).alias("best"))
    key, who, hit, its = free_names(df, "rk", "who", "hit", "its")
    number = F.col(f"`{id_col}`").cast("long")
    # a row goes by its id and the hash, so a hash that two ids share takes no other row along
    same = (F.col(key) == F.col(hit)) & F.col(who).eqNullSafe(F.col(its))
    losers = stable(found.join(best, "cluster").where(F.col("rk") != F.col("best.rk")).select(F.col("rk").alias(hit), F.col("doc_id").alias(its)).distinct())
    repeated = stable(found.groupBy(F.col("rk").alias(hit), F.col("doc_id").alias(its)).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    out = df.withColumns({key: F.xxhash64(number, F.col(f"`{text_col}`").cast("string")), who: number}).join(losers, same, "left_anti")
    if repeated.isEmpty():
        return out.select(*[F.col(f"`{c}`") for c in df.columns])
    # only rows of the same id and text have to meet
    again = out.join(repeated, same, "left_semi").dropDuplicates([key, who])
    return out.join(repeated, same, "left_anti").unionByName(again).select(*[F.col(f"`{c}`") for c in df.columns])


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs, n=4, num=85, den=100).select("doc_id", "n_shingles", "component_id", "n_links")
