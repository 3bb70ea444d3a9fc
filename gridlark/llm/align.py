"""Alignment of the tokens that two tokenizers make of the same texts.

A is a byte-level BPE file, applied to a space and the text; B is a SentencePiece
model, which puts that space in itself. The bytes of all texts of a batch lie one after
another, and a packed bitset of each tokenizer marks the bytes where its tokens end.
AND of both gives the shared cuts. The rank of a cut in a bitset (population counts of
the words before, and of the lower bits of its own) is the token that ends there, so
cuts become ranges of tokens: the groups. Tokens that end together are links.

How many links of all texts hold a pair of ids is counted in two steps: distinct pairs
of a task, then a shuffle by pair. A text gets the counts of its links back from pairs
that hold at least a millionth of all links (a million pairs at most, whatever the
input), which all tasks know; links of rarer pairs are joined in a shuffle, in which no
key can be hot.

Edge cases: texts that are null or empty, and those whose bytes a tokenizer does not
keep (B normalises some), have no tokens; strings of special tokens in a text are plain
text; very long texts are encoded whole; repeated rows count as often as they occur; an
empty table gives no rows; only the named columns are passed on, so others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm import _text as tx
from gridlark.llm._spark import free_names, written, written_at
from gridlark.llm.bpe import TOKENIZER, Codec, _installed
from gridlark.sources.files import Files

A, B = TOKENIZER, "piece_bpe_32k.model"
SHARE = 1_000_000  # pairs with one part in so many of the links are known to all tasks
_HOLD = 1 << 20  # distinct pairs a task holds before it passes them on


class Sides:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        place = lambda p: p if "/" in p else _installed(p)
        self.codec = Codec(place(a))
        self.codec.split = None  # strings of added tokens are plain text
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=place(b))
        of = self.pieces
        self.b_bytes = [bytes([int(p[3:5], 16)]) if of.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(of.id_to_piece(list(range(of.get_piece_size()))))]
        self.a_bytes = self.codec.bytes
        self.size = [np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes)]
        ids = [np.array([b"%d" % i for i in range(len(t))], object) for t in (self.a_bytes, self.b_bytes)]
        self.within, self.last = [x + b"," for x in ids], [ids[0] + b"|", ids[1] + b";"]

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text by A and by B; none where bytes are not kept."""
        none = np.zeros(0, np.int64)
        some = [i for i, t in enumerate(texts) if t]
        out: tuple[list[np.ndarray], list[np.ndarray]] = ([none] * len(texts), [none] * len(texts))
        if not some:
            return out
        spaced = [" " + texts[i] for i in some]  # type: ignore[operator]
        for i, t, a, b in zip(some, spaced, self.codec.encode(spaced), self.pieces.encode([texts[i] for i in some], num_threads=1), strict=True):
            raw = t.encode()
            if b"".join(map(self.b_bytes.__getitem__, b)) == raw and b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw:
                out[0][i], out[1][i] = a.astype(np.int64), np.array(b, np.int64)
        return out


_SIDES: dict[tuple[str, str], Sides] = {}


def sides(a: str, b: str) -> Sides:
    if (a, b) not in _SIDES:
        _SIDES[a, b] = Sides(a, b)
    return _SIDES[a, b]


def bitset(ends: np.ndarray, n: int) -> np.ndarray:
    """A packed set of the bytes (from 0) that end a token, 64 a word."""
    mark = np.zeros(-(-n // 64) * 64, np.uint8)
    mark[ends - 1] = 1
    return np.packbits(mark, bitorder="little").view("<u8")


def rank(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many members lie below each position."""
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
    word, low = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
    return before[word] + np.bitwise_count(bits[word] & low)


def cuts(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of A and of B (from 0) that end at each shared cut, for the byte sizes
    of tokens that cover the same bytes."""
    ends = [np.cumsum(size_a), np.cumsum(size_b)]
    if not len(size_a):
        return ends[0], ends[1]
    sets = [bitset(e, int(e[-1])) for e in ends]
    at = np.flatnonzero(np.unpackbits((sets[0] & sets[1]).view(np.uint8), bitorder="little"))
    return rank(sets[0], at), rank(sets[1], at)


#: Type of each column that `align` can make.
KINDS = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups": "string", "groups_sha256": "string", "pairs": "array<long>", "times": "array<int>"}


def align(df: DataFrame, a: str = A, b: str = B, text_col: str = "text", keep: Sequence[str] = (), make: Sequence[str] = ("n_a", "n_b", "n_groups", "n_links", "groups")) -> DataFrame:
    """Align the tokens of `text_col`; the result has the columns `keep`, then those of
    `make`: numbers of tokens, groups and links; groups as text (`a1,a2|b1;a3|b2,b3`, empty
    without tokens) or its hex digest; distinct linked pairs (`a << 32 | b`) and how often
    each is linked in the text."""
    clash = set(keep) & set(make)
    if clash:
        raise ValueError(f"columns made would clash: {sorted(clash)}")
    make = list(make)
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").cast("string").alias("text"))
    fields = [f"`{c}` {f.dataType.simpleString()}" for c, f in zip(keep, source.schema.fields, strict=False)] + [f"`{m}` {KINDS[m]}" for m in make]

    def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        off = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(a, b)
        for batch in batches:
            for part in tx.chunks(batch, "text", 1 << 20):
                made = _aligned(both, part.column("text").to_pylist(), make)
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                for m in make:
                    columns.append(lists(made[m], pa.int64() if m == "pairs" else pa.int32()) if m in ("pairs", "times") else pa.array(made[m], pa.string() if m.startswith("groups") else pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, [*keep, *make])

    return source.mapInArrow(run, ", ".join(fields))


def _aligned(both: Sides, texts: list[str | None], make: Sequence[str]) -> dict[str, list]:
    ids_a, ids_b = both.encode(texts)
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
    end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
    flat_a, flat_b = np.concatenate([np.zeros(0, np.int64), *ids_a]), np.concatenate([np.zeros(0, np.int64), *ids_b])
    last_a, last_b = cuts(both.size[0][flat_a], both.size[1][flat_b])
    # a text ends with both of its last tokens, so no group goes over the end of a text
    end = np.searchsorted(last_a, end_a, "left")  # groups up to the end of each text
    n = np.diff(end, prepend=0)
    out: dict[str, list] = {"n_a": n_a.tolist(), "n_b": n_b.tolist(), "n_groups": n.tolist(), "n_links": n.tolist()}
    if {"groups", "groups_sha256"} & set(make):
        texts_of = _groups(both, flat_a, flat_b, last_a, last_b, end_a + end_b)
        out["groups"] = [x.decode() for x in texts_of] if "groups" in make else []
        out["groups_sha256"] = [hashlib.sha256(x).hexdigest() if x else "" for x in texts_of]
    if {"pairs", "times"} & set(make):
        key = flat_a[last_a] << 32 | flat_b[last_b]
        parts = [np.unique(key[e - k : e], return_counts=True) for e, k in zip(end, n, strict=True)]
        out["pairs"], out["times"] = [p for p, _ in parts], [t for _, t in parts]
    return out


def _groups(both: Sides, flat_a: np.ndarray, flat_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Groups of each text as bytes. Tokens of A and B are put in one row by group, those
    of A first; each is followed by what parts it from the next."""
    row = np.empty(len(flat_a) + len(flat_b), object)
    before_b, through_a = np.concatenate([[0], last_b + 1])[:-1], last_a + 1
    k_a, k_b = (np.diff(last, prepend=-1) for last in (last_a, last_b))
    for side, flat, last, put in ((0, flat_a, last_a, np.repeat(before_b, k_a)), (1, flat_b, last_b, np.repeat(through_a, k_b))):
        token = both.within[side][flat]
        token[last] = both.last[side][flat[last]]
        row[np.arange(len(flat)) + put] = token
    return [b"".join(row[s:e].tolist())[:-1] for s, e in zip(np.concatenate([[0], ends])[:-1], ends, strict=True)]


def pair_counts(aligned: DataFrame) -> DataFrame:
    """`(pair, n, best)` of an aligned table with `pairs` and `times`: in how many links of all
    texts a pair is, and whether no pair with the same id of B is in more."""

    def merged(keys: list, times: list) -> pa.RecordBatch:
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(where, np.concatenate(times), len(key)).astype(np.int64))], ["pair", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        times: list = []
        held = 0
        for batch in batches:
            keys.append(batch.column(0).flatten().to_numpy())
            times.append(batch.column(1).flatten().to_numpy())
            held += len(keys[-1])
            if held > 2 * _HOLD:
                one = merged(keys, times)
                keys, times, held = [], [], 0
                if one.num_rows > _HOLD:
                    yield one
                else:
                    keys, times, held = [one.column(0).to_numpy()], [one.column(1).to_numpy()], one.num_rows
        if held:
            yield merged(keys, times)

    counts = written(aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    top = counts.groupBy(b.alias("b")).agg(F.max("n").alias("top"))
    # a row for each id of B
    return counts.withColumn("b", b).join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def with_counts(aligned: DataFrame, counts: DataFrame, share: int = SHARE) -> DataFrame:
    """An aligned table with n_best (links whose pair is the best of its id of B) and
    count_sum (of the pairs' counts over links) in place of `pairs` and `times`."""
    counts = written(counts)
    least = max(1, -(-(counts.agg(F.sum("n")).first()[0] or 0) // share))
    # no more than `share` pairs can have so many links
    known = counts.where(F.col("n") >= least).toArrow().combine_chunks().sort_by("pair")
    key, n, best = (known.column(c).to_numpy() for c in ("pair", "n", "best"))
    own, rare, more = free_names(aligned, "row", "rare", "more")
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]
    fields = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            size = np.diff(pairs.offsets.to_numpy())
            p, t = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(key, p), max(0, len(key) - 1))
            hit = key[at] == p if len(key) else np.zeros(len(p), bool)
            found = np.where(hit, at, 0)
            ends = np.cumsum(size)
            add = [np.zeros(len(size), np.int64)] * 2
            if len(key):
                sums = [np.concatenate([[0], np.cumsum(np.where(ok, x, 0))]) for ok, x in ((hit & best[found], t), (hit, n[found] * t))]
                add = [c[ends] - c[ends - size] for c in sums]
            off = np.concatenate([[0], np.cumsum(np.bincount(doc[~hit], minlength=len(size)))])
            lists = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x[~hit], k)) for x, k in ((p, pa.int64()), (t, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(add[0]), pa.array(add[1]), *lists], [*kept, "n_best", "count_sum", rare, more])

    source = aligned.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], "pairs", "times")
    out = source.mapInArrow(run, f"{fields}, n_best long, count_sum long, `{rare}` array<long>, `{more}` array<int>")
    out = written(out.withColumn(own, F.monotonically_increasing_id()))
    whole = F.size(rare) == 0
    links = out.where(~whole).select(own, F.explode(F.arrays_zip(F.col(rare).alias("pair"), F.col(more).alias("t"))).alias("x")).select(own, "x.pair", "x.t")
    sums = links.join(counts, "pair").groupBy(own).agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("_b"), F.sum(F.col("n") * F.col("t")).alias("_c"))
    late = out.where(~whole).join(sums, own).withColumns({"n_best": F.col("n_best") + F.col("_b"), "count_sum": F.col("count_sum") + F.col("_c")})
    names = [F.col(f"`{c}`") for c in [*kept, "n_best", "count_sum"]]
    return out.where(whole).select(*names).unionByName(late.select(*names))


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    aligned, path = written_at(align(docs, keep=["doc_id"], make=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]))
    out = with_counts(aligned, pair_counts(aligned))
    Files(spark).delete(path)  # what `out` needs of it is written
    return out
