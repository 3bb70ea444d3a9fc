"""BPE encoding and decoding by batched numpy merge rounds.

A byte-level BPE file of the `tokenizers` kind is read as data: vocabulary,
ranked merges, added tokens. Words that a batch brings for the first time are
encoded together: their symbols lie in one flat array, every round finds the rank
of each neighbouring pair by binary search over the sorted pair keys, and each
word merges its lowest-ranked pair (all of its occurrences, left to right). Ids
of known words are kept in a bounded table of each Python worker.

The result equals that of the `tokenizers` library with
add_special_tokens=False: strings of added tokens in a text become their id.
Decoding joins the tokens' bytes and replaces what is no UTF-8.

Edge cases: null counts as the empty text and gives no ids; very long texts are
split into words like any other; the order and number of rows stay; only the
named columns are passed on, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm import _text as tx

#: Fixed pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
_KNOWN_WORDS = 250_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one tokenizer file; keeps a bounded word table."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") or pre.get("add_prefix_space"):
            raise ValueError("only byte-level BPE without normalizer and prefix space")
        letter = byte_letters()
        byte = {c: b for b, c in letter.items()}
        vocab = model["vocab"]
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in (vocab | added).items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.base = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.first = np.full(65536, -1, np.int64)  # ranks of pairs of single bytes
        value = {int(t): b for b, t in enumerate(self.base)}
        for r, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
            if a in value and b in value:
                self.first[value[a] << 8 | value[b]] = r
        self.word = regex.compile(PATTERN)
        self.added = added
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1, np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        sym, word = self.base[data], np.repeat(np.arange(len(words)), size)
        none = np.int64(1 << 40)
        rank = np.full(len(sym), none)
        if len(sym) > 1:
            r = self.first[data[:-1].astype(np.int64) << 8 | data[1:]]
            ok = (word[1:] == word[:-1]) & (r >= 0)
            rank[:-1][ok] = r[ok]
        done_sym, done_word = [], []
        while len(sym):
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            length = np.diff(np.append(begin, len(word)))
            low = np.minimum.reduceat(rank, begin)
            if (low == none).any():  # words that are done leave the array
                over = np.repeat(low == none, length)
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, rank = sym[~over], word[~over], rank[~over]
                length, low = length[low < none], low[low < none]
                if not len(sym):
                    break
            hit = rank == np.repeat(low, length)
            if (hit[1:] & hit[:-1]).any():  # a run of one symbol merges from its left
                at = np.flatnonzero(hit)
                run = np.cumsum(np.concatenate([[True], np.diff(at) > 1])) - 1
                start = at[np.concatenate([[True], np.diff(at) > 1])]
                hit[at[(at - start[run]) % 2 == 1]] = False
            at = np.flatnonzero(hit)
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            fresh = np.zeros(len(sym), bool)
            fresh[at] = True
            sym, word, rank, fresh = sym[keep], word[keep], rank[keep], fresh[keep]
            stale = fresh.copy()
            stale[:-1] |= fresh[1:]
            i = np.flatnonzero(stale[:-1] & (word[1:] == word[:-1]))
            rank[stale] = none
            r = self._rank(sym[i], sym[i + 1])
            rank[i[r >= 0]] = r[r >= 0]
        if not done_sym:
            return np.zeros(0, np.uint32), size * 0
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.uint32), np.bincount(word, minlength=len(words))

    def _learn(self, words: list[str]) -> None:
        ids, size = self.merge([w.encode("utf-8", "surrogatepass") for w in words])
        at = self.start[-1]
        if at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[at : at + len(ids)] = ids
        n = len(self.start) - 1
        self.index.update(zip(words, range(n, n + len(words)), strict=True))
        self.start = np.concatenate([self.start, at + np.cumsum(size)])

    def _pieces(self, text: str) -> list[str | int]:
        if self.split is None or not any(a in text for a in self.added):
            return self.word.findall(text)
        out: list[str | int] = []
        for part in self.split.split(text):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out += self.word.findall(part)
        return out

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        if len(self.index) > _KNOWN_WORDS:
            self.forget()
        cut = [self._pieces(t or "") for t in texts]
        new = set(itertools.chain.from_iterable(cut)).difference(self.index)
        new.difference_update(self.added.values())
        if new:
            self._learn(sorted(new))
        get, out = self.index.get, []
        for words in cut:
            special = [(i, w) for i, w in enumerate(words) if w.__class__ is int] if self.split is not None and any(w.__class__ is int for w in words) else []
            if not special:
                out.append(self._gather(np.fromiter(map(get, words), np.int64, len(words))))
                continue
            parts, a = [], 0
            for i, w in special:
                parts += [self._gather(np.fromiter(map(get, words[a:i]), np.int64, i - a)), np.array([w], np.uint32)]
                a = i + 1
            parts.append(self._gather(np.fromiter(map(get, words[a:]), np.int64, len(words) - a)))
            out.append(np.concatenate(parts))
        return out

    def _gather(self, at: np.ndarray) -> np.ndarray:
        s = self.start[at]
        size = self.start[at + 1] - s
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(s - ends + size, size)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a tokenizer file: a path, or the bare name of one of the
    installed public tokenizers, which is found where the worker runs."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path if os.path.dirname(path) else _installed(path))
    return _CODECS[path]


def _installed(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Type of each column that `bpe` can make.
KINDS = {"n_tokens": "long", "ids": "array<int>", "packed": "binary", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def bpe(df: DataFrame, path: str, text_col: str = "text", keep: Sequence[str] = (), make: Sequence[str] = ("n_tokens", "ids")) -> DataFrame:
    """Encode `text_col`; the result has the columns `keep`, then those of `make`:
    n_tokens, ids (array), packed (ids as little-endian unsigned 32-bit integers),
    decoded (text made from the ids) and hex digests of the last two.
    """
    clash = set(keep) & set(make)
    if clash:
        raise ValueError(f"columns made would clash: {sorted(clash)}")
    make = list(make)
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").cast("string").alias("text"))
    fields = [f"`{c}` {f.dataType.simpleString()}" for c, f in zip(keep, source.schema.fields, strict=False)] + [f"`{m}` {KINDS[m]}" for m in make]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            for part in tx.chunks(batch, "text", 1 << 20):
                ids = coder.encode(part.column("text").to_pylist())
                decoded = [coder.decode(x) for x in ids] if {"decoded", "decoded_sha256"} & set(make) else []
                of = {
                    "n_tokens": lambda: pa.array([len(x) for x in ids], pa.int64()),  # noqa: B023
                    "ids": lambda: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32))),  # noqa: B023
                    "packed": lambda: pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),  # noqa: B023
                    "decoded": lambda: pa.array(decoded, pa.string()),  # noqa: B023
                    "ids_sha256": lambda: pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),  # noqa: B023
                    "decoded_sha256": lambda: pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),  # noqa: B023
                }
                columns = [part.column(i) for i in range(part.num_columns - 1)] + [of[m]() for m in make]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *make])

    return source.mapInArrow(run, ", ".join(fields))


def unbpe(df: DataFrame, path: str, packed_col: str = "packed", keep: Sequence[str] = (), out: str = "text") -> DataFrame:
    """Decode packed ids (little-endian unsigned 32-bit); null gives the empty text."""
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{packed_col}`").alias("packed"))
    fields = [f"`{c}` {f.dataType.simpleString()}" for c, f in zip(keep, source.schema.fields, strict=False)] + [f"`{out}` string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            text = [coder.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column("packed")]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(text, pa.string())], [*keep, out])

    return source.mapInArrow(run, ", ".join(fields))


#: The tokenizer of the query and of the pipeline.
TOKENIZER = "byte_bpe_50k.json"


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe(docs, TOKENIZER, keep=["doc_id"], make=["n_tokens", "ids_sha256", "decoded_sha256"])
