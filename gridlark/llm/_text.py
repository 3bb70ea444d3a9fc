"""Vectorised tokenising and hashing of Arrow text columns.

Texts of a batch lie in one byte buffer. Words are found by table look-up on
bytes and hashed in blocks of eight, so the work per byte is a handful of numpy
passes and no Python object is made per word. What decides whether texts are equal
takes `span_ids`; `span_hashes`, a polynomial modulo 2^64 for which unequal spans with
equal hashes can be built, only deals features to buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}

#: Bytes that end a word: space and the controls 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that end a word when punctuation is left out: ASCII but letters and digits.
PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n + 1:
        m = max(n + 1, 1 << 20)
        with np.errstate(over="ignore"):
            for name, base in (("p", _BASE), ("i", _INVERSE)):
                a = np.full(m, base, dtype=np.uint64)
                a[0] = 1
                _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["p"], _POWERS["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def unique(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which beats hashing here."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def unique_counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[at], np.diff(np.append(at, len(x)))


def chunks(batch: pa.RecordBatch, text: str, budget: int = 512 << 10) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `budget` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends = np.cumsum(size)
    a = 0
    while a < len(size):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + budget, "right"))
        b = max(b, a + 1)
        yield batch.slice(a, b - a)
        a = b


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    if not len(column) or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(buffers[2], np.uint8)[off[0] : off[-1]], off - off[0]


def spans(data: np.ndarray, off: np.ndarray, ends_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words and the text each is in."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~ends_word[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | cut[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | cut[1:n]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(off, s, "right") - 1


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans; letters A to Z count as a to z if `lower`."""
    if not len(s):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(data))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_TABLE[_LOWER] if lower else _TABLE)[data] * power[: len(data)], out=total[1:])
        return mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * U(0x632BE59BD9B4E019))


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_ids(data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = True, salt: int = 0) -> np.ndarray:
    """64-bit identities of byte spans: blocks of eight bytes are mixed, each with its
    place, before they are added up, so no pattern of blocks cancels out. Spans of one
    block and length never share one. Other salts give independent values."""
    out = np.zeros(len(s), np.uint64)
    if not len(s):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = _LOWER[data] if lower else data
    load = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = e - s
    blocks = (size + 7) >> 3
    first = np.cumsum(blocks) - blocks
    place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    at = np.repeat(s, blocks) + (place << 3)
    with np.errstate(over="ignore"):
        x = load[at] & _MASK[np.minimum(np.repeat(e, blocks) - at, 8)]
        x = mix(x ^ mix((place.astype(np.uint64) + U(1)) * _BASE + U(salt)))
        some = np.flatnonzero(blocks)
        if len(some):
            out[some] = np.add.reduceat(x, first[some])
        return mix(out + size.astype(np.uint64) * U(0x632BE59BD9B4E019) + U(salt))


def words(data: np.ndarray, off: np.ndarray, ends_word: np.ndarray = SPACE, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A to Z lower-cased, and the text it is in."""
    s, e, doc = spans(data, off, ends_word)
    return span_ids(data, s, e, salt=salt), doc


_SLOT = [U(int(x) | 1) for x in np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 64, dtype=np.uint64)]
LOW52 = U((1 << 52) - 1)


def _shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles, repeats included, and the text each is in."""
    count = np.bincount(doc, minlength=n_docs)
    with np.errstate(over="ignore"):
        if len(h) >= n:
            whole = doc[n - 1 :] == doc[: len(doc) - n + 1]
            g = np.zeros(len(h) - n + 1, np.uint64)
            for k in range(n):
                g += h[k : len(h) - n + 1 + k] * _SLOT[k]
            g, d = mix(g[whole]), doc[: len(doc) - n + 1][whole]
        else:
            g, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            first = np.concatenate([[0], np.cumsum(count)])
            extra = np.zeros(len(short), np.uint64)
            for i, x in enumerate(short):
                for k in range(count[x]):
                    extra[i] += h[first[x] + k] * _SLOT[k]
                extra[i] += U(int(count[x])) * _SLOT[63]
            g, d = np.concatenate([g, mix(extra)]), np.concatenate([d, short])
    return g, d


def _of_text(g: np.ndarray, d: np.ndarray, n_docs: int) -> np.ndarray:
    if n_docs > 4096:
        raise ValueError("at most 4096 texts at a time")
    return (d.astype(np.uint64) << U(52)) | (g & LOW52)


def shingle_sets(h: np.ndarray, doc: np.ndarray, n_docs: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text as sorted `(doc, 52-bit hash)`.

    A text of fewer than n words has its whole sequence as one shingle; one
    without words has none. At most 4096 texts at a time.
    """
    key = unique(_of_text(*_shingles(h, doc, n_docs, n), n_docs))
    return (key >> U(52)).astype(np.int64), key & LOW52


def shingle_checks(h: np.ndarray, second: np.ndarray, doc: np.ndarray, n_docs: int, n: int) -> np.ndarray:
    """For each shingle of `shingle_sets` 64 bits more, from other hashes of the words."""
    g, d = _shingles(h, doc, n_docs, n)
    key = _of_text(g, d, n_docs)
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    more = _shingles(second, doc, n_docs, n)[0][order]
    return np.maximum.reduceat(more, at) if len(at) else more
