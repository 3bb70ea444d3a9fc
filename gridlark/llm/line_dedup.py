"""Line dedup by a suffix array over sequences of line ids.

Documents are sequences of line ids, one after another in the order (doc_id,
text). A run of lines that occurs before, in an earlier document or earlier in
its own, is deleted where it occurs later, if it has `min_words` words or more.

* **Prefix doubling.** The rank of a suffix is the pair of its first line's hash
  and the number of suffixes with this first line that are known to be smaller.
  Round k sorts the suffixes whose first 2^k lines repeat by (own rank, rank 2^k
  lines on), which ranks them by 2^(k+1) lines; a suffix whose rank is its own, or
  that ends there, is done. This goes on until none is left. Sorts are range
  partitioned and break ties by position, so a line that a third of all documents
  has is spread over many tasks; ranks come from what is counted along the sorted
  rows, for which partitions pass on a few numbers each, as rows of a table.
* **Common prefixes.** The suffixes whose first line repeats, sorted by rank, are
  the suffix array. Of neighbours in it the longest common prefix is known where
  they end alike or share one line only. Where the lines before both are the same, it
  is one less than that of the suffixes one line earlier. The others, few and short in
  sum, are compared line by line.
* **Intervals.** A maximal repeated run is a longest-common-prefix interval. The
  longest run at a suffix that began earlier belongs to the nearest neighbour in
  either direction that is earlier in the corpus; it is found with a stack along the
  array, of which partitions pass on what the next ones can still see (never more
  than the lines of a common prefix).

Edge cases: null texts stay null and have no lines; empty lines are lines of no
words; rows that repeat (id and text) are one document and treated alike;
a line is known by 128 bits (64, and 64 more where different lines share these);
documents of one id and other texts are ordered by a hash of the text; null ids
come first; very long texts are one row in each step; an empty table gives no rows;
extra columns stay as they are, whatever their names, but for `deleted_lines`,
which takes the place of a column of that name.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlark.llm import _text as tx
from gridlark.llm._spark import free_names, has_rows_below, stable, written, written_at
from gridlark.sources.files import Files

_BREAK = np.zeros(256, bool)
_BREAK[10] = True
_ROWS = 150_000  # of a partition or a bucket, about
_CHECK = 0x5851F42D4C957F2D  # salt of the second hash


def line_arrays(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Of all lines: text, position, hash, number of words and a second, independent hash."""
    data, off = tx.raw(column)
    n = len(off) - 1
    breaks = np.flatnonzero(_BREAK[data]) if len(data) else np.zeros(0, np.int64)
    # a line ends at each break and at the end of each text; texts come first in
    # the order, as empty ones share an offset with their neighbours
    ends = np.concatenate([breaks, off[1:]])
    doc = np.concatenate([np.searchsorted(off, breaks, "right") - 1, np.arange(n)])
    order = np.lexsort((ends, doc))
    doc, ends = doc[order], ends[order]
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    starts = np.where(new, off[doc], np.concatenate([[0], ends[:-1] + 1]))
    first = np.flatnonzero(new)
    pos = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    h, check = (tx.span_ids(data, starts, ends, lower=False, salt=k) for k in (0, _CHECK))
    s, _, _ = tx.spans(data, off, tx.SPACE)
    words = np.searchsorted(s, ends) - np.searchsorted(s, starts)
    return doc, pos, h, words, check


def reach(doc: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line, the number of lines of the shortest run of `least` words
    that begins there, and that ends there; 0 where the text has none."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(doc)
    i = np.arange(n)
    last = np.searchsorted(doc, doc, "right")
    head = np.searchsorted(doc, doc, "left")
    end = np.searchsorted(total, total[:-1] + least, "left")  # first prefix with enough
    forward = np.where(end <= last, np.maximum(end - i, 1), 0)
    begin = np.searchsorted(total, total[1:] - least, "right") - 1  # last start with enough
    backward = np.where((total[1:] - total[head] >= least) & (begin >= head), i + 1 - np.minimum(begin, i), 0)
    return forward, backward


_LINE = "did long, tk long, pos int, a long, f int, prev long, tail int"
_READ = f"{_LINE}, c long, pc long"

def _lines(df: DataFrame, min_words: int) -> DataFrame:
    """A row a line: its hash `a`, the lines of the shortest run of enough words that
    begins there `f`, the hash of the line before (of none, its own flipped), how
    many lines there are to the end of the text, and second hashes of both lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.chunks(batch, "text"):
                doc, pos, h, words, c = line_arrays(part.column("text"))
                f, _ = reach(doc, words, min_words)
                prev, pc = (np.where(pos > 0, np.concatenate([x[:1], x[:-1]]), ~x) for x in (h, c))
                tail = np.searchsorted(doc, doc, "right") - np.arange(len(doc))
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([part.column("did").take(at), part.column("tk").take(at), pa.array(pos, pa.int32()), pa.array(h.view(np.int64)), pa.array(f, pa.int32()), pa.array(prev.view(np.int64)), pa.array(tail, pa.int32()), pa.array(c.view(np.int64)), pa.array(pc.view(np.int64))], _names(_READ))

    return df.mapInArrow(run, _READ)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _whole(batches: Iterator[pa.RecordBatch], schema: str) -> dict[str, np.ndarray]:
    """All rows of a partition, which has about _ROWS."""
    got = list(batches)
    if not got:
        return {c: np.zeros(0, np.int64) for c in _names(schema)}
    t = pa.Table.from_batches(got)
    return {c: t.column(c).to_numpy() for c in t.column_names}


def _change(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it; the first one does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _table(schema: str, **columns) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.table({c: pa.array(columns[c], kinds[k]) for c, k in (x.split() for x in schema.split(", "))})


def _sorted(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows in order over partitions of about _ROWS, with the number `pid` of each."""
    n = max(8, -(-rows // _ROWS))
    return stable(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("pid", F.spark_partition_id()))


_SUFFIX = f"{_LINE}, b long, k int, live boolean"
_ASKING = f"{_SUFFIX}, a2 long, b2 long, role int"


def _bucket(rows: int, did: str = "did", tk: str = "tk"):
    """Documents are dealt to so many buckets, of about _ROWS lines each."""
    return F.pmod(F.xxhash64(did, tk), F.lit(max(8, -(-rows // _ROWS)))).cast("int").alias("bucket")


def _second(k: int):
    """Of the documents of a bucket: suffixes with the rank 2^k lines on. role: 0 goes
    on, 1 is done but may be asked by one that goes on, 2 its document is done."""

    def run(rows: pa.Table) -> pa.Table:
        x = {c: rows.column(c).to_numpy() for c in _names(_SUFFIX)}
        order = np.lexsort((x["pos"], x["tk"], x["did"]))
        x = {c: v[order] for c, v in x.items()}
        doc = np.cumsum(_change(x["did"], x["tk"])) - 1
        to = np.minimum(np.arange(len(doc)) + (1 << k), max(0, len(doc) - 1))
        inside = x["tail"] > 1 << k
        # the end of a text is a line of its own kind, with rank (0, -1)
        x["a2"], x["b2"] = np.where(inside, x["a"][to], 0), np.where(inside, x["b"][to], -1)
        x["role"] = np.where(x["live"], 0, np.where(np.bincount(doc, x["live"])[doc] > 0, 1, 2))
        return _table(_ASKING, **x)

    return run


_RANKED = f"{_LINE}, b long, live boolean, pid int, carried int, edge int"
_ENDS = "pid int, n long, fa long, fb long, fa2 long, fb2 long, la long, lb long, la2 long, lb2 long, fg long, fs long, lg long, ls long"


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Along sorted suffixes: new ranks, but for what partitions before add.

    carried: 1 where the group may begin in a partition before, 2 where the equal
    suffixes may, too. edge: bits of a suffix that is alone here, but may have equal
    ones in the partition before (1) or after (2).
    """
    x = _whole(batches, _ASKING)
    n = len(x["a"])
    if not n:
        return
    group, same = _change(x["a"], x["b"]), _change(x["a"], x["b"], x["a2"], x["b2"])
    g0, s0 = (np.maximum.accumulate(np.where(new, np.arange(n), 0)) for new in (group, same))
    alone = np.bincount(np.cumsum(same) - 1)[np.cumsum(same) - 1] == 1
    ended = x["b2"] < 0
    x["b"] = x["b"] + s0 - g0
    edge = np.where(alone & ~ended, (s0 == 0) + 2 * (s0 == s0[-1]), 0)
    yield from _table(_RANKED, **{c: x[c] for c in _names(_LINE)}, b=x["b"], live=~ended & (~alone | (edge > 0)), pid=x["pid"], carried=np.where(s0 == 0, 2, np.where(g0 == 0, 1, 0)), edge=edge).to_batches()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's first and last ranks and the rows that have them."""
    x = _whole(batches, _ASKING)
    n = len(x["a"])
    if n:
        keys = {c: x[c] for c in ("a", "b", "a2", "b2")}
        like = lambda m, at: [int(np.all([c == c[at] for c in list(keys.values())[:m]], axis=0).sum())]
        yield from _table(_ENDS, pid=x["pid"][:1], n=[n], **{f"f{c}": v[:1] for c, v in keys.items()}, **{f"l{c}": v[-1:] for c, v in keys.items()}, fg=like(2, 0), fs=like(4, 0), lg=like(2, -1), ls=like(4, -1)).to_batches()


def _carries(ends: DataFrame) -> DataFrame:
    """For each partition `pid`, rows of its first group (g) and of its first equal
    suffixes (s) in partitions before, and whether its first (back) and last ones (on)
    have equal ones there. Windows over a row a partition."""
    along = Window.orderBy("pid")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    prior = lambda c: F.lag(c).over(along)
    meets = lambda *keys: F.coalesce(F.forall(F.array(*[F.col(f"f{c}") == prior(f"l{c}") for c in keys]), lambda x: x), F.lit(False))
    x = ends.select("*", meets("a", "b").alias("in_g"), meets("a", "b", "a2", "b2").alias("in_s"))
    for c in ("g", "s"):
        # rows that end like the last one do so from where their chain of partitions begins
        x = x.withColumn("sum", F.sum(f"l{c}").over(upto))
        begins = ~(F.col(f"in_{c}") & (F.col(f"f{c}") == F.col("n")))
        x = x.withColumn("from", F.max(F.when(begins, F.col("sum") - F.col(f"l{c}"))).over(upto))
        x = x.withColumn(c, F.when(F.col(f"in_{c}"), prior("sum") - prior("from")).otherwise(0)).drop("sum", "from")
    return x.select("pid", "g", "s", F.col("in_s").alias("back"), F.coalesce(F.lead("in_s").over(along), F.lit(False)).alias("on"))


#: Partitions up to which their carries (30 bytes each) are known to all tasks.
_CARRIED = 200_000


def _with_carries(ranked: DataFrame, near: DataFrame) -> DataFrame:
    """Rows with the carries of their partition. With many partitions only rows that
    need one, those of a first group or an edge, meet them in a shuffled join."""
    if has_rows_below(near, _CARRIED):
        return ranked.join(F.broadcast(near), "pid")
    needs = (F.col("carried") > 0) | (F.col("edge") > 0)
    rest = ranked.where(~needs).select("*", *[F.lit(0).cast("long").alias(c) for c in ("g", "s")], *[F.lit(False).alias(c) for c in ("back", "on")])
    return ranked.where(needs).join(near, "pid").select(*rest.columns).unionByName(rest)


def _parted(lines: DataFrame, mixed: DataFrame) -> DataFrame:
    """Different lines that share a hash get others, made of both of theirs, wherever
    they stand: as a line and as the one before."""
    for first, second in (("a", "c"), ("prev", "pc")):
        hit = mixed.select(F.col("a").alias("_mixed"), F.lit(True).alias("_hit"))
        lines = lines.join(hit, F.col(first) == F.col("_mixed"), "left").withColumn(first, F.when(F.col("_hit"), F.xxhash64(first, second)).otherwise(F.col(first))).drop("_mixed", "_hit")
    return written(lines)


def suffix_array(lines: DataFrame) -> DataFrame:
    """The suffixes whose first line repeats, with their rank `(a, b)` and `k`: the
    first 2^k lines repeat, twice as many don't (or the text ends). Equal ranks are
    equal to the end of both texts."""
    spark = lines.sparkSession
    lines, path = written_at(lines.dropDuplicates(["did", "tk", "pos"]))
    counted = lambda: stable(lines.groupBy("a").agg(F.count("*").alias("n"), (F.min("c") < F.max("c")).alias("mixed")).where("n > 1"))
    often = counted()
    mixed = often.where("mixed").select("a")
    if not mixed.isEmpty():
        lines, often = (lines := _parted(lines, mixed)), counted()
    # lines that so many texts have are known to all tasks (2,000 of them at most)
    n = often.agg(F.sum("n")).first()[0] or 0
    many, total = n // 2_000, lines.count()
    common = F.col("a").isin([r["a"] for r in often.where(F.col("n") > many).select("a").collect()] if many else [])
    rare = lines.where(~common).join(often.select("a", F.lit(True).alias("live")), "a", "left")
    lines = rare.unionByName(lines.where(common).withColumn("live", F.lit(True)))
    live = F.coalesce("live", F.lit(False))
    # the state of a round is not stored: it is read once more for a count only
    state = lines.select(*_names(_LINE), F.lit(0).cast("long").alias("b"), F.when(live, 0).otherwise(-1).alias("k"), live.alias("live"))
    done, k = [], 0
    while n:
        asking = stable(state.groupBy(_bucket(total)).applyInArrow(_second(k), _ASKING))
        done.append(asking.where("role = 2 and k >= 0").select(*_names(_SUFFIX)))
        ordered = _sorted(asking.where("role = 0"), n, "a", "b", "a2", "b2", "did", "tk", "pos")
        near = stable(_carries(ordered.mapInArrow(_ends, _ENDS)))
        b = F.col("b") + F.when(F.col("carried") == 2, F.col("g") - F.col("s")).when(F.col("carried") == 1, F.col("g")).otherwise(0)
        again = (F.col("edge") == 0) | (F.col("edge").bitwiseAND(1) > 0) & F.col("back") | (F.col("edge").bitwiseAND(2) > 0) & F.col("on")
        live = F.col("live") & again
        ranked = _with_carries(ordered.mapInArrow(_ranks, _RANKED), near).select(*_names(_LINE), b.alias("b"), F.when(live, k + 1).otherwise(k).alias("k"), live.alias("live"))
        idle = asking.where("role = 1").select(*_names(_SUFFIX))
        state = ranked.unionByName(idle)
        k, total, n = k + 1, n + idle.count(), ranked.where("live").count()
    out = state.where("k >= 0") if k else spark.createDataFrame([], _SUFFIX)
    for x in done:
        out = out.unionByName(x)
    Files(spark).delete(path)  # rounds end in checkpoints
    return out


_PLACED = "did long, tk long, pos int, a long, b long, f int, lcp int, qdid long, qtk long, qpos int, span int"
_ASK, _LESS = -1, -2


_RIM = f"{_SUFFIX}, pid int, side int"
_SEEN = ("did", "tk", "pos", "a", "b", "k", "prev")


def _rim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's first (side 0) and last row (1)."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            first, last = first or batch.slice(0, 1), batch.slice(batch.num_rows - 1)
    for side, row in enumerate((first, last)):
        if row is not None:
            yield pa.RecordBatch.from_arrays([*row.columns, pa.array([side], pa.int32())], _names(_RIM))


def _placed(x: dict, q: dict) -> pa.Table:
    """Suffixes `x` with those before them in the array, `q`, and their common prefix
    where it is known at once: none, one line, or all of equal suffixes. Else `_LESS`, one
    less than that of the line before, or `_ASK`: it takes a comparison of up to span
    lines."""
    k = np.minimum(x["k"], q["k"])
    less = (x["prev"] == q["prev"]) & (x["pos"] > 0) & (q["pos"] > 0)
    lcp = np.where(x["a"] != q["a"], 0, np.where(x["b"] == q["b"], x["tail"], np.where(k == 0, 1, np.where(less, _LESS, _ASK))))
    return _table(_PLACED, **{c: x[c] for c in ("did", "tk", "pos", "a", "b", "f")}, lcp=lcp, qdid=q["did"], qtk=q["tk"], qpos=q["pos"], span=2 << k)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All suffixes of a partition but its first one, with the one before."""
    x = _whole(batches, _SUFFIX)
    if len(x["a"]) > 1:
        yield from _placed({c: v[1:] for c, v in x.items()}, {c: x[c][:-1] for c in _SEEN}).to_batches()


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First suffixes of partitions; what comes before the very first one is null."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        x = {c: t.column(c).to_numpy() for c in _names(_SUFFIX)}
        there = t.column("qa").is_valid().to_numpy()
        q = {c: t.column(f"q{c}").fill_null(0).to_numpy() for c in _SEEN}
        # a suffix that none comes before shares nothing with it
        q["a"] = np.where(there, q["a"], ~x["a"])
        yield from _placed(x, q).to_batches()


def _places(docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Numbers of lines, in order of document and position, alike in all tables."""
    did, tk = (np.concatenate([d[i] for d in docs]) for i in (0, 1))
    order = np.lexsort((tk, did))
    number = np.empty(len(did), np.int64)
    number[order] = np.cumsum(_change(did[order], tk[order])) - 1
    cut = np.split(number, np.cumsum([len(d[0]) for d in docs])[:-1])
    return [(n << 32) | d[2].astype(np.int64) for n, d in zip(cut, docs, strict=True)]


def _columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    # the missing side of a cogroup has no columns
    return [t.column(c).to_numpy() if t.num_rows else np.zeros(0, np.int64) for c in names]


def _follows(key: np.ndarray) -> np.ndarray:
    """End of the run of lines without a gap that each one is in."""
    cut = np.flatnonzero(np.concatenate([key[1:] != key[:-1] + 1, [True]])) if len(key) else np.zeros(0, np.int64)
    return cut[np.searchsorted(cut, np.arange(len(key)))] + 1


_SEGMENT = "did long, tk long, pos int, seen binary"


def _segments(lines: pa.Table, asked: pa.Table) -> pa.Table:
    """For each comparison the lines of the neighbour; a line that never repeats ends it."""
    mine, other = _places([tuple(_columns(lines, "did", "tk", "pos")), tuple(_columns(asked, "_qdid", "_qtk", "_qpos"))])
    order = np.argsort(mine)
    mine, a = mine[order], _columns(lines, "a")[0][order]
    end = _follows(mine)
    at, span = np.searchsorted(mine, other), _columns(asked, "_span")[0]
    seen = [a[i : min(i + s, end[i])].tobytes() for i, s in zip(at, span, strict=True)] if len(mine) else []
    did, tk, pos = _columns(asked, "_did", "_tk", "_pos")
    return _table(_SEGMENT, did=did, tk=tk, pos=pos, seen=seen)


_ARRAY = "a long, b long, did long, tk long, pos int, f int, lcp int"


def _prefixes(lines: pa.Table, segments: pa.Table) -> pa.Table:
    """All common prefixes of a bucket of documents."""
    x = dict(zip(_names(_ARRAY), _columns(lines, *_names(_ARRAY)), strict=True))
    mine, asked = _places([(x["did"], x["tk"], x["pos"]), tuple(_columns(segments, "did", "tk", "pos"))])
    order = np.argsort(mine)
    mine, x = mine[order], {c: v[order] for c, v in x.items()}
    lcp, end = x["lcp"].astype(np.int64), _follows(mine)
    for i, seen in zip(np.searchsorted(mine, asked), segments.column("seen") if len(asked) else [], strict=True):
        theirs = np.frombuffer(seen.as_py(), np.int64)
        own = x["a"][i : min(i + len(theirs), end[i])]
        other = np.flatnonzero(own != theirs[: len(own)])
        lcp[i] = other[0] if len(other) else len(own)
    known = np.maximum.accumulate(np.where(lcp == _LESS, 0, np.arange(len(lcp))))
    x["lcp"] = lcp[known] - (np.arange(len(lcp)) - known) if len(lcp) else lcp
    return _table(_ARRAY, **x)


_FAR = 1 << 40


def _look(places: list[int], gaps: list[int], stack: list[list[int]]) -> list[int]:
    """For each suffix the longest prefix that it shares with an earlier place among
    those that came before in this direction; gaps are prefixes shared with the one
    just before. The stack has what can still be seen: places and prefixes, which
    both grow towards its top."""
    out = []
    for o, l in zip(places, gaps, strict=True):
        if not l:
            stack.clear()
        elif stack and stack[-1][1] > l:
            least = stack.pop()[0]
            while stack and stack[-1][1] > l:
                least = stack.pop()[0]
            if not stack or stack[-1][1] < l:
                stack.append([least, l])
        while stack and stack[-1][0] > o:
            stack.pop()
        out.append(stack[-1][1] if stack else 0)
        stack.append([o, _FAR])
    return out


_VIEW = "pid int, first int, least int, rest int, side int, did long, tk long, pos int, m long"


def _scan(batches: Iterator[pa.RecordBatch], carried: dict | None = None):
    x = _whole(batches, _ARRAY)
    n = len(x["a"])
    left, right, after = carried[int(x["pid"][0])] if carried and n else ([], [], 0)
    extra = [*left, *right]
    did, tk, pos = (np.concatenate([np.array([e[i] for e in extra], np.int64), x[c].astype(np.int64)]) for i, c in enumerate(("did", "tk", "pos")))
    place = np.empty(len(did), np.int64)
    place[np.lexsort((pos, tk, did))] = np.arange(len(did))
    stacks = [[[int(place[i]), int(e[3])] for i, e in enumerate(extra[: len(left)])], [[int(place[len(left) + i]), int(e[3])] for i, e in enumerate(right)]]
    mine, lcp = place[len(extra) :].tolist(), x["lcp"].tolist()
    best = [_look(mine, lcp, stacks[0]), _look(mine[::-1], [after, *lcp[:0:-1]], stacks[1])[::-1]] if n else [[], []]
    back = np.argsort(place)
    return x, np.maximum(*map(np.array, best)) if n else np.zeros(0, np.int64), [[(int(did[back[o]]), int(tk[back[o]]), int(pos[back[o]]), m) for o, m in s] for s in stacks]


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the next partitions can see of this one, to either side."""
    x, _, stacks = _scan(batches)
    if len(x["a"]):
        rows = [(side, *e) for side, s in enumerate(stacks) for e in s]
        side, did, tk, pos, m = zip(*rows, strict=True)
        same = lambda v: [int(v)] * len(rows)
        yield from _table(_VIEW, pid=same(x["pid"][0]), first=same(x["lcp"][0]), least=same(x["lcp"].min()), rest=same(x["lcp"][1:].min(initial=2**31 - 1)), side=side, did=did, tk=tk, pos=pos, m=m).to_batches()


def _joined(views: list) -> dict[int, tuple[list, list, int]]:
    """For each partition: what it sees to the left and to the right, and the prefix
    shared with the first suffix of the next one."""
    parts = [(pid, list(rows)) for pid, rows in itertools.groupby(sorted(views, key=lambda r: (r["pid"], r["side"], r["m"])), key=lambda r: r["pid"])]
    seen: dict[int, list] = {pid: [[], [], 0] for pid, _ in parts}

    def through(stack: list, least: int, rows: list, side: int) -> list:
        out: list = []
        for e in [[*e[:3], min(e[3], least)] for e in stack if least] + [[r["did"], r["tk"], r["pos"], r["m"]] for r in rows if r["side"] == side]:
            while out and out[-1][:3] > e[:3]:
                out.pop()
            if not out or out[-1][3] < e[3]:
                out.append(e)
        return out

    stack: list = []
    for pid, rows in parts:
        seen[pid][0] = stack
        stack = through(stack, rows[0]["least"], rows, 0)
    stack, after = [], 0
    for pid, rows in reversed(parts):
        seen[pid][1], seen[pid][2] = stack, after
        stack = through(stack, min(rows[0]["rest"], after), rows, 1)
        after = rows[0]["first"]
    return {pid: tuple(v) for pid, v in seen.items()}


_RUN = "did long, tk long, pos int, len int"


def repeated_runs(lines: DataFrame) -> DataFrame:
    """`(did, tk, pos, len)`: for each line the longest run that begins there and has
    occurred before, if it has enough words."""
    suffixes = suffix_array(lines)
    n = suffixes.count()
    ordered = _sorted(suffixes, n, "a", "b", "did", "tk", "pos")
    along = Window.orderBy("pid", "side")  # two rows a partition
    firsts = ordered.mapInArrow(_rim, _RIM).select(*_names(_RIM), *[F.lag(c).over(along).alias(f"q{c}") for c in _SEEN]).where("side = 0").drop("pid", "side")
    placed = stable(ordered.mapInArrow(_neighbours, _PLACED).unionByName(firsts.mapInArrow(_firsts, _PLACED)))
    # columns of their own, as a cogroup can't tell apart those that both sides have
    asked = placed.where(F.col("lcp") == _ASK).select(*[F.col(c).alias(f"_{c}") for c in ("did", "tk", "pos", "qdid", "qtk", "qpos", "span")])
    by = lambda df, *c: df.groupBy(_bucket(n, *c))
    segments = by(placed.select("did", "tk", "pos", "a")).cogroup(by(asked, "_qdid", "_qtk")).applyInArrow(_segments, _SEGMENT)
    array = by(placed.select(*_names(_ARRAY))).cogroup(by(segments)).applyInArrow(_prefixes, _ARRAY)
    array = _sorted(stable(array), n, "a", "b", "did", "tk", "pos")
    carried = _joined(array.mapInArrow(_views, _VIEW).collect())  # a common prefix a partition at most

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, longest, _ = _scan(batches, carried)
        use = (x["f"] > 0) & (longest >= x["f"])
        yield from _table(_RUN, did=x["did"][use], tk=x["tk"][use], pos=x["pos"][use], len=longest[use]).to_batches()

    return array.mapInArrow(runs, _RUN)


_GONE = "did long, tk long, gone array<int>, mark array<boolean>"


def _united(rows: pa.Table) -> pa.Table:
    """Sorted lines of the runs of each document of a bucket, and of each line up to the
    last of them whether it is one."""
    did, tk, pos, size = _columns(rows, "did", "tk", "pos", "len")
    order = np.lexsort((pos, tk, did))
    did, tk, pos, end = did[order], tk[order], pos[order].astype(np.int64), (pos + size)[order].astype(np.int64)
    starts = np.flatnonzero(_change(did, tk))
    marks = []
    for a, b in itertools.pairwise([*starts, len(did)]):
        mark = np.zeros(int(end[a:b].max()) + 1, np.int64)
        np.add.at(mark, pos[a:b], 1)
        np.add.at(mark, end[a:b], -1)
        marks.append(np.cumsum(mark) > 0)
    gone = [np.flatnonzero(m).astype(np.int32) for m in marks]
    return pa.table({"did": pa.array(did[starts]), "tk": pa.array(tk[starts]), "gone": pa.array(gone, pa.list_(pa.int32())), "mark": pa.array(marks, pa.list_(pa.bool_()))})


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """All rows and columns of `df`, with later copies of repeated runs taken out
    of the text, and `deleted_lines` (sorted positions from 0)."""
    df = df.drop("deleted_lines")
    text = F.col(f"`{text_col}`")
    did, tk = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63))), F.xxhash64(text)
    lines = _lines(df.where(text.isNotNull()).select(did.alias("did"), tk.alias("tk"), text.alias("text")), min_words)
    runs = stable(repeated_runs(lines))
    marks = runs.groupBy(_bucket(runs.count())).applyInArrow(_united, _GONE)
    d, t, g, m = free_names(df, "did", "tk", "gone", "mark")
    joined = df.join(marks.toDF(d, t, g, m), (did == F.col(d)) & (tk == F.col(t)), "left")
    # the text is split once, as the array that is filtered; places inside a lambda
    # would have it split for each of them. A line is one look at the marks.
    kept = F.filter(F.split(text, "\n"), lambda _, i: ~F.coalesce(F.get(m, i), F.lit(False)))
    clean = F.when(F.col(g).isNull(), text).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns], F.coalesce(g, F.array().cast("array<int>")).alias("deleted_lines"))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gone = F.array_join(F.col("deleted_lines").cast("array<string>"), ",")
    return dedup_lines(docs).select("doc_id", F.size("deleted_lines").cast("long").alias("n_deleted"), gone.alias("deleted"), "text")
