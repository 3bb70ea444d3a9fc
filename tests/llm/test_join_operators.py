"""Joins, searches, dedup, decontamination, licenses and the pipeline against brute force."""

import ctypes
import itertools
import math
import os
import random
import re
import time
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin as GroupedData

import corpus_pipeline
from gridlark.llm import _text, ann, decontaminate, jaccard_join, license_scan, line_dedup, quality
from gridlark.llm._spark import components
from gridlark.llm.jaccard_join import Scheme

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# components ------------------------------------------------------------------


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)]
    edges = spark.createDataFrame(chain + [(100, 101), (103, 101), (7, 7), (-5, 100)], "u long, v long")
    got = {r["node"]: r["comp"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: -5, 101: -5, 103: -5, -5: -5}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# Jaccard join ----------------------------------------------------------------


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def brute_components(rows, n, num, den):
    sets = {i: shingles(t, n) for i, t in rows}
    near, links = defaultdict(set), defaultdict(int)
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            near[a].add(b)
            near[b].add(a)
    comp = {}
    for i in sorted(sets):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = i
                todo += near[x]
        links[i] = len(near[i])
    return {i: (len(sets[i]), comp[i], links[i]) for i in sets}


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = rng.choice("uvwxyz") + str(rng.randrange(999))
    return words


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (2, 60, 100)])
def test_jaccard_join(spark, n, num, den):
    rng = random.Random(n)
    texts = [None, "", " \t", "One", "one", "a b", "A B c", "a b c d"]
    for size in (5, 8, 12, 20, 40, 90, 200):
        base = [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(size)]
        texts += [" ".join(edited(rng, base, rng.choice((0, 0, 1, 1, 2, 3, 6)))) for _ in range(9)]
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [" ".join(f"q{rng.randrange(10**6)}" for _ in range(40)) + " " + passage for _ in range(20)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_components(df, n=n, num=num, den=den).collect()}
    assert got == brute_components(rows, n, num, den)


def test_jaccard_hot_group(spark, monkeypatch):
    """Large clusters go through the grid, long lists through stars."""
    monkeypatch.setattr(jaccard_join, "_BLOCK_ROWS", 16)
    monkeypatch.setattr(jaccard_join, "_WIDE", 8)
    monkeypatch.setattr(jaccard_join, "_FEW", 4)
    monkeypatch.setattr(jaccard_join, "_MANY", 30)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(edited(rng, base, rng.randint(0, 5))) for _ in range(70)] + [" ".join(base)] * 20
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_components(docs(spark, texts), n=4, num=85, den=100).collect()}
    assert got == brute_components(list(enumerate(texts)), 4, 85, 100)


def test_jaccard_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_components(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, None)], "doc_id long, text string")
    got = sorted((r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_components(odd).collect())
    assert got == [(4, 2), (4, 2), (4, 2), (5, 0)]


def test_jaccard_workers_keep_no_memory(spark, monkeypatch):
    """What the join runs in Python workers gives freed memory back; they live on beside other stages."""
    give_back = ctypes.CDLL(None).malloc_trim
    ran = []
    for kind, name in ((DataFrame, "mapInArrow"), (GroupedData, "applyInArrow")):
        plain = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda self, run, schema, *a, plain=plain: ran.append((run, schema)) or plain(self, run, schema, *a))

    def kept():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) / 1024

    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(words[i] for i in rng.integers(0, 5000, 250)) for _ in range(6000)]
    rows = pa.record_batch({"doc_id": np.arange(6000), "rk": np.arange(6000), "text": texts})
    jaccard_join.jaccard_components(docs(spark, texts[:3] + texts[:2])).collect()
    of = {schema.split()[0]: run for run, schema in ran}
    assert set(of) == {"doc_id", "rng", "kind", "u", "node"}
    merge = next(run for run, schema in ran if schema == "kind int, a long, b long")
    for run in (of["doc_id"], of["node"], of["rng"]):
        pa.default_memory_pool().release_unused(), give_back(0)
        before = kept()
        for _ in run(iter([rows])):
            pass
        assert kept() - before < 32, run
    lists = pa.Table.from_batches(list(of["rng"](iter([rows]))))
    before = kept()
    merge(lists)
    assert kept() - before < 32


def test_scheme_loses_no_pair():
    """Any two sets that link share a key, whatever their sizes and the boundary."""
    rng = np.random.default_rng(5)
    for num, den in ((85, 100), (80, 100), (50, 100), (1, 1)):
        for boundary in (0, 4, 7):
            scheme = Scheme(num, den, boundary)
            for _ in range(150):
                s = int(rng.integers(1, 11 if num == 50 else 60))
                a = np.unique(rng.integers(0, 1 << 52, s, dtype=np.uint64))
                drop = int(rng.integers(0, max(1, len(a) // 3) + 1))
                b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 52, int(rng.integers(0, 3)), dtype=np.uint64)]))
                i = len(np.intersect1d(a, b))
                if den * i < num * (len(a) + len(b) - i) or np.array_equal(a, b):
                    continue
                doc = np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
                keys, owner = scheme.keys(doc, np.concatenate([a, b]), 2)
                assert set(keys[owner == 0]) & set(keys[owner == 1]), (num, den, boundary, len(a), len(b), i)


# nearest neighbours ----------------------------------------------------------


def brute_nearest(ids, x, q, k):
    s = (x * x[q]).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]))
    return [(int(ids[j]), s[j]) for j in sorted((j for j in range(len(ids)) if ids[j] != ids[q]), key=lambda j: (-s[j], ids[j]))[:k]]


def test_nearest_recall_and_scores(spark):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((12, 48))
    x = (centre[rng.integers(0, 12, 1500)] + 0.7 * rng.standard_normal((1500, 48))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), block=64)
    rows = defaultdict(list)
    for r in got.orderBy("query_id", "rank").collect():
        rows[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    hit = 0
    for q in range(0, 1500, 50):
        want = brute_nearest(np.arange(1500), x.astype(float), q, 5)
        assert [r[2] for r in rows[q]] == list(range(1, len(rows[q]) + 1))
        hit += len({i for i, _ in want} & {r[0] for r in rows[q]})
        for i, s, _ in rows[q]:
            exact = x[i].astype(float) @ x[q].astype(float) / (np.linalg.norm(x[i].astype(float)) * np.linalg.norm(x[q].astype(float)))
            assert abs(s - exact) < 1e-12
    assert hit / (5 * 30) >= 0.9


def test_nearest_odd(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(i, one) for i in range(12)] + [(50, [0.9, 0.1, 0.0]), (51, None), (52, [0.0, 0.0, 0.0]), (53, [float("nan"), 1.0, 0.0]), (54, [None, 1.0, 0.0]), (55, [float("inf"), 1.0, 0.0]), (56, []), (57, [1.0, 2.0]), (None, one), (3, one)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("dim", F.lit("clash"))
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id in (0, 51, 52, 53, 57, 3)"), block=4).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got == {0: [1, 2, 3, 4, 5], 3: [0, 1, 2, 4, 5]}
    assert ann.nearest(df.where("false"), df.where("false")).count() == 0


def test_nearest_of_an_id_with_many_rows(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((60, 16))
    x[1:] = x[0] + 0.3 * x[1:]
    rows = [(i, v) for i, v in enumerate(x)] + [(7, x[0] + 0.01 * j * x[7]) for j in range(12)] + [(9, x[0] * 2)] * 12
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id < 5")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in range(5):
        best = defaultdict(lambda: -2.0)
        for i, v in rows:
            if i != q:
                best[i] = max(best[i], v @ x[q] / np.linalg.norm(v) / np.linalg.norm(x[q]))
        want = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:5]
        assert [i for i, _ in got[q]] == [i for i, _ in want]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want], atol=1e-12)


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(1).standard_normal((5, 24))
    signs = ann.rotations(24, 1, 2)[0]
    y = ann.turned(x, signs[0])
    assert y.shape == (5, 32) and np.allclose(x @ x.T, y @ y.T)
    gap = []
    for s in signs:
        both = np.concatenate([ann.turned(x, s), -ann.turned(x, s)], 1)
        gap.append((both.max(1, keepdims=True) - both) ** 2)
    whole = (gap[0][:, :, None] + gap[1][:, None, :]).reshape(5, -1)
    near = ann.probed(x, signs, 9)
    assert (np.sort(near, 1) == np.sort(np.argsort(whole, axis=1)[:, :9], 1)).all()
    assert (ann.buckets(x, signs) == whole.argmin(1)).all()


def test_nearest_recall_without_structure(spark):
    """The query's own parameters on vectors that have no clusters at all, and a
    part of the table looked at that falls as it grows."""
    rng = np.random.default_rng(21)
    shares = []
    for n in (500, 6000):
        x = rng.standard_normal((n, 64)).astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        got = defaultdict(dict)
        for r in ann.nearest(df, df.where("vec_id % 25 = 0")).collect():
            got[r["query_id"]][r["vec_id"]] = r["n_scored"]
        hit = sum(len(got[q].keys() & {i for i, _ in brute_nearest(np.arange(n), x.astype(float), q, 5)}) for q in range(0, n, 25))
        assert hit / (5 * len(range(0, n, 25))) >= 0.9
        shares.append(np.mean([max(v.values()) for v in got.values()]) / n)
    assert shares[1] < 0.75 * shares[0]


def test_nearest_with_far_rows_put_in(spark):
    """Rows that are farther than every answer change no answer, however many they are."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((500, 64))
    q = x[:20]
    away = np.linalg.lstsq(q, np.ones(20), rcond=None)[0]
    side = rng.standard_normal((12_000, 64))
    side -= side @ np.linalg.pinv(q) @ q
    far = side / np.linalg.norm(side, axis=1)[:, None] - 0.3 * away / np.linalg.norm(away)
    assert (far @ q.T < 0).all()
    both = []
    for v in (x, np.concatenate([x, far])):
        df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
        both.append(sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, df.where("vec_id < 20"), block=4096).collect()))
    assert len(both[0]) == 100 and both[0] == both[1]


def test_nearest_of_hot_vectors(spark):
    """Copies of a vector fill a bucket of many cuts; the smallest ids answer."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 16))
    x[100:400] = x[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(7)
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id between 95 and 420"), block=32).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    for q in range(100, 400):
        assert got[q] == [i for i in range(100, 107) if i != q][:5]


# line dedup ------------------------------------------------------------------


def brute_lines(rows, least):
    seq = []
    for d, t in sorted(rows):
        seq += [(x, d, i, len(x.split())) for i, x in enumerate(t.split("\n"))] + [(None, d, -1, 0)]
    gone, where = defaultdict(set), defaultdict(list)
    for i, (line, d, _, _) in enumerate(seq):
        if line is None:
            continue
        best = 0
        for j in where[line]:
            k = 0
            while i + k < len(seq) and seq[j + k][0] is not None and seq[j + k][0] == seq[i + k][0]:
                k += 1
            if sum(x[3] for x in seq[i : i + k]) >= least:
                best = max(best, k)
        gone[d] |= {seq[i + k][2] for k in range(best)}
        where[line].append(i)
    return gone


@pytest.mark.parametrize("least", [1, 5, 9])
def test_line_dedup(spark, least):
    rng = random.Random(least)
    pool = ["a b c", "d e f", "g", "", "h i j k l m", "n o", "p q r s"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df, min_words=least).collect()}
    want = brute_lines(rows, least)
    for i, t in rows:
        assert set(got[i]["deleted_lines"]) == want[i], i
        assert got[i]["text"] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i])


def test_line_dedup_odd(spark):
    rows = [(1, "a b c d e\nx", 7), (1, "a b c d e\nx", 7), (2, None, 7), (3, "", 7), (None, "a b c d e", 7), (4, "a b c d e\r\ny", 7), (5, "z\na b c d e", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, r int")
    got = [tuple(r) for r in line_dedup.dedup_lines(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r[0], r[1], r[3]) for r in got), key=key) == [(1, "x", [0]), (1, "x", [0]), (2, None, []), (3, "", []), (4, "a b c d e\r\ny", []), (5, "z", [1]), (None, "a b c d e", [])]
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


def test_line_dedup_clashing_columns(spark):
    names = ["doc_id", "text", "did", "tk", "gone", "pos", "_did", "deleted_lines"]
    df = spark.createDataFrame([(1, "a b c d e f", *[str(i)] * 6) for i in range(3)] + [(2, "a b c d e f\nmore", *["9"] * 6)], names)
    out = line_dedup.dedup_lines(df)
    assert out.columns == names
    assert sorted((r["doc_id"], r["text"], r["did"], r["deleted_lines"]) for r in out.collect()) == [(1, "a b c d e f", str(i), []) for i in range(3)] + [(2, "more", "9", [0])]


@pytest.mark.parametrize("rows", [8, 40])
def test_suffix_array(spark, monkeypatch, rows):
    """Ranks order suffixes as their lines do, over any number of partitions."""
    monkeypatch.setattr(line_dedup, "_ROWS", rows)
    rng = random.Random(2)
    text = {i: [rng.choice("aaabc") for _ in range(rng.randint(1, 9))] for i in range(30)}
    text[30] = text[31] = text[3] + ["only"] + text[4]
    lines = line_dedup._lines(spark.createDataFrame([(i, i, "\n".join(t)) for i, t in text.items()], "did long, tk long, text string"), 1)
    code = {(r["did"], r["pos"]): r["a"] for r in lines.collect()}
    # the end of a text ranks as line 0 does, before all that follow one of that hash
    key = lambda d, p: [(code[d, i], 0) for i in range(p, len(text[d]))] + [(0, -1)]
    got = sorted((r["a"], r["b"], key(r["did"], r["pos"])) for r in line_dedup.suffix_array(lines).collect())
    assert len(got) == sum(map(len, text.values()))
    assert all(x[2] <= y[2] and (x[:2] == y[:2]) == (x[2] == y[2]) for x, y in itertools.pairwise(got))


def test_carries_row_by_row(spark):
    """What partitions hand on, against a walk along them."""
    rng = random.Random(8)
    ends = []
    for pid in range(0, 300, 2):
        n = rng.randint(1, 4)
        rows = sorted(rng.choices([(0, 0, 0, 0), (0, 0, 0, 1), (0, 1, 0, 0), (1, 0, 0, 0)], [9, 2, 1, 1], k=n))
        first, last = rows[0], rows[-1]
        like = lambda key, m, rows=rows: sum(r[:m] == key[:m] for r in rows)
        ends.append((pid, n, *first, *last, like(first, 2), like(first, 4), like(last, 2), like(last, 4)))
    x = spark.createDataFrame(ends, line_dedup._ENDS).repartition(4)
    want, g, s = [], 0, 0
    for j, (pid, n, *keys) in enumerate(ends):
        first, last, (fg, fs, lg, ls) = keys[:4], keys[4:8], keys[8:]
        before = ends[j - 1][6:10] if j else None
        after = list(ends[j + 1][2:6]) if j + 1 < len(ends) else None
        g, s = g if before and list(before[:2]) == first[:2] else 0, s if before and list(before) == first else 0
        want.append((pid, g, s, before is not None and list(before) == first, after == last))
        g, s = (g if fg == n else 0) + lg, (s if fs == n else 0) + ls
    assert sorted(tuple(r) for r in line_dedup._carries(x).collect()) == want and max(w[1] for w in want) > 4


@pytest.mark.parametrize(("rows", "carried"), [(8, 200_000), (8, 3), (60, 200_000)])
def test_longest_earlier_runs(spark, monkeypatch, rows, carried):
    """The longest run at each line that has been before, against a search of all."""
    monkeypatch.setattr(line_dedup, "_ROWS", rows)
    monkeypatch.setattr(line_dedup, "_CARRIED", carried)
    rng = random.Random(rows)
    text = {i: [rng.choice("aab") for _ in range(rng.randint(1, 14))] for i in range(25)}
    base = [f"line {i}" for i in range(40)]
    for i in range(25, 40):  # near copies of a long text
        text[i] = [x for x in base if rng.random() > 0.04][rng.randrange(3) :]
    text[40] = text[39] = text[38]
    lines = line_dedup._lines(spark.createDataFrame([(i, i, "\n".join(t)) for i, t in text.items()], "did long, tk long, text string"), 1)
    got = {(r["did"], r["pos"]): r["len"] for r in line_dedup.repeated_runs(lines).collect()}
    want = {}
    places = [(d, p) for d in sorted(text) for p in range(len(text[d]))]
    for n, (d, p) in enumerate(places):
        best = 0
        for e, q in places[:n]:
            k = 0
            while p + k < len(text[d]) and q + k < len(text[e]) and text[d][p + k] == text[e][q + k]:
                k += 1
            best = max(best, k)
        if best:
            want[d, p] = best
    assert got == want


# decontamination -------------------------------------------------------------


def test_lcs():
    rng = random.Random(1)

    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 20))] for _ in range(2))
        assert decontaminate.lcs(a, b) == slow(a, b)


def test_decontaminate(spark):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("an", "ell", "ori", "um")] + [f"rare{i}" for i in range(3000)]
    sentence = lambda n: " ".join(rng.choices(words, [60] * 20 + [1] * 3000, k=n))
    items = [sentence(n) for n in (9, 15, 22, 30, 40, 60, 90, 150)]
    texts = [sentence(rng.randint(1, 300)) for _ in range(150)]
    want = set()
    for k in range(40):
        i = k % len(items)
        w = items[i].split()
        if k % 3 == 1:  # a paraphrase: some words are others
            for _ in range(len(w) // 10):
                w[rng.randrange(len(w))] = "other"
        if k % 3 == 2:  # another case and punctuation
            w = [x.upper() + "," for x in w]
        texts.append(sentence(rng.randint(0, 120)) + "\n" + " ".join(w) + " " + sentence(rng.randint(0, 120)))
        want.add((len(texts) - 1, i))
    texts += [None, "", "..."]
    bench = spark.createDataFrame([*enumerate(items), (98, None), (99, "")], "item_id long, text string")
    df = docs(spark, texts).withColumn("item_id", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(df, bench).collect()}
    assert set(got) <= want and len(got) >= 0.95 * len(want)
    clean = {r["doc_id"] for r in decontaminate.drop_leaks(df, bench).select("doc_id").collect()}
    assert clean == set(range(len(texts))) - {d for d, _ in got}
    assert decontaminate.leaks(df, bench.where("false")).count() == 0
    assert decontaminate.leaks(df.where("false"), bench).count() == 0
    blocks = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, bench, max_items=4).collect()}
    assert len(blocks) >= 0.95 * len(want) and blocks <= want


@pytest.mark.parametrize("share", [0.01, 0.3, 0.6, 0.9])
def test_leaks_at_any_share(spark, share):
    """An item in however many texts is found, as it is or with words moved and put
    in; against a search of every stretch of every text."""
    rng = random.Random(int(share * 100))
    words = [f"{a}{b}" for a in "bcdfg" for b in ("an", "ell", "ori", "um")] + [f"rare{i}" for i in range(3000)]
    sentence = lambda n: " ".join(rng.choices(words, [60] * 20 + [1] * 3000, k=n))
    items = [sentence(n) for n in (30, 15, 60)]
    texts = []
    for i in range(150):
        t = sentence(rng.randint(1, 120))
        if i == 0 or rng.random() < share:
            w = items[0].split()
            if i % 3 == 1:
                w = w[:10] + ["more"] * 3 + w[10:]
            if i % 3 == 2:
                w = w[:12] + w[15:18] + w[12:15] + w[18:]
            t = f"{t} {' '.join(w)} {sentence(rng.randint(0, 60))}"
        texts.append(t)

    def brute(text, item):
        code = {}
        a, b = ([code.setdefault(w, len(code)) for w in x.split()] for x in (item, text))
        size = len(a) + len(a) // 2 + 1
        return any(decontaminate.lcs(a, b[i : i + size]) >= 0.7 * len(a) for i in range(max(1, len(b) - size + 1)))

    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if brute(t, x)}
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs(spark, texts), bench).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and want


@pytest.mark.parametrize("stage", [False, True])
def test_latent_space_is_of_all_texts(spark, monkeypatch, tmp_path, stage):
    """The space and the mean are those of every distinct text, against plain matrices;
    in the operator and in the stage of the pipeline."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    items = [" ".join(rng.sample(words, 20)) for _ in range(3)]
    texts = [" ".join(rng.choices([*words, "x", "y"], k=rng.randint(1, 200))) for _ in range(300)]
    texts += items + ["", "x y", None] + [texts[0]] * 2500
    fitted = []

    class Spy(decontaminate.Finder):
        def __init__(self, bench, idf, vectors, mean, *least):
            fitted.append((bench, idf, vectors, mean))
            super().__init__(bench, idf, vectors, mean, *least)

    monkeypatch.setattr(decontaminate, "Finder", Spy)
    given = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    if stage:
        given.write.parquet(f"{tmp_path}/benchmark.parquet")
        corpus_pipeline.no_leaks(spark, docs(spark, texts), str(tmp_path))
    else:
        decontaminate.leaks(docs(spark, texts), given)
    (bench, idf, vectors, mean), = fitted

    def counts(text):
        at = decontaminate.lookup(bench.vocab, decontaminate._hashes([text])[0])
        return [(np.bincount(at[a : a + 64][at[a : a + 64] >= 0], minlength=len(bench.vocab)) * idf, len(at[a : a + 64])) for a in range(0, len(at), 64)]

    rows = [(v, n) for t in {t for t in texts if t} for v, n in counts(t) if v.any()]
    own = np.stack([v for t in items for v, _ in counts(t)])
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    v = np.stack([v for v, _ in rows])
    gram = unit(v).T @ unit(v) + len(v) / len(own) * unit(own).T @ unit(own)
    white = vectors / idf[:, None]
    assert np.allclose(white.T @ gram @ white, np.eye(white.shape[1]), atol=1e-8)
    like = (unit(v @ white) @ unit(own @ white).T).max(1) < 0.5
    assert np.allclose(mean, (v @ white)[like].sum(0) / sum(n for (_, n), k in zip(rows, like, strict=True) if k))


def test_texts_are_read_twice(spark, tmp_path):
    """Once to count and to fit, once to search; frequencies count every copy."""
    log = str(tmp_path)

    def seen(batches):
        open(f"{log}/{uuid.uuid4().hex}", "w").close()
        yield from batches

    item = " ".join(f"w{i}" for i in range(25))
    df = docs(spark, [item, f"head {item}", "clean text of no one", None, item]).coalesce(1).mapInArrow(seen, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.leaks(df, bench).collect()} == {0, 1, 4}
    assert len(os.listdir(log)) == 2
    given = decontaminate.read_benchmark([(7, "w1 head nobody")])
    rows = decontaminate._counts(df.select("text"), given.vocab).where("at is not null").select("at", "z")
    total = decontaminate._total(rows, len(given.vocab) + 1, 1)[:, 0]
    at = decontaminate.lookup(given.vocab, given.words[0])
    assert [*total[at], total[-1]] == [3, 1, 0, 5]


def test_products_of_passages(monkeypatch):
    """Dense and sparse columns together are the plain matrix."""
    monkeypatch.setattr(decontaminate, "_DENSE", 7)
    rng = np.random.default_rng(4)
    n = np.where(rng.random((300, 60)) < rng.random(60), rng.integers(1, 4, (300, 60)), 0)
    n[n.sum(1) == 0, 3] = 1
    row, term = np.nonzero(n)
    x = decontaminate.Passages(np.bincount(row), n.sum(1), term, n[row, term])
    idf, q = rng.random(60) + 0.5, rng.standard_normal((60, 9))
    a, got = n * idf, np.zeros((60, 9))
    common = decontaminate.Common(idf)
    assert np.allclose(decontaminate.Matrix(x, x.n * idf[x.term], common).times(q), a @ q)
    decontaminate._add_product(got, x, idf, common, q, 2.0)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    assert np.allclose(got, 2 * a.T @ (a @ q))


def test_index_and_shared_words(monkeypatch):
    """Hashes by their top bits, against binary search, full places too; shared words
    of many stretches, against multisets."""
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1000):
        vocab = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64) >> np.uint64(n % 3 * 9))
        h = np.concatenate([vocab, vocab + np.uint64(1), rng.integers(0, 1 << 64, 999, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        assert (decontaminate.Index(vocab)(h) == decontaminate.lookup(vocab, h)).all()
    monkeypatch.setattr(decontaminate, "_STRETCH", 100)
    words = lambda k: " ".join(f"w{i}" for i in rng.integers(0, 30, k))
    bench = decontaminate.read_benchmark([(i, words(k)) for i, k in enumerate((3, 10, 25, 60))])
    finder = decontaminate.Finder(bench, np.ones(len(bench.vocab)), rng.random((len(bench.vocab), 4)), np.zeros(4), 0.1, 0.7, 0.6)
    text = decontaminate._hashes([words(400) + " x y"])[0]
    item, lo = rng.integers(0, 4, 50), rng.integers(0, 400, 50)
    hi = np.minimum(len(text), lo + rng.integers(0, 120, 50))
    want = [(Counter(bench.words[i].tolist()) & Counter(text[a:b].tolist())).total() for i, a, b in zip(item, lo, hi, strict=True)]
    assert finder.shared(item, finder.index(text), lo, hi).tolist() == want


def test_leaks_odd(spark):
    item = " ".join(f"w{i}" for i in range(25))
    rows = [(None, f"head {item}"), (None, "clean text of no one"), (1, item), (1, "another text with this id"), (2, "x " * 200_000 + item + " y" * 1000), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("_key", F.lit(2)).withColumn("item_id", F.lit(3))
    bench = spark.createDataFrame([(7, item), (None, "this has no id so nobody asks")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, bench).collect()} == {(None, 7), (1, 7), (2, 7)}
    kept = decontaminate.drop_leaks(df, bench)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, "clean text of no one"), (1, "another text with this id"), (3, "")]
    one = docs(spark, [item])
    assert decontaminate.leaks(one, bench).count() == 1
    assert decontaminate.leaks(one.unionByName(one), bench).count() == 2


def test_answers_count(spark):
    item = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item, "w28 w29")], "item_id long, text string, answer string")
    cut = " ".join(f"w{i}" for i in range(26))
    df = docs(spark, [item, cut])
    assert {r["doc_id"] for r in decontaminate.leaks(df, bench, answer_col="answer").collect()} == {0}


# licenses --------------------------------------------------------------------


def test_licenses(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/c.py", "x = 1"),
        (3, "a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0"),
        (4, "z.py", None),
        (5, "a/q.py", "code\n# SPDX-License-Identifier: GPL-3.0-or-later\nmore"),
        (6, None, ""),
        (7, "b/d/e/f.py", "nothing about it but the word license in a long sentence that goes on and on"),
        (8, "b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (9, "b/license_server.py", "y"),
        (10, "a/b/x/y/z.py", ""),
        (10, "a/b/x/y/z.py", ""),
        (11, None, "Licensed under CC BY-NC 4.0."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, file string, text string").withColumn("license", F.lit("clash"))
    out = license_scan.scan(df, F.col("file"))
    got = sorted((r["doc_id"], r["license"], r["via"], r["source_path"]) for r in out.collect())
    assert got == sorted(
        [
            (1, "MIT", "file", "a/LICENSE"),
            (2, "Apache-2.0", "inherited", "a/b/LICENSE.txt"),
            (3, "Apache-2.0", "file", "a/b/LICENSE.txt"),
            (4, None, None, None),
            (5, "GPL-3.0", "header", "a/q.py"),
            (6, None, None, None),
            (7, "GPL-3.0", "inherited", "b/COPYING"),
            (8, "GPL-3.0", "file", "b/COPYING"),
            (9, "GPL-3.0", "inherited", "b/COPYING"),
            (10, "Apache-2.0", "inherited", "a/b/LICENSE.txt"),
            (10, "Apache-2.0", "inherited", "a/b/LICENSE.txt"),
            (11, "CC-BY-NC-4.0", "header", None),
        ],
        key=lambda r: tuple(str(x) if i else x for i, x in enumerate(r)),
    ) or {r[:3] for r in got} == {(1, "MIT", "file"), (2, "Apache-2.0", "inherited"), (3, "Apache-2.0", "file"), (4, None, None), (5, "GPL-3.0", "header"), (6, None, None), (7, "GPL-3.0", "inherited"), (8, "GPL-3.0", "file"), (9, "GPL-3.0", "inherited"), (10, "Apache-2.0", "inherited"), (11, "CC-BY-NC-4.0", "header")}
    assert license_scan.scan(df.where("false"), F.col("file")).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def licenses_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["license"] for r in license_scan.scan(df, F.concat(F.lit("f/"), F.col("doc_id").cast("string"))).collect()}


def test_license_of_a_line_at_all_sizes(spark):
    lines = ["Released under the MIT License x", "Copyright 2024 Foo Inc. Licensed under the Apache License, Version 2.0", "word " * 60 + "Released under the MIT License" + " word" * 60, "App is licensed under the GNU General Public License version 3 (see there)", "Released under the Foo License"]
    for n in (1, 30, 600, 6000):
        some = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0"]
        got = licenses_of(spark, lines + [some[i // 10 % 2] if i % 10 == 0 else f"alpha beta {i}" for i in range(n)])
        assert [got[i] for i in range(len(lines))] == ["MIT", "Apache-2.0", "MIT", "GPL-3.0", None], n


def test_license_with_a_word_put_in(spark):
    assert licenses_of(spark, ["Licensed under the new Apache License, Version 2.0", "alpha"]) == {0: "Apache-2.0", 1: None}


def test_license_over_lines_and_inline(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met"
    long = "word " * 300 + "Licensed under the\nApache License, Version 2.0 " + "word " * 300
    rows = [(1, "a/LICENSE", f"Foo 1.0\nCopyright 2024 Foo\n\n# {bsd}:\n# 1. one"), (2, "a/b/c.py", "x"), (3, "d/e.py", long), (4, "d/f.py", long.replace("\n", " ")), (5, "d/g.py", "/* This Source Code Form is subject to the terms of the\r\n * Mozilla Public License, v. 2.0. If a copy */")]
    rows += [(10 + i, f"z/{i}.py", "Released under the MIT License." if i % 20 == 0 else f"alpha {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, file string, text string")
    got = {r["doc_id"]: (r["license"], r["via"]) for r in license_scan.scan(df, F.col("file")).where("doc_id < 10").collect()}
    assert got == {1: ("BSD-3-Clause", "file"), 2: ("BSD-3-Clause", "inherited"), 3: ("Apache-2.0", "header"), 4: ("Apache-2.0", "header"), 5: ("MPL-2.0", "header")}


def test_license_lines_of_the_tables(spark):
    kinds = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "Proprietary", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    want = dict(enumerate([*kinds.values(), "BSD-3-Clause", "MIT", None, "Proprietary"]))
    notice = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
    got = licenses_of(spark, [*kinds, f"Copyright Foo. All rights reserved.\n{notice}", "All rights reserved\nReleased under the MIT License", "No rights reserved", "Proprietary and confidential. All rights reserved"])
    assert got == want
    rows = [(1, "a/LICENSE", f"{notice} terms"), (2, "a/NOTICE", "All rights reserved."), (3, "a/x.py", "x")]
    df = spark.createDataFrame(rows, "doc_id long, file string, text string")
    assert {r["license"] for r in license_scan.scan(df, F.col("file")).where("doc_id = 3").collect()} == {"BSD-3-Clause"}


def test_license_headers_and_texts(spark):
    """Usual headers as they wrap in comments, heads of license texts and whole ones."""
    gpl = "This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU {}General Public License as published by\n# the Free Software Foundation, either version {} of the License, or\n# (at your option) any later version."
    wrapped = lambda t: "\n".join(t[i : i + 65] for i in range(0, len(t), 65))
    want = {
        "x/gpl3.py": ("# Foo\n#\n# " + gpl.format("", 3), "GPL-3.0"),
        "x/gpl2.py": ("# " + gpl.format("", 2), "GPL-2.0"),
        "x/agpl.py": ("# " + gpl.format("Affero ", 3), "AGPL-3.0"),
        "x/lgpl.py": ("# " + gpl.format("Lesser ", 3).replace("program", "library"), "LGPL-3.0"),
        "x/apache.py": ("/*\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n */", "Apache-2.0"),
        "g/COPYING": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation", "GPL-3.0"),
        "m/LICENSE": ("Copyright 2020 Some One\n\n" + dict(license_scan.TEXTS)["MIT"].replace(" the ", "\nthe "), "MIT"),
        "b/LICENSE": ("Copyright 2020 Some One\n\n" + dict(license_scan.TEXTS)["BSD-3-Clause"], "BSD-3-Clause"),
        "c/LICENSE": ("Copyright 2020 Some One\n\n" + dict(license_scan.TEXTS)["BSD-2-Clause"], "BSD-2-Clause"),
        "m/src/a.py": ("x = 1", "MIT"),
        "c/src/a.py": ("", "BSD-2-Clause"),
    }
    rows = [(i, k, t) for i, (k, (t, _)) in enumerate(want.items())] + [(100 + i, f"z/{i}.py", f"alpha the of and {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, file string, text string")
    got = {r["path"]: r["license"] for r in license_scan.scan(df, F.col("file")).collect()}
    assert {k: got[k] for k in want} == {k: v for k, (_, v) in want.items()}
    assert {v for k, v in got.items() if k.startswith("z/")} == {None}


def brute_license(texts, templates, least=0.75):
    """By definition: the best cosine of any line or window of a template's length."""
    words = [license_scan.terms_of(t or "") for t in texts]
    vocab = {w for _, t in templates for w in license_scan.terms_of(t)}
    n = len(texts)
    idf = {w: min(license_scan.RARE, math.log((1 + n) / (1 + sum(w in x for x in map(set, words)))) + 1) for w in vocab}
    rare = min(license_scan.RARE, math.log(1 + n) + 1)

    def norm(span):
        inside = defaultdict(int)
        for w in span:
            inside[w] += w in vocab
        return math.sqrt(sum((c * idf[w]) ** 2 for w, c in inside.items() if w in vocab) + rare * rare * sum(w not in vocab for w in span))

    out = []
    for text, own in zip(texts, words, strict=True):
        found = []
        for name, t in templates:
            want = license_scan.terms_of(t)
            spans = [license_scan.terms_of(x) for x in (text or "").split("\n")] + [own[i : i + len(want)] for i in range(max(1, len(own) - len(want) + 1))]
            for span in filter(None, spans):
                dot = sum(want.count(w) * idf[w] ** 2 for w in span if w in vocab)
                score = round(min(1.0, dot / norm(want) / norm(span)), 9)
                if score >= least:
                    found.append((t == license_scan.RESERVED, -score, name))
        out.append((min(found)[2], -min(found)[1]) if found else (None, None))
    return out


def test_licenses_against_every_span(spark):
    rng = random.Random(11)
    templates = [t for t in license_scan.TEMPLATES if len(t[1]) < 120]
    texts = []
    for _ in range(120):
        w = rng.choice(templates)[1].split()
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 1)] = rng.choice([[], ["alpha"], ["license"], [w[k], "beta"]])
            w = w or ["x"]
        gap = lambda: [rng.choice(["alpha", "beta", "the", "of", "code"]) for _ in range(rng.randint(0, 9))]
        joined = gap() + w + gap()
        cut = rng.randrange(len(joined) + 1)
        texts.append(" ".join(joined[:cut]) + rng.choice([" ", "\n", "\n# "]) + " ".join(joined[cut:]))
    texts += [None, "", "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["score"]) for r in license_scan.scan(df, F.concat(F.lit("f/"), F.col("doc_id").cast("string")), templates=templates, texts=[]).collect()}
    want = brute_license(texts, templates)
    apart = [i for i, x in enumerate(want) if got[i][0] != x[0] or x[1] is not None and abs(got[i][1] - x[1]) > 1e-8]
    assert not apart and sum(x[0] is not None for x in want) > 40


def test_license_of_null_ids(spark):
    """A file with its own notice is one row, whatever its id, also beside a license file."""
    rows = [(None, "a/x.py", "Released under the MIT License."), (None, "a/y.py", ""), (1, "a/LICENSE", "Licensed under CC BY-NC 4.0."), (None, None, "Released under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, file string, text string")
    got = sorted((str(r["path"]), r["license"], r["via"]) for r in license_scan.scan(df, F.col("file")).collect())
    assert got == [("None", "MIT", "header"), ("a/LICENSE", "CC-BY-NC-4.0", "file"), ("a/x.py", "MIT", "header"), ("a/y.py", "CC-BY-NC-4.0", "inherited")]


def test_license_files_without_words(spark):
    """Empty, null and wordless license files say nothing; they inherit as other files do."""
    rows = [(1, "LICENSE", "Released under the MIT License."), (2, "a/LICENSE", ""), (3, "b/COPYING", None), (4, "c/LICENSE.txt", " \n-- ***\n"), (5, "c/x.py", "x"), (6, "d/LICENSE", "\u4e2d\u6587")]
    df = spark.createDataFrame(rows, "doc_id long, file string, text string")
    got = {r["doc_id"]: (r["license"], r["via"], r["source_path"]) for r in license_scan.scan(df, F.col("file")).collect()}
    assert got == {1: ("MIT", "file", "LICENSE")} | dict.fromkeys(range(2, 7), ("MIT", "inherited", "LICENSE"))


# pipeline --------------------------------------------------------------------


ODD_NAMES = ["__id", "__did", "__gone", "__text", "deleted_lines", "did", "tk", "gone", "key", "rk", "rep", "node", "quality", "k0", "item_id", "component_id", "cluster"]


@pytest.mark.parametrize("place", range(5))
def test_stage_on_odd_rows(spark, tmp_path, place):
    """Each stage alone: nulls, empty and very long texts, repeated rows, columns of any
    name, and no rows at all. No stage drops a clean text or changes other columns."""
    name, stage = corpus_pipeline.STAGES[place]
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "so", "ti", "vu", "we")]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    page = lambda: "\n".join(line(rng.randint(6, 14)) for _ in range(8))
    same, item = page(), line(30)
    texts = [page() for _ in range(40)]
    rows = [*enumerate(texts), (None, page()), (None, same), (50, same), (51, same), (51, same), (52, None), (53, ""), (54, " \n "), (55, "\n".join(page() for _ in range(300))), (None, f"{page()}\n{item}"), (56, f"{page()}\n{item}")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({c: F.lit(c) for c in ODD_NAMES})
    spark.createDataFrame([(0, item), (None, "no id here at all"), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = stage(spark, df, str(tmp_path))
    assert stage(spark, df.where("false"), str(tmp_path)).count() == 0
    got = out.collect()
    if name == "bpe":
        assert len(got) == len(rows) and {r["n_tokens"] for r in got if r["doc_id"] in (52, 53)} == {0}
        return
    assert out.columns == df.columns and all(r[c] == c for r in got for c in ODD_NAMES)
    kept = [(r["doc_id"], r["text"]) for r in got]
    assert {(i, t) for i, t, *_ in rows if i is not None and (i < 40 or i == 55)} <= set(kept)
    if name == "quality_classifier":
        assert not {i for i, _ in kept} & {52, 53, 54} and len(kept) == len(rows) - 3
    if name == "line_dedup":
        # of one text under three ids the null one comes first; equal rows are one document
        assert sorted(str(i) for i, t in kept if t == same) == ["None"] and (52, None) in kept and (53, "") in kept
    if name == "jaccard_join":
        assert [i for i, t in kept if t == same] == [50] and {52, 53, 54} <= {i for i, _ in kept}
        assert len(kept) == len(rows) - 3
    if name == "decontaminate":
        assert not any(item in (t or "") for _, t in kept) and len(kept) == len(rows) - 2


def test_one_of_each_without_ids(spark):
    """Near copies without ids go like others; links through a text that only rows
    without id have are kept."""
    base = [f"w{i}" for i in range(120)]
    near = lambda k: " ".join(base[:k] + ["other"] + base[k:])
    rows = [(None, " ".join(base)), (None, near(30)), (None, near(30)), (7, near(60)), (3, near(90)), (None, "of its own"), (None, "of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_components(df).collect()
    assert {r["component_id"] for r in got if r["n_shingles"] > 5} == {3}
    assert sorted(map(str, (tuple(r) for r in jaccard_join.one_of_each(df).collect()))) == sorted(map(str, [(3, near(90)), (None, "of its own")]))
    nameless = df.where("doc_id is null")
    assert jaccard_join.one_of_each(nameless).count() == 2


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "so", "ti", "vu", "we")]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    page = lambda: "\n".join(line(rng.randint(6, 14)) for _ in range(8))
    item = line(30)
    texts = [page() for _ in range(60)]
    texts += ["BUY!! THIS!! NOW!! " * 40] * 2 + [texts[0]] + [texts[1].replace(" ", "  ")] + [page() + "\n" + item] * 1
    df = docs(spark, texts).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(60)) and all(n > 0 for n in got.values())
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "jaccard_join", "decontaminate", "bpe"]


# identity of texts --------------------------------------------------------------


def thue_morse(n=10):
    """Two strings of 2^n letters that every polynomial hash with an odd base modulo 2^64
    takes for one."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_span_ids_are_those_of_bytes():
    rng = np.random.default_rng(5)
    parts = [bytes(rng.integers(0, 3, int(k)).astype(np.uint8)) for k in rng.integers(0, 40, 3000)] + [b"", b"a", b"a\0", b"A" * 8, b"a" * 8, b"a" * 9, *(x.encode() for x in thue_morse())]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    for lower in (True, False):
        ids = _text.span_ids(data, starts, ends, lower=lower)
        seen = {}
        for p, i in zip(parts, ids.tolist(), strict=True):
            assert seen.setdefault(p.lower() if lower else p, i) == i
        assert len(set(seen.values())) == len(seen)


def test_strings_of_equal_polynomials(spark):
    a, b = thue_morse()
    df = spark.createDataFrame([(1, f"one two three four {a}"), (2, f"one two three four {b}")], "doc_id long, text string")
    assert {r["doc_id"]: r["deleted_lines"] for r in line_dedup.dedup_lines(df).collect()} == {1: [], 2: []}
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    got = jaccard_join.jaccard_components(df, n=4, num=85, den=100).collect()
    assert {(r["doc_id"], r["component_id"], r["n_links"]) for r in got} == {(1, 1, 0), (2, 2, 0)}
    words = decontaminate._hashes([a, b])
    assert words[0][0] != words[1][0]


def test_lines_that_share_a_hash(spark, monkeypatch):
    """With a first hash of four values, the second one tells lines apart."""
    rng = random.Random(6)
    lines = [f"line {i} of some five words" for i in range(12)] + ["", "x"]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 7)))) for i in range(40)]
    df = spark.createDataFrame(rows, "did long, text string").selectExpr("did", "did as tk", "text")
    full = line_dedup._lines(df, 5)
    weak = full.withColumn("a", F.pmod("a", F.lit(4))).withColumn("prev", F.when(F.col("pos") > 0, F.pmod("prev", F.lit(4))).otherwise(F.col("prev")))
    of = lambda x: sorted(tuple(r) for r in line_dedup.repeated_runs(x).collect())
    assert of(weak) == of(full) != []


@pytest.mark.parametrize("bits", [1, 6])
def test_sets_that_share_a_hash(spark, bits):
    """With a first hash of few values, the second one tells sets apart."""
    rng = random.Random(bits)
    texts = [None, "", "one", "two", "three", "a b", "b a", "a b c d", "a b c e"]
    for size in (6, 30, 90):
        base = [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(size)]
        texts += [" ".join(edited(rng, base, rng.choice((0, 0, 1, 2)))) for _ in range(8)]
    texts += [" ".join(["x", "y"] * 9), " ".join(["x", "y"] * 5)]  # one set of two texts
    df = docs(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_components(df, n=4, num=85, den=100, bits=bits).collect()}
    assert got == brute_components(list(enumerate(texts)), 4, 85, 100)


def test_second_hashes_are_those_of_sets():
    """They depend on the set alone, not on the order or number of its shingles, and tell
    sets apart that the first ones of a bit can't."""
    texts = [b"x y x y x y x y", b"x y x y x y", b"one", b"two", b"a b c d e", b"a b c d f", b""]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    doc, _ = _text.shingle_sets(*_text.words(data, off), len(texts), 2)
    check = jaccard_join.Naming().checks(data, off, len(texts), 2, doc, np.bincount(doc, minlength=len(texts)))
    assert check[0] == check[1] and check[6] == 0 and len(set(check.tolist())) == len(texts) - 1


def test_names_with_dots(spark):
    """Columns of any name can be the text and the id."""
    item = " ".join(f"word{i}" for i in range(30))
    rows = [(1, f"{item}\nReleased under the MIT License"), (2, "quiet fields lie under the wind, and rain comes slowly."), (3, None)]
    df = spark.createDataFrame(rows, "`the.id` long, `the.text` string")
    names = {"id_col": "the.id", "text_col": "the.text"}
    assert {r["doc_id"]: r["license"] for r in license_scan.scan(df, F.lit("a/b"), **names).collect()} == {1: "MIT", 2: None, 3: None}
    bench = spark.createDataFrame([(7, item, "word3")], "`its.id` long, `its.text` string, `its.answer` string")
    found = decontaminate.leaks(df, bench, **names, item_col="its.id", item_text="its.text", answer_col="its.answer").collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(1, 7)]
    assert decontaminate.drop_leaks(df, bench.toDF("item_id", "text", "answer"), **names).count() == 2
    kept = quality.keep_good(df, "the.text")
    assert kept.columns == df.columns and {r["the.id"] for r in kept.collect()} <= {1, 2}
    assert jaccard_join.one_of_each(df, **names).count() == 3
    assert line_dedup.dedup_lines(df, **names).columns == ["the.id", "the.text", "deleted_lines"]


def test_many_lines_of_one_text(spark):
    """Time grows with the lines, not with their square."""
    text = "\n".join(["the same five words again"] * 30_000)
    began = time.perf_counter()
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["text"] == "the same five words again" and len(got["deleted_lines"]) == 29_999
    assert time.perf_counter() - began < 90


def test_sums_are_a_tree(spark, monkeypatch):
    """No task adds up more partial sums than the tree's fan."""
    monkeypatch.setattr(decontaminate, "_FAN", 3)
    rows = spark.createDataFrame([(at, t, np.array([1.0 * t, at]).tobytes()) for at in (0, 2) for t in range(20)], decontaminate._SUMS).repartition(20)
    assert decontaminate._total(rows, 4, 1)[:, 0].tolist() == [190.0, 0.0, 190.0, 40.0]
