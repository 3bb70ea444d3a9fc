"""Mixing, alignment of tokenizers and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridlark.llm import align, mixing, resample
from gridlark.llm._spark import copied, running

DOCS = "doc_id long, text string, source string, size int, rank string, `a.b` int"
ODD = [None, "", " \n\t ", "a", "A a. B b!\nA a.", "漢字 ñ 🙂", "x" * 50_000, "a b c d e f " * 400, "<|endoftext|> <s> <0x41> ▁x", "tail  two spaces ﬁ "]


def odd(spark):
    rows = [(i, t, "s", 1, "q", 2) for i, t in enumerate(ODD)] + [(3, "a", None, 1, "q", 2), (3, "a", None, 1, "q", 2), (None, "no id", "t", 1, "q", 2)]
    return spark.createDataFrame(rows, DOCS)


def nothing(spark):
    return spark.createDataFrame([], DOCS)


def some(seed, n, words="the of and to in model data bank river tea cup ñandú 漢字".split()):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(words, k=int(rng.paretovariate(1.1) * 5) % 900)), rng.choice(["b", "a", None, "ü", "b", "b", "b"])) for i in range(n)]


# helpers ---------------------------------------------------------------------


def test_running_sums(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), (F.col("id") % 3).alias("w"), F.lit("k").alias("range"))
    got = running(df, [F.col("x").desc()], "w", 1000, per_range=100).collect()
    want, total = {}, 0
    for r in sorted(got, key=lambda r: -r["x"]):
        want[r["x"]], total = total, total + r["w"]
    assert {r["x"]: r["before"] for r in got} == want and got[0]["range"] == "k"


def test_copied(spark):
    got = copied(spark.createDataFrame([(1, 0), (2, 3), (3, 25)], "a long, n long"), "n", "i", piece=10).collect()
    assert sorted((r["a"], r["i"]) for r in got) == [(2, i) for i in range(3)] + [(3, i) for i in range(25)]


# mixing ----------------------------------------------------------------------


def plain_targets(size, weights, cap, total):
    """The shares in rounds: what is above a limit is shared again."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = {s: total * w[s] / sum(w.values()) for s in names}
    full = set()
    while True:
        over = {s for s in names if s not in full and target[s] > cap * size[s] + 1e-9}
        if not over:
            return target
        spare = sum(target[s] - cap * size[s] for s in over)
        for s in over:
            target[s] = cap * size[s]
        full |= over
        rest = sum(w[s] for s in names if s not in full)
        for s in names:
            if s not in full:
                target[s] += spare * w[s] / rest


@pytest.mark.parametrize("known", [100_000, 1])
def test_mix_reaches_targets(spark, known):
    rows = some(3, 600) + [(i, "w " * 3, "rare" if i % 2 else "rarer") for i in range(600, 606)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(t.split())
    got = mixing.planned(df, weights=(5, 2, 1), known=known).collect()
    want = plain_targets(size, (5, 2, 1), 3, sum(size.values()))
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert math.floor(r["rate"]) <= r["copies"] <= math.ceil(r["rate"]) <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    assert want["rare"] == 3 * size["rare"] == taken["rare"]
    for s in size:
        biggest = max(len(t.split()) for _, t, x in rows if x == s)
        assert abs(taken[s] - want[s]) <= max(0.05 * want[s], biggest)
    again = mixing.planned(df.repartition(7), weights=(5, 2, 1), known=known).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    texts = Counter()
    for r in mixing.mix(df, weights=(5, 2, 1), known=known).collect():
        texts[r["doc_id"]] += 1
    assert texts == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


def test_mix_draws_by_probability(spark):
    """One copy more has the probability of the fraction, over seeds."""
    df = spark.createDataFrame([(i, "w", "a" if i < 40 else "b") for i in range(80)], "doc_id long, text string, source string")
    n = Counter()
    for seed in range(6):
        n.update({r["doc_id"]: r["copies"] for r in mixing.planned(df, weights=(3, 1), seed=seed, tries=1).collect()})
    assert 40 * 6 * 1.5 == pytest.approx(sum(n[i] for i in range(40)), rel=0.15) and len({n[i] for i in range(40)}) > 2


def test_mix_odd(spark):
    assert mixing.planned(nothing(spark)).count() == 0 and mixing.mix(nothing(spark).drop("size")).count() == 0
    got = mixing.planned(odd(spark)).collect()
    assert len(got) == len(ODD) + 3 and {r["size"] for r in got if r["doc_id"] in (0, 1, 2)} == {0}
    assert {r["source"] for r in got} == {"s", None, "t"} and max(r["size"] for r in got) == 2400
    assert len({r["copies"] for r in got if r["doc_id"] == 3 and r["source"] is None}) == 1
    with pytest.raises(ValueError, match="clash"):
        mixing.mix(odd(spark))
    out = mixing.mix(odd(spark).drop("size"))
    assert out.columns == ["doc_id", "text", "source", "rank", "a.b", "copy"]
    with pytest.raises(ValueError):
        mixing.planned(odd(spark), share=4)
    assert {r["target"] for r in mixing.planned(odd(spark).where("doc_id < 3")).collect()} == {0.0}  # no words at all


# alignment -------------------------------------------------------------------


@pytest.fixture(scope="module")
def tools():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def byte_letter():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_align(tools, text):
    """Groups by a walk over both token lists."""
    t, m = tools
    if not text:
        return [], [], []
    letter = byte_letter()
    a, b = t.encode(" " + text, add_special_tokens=False).ids, m.encode(text)
    by_a = [bytes(letter[c] for c in t.id_to_token(i)) for i in a]
    by_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in (m.id_to_piece(i) for i in b)]
    if not b"".join(by_a) == b"".join(by_b) == (" " + text).encode():
        return [], [], []
    groups, x, y, i, j = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if x <= y:
            groups[-1][0].append(a[i])
            x += len(by_a[i])
            i += 1
        else:
            groups[-1][1].append(b[j])
            y += len(by_b[j])
            j += 1
        if x == y:
            groups.append(([], []))
    return a, b, groups[:-1]


@pytest.mark.parametrize("share", [align.SHARE, 40])
def test_alignment_against_walk(spark, tools, share):
    rows = [(i, t) for i, t, _ in some(5, 60, words="unbelievable tokenization don't 1234567 naïve 漢字 🙂 <|endoftext|> a,b;c|d the  of".split(" "))]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(3, rows[3][1])]
    aligned = align.align(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"], make=["n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "pairs", "times"])
    got = align.with_counts(aligned, align.pair_counts(aligned), share)
    want = {i: plain_align(tools, t) for i, t in rows}
    links = {i: [(a[-1], b[-1]) for a, b in g] for i, (_, _, g) in want.items()}
    count = Counter(x for i, _ in rows for x in links[i])
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    seen = []
    for r in got.collect():
        a, b, g = want[r["doc_id"]]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups"]) == (len(a), len(b), len(g), len(g), text)
        assert r["groups_sha256"] == (hashlib.sha256(text.encode()).hexdigest() if text else "")
        own = links[r["doc_id"]]
        assert (r["n_best"], r["count_sum"]) == (sum(count[x] == top[x[1]] for x in own), sum(count[x] for x in own))
        seen.append(r["doc_id"])
    assert sorted(seen) == sorted(i for i, _ in rows)
    assert sum(bool(g) for _, _, g in want.values()) > 40


def test_cuts_of_random_sizes():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 300))
        ends = [np.unique(np.append(rng.integers(1, n + 1, int(rng.integers(0, n + 1))), n)) for _ in range(2)]
        a, b = align.cuts(*(np.diff(e, prepend=0) for e in ends))
        both = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        assert ends[0][a].tolist() == both == ends[1][b].tolist()


def test_alignment_odd(spark):
    for df in (nothing(spark), odd(spark)):
        aligned = align.align(df, keep=["doc_id", "rank", "a.b"], make=["n_a", "groups", "pairs", "times"])
        got = align.with_counts(aligned, align.pair_counts(aligned)).collect()
        assert len(got) == df.count()
        assert all(r["n_a"] == r["count_sum"] == 0 and r["groups"] == "" for r in got if r["doc_id"] in (0, 1))
    with pytest.raises(ValueError, match="clash"):
        align.align(odd(spark).withColumn("n_a", F.lit(1)), keep=["n_a"])


# resampling ------------------------------------------------------------------


def test_crc_of_spans():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    s = np.sort(rng.integers(0, 4000, 300))
    e = s + np.where(rng.random(300) < 0.1, rng.integers(65, 900, 300), rng.integers(1, 65, 300))
    want = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(s, e, strict=True)]
    assert resample.crc(data, s, e).tolist() == want
    again = [zlib.crc32(data[a:b].tobytes(), w) for a, b, w in zip(s, e, want, strict=True)]
    assert resample.crc(data, s, e, np.array(want)).tolist() == again


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def runs(words, low, high):
    return [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def plain_resample(rows, target, share, low, high, buckets, least, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [[bucket(f) for f in runs(tokens(t), low, high)] for _, t in rows]
    s, t = Counter(b for x in own for b in x), Counter(bucket(f) for x in target for f in runs(tokens(x), low, high))
    big, all_ = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big + buckets) / ((s[b] + 1) * (all_ + buckets)))) for b in s}
    out = []
    for (i, text), x in zip(rows, own, strict=True):
        w = sum(gain[b] for b in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(tokens(text)), len(x), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    can = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2], x[3]))
    return out, can[: len(can) * share[0] // share[1]]


@pytest.mark.parametrize(("low", "high", "share"), [(1, 1, (10, 100)), (1, 3, (1, 3)), (2, 2, (1, 1)), (1, 1, (0, 1))])
def test_resample_against_plain(spark, low, high, share):
    rows = [(i, t) for i, t, _ in some(9, 250)] + [(i, "Copies of ONE text x 9 " * 6) for i in [7, None, -(2**62), 2**62]] + [(5, "repeated row " * 12)] * 40
    target = ["the river and the data", "Tea Cup", None, ""]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out, chosen = plain_resample(rows, target, share, low, high, 500, 6, 1)
    got = resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), share, words=(low, high), buckets=500, min_words=6, seed=1)
    fields = ["doc_id", "n_words", "n_features", "weight", "score"]
    rows_ = got.collect()
    assert sorted(map(str, out)) == sorted(str(tuple(r[c] for c in fields)) for r in rows_)
    ranked = sorted((r for r in rows_ if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(chosen) + 1))
    assert [tuple(r[c] for c in fields) for r in ranked] == chosen
    ids = {r["doc_id"] for r in ranked}
    assert {r["doc_id"] for r in resample.drawn(df, got).collect()} == ids - {None}


def test_border_within_copies(spark):
    """More alike rows than are left: as many as are missing are drawn."""
    df = spark.createDataFrame([(1, "a b c " * 9)] * 300 + [(2, "d e f " * 9)] * 30, "doc_id long, text string")
    got = resample.resample(df, df.where("doc_id = 2"), (1, 2), words=(1, 1)).collect()
    assert len(got) == 330 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 166))


def test_kth_key(spark):
    rng = random.Random(4)
    keys = [(rng.choice([-3, 0, 2, 70_000, -(2**63), 2**63 - 1]), rng.randint(-5, 200_000)) for _ in range(300)]
    df = spark.createDataFrame(keys + keys[:50], "a long, b long")
    order = sorted(keys + keys[:50])
    for k in (1, 17, 160, 350):
        want = list(order[k - 1])
        assert resample.kth_key(df, [F.col("a"), F.col("b")], k) == (want, k - order.index(tuple(want)))


def test_resample_odd(spark):
    none = resample.resample(nothing(spark), odd(spark), (1, 2), words=(1, 1))
    assert none.count() == 0
    got = resample.resample(odd(spark), nothing(spark), (1, 2), words=(1, 1), min_words=1).collect()
    assert len(got) == len(ODD) + 3 and all(r["n_features"] == r["weight"] == 0 for r in got if r["doc_id"] in (0, 1, 2))
    assert sum(r["rank"] is not None for r in got) == sum(r["n_words"] >= 1 for r in got) // 2
    with pytest.raises(ValueError):
        resample.resample(odd(spark), odd(spark), (3, 2))


def test_features_are_lists_of_one_batch():
    found, where, words = resample.features(pa.array(["B a", None, "b"]), 1, 2, 1000)
    assert where.tolist() == [0, 0, 2, 0] and words.tolist() == [2, 0, 1] and found[0] == found[2]
