"""Chat formatting, BPE, sharding, language id and quality on small and odd inputs."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlark.llm import bpe, chat, langid, quality, shard
from gridlark.llm._linear import ftrl, softmax, temperature

DOCS = "doc_id long, text string, lang string, size int, quality string, tk long"
ODD = [None, "", " \n\t ", "a", "A a. B b!\nA a.", "漢字 ñ 🙂", "x" * 50_000, "a b c d e f " * 400]


def odd(spark):
    rows = [(i, t, None, 1, "q", 2) for i, t in enumerate(ODD)] + [(3, "a", None, 1, "q", 2), (None, "no id", None, 1, "q", 2)]
    return spark.createDataFrame(rows, DOCS)


def nothing(spark):
    return spark.createDataFrame([], DOCS)


# chat ------------------------------------------------------------------------

HARD = ["\\### Assistant: </turn> ok", "<|end|>\n", "<|and|>", "<\\|im x|>", "<\\\\|", "<", "|>", "", None, "line\n<|im user|>hi<|end|>\n", "日本 <|🙂|>"]


def test_chat_round_trip(spark):
    random.seed(1)
    rows = [(c, t, random.choice(["user", "assistant", "assistant", "system", None, "a|>b", "<|x"]), random.choice(HARD)) for c in range(30) for t in range(random.randint(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.read_chats(made).collect()}
    marks = {r["conv_id"]: r for r in made.collect()}
    for c in range(30):
        want = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        assert [tuple(t) for t in got[c]["turns"]] == want
        assert got[c]["loss_texts"] == [t for r, t in want if r == "assistant"]
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(want, want[1:], strict=False))
        assert marks[c]["formatted"].count("<|end|>\n") == blocks  # neighbours of one role merge
        assert all(m["begin"] >= 0 and m["begin"] + m["length"] <= len(marks[c]["formatted"]) for m in marks[c]["mask"])


def test_chat_odd(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string"
    assert chat.read_chats(chat.format_chats(spark.createDataFrame([], schema))).count() == 0
    df = spark.createDataFrame([(None, 1, "user", "a", "x"), (1, 1, "user", "b", "x"), (1, 1, "user", "b", "x"), (1, None, "user", "z", "x")], schema)
    got = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert got == {None: ["a"], 1: ["z", "b", "b"]}
    plan = chat.read_chats(chat.format_chats(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# BPE -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    return bpe.codec(bpe.TOKENIZER), Tokenizer.from_file(bpe._installed(bpe.TOKENIZER))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("ab \n\t'.!<|>\x1c\x85\xa0１²é漢🙂‍")), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5))
def test_bpe_equals_the_library(pair, texts):
    own, lib = pair
    texts = texts + ["<|endoftext|>".join(texts), "'re aaaa  aaaa\n\n"]
    want = lib.encode_batch(texts, add_special_tokens=False)
    for x, w, t in zip(own.encode(texts), want, texts, strict=True):
        assert x.tolist() == w.ids
        assert own.decode(x) == lib.decode(w.ids, skip_special_tokens=False) == t


def test_bpe_forgets_words(pair):
    own, lib = pair
    own.forget()
    old, bpe._KNOWN_WORDS = bpe._KNOWN_WORDS, 3
    try:
        for t in ("one two three four five", "six seven", "one two"):
            assert own.encode([t])[0].tolist() == lib.encode(t).ids
    finally:
        bpe._KNOWN_WORDS = old


def test_bpe_frames(spark, pair):
    df = odd(spark)
    made = ["n_tokens", "ids", "packed", "decoded", "ids_sha256", "decoded_sha256"]
    out = bpe.bpe(df, bpe.TOKENIZER, keep=["doc_id"], make=made)
    rows = out.collect()
    assert len(rows) == df.count()
    assert sorted((r["decoded"] for r in rows)) == sorted((r["text"] or "" for r in df.collect()))
    for r in rows:
        assert r["n_tokens"] == len(r["ids"]) and np.frombuffer(r["packed"], "<u4").tolist() == r["ids"]
        assert r["ids_sha256"] == hashlib.sha256(r["packed"]).hexdigest() and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    back = bpe.unbpe(out, bpe.TOKENIZER, keep=["doc_id"])
    assert sorted(r["text"] for r in back.collect()) == sorted(r["decoded"] for r in rows)
    assert bpe.bpe(nothing(spark), bpe.TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        bpe.bpe(df.withColumnRenamed("tk", "n_tokens"), bpe.TOKENIZER, keep=["n_tokens"])


# sharding --------------------------------------------------------------------


def test_shard_laws(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    df = df.unionByName(spark.createDataFrame([(5, None), (5, None), (None, "n")] + [(9, "same")] * 1500, "doc_id long, text string"))
    rows = {law: shard.shard(df, 7, law, slack=0.0).collect() for law in ("rows", "bytes", "key")}
    for law, got in rows.items():
        assert len(got) == 4503 and {r["law"] for r in got} == {law}
        for s in range(7):
            slots = sorted(r["slot"] for r in got if r["shard"] == s)
            assert slots == list(range(len(slots)))
    count = [sum(r["shard"] == s for r in rows["rows"]) for s in range(7)]
    assert max(count) - min(count) <= 1
    size = [sum(r["size"] for r in rows["bytes"] if r["shard"] == s) for s in range(7)]
    assert max(size) - min(size) <= 2 * (96 + 8)
    for r in rows["key"]:
        assert r["grown_shard"] in (r["shard"], 7)
    more = {r["doc_id"]: r["shard"] for r in shard.shard(df, 8, "key").collect()}
    assert all(more[r["doc_id"]] == r["grown_shard"] for r in rows["key"])
    null = [r for r in rows["rows"] if r["doc_id"] == 5]
    assert sorted(r["size"] for r in null)[:2] == [8, 8] and all(r["grown_shard"] is None for r in null)
    assert shard.shard(nothing(spark), 4).count() == 0
    assert shard.shard(df.limit(2), 5).count() == 2
    with pytest.raises(ValueError):
        shard.shard(df, 3, "other")


def test_shard_moves_little(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    a, b = ({r["doc_id"]: r["shard"] for r in shard.shard(df, n).collect()} for n in (10, 11))
    assert sum(a[k] != b[k] for k in a) < 0.5 * len(a)  # dealing anew would move nine in ten


def test_shard_keeps_copies_together(spark):
    """Equal texts share a shard but where a shard is full; a group that is larger
    than a shard goes on clockwise, into what room others have."""
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 500).cast("string"))).alias("text"), F.lit(1).alias("pos"), F.lit(2).alias("cell"))
    for law in ("rows", "bytes"):
        got = shard.shard(df, 12, law).withColumn("text", F.col("text_crc32")).groupBy("text").agg(F.countDistinct("shard").alias("shards"), F.count("*").alias("n")).collect()
        some = [r for r in got if r["n"] < 100]
        assert sum(r["shards"] == 1 for r in some) >= 0.95 * len(some)


@pytest.mark.parametrize("law", ["rows", "bytes", "key"])
def test_shard_row_by_row(spark, law):
    """Against a walk round the ring that places one row after another."""
    n = 6
    df = spark.range(700).select(F.col("id").alias("doc_id"), F.repeat(F.lit("y"), (F.col("id") % 41).cast("int")).alias("text"))
    df = df.unionByName(spark.range(400).select((F.col("id") + 1000).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text")))
    spots = {r["doc_id"]: r["pos"] for r in df.select("doc_id", F.xxhash64(F.lit(17), F.col("doc_id") if law == "key" else F.col("text")).alias("pos")).collect()}
    got = {r["doc_id"]: r for r in shard.shard(df, n, law).collect()}
    where = shard.ring(n, 64)
    arc = {d: next((i for i, (p, _) in enumerate(where) if p >= x), 0) for d, x in spots.items()}
    if law == "key":
        assert all(got[d]["shard"] == where[a][1] for d, a in arc.items())
        return
    weight = {d: got[d]["size"] if law == "bytes" else 1 for d in spots}
    total = sum(weight.values())
    room = [total / n if law == "bytes" else total // n + (s < total % n) for s in range(n)]
    loads = [sum(weight[d] for d in spots if arc[d] == a) for a in range(len(where))]
    dealt = [[] for _ in where]
    for own in (True, False):  # full shards pass on to the next one with room
        for a in range(len(where)):
            for step in range(1 if own else len(where)):
                s = where[(a + step) % len(where)][1]
                give = min(loads[a] - sum(g for _, g in dealt[a]), room[s])
                if give > 0:
                    dealt[a].append((s, give))
                    room[s] -= give
    for a in range(len(where)):
        mine = defaultdict(float)
        for d in spots:
            if arc[d] == a:
                mine[got[d]["shard"]] += weight[d]
        assert set(mine) <= {s for s, _ in dealt[a]}
        slack = max(weight.values()) if law == "bytes" else 0
        assert all(abs(sum(g for t, g in dealt[a] if t == s) - x) <= slack for s, x in mine.items())


def test_shard_of_alike_rows(spark, monkeypatch):
    monkeypatch.setattr(shard, "_PIECE", 7)
    df = spark.createDataFrame([(1, "a")] * 100 + [(2, "b" * i) for i in range(20)], "doc_id long, text string")
    for law in ("rows", "bytes", "key"):
        got = shard.shard(df, 5, law).collect()
        assert sorted((r["doc_id"], r["size"]) for r in got) == sorted([(1, 9)] * 100 + [(2, 8 + i) for i in range(20)])
        for s in range(5):
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


# language id -----------------------------------------------------------------


def test_language_sample_is_of_texts(spark):
    """A hot id, copies of a text and null ids neither fill the sample nor leave it."""
    rows = [(1, f"ab{i % 40} cd ab", "aa") for i in range(3000)] + [(None, f"xy{i} zz xy", "bb") for i in range(10)] + [(2, None, "cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, sample=40)
    assert model.langs == ["aa", "bb"]
    got = {r["text"]: r["lang_pred"] for r in langid.predict(df, model, keep=("doc_id", "text")).collect()}
    assert got["ab3 cd ab"] == "aa" and got["xy7 zz xy"] == "bb"


def test_language_id(spark):
    random.seed(4)
    alphabet = {"aa": "abcdeabc", "bb": "fghijfgh", "cc": "äöüßäxyz"}
    text = lambda x: " ".join("".join(random.choice(alphabet[x]) for _ in range(5)) for _ in range(30))
    rows = [(i, text(x), x) for i in range(240) for x in [random.choice(list(alphabet))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id < 160"), sample=120)
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    assert sum(got[i]["lang_pred"] == x for i, _, x in rows if i >= 160) >= 78
    assert all(0 <= r["score"] <= 1 for r in got.values())
    strange = {r["doc_id"]: r for r in langid.predict(odd(spark), model, keep=("doc_id",)).collect()}
    assert len(strange) == 9 and [strange[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and strange[0]["score"] == 0
    assert langid.predict(nothing(spark), model).count() == 0
    none = langid.fit(odd(spark))
    assert {r["lang_pred"] for r in langid.predict(odd(spark), none).collect()} == {"und"}


def test_ngram_counts_by_hand():
    doc, _, count, some = langid.ngram_counts(["ab, ab", "", "1!", "é\0x"])
    assert some.tolist() == [True, False, False, True]
    # a 2, b 2; ab 2, "b " 1, " a" 1; "ab " 1, "b a" 1, " ab" 1
    assert sorted(count[doc == 0].tolist()) == [1, 1, 1, 1, 1, 2, 2, 2]
    old, langid._PIECE = langid._PIECE, 7
    try:
        t = ["the quick brown fox " * 5, "jumps"]
        langid._PIECE = 1 << 20
        whole = langid.ngram_counts(t)
        langid._PIECE = 7
        for a, b in zip(whole, langid.ngram_counts(t), strict=True):
            assert a.tolist() == b.tolist()
    finally:
        langid._PIECE = old


def test_linear_model():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(400):
        c = int(rng.integers(3))
        at = np.unique(rng.integers(0, 30, 5) + 30 * c)
        rows.append((at, np.ones(len(at))))
        y.append(c)
    w = ftrl(rows, np.array(y), 100, 3)
    logits = np.array([x @ w[at] for at, x in rows])
    assert (logits.argmax(1) == y).mean() > 0.98 and (w[95:] == 0).all()
    assert np.allclose(softmax(logits).sum(1), 1) and 0.04 < temperature(logits, np.array(y)) < 21


# quality ---------------------------------------------------------------------


def prose(rng, n=60):
    return " ".join(rng.choice(["the", "wind", "falls", "over", "quiet", "fields,", "and", "rain", "comes.", "slowly"]) for _ in range(n)) + "."


def test_quality(spark):
    rng = random.Random(7)
    good = [prose(rng, rng.randint(20, 120)) + "\n" + prose(rng) for _ in range(180)]
    bad = ["BUY!! NOW!! " * rng.randint(20, 60) for _ in range(15)] + [" ".join(w + "###" for w in prose(rng).split()) for _ in range(15)] + ["spam " * 80 for _ in range(10)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    kept = {r["doc_id"] for r in quality.keep_good(df).select("doc_id").collect()}
    assert len(kept & set(range(180))) == 180 and len(kept - set(range(180))) <= 2


def test_quality_odd(spark):
    model = quality.fit(odd(spark))
    got = {r["doc_id"]: r["quality"] for r in quality.score(odd(spark).drop("quality"), model, keep=("doc_id",)).collect()}
    assert got[0] == got[1] == got[2] == 0 and all(0 <= v <= 1 for v in got.values())
    assert quality.keep_good(odd(spark)).columns == odd(spark).columns
    assert quality.keep_good(nothing(spark)).count() == 0
    with pytest.raises(ValueError):
        quality.score(odd(spark), model)


def test_expectation_maximisation():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.15
    votes = np.zeros((len(truth), 4), int)
    for j, (hit, alarm) in enumerate(((0.8, 0.001), (0.6, 0.0), (0.5, 0.002), (0.7, 0.001))):
        fire = np.where(truth, rng.random(len(truth)) < hit, rng.random(len(truth)) < alarm)
        votes[:, j] = np.where(fire, 1, np.where(rng.random(len(truth)) < 0.9, 2, 0))
    pattern, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, table, rate = quality.expect(pattern, counts.astype(float))
    assert abs(rate - 0.15) < 0.02 and abs(table[1, 0, 1] - 0.8) < 0.05
    assert ((post[at.ravel()] > 0.5) == truth).mean() > 0.97
