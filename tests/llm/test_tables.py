"""The queries on the driver's tables: against SQL, labels and brute force."""

import glob
import os
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = c.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in QUERIES[name](spark, SF).select(*columns).collect())


def test_quality_agrees_with_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality is not null")
    r = QUERIES["op6_quality"](spark, SF).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id").agg(F.avg((F.col("kept") == (F.col("label") == 1)).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert r["n"] > 100 and r["a"] >= 0.97


def test_language_of_held_out_documents(spark):
    lang = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").select("doc_id", "lang")
    r = QUERIES["op4_language_id"](spark, SF).where("held_out").join(lang, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert r["n"] > 100 and r["a"] >= 0.97


def test_recall_of_neighbours(spark):
    """The query's own parameters against all cosines."""
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    ids, x = np.array([i for i, _ in rows]), np.stack([v / np.linalg.norm(v) for _, v in rows])
    got = defaultdict(set)
    for r in QUERIES["op1_ann"](spark, SF).collect():
        got[r["query_id"]].add(r["vec_id"])
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = np.where(ids == ids[q], -2.0, x @ x[q])
        hit += len(got[ids[q]] & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
        total += 5
    assert total and hit / total >= 0.9


def test_leaks_have_all_whole_items(spark):
    """Every text that has an item's words in a row is found with it."""
    words = lambda t: re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", (t or "").lower()).split()
    items = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        text = f" {' '.join(words(r['text']))} "
        want |= {(r["doc_id"], i) for i, w in items.items() if w and f" {' '.join(w)} " in text}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op2_decontaminate"](spark, SF).collect()}
    assert want and len(want - got) <= 0.02 * len(want)
