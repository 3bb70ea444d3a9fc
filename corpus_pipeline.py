"""Corpus pipeline: quality classifier, line dedup, near duplicates, benchmark
decontamination, BPE. Each stage gets what its predecessor kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm import bpe, decontaminate, jaccard_join, line_dedup, quality
from gridlark.llm._spark import free_names, shared_folder
from gridlark.sources.files import Files

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on them, finds good. Null texts and
    texts without a word go; a quality of exactly one half stays; repeated rows stay or
    go together; no rows give none."""
    return quality.keep_good(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; so do texts of which no word is left.
    n_chars is brought up to date. A column `deleted_lines` of the documents stays."""
    mark, = free_names(docs, "gone")
    own = docs.withColumnRenamed("deleted_lines", mark) if "deleted_lines" in docs.columns else docs
    out = line_dedup.dedup_lines(own)
    cut = F.size("deleted_lines") > 0
    out = out.where(~F.coalesce(cut & (F.trim(F.regexp_replace("text", r"\s+", " ")) == ""), F.lit(False)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    out = out.drop("deleted_lines")
    return (out.withColumnRenamed(mark, "deleted_lines") if mark in out.columns else out).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents (five-word shingles, similarity 0.8) the one with the
    smallest id stays; of rows that share id and text, one."""
    return jaccard_join.one_of_each(docs, n=5, num=80, den=100)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. Null and empty texts hold none and
    stay; repeated rows stay or go together, null ids are like any; null items are found
    nowhere; no rows give none."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, packed as little-endian unsigned 32-bit integers: a row for each
    row, repeated ones and those without id too; null and empty texts have no ids."""
    return bpe.bpe(docs, bpe.TOKENIZER, keep=["doc_id"], make=["n_tokens", "packed"])


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_text),
    ("line_dedup", fresh_lines),
    ("jaccard_join", one_of_each),
    ("decontaminate", no_leaks),
    ("bpe", tokens),
]

#: Trained models and iterations are in it, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again. What a
    stage has written goes as soon as the next one is done; the last one's rows stay."""
    shared = shared_folder(spark)
    files = Files(spark)
    before = None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            files.delete(before)
        before = path
    return docs
