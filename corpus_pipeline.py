"""Corpus pipeline over ``documents``: each stage works on all that the one before it kept.

1. quality: documents that the quality rules reject go.
2. near_duplicates: of each group of near duplicates the document with the smallest doc_id stays.
3. decontamination: documents that hold a benchmark item go.
4. secrets: values that look like live credentials are replaced in the text; copied examples stay.
5. tokens: doc_id, lang, source, n_tokens, token_ids and round_trip of what is left.

Rows with a null doc_id, and rows that repeat one, are each a document of their own in every stage (of equal rows one stays).
Extra columns come through. A stage deletes the tables that it wrote on its way, but for the last that its result reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.decontamination import contaminated
from quillstream.llm.near_duplicates import near_duplicates
from quillstream.llm.quality_rules import quality_filter
from quillstream.llm.queries import TOKENIZER
from quillstream.llm.secrets import redact_live
from quillstream.llm.sentencepiece_codec import tokens
from quillstream.llm.staging import drop, free_name, row_ids, sized, stage

#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def _without(named: DataFrame, row: str, found: DataFrame, name: str) -> DataFrame:
    """``named`` without the rows whose ``row`` is a doc_id of ``found``."""
    gone = free_name(named.columns, "_gone")
    ids = stage(found.select(F.col("doc_id").alias(gone)).distinct(), name)
    return named.join(sized(ids), F.col(row) == F.col(gone), "left_anti")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named, row, _ = row_ids(docs)
    found = near_duplicates(named.select(F.col(row).alias("doc_id"), "text"), SHINGLE)
    return _without(named, row, found.where("not kept"), "copies").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named, row, _ = row_ids(docs)
    found = contaminated(named.select(F.col(row).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(named, row, found, "contaminated").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_live(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens(docs, TOKENIZER, keep=("doc_id", "lang", "source"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicate), ("decontamination", decontamination), ("secrets", secrets), ("tokens", encode)]

#: Near duplicates and token ids have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        before, docs = docs, stage(step(spark, docs, sf_dir), name)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
