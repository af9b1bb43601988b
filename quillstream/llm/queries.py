"""The queries opN_<name>: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstream.llm.decontamination import contaminated
from quillstream.llm.dual_tree import clustered
from quillstream.llm.html_text import extract
from quillstream.llm.near_duplicates import near_duplicates
from quillstream.llm.pii import personal_data
from quillstream.llm.prefix_trie import forked, numbered_turns, prefix_trie
from quillstream.llm.quality_rules import quality_rules
from quillstream.llm.secrets import secret_spans
from quillstream.llm.sentencepiece_codec import tokens
from quillstream.llm.sharding import sharded
from quillstream.llm.simhash import simhash_duplicates
from quillstream.llm.suffix_dedup import remove_repeats
from quillstream.llm.warc_zip import archived
from quillstream.sources.shared import spread

#: The tokenizer file of op2 and of the pipeline's last stage.
TOKENIZER = os.environ.get("QUILLSTREAM_TOKENIZER", "/opt/tokenizers/piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(_table(spark, sf_dir, "documents"), TOKENIZER)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(_table(spark, sf_dir, "pages"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(_table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(_table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(forked(numbered_turns(_table(spark, sf_dir, "conversations"))))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(_table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_warc": op4_warc,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_secret_scans": op6_secret_scans,
    "op7_html_extraction": op7_html_extraction,
    "op8_pii": op8_pii,
    "op9_sharding": op9_sharding,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_simhash_near_dedup": op12_simhash_near_dedup,
    "op13_centroid_clustering": op13_centroid_clustering,
}
