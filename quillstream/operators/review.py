"""Review: comparison of runs, corrections, keyed upserts, deletes with what hangs on them, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value_a, value_b, change (added, removed, changed, same) over the keys of either run."""
    both = a.select(*keys, F.col(value).alias("value_a"), F.lit(1).alias("in_a")).join(b.select(*keys, F.col(value).alias("value_b"), F.lit(1).alias("in_b")), keys, "full_outer")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(F.col("value_a").eqNullSafe(F.col("value_b")), "same").otherwise("changed")
    return both.select(*keys, "value_a", "value_b", change.alias("change"))


def overlay(rows: DataFrame, corrections: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """rows with the last correction of each key; corrected values have confidence 1 and source human."""
    last = corrections.groupBy(*keys).agg(F.max_by(value, order).alias("_new"))
    out = rows.join(last, keys, "left")
    real = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col(value))
    done = out.withColumn("_real", real)
    done = done.withColumn(value, F.when(F.col("_real"), F.col("_new")).otherwise(F.col(value)))
    done = done.withColumn("confidence", F.when(F.col("_real"), 1.0).otherwise(F.col("confidence"))).withColumn("source", F.when(F.col("_real"), "human").otherwise(F.col("source")))
    return done.drop("_new", "_real")


def audit(before: DataFrame, after: DataFrame, keys: list[str], value: str, action: str = "HUMAN_CORRECTION") -> DataFrame:
    """An event for each key whose value changed: keys, action, original_value, corrected_value."""
    changed = compare_runs(before, after, keys, value).where("change = 'changed'")
    return changed.select(*keys, F.lit(action).alias("action"), F.col("value_a").alias("original_value"), F.col("value_b").alias("corrected_value"))


def upsert(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """current with the rows of ``new`` in place of, or beside, its own; one row per key of ``new``."""
    return current.join(new.select(*keys), keys, "left_anti").unionByName(new)


def delete_with_children(parent: DataFrame, child: DataFrame, gone: DataFrame, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """parent and child without the keys in ``gone``."""
    return parent.join(gone.select(key), key, "left_anti"), child.join(gone.select(F.col(key).alias(child_key)), child_key, "left_anti")


def verified(runs: DataFrame, approved: DataFrame) -> DataFrame:
    """``runs`` (document_id, run_id, created_at, status) in which the latest run of each document in ``approved`` is VERIFIED."""
    last = runs.join(approved, "document_id", "left_semi").groupBy("document_id").agg(F.max(F.struct("created_at", "run_id")).alias("_last")).select("document_id", F.col("_last.run_id").alias("_run"))
    out = runs.join(last, "document_id", "left")
    return out.withColumn("status", F.when(F.col("run_id") == F.col("_run"), "VERIFIED").otherwise(F.col("status"))).drop("_run")


def reprocessed(docs: DataFrame, again: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` (document_id, status) with those in ``again`` in PROCESSING, and a queued run for each of these: document_id,
    status, stage, reprocessed_from (the status that the document had)."""
    chosen = again.select("document_id").distinct()
    runs = docs.join(chosen, "document_id", "left_semi").select("document_id", F.lit("QUEUED").alias("status"), F.lit("UPLOADED").alias("stage"), F.col("status").alias("reprocessed_from"))
    out = docs.join(chosen.withColumn("_again", F.lit(True)), "document_id", "left")
    return out.withColumn("status", F.when(F.col("_again"), "PROCESSING").otherwise(F.col("status"))).drop("_again"), runs
