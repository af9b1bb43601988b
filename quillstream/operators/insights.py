"""Insights over extracted tables, and profiles of whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.sources.shared import tasks


def column_insights(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: n_rows, and sum, avg (two places), min, max of the numbers; keys without a number give none."""
    v = F.col(value).cast("decimal(18,2)")
    out = rows.groupBy(key).agg(F.count("*").alias("n_rows"), F.sum(v).cast("double").alias("sum_value"), F.round(F.avg(v), 2).cast("double").alias("avg_value"), F.min(v).cast("double").alias("min_value"), F.max(v).cast("double").alias("max_value"))
    return out.where("sum_value is not null")


def coverage(outcomes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: "g/t grounded (v verified)"."""
    n = outcomes.groupBy(key).agg(F.count("*").alias("t"), F.count_if("grounded").alias("g"), F.count_if(F.col("status") == "verified").alias("v"))
    return n.select(key, F.format_string("%d/%d grounded (%d verified)", "g", "t", "v").alias("insight"))


def profile(table: DataFrame) -> DataFrame:
    """A row per column: n_rows, missing, distinct_values, and min, max, mean (two places) of numeric ones.

    One aggregate over the table; distinct counts are exact. Rows are dealt out first, as a task holds each value that it has seen.
    """
    numeric = {f.name for f in table.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")}
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(table.columns):
        aggs += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}"), F.countDistinct(f"`{c}`").alias(f"d{i}")]
        if c in numeric:
            aggs += [F.min(f"`{c}`").cast("double").alias(f"lo{i}"), F.max(f"`{c}`").cast("double").alias(f"hi{i}"), F.round(F.avg(F.col(f"`{c}`").cast("decimal(18,4)")), 2).cast("double").alias(f"av{i}")]
    row = table.repartition(tasks(table, 100_000)).agg(*aggs)
    none = F.lit(None).cast("double")
    cells = [F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"m{i}").alias("missing"), F.col(f"d{i}").alias("distinct_values"), *[(F.col(f"{p}{i}") if c in numeric else none).alias(a) for p, a in (("lo", "min_value"), ("hi", "max_value"), ("av", "mean_value"))]) for i, c in enumerate(table.columns)]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def duplicate_rows(table: DataFrame) -> DataFrame:
    """One row: duplicate_rows, the rows that equal an earlier one."""
    counted = table.groupBy(*[f"`{c}`" for c in table.columns]).agg(F.count("*").alias("_n"))
    return counted.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
