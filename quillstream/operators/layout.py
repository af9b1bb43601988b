"""Words with places on a page: lines, neighbours of keywords, confidence of a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines_of_words(words: DataFrame, least: float = 10.0) -> DataFrame:
    """doc_id, page, block, line, text, x0, y0, x1, y1, confidence from words (doc_id, page, block, line, word_no, text,
    conf 0-100, x0, y0, x1, y1). Words below ``least`` and blank ones are left out; confidence is the mean, of 1."""
    good = words.where((F.col("conf") >= least) & (F.trim("text") != ""))
    out = good.groupBy("doc_id", "page", "block", "line").agg(F.array_sort(F.collect_list(F.struct("word_no", "text"))).alias("w"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.round(F.avg(F.col("conf").cast("decimal(10,4)")) / 100, 4).cast("double").alias("confidence"))
    return out.select("doc_id", "page", "block", "line", F.array_join("w.text", " ").alias("text"), "x0", "y0", "x1", "y1", "confidence")


def same_line(a: str, b: str) -> Column:
    """Boxes overlap by half the lower one's height, or their middles are within six tenths of it."""
    c = lambda n: F.col(n)
    height = F.least(c(f"{a}.y1") - c(f"{a}.y0"), c(f"{b}.y1") - c(f"{b}.y0"))
    overlap = F.least(c(f"{a}.y1"), c(f"{b}.y1")) - F.greatest(c(f"{a}.y0"), c(f"{b}.y0"))
    middle = F.abs((c(f"{a}.y0") + c(f"{a}.y1")) / 2 - (c(f"{b}.y0") + c(f"{b}.y1")) / 2)
    return (overlap >= height * 0.5) | (middle <= height * 0.6)


def right_neighbours(words: DataFrame, keyword: str, value: str, reach: int = 7) -> DataFrame:
    """doc_id, page, keyword, value: the first word that matches ``value`` among the next ``reach`` words on the line of a
    word that matches ``keyword``. An equi-join on page and place, so that pages are not compared with each other."""
    keys = words.where(F.col("text").rlike(keyword)).withColumn("near", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + reach)))
    pairs = keys.alias("k").join(words.where(F.col("text").rlike(value)).alias("v"), F.expr("k.doc_id = v.doc_id and k.page = v.page and k.near = v.pos")).where(same_line("k", "v") & (F.col("v.x0") >= F.col("k.x0")))
    return pairs.groupBy("k.doc_id", "k.page", "k.pos").agg(F.first("k.text").alias("keyword"), F.min_by("v.text", "v.pos").alias("value")).select("doc_id", "page", "keyword", "value")
