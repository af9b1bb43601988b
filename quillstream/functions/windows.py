"""Hashes of word windows as native array expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _joined(df: DataFrame, out: str, a: str, b: str, skip: int, of: str) -> DataFrame:
    """out[i] = of(a[i], b[i + skip]), as long as both exist."""
    n = f"greatest(size({b}) - {skip}, 0)"
    return df.withColumn(out, F.expr(f"zip_with(slice({a}, 1, {n}), slice({b}, {skip + 1}, {n}), (x, y) -> {of})"))


def window_hashes(df: DataFrame, words: str, size: int, out: str) -> DataFrame:
    """Adds ``out``: a 64-bit hash of each window of ``size`` (1 to 5) neighbouring words; empty for fewer words.

    Words are hashed once; wider windows are hashes of two narrower ones, which costs less than indexing the words of
    every window.
    """
    return _windows(df, f"transform({words}, x -> xxhash64(x))", size, out, "xxhash64(x, y)")


def windows_of_sizes(df: DataFrame, words: str, sizes: list[int], prefix: str) -> DataFrame:
    """Adds ``prefix`` + n for each n of ``sizes`` (1 to 5): the same as ``window_hashes`` for each, with the narrower ones shared."""
    of = "xxhash64(x, y)"
    one, two, four = f"{prefix}1", f"{prefix}2", f"{prefix}4"
    df = df.withColumn(one, F.expr(f"transform({words}, x -> xxhash64(x))"))
    if max(sizes, default=1) > 1:
        df = _joined(df, two, one, one, 1, of)
    if max(sizes, default=1) > 3:
        df = _joined(df, four, two, two, 2, of)
    if 3 in sizes:
        df = _joined(df, f"{prefix}3", two, one, 2, of)
    if 5 in sizes:
        df = _joined(df, f"{prefix}5", four, one, 4, of)
    return df.drop(*[f"{prefix}{n}" for n in (1, 2, 4) if n not in sizes])


def window_counts(df: DataFrame, words: str, what: str, size: int, out: str) -> DataFrame:
    """Adds ``out``: how many words ``x`` of each window of ``size`` (1 to 5) words fulfil ``what``."""
    return _windows(df, f"transform({words}, x -> if({what}, 1, 0))", size, out, "x + y")


def _windows(df: DataFrame, each: str, size: int, out: str, of: str) -> DataFrame:
    df = df.withColumn("_h1", F.expr(each))
    if size == 1:
        return df.withColumn(out, F.col("_h1")).drop("_h1")
    df = _joined(df, "_h2", "_h1", "_h1", 1, of)
    if size == 2:
        return df.withColumn(out, F.col("_h2")).drop("_h1", "_h2")
    if size == 3:
        return _joined(df, out, "_h2", "_h1", 2, of).drop("_h1", "_h2")
    df = _joined(df, "_h4", "_h2", "_h2", 2, of)
    if size == 4:
        return df.withColumn(out, F.col("_h4")).drop("_h1", "_h2", "_h4")
    return _joined(df, out, "_h4", "_h1", 4, of).drop("_h1", "_h2", "_h4")
