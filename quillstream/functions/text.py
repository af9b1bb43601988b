"""Text preparation: lines, redaction, shortening, comparison forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tidy_lines(text: Column) -> Column:
    """Lines with single spaces, trimmed, without blank ones."""
    tidy = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.filter(tidy, lambda x: x != "")


def prepared_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line): ``tidy_lines``, numbered from 0."""
    return docs.select(key, F.posexplode(tidy_lines(F.col(text))).alias("line_no", "line"))


def redacted(text: Column) -> Column:
    """Credentials of URLs, bearer tokens and service keys are starred out."""
    out = F.regexp_replace(text, r"(://[^:/@\s]+):[^@/\s]+@", "$1:***@")
    out = F.regexp_replace(out, r"(?i)bearer [A-Za-z0-9._-]+", "Bearer ***")
    return F.regexp_replace(out, r"(sk-|AIza)[A-Za-z0-9_-]{8,}", "$1***")


def masked(secret: Column) -> Column:
    """First and last four characters."""
    return F.when(F.length(secret) > 8, F.concat(F.left(secret, F.lit(4)), F.lit("..."), F.right(secret, F.lit(4)))).otherwise("***")


def head_and_tail(text: Column, most: int = 12000, mark: str = "\n...\n") -> Column:
    """Longer texts keep 60 hundredths of ``most`` from the start and the rest from the end."""
    head = most * 60 // 100
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(mark), F.right(text, F.lit(most - head))))


def comparison(text: Column) -> Column:
    """Form in which values are compared: lower case, letters, digits, points and dashes."""
    return F.regexp_replace(F.lower(F.trim(text)), r"(?U)[^\w.-]", "")


def grounding_form(text: Column) -> Column:
    """Bullets and control characters are spaces, quotes and dashes plain, spaces single, lower case."""
    out = F.regexp_replace(text, r"[•●▪◦\x00-\x1f]", " ")
    out = F.translate(out, "“”‘’–—", "\"\"''--")
    return F.trim(F.regexp_replace(F.lower(out), r"\s+", " "))
