"""Dashboard analytics over a table of documents: document_id, status, file_type, uploaded_at, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("UPLOADED", "PROCESSING", "VERIFIED", "NEEDS_REVIEW", "FAILED")
HIGH, MEDIUM = 0.85, 0.70


def status_counts(docs: DataFrame) -> DataFrame:
    return docs.where("status is not null").groupBy("status").agg(F.count("*").alias("n"))


def type_counts(docs: DataFrame) -> DataFrame:
    """Missing and empty types count as UNKNOWN."""
    return docs.groupBy(F.coalesce(F.nullif(F.col("file_type"), F.lit("")), F.lit("UNKNOWN")).alias("file_type")).agg(F.count("*").alias("n"))


def tier(confidence: Column) -> Column:
    return F.when(confidence >= HIGH, "high").when(confidence >= MEDIUM, "medium").otherwise("low")


def tier_counts(docs: DataFrame) -> DataFrame:
    return docs.where("confidence is not null").groupBy(tier(F.col("confidence")).alias("tier")).agg(F.count("*").alias("n"))


def summary(docs: DataFrame) -> DataFrame:
    """One row of totals, rates and tiers; one pass with conditional aggregates."""
    n = lambda c: F.count_if(c)
    s, c = F.col("status"), F.col("confidence")
    done, review = n(s == "VERIFIED"), n(s == "NEEDS_REVIEW")
    known = n(c.isNotNull())
    rate = lambda a, b, places: F.when(b > 0, F.round(F.lit(100) * a / b, places)).otherwise(F.lit(0.0)).cast("double")
    return docs.agg(
        F.count("*").alias("total"), done.alias("verified"), review.alias("needs_review"), n(s == "FAILED").alias("failed"), n(s == "PROCESSING").alias("processing"),
        F.round(F.avg(c), 4).cast("double").alias("average_confidence"), rate(done, done + review, 2).alias("accuracy_rate"), rate(done, known, 1).alias("automation_rate"),
        n(c >= HIGH).alias("high"), n((c < HIGH) & (c >= MEDIUM)).alias("medium"), n(c < MEDIUM).alias("low"), n(c < HIGH).alias("review_required"),
    )


def list_page(docs: DataFrame, page: int, size: int, status: str | None = None, kind: str | None = None) -> DataFrame:
    """A page of documents, newest first; ``status`` is one of STATUSES in any case."""
    if status is not None:
        status = status.strip().upper()
        if status not in STATUSES:
            raise ValueError(f"unknown status {status}")
        docs = docs.where(F.upper("status") == status)
    if kind is not None:
        docs = docs.where(F.upper("file_type") == kind.strip().upper())
    return docs.orderBy(F.desc("uploaded_at"), F.desc("document_id")).offset((page - 1) * size).limit(size)


def search(docs: DataFrame, records: DataFrame, term: str, columns: tuple[str, ...]) -> DataFrame:
    """Documents with ``term`` (any case) in one of ``columns`` of their own or, if they have any, of their record."""
    joined = docs.join(records, "doc_id", "left")
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).cast("string").ilike(f"%{term}%"), F.lit(False))
    return joined.where(hit).select(*docs.columns).distinct()


def review_queue(docs: DataFrame, size: int = 50) -> DataFrame:
    return docs.where("status = 'NEEDS_REVIEW'").orderBy(F.desc("uploaded_at"), F.desc("document_id")).limit(size)


def detection_rates(found: DataFrame, fields: list[str]) -> DataFrame:
    """``found``: one row per document with a column of values per field, null or blank where there is none.

    field, detected, detection_rate (percent, one place); fields never found count 0.
    """
    total = F.count("*").alias("total")
    wide = found.agg(total, *[F.count_if(F.coalesce(F.trim(F.col(f)), F.lit("")) != "").alias(f) for f in fields])
    long = wide.select("total", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("detected")) for f in fields])).alias("x"))
    return long.select("x.field", "x.detected", F.when(F.col("total") > 0, F.round(F.lit(100) * F.col("x.detected") / F.col("total"), 1)).otherwise(0.0).cast("double").alias("detection_rate"))


def first_filled(*columns: str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns])


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key; a maximum of structs, which combines before the shuffle."""
    return rows.groupBy(key).agg(F.max(F.struct(*order, *[F.col(c) for c in rows.columns if c != key])).alias("_last")).select(key, *[f"_last.{c}" for c in rows.columns if c != key])


#: Letters and digits from which on a page, and a document, has text.
PAGE_TEXT, DOCUMENT_TEXT = 10, 25


def text_metrics(pages: DataFrame) -> DataFrame:
    """doc_id, n_chars, n_words, n_alnum, pages_with_text, n_pages, likely_scanned from ``pages`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    each = pages.select("doc_id", F.length(text).alias("c"), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("w"), F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")).alias("a"))
    out = each.groupBy("doc_id").agg(F.sum("c").alias("n_chars"), F.sum("w").alias("n_words"), F.sum("a").alias("n_alnum"), F.count_if(F.col("a") >= PAGE_TEXT).alias("pages_with_text"), F.count("*").alias("n_pages"))
    return out.withColumn("likely_scanned", (F.col("n_alnum") < DOCUMENT_TEXT) | (F.col("pages_with_text") == 0))


def mean_confidence(docs: DataFrame) -> DataFrame:
    """One row: mean confidence, three places; 0 without any."""
    return docs.agg(F.coalesce(F.round(F.avg("confidence"), 3), F.lit(0)).cast("double").alias("mean_confidence"))


def sections(fields: DataFrame) -> DataFrame:
    """doc_id, section, place, n: a document's sections in the order in which its fields (doc_id, pos, section) first name them;
    of two at one place the first by name."""
    got = fields.groupBy("doc_id", F.coalesce(F.nullif(F.trim("section"), F.lit("")), F.lit("General")).alias("section")).agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    return got.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "section"))).drop("first")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """doc_id, passed, failed of rules' ``outcomes`` (doc_id, status)."""
    return outcomes.groupBy("doc_id").agg(F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "fail").alias("failed"))


def primary_source(fields: DataFrame) -> DataFrame:
    """doc_id, source: the commonest source of a document's fields, the first by name of equally common ones."""
    counted = fields.groupBy("doc_id", "source").agg(F.count("*").alias("n"))
    return counted.groupBy("doc_id").agg(F.min_by("source", F.struct(-F.col("n"), F.col("source"))).alias("source"))


def box_union(boxes: DataFrame, *keys: str) -> DataFrame:
    """keys, x0, y0, x1, y1: the smallest box around the boxes (keys, x0, y0, x1, y1) of each key."""
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def evidence(fields: DataFrame) -> DataFrame:
    """document_id, run_id, field, evidence: those of each document's latest run that have evidence.

    ``fields``: document_id, run_id, created_at, field, evidence.
    """
    last = fields.groupBy("document_id").agg(F.max(F.struct("created_at", "run_id")).alias("_last")).select("document_id", F.col("_last.run_id").alias("run_id"))
    return fields.where("evidence is not null").join(last, ["document_id", "run_id"]).select("document_id", "run_id", "field", "evidence")
