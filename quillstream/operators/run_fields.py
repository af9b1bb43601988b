"""Fields of extraction runs: found and missing ones, fields that a reviewer adds, and scores made again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import normalize as N
from quillstream.operators.validate import field_score

#: The fields of an invoice, and the confidence from which one counts as found.
INVOICE, LEAST = ("vendor_name", "invoice_number", "invoice_date", "total_amount"), 0.35
NO_RUN = "No active extraction run for document."


def ranked(candidates: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """candidates with ``rank`` from 1 within ``keys``: the highest score first, equal ones by ``order``."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), order)).cast("long"))


def found_and_missing(docs: DataFrame, best: DataFrame, fields: tuple[str, ...] = INVOICE, least: float = LEAST) -> DataFrame:
    """doc_id, found, missing (arrays of names, in the order of ``fields``) of every document in ``docs`` by its ``best`` (doc_id, field,
    value, confidence); a field counts from ``least`` on."""
    sure = best.where((F.col("confidence") >= least) & (F.coalesce("value", F.lit("")) != "")).groupBy("doc_id").agg(F.collect_set("field").alias("_got"))
    names = F.array(*[F.lit(f) for f in fields])
    got = F.coalesce("_got", F.array().cast("array<string>"))
    return docs.select("doc_id").join(sure, "doc_id", "left").select("doc_id", F.filter(names, lambda f: F.array_contains(got, f)).alias("found"), F.filter(names, lambda f: ~F.array_contains(got, f)).alias("missing"))


def added_fields(runs: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of fields that reviewers add, their audit events, and what was refused.

    ``runs``: document_id, run_id, created_at; ``added``: document_id, label, value, data_type, section, canonical_key,
    reviewer_id. A field goes to its document's latest run, as edited and certain; its key is the label's if none is given. A
    value that its type refuses stays as it is, with a message. Documents without a run are refused.
    """
    last = runs.groupBy("document_id").agg(F.max(F.struct("created_at", "run_id")).alias("_l")).select("document_id", F.col("_l.run_id").alias("run_id"))
    value = F.trim(F.col("value").cast("string"))
    rows = added.join(last, "document_id", "left").withColumn("_n", N.field(value, F.col("data_type")))
    key = F.coalesce(F.when(F.col("canonical_key") != "", F.col("canonical_key")), F.regexp_replace(F.lower("label"), " ", "_"))
    section = F.coalesce(F.when(F.col("section") != "", F.col("section")), F.lit("Custom Fields"))
    messages = F.when(~F.col("_n.valid") & F.col("_n.error").isNotNull(), F.array("_n.error")).otherwise(F.array().cast("array<string>"))
    fields = rows.where("run_id is not null").select("document_id", "run_id", key.alias("canonical_key"), "label", section.alias("section"), "data_type", value.alias("raw_value"), F.coalesce("_n.value", value).alias("normalized_value"), F.lit(1.0).alias("confidence"), F.lit("edited").alias("status"), F.lit(True).alias("grounded"), messages.alias("validation_messages"), "reviewer_id")
    audit = fields.select("document_id", F.lit("FIELD_ADDITION_V2").alias("action"), F.col("reviewer_id").alias("actor"), F.col("canonical_key").alias("key"), F.col("normalized_value").alias("value"))
    refused = rows.where("run_id is null").select("document_id", "label", F.lit(NO_RUN).alias("error_message"))
    return fields.drop("reviewer_id"), audit, refused


def rescored(fields: DataFrame) -> DataFrame:
    """fields with confidence and status made again from value, grounded, match_score, n_passes, agree, messages and failures.

    As the worker does it: the score of the match stands in for the quality of recognition, any message counts as a value
    of the wrong type, and a field that is absent gets 0 and needs review, whatever it had.
    """
    has, valid = F.coalesce(F.trim("value"), F.lit("")) != "", F.size("messages") == 0
    score = field_score(has, F.col("grounded"), F.col("match_score"), F.col("n_passes"), F.col("agree"), valid, F.col("failures"), F.col("match_score"))
    sure = (score >= 0.85) & F.col("grounded") & valid & has
    return fields.withColumns({"confidence": score, "status": F.when(sure, "verified").otherwise("needs_review")})


def document_status(fields: DataFrame) -> DataFrame:
    """document_id, confidence, status: the mean of a document's fields; one that needs review makes the document need it."""
    return fields.groupBy("document_id").agg(F.round(F.avg(F.col("confidence").cast("decimal(10,4)")), 2).cast("double").alias("confidence"), F.when(F.max((F.col("status") == "needs_review").cast("int")) == 1, "NEEDS_REVIEW").otherwise("VERIFIED").alias("status"))
