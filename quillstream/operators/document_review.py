"""Whole documents under review: confidence and status from their fields, checks after edits, comparison of sources, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.operators.validate import THRESHOLD, invoice_errors

#: Fields of an invoice.
INVOICE = ("vendor_name", "invoice_number", "invoice_date", "total_amount")


def _filled(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit("")) != ""


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(10,6)")


def typed_route(fields: DataFrame) -> DataFrame:
    """doc_id, confidence, status, reason from ``fields`` (doc_id, pos, field, value, confidence) of types other than invoices.

    The mean takes a null value for 0. Verified from the threshold on, if no value is missing; else the first three missing
    fields are named.
    """
    missing = F.when(~_filled(F.col("value")), F.struct("pos", F.initcap(F.translate("field", "_", " ")).alias("name")))
    got = fields.groupBy("doc_id").agg(F.round(F.avg(F.when(F.col("value").isNull(), F.lit(0)).otherwise(F.coalesce(_exact("confidence"), F.lit(0)))), 2).alias("c"), F.array_sort(F.collect_list(missing)).alias("gone"))
    ok = (F.col("c") >= THRESHOLD) & (F.size("gone") == 0)
    names = F.array_join(F.slice(F.col("gone.name"), 1, 3), ", ")
    reason = F.when(F.size("gone") > 0, F.concat(F.lit("Fields missing or requiring review: "), names)).when(~ok, "Document confidence below verification threshold")
    return got.select("doc_id", F.col("c").cast("double").alias("confidence"), F.when(ok, "VERIFIED").otherwise("NEEDS_REVIEW").alias("status"), reason.alias("reason"))


def evaluated(docs: DataFrame, fields: DataFrame, errors: DataFrame) -> DataFrame:
    """doc_id, confidence, status, reasons of all ``docs`` from their ``fields`` (doc_id, pos, label, confidence, status,
    grounded) and the messages of failed rules in ``errors`` (doc_id, pos, message). A document without fields has 0."""
    failing = F.when(F.col("status") == "needs_review", F.struct("pos", "label"))
    by_doc = fields.groupBy("doc_id").agg(F.avg(_exact("confidence")).alias("mean"), F.count_if(~F.col("grounded")).alias("loose"), F.array_sort(F.collect_list(failing)).alias("failing"))
    said = errors.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "message"))).alias("said"))
    all_ = docs.select("doc_id").join(by_doc, "doc_id", "left").join(said, "doc_id", "left")
    own = F.array_compact(F.array(
        F.when(F.col("loose") > 0, F.concat(F.col("loose").cast("string"), F.lit(" field(s) ungrounded in document text"))),
        F.when(F.size("failing") > 0, F.concat(F.lit("Fields requiring human review: "), F.array_join(F.slice(F.col("failing.label"), 1, 4), ", "))),
    ))
    reasons = F.when(F.col("mean").isNull(), F.array(F.lit("No fields extracted from document."))).otherwise(F.concat(own, F.coalesce(F.col("said.message"), F.array().cast("array<string>"))))
    ok = (F.size(reasons) == 0) & (F.col("mean") >= THRESHOLD)
    return all_.select("doc_id", F.coalesce(F.round("mean", 2), F.lit(0)).cast("double").alias("confidence"), F.when(ok, "VERIFIED").otherwise("NEEDS_REVIEW").alias("status"), reasons.alias("reasons"))


def overall_after_edits(fields: DataFrame) -> DataFrame:
    """doc_id, confidence: the mean of the confidences that there are, four places; 1 without any."""
    return fields.groupBy("doc_id").agg(F.coalesce(F.round(F.avg(_exact("confidence")), 4), F.lit(1)).cast("double").alias("confidence"))


def revalidated(fields: DataFrame) -> DataFrame:
    """doc_id, is_valid, errors after edits of ``fields`` (doc_id, doc_type, pos, field, value, errors).

    First come the fields' own messages. An invoice, by its type or by having all four of its fields, is held to the rules
    of invoices; in other documents no field that is given may be empty.
    """
    empty = F.when(~_filled(F.col("value")), F.struct("pos", F.concat("field", F.lit(" is required and cannot be empty")).alias("message")))
    four = [F.max(F.when(F.col("field") == f, F.coalesce("value", F.lit("")))).alias(f) for f in INVOICE]
    got = fields.groupBy("doc_id").agg(F.max(F.lower("doc_type")).alias("kind"), F.array_sort(F.collect_list(F.struct("pos", F.coalesce("errors", F.array().cast("array<string>")).alias("e")))).alias("own"), F.array_sort(F.collect_list(empty)).alias("empty"), *four)
    all_four = F.lit(True)
    for f in INVOICE:
        all_four = all_four & F.col(f).isNotNull()
    rules = F.when(F.coalesce(F.col("kind") == "invoice", F.lit(False)) | all_four, invoice_errors(*[F.col(f) for f in INVOICE])).otherwise(F.col("empty.message"))
    errors = F.array_distinct(F.concat(F.flatten(F.col("own.e")), rules))
    return got.select("doc_id", (F.size(errors) == 0).alias("is_valid"), errors.alias("errors"))


def rule_failures(fields: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``fields`` (doc_id, key) with n_failures: failed ``outcomes`` (doc_id, target, status) for the key or for its end after a point.

    The ends of a key are joined with the targets by equality, so a document's rules aren't held against all its fields.
    """
    failed = outcomes.where("status = 'fail'").groupBy("doc_id", F.col("target").alias("_end")).agg(F.count("*").alias("_n"))
    parts = F.split("key", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hits = fields.select("doc_id", "key").distinct().select("doc_id", "key", F.explode(ends).alias("_end")).join(failed, ["doc_id", "_end"])
    return fields.join(hits.groupBy("doc_id", "key").agg(F.sum("_n").alias("n_failures")), ["doc_id", "key"], "left").fillna(0, ["n_failures"])


def looked_up(fields: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id, name, key, value: for each name ``asked`` (doc_id, name) the document's first field of ``fields`` (doc_id, pos,
    key, label, value) with that key, else with a key that ends in it after a point, else with that label in snake case."""
    parts = F.split("key", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("name"), F.when(i == 1, 0).otherwise(1).alias("rank")))
    label = F.struct(F.translate(F.lower("label"), " ", "_").alias("name"), F.lit(2).alias("rank"))
    names = fields.select("doc_id", "pos", "key", "value", F.explode(F.concat(ends, F.array(label))).alias("n")).select("doc_id", "pos", "key", "value", "n.name", "n.rank")
    return asked.join(names, ["doc_id", "name"]).groupBy("doc_id", "name").agg(F.min(F.struct("rank", "pos", "key", "value")).alias("x")).select("doc_id", "name", "x.key", "x.value")


def by_source(finals: DataFrame, candidates: DataFrame) -> DataFrame:
    """doc_id, field, rule_value, model_value, outcome (AGREED, REVIEW REQUIRED, SINGLE_SOURCE, MISSING).

    The best candidate of the rules (keyword, regex, positional, rule) and of the model stand for them; without one, the
    final value does where its source names them. ``finals``, ``candidates``: doc_id, field, value, confidence, source.
    """
    kind = F.lower("source")
    best = lambda who: F.max_by(F.when(who, F.col("value")), F.when(who, F.struct(F.coalesce("confidence", F.lit(0.0)), F.col("value"))))
    got = candidates.groupBy("doc_id", "field").agg(best(kind.isin("keyword", "regex", "positional", "rule")).alias("r"), best(kind == "ai").alias("m"))
    both = finals.join(got, ["doc_id", "field"], "left")
    side = lambda c, word: F.coalesce(F.col(c), F.when(F.col("source").contains(word), F.col("value")))
    rule, model = side("r", "rule"), side("m", "ai")
    a, b = (F.coalesce(F.lower(F.trim(x)), F.lit("")) for x in (rule, model))
    outcome = F.when(F.col("source").contains("rule+ai") | ((a != "") & (a == b)), "AGREED").when((a != "") & (b != ""), "REVIEW REQUIRED").when((a != "") | (b != ""), "SINGLE_SOURCE").otherwise("MISSING")
    return both.select("doc_id", "field", rule.alias("rule_value"), model.alias("model_value"), outcome.alias("outcome"))


def full_text(blocks: DataFrame) -> DataFrame:
    """doc_id, text: blocks (doc_id, page, reading_order, text) in order, trimmed, a blank line between them, empty ones left out."""
    kept = blocks.select("doc_id", "page", "reading_order", F.trim("text").alias("text")).where("text <> ''")
    return kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "reading_order", "text"))).alias("x")).select("doc_id", F.array_join(F.col("x.text"), "\n\n").alias("text"))


def block_kind(text: Column) -> Column:
    """heading, list or paragraph: short text all in capitals, or with a capital at the start of each word only, is a heading."""
    capitals = text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}")
    title = text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{L}\p{Lu}|(^|\P{L})\p{Ll}")
    return F.when((F.length(text) < 80) & (capitals | title), "heading").when(text.rlike(r"^\s*([•●▪◦*-]|\d+[.)])\s"), "list").otherwise("paragraph")


def occurrence_boost(candidates: DataFrame, fold: bool) -> DataFrame:
    """``candidates`` (doc_id, field, value, confidence) with 0.05 more, 1 at most, for values that a document's field has twice or
    more; ``fold`` tells whether case counts as equal."""
    same = F.lower("value") if fold else F.col("value")
    both = candidates.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id", "field", same)))
    more = F.least(F.lit(1).cast("decimal(6,4)"), F.col("confidence").cast("decimal(6,4)") + F.lit(0.05).cast("decimal(6,4)"))
    return both.withColumn("confidence", F.when(F.col("_n") > 1, more.cast("double")).otherwise(F.col("confidence").cast("double"))).drop("_n")


def proximity(lines: Column, chars: Column, between: Column) -> Column:
    """How near a value is to its keyword, 0.10 to 1: by the lines with other text ``between`` them, else the characters on the
    same line (null: touching), else the lines down."""
    d = lambda x: F.lit(x).cast("decimal(10,4)")
    n = lambda c: c.cast("decimal(10,4)")
    near = F.when(chars.isNull() | (chars <= 4), d(1)).when(chars <= 20, F.greatest(d(0.75), d(1) - n(chars - 4) * d(0.015))).otherwise(F.greatest(d(0.40), d(0.75) - n(chars - 20) * d(0.01)))
    far = F.when(lines == 1, d(0.80)).otherwise(F.greatest(d(0.10), d(0.80) - n(lines - 1) * d(0.25)))
    return F.round(F.when(between > 0, F.greatest(d(0.10), d(0.70) - n(between) * d(0.20))).when(lines == 0, near).otherwise(far), 2).cast("double")


def near_in_space(base: Column, distance: Column) -> Column:
    """``base`` and the nearness of two boxes ``distance`` pixels apart, half each; ``base`` alone without a distance."""
    space = F.when(distance < 40, 1.0).when(distance < 120, F.greatest(F.lit(0.60), 1 - (distance - 40) * 0.005)).otherwise(F.greatest(F.lit(0.10), 0.60 - (distance - 120) * 0.002))
    return F.when(distance.isNull(), base).otherwise(F.round((base + space) / 2, 2))


def plausible_date(text: Column) -> Column:
    """Whether a date as text may be one: day to 31, month to 12, year 1990 to 2040; a month's name needs only the year."""
    part = [F.regexp_extract(text, r"^(\d{1,4})[-/. ](\d{1,2})[-/. ](\d{1,4})$", i).try_cast("int") for i in (1, 2, 3)]
    first, month, last = part
    year = F.when(first > 1000, first).when(last > 1000, last).when(last < 100, last + 2000).otherwise(last)
    day = F.when(first > 1000, last).otherwise(first)
    worded = F.regexp_extract(text, r"\b((?:19|20)\d\d)\b", 1).try_cast("int")
    named = text.rlike(r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b")
    numeric = month.between(1, 12) & day.between(1, 31) & year.between(1990, 2040)
    return F.coalesce(F.when(month.isNotNull(), numeric).when(named, F.coalesce(worded.between(1990, 2040), F.lit(True))), F.lit(False))
