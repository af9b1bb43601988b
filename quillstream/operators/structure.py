"""Structure of documents: cleaned page text, labelled lines, sections, tables as text, events of a document's life."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.text import prepared_lines

#: Headings of résumé sections.
SECTIONS = {"summary": "summary|professional summary|profile|objective", "skills": "skills|technical skills", "experience": "experience|work experience|employment history", "education": "education|academic background", "projects": "projects", "certifications": "certifications|certificates", "languages": "languages|language proficiency"}


def cleaned(text: Column) -> Column:
    """Without NUL; line feeds only; no white space at line ends; at most one blank line in a row; trimmed."""
    out = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\x00", ""), r"\r\n?", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t\f\x0b]+(?=\n|$)", ""), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def labelled_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, label, value) of lines with a colon: label in lower case with underscores."""
    lines = prepared_lines(docs, key, text).where(F.col("line").contains(":"))
    label = F.trim(F.translate(F.lower(F.substring_index("line", ":", 1)), " ", "_"))
    value = F.trim(F.substring(F.col("line"), F.instr("line", ":") + 1, F.length("line")))
    return lines.select(key, "line_no", label.alias("label"), value.alias("value")).where("value <> ''")


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section, content): lines under the last section heading, joined; lines before any heading belong to none."""
    lines = prepared_lines(docs, key, text)
    bare = F.trim(F.lower(F.regexp_replace("line", r"[^A-Za-z0-9\s]", "")))
    head = F.lit(None).cast("string")
    for name, words in reversed(SECTIONS.items()):
        head = F.when((F.length(bare) <= 40) & bare.rlike(f"^(?:{words})s?$|^(?:{words}) | (?:{words})$"), name).otherwise(head)
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    under = lines.withColumn("head", head).withColumn("section", F.last("head", ignorenulls=True).over(order)).where("head is null and section is not null")
    content = F.trim(F.regexp_replace("line", r"^[•●*\-\s]+", ""))
    got = under.withColumn("line", content).where("line <> ''").groupBy(key, "section").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    return got.select(key, "section", F.array_join("x.line", "\n").alias("content"))


def rows_as_text(table: DataFrame, order: list[str], name: str) -> DataFrame:
    """(row_text): each row as "column: value, ..." without missing ones."""
    parts = [F.when(F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) != "", F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string"))) for c in table.columns]
    return table.select(*order, F.lit(name).alias("sheet"), F.concat_ws(", ", *parts).alias("row_text"))


def safe_name(name: Column) -> Column:
    """The last part of a path without leading dots and NUL; unnamed_document if nothing is left."""
    last = F.element_at(F.split(F.translate(F.trim(F.translate(name, "\x00", "")), "\\", "/"), "/"), -1)
    return F.coalesce(F.nullif(F.regexp_replace(last, r"^\.+", ""), F.lit("")), F.lit("unnamed_document"))


def messages(record_errors: Column, status: Column, error_message: Column) -> Column:
    """Distinct sorted messages of a record; without any, those of the document under review."""
    own = F.filter(F.coalesce(record_errors, F.array().cast("array<string>")), lambda e: e != "")
    split = F.filter(F.transform(F.split(F.coalesce(error_message, F.lit("")), ";"), lambda e: F.trim(e)), lambda e: e != "")
    return F.array_sort(F.array_distinct(F.when(F.size(own) > 0, own).when(status == "NEEDS_REVIEW", split).otherwise(F.array().cast("array<string>"))))


def events(docs: DataFrame) -> DataFrame:
    """document_id, action, at: upload of each document, and what its status says of it."""
    status = F.create_map(*[F.lit(x) for x in ("VERIFIED", "DOCUMENT_VERIFIED", "NEEDS_REVIEW", "ROUTED_TO_REVIEW", "FAILED", "PROCESSING_FAILED")])
    both = F.array_compact(F.array(F.when(F.col("uploaded_at").isNotNull(), F.lit("DOCUMENT_UPLOADED")), F.try_element_at(status, F.col("status"))))
    return docs.select("document_id", F.explode(both).alias("action"), F.col("uploaded_at").alias("at"))


def header_names(headers: Column) -> Column:
    """Names of columns: blank, unnamed and none are column_<place>; repeated ones get _2, _3, ..."""
    named = F.transform(headers, lambda h, i: F.when(F.lower(F.trim(F.coalesce(h, F.lit("")))).rlike("^(unnamed:.*|none|nan|)$"), F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(F.trim(h)))
    return F.transform(named, lambda h, i: F.concat(h, F.when(F.size(F.filter(F.slice(named, 1, i), lambda o: o == h)) > 0, F.concat(F.lit("_"), (F.size(F.filter(F.slice(named, 1, i), lambda o: o == h)) + 1).cast("string"))).otherwise("")))


def review_items(records: DataFrame, fields: str = "fields") -> DataFrame:
    """document_id, field, value, original, confidence, source: a row per field of a record's map of structs."""
    each = records.select("document_id", F.explode(fields).alias("field", "f"))
    return each.select("document_id", "field", F.coalesce("f.normalized_value", "f.value").alias("value"), F.coalesce("f.original_value", "f.value").alias("original"), "f.confidence", "f.source")
