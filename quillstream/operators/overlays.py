"""Maps of fields merged by precedence, with where each value came from; both halves of an invoice normalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import normalize as N

#: The invoice's field that stands in for a receipt's.
RECEIPT = (("store_name", "vendor_name"), ("receipt_number", "invoice_number"), ("receipt_date", "invoice_date"), ("total_amount", "total_amount"))
INVOICE = ("vendor_name", "invoice_number", "invoice_date", "total_amount")
FIELD = "struct<value:string,original_value:string,normalized_value:string,confidence:double,source:string,taken:boolean>"


def _filled(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def overlaid(docs: DataFrame, doc_type: str = "doc_type", fields: str = "fields", invoice: str = "invoice") -> DataFrame:
    """``docs`` with ``fields`` in which the invoice extractor's values stand by the type's rule.

    Both columns are maps from name to struct(value, original_value, normalized_value, confidence, source). Invoices and
    general documents take every invoice value that is there; its confidence counts from above 0. Receipts take one for a
    field without a value, under the receipt's name, with the greater confidence. Other types, and fields that the document
    doesn't have, stay. ``taken`` tells which values came from the invoice.
    """
    own, other = F.col(fields), F.col(invoice)
    renamed = F.map_from_arrays(F.array(*[F.lit(a) for a, _ in RECEIPT]), F.array(*[F.try_element_at(other, F.lit(b)) for _, b in RECEIPT]))
    four = F.map_filter(other, lambda k, _: k.isin(*INVOICE))

    def merged(k: Column, a: Column, b: Column) -> Column:
        receipt = F.col(doc_type) == "receipt"
        take = F.coalesce(_filled(b["value"]) & F.when(receipt, ~_filled(a["value"])).otherwise(F.lit(True)), F.lit(False))
        sure = F.when(receipt, F.greatest(F.coalesce(a["confidence"], F.lit(0.0)), F.coalesce(b["confidence"], F.lit(0.0)))).otherwise(F.when(b["confidence"] > 0, b["confidence"]).otherwise(a["confidence"]))
        pick = lambda x, y: F.when(take, x).otherwise(y)
        return F.struct(pick(b["value"], a["value"]).alias("value"), pick(b["value"], a["original_value"]).alias("original_value"), pick(F.when(_filled(b["normalized_value"]), b["normalized_value"]).otherwise(b["value"]), a["normalized_value"]).alias("normalized_value"), pick(sure, a["confidence"]).alias("confidence"), pick(b["source"], a["source"]).alias("source"), take.alias("taken"))

    none = F.map_filter(four, lambda k, _: F.lit(False))
    right = F.when(F.col(doc_type).isin("invoice", "general"), four).when(F.col(doc_type) == "receipt", renamed).otherwise(none)
    both = F.map_zip_with(own, F.coalesce(right, none), merged)
    return docs.withColumn(fields, F.map_filter(both, lambda k, _: F.map_contains_key(own, k)).cast(f"map<string,{FIELD}>"))


def raw_text(field: Column) -> Column:
    """The text of a field given as VARIANT: a string or number itself, of an object its value, else original_value, else
    normalized_value; the first of them that is there counts, even if it is null."""
    is_object = F.schema_of_variant(field).startswith("OBJECT")
    out = F.lit(None).cast("string")
    for name in ("normalized_value", "original_value", "value"):
        there = F.try_variant_get(field, f"$.{name}", "variant").isNotNull()
        out = F.when(there, F.try_variant_get(field, f"$.{name}", "string")).otherwise(out)
    return F.when(is_object, out).otherwise(F.try_variant_get(field, "$", "string"))


def _outcome(raw: Column, value: Column, error: Column) -> Column:
    bad = raw.isNotNull() & value.isNull()
    return F.struct(raw.alias("original_value"), value.alias("normalized_value"), (~bad).alias("success"), F.when(bad, error).alias("error"))


def normalized_invoice(invoice_date: Column, total_amount: Column) -> Column:
    """struct(success, invoice_date, total_amount, errors) of the two raw texts; a missing text is no error, a blank one is."""
    d, a = F.trim(invoice_date), F.trim(total_amount)
    form = r"^\D*\d{1,4}[-/. ]+(\d{1,2}|\p{L}+)[-/., ]+\d{1,4}.*$|^\D*\p{L}+[-/ ]+\d{1,2}.*$"
    day_error = F.when(d == "", "Date value is empty").when(~d.rlike(r"\d"), "Date value contains no date digits or tokens").when(d.rlike(form), F.concat(F.lit("Invalid calendar date: '"), d, F.lit("'"))).otherwise(F.concat(F.lit("Unrecognized or unsupported date format: '"), d, F.lit("'")))
    minus = F.length(a) - F.length(F.translate(a, "-", ""))
    amount_error = F.when(a == "", "Amount value is empty").when(~a.rlike(r"\d"), "Invalid numeric amount: missing numeric digits").when((minus > 1) & ~a.rlike("/-$"), F.concat(F.lit("Ambiguous or malformed negative format: '"), a, F.lit("'"))).otherwise(F.concat(F.lit("Invalid numeric amount: '"), a, F.lit("' does not conform to a valid numeric format")))
    day = _outcome(invoice_date, F.when(d != "", N.date_day_first(d)).cast("string"), day_error)
    total = _outcome(total_amount, F.when(a != "", N.amount(a)).cast("string"), amount_error)
    errors = F.array_compact(F.array(F.concat(F.lit("invoice_date: "), day["error"]), F.concat(F.lit("total_amount: "), total["error"])))
    return F.struct((day["success"] & total["success"]).alias("success"), day.alias("invoice_date"), total.alias("total_amount"), errors.alias("errors"))
