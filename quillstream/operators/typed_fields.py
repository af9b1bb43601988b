"""Fields of documents of a known type, one row per field.

A line that begins with a label and a sign ("Policy No: P/17", "Receipt # 5") is a labelled value. Labels are compared
without case, signs and a closing word for number, so "PO Number", "PO No." and "PO #" are one. What a field takes of its
line depends on its kind. Fields without labels are taken by place (the first line, the n-th date) or by form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a kind of value looks like on a labelled line.
KINDS = {
    "amount": r"[$€£₹]?\s?[0-9][0-9,]*(?:\.[0-9]+)?",
    "code": r"[A-Za-z0-9][A-Za-z0-9/_-]*",
    "date": r"[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}",
    "name": r"\p{L}[\p{L} .'-]*",
    "text": r"\S.*",
}
#: type, field, confidence (fixed values), kind of value, labels.
LABELLED: tuple[tuple[str, str, float, str, tuple[str, ...]], ...] = (
    ("application_form", "address", 0.80, "text", ("address", "home address", "postal address")),
    ("application_form", "applicant_name", 0.85, "name", ("applicant", "applicant name", "name", "full name")),
    ("application_form", "application_number", 0.90, "code", ("application", "application id", "form")),
    ("bank_statement", "account_holder", 0.85, "text", ("account holder", "account name", "customer", "customer name")),
    ("bank_statement", "account_number", 0.90, "code", ("account", "a c")),
    ("bank_statement", "balance_amount", 0.85, "amount", ("balance", "closing balance", "available balance", "ending balance")),
    ("bank_statement", "credit_amount", 0.75, "amount", ("credit", "credits", "deposit", "deposits", "total credits")),
    ("bank_statement", "debit_amount", 0.75, "amount", ("debit", "debits", "withdrawal", "withdrawals", "total debits")),
    ("bank_statement", "statement_period", 0.85, "text", ("period", "statement period")),
    ("certificate", "certificate_id", 0.85, "code", ("certificate", "certificate id", "credential id")),
    ("certificate", "person_name", 0.85, "name", ("awarded to", "name", "presented to")),
    ("contract", "contract_value", 0.80, "amount", ("contract value", "fee", "value", "contract amount")),
    ("contract", "effective_date", 0.85, "date", ("effective date", "start date")),
    ("contract", "expiry_date", 0.85, "date", ("end date", "expiration date", "expiry date", "termination date")),
    ("contract", "parties", 0.80, "text", ("between", "parties")),
    ("delivery_challan", "challan_number", 0.90, "code", ("challan", "delivery challan", "dc")),
    ("delivery_challan", "customer_name", 0.80, "text", ("consignee", "customer", "deliver to", "to")),
    ("delivery_challan", "supplier_name", 0.80, "text", ("consignor", "from", "supplier")),
    ("expense_report", "employee_name", 0.85, "name", ("claimant", "employee", "employee name", "submitted by")),
    ("expense_report", "total_amount", 0.85, "amount", ("grand total", "total", "total amount", "total claim", "total expenses")),
    ("id_document", "address", 0.80, "text", ("address",)),
    ("id_document", "date_of_birth", 0.85, "date", ("birth date", "date of birth", "dob")),
    ("id_document", "id_number", 0.90, "code", ("card", "id", "licence", "license", "passport")),
    ("id_document", "person_name", 0.80, "name", ("full name", "holder", "name")),
    ("insurance", "policy_holder", 0.85, "name", ("insured", "insured name", "policy holder", "policyholder")),
    ("insurance", "policy_number", 0.90, "code", ("policy",)),
    ("insurance", "premium_amount", 0.85, "amount", ("premium", "premium amount", "total premium")),
    ("invoice", "invoice_number", 0.85, "code", ("bill", "inv", "invoice")),
    ("invoice", "tax_amount", 0.75, "amount", ("gst", "sales tax", "tax", "vat")),
    ("invoice", "total_amount", 0.85, "amount", ("amount due", "grand total", "net payable", "total", "total amount")),
    ("medical_report", "patient_name", 0.85, "name", ("name", "patient", "patient name")),
    ("medical_report", "reference_range", 0.75, "text", ("normal range", "reference range", "reference interval")),
    ("medical_report", "test_name", 0.80, "text", ("investigation", "procedure", "test", "test name")),
    ("medical_report", "test_result", 0.80, "text", ("finding", "findings", "observed value", "result")),
    ("purchase_order", "buyer_name", 0.85, "text", ("buyer", "deliver to", "ordered by")),
    ("purchase_order", "po_number", 0.90, "code", ("po", "purchase order")),
    ("purchase_order", "supplier_name", 0.80, "text", ("supplier", "vendor")),
    ("purchase_order", "total_amount", 0.85, "amount", ("grand total", "order total", "total", "total amount")),
    ("receipt", "receipt_number", 0.85, "code", ("check", "order", "receipt", "transaction")),
    ("receipt", "tax_amount", 0.75, "amount", ("gst", "sales tax", "tax", "vat")),
    ("receipt", "total_amount", 0.85, "amount", ("fare", "grand total", "total", "total amount", "total paid")),
)
#: type, field, confidence (fixed values), which date of the text counts (-1: the last); 0 stands for the first line.
PLACED: tuple[tuple[str, str, float, int], ...] = (
    ("bank_statement", "transaction_date", 0.80, -1),
    ("certificate", "issue_date", 0.80, -1),
    ("delivery_challan", "challan_date", 0.85, 1),
    ("expense_report", "expense_date", 0.85, 1),
    ("insurance", "expiry_date", 0.80, 2),
    ("insurance", "start_date", 0.80, 1),
    ("invoice", "invoice_date", 0.85, 1),
    ("invoice", "vendor_name", 0.80, 0),
    ("medical_report", "report_date", 0.85, 1),
    ("purchase_order", "order_date", 0.85, 1),
    ("receipt", "receipt_date", 0.85, 1),
    ("receipt", "store_name", 0.80, 0),
)
#: type, field, confidence (fixed values), form of the value anywhere in the text.
FORMED: tuple[tuple[str, str, float, str], ...] = (
    ("certificate", "certificate_type", 0.80, r"(?i)\b(?:certificate|diploma|degree) of \p{L}+"),
    ("certificate", "institution_name", 0.80, r"(?i)[^\n,]*\b(?:academy|board|college|institute|school|university)\b[^\n,]*"),
    ("medical_report", "doctor_name", 0.80, r"\b(?:Dr|Doctor)\.?\s?\p{Lu}[\p{L}-]*(?: \p{Lu}[\p{L}-]*)*"),
    ("receipt", "payment_method", 0.80, r"(?i)\b(?:amex|apple pay|cash|debit card|mastercard|upi|visa)\b"),
    ("resume", "education", 0.80, r"(?i)[^\n]*\b(?:bachelor|college|degree|institute|master|phd|university)\b[^\n]*"),
    ("resume", "email", 0.95, r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"),
    ("resume", "experience", 0.80, r"(?i)[0-9]+\+? years?\b[^\n]*experience[^\n]*"),
    ("resume", "phone", 0.90, r"\+?[0-9(][0-9() .-]{7,}[0-9]"),
)
#: A line's label and the rest of the line; "No." and "number" end a label without a sign.
LINE = r"^\s*(\p{L}[\p{L} /&]{0,40}?)(?:[\s.]*[:#=–-]+|(?<= [Nn]o)\.(?=\s)|(?<= [Nn]umber)\s)[\s:#]*(.*)$"
SCHEMA = "kind string, field string, sure double, how string, labels array<string>, pattern string, nth int"


def _rules(spark) -> DataFrame:
    rows = [(t, f, c, "label", list(labels), KINDS[k], 1) for t, f, c, k, labels in LABELLED]
    rows += [(t, f, c, "date" if n else "line", [], KINDS["date"], n or 1) for t, f, c, n in PLACED]
    rows += [(t, f, c, "form", [], p, 1) for t, f, c, p in FORMED]
    return spark.createDataFrame(rows, SCHEMA)


def typed_fields(docs: DataFrame, doc_type: str = "doc_type", text: str = "text") -> DataFrame:
    """doc_id, doc_type, field, value, confidence: the fields that the document's type has; missing ones 0.

    The rules are a table of fixed size that each document is joined with by its type; nothing is shuffled.
    """
    rows = docs.select("doc_id", F.col(doc_type).alias("doc_type"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.trim(x) != ""))
    label = lambda x: F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.regexp_extract(x, LINE, 1)), r"[^\p{L}]+", " ")), r"(?<=\S) (?:no|num|number)$", "")
    rows = rows.withColumn("_pairs", F.transform("_lines", lambda x: F.struct(label(x).alias("label"), F.regexp_extract(x, LINE, 2).alias("rest"))))
    rows = rows.join(F.broadcast(_rules(docs.sparkSession)), F.col("doc_type") == F.col("kind"))
    on_line = F.expr("get(filter(_pairs, p -> p.rest <> '' and array_contains(labels, p.label)), 0).rest")
    source = F.when(F.col("how") == "label", on_line).when(F.col("how") == "line", F.get("_lines", F.lit(0))).otherwise(F.col("_text"))
    # each pattern stands in the plan, where it is compiled once; one that is read from a row is compiled for each row
    found = F.when(F.col("how") == "line", source)
    for pattern in dict.fromkeys([*KINDS.values(), *(p for *_, p in FORMED)]):
        found = found.when(F.col("pattern") == pattern, F.try_element_at(F.regexp_extract_all(F.col("_from"), F.lit(pattern), 0), F.col("nth")))
    # out of an array of one, so that a filter on the value doesn't make it a second time
    rows = rows.withColumn("_from", source).withColumn("_found", F.trim(found)).withColumn("value", F.explode(F.array(F.nullif("_found", F.lit("")))))
    return rows.select("doc_id", "doc_type", "field", "value", F.when(F.col("value").isNotNull(), F.col("sure")).otherwise(0.0).alias("confidence"))
