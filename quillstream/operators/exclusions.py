"""What speaks against a candidate: a table of reasons, compiled into one expression per candidate."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A reason for ``field``: it holds when the value matches ``value``, or the line ``line`` while nothing in ``saved`` is in
    the line; with ``both``, only when value and line match. ``strip``: characters taken out of the value first."""

    field: str
    reason: str
    penalty: float
    value: str = ""
    line: str = ""
    saved: str = ""
    both: bool = False
    strip: str = ""


#: Reasons, penalties, and what each looks like.
RULES = (
    Rule("invoice_number", "GSTIN", 0.80, r"\b\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b", r"\b(gstin|gst\s*no|gst\s*#)\b", "inv|bill"),
    Rule("invoice_number", "PAN", 0.80, r"^[A-Z]{5}\d{4}[A-Z]\b", r"\bpan\s*(no|#|number)?\b", "inv|bill", strip=r"[\s-]"),
    # digits behind letters of the same token are a code's
    Rule("invoice_number", "phone number", 0.80, r"(?<![A-Za-z][A-Za-z0-9/_-]{0,40})(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}|\b[6-9]\d{9}\b"),
    Rule("invoice_number", "mobile number", 0.80, r"^[6-9]\d{9}$", strip=r"\D"),
    Rule("invoice_number", "called number", 0.80, r"^\d{10,}$", r"\b(phone|tel|mobile|mob|contact|fax|call)\b", both=True, strip=r"\D"),
    Rule("invoice_number", "bank account", 0.75, r"^\d{11,18}$", r"\b(a/c|account|bank|ifsc|iban|swift|branch)\b", both=True, strip=r"\D"),
    Rule("invoice_number", "IFSC code", 0.80, r"^[A-Z]{4}0[A-Z0-9]{6}\b", r"\bifsc\s*(code)?\b", strip=r"[\s-]"),
    Rule("invoice_number", "date", 0.85, r"^\s*\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\s*$"),
    Rule("invoice_number", "PIN code", 0.75, r"^\s*(\d{6}|\d{5}(-\d{4})?)\s*$", r"\b(pin|zip|postal|road|street|nagar|park|marg|lane|floor|building|bangalore|mumbai|delhi|kolkata|chennai|hyderabad|pune)\b", both=True),
    Rule("invoice_number", "tax percentage", 0.85, r"^\d+(\.\d+)?%$", r"\b(cgst|sgst|igst|vat|tax)\s*(rate|%|@)"),
    Rule("invoice_number", "HSN/SAC code", 0.60, "", r"\b(hsn|sac|sku|item\s*code|part\s*no|code)\b"),
    Rule("invoice_date", "due date", 0.65, "", r"\bdue\s*(date)?\b|\bpayment\s*(due\s*)?date\b"),
    Rule("invoice_date", "delivery date", 0.65, "", r"\bdelivery\s*date\b|\bdelivered\s*(on|date)?\b"),
    Rule("invoice_date", "order date", 0.65, "", r"\border\s*date\b|\bpo\s*date\b|\bpurchase\s*order\s*date\b"),
    Rule("invoice_date", "shipping date", 0.65, "", r"\bshipping\s*date\b|\bship\s*date\b|\bdispatch\s*date\b"),
    Rule("invoice_date", "expiry date", 0.65, "", r"\bexpiry\s*date\b|\bvalid\s*(until|through)\b"),
    Rule("total_amount", "subtotal", 0.65, "", r"\bsub\s*-?total\b", "grand total|net payable|total due|amount due"),
    Rule("total_amount", "tax amount", 0.65, "", r"\b(tax\s*amount|taxable|cgst|sgst|igst|vat|tax)\b", "grand total|net payable|total due|amount due"),
    Rule("total_amount", "discount", 0.65, "", r"\b(discount|rebate)\b", "grand total|net payable|total due|amount due"),
    Rule("total_amount", "unit price", 0.65, "", r"\b(unit\s*price|unit\s*cost|rate|price)\b", "grand total|net payable|total due|amount due"),
    Rule("total_amount", "quantity", 0.65, "", r"\b(quantity|qty|hours|units|nos|count|attendees|items|pieces|pcs|users|people|members|tickets)\b", "grand total|net payable|total due|amount due"),
    Rule("vendor_name", "another party", 0.65, "", r"\b(bill\s+to|ship\s+to|invoice\s+to|customer|client|consignee)\b"),
)
#: Reasons that tell of one thing; only the first of them that holds counts.
ONE_THING = (("phone number", "mobile number", "called number"),)
#: A number of digits only, without a keyword that it stands by.
UNANCHORED = ("bare number", 0.80)


def _holds(rule: Rule, value: Column, line: Column) -> Column:
    bare = F.regexp_replace(value, rule.strip, "") if rule.strip else value
    in_value = bare.rlike(f"(?i){rule.value}") if rule.value else F.lit(False)
    in_line = line.rlike(f"(?i){rule.line}") if rule.line else F.lit(False)
    if rule.saved:
        in_line = in_line & ~line.rlike(f"(?i){rule.saved}")
    return in_value & in_line if rule.both else in_value | in_line


def _suspect(field: str) -> str:
    """One pattern that a line or value must match for any rule of the field to hold, so that most candidates try no rule."""
    lines = [r.line for r in RULES if r.field == field and r.line]
    return "(?i)" + "|".join([*(["\\d"] if field == "invoice_number" else []), *lines])


def reasons(field: str, value: Column, line: Column, anchored: Column | None = None) -> Column:
    """Array of (reason, penalty) that hold, in the order of the table; null value or line counts as empty."""
    value, line = F.coalesce(value, F.lit("")), F.coalesce(line, F.lit(""))
    told: list[Column] = []
    held: dict[str, Column] = {}
    for rule in RULES:
        if rule.field != field:
            continue
        holds = held[rule.reason] = _holds(rule, value, line)
        for group in ONE_THING:
            for other in group[: group.index(rule.reason)] if rule.reason in group else ():
                holds = holds & ~held[other]
        told.append(F.when(holds, F.struct(F.lit(rule.reason).alias("reason"), F.lit(rule.penalty).cast("decimal(4,2)").alias("penalty"))))
    if field == "invoice_number" and anchored is not None:
        told.append(F.when(value.rlike(r"^\d+$") & ~anchored, F.struct(F.lit(UNANCHORED[0]).alias("reason"), F.lit(UNANCHORED[1]).cast("decimal(4,2)").alias("penalty"))))
    none = F.array().cast("array<struct<reason:string,penalty:decimal(4,2)>>")
    return F.when(F.concat(value, F.lit("\n"), line).rlike(_suspect(field)), F.array_compact(F.array(*told))).otherwise(none)


def penalty(found: Column) -> Column:
    """The sum of the penalties of ``reasons``."""
    return F.aggregate(found, F.lit(0).cast("decimal(8,2)"), lambda a, r: (a + r["penalty"]).cast("decimal(8,2)"))


def main_reason(found: Column) -> Column:
    """The reason with the largest penalty, of equal ones the first; null without any."""
    best = F.aggregate(found, F.get(found, 0), lambda a, r: F.when(r["penalty"] > a["penalty"], r).otherwise(a))
    return best["reason"]
