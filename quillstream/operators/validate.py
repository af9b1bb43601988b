"""Validation of fields and declared rules, confidence and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 0.85


def invoice_errors(vendor: Column, number: Column, date: Column, total: Column) -> Column:
    """Messages of the four rules of an invoice, in their order; ``date`` ISO text, ``total`` text."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    day = F.coalesce(*[F.try_to_date(date, f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd")])
    value = F.translate(F.regexp_replace(total, r"₹|Rs\.?", ""), ", ", "").try_cast("decimal(18,2)")
    return F.array_compact(F.array(
        F.when(blank(vendor), "Vendor Name is required"),
        F.when(blank(number), "Invoice Number is required"),
        F.when(blank(date), "Invoice Date is required").when(day.isNull(), "Invoice Date is invalid"),
        F.when(blank(total), "Total Amount is required").when(value.isNull(), "Total Amount must be numeric").when(value <= 0, "Total Amount must be greater than 0"),
    ))


def overall(*confidences: Column) -> Column:
    """Mean of the fields' confidences, each within 0 and 1, missing ones 0; four places."""
    parts = [F.greatest(F.lit(0), F.least(F.lit(1), F.coalesce(c, F.lit(0)))).cast("decimal(10,6)") for c in confidences]
    return F.round(sum(parts[1:], parts[0]) / len(parts), 4).cast("decimal(6,4)")


def route(errors: Column, confidences: dict[str, Column], threshold: float = THRESHOLD) -> tuple[Column, Column]:
    """(status, reasons): VERIFIED if there is no error and each field and the whole reach the threshold."""
    t = F.lit(threshold).cast("decimal(6,4)")
    whole = overall(*confidences.values())
    low = [F.when(F.round(F.coalesce(c, F.lit(0)).cast("decimal(10,6)"), 4) < t, F.lit(f"{name} confidence is low")) for name, c in confidences.items()]
    reasons = F.concat(errors, F.array_compact(F.array(*low)), F.array_compact(F.array(F.when(whole < t, "Overall confidence is low"))))
    return F.when(F.size(reasons) == 0, "VERIFIED").otherwise("NEEDS_REVIEW"), reasons


def field_score(has_value: Column, grounded: Column, match: Column, n_passes: Column, agree: Column, valid: Column, failures: Column, ocr: Column) -> Column:
    """Composite confidence: 35 % grounding, 25 % agreement, 25 % type, 15 % rules and OCR; within 0.1 and 0.99."""
    d = lambda c: c.cast("decimal(10,4)")
    agreement = F.when(n_passes >= 2, F.when(agree, 1.0).otherwise(0.55)).otherwise(0.88)
    rule = F.greatest(F.lit(0).cast("decimal(10,4)"), 1 - d(failures) * F.lit(0.3).cast("decimal(4,2)"))
    aux = rule * F.lit(0.6).cast("decimal(4,2)") + F.greatest(d(F.lit(0.5)), F.least(d(F.lit(1)), d(ocr))) * F.lit(0.4).cast("decimal(4,2)")
    w = lambda x: F.lit(x).cast("decimal(4,2)")
    sum_ = d(match) * w(0.35) + d(agreement) * w(0.25) + d(F.when(valid, 1.0).otherwise(0.40)) * w(0.25) + aux * w(0.15)
    score = F.round(F.least(F.lit(0.99).cast("decimal(12,6)"), F.greatest(F.lit(0.1).cast("decimal(12,6)"), sum_.cast("decimal(12,6)"))), 2)
    return F.when(~has_value, 0.0).when(~grounded, 0.35).otherwise(score.cast("double"))


def sum_equals(target: Column, total: Column, adjustments: list[Column], tolerance: float = 0.05) -> Column:
    """pass, fail, or skipped without a target; a sum that differs may be made up for by one of the adjustments."""
    t = F.lit(tolerance).cast("decimal(10,2)")
    fits = F.abs(target - total) <= t
    for a in adjustments:
        fits = fits | (F.abs(target - (total + F.coalesce(a, F.lit(0)))) <= t) | (F.abs(target - (total - F.coalesce(a, F.lit(0)))) <= t)
    return F.when(target.isNull(), "skipped").when(fits, "pass").otherwise("fail")


def running_balance(rows: DataFrame, keys: list[str], order: list[str], tolerance: float = 0.05) -> DataFrame:
    """rows (credit, debit, balance) with expected and mismatch: the balance before, plus credit, less debit.

    Rows without a balance are passed over; the balance before is the last one there was.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("balance", ignorenulls=True).over(w)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    df = rows.withColumn("expected", before + zero("credit") - zero("debit"))
    return df.withColumn("mismatch", F.coalesce(F.abs(F.col("balance") - F.col("expected")) > F.lit(tolerance).cast("decimal(10,2)"), F.lit(False)))


def in_order(first: Column, second: Column) -> Column:
    return F.when(first.isNull() | second.isNull(), "skipped").when(first <= second, "pass").otherwise("fail")


def in_range(value: Column, low: float | None, high: float | None) -> Column:
    ok = F.lit(True)
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & (value <= high)
    return F.when(value.isNull(), "skipped").when(ok, "pass").otherwise("fail")


def matches(value: Column, pattern: str) -> Column:
    return F.when(value.isNull(), "skipped").when(value.rlike(pattern), "pass").otherwise("fail")
