"""Reconciliation of competing values of a field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.text import comparison

#: Evidence that speaks against a field's value, and evidence that saves it.
AGAINST = {
    "total_amount": ("subtotal", "sub-total", "tax", "cgst", "sgst", "discount", "unit price", "qty"),
    "invoice_date": ("due date", "delivery date", "shipping date", "order date", "po date", "expiry"),
    "vendor_name": ("bill to", "buyer", "customer", "ship to", "consignee", "client"),
    "invoice_number": ("gstin", "pan", "phone", "bank", "account", "ifsc", "pin code"),
}
SAVED = {
    "total_amount": ("grand total", "net payable", "total amount", "total due"),
    "invoice_date": ("invoice date", "bill date", "date of issue", "dated"),
    "vendor_name": ("vendor", "seller", "supplier", "from"),
    "invoice_number": ("inv", "bill"),
}


def disqualified(field: Column, evidence: Column) -> Column:
    text = F.lower(F.coalesce(evidence, F.lit("")))
    out = F.lit(False)
    for name, words in AGAINST.items():
        out = F.when(field == name, text.rlike("|".join(words)) & ~text.rlike("|".join(SAVED[name]))).otherwise(out)
    return out


def best_candidates(candidates: DataFrame, least: float = 0.35) -> DataFrame:
    """The candidate of each (doc_id, field) with the highest confidence from ``least`` on; then the first line."""
    rows = candidates.where(F.col("confidence") >= least)
    rest = [c for c in rows.columns if c not in ("doc_id", "field")]
    rank = F.struct("confidence", (-F.coalesce(F.col("line_no"), F.lit(-1))).alias("line_rank"), *[F.col(c).alias(f"_{c}") for c in rest])
    return rows.groupBy("doc_id", "field").agg(F.max(rank).alias("b")).select("doc_id", "field", *[F.col(f"b._{c}").alias(c) for c in rest])


def best_of(found: Column, fields: list[str], least: float = 0.35) -> dict[str, Column]:
    """As ``best_candidates``, of a document's candidates in one array: the best struct of each field, null without any."""
    rest = ("value", "confidence", "strategy", "evidence", "line_no", "reason")
    rank = lambda c: F.struct(c["confidence"].alias("rank"), (-F.coalesce(c["line_no"], F.lit(-1))).alias("line_rank"), *[c[x].alias(x) for x in rest])
    of = lambda f: F.filter(found, lambda c: (c["field"] == f) & (c["confidence"] >= least))
    return {f: F.array_max(F.transform(of(f), rank)) for f in fields}


def rule_and_model(rules: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, field, value, confidence, source from the best rule candidate and the model's, each (doc_id, field,
    value, confidence, evidence).

    Equal values agree (+0.05, at most 1). Otherwise a value whose evidence speaks against it loses; then the higher
    confidence wins, the rule's on a tie, damped unless one value holds the other or both are close.
    """
    side = lambda df, p: df.select("doc_id", "field", *[F.col(c).alias(f"{p}_{c}") for c in ("value", "confidence", "evidence")])
    both = side(rules, "r").join(side(model, "m"), ["doc_id", "field"], "full_outer")
    r, m, rc, mc = F.col("r_value"), F.col("m_value"), F.col("r_confidence"), F.col("m_confidence")
    d2 = "decimal(6,4)"
    agree = comparison(r) == comparison(m)
    bad_r, bad_m = disqualified(F.col("field"), F.col("r_evidence")), disqualified(F.col("field"), F.col("m_evidence"))
    rule_wins = F.when(bad_r & ~bad_m, False).when(bad_m & ~bad_r, True).otherwise(rc >= mc)
    a, b = comparison(r), comparison(m)
    holds = (F.length(a) >= 3) & (F.length(b) >= 3) & (a.contains(b) | b.contains(a))
    close = ~holds & ((F.least(rc, mc) >= 0.70) | (F.abs(rc.cast(d2) - mc.cast(d2)) <= 0.15))
    damp = lambda c: F.greatest(F.lit(0.35).cast(d2), F.least(c.cast(d2) - F.lit(0.20).cast(d2), F.lit(0.75).cast(d2)))
    won = F.when(rule_wins, rc).otherwise(mc)
    confidence = F.when(m.isNull(), rc.cast(d2)).when(r.isNull(), mc.cast(d2)).when(agree, F.least(F.lit(1).cast(d2), F.greatest(rc, mc).cast(d2) + F.lit(0.05).cast(d2))).when((bad_r == bad_m) & close, damp(won)).otherwise(won.cast(d2))
    source = F.when(m.isNull() & r.isNull(), "none").when(m.isNull(), "rule").when(r.isNull(), "ai").when(agree, "rule+ai").when(rule_wins, "rule").otherwise("ai")
    value = F.when(m.isNull(), r).when(r.isNull(), m).when(agree | rule_wins, r).otherwise(m)
    return both.select("doc_id", "field", value.alias("value"), F.round(confidence, 2).cast("double").alias("confidence"), source.alias("source"))


def passes(values: DataFrame) -> DataFrame:
    """doc_id, field, confidence, status from ``passes`` (array of values found by independent passes) and ``grounded``."""
    n = F.size("passes")
    differ = (n >= 2) & (F.lower(F.trim(F.get("passes", 0))) != F.lower(F.trim(F.get("passes", 1))))
    confidence = F.when(~F.col("grounded"), 0.40).when(n == 0, 0.0).when(differ, 0.60).when(n >= 2, 0.95).otherwise(0.90)
    return values.select("doc_id", "field", confidence.alias("confidence"), F.when(confidence >= 0.90, "verified").otherwise("needs_review").alias("status"))
