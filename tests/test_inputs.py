"""Mixed inputs, overlays, named types, header vendors and fields of runs: edges that the queries don't reach."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillstream.functions import seeds
from quillstream.operators import header_vendors, mixed_input, overlays, run_fields, type_hints
from quillstream.sources import files, office


def words(spark, payload):
    rows = mixed_input.mixed_words(spark.createDataFrame([(1, payload)], "doc_id int, payload string")).collect()
    return [(r.page, r.pos, r.text, r.conf, r.x0, r.y0, r.x1, r.y1, r.line) for r in rows]


@pytest.mark.parametrize("payload", [None, "", "plain text", "7", "null", "[]", "{}", '{"words":5}', '{"pages":[1,{}]}', '[null,1,"x",{"text":null},{"text":"  "}]'])
def test_no_words(spark, payload):
    assert words(spark, payload) == []


def test_malformed_words(spark):
    w = [{"text": 12, "confidence": "high"}, {"text": "a", "confidence": 1e308, "bbox": {"left": -5, "top": "7.9", "width": 3, "height": None}}, {"text": "b", "bbox": {}, "bounding_box": {"left": 2, "width": 2, "y2": 9}}, {"text": "c", "confidence": "inf", "bbox": [1, 2], "line_num": "x"}, {"text": "d", "line_num": -4, "bbox": {"left": "NaN", "top": 3}}]
    got = words(spark, json.dumps({"words": w}))
    assert got == [(1, 0, "12", 100.0, 0.0, 0.0, 0.0, 0.0, 1), (1, 1, "a", 100.0, 0.0, 7.0, 3.0, 7.0, 1), (1, 2, "b", 100.0, 2.0, 0.0, 4.0, 9.0, 1), (1, 3, "c", 100.0, 0.0, 0.0, 0.0, 0.0, 1), (1, 4, "d", 100.0, 0.0, 0.0, 0.0, 0.0, 1)]


def test_texts(spark):
    rows = [(1, None, None), (2, "", None), (3, '"quoted"', None), (4, '{"text":"","words":[{"text":"x"}]}', None), (5, "[1", " y "), (6, '{"text":"t"}', "")]
    got = {r.doc_id: r.text for r in mixed_input.mixed_texts(spark.createDataFrame(rows, "doc_id int, payload string, text string")).collect()}
    assert got == {1: "", 2: "", 3: "quoted", 4: "x", 5: "y", 6: ""}


def test_hints_and_ladder(spark):
    df = spark.createDataFrame([(h, "other", 0.4) for h in (None, "", "auto", "Policy", " nda", "invoice")], "hint string, doc_type string, doc_confidence double")
    got = [(r.doc_type, r.doc_confidence) for r in type_hints.hinted(df, "hint").collect()]
    assert got == [("other", 0.4)] * 3 + [("insurance", 1.0), ("contract", 1.0), ("invoice", 1.0)]
    texts = [(None, None), ("x", "receiptax invoice"), ("x", "CASHIERESUME"), ("a.pdf", "to certify that withdrawal"), ("x" * 10, "nothing")]
    df = spark.createDataFrame(texts, "n string, t string").select(type_hints.ladder(F.col("n"), F.col("t")).alias("l"))
    assert [r.l.type for r in df.collect()] == ["Unknown Document", "Commercial Invoice", "Resume / CV", "Bank Statement", "Unknown Document"]


def test_seeds_fill_a_registry_once(spark):
    empty = spark.createDataFrame([], "canonical_key string, alias string, data_type string, family string, note string")
    full = type_hints.seeded(empty, seeds.aliases(spark), ["alias"])
    assert full.count() == len(seeds.ALIASES) == type_hints.seeded(full, seeds.aliases(spark), ["alias"]).count()
    s = {r.schema_id: r for r in seeds.schemas(spark).collect()}
    assert len(s) == 13 and all(r.fields for r in s.values())
    keys = {f.key: f.canonical_key for f in s["sch_purchase_order_v1"].fields}
    assert keys == {"po_number": "document.reference_number", "order_date": "document.date", "buyer_name": None, "supplier_name": "entity.vendor_name", "total_amount": "financial.total_amount"}
    assert s["sch_bank_statement_v1"].rules[0].rule == "running_balance" and s["sch_bank_statement_v1"].tables[0].columns[-1] == "balance"


def test_overlay_of_nothing(spark):
    field = "map<string, struct<value: string, original_value: string, normalized_value: string, confidence: double, source: string>>"
    one = {"a": ("x", None, None, 0.5, "own")}
    rows = [(1, "invoice", one, {}), (2, "receipt", {}, {"vendor_name": ("v", None, None, 0.9, "rule")}), (3, "odd", one, {"a": ("y", None, None, 0.9, "rule")}), (4, "receipt", {"store_name": (None, None, None, None, None)}, {"vendor_name": ("v", None, "", None, "rule")})]
    got = {r.doc_id: r.fields for r in overlays.overlaid(spark.createDataFrame(rows, f"doc_id int, doc_type string, fields {field}, invoice {field}")).collect()}
    assert got[1]["a"].value == got[3]["a"].value == "x" and not got[1]["a"].taken and got[2] == {}
    assert tuple(got[4]["store_name"]) == ("v", "v", "v", 0.0, "rule", True)


def test_normalised_invoices(spark):
    rows = [(None, None), ("", ""), ("5/6/2024", "$1.50"), ("soon", "free"), ("2024-13-40", "-5-"), ("12", "1.2.3")]
    df = spark.createDataFrame(rows, "d string, a string").select(overlays.normalized_invoice(F.col("d"), F.col("a")).alias("n"))
    got = [(r.n.success, r.n.invoice_date.normalized_value, r.n.total_amount.normalized_value, len(r.n.errors)) for r in df.collect()]
    assert got == [(True, None, None, 0), (False, None, None, 2), (True, "2024-06-05", "1.50", 0), (False, None, None, 2), (False, None, None, 2), (False, None, None, 2)]


def test_vendors_of_nothing_and_of_long_lines(spark):
    rows = [(1, None), (2, ""), (3, "x" * 200 + " Ltd"), (4, "a b c d e f g h Ltd"), (5, "Inc"), (6, "Blue Inc.\nGreen Inc")]
    got = header_vendors.header_vendors(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert [(r.doc_id, r.value) for r in got] == [(5, "Inc"), (6, "Green Inc")]


def test_added_fields(spark):
    runs = spark.createDataFrame([(1, "r1", 5), (1, "r2", 5), (1, "r0", 9)], "document_id int, run_id string, created_at int")
    added = spark.createDataFrame([(1, "A B", None, "date", None, None, "me"), (1, "C", "x@y.org", "email", "Top", "k", "me"), (2, "D", "1", "text", "", "", "me")], "document_id int, label string, value string, data_type string, section string, canonical_key string, reviewer_id string")
    fields, audit, refused = run_fields.added_fields(runs, added)
    assert sorted((r.run_id, r.canonical_key, r.section, r.normalized_value) for r in fields.collect()) == [("r0", "a_b", "Custom Fields", None), ("r0", "k", "Top", "x@y.org")]
    assert audit.count() == 2 and [r.document_id for r in refused.collect()] == [2]


def test_broken_files_give_rows(spark):
    big = "x" * 200_000
    rows = [("/a.csv", f"h,i\n{big},1\n".encode()), ("/b.csv", b"a,b\n" + b"1,2\n" * (files.MOST // 4)), ("/c.xlsx", b"PK\x03\x04 no"), ("/d.docx", b"")]
    got = {r.path: r for r in files.blocks(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert len(got["/a.csv"].text) > 200_000 and got["/b.csv"].error_message == "File is too large"
    assert got["/c.xlsx"].error_message and got["/d.docx"].error_message
    assert {ValueError, TypeError} <= set(office.BROKEN)
