from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from quillstream.functions import normalize as N
from quillstream.functions import text as T
from quillstream.operators import extract, grounding, reconcile, validate


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("text", ["05/09/2026", "05-09-2026", "5/9/2026", "05.09.2026", "2026-09-05", "2026/09/05", "Sep 5, 2026", "5 September 2026", "5-Sep-2026", "5th September 2026", "Invoice Date: 05/09/2026", "05/09/2026 14:30:00"])
def test_dates(spark, text):
    assert one(spark, N.date_day_first, text) == datetime.date(2026, 9, 5)


@pytest.mark.parametrize(("text", "day"), [("4 NOVEMBRE 2019", (2019, 11, 4)), ("LUN 4 NOVEMBRE 2019", (2019, 11, 4)), ("9 février 2022", (2022, 2, 9)), ("30 août 2021", (2021, 8, 30)), ("6 de mayo de 2020", (2020, 5, 6)), ("31 Oktober 2017", (2017, 10, 31)), ("03/04/2024", (2024, 4, 3))])
def test_dates_in_other_languages(spark, text, day):
    assert one(spark, N.date_day_first, text) == datetime.date(*day)


@pytest.mark.parametrize("text", ["30/02/2025", "29/02/2023", "77/88/2025", "10/45/2025", "00/06/2025", "no day", "later", "", None])
def test_bad_dates(spark, text):
    assert one(spark, N.date_day_first, text) is None


@pytest.mark.parametrize(("text", "amount"), [("₹31,700", 31700), ("Rs. 31,700", 31700), ("INR 31,700", 31700), ("31700", 31700), ("₹ 31700/-", 31700), ("Total: ₹31,700.00", 31700), ("$4,075.00", 4075), ("€812.40", 812.40), ("-₹640.00", -640), ("₹-640.00", -640), ("-Rs. 640", -640), ("(640.00)", -640), ("(₹31,700)", -31700), ("3,17,000", 317000), ("31,70,000.25", 3170000.25), ("3,170,000.25", 3170000.25), ("31700.128", 31700.13)])
def test_amounts(spark, text, amount):
    assert float(one(spark, N.amount, text)) == amount


@pytest.mark.parametrize("text", ["₹xy", "1.2.3", "₹", "Rs.", "₹ 31,70,00", "-₹-640", "31,70,00,abc", "n/a", "", None])
def test_bad_amounts(spark, text):
    assert one(spark, N.amount, text) is None


def test_typed_values(spark):
    assert one(spark, N.money, "8.140,25 €") == 8140.25
    assert one(spark, N.money, "₹ 8,14,000.75") == 814000.75
    assert one(spark, N.percent, "18%") == one(spark, N.percent, "0.18") == 18.0
    assert one(spark, N.email, " Eva.Holm@Example.ORG ") == "eva.holm@example.org"
    assert one(spark, N.phone, "+1 (555) 871-2046") == "+15558712046"
    assert one(spark, N.boolean, "yes") is True and one(spark, N.boolean, "No") is False
    assert one(spark, N.identifier, " #0070881. ") == "0070881"


def test_text(spark):
    assert one(spark, T.masked, "abcd12345wxyz") == "abcd...wxyz"
    assert one(spark, T.comparison, " INV 001! ") == "inv001"


INVOICE = "Norden Glass Works Ltd\n7 Quay Lane\nTAX INVOICE\nInvoice Number: NGW-7/2025-88\nInvoice Date: 03/11/2025\nDue Date: 17/11/2025\nBill To:\nHolm & Sons Inc\nSubtotal: $812.40\nTax (10%): $81.24\nGrand Total: $893.64"


def test_invoice_text(spark):
    docs = spark.createDataFrame([(1, INVOICE)], "doc_id bigint, text string")
    best = {r.field: r.value for r in reconcile.best_candidates(extract.candidates(docs)).collect()}
    assert best["vendor_name"] == "Norden Glass Works Ltd"
    assert best["invoice_number"] == "NGW-7/2025-88"
    assert best["invoice_date"] == "03/11/2025"
    assert best["total_amount"] == "$893.64"


def test_grounding(spark):
    blocks = spark.createDataFrame([(1, 0, "b0", 1, "Vendor: Holm Glass Trading Ltd", 50.0, 50.0, 300.0, 70.0), (1, 1, "b1", 1, "Invoice Number: HG-40417", 50.0, 80.0, 250.0, 100.0)], "doc_id bigint, pos int, block_id string, page int, text string, x0 double, y0 double, x1 double, y1 double")
    values = spark.createDataFrame([(1, "vendor", "Holm Glass Trading Ltd", "Holm Glass Trading", 1), (1, "number", "HG-40417", "", 1), (1, "none", "Zebra Co", "a seller nobody named", 1)], "doc_id bigint, field string, value string, quote string, page int")
    got = {r.field: (r.block_id, r.grounded, r.bbox) for r in grounding.ground(values, blocks).collect()}
    assert got["vendor"] == ("b0", True, [50.0, 50.0, 300.0, 70.0])
    assert got["number"][:2] == ("b1", True)
    assert got["none"] == (None, False, [0.0] * 4)


def test_threshold_is_inclusive(spark):
    df = spark.range(1)
    for c, status in ((0.85, "VERIFIED"), (0.849, "NEEDS_REVIEW")):
        got = df.select(validate.route(F.array().cast("array<string>"), {"a": F.lit(c)})[0]).first()[0]
        assert got == status


def test_field_dispatch(spark):
    rows = [("14/08/2024", "date", "2024-08-14", True), ("$1,250.50", "money", "1250.5", True), ("18%", "percent", "18.0", True), ("abc", "number", None, False), ("", "date", None, True), (None, "money", None, True), ("x", "email", "x", False), (" hi ", "text", "hi", True)]
    df = spark.createDataFrame(rows, "v string, t string, want string, ok boolean").select("want", "ok", N.field(F.col("v"), F.col("t")).alias("f"))
    for r in df.collect():
        assert (r.f.value, r.f.valid) == (r.want, r.ok) and (r.f.error is None) == r.ok


def test_headers_and_items(spark):
    from quillstream.operators import structure

    df = spark.createDataFrame([(["Amount", "", "Amount", "Unnamed: 3", None, " Amount "],)], "h array<string>")
    assert df.select(structure.header_names(F.col("h"))).first()[0] == ["Amount", "column_2", "Amount_2", "column_4", "column_5", "Amount_3"]
    rec = spark.createDataFrame([(1, {"total": ("5", None, "5.00", 0.9, "rule"), "x": ("raw", "orig", None, None, "ai")})], "document_id int, fields map<string, struct<value: string, original_value: string, normalized_value: string, confidence: double, source: string>>")
    assert sorted(tuple(r) for r in structure.review_items(rec).collect()) == [(1, "total", "5.00", "5", 0.9, "rule"), (1, "x", "raw", "orig", None, "ai")]
