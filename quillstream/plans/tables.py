"""The driver's tables in the roles of the engine's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.sources.shared import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dashboard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: document_id, status, file_type, uploaded_at, confidence (null for every 11th)."""
    status = F.when(F.col("o_orderstatus") == "F", "VERIFIED").when(F.col("o_orderstatus") == "O", "NEEDS_REVIEW").otherwise("PROCESSING")
    kind = F.when(F.col("o_orderkey") % 13 == 0, "").otherwise(F.col("o_orderpriority"))
    confidence = F.when(F.col("o_orderkey") % 11 != 0, ((F.col("o_orderkey") % 101).cast("decimal(10,2)") / 100).cast("decimal(6,2)"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), status.alias("status"), kind.alias("file_type"), F.col("o_orderdate").alias("uploaded_at"), confidence.alias("confidence"), "o_custkey")


def western(amount):
    """Decimal as text with groups of three."""
    return F.format_number(amount.cast("decimal(18,2)"), 2)


def rendered_invoices(spark: SparkSession, sf_dir: str, series: str = "INV-24-", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text: each order as an invoice. Every tenth has no vendor line, every seventh a total of 0;
    ``series`` begins its number, and columns of the order named in ``keep`` follow."""
    k = F.col("o_orderkey")
    vendor = F.concat(F.lit("Vendor: Acme Works "), k.cast("string"), F.lit(" Ltd"))
    total = F.when(k % 7 == 0, F.lit(0).cast("decimal(18,2)")).otherwise(F.col("o_totalprice").cast("decimal(18,2)"))
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    lines = F.array_compact(F.array(
        F.lit("TAX INVOICE"), F.when(k % 10 != 0, vendor), F.lit(""),
        F.concat(F.lit(f"Invoice  Number: {series}"), F.lpad(k.cast("string"), 8, "0")),
        F.concat(F.lit("Due Date: "), F.date_format(F.date_add("o_orderdate", 30), "dd/MM/yyyy")),
        F.when(k % 3 == 0, F.lit("Invoice Date:")), F.when(k % 3 == 0, day).otherwise(F.concat(F.lit("Invoice Date: "), day)),
        F.concat(F.lit("Bill To: Customer "), F.col("o_custkey").cast("string")),
        F.concat(F.lit("Subtotal: $"), western(total - 1)),
        F.concat(F.lit("Grand Total: $"), western(total)),
    ))
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").select(k.alias("doc_id"), F.array_join(lines, "\n").alias("text"), *keep)


def rendered_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a line "Invoice Number: N-<key>" and a line with the date, 50 wide, as text recognition gives them; every
    third order has a speck between."""
    k = F.col("o_orderkey")
    word = lambda line, no, text, conf: F.struct(F.lit(line).alias("line"), F.lit(no).alias("word_no"), text.alias("text"), F.lit(conf).alias("conf"), F.lit(no * 50.0).alias("x0"), F.lit(line * 20.0).alias("y0"), F.lit(no * 50.0 + 40).alias("x1"), F.lit(line * 20.0 + 10).alias("y1"))
    words = F.array(word(1, 0, F.lit("Invoice"), 96.0), word(1, 1, F.lit("Number:"), 92.0), word(1, 2, F.when(k % 3 == 0, "~").otherwise(""), 4.0), word(1, 3, F.concat(F.lit("N-"), k.cast("string")), 88.0), word(2, 4, F.date_format("o_orderdate", "yyyy-MM-dd"), 80.0))
    rows = table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.explode(words).alias("w")).select("doc_id", F.lit(1).alias("page"), F.lit(1).alias("block"), "w.*")
    return rows.withColumn("pos", F.col("word_no"))


def scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, w (words in reading order) of a scanned page of each order: a tax number, "Invoice No:" with its number to the right, below
    or too far off, and a total far to the right. Boxes are off by some pixels; only every 13th page has line numbers."""
    k = F.col("o_orderkey")
    n = lambda c: c.cast("double") if hasattr(c, "cast") else F.lit(float(c))
    tax_number = F.lit("27ABCDE1234F1Z5")

    def word(line, text, conf, x, y, width):
        text = text if hasattr(text, "cast") else F.lit(text)
        return F.struct(F.lit(line).alias("line"), text.alias("text"), n(conf).alias("conf"), n(x).alias("x0"), n(y).alias("y0"), (n(x) + width).alias("x1"), (n(y) + 12).alias("y1"))

    at_right, under, aside = k % 4 == 0, k % 4 == 1, k % 4 == 2
    x = F.when(at_right, 210 + k % 5 * 60).when(under, 50 + k % 6 * 30).when(aside, 130 + k % 3 * 90).otherwise(210)
    y = F.when(at_right, 101).when(under, 112 + k % 5 * 40).when(aside, 130).otherwise(99)
    total = F.when(k % 11 == 0, F.lit(0).cast("decimal(18,2)")).otherwise(F.col("o_totalprice").cast("decimal(18,2)"))
    words = F.array(
        word(1, "Acme", 97, 50, 30, 50), word(1, "Works", 95, 105, 31 + k % 3, 55),
        word(2, "GSTIN:", 90, 50, 60, 60), word(2, tax_number, 88, 120, 61, 140),
        word(3, "Invoice No:", 96, 50, 100, 80), word(3, F.when(k % 7 == 0, "2024-01-05").otherwise("~"), 20, 135, 100, 60),
        word(3, F.when(k % 4 == 3, tax_number).otherwise(F.concat(F.lit("INV-"), k)), 60 + k % 40, x, y, 90),
        word(4, "Grand Total", 93, 50, 300, 90), word(4, "Tax", 80, 200, 300, 30), word(4, F.concat(F.lit("₹"), western(total)), 70 + k % 30, 400 + k % 3 * 100, 302, 120),
        word(4, "05/06/2024", 75, 760, 299, 90),
    )
    numbered = k % 13 == 0
    each = F.transform(words, lambda w, i: F.struct(i.alias("pos"), *[w[c].alias(c) for c in ("text", "conf", "x0", "y0", "x1", "y1")], F.when(numbered, 1).alias("block"), F.when(numbered, w["line"]).alias("line")))
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").select(k.alias("doc_id"), F.lit(1).alias("page"), each.alias("w"))


def scanned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of ``scanned_pages``, one a row."""
    return scanned_pages(spark, sf_dir).select("doc_id", "page", F.explode("w").alias("w")).select("doc_id", "page", "w.*")
