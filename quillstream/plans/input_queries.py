"""Queries over mixed inputs, merged fields, named types and header lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream.functions import seeds
from quillstream.operators import header_vendors, mixed_input, overlays, type_hints
from quillstream.plans.queries import query
from quillstream.plans.tables import table


def _key(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate", "o_totalprice", "o_orderpriority")


def _turn(values: list, n: int | None = None):
    """The value of ``values`` that the document's key picks, in turn."""
    values = [v if hasattr(v, "cast") else F.lit(v) for v in values]
    return F.element_at(F.array(*values), (F.col("doc_id") % (n or len(values)) + 1).cast("int"))


def mixed_documents(spark, sf_dir):
    """doc_id, payload, text: orders as plain text, lists of words, and objects, whole and malformed, in turn."""
    filled = lambda form: F.replace(F.lit(form), F.lit("<k>"), F.col("doc_id").cast("string"))
    forms = [
        "Total for <k>",
        '[{"text":"No","confidence":"91.5","line_num":1,"bbox":{"left":"10","top":5.9,"width":20,"height":8}},{"text":" <k> ","confidence":-3,"line_num":"2"},{"text":"","confidence":5},7,{"confidence":50},{"text":"x","confidence":"NaN","line_num":0,"bbox":{"left":"oops","top":4}}]',
        '{"text":"given <k>","words":[{"text":"w","bounding_box":{"left":1,"top":2,"width":3,"height":4,"x2":9}}]}',
        '{"words":[{"text":"b","line_num":2},{"text":"a","line_num":1},{"text":<k>,"confidence":150}]}',
        '{"pages":[{"page_number":2,"words":[{"text":"two"}]},{"page_number":1,"words":[{"text":"own"},{"text":"p2","line_num":3}]},{"page_number":2,"words":[{"text":"again"}]},{"words":[]}]}',
        '{"combined_text":"joined <k>","text":"other"}',
        '{"text": <k>',
    ]
    return _key(spark, sf_dir).select("doc_id", _turn([filled(f) for f in forms]).alias("payload"), F.when(F.col("doc_id") % 10 == 0, " apart ").alias("text"))


@query
def mixed_words(spark, sf_dir):
    return mixed_input.mixed_words(mixed_documents(spark, sf_dir))


@query
def mixed_texts(spark, sf_dir):
    return mixed_input.mixed_texts(mixed_documents(spark, sf_dir))


@query
def overlaid_fields(spark, sf_dir):
    """Fields of invoices, receipts, statements and other documents after the invoice extractor's values are laid over them."""
    k = F.col("doc_id")
    part = lambda value, normalized, confidence, source: F.struct(value.cast("string").alias("value"), F.lit(None).cast("string").alias("original_value"), normalized.cast("string").alias("normalized_value"), confidence.cast("double").alias("confidence"), F.lit(source).alias("source"))
    null = F.lit(None)
    own = {"vendor_name": part(F.concat(F.lit("own "), k), null, F.lit(0.8), "multi"), "total_amount": part(F.when(k % 3 != 0, "10"), null, F.lit(0.6), "multi"), "store_name": part(F.when(k % 2 == 0, "").otherwise("Shop"), null, F.lit(0.95), "multi"), "memo": part(F.lit("m"), null, F.lit(0.5), "multi")}
    invoice = {"vendor_name": part(F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("V"), k)), null, F.when(k % 7 == 0, 0.0).otherwise(0.9), "rule"), "total_amount": part(F.concat(F.lit("$"), k), F.concat(k, F.lit(".00")), F.lit(0.7), "rule"), "invoice_date": part(F.lit("1/2/2024"), F.lit("2024-02-01"), F.lit(0.9), "rule")}
    as_map = lambda d: F.map_from_arrays(F.array(*[F.lit(n) for n in d]), F.array(*d.values()))
    docs = _key(spark, sf_dir).select("doc_id", _turn(["invoice", "receipt", "bank_statement", "general"]).alias("doc_type"), as_map(own).alias("fields"), as_map(invoice).alias("invoice"))
    return overlays.overlaid(docs).select("doc_id", F.explode("fields").alias("field", "f")).select("doc_id", "field", "f.*")


@query
def normalized_invoices(spark, sf_dir):
    """Both halves of an invoice, given as text or as an object, normalised together."""
    d, a = F.col("o_orderdate"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    day = _turn([quoted(F.date_format(d, "dd/MM/yyyy")), F.concat(F.lit('{"value":"'), F.date_format(d, "d MMM yyyy"), F.lit('"}')), F.lit("null"), F.lit('" "'), F.lit('{"original_value":"TBD","normalized_value":"x"}'), F.lit('"31/02/2024"'), F.lit('{"value":null,"original_value":"1/1/2024"}')])
    total = _turn([F.concat(F.lit('{"value":"₹'), a, F.lit('"}')), a, F.lit('"--5"'), F.lit('"12,3"'), F.lit('""')])
    v = F.parse_json(F.concat(F.lit('{"invoice_date":'), day, F.lit(',"total_amount":'), total, F.lit("}")))
    part = lambda n: overlays.raw_text(F.try_variant_get(v, f"$.{n}", "variant"))
    rows = _key(spark, sf_dir).select("doc_id", part("invoice_date").alias("d"), part("total_amount").alias("a"))
    n = rows.select("doc_id", overlays.normalized_invoice(F.col("d"), F.col("a")).alias("n"))
    return n.select("doc_id", "n.success", F.col("n.invoice_date.normalized_value").alias("invoice_date"), F.col("n.total_amount.normalized_value").cast("double").alias("total_amount"), F.array_join("n.errors", "; ").alias("errors"))


@query
def hinted_types(spark, sf_dir):
    docs = _key(spark, sf_dir).select("doc_id", F.lower("o_orderpriority").alias("doc_type"), F.lit(0.7).alias("doc_confidence"), _turn([None, "AUTO", " CV ", "Bill", "nonsense", "receipt", "Passport"]).alias("hint"))
    return type_hints.hinted(docs, "hint").select("doc_id", "doc_type", "doc_confidence")


@query
def fallback_types(spark, sf_dir):
    """Types by the first words that tell of one, over names of files and the corpus."""
    d = table(spark, sf_dir, "documents").withColumn("name", _turn(["cv.pdf", "Tax Invoice 7.pdf", "scan.png", None, "certify that.txt", "receipT.docx"]))
    return d.select("doc_id", type_hints.ladder(F.col("name"), F.col("text")).alias("t")).select("doc_id", F.col("t.type").alias("doc_type"), "t.family", "t.confidence")


@query
def seeded_aliases(spark, sf_dir):
    """A registry that holds aliases of its own, some of them seeds, and the seeds that it lacks."""
    names = [a for _, a, _, _ in seeds.ALIASES]
    k = F.col("s_suppkey")
    own = table(spark, sf_dir, "supplier").select(F.concat(F.lit("custom."), k).alias("canonical_key"), F.when(k <= 10, F.element_at(F.array(*[F.lit(n) for n in names]), k.cast("int") % len(names) + 1)).otherwise(F.concat(F.lit("supplier_"), k)).alias("alias"))
    return type_hints.seeded(own, seeds.aliases(spark), ["alias"]).select("canonical_key", "alias")


@query
def seeded_fields(spark, sf_dir):
    """Fields of the seeded schemas for the orders' types, after a registry that has one of them already is seeded."""
    kinds = _key(spark, sf_dir).select(_turn(["Commercial Invoice", "Resume / CV", "Certificate", "Purchase Order"]).alias("name")).groupBy("name").agg(F.count("*").alias("documents"))
    own = spark.createDataFrame([("sch_resume_v1", "Resume / CV", "own")], "schema_id string, name string, family string")
    registry = type_hints.seeded(own, seeds.schemas(spark).select("schema_id", "name", "family", "fields"), ["schema_id"])
    fields = seeds.schemas(spark).select("schema_id", F.explode("fields").alias("f"))
    return kinds.join(F.broadcast(registry), "name").join(F.broadcast(fields), "schema_id").groupBy("name", "family", "documents").agg(F.count("*").alias("n_fields"), F.count("f.canonical_key").alias("n_canonical"))


@query
def vendor_candidates(spark, sf_dir):
    """Suppliers' names in header lines, told by endings and by the addresses after them."""
    k = F.col("doc_id")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"))
    text = _turn([F.concat(F.lit("Acme "), k, F.lit(" Ltd\nfirst\nsecond")), F.lit("TAX INVOICE\nGreen Leaf\n\nPlot 5, MG Road\nInvoice No: 5"), F.lit("Hello world.\nplain words\nx\n\nGSTIN: 27"), F.lit("Vendor: Foo Ltd\nNorth Co 12345\nDate 2024-01-05"), F.lit("a b\nc d")])
    return header_vendors.header_vendors(s.select("doc_id", text.alias("text")))
