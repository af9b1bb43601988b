"""Plans that hold at size: nothing is broadcast that grows with the input, and pages stay where they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream.functions import normalize as N
from quillstream.operators import answers, exclusions, extract, grounding, insights, reconcile, spatial, typed_fields
from quillstream.plans import page_queries
from quillstream.sources.shared import spread, tasks

WORDS = "doc_id long, page int, pos int, text string, conf double, x0 double, y0 double, x1 double, y1 double, block int, line int"
ROWS = [(1, 1, 0, "Invoice No:", 96.0, 50.0, 100.0, 130.0, 112.0, None, None), (1, 1, 1, "~", 20.0, 135.0, 100.0, 195.0, 112.0, None, None), (1, 1, 2, "INV-7", 90.0, 210.0, 101.0, 300.0, 113.0, None, None), (1, 1, 3, "Grand Total", 93.0, 50.0, 300.0, 140.0, 312.0, None, None), (1, 1, 4, "$9.50", 80.0, 400.0, 302.0, 520.0, 314.0, None, None)]

WORDS_OF = [c.split()[0] for c in WORDS.split(", ")[2:]]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_of_pages_without_join_or_shuffle(spark):
    words = spark.createDataFrame(ROWS, WORDS)
    got = spatial.number_candidates(words, "Invoice No")
    assert [(r.strategy, r.value) for r in got.collect()] == [("right", "INV-7")]
    assert "Join" not in plan(got)
    assert "Exchange" not in plan(spatial.number_candidates(words.groupBy(F.lit(1).alias("doc_id"), "page").agg(F.array_sort(F.collect_list(F.struct(*words.columns[2:]))).alias("w")).transform(_stored), "Invoice No"))


def _stored(df):
    """The rows without the plan that made them."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def test_values_meet_their_blocks_without_broadcast(spark):
    values = spark.createDataFrame([(1, "a", "acme works", "", 1), (1, "b", "zebra", "", 1), (2, "c", "x", "", 1)], "doc_id long, field string, value string, quote string, page int")
    blocks = spark.createDataFrame([(1, "b0", 1, 0, "Acme Work5", 0.0, 0.0, 1.0, 1.0)], "doc_id long, block_id string, page int, pos int, text string, x0 double, y0 double, x1 double, y1 double")
    got = grounding.ground(values, blocks, parts=3)
    assert "Broadcast" not in plan(got) and plan(got).count("SortMergeJoin") == 1
    assert {(r.field, r.block_id, r.match_score) for r in got.collect()} == {("a", "b0", 0.9), ("b", None, 0.0), ("c", None, 0.0)}


def test_a_number_with_its_year_is_no_phone_number(spark):
    rows = spark.createDataFrame([("INV-2024-00000001",), ("555-123-4567",), ("15551234567",)], "v string")
    told = [r.n for r in rows.select(F.size(exclusions.reasons("invoice_number", F.col("v"), F.lit("Invoice Number"), F.lit(True))).alias("n")).collect()]
    assert told == [0, 1, 1]


def test_partitions_grow_with_the_rows(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks(spark.range(10), 5) == least
    assert tasks(spark.range(5 * least + 1), 5) == least + 1
    assert "REPARTITION_BY_NUM" in plan(insights.profile(spark.range(10)))


def test_a_document_keeps_its_candidates(spark):
    docs = spark.createDataFrame([(1, "Acme Works Ltd\nInvoice No: A-17\nInvoice Date:\n01/02/2024\nSubtotal: $4.00\nTax total: $1.00\nGrand Total: $5.00"), (2, None), (3, "Vendor: X\nVendor: Y")], "doc_id long, text string")
    fields = list(extract.KEYWORDS)
    kept = extract.found(docs).select("doc_id", *[c.alias(f) for f, c in reconcile.best_of(F.col("found"), fields).items()])
    assert "Exchange" not in plan(kept)
    got = {(r.doc_id, f, r[f].value, r[f].confidence, r[f].line_no) for r in kept.collect() for f in fields if r[f]}
    assert got == {(r.doc_id, r.field, r.value, r.confidence, r.line_no) for r in reconcile.best_candidates(extract.candidates(docs)).collect()}
    assert {(d, f, v) for d, f, v, *_ in got} == {(1, "vendor_name", "Acme Works Ltd"), (1, "invoice_number", "A-17"), (1, "invoice_date", "01/02/2024"), (1, "total_amount", "$5.00"), (3, "vendor_name", "X")}


def test_open_fields_of_a_document_in_one_shuffle(spark):
    found = spark.createDataFrame([(1, "Total", "Sum"), (1, None, None), (3, "a", "b")], "doc_id long, key string, label string")
    rows = spark.createDataFrame([(1, 2, "x", "Sum", "1"), (1, 1, " TOTAL", "T", "1"), (1, 3, None, "Ship Via", "air"), (1, 4, "ship_via", "Other", "2"), (2, 1, "k", None, "v"), (2, 2, "z", "Z", None)], "doc_id long, pos int, key string, label string, value string").withColumns({"section": F.lit(None).cast("string"), "data_type": F.lit(None).cast("string")})
    got = answers.open_fields(found, rows)
    assert "Join" not in plan(got) and plan(got).count("Exchange") == 1
    assert sorted((r.doc_id, r.key, r.label) for r in got.collect()) == [(1, "ship_via", "Ship Via"), (2, "k", "K")]


def test_values_of_a_document_merge_in_one_shuffle(spark):
    kind = "doc_id long, field string, value string, confidence double"
    rules = spark.createDataFrame([(1, "store_name", "s1", 0.75), (2, "due_date", "03/04/2024", 0.5), (3, "candidate_name", None, 0.6)], kind)
    model = spark.createDataFrame([(1, "vendor_name", "S1", 0.8), (3, "full_name", "Q", 0.5), (3, "person_name", "P", 0.0), (4, "name", "N", None)], kind)
    types = spark.createDataFrame([(1, "Receipt"), (2, "Receipt"), (3, "cv")], "doc_id long, doc_type string")
    got = answers.merged(rules, model, types)
    assert "Join" not in plan(got) and plan(got).count("Exchange") == 1
    want = {(1, "store_name", "S1", 0.85, "rule+ai"), (1, "vendor_name", "S1", 0.8, "ai"), (2, "due_date", "2024-04-03", 0.5, "rule"), (3, "candidate_name", "P", 0.9, "ai"), (3, "full_name", "Q", 0.5, "ai"), (3, "person_name", "P", 0.9, "ai"), (4, "name", "N", 0.9, "ai")}
    assert {(r.doc_id, r.field, r.normalized_value, r.confidence, r.source) for r in got.collect()} == want


def test_parts_of_no_date_give_null(spark):
    rows = spark.createDataFrame([("31/02/2024",), ("2024-13-01",), ("1 May 24",), ("May 1, 2024",), ("05/06/2024",), ("",), (None,)], "v string")
    assert [str(r.d) for r in rows.select(N.date_day_first(F.col("v")).alias("d")).collect()] == ["None", "None", "2024-05-01", "2024-05-01", "2024-06-05", "None", "None"]


def test_typed_values_are_made_once(spark):
    docs = _stored(spark.createDataFrame([(1, "receipt", "Shop\nReceipt # 5\n1999-01-02\nTotal paid: 7.50")], "doc_id long, doc_type string, text string"))
    got = typed_fields.typed_fields(docs).where("value is not null")
    assert not [x for x in plan(got).split("\n") if "Filter" in x and "regexp_extract_all" in x]
    assert {(r.field, r.value) for r in got.collect()} == {("store_name", "Shop"), ("receipt_number", "5"), ("receipt_date", "1999-01-02"), ("total_amount", "7.50")}


def test_lines_are_sorted_without_a_comparing_function(spark):
    assert "sort_array" in plan(spatial.lines_of_bare_words(spark.createDataFrame(ROWS, WORDS)))


def test_totals_and_geometry_of_pages_without_shuffle(spark):
    page = _stored(spark.createDataFrame(ROWS, WORDS).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct(*WORDS_OF))).alias("w")))
    got = spatial.total_candidates(page)
    assert "Exchange" not in plan(got) and "Join" not in plan(got)
    assert [r.value for r in got.collect()] == ["9.50"]


def test_rows_are_dealt_out_without_a_sort(spark, tmp_path):
    keys = [*range(1000), None]
    spark.createDataFrame([(k, float(k or 0), f"s{k}") for k in keys], "o_orderkey long, o_totalprice double, o_orderstatus string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = page_queries.page_geometry(spark, str(tmp_path))
    assert not [x for x in ("RoundRobin", "Sort", "Aggregate", "Join") if x in plan(got)] and got.count() == len(keys)
    dealt = spread(spark.read.parquet(f"{tmp_path}/orders.parquet"), "o_orderkey")
    cores = spark.sparkContext.defaultParallelism
    assert "RoundRobin" not in plan(dealt) and dealt.rdd.getNumPartitions() == cores
    assert sorted(map(str, dealt.select("o_orderkey").toPandas()["o_orderkey"].astype("Int64"))) == sorted("<NA>" if k is None else str(k) for k in keys)
    assert max(len(p) for p in dealt.rdd.glom().collect()) < 2 * len(keys) / cores
