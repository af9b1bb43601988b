"""Queries over runs, tables that batches merge into, files written and read again, and fields of runs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.operators import run_fields, schemas, structure
from quillstream.plans.queries import query
from quillstream.plans.tables import table
from quillstream.sources import files, office
from quillstream.sources.shared import new_folder, tasks
from quillstream.streaming import runs
from quillstream.streaming.sinks import KeyedTable, replace_partitions


def run_events(spark, sf_dir):
    """Events as those of runs: a user's day is a run, the event's number tells the stage; FAILED and unknown ones among them."""
    e = table(spark, sf_dir, "events").where("user_id is not null")
    pick = F.element_at(F.array(*[F.lit(s) for s in (*runs.STAGES, "FAILED", "ODD", "UPLOADED", "INGESTION", "CLASSIFYING", "EXTRACTING")]), (F.col("event_id") % 15 + 1).cast("int"))
    run = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return e.select(run.alias("run_id"), pick.alias("stage"), F.when(F.col("event_id") % 2 == 0, "VERIFIED").otherwise("NEEDS_REVIEW").alias("status"), F.concat(F.lit("m"), F.col("event_id") % 7).alias("message"), F.col("ts").cast("timestamp").alias("at"))


@query
def run_stages(spark, sf_dir):
    """The state of each run; open ones that were silent for half an hour before the last event of all have failed."""
    e = run_events(spark, sf_dir)
    now = table(spark, sf_dir, "events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    return runs.run_states(e, now).select("run_id", "stage", "status", "message", "seconds", "n_stages")


@query
def keyed_merge(spark, sf_dir):
    """Events merged by user and type into a keyed table, in three batches, the second of which comes twice."""
    e = table(spark, sf_dir, "events").where("user_id is not null").select("user_id", "event_type", "event_id", F.col("value").cast("decimal(18,2)").cast("double").alias("value"))
    kept = KeyedTable(spark, new_folder(spark, "keyed"), ["user_id", "event_type"], ["event_id"], buckets=8)
    for batch in (0, 1, 1, 2):
        kept.apply(e.where(F.col("event_id") % 3 == batch), batch)
    return kept.read()


@query
def partition_overwrite(spark, sf_dir):
    """Orders by status, of which one status is written anew, twice."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    path = new_folder(spark, "partitions")
    replace_partitions(o, path, ["o_orderstatus"])
    for _ in range(2):
        replace_partitions(o.where("o_orderstatus = 'O' and o_orderkey % 2 = 0").withColumn("o_orderpriority", F.lit("new")), path, ["o_orderstatus"])
    return spark.read.schema(o.schema).parquet(path)


@query
def file_types(spark, sf_dir):
    """Pages behind the signatures of several types of files: type, status and message of each."""
    p = table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    k, html = F.col("page_id"), F.col("html").cast("binary")
    raw = lambda digits: F.unhex(F.lit(digits))
    kinds = [F.concat(F.lit("%PDF-1.7 ").cast("binary"), html), F.concat(raw("89504E470D0A1A0A"), html), F.concat(raw("FFD8FF"), html), F.concat(raw("504B0304"), html, F.lit(" xl/workbook.xml").cast("binary")), F.lit("a,b\n1,2").cast("binary"), F.concat(raw("00"), html), F.lit("").cast("binary"), F.lit("word").cast("binary")]
    content = F.element_at(F.array(*kinds), (k % len(kinds) + 1).cast("int"))
    f = p.select(F.concat(F.lit("/in/"), k, F.when(k % 16 == 7, ".csv").otherwise(".dat")).alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))
    return files.documents(f).select("file_name", "file_type", "file_size", "status", "error_message")


@query
def csv_round_trip(spark, sf_dir):
    """Suppliers written as quoted text and read again."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("s_suppkey"), F.concat(F.lit('the "'), F.col("s_name"), F.lit('", ltd')).alias("s_name"), F.col("s_acctbal").cast("decimal(12,2)").cast("string").alias("s_acctbal"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey").cast("string")).alias("s_nationkey"))
    path = new_folder(spark, "csv")
    files.write_csv(s, path)
    return spark.read.schema(s.schema).option("header", True).option("escape", '"').option("nullValue", "").csv(path)


@query
def delimited_files(spark, sf_dir):
    """A file of suppliers for each nation, with its own delimiter, written to the shared folder and read by their own form."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_name")
    mark = F.element_at(F.array(*[F.lit(m) for m in (",", ";", "\t", "|")]), (F.col("s_nationkey") % 4 + 1).cast("int"))
    line = F.concat_ws("", F.col("s_suppkey").cast("string"), mark, F.lit('"'), F.col("s_name"), F.lit(', x"'), mark)
    body = s.select("s_nationkey", mark.alias("mark"), line.alias("line")).groupBy("s_nationkey", "mark").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("body"))
    path = new_folder(spark, "delimited")
    text = F.concat(F.lit("key"), F.col("mark"), F.lit("name"), F.col("mark"), F.lit("name\n"), F.col("body"), F.lit("\n"), F.col("mark"), F.col("mark"))
    body.select("s_nationkey", text.alias("value")).repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    rows = files.delimited_rows(files.read_files(spark, path))
    return rows.select(F.regexp_extract("path", r"s_nationkey=(\d+)", 1).cast("int").alias("nation"), F.array_join("headers", "|").alias("headers"), F.array_join("cells", "|", "-").alias("cells"))


@query
def decoded_files(spark, sf_dir):
    """Names in several encodings, decoded by what their bytes are."""
    k = F.col("s_suppkey")
    name = F.concat(F.col("s_name"), F.lit(" é"))
    raw = F.when(k % 3 == 0, F.encode(name, "UTF-8")).when(k % 3 == 1, F.encode(name, "ISO-8859-1")).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode(name, "UTF-8")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", files.decoded(raw).alias("name"))


def _packed(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _workbooks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    main, rel = office.MAIN.strip("{}"), office.LINK.removeprefix("{").removesuffix("}id")
    for f in frames:
        made = [
            _packed({
                "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S{k % 3}" sheetId="1" r:id="r1"/></sheets></workbook>',
                "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
                "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>{name}</t></si></sst>',
                "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>{k}</v></c></row><row r="2"><c r="AB2" t="b"><v>1</v></c></row></sheetData></worksheet>',
            }) if k % 7 else b"PK no package"
            for k, name in zip(f["k"], f["name"], strict=True)
        ]
        yield pd.DataFrame({"path": [f"/in/{k}.xlsx" for k in f["k"]], "content": made})


def _word_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    word = office.WORD.strip("{}")
    for f in frames:
        made = [_packed({"word/document.xml": f'<w:document xmlns:w="{word}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>{name}</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>key</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>{k}</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'}) for k, name in zip(f["k"], f["name"], strict=True)]
        yield pd.DataFrame({"path": [f"/in/{k}.docx" for k in f["k"]], "content": made})


def _named_suppliers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.regexp_replace("s_name", "[<>&]", "").alias("name"))


@query
def workbook_cells(spark, sf_dir):
    """Cells of a workbook for each supplier; every seventh file is broken and gives a message."""
    cells = office.spreadsheet_cells(_named_suppliers(spark, sf_dir).mapInPandas(_workbooks, "path string, content binary"))
    return cells.select("path", "sheet", "row_idx", "col_idx", "value", F.col("error_message").isNotNull().alias("broken"))


@query
def word_blocks(spark, sf_dir):
    """Headings and tables of a word document for each supplier."""
    return files.blocks(_named_suppliers(spark, sf_dir).mapInPandas(_word_files, "path string, content binary"))


@query
def review_item_rows(spark, sf_dir):
    """A row for each field of a record, with what it was and is."""
    k = F.col("o_orderkey")
    part = lambda value, original, normalized, conf: F.struct(value.cast("string").alias("value"), original.cast("string").alias("original_value"), normalized.cast("string").alias("normalized_value"), F.lit(conf).alias("confidence"), F.lit("rule").alias("source"))
    fields = F.create_map(F.lit("number"), part(k, F.lit(None), F.when(k % 2 == 0, F.concat(F.lit("N"), k)), 0.9), F.lit("status"), part(F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit(None), 0.5))
    return structure.review_items(table(spark, sf_dir, "orders").select(k.alias("document_id"), fields.alias("fields")))


@query
def header_names(spark, sf_dir):
    """Names of columns made from heads that are blank, unnamed or the same."""
    k = F.col("s_suppkey")
    heads = F.array(F.when(k % 2 == 0, " ").otherwise("name"), F.lit("name "), F.when(k % 3 == 0, "Unnamed: 2").otherwise("name"), F.when(k % 5 == 0, None).otherwise(F.concat(F.lit("c"), k)), F.lit("NaN"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(structure.header_names(heads), "|").alias("headers"))


@query
def schema_versions(spark, sf_dir):
    """Parts as schemas, some of which are revised: the last version of each active one."""
    k = F.col("p_partkey")
    old = table(spark, sf_dir, "part").select(k.cast("string").alias("schema_id"), F.col("p_name").alias("name"), F.col("p_type").alias("family"), F.lit(1).alias("version"), F.col("p_size").cast("string").alias("fingerprint"), (k % 4 != 0).alias("is_active"))
    changes = table(spark, sf_dir, "part").where(k % 3 == 0).select(k.cast("string").alias("schema_id"), F.lit("revised").alias("name"), F.when(k % 2 == 0, True).alias("is_active"))
    return schemas.current(schemas.revised(old, changes)).select("schema_id", "name", "version", "fingerprint")


@query
def masked_values(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.masked(F.when(F.col("c_custkey") % 3 == 0, F.left("c_name", F.lit(8))).otherwise(F.col("c_name"))).alias("masked"))


@query
def custom_fields(spark, sf_dir):
    """Fields that reviewers add to the latest run of an order's document; documents without a run are refused."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    run = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.concat(F.lit("run"), F.col("l_linenumber")).alias("run_id"), F.col("l_shipdate").alias("created_at")).where("document_id % 5 <> 0")
    added = o.select(k.alias("document_id"), F.lit("Net Weight").alias("label"), F.when(k % 3 == 0, " $5.50 ").when(k % 3 == 1, "x").otherwise("1,000").alias("value"), F.when(k % 3 == 2, "number").otherwise("money").alias("data_type"), F.lit("").alias("section"), F.when(k % 2 == 0, "weight").alias("canonical_key"), F.lit("me").alias("reviewer_id"))
    fields, _, refused = run_fields.added_fields(run, added)
    both = fields.select("document_id", "run_id", "canonical_key", "normalized_value", F.array_join("validation_messages", "; ").alias("messages"), F.lit(None).cast("string").alias("error_message"))
    return both.unionByName(refused.select("document_id", "error_message"), allowMissingColumns=True)


@query
def found_fields(spark, sf_dir):
    """Which of an invoice's fields each order has, by the confidence of its values."""
    k = F.col("o_orderkey")
    each = [("vendor_name", 0.9, F.when(k % 2 == 0, "v")), ("invoice_number", 0.35, k.cast("string")), ("invoice_date", 0.34, F.lit("d")), ("total_amount", 0.6, F.when(k % 3 == 0, "").otherwise("t"))]
    best = table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.explode(F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value"), F.lit(c).alias("confidence")) for n, c, v in each])).alias("b")).select("doc_id", "b.*")
    out = run_fields.found_and_missing(best.select("doc_id").distinct(), best)
    return out.select("doc_id", F.array_join("found", "|").alias("found"), F.array_join("missing", "|").alias("missing"))


@query
def rescored_documents(spark, sf_dir):
    """Lines of an order as its document's fields, scored again; a document with an absent field needs review."""
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    none = F.array().cast("array<string>")
    fields = table(spark, sf_dir, "lineitem").select(k.alias("document_id"), F.when((n != 4) | (k % 2 == 0), "v").alias("value"), F.lit(0.95).alias("confidence"), F.lit("verified").alias("status"), (n != 6).alias("grounded"), (F.lit(0.7) + n % 3 * 0.1).alias("match_score"), (n % 3).alias("n_passes"), F.lit(True).alias("agree"), F.when(n == 5, F.array(F.lit("m"))).otherwise(none).alias("messages"), (k % 2).alias("failures"))
    return run_fields.document_status(run_fields.rescored(fields))


@query
def listed_runs(spark, sf_dir):
    """Runs of documents of one status, newest first by document; ALL is every status."""
    chosen = table(spark, sf_dir, "orders").where(F.lit("ALL").isin("ALL", "") | (F.col("o_orderstatus") == "ALL")).select(F.col("o_orderkey").alias("document_id"))
    run = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("run_id"), F.col("l_shipdate").alias("created_at"))
    parts = tasks(table(spark, sf_dir, "lineitem"), 500_000)
    run, chosen = run.repartition(parts, "document_id"), chosen.repartition(parts, "document_id")
    return run_fields.ranked(run.join(chosen, "document_id", "left_semi"), ["document_id"], "created_at", "run_id").select("document_id", "run_id", "rank")


@query
def audit_order(spark, sf_dir):
    """Events of each user, newest first."""
    e = table(spark, sf_dir, "events").where("user_id is not null").select("user_id", "event_id", "ts")
    return run_fields.ranked(e, ["user_id"], "ts", "event_id").select("user_id", "event_id", "rank")


@query
def ranked_candidates(spark, sf_dir):
    """Candidates of a field, the surest first, equal ones in their order."""
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit("total").alias("field"), F.col("l_linenumber").alias("pos"), F.col("l_discount").cast("decimal(4,2)").alias("confidence"))
    return run_fields.ranked(c, ["doc_id", "field"], "confidence", "pos").select("doc_id", "pos", "rank")
