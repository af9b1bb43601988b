"""Files as tables: type by signature, content hash, delimited text."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators.structure import header_names
from quillstream.sources import office

#: Bytes looked at to tell a file's type, and the largest file taken in.
HEAD, MOST = 4096, 10 * 1024 * 1024
#: Delimiters that are looked for, the likelier first, and rows of a sheet that are profiled.
DELIMITERS, ROWS = (",", ";", "\t", "|"), 5000
#: Bytes 80 to 9F of the code page that Western texts use, without those it leaves open.
_WESTERN = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def read_files(spark: SparkSession, path: str, stream: bool = False, schema: str = "path string, modificationTime timestamp, length bigint, content binary") -> DataFrame:
    """path, length, content of the files below ``path``; as a stream, files that arrive are taken up.
    Spark passes over empty files."""
    reader = spark.readStream.schema(schema) if stream else spark.read
    return reader.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def file_type(content: Column, path: Column) -> Column:
    """PDF, IMAGE, EXCEL, CSV or UNSUPPORTED by the first bytes, and for text by its delimiters and line ends."""
    head = F.substring(content, 1, HEAD)
    text = F.decode(head, "ISO-8859-1")
    begins = lambda digits: F.startswith(F.hex(head), F.lit(digits))
    declared = F.lower(path).rlike(r"\.(csv|tsv)$")
    delimiter, line = text.rlike("[,;\t|]"), text.contains("\n")
    readable = ~text.contains("\x00") & (F.length(text) > 0)
    return (
        F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, "UNSUPPORTED")
        .when(F.instr(F.left(text, F.lit(1024)), "%PDF-") > 0, "PDF")
        .when(begins("89504E470D0A1A0A") | begins("FFD8FF"), "IMAGE")
        .when(begins("504B0304") & F.decode(content, "ISO-8859-1").contains("xl/"), "EXCEL")
        .when(readable & F.when(declared, delimiter | line).otherwise(delimiter & line), "CSV")
        .otherwise("UNSUPPORTED")
    )


def documents(files: DataFrame) -> DataFrame:
    """A row per file: path, file_name, file_type, file_size, file_hash, status, error_message."""
    kind = file_type(F.col("content"), F.col("path"))
    problem = F.when(F.col("length") > MOST, "File is too large").when(F.col("length") == 0, "File is empty").when(kind == "UNSUPPORTED", "Unsupported file type")
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), kind.alias("file_type"), F.col("length").alias("file_size"), F.sha2("content", 256).alias("file_hash"), F.when(problem.isNull(), "UPLOADED").otherwise("FAILED").alias("status"), problem.alias("error_message"))


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A delimited file with a header; values are trimmed, broken lines and empty rows dropped."""
    df = spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding).option("mode", "DROPMALFORMED").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    filled = [F.when(F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) != "", 1) for c in df.columns]
    return df.where(F.coalesce(*filled).isNotNull())


def write_csv(df: DataFrame, path: str) -> None:
    """Every value in quotes, quotes doubled, missing ones empty."""
    df.select([F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def decoded(content: Column) -> Column:
    """Text of a file's bytes: UTF-8 without its mark; where that fails Western code page 1252, and Latin-1 for bytes that it leaves open."""
    text = content.cast("string")
    latin = F.decode(content, "ISO-8859-1")
    western = F.translate(latin, "".join(map(chr, _WESTERN)), "".join(_WESTERN.values()))
    return F.when(F.is_valid_utf8(text), F.regexp_replace(text, "^\ufeff", "")).when(latin.rlike("[\x81\x8d\x8f\x90\x9d]"), latin).otherwise(western)


def _agreeing(lines: Column, mark: str) -> Column:
    """Lines in which ``mark`` is as often as in the first; 0 if it isn't there."""
    n = F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit(""))))
    return F.when(F.get(n, 0) > 0, F.size(F.filter(n, lambda x: x == F.get(n, 0)))).otherwise(0)


def delimiter(text: Column) -> Column:
    """The delimiter by which most lines of the first 4096 characters have as many parts as the first line, half of them at
    least; quoted text is passed over. A comma if there is none."""
    head = F.regexp_replace(F.left(text, F.lit(HEAD)), '"[^"]*"', "")
    whole = F.when(F.length(text) > HEAD, F.regexp_replace(head, r"\n[^\n]*$", "")).otherwise(head)
    lines = F.filter(F.split(whole, r"\r?\n"), lambda x: F.trim(x) != "")
    found = [F.struct(_agreeing(lines, d).alias("n"), F.lit(-i).alias("rank"), F.lit(d).alias("mark")) for i, d in enumerate(DELIMITERS)]
    best = F.greatest(*found)
    return F.when(best["n"] * 2 >= F.size(lines), best["mark"]).otherwise(",")


def _records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    csv.field_size_limit(MOST)  # no cell is longer than the largest file
    for frame in frames:
        for path, text, mark in zip(frame["path"], frame["text"], frame["delimiter"], strict=True):
            found, width = [], 0
            for cells in csv.reader(io.StringIO(text, newline=""), delimiter=mark, skipinitialspace=True):
                if not cells:
                    continue
                width = width or len(cells)
                if len(cells) <= width:  # a broken line is passed over
                    found.append((path, len(found), cells + [""] * (width - len(cells))))
            yield pd.DataFrame(found, columns=["path", "row_idx", "cells"])


def delimited_rows(files: DataFrame, most: int | None = None) -> DataFrame:
    """path, row_idx, headers, cells of the data rows of delimited ``files`` (path, content, up to MOST bytes each).

    Encoding and delimiter are told for each file. Lines with more cells than the header are passed over, and so are rows
    without any value; cells are trimmed, and null for blank, NaN and infinite ones. ``most`` keeps that many rows of a file.
    """
    texts = files.where(F.octet_length("content") <= MOST).select("path", decoded(F.col("content")).alias("text")).withColumn("delimiter", delimiter(F.col("text")))
    rows = texts.mapInPandas(_records, "path string, row_idx int, cells array<string>")
    cell = lambda c: F.when(~F.lower(F.trim(c)).isin("", "nan", "inf", "-inf", "infinity", "-infinity"), F.trim(c))
    headers = rows.where("row_idx = 0").select("path", header_names(F.col("cells")).alias("headers"))
    data = rows.where("row_idx > 0").select("path", "row_idx", F.transform("cells", cell).alias("cells"))
    if most is not None:
        data = data.where(F.col("row_idx") <= most)
    return data.where(F.exists("cells", lambda c: c.isNotNull())).join(headers, "path").select("path", "row_idx", "headers", "cells")


def blocks(files: DataFrame) -> DataFrame:
    """path, reading_order, type, text, error_message of the ``files`` (path, content) that have a reader, by their suffix.

    csv, tsv and txt: a block per row, "header: value, ..."; xlsx: a block per row of each sheet; docx: paragraphs and
    tables. Other files give no rows. Of a sheet the first ROWS rows are read. A file that is too large, or that its reader
    can't read, gives one row with a message.
    """
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kept = files.select("path", "content", suffix.alias("suffix")).where("suffix in ('csv', 'tsv', 'txt', 'xlsx', 'docx')")
    large = kept.where(F.octet_length("content") > MOST).select("path", F.lit(None).cast("int").alias("reading_order"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("File is too large").alias("error_message"))
    kept = kept.where(F.octet_length("content") <= MOST)
    pairs = F.filter(F.arrays_zip("headers", "cells"), lambda p: p["cells"].isNotNull())
    flat = delimited_rows(kept.where("suffix in ('csv', 'tsv', 'txt')"), ROWS)
    flat = flat.select("path", "row_idx", F.array_join(F.transform(pairs, lambda p: F.concat(p["headers"], F.lit(": "), p["cells"])), ", ").alias("text"))
    cells = office.spreadsheet_cells(kept.where("suffix = 'xlsx'")).where(F.coalesce("row_idx", F.lit(0)) <= ROWS)
    sheets = cells.groupBy("path", "sheet", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "value"))).alias("c"), F.max("error_message").alias("error_message"))
    sheets = sheets.select("path", "row_idx", F.when(F.col("sheet").isNotNull(), F.concat("sheet", F.lit(": "), F.array_join("c.value", " | "))).alias("text"), "error_message")
    row = F.lit("table_row").alias("type")
    words = office.document_blocks(kept.where("suffix = 'docx'")).select("path", "reading_order", "type", "text", "error_message")
    return large.unionByName(words).unionByName(flat.select("path", F.col("row_idx").alias("reading_order"), row, "text", F.lit(None).cast("string").alias("error_message"))).unionByName(sheets.select("path", F.col("row_idx").alias("reading_order"), row, "text", "error_message"))
