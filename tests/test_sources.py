from __future__ import annotations

import zipfile

from pyspark.sql import functions as F

from quillstream.sources.files import blocks, delimited_rows, documents, read_delimited, read_files, write_csv
from quillstream.streaming.intake import intake, tumbling


def test_types_and_intake(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (src / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    (src / "c.csv").write_text("a,b\n1,2\n")
    (src / "copy.csv").write_text("a,b\n1,2\n")
    (src / "e.bin").write_bytes(b"\x00\x01")
    (src / "f.txt").write_text("")  # Spark's reader passes over empty files
    with zipfile.ZipFile(src / "g.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", "x")
    got = {r.file_name: (r.file_type, r.status) for r in documents(read_files(spark, str(src))).collect()}
    assert got == {"a.pdf": ("PDF", "UPLOADED"), "b.png": ("IMAGE", "UPLOADED"), "c.csv": ("CSV", "UPLOADED"), "copy.csv": ("CSV", "UPLOADED"), "e.bin": ("UNSUPPORTED", "FAILED"), "g.xlsx": ("EXCEL", "UPLOADED")}
    intake(spark, str(src), str(tmp_path / "out"), str(tmp_path / "chk")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_delimited(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a;b\n 1 ;x\n;\n2;y\n")
    df = read_delimited(spark, str(tmp_path / "x.csv"), ";")
    assert [tuple(r) for r in df.collect()] == [("1", "x"), ("2", "y")]
    write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = tumbling(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, tumbling(events).collect()))
    assert tumbling(events).agg(F.sum("n")).first()[0] == events.count()


def test_encodings_and_delimiters(spark, tmp_path):
    (tmp_path / "mark.csv").write_bytes("\ufeffa;b\n é ;\"x;\ny\"\n;\n1;2;3\nNaN;z\n1;2\n".encode())
    (tmp_path / "west.csv").write_bytes("a\tb\tb\n“é”\t5 €\t\n".encode("cp1252"))
    (tmp_path / "latin.txt").write_bytes(b"a,b\n\xe9,\x81\n")
    (tmp_path / "one.csv").write_text("a\n1\n")
    got = {(r.path.split("/")[-1], r.row_idx): (r.headers, r.cells) for r in delimited_rows(read_files(spark, str(tmp_path))).collect()}
    assert got == {
        ("mark.csv", 1): (["a", "b"], ["é", "x;\ny"]), ("mark.csv", 3): (["a", "b"], [None, "z"]), ("mark.csv", 4): (["a", "b"], ["1", "2"]), ("west.csv", 1): (["a", "b", "b_2"], ["“é”", "5 €", None]),
        ("latin.txt", 1): (["a", "b"], ["é", "\x81"]), ("one.csv", 1): (["a"], ["1"]),
    }
    with zipfile.ZipFile(tmp_path / "bad.docx", "w") as z:
        z.writestr("x", "y")
    out = {r.path.split("/")[-1]: (r.type, r.text, r.error_message) for r in blocks(read_files(spark, str(tmp_path))).collect()}
    assert out["west.csv"] == ("table_row", "a: “é”, b: 5 €", None) and out["bad.docx"][2].startswith("KeyError") and len(out) == 5
