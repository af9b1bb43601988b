from __future__ import annotations

import io
import zipfile

from quillstream.operators import layout, schemas
from quillstream.sources.office import document_blocks, spreadsheet_cells

SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def package(parts):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return bytearray(raw.getvalue())


def test_office_files(spark):
    book = package({
        "xl/workbook.xml": f'<workbook xmlns="{SHEET}" xmlns:r="{OFFICE}"><sheets><sheet name="Q3" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{SHEET}"><si><t>Region</t></si></sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{SHEET}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>12.5</v></c></row><row><c r="B2" t="inlineStr"><is><t>x</t></is></c><c r="C2"/></row></sheetData></worksheet>',
    })
    doc = package({"word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t></w:r><w:r><w:t>text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    files = lambda raw: spark.createDataFrame([("f", raw), ("broken", bytearray(b"no"))], "path string, content binary")
    cells = [tuple(r) for r in spreadsheet_cells(files(book)).collect()]
    assert ("f", "Q3", 0, 0, "Region", None) in cells and ("f", "Q3", 0, 27, "12.5", None) in cells and ("f", "Q3", 1, 1, "x", None) in cells
    assert len(cells) == 4 and any(c[0] == "broken" and "BadZipFile" in c[5] for c in cells)
    assert [tuple(r)[1:4] for r in document_blocks(files(doc)).where("path = 'f'").collect()] == [(0, "heading", "Head"), (1, "paragraph", "Some text"), (2, "table", "a | b")]


WORDS = [(1, 1, 1, 1, i, i, t, c, x, y, x + 40.0, y + 10.0) for i, (t, c, x, y) in enumerate([("Invoice", 95.0, 10.0, 100.0), ("No:", 90.0, 60.0, 101.0), ("noise", 3.0, 90.0, 100.0), ("INV-7", 85.0, 110.0, 102.0)])] + [(1, 1, 1, 2, 4, 4, "INV-9", 80.0, 10.0, 140.0, 50.0, 150.0)]


def test_words(spark):
    words = spark.createDataFrame(WORDS, "doc_id int, page int, block int, line int, word_no int, pos int, text string, conf double, x0 double, y0 double, x1 double, y1 double")
    got = sorted(tuple(r) for r in layout.lines_of_words(words).select("line", "text", "x0", "x1", "confidence").collect())
    assert got == [(1, "Invoice No: INV-7", 10.0, 150.0, 0.9), (2, "INV-9", 10.0, 50.0, 0.8)]
    assert [tuple(r) for r in layout.right_neighbours(words, "^No", "^INV").select("keyword", "value").collect()] == [("No:", "INV-7")]


def test_schemas(spark):
    reg = spark.createDataFrame([("s1", "Invoice", "finance", 1, "f1", True), ("s1", "Tax Invoice", "finance", 2, "f1", True), ("s2", "Invoice", "finance", 1, None, True), ("s3", "Report", "x", 1, "f3", False)], "schema_id string, name string, family string, version int, fingerprint string, is_active boolean")
    docs = spark.createDataFrame([(1, "invoice", "f1"), (2, "Commercial Invoice", "zz"), (3, "Report", "f3"), (4, "letter", None)], "doc_id int, doc_type string, fingerprint string")
    got = {r.doc_id: (r.schema_id, r.how) for r in schemas.resolve(docs, reg).collect()}
    assert got == {1: ("s1", "fingerprint"), 2: ("s2", "name"), 3: (None, "none"), 4: (None, "none")}
    new = schemas.revised(reg, spark.createDataFrame([("s2", "Bill")], "schema_id string, name string"))
    assert {(r.schema_id, r.version, r.name) for r in new.collect()} >= {("s2", 1, "Invoice"), ("s2", 2, "Bill")} and new.count() == 5
    aliases = spark.createDataFrame([("vendor", "seller", None), ("payee", "seller", "bank")], "canonical_key string, alias string, family string")
    fields = spark.createDataFrame([("Seller", "bank"), ("seller", "x"), ("other", "x")], "field_key string, family string")
    assert sorted(r.canonical_key for r in schemas.canonical(fields, aliases).collect()) == ["other", "payee", "payee"]
