"""Workbooks and Word files: written files read back, and files as other programs write them."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from weir.operators import documents
from weir.sources import office

ROWS = "path string, sheet_no int, sheet string, row_no long, cells array<string>"


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def contents(spark, *files):
    return spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in files], "path string, content binary")


def shown(cell) -> str | None:
    return {"null": None, "int": cell.i, "float": cell.f}.get(cell.kind, cell.t)


def rows_read(df):
    return [(r.sheet, r.row_no, [shown(c) for c in r.cells]) for r in df.orderBy("path", "sheet_no", "row_no").collect()]


def test_workbooks_round_trip(spark):
    odd = "a\x01_x0041_ <&>\r\n é\t "
    rows = [
        ("b.xlsx", 0, "One: two", 0, ["Name", "n"]), ("b.xlsx", 0, "One: two", 1, [odd, "12"]), ("b.xlsx", 0, "One: two", 2, [None, "-0.5"]),
        ("b.xlsx", 0, "One: two", 3, ["=1+1", "007"]), ("b.xlsx", 0, "One: two", 4, ["  ", None]), ("b.xlsx", 1, "one  two", 0, []),
        ("b.xlsx", 2, "ONE  TWO", 0, ["x"]), ("c.xlsx", 0, None, 0, None),
    ]
    made = office.workbooks(spark.createDataFrame(rows, ROWS).withColumn("cells", office.text_cells(F.col("cells"))))
    assert [r.path for r in made.orderBy("path").collect()] == ["b.xlsx", "c.xlsx"]
    got = rows_read(office.workbook_rows(made))
    assert got == [("One  two", 0, ["Name", "n"]), ("One  two", 1, [odd, 12]), ("One  two", 2, [None, -0.5]), ("One  two", 3, ["'=1+1", "007"]), ("ONE  TWO (3)", 0, ["x"])]
    sheet = zipfile.ZipFile(io.BytesIO(made.where("path = 'b.xlsx'").first().content)).read("xl/worksheets/sheet1.xml").decode()
    assert 'state="frozen"' in sheet and '<c r="A1" t="inlineStr" s="1">' in sheet and '<col min="2" max="2" width="8"' in sheet


def test_sheet_names():
    assert office.free_sheet_name("[x]:*?/\\" + "y" * 40, set()) == ("x" + " " * 6 + "y" * 40)[:31]
    assert office.free_sheet_name("z" * 31, {"z" * 31, "z" * 27 + " (2)"}) == "z" * 27 + " (3)"
    assert office.free_sheet_name("", {"sheet"}) == "Sheet (2)" and office.free_sheet_name("/", set()) == "Sheet"


def test_foreign_workbook(spark):
    main, rel = f'xmlns="{office.SHEET}" xmlns:r="{office.RELS}"', f'xmlns="{office.PACKAGE}/relationships"'
    sheet = """<sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="D2" t="s"><v>1</v></c></row>
      <row r="4"><c r="A4" s="1"><v>45292</v></c><c s="1"><v>45292.5</v></c><c t="b"><v>1</v></c><c s="2"><v>0.25</v></c><c><v>1E3</v></c></row>
      <row><c><v>7</v></c><c t="e"><v>#N/A</v></c><c t="str"><f>A1</f><v>said</v></c><c r="J5" t="str"><v></v></c></row>
      <row r="9"><c r="K9" t="str"><v> </v></c></row></sheetData>"""
    book = zipped({
        "xl/workbook.xml": f'<workbook {main}><sheets><sheet name="S" sheetId="1" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {rel}><Relationship Id="a" Target="/xl/worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {main}><si><t>plain</t></si><si><r><t>in </t></r><r><t>runs</t></r><rPh><t>no</t></rPh></si></sst>",
        "xl/styles.xml": f'<styleSheet {main}><numFmts><numFmt numFmtId="164" formatCode="hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>',
        "xl/worksheets/s.xml": f"<worksheet {main}>{sheet}</worksheet>",
    })
    empty = [None] * 5
    want = [
        ("S", 0, empty), ("S", 1, [None, "plain", None, "in runs", None]), ("S", 2, empty),
        ("S", 3, ["2024-01-01", "2024-01-01 12:00:00", "TRUE", "06:00:00", 1000.0]), ("S", 4, [7, "#N/A", "said", None, None]),
    ]
    assert rows_read(office.workbook_rows(contents(spark, ("s.xlsx", book)))) == want


def test_broken_files(spark):
    bad = contents(spark, ("a", b"no zip"), ("b", None), ("c", zipped({"x": ""})))
    assert all(r.error.startswith("This file cannot be read as an Excel workbook (") and r.cells is None for r in office.workbook_rows(bad).collect())
    assert [r.error[:42] for r in office.word_blocks(bad).collect()] == ["This file cannot be read as a Word documen"] * 3
    assert office.workbook_rows(bad.limit(0)).count() == office.word_blocks(bad.limit(0)).count() == 0


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([("b.xlsx", k, f"s{k}", n, [f"h{k}" if n == 0 else str(n)]) for k in range(2) for n in range(3)], ROWS)
    office.save(office.workbooks(rows.withColumn("cells", office.text_cells(F.col("cells")))), str(tmp_path))
    (tmp_path / "a.v1.csv").write_text("x;y\n1,5;007\n;\n")
    (tmp_path / "c.bin").write_bytes(b"?")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.v1.csv", "b.xlsx", "c.bin"]
    got = office.tables(spark, str(tmp_path))
    assert rows_read(got.where("error is null")) == [("a.v1", 0, ["x", "y"]), ("a.v1", 1, [1.5, "007"]), *((f"s{k}", n, [n or f"h{k}"]) for k in range(2) for n in range(3))]
    assert [r.error for r in got.where("error is not null").collect()] == ["'c.bin' is not a CSV or Excel file."]
    assert {(r.path.rsplit("/", 1)[-1], r.rows) for r in office.row_counts(got).collect()} == {("a.v1.csv", 1), ("b.xlsx", 4)}
    assert {r.label for r in office.labels(got).collect()} == {"a.v1.csv", "b.xlsx - s0", "b.xlsx - s1", "c.bin"}
    assert office.tables(spark, str(tmp_path), every_sheet=False).where("error is null").count() == 5


MARKDOWN = "# A *b*\n\nsome **bold** `c` and [x](http://y.z)\n\n- one\n  - two\n1. three\n\n> said\n\n```\nx <y>\n  z\n```\n\n| a | b |\n|---|---|\n| 1 | 1 |\n"


def test_word_round_trip(spark):
    docs = spark.createDataFrame([("d", MARKDOWN), ("e", "")], "doc_id string, text string")
    blocks = documents.markdown_blocks(docs).withColumn("runs", documents.runs("text"))
    files = office.word_files(blocks, "doc_id")
    back = office.word_blocks(files)
    got = [(r.kind, r.level, r.text, r.rows) for r in back.orderBy("place").collect()]
    assert got == [
        ("heading", 1, "A b", []), ("para", 0, "some bold c and x (http://y.z)", []), ("bullet", 0, "one", []), ("bullet", 1, "two", []), ("number", 0, "three", []),
        ("quote", 0, "said", []), ("code", 0, "x <y>\n  z", []), ("table", 0, "", [["a", "b"], ["1", ""]]),
    ]
    assert documents.to_markdown(back, "path").first().text.startswith("# A *b*\n\nsome **bold** `c` and x (http://y.z)\n\n- one\n  - two\n1. three\n\n> said")
    assert "<h1>A <em>b</em></h1>" in documents.to_html(back, id_col="path").first().text


def test_foreign_word_file(spark):
    w, rel = f'xmlns:w="{office.WORD}" xmlns:r="{office.RELS}"', f'xmlns="{office.PACKAGE}/relationships"'
    body = """<w:p><w:pPr><w:pStyle w:val="T"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p/>
      <w:p><w:pPr><w:numPr><w:ilvl w:val="2"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>deep</w:t></w:r></w:p>
      <w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bo</w:t></w:r><w:r><w:rPr><w:b w:val="1"/></w:rPr><w:t>ld</w:t></w:r><w:r><w:rPr><w:b w:val="0"/></w:rPr><w:tab/><w:t>x</w:t><w:br/><w:br w:type="page"/></w:r>
        <w:hyperlink r:id="l" w:anchor="f"><w:r><w:t>go</w:t></w:r></w:hyperlink></w:p>
      <w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>tall</w:t></w:r></w:p></w:tc></w:tr>
      <w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc></w:tr></w:tbl>"""
    made = zipped({
        "word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>",
        "word/styles.xml": f'<w:styles {w}><w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/></w:style><w:style w:type="paragraph" w:styleId="T"><w:name w:val="Title"/></w:style></w:styles>',
        "word/_rels/document.xml.rels": f'<Relationships {rel}><Relationship Id="l" Target="http://h.i" TargetMode="External"/></Relationships>',
    })
    got = office.word_blocks(contents(spark, ("w.docx", made))).orderBy("place").collect()
    assert [(r.kind, r.level, r.text) for r in got] == [("heading", 1, "Top"), ("bullet", 2, "deep"), ("para", 0, "bold\tx\ngo"), ("table", 0, "")]
    assert [tuple(r) for r in got[2].runs] == [("bold", True, False, False, ""), ("\tx\n", False, False, False, ""), ("go", False, False, False, "http://h.i#f")]
    assert got[3].rows == [["wide", "", "tall"], ["1\n2", "", "tall"]]
