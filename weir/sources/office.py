"""Workbooks and Word files as relations of rows and blocks, and back.

Both formats are ZIP archives of XML, so the standard library is enough. Readers take a relation of
whole files (``path``, ``content``), as ``spark.read.format("binaryFile")`` gives it; writers return
one (``path``, ``content``). A file is one task's work; many files are many tasks.
"""

from __future__ import annotations

import io
import itertools
import os
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import groupby
from typing import NamedTuple
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import suffix
from ..functions.values import typed
from ..operators.documents import RUN, without_left_repeats
from .files import decoded_bytes, rows_of, typed_rows

CELL = pa.struct([("kind", pa.string()), ("i", pa.int64()), ("f", pa.float64()), ("t", pa.string())])
#: Rows that leave a reader at once.
BATCH = 4096
#: What a sheet holds at most, and what its name must not hold.
MOST_ROWS, MOST_NAME, NOT_IN_NAMES = 1_048_576, 31, r"[\[\]:*?/\\]"
#: Fixed values of the format: built-in number formats that show dates.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
SHEET, RELS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
WORD, PACKAGE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_BROKEN = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, EOFError, IndexError, AttributeError, OverflowError, NotImplementedError, RuntimeError)


def _mark(where: str, name: str) -> str:
    return f"{{{where}}}{name}"


def _targets(book: zipfile.ZipFile, part: str) -> dict[str, str]:
    """What the relations of a part point to, by id; inside the archive as a name, else as it is."""
    folder, name = part.rsplit("/", 1)
    where = f"{folder}/_rels/{name}.rels"
    if where not in book.namelist():
        return {}
    out = {}
    for x in ElementTree.fromstring(book.read(where)):
        to = x.get("Target", "")
        inside = x.get("TargetMode") != "External"
        out[x.get("Id")] = (to[1:] if to.startswith("/") else os.path.normpath(f"{folder}/{to}")) if inside else to
    return out


# ------------------------------------------------------------------ texts in XML
_CODED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_UNSAFE = re.compile("[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")


def _shown(text: str) -> str:
    """A cell's text in XML; characters that XML has no place for as _xHHHH_."""
    return escape(_UNSAFE.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


def _meant(text: str) -> str:
    return _CODED.sub(lambda m: chr(int(m[1], 16)), text)


# --------------------------------------------------------------------- workbooks
def _column(name: str) -> int:
    n = 0
    for c in name:
        n = n * 26 + ord(c) - 64
    return n - 1


def _letters(index: int) -> str:
    out = ""
    while index >= 0:
        out, index = chr(65 + index % 26) + out, index // 26 - 1
    return out


class _Book:
    """A workbook: sheets as streams of rows, with values and not formulas."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        root = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        to = _targets(self.zip, "xl/workbook.xml")
        self.sheets = [(s.get("name"), to[s.get(_mark(RELS, "id"))]) for s in root.iter(_mark(SHEET, "sheet")) if "worksheets/" in to[s.get(_mark(RELS, "id"))]]
        properties = root.find(_mark(SHEET, "workbookPr"))
        late = properties is not None and properties.get("date1904") in ("1", "true")
        self.epoch = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)
        self.texts, self.dates = self._texts(), self._dates()

    def _texts(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return []
        return [self._said(x) for x in ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml")).iter(_mark(SHEET, "si"))]

    @staticmethod
    def _said(x) -> str:
        """The text of an item, be it plain or in runs; the sound of East Asian words is no text."""
        parts = [x, *x.findall(_mark(SHEET, "r"))]
        return _meant("".join(t.text or "" for p in parts for t in p.findall(_mark(SHEET, "t"))))

    def _dates(self) -> set[int]:
        """Styles whose number format shows a date or time."""
        if "xl/styles.xml" not in self.zip.namelist():
            return set()
        root = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(x.get("numFmtId")): x.get("formatCode", "") for x in root.iter(_mark(SHEET, "numFmt"))}
        shows = {k for k, code in own.items() if re.search("[dmhysDMHYS]", re.sub(r'"[^"]*"|\[(?!h|m|s)[^\]]*\]|\\.', "", code.split(";")[0]).replace("General", ""))}
        styles = root.find(_mark(SHEET, "cellXfs"))
        return {k for k, x in enumerate(styles if styles is not None else []) if int(x.get("numFmtId") or 0) in shows | DATE_FORMATS - (own.keys() - shows)}

    def value(self, cell) -> tuple | None:
        """(kind, i, f, t) of a cell: int, float, text, bool or date (as its canonical text); None if empty."""
        kind, v = cell.get("t", "n"), cell.find(_mark(SHEET, "v"))
        if kind == "inlineStr":
            inner = cell.find(_mark(SHEET, "is"))
            return None if inner is None else ("text", None, None, self._said(inner))
        if v is None or v.text is None:
            return None
        if kind == "s":
            return ("text", None, None, self.texts[int(v.text)])
        if kind in ("str", "e"):
            return ("text", None, None, _meant(v.text))
        if kind == "b":
            return ("bool", None, None, "TRUE" if v.text.strip() in ("1", "true") else "FALSE")
        if kind == "d":
            return ("date", None, None, _day(datetime.fromisoformat(v.text)))
        if int(cell.get("s") or 0) in self.dates:
            number = float(v.text)
            at = self.epoch + timedelta(milliseconds=round(number * 86_400_000))
            return ("date", None, None, at.strftime("%H:%M:%S") if 0 <= number < 1 else _day(at))
        whole = re.fullmatch(r"\s*-?\d+\s*", v.text) and -(2**63) <= int(v.text) < 2**63
        return ("int", int(v.text), None, None) if whole else ("float", None, float(v.text), None)

    def rows(self, part: str) -> Iterator[tuple[int, dict[int, tuple]]]:
        """(row number, its filled cells by column), one row in memory at a time."""
        with self.zip.open(part) as source:
            at, holder = -1, None
            for event, x in ElementTree.iterparse(source, events=("start", "end")):
                if event == "start":
                    holder = x if x.tag == _mark(SHEET, "sheetData") else holder
                    continue
                if x.tag != _mark(SHEET, "row"):
                    continue
                at = int(x.get("r")) - 1 if x.get("r") else at + 1
                cells, column = {}, -1
                for c in x.findall(_mark(SHEET, "c")):
                    column = _column(re.match("[A-Z]+", c.get("r"))[0]) if c.get("r") else column + 1
                    value = self.value(c)
                    if value is not None:
                        cells[column] = value
                yield at, cells
                if holder is not None:
                    holder.clear()

    def trimmed(self, part: str) -> Iterator[tuple[int, list[tuple | None]]]:
        """All rows up to the last that isn't blank, as wide as the widest of them; a first pass finds both."""
        last, width, widest = -1, 0, 0
        for at, cells in self.rows(part):
            widest = max([widest, *(k + 1 for k, x in cells.items() if x[3] != "")])
            if any(x[3] is None or x[3].strip() for x in cells.values()):
                last, width = at, widest
        due = 0
        for at, cells in self.rows(part):
            if at > last:
                break
            yield from ((k, [None] * width) for k in range(due, at))
            yield at, [cells.get(k) for k in range(width)]
            due = at + 1


def _day(at: datetime) -> str:
    return at.strftime("%Y-%m-%d" if (at.hour, at.minute, at.second) == (0, 0, 0) else "%Y-%m-%d %H:%M:%S")


_ROWS = pa.schema([("path", pa.string()), ("sheet_no", pa.int32()), ("sheet", pa.string()), ("row_no", pa.int64()), ("cells", pa.list_(CELL)), ("error", pa.string())])
_ROWS_SQL = "path string, sheet_no int, sheet string, row_no long, cells array<struct<kind:string,i:long,f:double,t:string>>, error string"


def _sheet_rows(path: str, content: bytes) -> Iterator[tuple]:
    try:
        book = _Book(content)
        for no, (name, part) in enumerate(book.sheets):
            for at, cells in book.trimmed(part):
                kinds = [x or ("null", None, None, None) for x in cells]
                yield path, no, name, at, [dict(zip(("kind", "i", "f", "t"), x, strict=True)) for x in kinds], None
    except _BROKEN as problem:
        yield path, None, None, None, None, f"This file cannot be read as an Excel workbook ({problem})."


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True)


def workbook_rows(files: DataFrame) -> DataFrame:
    """``path``, ``sheet_no``, ``sheet``, ``row_no`` (from 0), ``cells`` of every sheet of workbooks (``path``, ``content``).

    Cells are (kind, i, f, t) as ``values.typed`` gives them, and bool and date with their text in t. Blank rows at a sheet's
    end and blank columns at its right are left out; empty rows between others stay. A file that can't be read gives a row
    with ``error`` behind the rows read so far; a null content is such a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched((r for path, content in _pairs(batches) for r in _sheet_rows(path, content or b"")), _ROWS)

    return files.select("path", "content").mapInArrow(run, _ROWS_SQL)


def free_sheet_name(name: str | None, taken: set[str]) -> str:
    """A name a workbook accepts that isn't among ``taken`` (lower case): the first of the numbered ones, each cut to fit."""
    bare = re.sub(NOT_IN_NAMES, " ", name or "").strip()[:MOST_NAME] or "Sheet"
    endings = itertools.chain([""], map(" ({})".format, itertools.count(2)))
    return next(said for said in (bare[: MOST_NAME - len(end)] + end for end in endings) if said.lower() not in taken)


class _Sheet(NamedTuple):
    name: str
    xml: str


def _written_cell(value: dict | None, at: str, bold: bool) -> tuple[str, int]:
    """(XML, characters shown) of a cell."""
    style = ' s="1"' if bold else ""
    kind = value["kind"] if value else "null"
    if kind == "null":
        return "", 0
    if kind == "int":
        return f'<c r="{at}"{style}><v>{value["i"]}</v></c>', len(str(value["i"]))
    if kind == "float":
        f = value["f"]
        return f'<c r="{at}"{style}><v>{f!r}</v></c>', len(str(int(f)) if f == f // 1 and abs(f) < 1e15 else repr(f))
    if kind == "bool":
        return f'<c r="{at}" t="b"{style}><v>{int(value["t"] == "TRUE")}</v></c>', len(value["t"])
    text = value["t"] or ""
    guarded = "'" + text if text.startswith("=") else text
    return f'<c r="{at}" t="inlineStr"{style}><is><t xml:space="preserve">{_shown(guarded)}</t></is></c>', len(text)


def _sheet_xml(rows: Iterator[list], bold: bool) -> str:
    widths: dict[int, int] = {}
    body = []
    for k, cells in enumerate(rows):
        if k == MOST_ROWS:
            raise ValueError(f"a sheet holds at most {MOST_ROWS} rows")
        said = []
        for c, value in enumerate(cells or []):
            xml, size = _written_cell(value, f"{_letters(c)}{k + 1}", bold and k == 0)
            widths[c] = max(widths.get(c, 0), min(60, size))
            said.append(xml)
        body.append(f'<row r="{k + 1}">{"".join(said)}</row>')
    frozen = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>' if bold and body else ""
    columns = "".join(f'<col min="{c + 1}" max="{c + 1}" width="{max(8, w + 2)}" customWidth="1"/>' for c, w in sorted(widths.items()))
    return f'{_HEAD}<worksheet xmlns="{SHEET}">{frozen}{f"<cols>{columns}</cols>" if columns else ""}<sheetData>{"".join(body)}</sheetData></worksheet>'


def _archive(parts: dict[str, str]) -> bytes:
    """A ZIP archive with the same bytes for the same parts."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text.encode(), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _package(main: str, kind: str, kinds: dict[str, str], relations: list[tuple[str, str]], parts: dict[str, str]) -> bytes:
    """``kinds``: content types by part; ``relations``: (type, target) of the main part, rId1, rId2 and so on."""
    types = "".join(f'<Override PartName="/{p}" ContentType="application/vnd.openxmlformats-officedocument.{t}+xml"/>' for p, t in {main: kind, **kinds}.items())
    folder, name = main.rsplit("/", 1)
    inner = "".join(f'<Relationship Id="rId{k}" Type="{RELS}/{t}" Target="{to}"/>' for k, (t, to) in enumerate(relations, 1))
    rels = lambda said: f'{_HEAD}<Relationships xmlns="{PACKAGE}/relationships">{said}</Relationships>'
    return _archive({
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>',
        "_rels/.rels": rels(f'<Relationship Id="rId1" Type="{RELS}/officeDocument" Target="{main}"/>'),
        f"{folder}/_rels/{name}.rels": rels(inner),
        **parts,
    })


def _workbook(sheets: list[_Sheet]) -> bytes:
    listed = "".join(f'<sheet name={quoteattr(s.name)} sheetId="{k}" r:id="rId{k}"/>' for k, s in enumerate(sheets, 1))
    names = [f"worksheets/sheet{k}.xml" for k in range(1, len(sheets) + 1)]
    fonts = '<fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><name val="Calibri"/></font></fonts>'
    fills = '<fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills><borders count="1"><border/></borders>'
    forms = '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf xfId="0"/><xf fontId="1" applyFont="1" xfId="0"/></cellXfs>'
    return _package(
        "xl/workbook.xml", "spreadsheetml.sheet.main", {**{f"xl/{n}": "spreadsheetml.worksheet" for n in names}, "xl/styles.xml": "spreadsheetml.styles"},
        [*(("worksheet", n) for n in names), ("styles", "styles.xml")],
        {"xl/workbook.xml": f'{_HEAD}<workbook xmlns="{SHEET}" xmlns:r="{RELS}"><sheets>{listed}</sheets></workbook>', "xl/styles.xml": f'{_HEAD}<styleSheet xmlns="{SHEET}">{fonts}{fills}{forms}</styleSheet>', **{f"xl/{n}": s.xml for n, s in zip(names, sheets, strict=True)}},
    )


_FILE = pa.schema([("path", pa.string()), ("content", pa.binary())])


def workbooks(rows: DataFrame, *, bold_header: bool = True) -> DataFrame:
    """``path``, ``content``: a workbook for each path of ``rows`` (path, sheet_no, sheet, row_no, cells as (kind, i, f, t)).

    Rows are written in the order of row_no, without gaps. The first is bold and frozen, columns are as wide as their longest
    cell (8 to 62), texts that begin with = get an apostrophe, names of sheets are made free. A workbook is one task's work:
    its rows come sorted and leave as XML sheet by sheet. A row without cells is empty; a sheet of over 1 048 576 rows raises.
    """

    def books(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for path, own in groupby(_pairs(batches), key=lambda r: r[0]):
            sheets: list[_Sheet] = []
            for (_, name), part in groupby(own, key=lambda r: (r[1], r[2])):
                free = free_sheet_name(name, {s.name.lower() for s in sheets})
                sheets.append(_Sheet(free, _sheet_xml((r[4] for r in part), bold_header)))
            yield path, _workbook(sheets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file in books(batches):
            yield pa.RecordBatch.from_pylist([dict(zip(_FILE.names, file, strict=True))], _FILE)

    order = ["path", "sheet_no", "sheet", "row_no"]
    return rows.select(*order, "cells").repartition("path").sortWithinPartitions(*order).mapInArrow(run, "path string, content binary")


def text_cells(cells: Column) -> Column:
    """An array of texts as cells for ``workbooks``, numbers where they clearly are some."""
    return F.transform(cells, lambda c: typed(c))


def tables(spark: SparkSession, path: str | list[str], *, every_sheet: bool = True) -> DataFrame:
    """``path``, ``sheet_no``, ``sheet``, ``row_no``, ``cells``, ``error`` of delimited files (one sheet, named as the file) and workbooks.

    A file with another ending gives a row with ``error``.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content").withColumn("end", F.lower(suffix("path")))
    name = F.substring_index("path", "/", -1)
    delimited, sheets = F.col("end").isin(".csv", ".tsv", ".txt"), F.col("end").isin(".xlsx", ".xlsm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((where, mark, k, cells) for where, content in _pairs(batches) for mark, all_rows in [rows_of(decoded_bytes(content) or "", where)] for k, cells in enumerate(all_rows))
        return _batched(rows, pa.schema([("path", pa.string()), ("delimiter", pa.string()), ("row_no", pa.int64()), ("cells", pa.list_(pa.string()))]))

    texts = typed_rows(files.where(delimited).select("path", "content").mapInArrow(run, "path string, delimiter string, row_no long, cells array<string>"))
    one = texts.select("path", F.lit(0).alias("sheet_no"), F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("sheet"), "row_no", "cells", F.lit(None).cast("string").alias("error"))
    other = files.where(~delimited & ~sheets).select("path", F.concat(F.lit("'"), name, F.lit("' is not a CSV or Excel file.")).alias("error"))
    out = one.unionByName(workbook_rows(files.where(sheets))).unionByName(other, allowMissingColumns=True)
    return out if every_sheet else out.where("sheet_no = 0 or error is not null")


def row_counts(rows: DataFrame) -> DataFrame:
    """``path``, ``rows``: rows below the headers of all sheets of a file."""
    each = rows.where("error is null").groupBy("path", "sheet_no").agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("n"))
    return each.groupBy("path").agg(F.sum("n").alias("rows"))


def labels(rows: DataFrame) -> DataFrame:
    """With ``label``: the file's name, and the sheet's behind it where a file has several with rows."""
    name = F.substring_index("path", "/", -1)
    several = rows.where("error is null").groupBy("path").agg((F.min("sheet_no") < F.max("sheet_no")).alias("several"))
    return rows.join(several, "path", "left").withColumn("label", F.when(F.col("several"), F.concat(name, F.lit(" - "), "sheet")).otherwise(name)).drop("several")


# -------------------------------------------------------------------- Word files
#: Faces that mean code.
CODE_FACES = {"consolas", "courier new", "courier"}


def _w(name: str) -> str:
    return _mark(WORD, name)


def _on(properties, name: str) -> bool:
    x = properties.find(_w(name)) if properties is not None else None
    return x is not None and x.get(_w("val"), "1") not in ("0", "false", "off")


def _run_text(run) -> str:
    out = []
    for x in run:
        tag = x.tag.rsplit("}", 1)[-1]
        if tag == "t":
            out.append(x.text or "")
        elif tag in ("tab", "ptab"):
            out.append("\t")
        elif tag == "cr" or (tag == "br" and x.get(_w("type"), "textWrapping") == "textWrapping"):
            out.append("\n")
        elif tag == "noBreakHyphen":
            out.append("-")
    return "".join(out)


def _pieces(paragraph, to: dict[str, str]) -> list[tuple[str, bool, bool, bool, str]]:
    """(text, bold, italic, code, link) of a paragraph's runs; like neighbours are one."""
    found = []
    for x in paragraph:
        if x.tag == _w("hyperlink"):
            base, anchor = to.get(x.get(_mark(RELS, "id")), ""), x.get(_w("anchor"), "")
            found.append(("".join(_run_text(r) for r in x.findall(_w("r"))), False, False, False, f"{base}#{anchor}" if base and anchor else base))
        elif x.tag == _w("r"):
            look = x.find(_w("rPr"))
            face = look.find(_w("rFonts")) if look is not None else None
            found.append((_run_text(x), _on(look, "b"), _on(look, "i"), face is not None and face.get(_w("ascii"), "").lower() in CODE_FACES, ""))
    return [("".join(p[0] for p in same), *look) for look, same in groupby((p for p in found if p[0]), key=lambda p: p[1:])]


def _cell_text(cell, to: dict[str, str]) -> str:
    return "\n".join("".join(p[0] for p in _pieces(x, to)) for x in cell.findall(_w("p"))).strip()


def _grid(table, to: dict[str, str]) -> list[list[str]]:
    """A table's texts; a cell over several columns or rows stands in each of them."""
    out: list[list[str]] = []
    for row in table.findall(_w("tr")):
        line: list[str] = []
        for cell in row.findall(_w("tc")):
            look = cell.find(_w("tcPr"))
            span = look.find(_w("gridSpan")) if look is not None else None
            down = look.find(_w("vMerge")) if look is not None else None
            goes_on = down is not None and down.get(_w("val"), "continue") == "continue" and out and len(line) < len(out[-1])
            said = out[-1][len(line)] if goes_on else _cell_text(cell, to)
            line += [said] * (int(span.get(_w("val"))) if span is not None else 1)
        out.append(line)
    return out


#: What a style's name says about a paragraph: the first pattern that is found in it decides.
_KINDS = [("heading", r"^title$|^heading \d"), ("number", "list number"), ("bullet", "list"), ("quote", "quote"), ("code", "code|html preformatted")]


def _paragraph(x, styles: dict[str, str], to: dict[str, str]) -> tuple | None:
    """(kind, level, text, rows, runs) of a paragraph; None for a blank one."""
    pieces = _pieces(x, to)
    text = "".join(p[0] for p in pieces)
    if not text.strip():
        return None
    look = x.find(_w("pPr"))
    style = look.find(_w("pStyle")) if look is not None else None
    name = styles.get(style.get(_w("val")) if style is not None else None, "").lower()
    numbering = look.find(_w("numPr")) if look is not None else None
    kind = next((k for k, pattern in _KINDS if re.search(pattern, name)), None)
    if numbering is not None and kind in (None, "quote", "code"):
        kind = "bullet"
    if kind is None and name == "no spacing" and all(p[3] for p in pieces):
        kind = "code"
    level = 0
    if kind == "heading":
        level = 1 if name == "title" else min(6, int(name[8]))
    elif kind in ("number", "bullet"):
        digit = re.search(r"\d$", name)
        deep = numbering.find(_w("ilvl")) if numbering is not None else None
        level = int(digit[0]) - 1 if digit and int(digit[0]) > 1 else int(deep.get(_w("val"))) if deep is not None else 0
    runs = [dict(zip(("text", "bold", "italic", "code", "link"), p, strict=True)) for p in pieces]
    return kind or "para", level, text, [], runs


def _word_blocks(path: str, content: bytes) -> Iterator[tuple]:
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        body = ElementTree.fromstring(book.read("word/document.xml")).find(_w("body"))
        to, styles = _targets(book, "word/document.xml"), {}
        if "word/styles.xml" in book.namelist():
            for s in ElementTree.fromstring(book.read("word/styles.xml")).findall(_w("style")):
                name = s.find(_w("name")).get(_w("val"))
                styles[s.get(_w("styleId"))] = name
                if s.get(_w("type")) == "paragraph" and s.get(_w("default")) in ("1", "true"):
                    styles[None] = name
        found = []
        for x in body:
            if x.tag == _w("p"):
                found.append(_paragraph(x, styles, to))
            elif x.tag == _w("tbl") and x.find(_w("tr")) is not None:
                found.append(("table", 0, "", _grid(x, to), []))
        yield from ((path, k, *block, None) for k, block in enumerate(b for b in found if b))
    except _BROKEN as problem:
        yield path, None, None, None, None, None, None, f"This file cannot be read as a Word document ({problem})."


_BLOCK_RUN = pa.struct([("text", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_()), ("code", pa.bool_()), ("link", pa.string())])
_BLOCKS = pa.schema([("path", pa.string()), ("place", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("rows", pa.list_(pa.list_(pa.string()))), ("runs", pa.list_(_BLOCK_RUN)), ("error", pa.string())])


def word_blocks(files: DataFrame) -> DataFrame:
    """``path``, ``place``, ``kind``, ``level``, ``text``, ``rows``, ``runs``, ``error``: the blocks of Word files (``path``, ``content``).

    The block model is that of ``documents``; its renderers take ``runs`` where there are some. A cell that spans columns
    is kept once. A file that can't be read gives one row with ``error``; a null content is such a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched((r for path, content in _pairs(batches) for r in _word_blocks(path, content or b"")), _BLOCKS)

    out = files.select("path", "content").mapInArrow(run, f"path string, place int, kind string, level int, text string, rows array<array<string>>, runs array<{RUN.simpleString()}>, error string")
    return out.withColumn("rows", F.transform("rows", without_left_repeats))


def _word_run(r: dict, *, bold: bool = False, half_points: int | None = None) -> str:
    said = r["text"] + (f" ({r['link']})" if r["link"] and r["link"] != r["text"] else "")
    look = ("<w:rFonts w:ascii=\"Consolas\" w:hAnsi=\"Consolas\"/>" if r["code"] else "") + ("<w:b/>" if r["bold"] or bold else "") + ("<w:i/>" if r["italic"] else "")
    look += f'<w:sz w:val="{half_points}"/>' if half_points else ""
    pieces = {"\t": "<w:tab/>", "\n": "<w:br/>"}
    inner = "".join(pieces.get(p) or f'<w:t xml:space="preserve">{escape(p)}</w:t>' for p in re.split("([\t\n])", re.sub("\r\n?", "\n", said)) if p)
    inner = re.sub("[\x00-\x08\x0b-\x1f\ufffe\uffff]", "", inner)
    return f"<w:r>{f'<w:rPr>{look}</w:rPr>' if look else ''}{inner}</w:r>"


def _said(text: str, code: bool = False) -> dict:
    return {"text": text, "bold": False, "italic": False, "code": code, "link": ""}


def _word_paragraph(style: str | None, runs: str) -> str:
    return f"<w:p>{f'<w:pPr><w:pStyle w:val={quoteattr(style)}/></w:pPr>' if style else ''}{runs}</w:p>"


#: Styles by id: (name, what its paragraphs look like).
_STYLES = {
    "Normal": ("Normal", ""), "NoSpacing": ("No Spacing", '<w:spacing w:after="0"/>'), "Quote": ("Quote", '<w:ind w:left="720"/>'),
    **{f"Heading{k}": (f"heading {k}", f'<w:outlineLvl w:val="{k - 1}"/>') for k in range(1, 10)},
    **{f"List{kind}{k if k > 1 else ''}": (f"List {kind}{f' {k}' if k > 1 else ''}", f'<w:numPr><w:ilvl w:val="{k - 1}"/><w:numId w:val="{n}"/></w:numPr>') for n, kind in enumerate(("Bullet", "Number"), 1) for k in (1, 2, 3)},
}


def _word_style(block: dict) -> str | None:
    if block["kind"] == "heading":
        return f"Heading{min(max(block['level'], 1), 9)}"
    if block["kind"] in ("bullet", "number"):
        deep = min(3, block["level"] + 1)
        return f"List{block['kind'].capitalize()}{deep if deep > 1 else ''}"
    return {"quote": "Quote", "code": "NoSpacing"}.get(block["kind"])


def _word_block(block: dict) -> str:
    if block["kind"] == "table":
        width = max((len(r) for r in block["rows"]), default=0)
        cell = lambda text, first: f"<w:tc>{_word_paragraph(None, _word_run(_said(text or ''), bold=first) if text else '')}</w:tc>"
        rows = "".join(f"<w:tr>{''.join(cell(c, k == 0) for c in [*r, *[''] * (width - len(r))])}</w:tr>" for k, r in enumerate(block["rows"]))
        lines = "".join(f'<w:{side} w:val="single" w:sz="4"/>' for side in ("top", "left", "bottom", "right", "insideH", "insideV"))
        return f'<w:tbl><w:tblPr><w:tblBorders>{lines}</w:tblBorders></w:tblPr><w:tblGrid>{"<w:gridCol/>" * width}</w:tblGrid>{rows}</w:tbl>'
    if block["kind"] == "code":
        return _word_paragraph(_word_style(block), _word_run(_said(block["text"], True), half_points=19))
    return _word_paragraph(_word_style(block), "".join(_word_run(r) for r in block["runs"] or []))


def _word_file(blocks: list[dict]) -> bytes:
    styles = "".join(f'<w:style w:type="paragraph"{" w:default=%s" % quoteattr("1") if k == "Normal" else ""} w:styleId="{k}"><w:name w:val="{name}"/><w:pPr>{look}</w:pPr></w:style>' for k, (name, look) in _STYLES.items())
    step = lambda k, form, text: f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="{form}"/><w:lvlText w:val="{text}"/><w:pPr><w:ind w:left="{360 * (k + 1)}" w:hanging="360"/></w:pPr></w:lvl>'
    kinds = [("bullet", lambda k: "•"), ("decimal", lambda k: f"%{k + 1}.")]
    numbering = "".join(f'<w:abstractNum w:abstractNumId="{n}">{"".join(step(k, form, text(k)) for k in range(3))}</w:abstractNum>' for n, (form, text) in enumerate(kinds))
    numbering += "".join(f'<w:num w:numId="{n + 1}"><w:abstractNumId w:val="{n}"/></w:num>' for n in range(2))
    page = lambda tag, inner: f'{_HEAD}<w:{tag} xmlns:w="{WORD}">{inner}</w:{tag}>'
    return _package(
        "word/document.xml", "wordprocessingml.document.main", {"word/styles.xml": "wordprocessingml.styles", "word/numbering.xml": "wordprocessingml.numbering"},
        [("styles", "styles.xml"), ("numbering", "numbering.xml")],
        {"word/document.xml": page("document", f"<w:body>{''.join(map(_word_block, blocks))}</w:body>"), "word/styles.xml": page("styles", styles), "word/numbering.xml": page("numbering", numbering)},
    )


def word_files(blocks: DataFrame, id_col: str = "path") -> DataFrame:
    """``path``, ``content``: a Word file for each id of ``blocks`` (place, kind, level, text, rows, runs).

    A run with a link has it in brackets behind its text. Control characters are left out. A file's blocks are one row.
    """
    held = F.array_sort(F.collect_list(F.struct("place", "kind", "level", "text", "rows", "runs")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, own in _pairs(batches):
            yield pa.RecordBatch.from_pylist([{"path": path, "content": _word_file(own)}], _FILE)

    return blocks.groupBy(F.col(id_col).cast("string").alias("path")).agg(held.alias("blocks")).mapInArrow(run, "path string, content binary")


def save(files: DataFrame, folder: str) -> None:
    """Writes ``content`` to ``path`` below a folder that all executors have mounted; a reader never sees half a file."""

    def write(rows) -> None:
        for path, content in rows:
            where = os.path.join(folder, path)
            os.makedirs(os.path.dirname(where), exist_ok=True)
            part = f"{where}.{os.getpid()}.part"
            with open(part, "wb") as out:
                out.write(content)
            os.replace(part, where)

    files.select("path", "content").foreachPartition(write)
