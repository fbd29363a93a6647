"""Delimited files by ranges against the csv module over whole texts."""

from __future__ import annotations

import csv
import random

import pytest

from weir.sources import delimited, files


def cell(rnd: random.Random) -> str:
    kind = rnd.random()
    if kind < 0.3:
        return rnd.choice(["a", "12", "x y", "", " ", "é"])
    if kind < 0.55:
        return '"' + rnd.choice(["l1\nl2", 'q""q', "", "\n\n", "a;b,c\t|", '""', "\r\n x", "ü\n" * 9]) + '"'
    if kind < 0.65:
        return rnd.choice(['5" pipe', 'a"b"c', '"x"y', '" "', '"" ""'])
    return "w" * rnd.randint(0, 9)


#: What stands at a file's end: nothing, blank rows of many kinds, quotes that never close.
ENDS = ["", "\n", "\n\n\n", "\n;;\n", '\n"\n"\n', '\n"";" "\n', '\n"op\nen', '\n"open\nto the end', '\n"open\n', '\n"', '\n"\n', '\n";"\n', '\n""""\n']


def texts() -> list[bytes]:
    out = []
    for seed in range(60):
        rnd = random.Random(seed)
        mark, feed = rnd.choice(";,\t|"), rnd.choice(["\n", "\r\n"])
        text = feed.join(mark.join(cell(rnd) for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(1, 150)))
        data = (text + ENDS[seed % len(ENDS)].replace("\n", feed)).encode()
        out.append((b"", b"", b"\xef\xbb\xbf")[seed % 3] + data + (b"\n\xe9;\xff" if seed % 5 == 4 and seed % 3 < 2 else b""))
    return out + [b"", b"\n\n", b'"', b"one", b'a;b\n"1;2\n' * 200, b'x,"' + b"long\n" * 30_000 + b'",y\nz,1,2\n']


@pytest.fixture
def small_ranges(spark):
    """Ranges of 211 bytes: the larger files have dozens."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    before = {n: spark.conf.get(n, None) for n in names}
    for name, value in zip(names, ("211", "1", "1"), strict=True):
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def wanted(data: bytes, name: str) -> list | None:
    try:
        return files.rows_of(files.decoded_bytes(data), name)[1]
    except csv.Error:
        return None


def test_rows_of_many_ranges_are_the_readers(spark, tmp_path, small_ranges):
    limit = csv.field_size_limit(10**9)
    try:
        want = {}
        for k, data in enumerate(texts()):
            rows = wanted(data, f"f{k}.csv")
            if rows is not None and len(data) < 20_000:
                (tmp_path / f"f{k}.csv").write_bytes(data)
                want |= {(f"f{k}.csv", n): row for n, row in enumerate(rows)}
        got = delimited.split_rows(spark, str(tmp_path)).collect()
    finally:
        csv.field_size_limit(limit)
    assert len(got) == len({(r.source, r.row_no) for r in got}) and not any(r.error for r in got)
    assert {(r.source, r.row_no): r.cells for r in got} == want and len(want) > 3000


def test_a_record_of_thousands_of_ranges(spark, tmp_path, small_ranges):
    data = texts()[-1]
    (tmp_path / "long.csv").write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    got = sorted(delimited.split_rows(spark, str(tmp_path / "long.csv")).collect(), key=lambda r: r.row_no)
    assert [r.cells for r in got] == [["x", "long\n" * 30_000, "y"], ["z", "1", "2"]]


def test_ranges_are_described_for_the_way_they_begin(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_bytes(b'k;t\n' + b'1;"in\nside ""x"" and\nmore"\n' * 40 + b";;\n\n")
    lines = delimited._lines(spark, str(tmp_path / "a.csv"))
    rows = sorted(delimited.ranges(lines, delimited._dialects(lines)).collect(), key=lambda r: r.range)
    assert len(rows) > 4 and any(r.inside for r in rows) and not all(r.inside for r in rows) and not rows[0].inside
    assert {r["last"] for r in rows} == {40} and [r.first for r in rows] == sorted(r.first for r in rows) and all(r.utf8 and not r.no_feed for r in rows)


def test_odd_files(spark, tmp_path):
    (tmp_path / "wide.csv").write_bytes("a;b\n1;2\n".encode("utf-16"))
    (tmp_path / "cr.csv").write_bytes(b"a;b\n1\r2;3\n4;5\n")
    (tmp_path / "tab.tsv").write_bytes(b"a,b\tc\n")
    rows = {}
    for r in delimited.split_rows(spark, str(tmp_path)).collect():
        rows.setdefault(r.source, []).append((r.row_no, r.cells, bool(r.error)))
    assert rows["wide.csv"] == [(0, None, True)] and sorted(rows["tab.tsv"]) == [(0, ["a,b", "c"], False)]
    assert sorted(rows["cr.csv"])[0] == (0, ["a", "b"], False) and sorted(rows["cr.csv"])[1][2] and sorted(rows["cr.csv"])[2] == (2, ["4", "5"], False)


def test_table_by_header(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text('name;Note;note;\nAnna;"two\nlines";1;x\n\nLuca;"";"a ""b""";\n' * 1)
    (tmp_path / "b.csv").write_text("name;Note;note;\nSara\n")
    got = delimited.table(spark, str(tmp_path))
    assert got.columns == ["name", "Note1", "note2", "_c3"]
    assert sorted(map(tuple, got.collect())) == [("Anna", "two\nlines", "1", "x"), ("Luca", None, 'a "b"', None), ("Sara", None, None, None)]


def test_texts_of_two_byte_characters(spark, tmp_path):
    for name, data in {"le": "grüße\n".encode("utf-16"), "be": b"\xfe\xff" + "x\n".encode("utf-16-be"), "zero": b"a\x00b", "plain": b"ok"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.error) for r in files.texts(spark, str(tmp_path)).collect()}
    assert got == {"le": ("grüße\n", None), "be": ("x\n", None), "plain": ("ok", None), "zero": (None, "This is not a text file.")}


def test_csv_records_tells_empty_from_null_texts_and_is_not_misled_by_them(spark, tmp_path):
    import __spark_entry__ as entry

    texts = ["','" * 3000, ',"x",' * 1000, "", None, "\n", '"', '""', "a\r\nb\r", "\x00", " x ", ";", "null", '";"', "\\"]
    rows = [(k, ("en", "", None)[k % 3], ("", "s", None, "a;b")[k % 4], text) for k, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = entry.queries()["csv_records"](spark, str(tmp_path)).select("doc_id", "lang", "source", "text")
    assert sorted(map(tuple, got.collect())) == rows


def test_ranges_that_change_between_the_passes_are_an_error(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text("a;b\n" + "1;2\n" * 1000)
    rows = delimited.split_rows(spark, str(tmp_path / "a.csv"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    with pytest.raises(Exception, match="other ranges"):
        rows.collect()


def test_a_given_delimiter_is_one_of_those_known(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n" * 9)
    assert {len(r.cells) for r in delimited.split_rows(spark, str(tmp_path / "a.csv"), "|").collect()} == {1}
    with pytest.raises(ValueError, match="delimiter"):
        delimited.split_rows(spark, str(tmp_path / "a.csv"), "x")
