"""Literal cases of the scalar functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weir.functions import media as X
from weir.functions import names as N
from weir.functions import text as T
from weir.functions import values as V


@pytest.fixture(scope="module")
def one(spark):
    def run(column, *values, types="string"):
        names = [f"v{k}" for k in range(len(values))]
        df = spark.createDataFrame([values], ", ".join(f"{n} {types}" for n in names))
        return df.select(column(*(F.col(n) for n in names)).alias("x")).first()["x"]

    return run


def test_clean(one):
    assert one(lambda c: T.clean(c, join_broken=False, unique_lines=True), "“Hi” – there\nsame\nSame\n") == '"Hi" - there\nsame\n'
    assert one(T.clean, "one  two\n") == "one two\n"
    broken = "This  is a line that was broken by the page and\ngoes on. The word con-\ncrete is cut.\n\n- first\n- second\n"
    assert one(T.clean, broken) == "This is a line that was broken by the page and goes on. The word concrete is cut.\n\n- first\n- second\n"
    assert one(T.clean, "") == "\n"
    assert one(T.clean, None) is None


def test_sentences(one):
    assert one(T.sentences, 'One is here. "Two" follows! three no? Four… É five. 6 ends') == ["One is here.", '"Two" follows! three no?', "Four…", "É five.", "6 ends"]
    assert one(T.sentences, "   ") == []


def test_text_stats(one):
    assert one(T.text_stats, "word " * 1234) == "1.234 words. 6 min read"
    assert one(T.text_stats, "") == "0 words. 1 min read"


def test_html(one):
    page = "<style>p{}</style><h1>T</h1><p>a &amp; b<br/>c &lt; d</p><script>x='</p>'</script><!-- no -->"
    assert one(T.html_to_text, page) == "T\na & b\nc < d\n"
    assert one(T.escape, "a < b & \"c\" 'd'") == "a &lt; b &amp; &quot;c&quot; &#x27;d&#x27;"


def test_subtitles(one):
    srt = "1\n00:00:01,000 --> 00:00:02,000\n<i>Hello and</i>\nwelcome.\n\n2\n00:00:03,000 --> 00:00:04,000\nToday we talk.\n"
    assert one(T.subtitles_to_text, srt) == "Hello and welcome. Today we talk."


def test_urls(one):
    assert one(T.urls, "see https://a.b/c, https://d.e and https://a.b/c.") == ["https://a.b/c", "https://d.e"]


def test_render(one):
    assert one(lambda c: T.rendered(c, F.lit("T&C"), "html"), "a < b\n\nc") == "<h1>T&amp;C</h1>\n<p>a &lt; b</p>\n<p>c</p>\n"
    assert one(lambda c: T.rendered(c, F.lit("T"), "md"), "a\n\nb\n") == "# T\n\na\n\nb\n"


@pytest.mark.parametrize(("cell", "comma", "want"), [("00184", False, ("text", "00184")), ("42", False, ("int", 42)), ("3,5", True, ("float", 3.5)), ("3,5", False, ("text", "3,5")), ("007", False, ("text", "007")), ("00.5", False, ("float", 0.5)), ("-0", False, ("int", 0)), ("  x ", False, ("text", "  x ")), ("1234567890123456", False, ("text", "1234567890123456")), ("", False, ("null", None)), (None, False, ("null", None))])
def test_typed(one, cell, comma, want):
    got = one(lambda c: V.typed(c, comma), cell)
    assert (got.kind, {"int": got.i, "float": got.f, "text": got.t, "null": None}[got.kind]) == want


def test_cell_text(one):
    assert one(lambda c: V.cell_text(c, "double"), 7.0, types="double") == "7"
    assert one(lambda c: V.cell_text(c, "double", True), 1234.5, types="double") == "1234,5"
    assert one(lambda c: V.cell_text(c, "boolean"), True, types="boolean") == "TRUE"
    assert one(lambda c: V.cell_text(c, "double"), None, types="double") == ""


@pytest.mark.parametrize(("n", "want"), [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1468006, "1.4 MB"), (5 << 40, "5120.0 GB"), (-3, "0 B"), (1075, "1.0 KB"), (265472, "259.2 KB")])
def test_human_size(one, n, want):
    assert one(V.human_size, n, types="long") == want


@pytest.mark.parametrize(("seconds", "want"), [(None, "estimating time left"), (4.0, "a few seconds left"), (32.0, "about 30 s left"), (150.0, "about 2 min left"), (3720.0, "about 1 h 02 min left")])
def test_describe_seconds(one, seconds, want):
    assert one(V.describe_seconds, seconds, types="double") == want


@pytest.mark.parametrize(("text", "want"), [("90", 90.0), ("1:30", 90.0), ("0:01:30,5", 90.5), ("1m30", None), ("", None), ("1:2:3:4", None)])
def test_parse_time(one, text, want):
    assert one(V.parse_time, text) == want


def test_times(one):
    assert one(V.srt_time, 3661.5, types="double") == "01:01:01,500"
    assert one(V.clock, 59, types="long") == "0:59" and one(V.clock, 3661, types="long") == "1:01:01"


def test_letters_of_large_numbers(one):
    def name(n: int) -> str:
        return name((n - 1) // 26) + chr(65 + (n - 1) % 26) if n else ""

    for n in (475254, 475255, 321272406, 321272407, 2**53 + 1, 2**63 - 1):
        assert one(V.letters, n, types="long") == name(n)


@pytest.mark.parametrize(("mode", "value", "enlarge", "want"), [("longest", 400, False, (400, 200)), ("width", 2000, False, (800, 400)), ("width", 1600, True, (1600, 800)), ("percent", 25, False, (200, 100))])
def test_new_size(one, mode, value, enlarge, want):
    assert tuple(one(lambda w, h: V.new_size(w, h, mode, value, enlarge), 800, 400, types="int")) == want


def test_numbers(one):
    assert [one(V.letters, n, types="long") for n in (1, 26, 27, 703, 0)] == ["A", "Z", "AA", "AAA", "0"]
    assert [one(V.roman, n, types="long") for n in (1994, 3999, 4000, 0)] == ["MCMXCIV", "MMMCMXCIX", "4000", "0"]
    assert [one(lambda c: V.number_text(c, 3), n, types="long") for n in (7, 1234, -5)] == ["007", "1234", "-005"]
    assert one(lambda a, b: V.target_kbps(a, b), 1.0, 3600.0, types="double") is None
    assert 1000 < one(lambda a, b: V.target_kbps(a, b), 25.0, 120.0, types="double") < 1700


@pytest.mark.parametrize(("name", "want"), [("a/b:c*d", "a b c d"), ("  . x . ", "x"), ("", "untitled"), ("con.txt", "_con.txt"), ("a" * 200, "a" * 120), (None, "untitled"), ("été", "été")])
def test_safe_filename(one, name, want):
    assert one(N.safe_filename, name) == want


def test_names(spark, one):
    order = spark.createDataFrame([("trip 10",), ("trip 2",), ("Alpha",), ("2 b",), ("10 a",)], "name string").orderBy(N.natural_key("name"))
    assert [r.name for r in order.collect()] == ["2 b", "10 a", "Alpha", "trip 2", "trip 10"]
    assert one(N.without_number, "07 - Holiday") == "Holiday" and one(N.without_number, "2024") == "2024"
    assert one(N.extensions, "jpg, .PNG pdf") == [".jpg", ".png", ".pdf"]
    assert one(N.archive_stem, "photos.tar.gz") == "photos" and one(N.archive_kind, "X.TGZ") == "tar" and one(N.archive_kind, "x.txt") is None
    assert one(N.unsafe_reason, "a/../b") and one(N.unsafe_reason, "C:\\x") and one(N.unsafe_reason, "/x") and not one(N.unsafe_reason, "a..b/c")
    assert one(lambda n, p: N.wifi_text(n, p, F.lit("WPA"), F.lit(True)), "My;Net", 'p"w') == 'WIFI:T:WPA;S:My\\;Net;P:p\\"w;H:true;;'
    assert one(lambda c: N.code_problem(c, "ean13"), "123") == "Needs 12 or 13 digits."
    assert one(lambda c: N.code_problem(c, "isbn13"), "978-0-306-40615-7") == ""


def test_templates():
    assert N.template_problem("{n} - {name}") is None
    assert "Unknown" in N.template_problem("{nope}") and "digits" in N.template_problem("{n:x}")
    assert N.template_problem("") and N.template_problem("same") and N.template_problem("a/{n}")


def test_dated_folder(spark):
    df = spark.sql("select timestamp_ntz'2026-07-12 10:00:00' as d, cast(null as timestamp_ntz) as e")
    at = lambda c, p: df.select(N.dated_folder(F.col(c), p, F.lit("JPG"), F.lit("Videos"))).first()[0]
    assert at("d", "{year}/{month} - {monthname}") == "2026/07 - July"
    assert at("d", "{kind}/{year}-{mon}-{day} {weekday}") == "Videos/2026-Jul-12 Sunday"
    assert at("d", "{ext}") == "jpg" and at("e", "{year}") == "No date"


def test_templates_and_numbers_that_are_none(spark):
    assert N.folder_template_problem("{year}/{month} - {monthname}") is None and "Unknown" in N.folder_template_problem("{n}")
    assert N.folder_template_problem("same") and N.folder_template_problem("") and N.folder_template_problem("{year}:x") and not N.folder_template_problem("{date}/x")
    row = spark.range(1).select(X.clamped(F.lit("x"), 1, 9, 5), X.clamped(F.lit("70"), 1, 9, 5), X.target_bytes(F.lit("y")), X.target_bytes(F.lit("0"))).first()
    assert tuple(row) == (5, 9, 500 * 1024, 1024)


def test_dated_folders_compile(spark):
    try:
        spark.conf.set("spark.sql.codegen.fallback", "false")
        spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
        when = F.current_timestamp()
        made = spark.range(3).select(N.dated_folder(when, "{year}/{month} - {monthname}/{kind}/{weekday}", F.lit("JPG"), F.concat(F.col("id").cast("string"), F.lit("x"))).alias("f"))
        assert made.count() == 3 and made.first().f.count("/") == 3
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
        spark.conf.unset("spark.sql.codegen.factoryMode")


def test_joined_lines_are_those_of_a_fold(spark):
    """The text as it grows line by line, with short beginnings, lone dashes, cut words and lists."""
    import random
    import re

    from pyspark.sql import functions as F

    def grown(lines):
        out = ""
        for line in lines:
            if not out:
                out = line
            elif re.match(r"([-*•]|[0-9]+[.)])\s", line) or out.endswith(":") or (len(out) < 40 and out[-1] in ".!?"):
                out += "\n" + line
            elif out.endswith("-") and not out.endswith(" -") and line[0].islower():
                out = out[:-1] + line
            else:
                out += " " + line
        return out

    rnd = random.Random(5)
    bits = ["-", "a", "b-", "x -", "con-", "crete", "Up", "- item", "12) x", "head:", "End.", "so?", "-a", "é", "word " * 9 + "w", "q" * 39 + ".", ":", "--", "a long enough line that goes on."]
    rows = [([rnd.choice(bits) for _ in range(rnd.randint(0, 12))],) for _ in range(600)] + [(["a-"] * 300,), (["w x"] * 3000,), (None,)]
    df = spark.createDataFrame(rows, "lines array<string>").repartition(4)
    got = df.select("lines", T.joined_lines(F.col("lines")).alias("text")).collect()
    assert all(r.text == (None if r.lines is None else grown(r.lines)) for r in got) and len(got) == len(rows)
