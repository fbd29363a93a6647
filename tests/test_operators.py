"""Literal cases of the relational operators, sources, streams and recipes."""

from __future__ import annotations

import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from weir.functions import names as N
from weir.operators import compare, documents, duplicates, intervals, jobs, plans, summaries, tables
from weir.plans import recipes
from weir.sources import files, sinks
from weir.streaming import watch

FILES = "id long, path string, size long, modified double, pixels long, content string"


def test_duplicates(spark):
    same, other = "x" * 200_000, "y" * 200_000
    rows = spark.createDataFrame([(1, "a/report.pdf", 200_000, 1.0, 0, same), (2, "b/report copy.pdf", 200_000, 2.0, 0, same), (3, "b/other.pdf", 200_000, 0.0, 0, other), (4, "c/a", 4, 0.0, 0, "aaaa"), (5, "c/b", 4, 0.0, 0, "aaaa")], FILES)
    marked = duplicates.mark(duplicates.exact_groups(rows, min_size=1024), "oldest")
    assert {(r.group_id, r.id, r.keep) for r in marked.collect()} == {(1, 1, True), (1, 2, False)}
    assert tuple(duplicates.summary(marked).first()) == (1, 1, 200_000)
    assert duplicates.exact_groups(rows).count() == 4
    assert [r.problem for r in duplicates.refused(marked.withColumn("keep", F.lit(False))).collect()] == ["keep at least one"]


@pytest.mark.parametrize(("rule", "want"), [("largest", 2), ("oldest", 1), ("newest", 3), ("shortest", 3)])
def test_keep_rules(spark, rule, want):
    rows = spark.createDataFrame([(1, "long/name/a", 5, 1.0, 10), (2, "name/b", 5, 2.0, 20), (3, "c", 5, 3.0, 20)], "id long, path string, size long, modified double, pixels long").withColumn("group_id", F.lit(1))
    assert [r.id for r in duplicates.mark(rows, rule).where("keep").collect()] == [want]


def test_similar(spark):
    codes = [(1, 0), (2, 0b111), (3, 0b111111), (4, -1), (5, 0), (6, None)]
    pairs = duplicates.similar_pairs(spark.createDataFrame(codes, "id long, code long"), 95)
    assert {tuple(r) for r in pairs.collect()} == {(1, 2, 3), (2, 3, 3), (1, 5, 0)}
    assert {tuple(r) for r in duplicates.clusters(pairs).collect()} == {(1, 1), (2, 1), (3, 1), (5, 1)}


def test_relative_to_root(spark):
    rows = spark.createDataFrame([("/a/b/c/x",), ("/a/b/y",)], "path string")
    assert [r.relative for r in duplicates.relative_to_root(rows).orderBy("path").collect()] == ["c/x", "y"]


def test_compare(spark):
    schema = "rel string, size long, modified double, hash string"
    left = spark.createDataFrame([("same", 4, 1.0, "s"), ("sub/deep", 4, 1.0, "d"), ("Changed", 4, 1.0, "aaaa"), ("only-left", 1, 1.0, "l")], schema)
    right = spark.createDataFrame([("same", 4, 1.0, "s"), ("sub/deep", 4, 1.0, "d"), ("changed", 4, 1.5, "bbbb"), ("only-right", 1, 1.0, "r")], schema)
    got = compare.compare(left, right)
    assert {r.rel: r.status for r in got.collect()} == {"same": "identical", "sub/deep": "identical", "Changed": "different", "only-left": "only-left", "only-right": "only-right"}
    assert {r.rel: r.status for r in compare.compare(left, right, quick=True).collect()}["Changed"] == "identical"
    assert {r.status: r.n for r in compare.counts(got.where("status <> 'different'")).collect()}["different"] == 0
    assert {tuple(r) for r in compare.copy_plan(got).collect()} == {("only-left", "right"), ("only-right", "left")}


def test_merge(spark):
    january = spark.createDataFrame([("Anna", "12"), ("Luca", "7"), (" ", None)], ["Name", "Amount"])
    february = spark.createDataFrame([("5", "Sara", "Rome"), ("12", "Anna", "")], ["amount", "NAME", "City"])
    merged = tables.merged({"January.csv": january, "February.csv": february})
    assert merged.columns == ["Name", "Amount", "City", "Source file"]
    assert {tuple(r) for r in merged.collect()} == {("Anna", "12", None, "January.csv"), ("Luca", "7", None, "January.csv"), ("Sara", "5", "Rome", "February.csv"), ("Anna", "12", "", "February.csv")}
    once = tables.first_rows(merged.withColumn("seq", F.monotonically_increasing_id()), ["seq"], ["Source file"])
    assert {(r.Name, r.Amount) for r in once.collect()} == {("Anna", "12"), ("Luca", "7"), ("Sara", "5")} and once.count() == 3


def test_summary(spark):
    text = "Solar panels turn light into electricity. My cat sleeps on the sofa today. Solar electricity from panels is cheap. It rained a little in the morning. Panels make solar electricity for homes."
    got = summaries.summary(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string"), 3)
    assert [r.sentence.split()[0] for r in got.orderBy("place").collect()] == ["Solar", "Solar", "Panels"]


def test_summary_gets_a_text_as_one_string(spark):
    rows = [(1, "solar panel\n\npanel light\nsolar panel light\n", "light light"), (2, "", "solar"), (3, None, None), (4, "one\ntwo\n", "")]
    got = spark.createDataFrame(rows, "id int, said string, rest string").select("id", summaries._told(2)("said", "rest").alias("told"))
    assert {r.id: r.told for r in got.collect()} == {1: [2, 3], 2: [], 3: None, 4: [0, 1]}


def test_summary_of_odd_spaces(spark):
    text = "\u3000Solar \t panels\x1c\u00a0turn light to power.  \n My cat sleeps on the sofa today. Solar! Solar\r\n\x85light is cheap on panels.\u2028Rain fell in the morning here. \x1f"
    got = summaries.summary(spark.createDataFrame([(1, text)], "doc_id int, text string"), 2).collect()
    assert [tuple(r) for r in got] == [(1, 0, "Solar panels turn light to power."), (1, 2, "Solar light is cheap on panels.")]


def test_lines(spark):
    got = summaries.repeated_lines(spark.createDataFrame([(1, "a\nA\n\nb\n\na")], "doc_id int, text string")).first()
    assert got.text == "a\n\nb\n"


def test_renames(spark):
    rows = spark.createDataFrame([("p", "a.txt", "same.txt", 1), ("p", "b.txt", "Same.txt", 2), ("p", "c.txt", "free.txt", 3), ("p", "d.txt", "held.txt", 4)], "parent string, name string, new_name string, seq int")
    got = {r.name: r.problem for r in plans.taken(plans.clashes(rows), spark.createDataFrame([("p", "held.txt"), ("p", "a.txt")], "parent string, name string")).collect()}
    assert got == {"a.txt": "Same new name as 'b.txt'", "b.txt": "Same new name as 'a.txt'", "c.txt": "", "d.txt": "A file or folder with this name is already there"}


def test_numbered(spark):
    rows = spark.createDataFrame([(f"trip {k}",) for k in range(1, 121)], "name string").repartition(5)
    got = plans.numbered(rows, [N.natural_key("name")], start=5, step=2).orderBy("value").collect()
    assert [r.name for r in got] == [f"trip {k}" for k in range(1, 121)] and [r.value for r in got] == [5 + 2 * k for k in range(120)] and {r.digits for r in got} == {3}


def test_styles(spark):
    made = lambda **o: spark.range(1).select(plans.new_name(F.lit("07 - Holiday"), F.lit("03"), **o)).first()[0]
    assert made() == "03 - 07 - Holiday" and made(drop_number=True) == "03 - Holiday"
    assert made(style="name_number", drop_number=True, text="Work") == "Work - Holiday - 03"
    assert made(style="text_number", text="Work") == "Work 03" and made(style="number", text="") == "03"


def test_free_names(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a (2)"), (4, "A"), (5, "b")], "seq int, base string")
    assert [r.name for r in plans.free_names(rows).orderBy("seq").collect()] == ["a", "a (2)", "a (2) (2)", "A (3)", "b"]


def test_silences(spark):
    rows = spark.createDataFrame([("a", 1, 2.0, 5.0), ("a", 2, 7.0, 9.0), ("c", 1, 0.0, 1.0)], "key string, seq long, start double, end double")
    long = spark.createDataFrame([("a", 9.0), ("b", 5.0), ("c", 4.0)], "key string, duration double")
    got = sorted((r.key, round(r.start, 3), round(r.end, 3)) for r in intervals.speech_segments(rows, long).collect())
    # 'b' has no silence at all, so the whole of it stays
    assert got == [("a", 0.0, 2.2), ("a", 4.8, 7.2), ("b", 0.0, 5.0), ("c", 0.8, 4.0)]


@pytest.mark.parametrize(("spec", "want"), [("1-3,7", [[0, 1, 2], [6]]), ("3,1, 2", [[2], [0], [1]]), ("4-end", [[3, 4, 5, 6, 7]]), ("3-1", [[2, 1, 0]]), ("1-2;5", [[0, 1], [4]]), ("9", None), ("x", None), (" ", None), ("0", None)])
def test_pages(spark, spec, want):
    assert spark.range(1).select(intervals.pages(F.lit(spec), F.lit(8))).first()[0] == want


def test_ranges_text(spark):
    assert spark.range(1).select(intervals.ranges_text(F.array(*map(F.lit, [0, 1, 2, 6, 8, 9])))).first()[0] == "1-3,7,9-10"


def test_paragraphs(spark):
    rows = [("k", 1, 0.0, 1.0, "a" * 200 + "."), ("k", 2, 1.0, 2.0, "b" * 100 + "."), ("k", 3, 2.0, 3.0, "c"), ("k", 4, 5.0, 6.0, "d")]
    got = intervals.transcript_paragraphs(spark.createDataFrame(rows, "key string, seq int, start double, end double, text string")).orderBy("n").collect()
    assert [r.text for r in got] == ["a" * 200 + ". " + "b" * 100 + ".", "c", "d"]


def test_time_left(spark):
    rows = [("k", 1, 1.0, 0.5), ("k", 2, 60.0, 0.25), ("k", 3, 90.0, 0.5), ("k", 4, 91.0, 1.0)]
    got = jobs.time_left(spark.createDataFrame(rows, "key string, seq long, elapsed double, fraction double")).orderBy("seq").collect()
    assert [r.left if r.left is None else round(r.left, 6) for r in got] == [None, 180.0, 153.0, 0.0]


def test_otsu(spark):
    two = [(k, 100) for k in (18, 20, 22, 228, 230, 232)]
    assert 20 <= jobs.otsu(spark.createDataFrame(two, "level int, n int")).first()[0] < 230
    assert jobs.otsu(spark.createDataFrame([], "level int, n int")).first()[0] == 128


def test_routes(spark):
    got = {(r.source, r.target): r.route for r in jobs.routes(spark.createDataFrame([("it", "en"), ("en", "de")], "source string, target string")).collect()}
    assert got == {("it", "en"): "it>en", ("en", "de"): "en>de", ("it", "de"): "it>en>de"}


def test_subtitles_for(spark):
    videos = spark.createDataFrame([("/m/films", "one"), ("/m/films", "two"), ("/m/films", "three")], "folder string, stem string")
    subs = spark.createDataFrame([("/m/subs", "one"), ("/m/films", "one.en"), ("/m/subs", "two.it"), ("/x/subs", "three")], "folder string, stem string")
    assert {(r.stem, r.subtitle_folder, r.subtitle) for r in jobs.subtitles_for(videos, subs).collect()} == {("one", "/m/films", "one.en"), ("two", "/m/subs", "two.it")}


MARKDOWN = "# Title\n\nSome **bold** and *it* `c` [l](u)\nmore\n\n## Sub\n- a\n- b\n  - c\n1. x\n2. y\n\n> said\n\n| h | k |\n|---|---|\n| 1 | 2 |\n\n```\ncode *x*\n```\n"


def test_markdown(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, ""), (3, None), (4, " \n\r\n")], "doc_id int, text string")
    blocks = documents.markdown_blocks(docs)
    got = blocks.orderBy("place").collect()
    assert {r.doc_id for r in got} == {1} and [r.place for r in got] == list(range(11))
    assert [r.kind for r in got] == ["heading", "para", "heading", "bullet", "bullet", "bullet", "number", "number", "quote", "table", "code"]
    assert got[5].level == 1 and got[9].rows == [["h", "k"], ["1", "2"]] and got[1].text == "Some **bold** and *it* `c` [l](u) more" and got[10].text == "code *x*"
    said = {to: documents.converted(docs, to).first().text for to in ("txt", "md", "html")}
    assert said["txt"] == "TITLE\n\nSome bold and it c l more\n\nSub\n\n- a\n- b\n  - c\n1. x\n2. y\n\nsaid\n\nh\tk\n1\t2\n\ncode *x*\n"
    assert said["md"] == "# Title\n\nSome **bold** and *it* `c` [l](u) more\n\n## Sub\n\n- a\n- b\n  - c\n1. x\n1. y\n\n> said\n\n| h | k |\n| --- | --- |\n| 1 | 2 |\n\n```\ncode *x*\n```\n"
    assert "<strong>bold</strong> and <em>it</em> <code>c</code> <a href=\"u\">l</a> more</p>" in said["html"]
    assert "<ul>\n<li>a</li>\n<li>b</li>\n<ul>\n<li>c</li>\n</ul>\n</ul>\n<ol>\n<li>x</li>\n<li>y</li>\n</ol>\n<blockquote>said</blockquote>" in said["html"]
    assert "<table><thead><tr><th>h</th><th>k</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>\n<pre><code>code *x*</code></pre>\n</body></html>\n" in said["html"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a\n---\nb\r\rc\r\n* * *", [("para", "a"), ("para", "b"), ("para", "c")]),
        ("# a # ##\n##\n####### x\n#\ty #", [("heading", "a #"), ("para", "## ####### x"), ("heading", "y")]),
        ("> > said\n>\n  >> more ", [("quote", "said"), ("quote", ""), ("quote", "more")]),
        ("```\n# a\n\n  ```x\nb", [("code", "# a\n"), ("para", "b")]),
        ("x\n```\n|a|\n|-|--", [("para", "x"), ("code", "|a|\n|-|--")]),
        ("a | b\n--- | ---\nc", [("para", "a | b --- | --- c")]),
        ("|a|\n--- | ---\n|b|\n--|--\n|c|\n| :--: |\n|d\\|e|", [("table", [["a"], ["b"]]), ("para", "--|--"), ("table", [["c"], ["d\\", "e"]])]),
        ("|a|\n|--|\n|--|\nx|y", [("table", [["a"], ["--"]]), ("para", "x|y")]),
        ("|x|\n|a|\n---", [("para", "|x|"), ("table", [["a"]])]),
        ("|a|\n|b|", [("para", "|a| |b|")]),
        ("\t- a\n  + b\n-c\n- \n12) d\n1.e", [("bullet", "a"), ("bullet", "b"), ("para", "-c"), ("bullet", ""), ("number", "d"), ("para", "1.e")]),
    ],
)
def test_markdown_lines(spark, text, want):
    got = documents.markdown_blocks(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("place").collect()
    assert [(r.kind, r.rows if r.kind == "table" else r.text) for r in got] == want


def test_runs():
    plain = lambda t: (t, False, False, False, "")
    assert documents.runs_of("**a *b* c**d") == [("a ", True, False, False, ""), ("b", True, True, False, ""), (" c", True, False, False, ""), plain("d")]
    assert documents.runs_of("") == [] and documents.runs_of("2 * 3 * 4 a_b [x] (y) [x]( y) `` *") == [plain("2 * 3 * 4 a_b [x] (y) [x]( y) `` *")]
    assert documents.runs_of("_a `b`_ [c *d*](e) **x") == [("a ", False, True, False, ""), ("b", False, True, True, ""), plain(" "), ("c *d*", False, False, False, "e"), plain(" **x")]
    assert documents.runs_of("***a***") == [("*a", True, False, False, ""), plain("*")] and documents.runs_of("**a*") == [("*a", False, True, False, "")]


def test_rendered_runs(spark):
    rows = spark.createDataFrame([(1, "- ** a ** `x|y` <b> & [\"q\"](u&v)\n  1. z\n      - deep\n- end\n\ntext\n1. one\n\n|a|b\n|--|--\n|c")], "doc_id int, text string")
    said = {to: documents.converted(rows, to).first().text for to in ("txt", "md", "html")}
    assert said["txt"] == "-  a  x|y <b> & \"q\"\n  1. z\n      - deep\n- end\n\ntext\n\n1. one\n\na\tb\nc\n"
    assert said["md"] == "-  **a**  `x|y` <b> & [\"q\"](u&v)\n  1. z\n      - deep\n- end\n\ntext\n\n1. one\n\n| a | b |\n| --- | --- |\n| c |  |\n"
    body = said["html"].split("<body>\n")[1]
    assert body.startswith('<ul>\n<li><strong> a </strong> <code>x|y</code> &lt;b&gt; &amp; <a href="u&amp;v">&quot;q&quot;</a></li>\n<ol>\n<li>z</li>\n<ul>\n<ul>\n<li>deep</li>\n</ul>\n</ul>\n</ol>\n<li>end</li>\n</ul>\n<p>text</p>\n<ol>\n<li>one</li>\n</ol>\n<table>')


def test_cells_left(spark):
    assert spark.range(1).select(documents.without_left_repeats(F.array(*map(F.lit, "xxxy")))).first()[0] == ["x", "", "x", "y"]


def test_ocr(spark):
    boxes = [("world", 50.0, 0.0, 90.0, 10.0), ("Hello", 0.0, 1.0, 40.0, 11.0), ("Far below", 0.0, 60.0, 40.0, 70.0)]
    df = spark.createDataFrame([(1, k, *b) for k, b in enumerate(boxes)], "page int, seq int, text string, left double, top double, right double, bottom double")
    assert documents.words_to_text(df).first()["text"] == "Hello world\n\nFar below"


def test_words_of_crowded_pages(spark):
    """Words of many heights, of which some join a line above the last one; brute force over the first words of lines."""
    import random

    rnd = random.Random(7)
    pages = {p: [(k, f"w{k}", float(rnd.randint(0, 30)), float(top := rnd.randint(0, 80)), 9.0, float(top + rnd.choice([2, 6, 7, 20, 31]))) for k in range(n)] for p, n in ((1, 40), (2, 1), (3, 25), (None, 3))}
    df = spark.createDataFrame([(p, *w) for p, ws in pages.items() for w in ws], "page int, seq int, text string, left double, top double, right double, bottom double").repartition(3)
    got = {(r.page, r.seq): r.line for r in documents.word_lines(df).collect()}
    for page, words in pages.items():
        heads = []
        for seq, _, _, top, _, bottom in sorted(words, key=lambda w: ((w[3] + w[5]) / 2, w[0])):
            fits = [k for k, (middle, height) in enumerate(heads, 1) if abs(middle - (top + bottom) / 2) <= 0.5 * min(height, bottom - top)]
            if not fits:
                heads.append(((top + bottom) / 2, bottom - top))
            assert got[page, seq] == (fits[0] if fits else len(heads))


LOOKS = [(1, "old", 5), (2, "old", 5), (2, "new", 3), (3, "new", 4), (4, "new", 4), (5, "new", 4), (3, "old", 5), (4, "old", 6), (5, "old", 6), (4, "empty", 0), (5, "empty", 0), (7, "new", 4), (8, "new", 4)]
WANT = {(4, "new", 4), (5, "old", 6), (8, "new", 4)}


def test_stable_batch(spark):
    looks = spark.createDataFrame([(t, p, s, 1.0) for t, p, s in LOOKS], "tick long, path string, size long, modified double")
    assert {(r.tick, r.path, r["size"]) for r in watch.stable_batch(looks).collect()} == WANT
    assert {(r.tick, r.path, r["size"]) for r in watch.stable_batch(looks, include_existing=True).collect()} == WANT | {(2, "old", 5)}


def test_stable_stream(spark, tmp_path):
    schema = "tick long, path string, size long, modified double"
    for tick in sorted({t for t, _, _ in LOOKS}):
        spark.createDataFrame([(t, p, s, 1.0) for t, p, s in LOOKS if t == tick] + [(tick, "x.part", 9, 1.0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/looks")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/looks")
    out = watch.stable_stream(stream).writeStream.format("memory").queryName("stable").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert {(r.tick, r.path, r["size"]) for r in spark.table("stable").collect()} == WANT | {(2, "old", 5)}


def test_recipes(spark):
    recipe = recipes.Recipe("r", [recipes.Step("clean", {"quotes": False}), recipes.Step("lower", only="doc_id = 1"), recipes.Step("sentences")])
    assert recipe.problem() is None and recipes.Recipe.from_json(recipe.to_json()) == recipe
    assert recipe.describe() == "clean (quotes=False), lower, sentences"
    got = recipes.run(spark.createDataFrame([(1, "One is. Two is."), (2, "Three is. Four is.")], "doc_id int, text string"), recipe)
    assert {(r.doc_id, r.place, r.sentence) for r in got.collect()} == {(1, 0, "one is. two is."), (2, 0, "Three is."), (2, 1, "Four is.")}
    assert recipes.Recipe("r", [recipes.Step("sentences"), recipes.Step("lower")]).problem() and recipes.Recipe("", []).problem() and recipes.Recipe("r", [recipes.Step("no")]).problem()
    assert recipes.Recipe.from_json('{"name": "r", "steps": [{"kind": "clean", "options": {"odd": 1}}]}').steps[0].options == {}


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_bytes("name;amount;zip\nAnna;1234,5;00184\nLuca;7;20100\n\n".encode())
    (tmp_path / "sub" / "b.txt").write_bytes("caffè".encode("cp1252"))
    (tmp_path / "c.bin").write_bytes(b"a\x00b")
    (tmp_path / ".hidden").write_text("x")
    listed = files.listing(spark, str(tmp_path))
    assert {r.rel for r in listed.collect()} >= {"a.csv", "sub/b.txt", "c.bin"} and not listed.where("name = '.hidden'").count()
    assert {r.name for r in files.listing(spark, str(tmp_path), extensions=[".TXT"]).collect()} == {"b.txt"}
    rows = files.raw_rows(spark, str(tmp_path / "a.csv")).orderBy("row_no").collect()
    assert [r.cells for r in rows] == [["name", "amount", "zip"], ["Anna", "1234,5", "00184"], ["Luca", "7", "20100"]] and rows[0].delimiter == ";"
    assert files.texts(spark, str(tmp_path / "sub")).first().text == "caffè"
    assert files.texts(spark, str(tmp_path / "c.bin")).first().error
    assert files.table(spark, str(tmp_path / "a.csv")).columns == ["name", "amount", "zip"]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.txt", "12345")
        z.writestr("../y", "1")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        t.add(tmp_path / "a.zip", "z")
    (tmp_path / "c.zip").write_bytes(b"no")
    entries = files.archive_entries(spark, str(tmp_path))
    assert {(r.archive, r.name) for r in entries.where("error is null").collect()} == {("a.zip", "d/x.txt"), ("a.zip", "../y"), ("b.tar.gz", "z")}
    assert entries.where("error is not null").select("archive").first()[0] == "c.zip"
    assert {(r.archive, r.files) for r in files.described(entries.where("error is null")).collect()} == {("a.zip", 2), ("b.tar.gz", 1)}


def test_silence_log(spark):
    log = [("k", 1, "[x] silence_start: -0.01"), ("k", 2, "[x] silence_end: 1.5 | silence_duration: 1.5"), ("k", 3, "noise"), ("k", 4, "silence_start: 7")]
    got = files.silences(spark.createDataFrame(log, "key string, seq int, line string"), spark.createDataFrame([("k", 9.0)], "key string, duration double"))
    assert [(r.start, r.end) for r in got.orderBy("seq").collect()] == [(0.0, 1.5), (7.0, 9.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 1.5, True, None)], "a string, b double, c boolean, d string")
    assert tuple(sinks.as_cells(df, comma_decimal=True, guard=True).first()) == ("'=1+1", "1,5", "TRUE", "")
    sinks.write_csv(df, f"{tmp_path}/out", ";")
    assert {r.value for r in spark.read.text(f"{tmp_path}/out").collect()} == {"a;b;c;d", "=1+1;1,5;TRUE;"}


def test_page_tables(spark):
    pages = spark.createDataFrame([(1, 1, True), (1, 2, True), (2, 1, False), (3, 1, True)], "queue int, page int, ok boolean")
    assert {(r.queue, r.page, r.place) for r in intervals.concatenated(pages).collect()} == {(1, 1, 1), (1, 2, 2), (3, 1, 3)}


def test_translate_keeps_the_shape(spark):
    from weir.operators import translate

    def up():
        return [lambda said: [s.upper() for s in said]]

    texts = {
        "# a b\n\n- one\n- two\n\nSaid. And\nmore": "# A B\n\n- ONE\n- TWO\n\nSAID. AND MORE", "": "", "\n": "\n", " \na": "A", "a\n": "A", "- a\n": "- A\n", "\n\na\r\n \n\n b\n\n": "\n\nA\n \n\nB\n\n",
        "- a\nb": "- A B", "> a\n> \n1) c d": "> A\n> \n1) C D", "x  y": "X Y", None: None,
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.text for r in translate.translated_text(rows, up).collect()}
    assert got == dict(enumerate(texts.values()))
    srt = "1\n00:00:01,000 --> 00:00:02,000\n<i>hi</i>\nyou\n\n2\n00:00:03,000 --> 00:00:04,000\nbye"
    said = translate.translated_subtitles(spark.createDataFrame([(1, srt), (2, None)], "id int, text string"), up).orderBy("id").collect()
    assert said[0].text == "1\n00:00:01,000 --> 00:00:02,000\nHI YOU\n\n2\n00:00:03,000 --> 00:00:04,000\nBYE" and said[1].text is None


def test_all_conversations_are_translated(spark, tmp_path):
    import re

    import __spark_entry__ as entry

    def brute(text):
        out = []
        for piece in re.split(r"(\n\s*\n)", text.replace("\r\n", "\n")):
            lines = piece.split("\n")
            heads = [re.match(r"\s*(#{1,6}\s+|[-*+]\s+|\d+[.)]\s+|>\s*)|", line)[0] for line in lines]
            if not piece.strip():
                out.append(piece)
            elif len(lines) > 1 and all(h.strip() for h, line in zip(heads, lines, strict=True) if line[len(h) :].strip()):
                out.append("\n".join(h + " ".join(line[len(h) :].split()).lower() for h, line in zip(heads, lines, strict=True)))
            else:
                lead = heads[0] if heads[0].strip() else ""
                out.append(lead + " ".join(piece[len(lead) :].split()).lower())
        return "".join(out)

    texts = ["# A B\n\n- One\n- Two\n\n\nSaid.  And\nMore ", "1) X\r\n2) Y", "> Q\n \n\u00c9T\u00c9", " A", "", "Plain", "\n\nZ"]
    spark.createDataFrame([(1, k, "user", x) for k, x in enumerate([*texts, None])], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.text for r in entry.queries()["translated"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate([*map(brute, texts), None]))
    assert got[0] == "# a b\n\n- one\n- two\n\n\nsaid. and more"
    tables = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{tables}/conversations.parquet").collect()
    assert sorted(map(tuple, entry.queries()["translated"](spark, tables).collect())) == sorted((r.conv_id, r.turn, brute(r.text)) for r in rows)



def test_codes(spark):
    from weir.operators import codes

    got = codes.codes(codes.of_lines(spark.createDataFrame([("same\nsame\n\n123456789012",)], "text string")), "ean13").orderBy("seq").collect()
    assert [(r.name, r.problem) for r in got] == [("same", "Needs 12 or 13 digits."), ("same (2)", "Needs 12 or 13 digits."), ("123456789012", "")]
    rows = spark.createDataFrame([(0, ["code", "name"]), (1, ["1", ""]), (2, [" "])], "row_no int, cells array<string>")
    assert [(r.content, r.name) for r in codes.of_rows(rows, 0, 1).orderBy("seq").collect()] == [("code", "name"), ("1", "1")]


def test_media(spark):
    from weir.functions import media

    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(media.creation_time(F.lit("creation_time : 2026-07-12T10:00:00.000000Z"), "Europe/Rome")).hour == 12
    assert one(media.creation_time(F.lit("creation_time : 2026-07-12T10:00:00+0500"))).hour == 10
    assert one(media.creation_time(F.lit("creation_time : 1904-01-01T00:00:00Z"))) is None
    assert one(media.pdf_date(F.lit("D:2026"))) == "2026" and one(media.pdf_date(F.lit("x"))) == "x"
    assert one(media.without_app_tags(F.lit("<a/><Company>x</Company><Manager/>"))) == "<a/>"
    assert tuple(one(media.layout(F.lit("/d"), F.lit("T: x"), F.lit("sorted")))) == ("/d/T x", "/d/T x/Video", "/d/T x/Audio", "/d/T x/Text")
    assert one(media.fitting(F.lit("d" * 300), F.lit("n" * 60))) == "n" * 24


def test_one_level(spark, tmp_path):
    for name in ("a.txt", "in/b.txt", "in/deep/c.txt", ".hidden/d.txt", "other/e.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    found = files.listing(spark, str(tmp_path))
    assert [r.name for r in files.files_in(found).collect()] == ["a.txt"]
    assert [r.name for r in plans.natural_order(files.folders_in(found), descending=True, by="name").collect()] == ["other", "in"]


def test_packs(spark, tmp_path):
    for name, said, model in (("one", '{"from_code": "en", "to_code": "de"}', True), ("two", '{"from_code": "en", "to_code": "de"}', True), ("bare", '{"from_code": "en", "to_code": "fr"}', False), ("bad", "{", True), ("half", '{"from_code": "en", "to_code": ""}', True)):
        (tmp_path / name / "model").mkdir(parents=True)
        (tmp_path / name / "metadata.json").write_text(said)
        if model:
            (tmp_path / name / "model" / "model.bin").write_text("x")
    assert [tuple(r) for r in files.packs(spark, str(tmp_path)).collect()] == [("en", "de", "two")]
    (tmp_path / "index.json").write_text('[{"from_code": "en", "to_code": "de"},\n {"from_code": "de", "to_code": "en"}]')
    assert {(r.from_code, r.to_code) for r in files.pack_index(spark, str(tmp_path / "index.json")).collect()} == {("en", "de"), ("de", "en")}


def test_colour_steps(spark):
    tries = spark.createDataFrame([(1, 0, 10), (1, 256, 5), (2, 0, 90), (2, 256, 80), (2, 192, 20), (2, 4, 1), (3, 0, 90), (3, 4, 80), (3, 5, 1)], "key long, colours int, size long")
    got = {tuple(r) for r in jobs.fewest_lost_colours(tries, 20).collect()}
    assert got == {(1, None, 10, 1, True), (2, 192, 20, 3, True), (3, 4, 80, 12, False)}


def test_snapshots(spark):
    shape = "id long, destination string, stage string, progress double, message string, error string, output string, source_bytes long, output_bytes long, info map<string,string>"
    now = spark.createDataFrame([(1, "/d", "done", 100.0, "m", "", "/o", 5, 4, {"rows": "3"}), (2, "/d", "failed", 7.0, "", "bad", "", 6, 0, {}), (3, "/d", "queued", 0.0, "", "", "", 7, 0, None)], shape)
    taken = spark.createDataFrame([(1, '{"stage": "working", "destination": ""}'), (3, "no json")], "id long, snapshot string")
    got = {r.id: tuple(r)[1:] for r in jobs.applied(now, taken).collect()}
    assert got[1] == ("/d", "working", 0.0, "", "", "", 5, 0, {}) and got[2][1] == "failed"
    again = {r.id: r for r in jobs.applied(jobs.reset(now, F.lit(True)), jobs.snapshots(now)).collect()}
    assert tuple(again[1]) == tuple(now.where("id = 1").first()) and again[2].error == "bad"
    assert {r.stage for r in jobs.reset(now, F.col("stage") == "failed").where("id = 2").collect()} == {"queued"}
    assert jobs.queue_weight(now.limit(0)).first().bytes == 0


def test_sure_words(spark):
    words = spark.createDataFrame([(" a\n", [(1, 2), (3, 0)], 0.5), ("b", [(0, 0)], 0.49), (" ", [(0, 0)], 0.9), ("c", [(5, 5)], None)], "text string, points array<struct<x:int,y:int>>, score double")
    assert [tuple(r) for r in documents.sure_words(words).orderBy("text").collect()] == [("a", 1.0, 0.0, 3.0, 2.0), ("c", 5.0, 5.0, 5.0, 5.0)]


def test_recipes_keep_errors_to_their_rows(spark):
    def halved(text: str, least: int = 2) -> str:
        if len(text) < least:
            raise recipes.StepError("too short")
        return text[: len(text) // int(text[0])] if text[0].isdigit() else None

    recipes.text_kind("halved", halved, least=2)
    try:
        rows = [(1, "2abcde"), (2, "0abc"), (3, "x"), (4, "word"), (5, None), (6, "2AbC")]
        df = spark.createDataFrame([(*r, "old") for r in rows], "k int, text string, stage string").repartition(3)
        recipe = recipes.Recipe("r", [recipes.Step("halved", {"least": 3}, only="k < 6"), recipes.Step("lower", only="k <> 5")])
        got = {r.k: (r.text, r.stage, r.failed_step, r.error) for r in recipes.run_isolated(df, recipe).collect()}
        # a null is a value: 'word' became one, and nothing failed
        assert {k: v[:3] for k, v in got.items()} == {1: ("2ab", "done", None), 2: ("0abc", "failed", 1), 3: ("x", "failed", 1), 4: (None, "done", None), 5: (None, "done", None), 6: ("2abc", "done", None)}
        assert got[2][3].startswith("Unexpected problem: ") and got[3][3] == "too short"
        with pytest.raises(Exception, match="too short"):
            recipes.run(df.where("k = 3"), recipe).collect()
        many = recipes.Recipe("r", [recipes.Step("seconds"), recipes.Step("sentences")])
        out = recipes.run_isolated(spark.createDataFrame([(1, "1:30"), (2, "soon"), (3, "")], "k int, text string"), many).collect()
        assert {(r.k, r.sentence, r.stage, r.failed_step) for r in out} == {(1, "90.0", "done", None), (2, None, "failed", 1), (3, None, "failed", 1)}
        assert {(r.k, r.stage) for r in recipes.run_isolated(df, recipes.Recipe("r", [recipes.Step("lower", only="k < 0")])).collect()} == {(k, "skipped") for k in range(1, 7)}
    finally:
        recipes.KINDS.pop("halved")


def test_markdown_tasks_grow_with_the_text(spark, monkeypatch):
    """Texts are dealt over as many parts as their length asks for, and blocks stay the same."""
    docs = spark.createDataFrame([(k, f"# {k}\n\na\nb\n- c") for k in range(50)], "doc_id long, text string")
    want = sorted(map(tuple, documents.markdown_blocks(docs).select("doc_id", "place", "kind", "text").collect()))
    monkeypatch.setattr(documents, "TASK_CHARS", 40)
    got = documents.markdown_blocks(docs)
    assert got.rdd.getNumPartitions() > 10 and sorted(map(tuple, got.select("doc_id", "place", "kind", "text").collect())) == want
