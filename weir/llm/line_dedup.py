"""Line dedup (operator 9): suffix classes over line-id sequences by prefix doubling. DataFrame functions only.

A document is the sequence of its lines that aren't blank; a line's id is a 128-bit
hash. Positions whose first 2**k lines are equal form a class of level k. Level k+1
follows from level k by one grouping: a class is the pair of the classes at a
position and 2**k lines on. Ordered by class, the positions are a suffix array, and
the classes of a level are its intervals with a common prefix of 2**k lines at least.
Only positions in classes of two or more go on, so the table shrinks from round to
round, and rounds end when no class has two members: after as many as the longest
repeated run has binary digits. Each class keeps its first position in the corpus;
at the others the common prefix is a later copy. The copies that overlap or touch
in a document make its maximal repeated runs, and those are deleted.

Scale: the rounds move ids and places, never text. Classes are counted with partial
aggregation, so a line that stands in a third of all documents is one row a task; the
positions of such a class meet its first one in many tasks (``shared.spread_join``).
The text is moved once, at the end, to meet its document's runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

BLANK = r"^[\s\p{Z}]*$"


def _ids(*parts: Column | str) -> list[Column]:
    """128 bits of a hash, as two longs."""
    return [F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("line"), *parts).alias("b")]


def _classes(rows: DataFrame) -> DataFrame:
    """Rows in classes of two or more, with ``later``: whether the class has a member before."""
    # (doc_id, at) of the first member
    groups = rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at")).alias("first")).where("n > 1")
    met = shared.spread_join(rows, groups, ["a", "b"], rows.count(), ["doc_id", "at"])
    return met.withColumn("later", F.struct("doc_id", "at") != F.col("first")).drop("first")


def copied_lines(docs: DataFrame, min_lines: int, long_line: int) -> tuple[DataFrame, DataFrame]:
    """(``doc_id``, ``at`` of each line in a later copy; ``doc_id``, ``longest``: the largest 2**k for which a class of level k has a later copy there)."""
    plain = docs.where("doc_id is not null and text is not null")
    full = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(BLANK))
    line = plain.select("doc_id", F.posexplode(full).alias("at", "line"))
    rows = line.select("doc_id", "at", *_ids("line"), (F.length("line") >= long_line).alias("long"))
    rows = shared.Kept(rows, "lines")
    levels = [shared.Kept(_classes(rows.df), "lines")]
    rows.drop()
    level = levels[0].df
    later = level.where("later")
    found = [(later if min_lines == 1 else later.where("long")).select("doc_id", "at", F.lit(1).alias("n"))]
    span = 1
    while not level.isEmpty():
        ahead = Window.partitionBy("doc_id").orderBy("at").rangeBetween(span, span)
        pair = level.select("doc_id", "at", "a", "b", F.max("a").over(ahead).alias("a2"), F.max("b").over(ahead).alias("b2"))
        pair = shared.Kept(pair.where("a2 is not null").select("doc_id", "at", *_ids("a", "b", "a2", "b2")), "lines")
        levels.append(shared.Kept(_classes(pair.df), "lines"))
        pair.drop()
        level = levels[-1].df
        span *= 2
        if span >= min_lines:
            found.append(level.where("later").select("doc_id", "at", F.lit(span).alias("n")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # a copy at a longer level covers what the shorter ones at its place do
    every = shared.keep(every.groupBy("doc_id", "at").agg(F.max("n").alias("n")), "copies")
    for done in levels:
        done.drop()
    covered = every.select("doc_id", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("at")).distinct()
    return covered, every.groupBy("doc_id").agg(F.max("n").alias("longest"))


def _runs(covered: DataFrame) -> DataFrame:
    """``doc_id``, ``runs``: sorted (first, last) of each maximal run of covered lines; ``n_removed``."""
    island = covered.withColumn("k", F.col("at") - F.row_number().over(Window.partitionBy("doc_id").orderBy("at")))
    run = island.groupBy("doc_id", "k").agg(F.min("at").alias("s"), F.max("at").alias("e"))
    return run.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("runs"), F.sum(F.col("e") - F.col("s") + 1).alias("n_removed"))


def kept_text(text: Column, runs: Column) -> Column:
    """The text without its runs: whole lines with one line feed go; blank lines inside a run go with it."""
    lines = F.split(text, "\n")
    full = F.filter(F.transform(lines, lambda x, i: F.when(~x.rlike(BLANK), i)), lambda i: i.isNotNull())
    real = F.transform(runs, lambda r: F.struct(F.get(full, r["s"]).alias("s"), F.get(full, r["e"]).alias("e")))
    # the gaps: from behind a run up to the next one
    starts = F.concat(F.array(F.lit(0)), F.transform(real, lambda r: r["e"] + 1))
    ends = F.concat(F.transform(real, lambda r: r["s"]), F.array(F.size(lines)))
    gaps = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    parts = F.transform(gaps, lambda g: F.slice(lines, g["a"] + 1, g["b"] - g["a"]))
    return F.when(runs.isNull(), text).otherwise(F.array_join(F.flatten(parts), "\n"))


def without_copied_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, long_line: int = 200) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from the text; ``n_chars`` (if there) counted anew.

    A run repeats if at least ``min_lines`` (a power of two) lines in a row that
    aren't blank, or one line of at least ``long_line`` characters, stand in the same
    order elsewhere, in this or another document. The first copy, by document id
    and line, stays. Three columns are added: ``n_lines`` (that aren't blank),
    ``n_removed`` and ``longest_copy`` (the largest power of two for which as many
    lines in a row are a copy; 0 for none).

    Blank lines neither make nor break a run. Null text stays null, with 0 lines;
    empty text stays empty. A null id: the row stays as it is and matches nothing.
    Rows that share an id are texts of their own, in the order of their texts' hashes.
    """
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    columns, row = docs.columns, id_col
    if shared.repeated(docs, id_col):
        docs, row = shared.numbered(docs, id_col, text_col), "_weir_row"
    plain = shared.texts(docs, row, text_col)
    covered, longest = copied_lines(plain, min_lines, long_line)
    found = _runs(covered).join(longest, "doc_id")
    found = found.select(F.col("doc_id").alias("_weir_id"), F.col("runs").alias("_weir_runs"), F.col("n_removed").alias("_weir_removed"), F.col("longest").alias("_weir_longest"))
    out = docs.join(found.hint("merge"), docs[row].cast("long") == found["_weir_id"], "left")
    text = kept_text(out[text_col].cast("string"), out["_weir_runs"])
    lines = F.size(F.filter(F.split(out[text_col].cast("string"), "\n"), lambda x: ~x.rlike(BLANK)))
    added = {text_col: text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in columns else {})
    columns = [added[c].alias(c) if c in added else docs[c] for c in columns]
    return out.select(
        *columns,
        F.when(out[text_col].isNull(), 0).otherwise(lines).cast("long").alias("n_lines"),
        F.coalesce("_weir_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("_weir_longest", F.lit(0)).cast("long").alias("longest_copy"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_copied_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS place FROM l WHERE NOT regexp_full_match(line, '[\s\p{Z}]*')),
w AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY place) AS line2 FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, place) AS one, row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, place) AS two FROM w),
c AS (SELECT *, (length(line) >= 200 AND one > 1) AS c1, (line2 IS NOT NULL AND two > 1) AS c2 FROM r),
d AS (SELECT *, c1 OR c2 OR coalesce(lag(c2) OVER (PARTITION BY doc_id ORDER BY place), false) AS gone FROM c),
g AS (SELECT a.doc_id, a.line, a.line_no, d.gone,
        -- a blank line goes if the lines around it go
        CASE WHEN d.gone IS NULL THEN coalesce(last_value(d.gone IGNORE NULLS) OVER (PARTITION BY a.doc_id ORDER BY a.line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false)
               AND coalesce(first_value(d.gone IGNORE NULLS) OVER (PARTITION BY a.doc_id ORDER BY a.line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), false) ELSE d.gone END AS out
      FROM l a LEFT JOIN d ON a.doc_id = d.doc_id AND a.line_no = d.line_no),
k AS (SELECT doc_id, CAST(count(gone) AS BIGINT) AS n_lines, CAST(coalesce(sum(CASE WHEN gone THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_removed,
        coalesce(string_agg(CASE WHEN NOT out THEN line END, chr(10) ORDER BY line_no), '') AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id"""
