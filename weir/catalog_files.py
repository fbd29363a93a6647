"""Registered queries of operators that read or write files: tables are written to this driver's shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import query
from .functions import pictures as X
from .operators import storage
from .sources import delimited as S


def _as_csv(df: DataFrame, mark: str) -> str:
    """The path of delimited files with line feeds, quotes and outer spaces as they are."""
    path = storage.folder(df.sparkSession, "csv")
    df.write.csv(path, sep=mark, header=True, quote='"', escape='"', quoteAll=True, emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


@query("csv_records", "SELECT doc_id, lang, source, text FROM documents WHERE doc_id IS NOT NULL")
def _(t):
    """Whole texts, line feeds and all, through delimited files read by ranges; a column says which cells are null and not empty."""
    texts = ("lang", "source", "text")
    nulls = F.concat_ws(",", *(F.when(F.col(c).isNull(), F.lit(c)) for c in texts))
    docs = t("documents").select("doc_id", nulls.alias("nulls"), *texts).where("doc_id is not null")
    back = S.table(docs.sparkSession, _as_csv(docs, ";"), ";")
    null = lambda c: F.array_contains(F.split(F.coalesce("nulls", F.lit("")), ","), c)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.when(~null(c), F.coalesce(c, F.lit(""))).alias(c) for c in texts))


@query("csv_row_numbers", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(length(text)) AS BIGINT) AS characters, true AS numbers_are_gapless FROM conversations")
def _(t):
    """Turns of conversations as cells of one-column rows: every file's rows are numbered from its header on."""
    turns = t("conversations").select("text", F.lit("x").alias("x"))
    rows = S.split_rows(turns.sparkSession, _as_csv(turns, "|"), "|")
    files = rows.groupBy("source").agg(F.count("*").alias("n"), F.max("row_no").alias("last"), F.count_distinct("row_no").alias("numbers"), F.sum(F.when(F.col("row_no") > 0, F.length(F.col("cells")[0]))).alias("characters"))
    return files.agg(F.sum(F.col("n") - 1).alias("rows"), F.sum("characters").alias("characters"), F.bool_and((F.col("numbers") == F.col("n")) & (F.col("last") == F.col("n") - 1)).alias("numbers_are_gapless"))


def _bytes_of(n: Column, size: int, little: Column) -> Column:
    """A number as hexadecimal digits in either order of bytes."""
    big = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.when(little, F.concat(*(F.substring(big, 2 * k + 1, 2) for k in reversed(range(size))))).otherwise(big)


def _photos(rows: DataFrame) -> DataFrame:
    """JPEG headers of rows (id, width, height, orientation, taken, saved): segments before the directories of tags, which are in either order of bytes."""
    little = F.col("id") % 2 == 0
    entry = lambda tag, kind, n, value: F.concat(_bytes_of(F.lit(tag), 2, little), _bytes_of(F.lit(kind), 2, little), _bytes_of(F.lit(n), 4, little), value)
    long = lambda n: _bytes_of(F.lit(n), 4, little)
    short = F.concat(_bytes_of(F.col("orientation"), 2, little), F.lit("0000"))
    text = lambda c: F.concat(F.hex(F.col(c)), F.lit("00"))
    # the main directory at 8 has three entries and ends at 50; one text of 20 bytes, then the other directory with one entry, then its text
    main = F.concat(_bytes_of(F.lit(3), 2, little), entry(0x0112, 3, 1, short), entry(0x0132, 2, 20, long(50)), entry(0x8769, 4, 1, long(70)), long(0), text("saved"))
    more = F.concat(_bytes_of(F.lit(1), 2, little), F.when(F.col("id") % 3 == 0, entry(0x9003, 2, 20, long(88))).otherwise(entry(0x9286, 2, 20, long(88))), long(0), text("taken"))
    tags = F.concat(F.lit("457869660000"), F.when(little, "49492A0008000000").otherwise("4D4D002A00000008"), main, more)
    big = F.lit(False)
    segment = lambda mark, body: F.concat(F.lit(mark), _bytes_of(F.length(body) / 2 + 2, 2, big), body)
    size = F.concat(F.lit("08"), _bytes_of(F.col("height"), 2, big), _bytes_of(F.col("width"), 2, big), F.lit("03"))
    filler = F.expr("repeat('FFC0', cast(id % 40 as int))")
    picture = F.concat(F.lit("FFD8"), segment("FFE0", F.lit("4A46494600")), segment("FFE2", filler), segment("FFE1", tags), segment("FFFFFFC0", size), F.lit("FFDA0002"))
    return rows.select("id", F.unhex(picture).alias("content"))


@query("picture_facts", """WITH o AS (SELECT o_orderkey AS id, o_custkey % 5000 + 1 AS w, o_orderkey % 3000 + 1 AS h, o_orderkey % 9 AS turn, CAST(o_orderdate AS TIMESTAMP) AS saved FROM orders)
SELECT id, 'jpeg' AS kind, CASE WHEN turn BETWEEN 5 AND 8 THEN h ELSE w END AS width, CASE WHEN turn BETWEEN 5 AND 8 THEN w ELSE h END AS height,
    strftime(CASE WHEN id % 3 = 0 THEN saved - INTERVAL 1 DAY ELSE saved END, '%Y-%m-%d %H:%M:%S') AS taken FROM o""")
def _(t):
    """Size as shown and date of photos whose headers are made of orders."""
    k = F.col("o_orderkey")
    said = lambda days: F.date_format(F.col("o_orderdate").cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"), "yyyy:MM:dd HH:mm:ss")
    rows = t("orders").select(k.alias("id"), (F.col("o_custkey") % 5000 + 1).alias("width"), (k % 3000 + 1).alias("height"), (k % 9).alias("orientation"), said(1).alias("taken"), said(0).alias("saved"))
    facts = _photos(rows).select("id", X.picture_facts("content").alias("f"))
    return facts.select("id", "f.kind", "f.width", "f.height", F.date_format("f.taken", "yyyy-MM-dd HH:mm:ss").alias("taken"))
