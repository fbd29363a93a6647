"""Texts and subtitles through a sentence model, with their shape kept.

A text is a relation of lines. Islands of lines that are said together become one
row with its sentences; the model sees the sentences of a whole Arrow batch at a time;
an ordered aggregation puts the lines together again. A model is any function from a
list of sentences to as many; it is made once a worker by ``load``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import SPACE, sentences, strip

Model = Callable[[list[str]], list[str]]
#: What may stand before a capital at the start of a sentence, a line's mark, a subtitle's time.
OPENERS = "\"'«(["
MARK = rf"^{SPACE}*(#{{1,6}}{SPACE}+|[-*+]{SPACE}+|\d+[.)]{SPACE}+|>{SPACE}*)?"
TIME = rf"^{SPACE}*\d{{1,2}}:\d\d(:\d\d)?[.,]\d{{3}}{SPACE}*-->{SPACE}*"


def said(of: Column, load: Callable[[], list[Model]]) -> Column:
    """Arrays of sentences through the models of a route, one after the other; each array as one text."""

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        models = load()
        for batch in batches:
            sizes = [len(x) for x in batch]
            flat = [s for x in batch for s in x]
            for model in models:
                flat = model(flat) if flat else flat
            at = iter(flat)
            yield pd.Series([" ".join(next(at) for _ in range(n)) for n in sizes], dtype=object)

    return run(of)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.replace(docs[text_col].cast("string"), F.lit("\r\n"), F.lit("\n"))
    parts = docs.select(docs[id_col].alias("id"), text.isNull().alias("none"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("at", "line"))
    return parts.withColumn("blank", strip("line") == "")


def _together(units: DataFrame, load: Callable[[], list[Model]], id_col: str) -> DataFrame:
    """From ``id``, ``none``, ``at``, ``lead``, ``body`` (null: only the lead) to a text an id."""
    line = F.concat("lead", F.when(F.col("body").isNull(), "").otherwise(said(F.coalesce(sentences("body", OPENERS), F.array().cast("array<string>")), load)))
    made = units.select("id", "none", F.struct("at", line.alias("line")).alias("x")).groupBy("id").agg(F.max("none").alias("none"), F.array_sort(F.collect_list("x")).alias("x"))
    return made.select(F.col("id").alias(id_col), F.when(~F.col("none"), F.array_join(F.transform("x", lambda x: x["line"]), "\n")).alias("text"))


def translated_text(docs: DataFrame, load: Callable[[], list[Model]], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``text``: block by block; blank lines between blocks and marks of lists, headings and quotes stay.

    A block of several lines that all have a mark is said line by line; of any other one the first line's mark
    stays and the rest is one text. A single blank line at the text's start or end belongs to the block beside
    it. Null stays null. An id names one text.
    """
    per = Window.partitionBy("id").orderBy("at")
    t = _lines(docs, id_col, text_col)
    before, after = F.lag("blank").over(per), F.lead("blank").over(per)
    lone = (before.isNull() & ~F.coalesce(after, F.lit(True))) | (after.isNull() & ~F.coalesce(before, F.lit(True)))
    t = t.withColumn("gap", F.col("blank") & ~lone)
    t = t.withColumn("block", F.sum((F.col("gap") | F.coalesce(F.lag("gap").over(per), F.lit(True))).cast("int")).over(per))
    whole = Window.partitionBy("id", "block")
    t = t.withColumn("mark", F.regexp_extract("line", MARK, 0)).withColumn("rest", F.substring("line", F.length("mark") + 1, F.length("line")))
    bare = (strip("mark") == "") & (strip("rest") != "")
    t = t.withColumn("listed", ~F.col("gap") & (F.count("*").over(whole) > 1) & ~F.max(bare).over(whole)).withColumn("first", F.min("at").over(whole) == F.col("at"))
    alone = t.where("gap or listed").select("id", "none", "at", F.when(F.col("gap") | (strip("rest") == ""), F.col("line")).otherwise(F.col("mark")).alias("lead"), F.when(~F.col("gap") & (strip("rest") != ""), F.col("rest")).alias("body"))
    kept = F.col("first") & (strip("mark") != "")
    joined = t.where("not gap and not listed").groupBy("id", "block").agg(
        F.max("none").alias("none"), F.min("at").alias("at"), F.max(F.when(kept, F.col("mark"))).alias("mark"),
        F.array_sort(F.collect_list(F.struct("at", F.when(kept, F.col("rest")).otherwise(F.col("line")).alias("line")))).alias("x"),
    )
    joined = joined.select("id", "none", "at", F.coalesce("mark", F.lit("")).alias("lead"), F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("body"))
    return _together(alone.unionByName(joined), load, id_col)


def translated_subtitles(docs: DataFrame, load: Callable[[], list[Model]], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``text``: only what is spoken; numbers, times, headers and notes stay. A cue becomes one line.

    A time or a blank line begins an island; in one that begins with a time the other lines are the cue.
    """
    per = Window.partitionBy("id").orderBy("at")
    t = _lines(docs, id_col, text_col).withColumn("timed", F.col("line").rlike(TIME))
    t = t.withColumn("island", F.sum((F.col("timed") | F.col("blank")).cast("int")).over(per))
    t = t.withColumn("spoken", F.max("timed").over(Window.partitionBy("id", "island")) & ~F.col("timed"))
    alone = t.where("not spoken").select("id", "none", "at", F.col("line").alias("lead"), F.lit(None).cast("string").alias("body"))
    cue = t.where("spoken").groupBy("id", "island").agg(F.max("none").alias("none"), F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", F.regexp_replace("line", "<[^>]+>", "").alias("line")))).alias("x"))
    cue = cue.select("id", "none", "at", F.lit("").alias("lead"), F.array_join(F.transform("x", lambda x: x["line"]), " ").alias("body"))
    return _together(alone.unionByName(cue), load, id_col)
