"""Gaps and islands: silences, paragraphs, page ranges, chunks, runs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .paragraphs import SAID, by_ranges
from .running import prefix_sum


def speech_segments(silences: DataFrame, durations: DataFrame, *, keep: float = 0.2, key: str = "key") -> DataFrame:
    """``key``, ``start``, ``end`` of what isn't silent, each silence shortened by ``keep`` at either end.

    ``silences``: key, seq, start, end; ``durations``: key, duration. A running
    maximum of the ends so far gives where each part begins; a window by key.
    """
    both = silences.join(durations, key)
    a = F.when(F.col("start") > 0.01, F.col("start") + keep).otherwise(F.lit(0.0))
    b = F.when(F.col("end") < F.col("duration") - 0.01, F.col("end") - keep).otherwise(F.col("duration"))
    cuts = both.select(key, "seq", a.alias("a"), b.alias("b")).where(F.col("b") - F.col("a") > 0.05)
    tail = durations.select(key, F.lit(None).cast("long").alias("seq"), F.col("duration").alias("a"), F.col("duration").alias("b"))
    w = Window.partitionBy(key).orderBy(F.col("seq").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    parts = cuts.unionByName(tail).withColumn("start", F.greatest(F.lit(0.0), F.coalesce(F.max("b").over(w), F.lit(0.0))))
    return parts.where(F.col("a") > F.col("start") + 0.02).select(key, "start", F.col("a").alias("end"))


def transcript_paragraphs(segments: DataFrame, *, key: str = "key", longest: int = 280, pause: float = 1.5, most: int = 100_000) -> DataFrame:
    """``key``, ``n``, ``text``: segments (key, seq, start, end, text) joined up to a pause, or to a sentence end beyond ``longest`` characters.

    The length so far starts anew with each paragraph. Keys of at most ``most`` segments
    are folded, each in one row; if there is a larger one, paragraphs are found by
    ``by_ranges``, to the same result. A null text is empty.
    """
    segments = segments.select(key, "seq", "start", "end", F.coalesce("text", F.lit("")).alias("text"))
    if not segments.groupBy(key).count().where(F.col("count") > most).isEmpty():
        return by_ranges(segments, key, longest, pause)
    w = Window.partitionBy(key).orderBy("seq")
    ahead = F.coalesce(F.lead("start").over(w) - F.col("end") > pause, F.lit(False))
    rows = segments.withColumn("gap", ahead).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "text", "gap"))).alias("s"))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))

    def step(a: Column, x: Column) -> Column:
        now = F.when(a["now"].isNull(), x["text"]).otherwise(F.concat(a["now"], F.lit(" "), x["text"]))
        over = (x["text"].rlike(SAID) & (F.length(now) > longest)) | x["gap"]
        return F.struct(F.when(over, F.concat(a["done"], F.array(now))).otherwise(a["done"]).alias("done"), F.when(~over, now).alias("now"))

    folded = rows.select(key, F.aggregate("s", empty, step).alias("a"))
    every = F.when(F.col("a.now").isNotNull(), F.concat(F.col("a.done"), F.array(F.col("a.now")))).otherwise(F.col("a.done"))
    return folded.select(key, F.posexplode(every).alias("n", "text"))


def srt(segments: DataFrame, *, key: str = "key") -> DataFrame:
    """``key``, ``n``, ``block``: numbered SRT blocks."""
    from ..functions.values import srt_time

    n = F.row_number().over(Window.partitionBy(key).orderBy("seq"))
    return segments.select(key, n.alias("n"), "start", "end", "text").select(key, "n", F.concat(F.col("n").cast("string"), F.lit("\n"), srt_time("start"), F.lit(" --> "), srt_time("end"), F.lit("\n"), F.col("text"), F.lit("\n")).alias("block"))


PART = re.compile(r"^\s*(\d+|end|last)\s*(?:-\s*(\d+|end|last)\s*)?$", re.IGNORECASE)


def pages(spec: Column, count: Column) -> Column:
    """Array of arrays of page indexes from 0 of '1-3,7;5-end'; null if a part isn't a page or range, lies beyond, or none is written."""
    parts = F.filter(F.split(F.replace(spec, F.lit(";"), F.lit(",")), ","), lambda p: F.trim(p) != "")
    form = r"(?i)^\s*(\d+|end|last)\s*(-\s*(\d+|end|last)\s*)?$"
    number = lambda x: F.when(F.lower(x).isin("end", "last"), count).otherwise(x.try_cast("int"))
    low = lambda p: number(F.regexp_extract(p, form, 1))
    high = lambda p: F.coalesce(number(F.nullif(F.regexp_extract(p, form, 3), F.lit(""))), low(p))
    bad = F.exists(parts, lambda p: ~p.rlike(form) | F.coalesce((low(p) < 1) | (low(p) > count) | (high(p) < 1) | (high(p) > count), F.lit(True)))
    groups = F.transform(parts, lambda p: F.sequence(low(p) - 1, high(p) - 1))
    return F.when((F.size(parts) > 0) & ~bad, groups)


def page_spec_problem(spec: Column) -> Column:
    """What is wrong with '1-3,7;5-end' before the number of pages is known; '' if nothing is."""
    parts = F.filter(F.transform(F.split(F.replace(spec, F.lit(";"), F.lit(",")), ","), lambda p: F.trim(p)), lambda p: p != "")
    odd = F.get(F.filter(parts, lambda p: ~p.rlike(r"(?i)^(\d+|end|last)(\s*-\s*(\d+|end|last))?$")), F.lit(0))
    zero = F.exists(parts, lambda p: p.rlike(r"(^|-\s*)0+(\s*-|$)"))
    said = F.concat(F.lit("'"), odd, F.lit("' is not a page or a range. Write for example  1-3,7  or  5-end"))
    return F.when(odd.isNotNull(), said).when(zero, "Pages are counted from 1.").otherwise("")


def left_after(listing: DataFrame, gone: DataFrame) -> DataFrame:
    """``doc``, ``pages`` left of each document, with ``problem`` where all of them would go."""
    left = listing.join(gone.select("doc", "page").distinct().withColumn("_gone", F.lit(1)), ["doc", "page"], "left")
    kept = F.count_if(F.col("_gone").isNull())
    return left.groupBy("doc").agg(kept.alias("pages"), F.when(kept == 0, "That would delete every page: nothing would be left.").otherwise("").alias("problem"))


def ranges_text(indexes: Column) -> Column:
    """[0, 1, 2, 6] as '1-3,7': runs of +1 in the given order."""
    pair = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))
    runs = F.aggregate(
        indexes, F.array(pair).cast("array<struct<a:int,b:int>>"),
        lambda out, x: F.when((F.size(out) > 1) & (F.element_at(out, -1)["b"] + 1 == x), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["a"].alias("a"), x.cast("int").alias("b"))))).otherwise(F.concat(out, F.array(F.struct(x.cast("int").alias("a"), x.cast("int").alias("b"))))),
    )
    said = F.transform(F.slice(runs, 2, F.size(runs)), lambda r: F.when(r["a"] == r["b"], (r["a"] + 1).cast("string")).otherwise(F.concat((r["a"] + 1).cast("string"), F.lit("-"), (r["b"] + 1).cast("string"))))
    return F.array_join(said, ",")


def runs(rows: DataFrame, *, key: str, value: str) -> DataFrame:
    """``key``, ``first``, ``last`` of runs of +1 among the distinct values of a key."""
    island = F.col(value) - F.row_number().over(Window.partitionBy(key).orderBy(value))
    return rows.select(key, value).distinct().withColumn("_k", island).groupBy(key, "_k").agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("_k")


def chunks(rows: DataFrame, size: int, *, key: str, order: str) -> DataFrame:
    """With ``chunk`` (from 1) of ``size`` rows each, within a key."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return rows.withColumn("chunk", (F.floor(at / size) + 1).cast("long"))


def without_pages(listing: DataFrame, gone: DataFrame) -> DataFrame:
    """Pages (doc, page) in order, but those in ``gone``."""
    return listing.join(gone, ["doc", "page"], "left_anti")


def concatenated(listing: DataFrame) -> DataFrame:
    """Pages (queue, page, ok) of all inputs in the order of the queue, failed inputs left out, with ``place`` from 1.

    One sequence over all inputs, counted by ranges: no task sees more than its range of pages.
    """
    good = listing.where("ok").select("queue", "page", F.lit(1).alias("one"))
    return prefix_sum(good, [], ["queue", "page"], "one", "place").select("queue", "page", (F.col("place") + 1).alias("place"))


def segment(seconds: Column, length: float) -> Column:
    """Which fixed-length part, from 0, a time lies in."""
    return F.floor(seconds / length)


def rotated(rotation: Column, angle: int) -> Column:
    return F.pmod(rotation + angle, F.lit(360))
