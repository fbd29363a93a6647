"""Word frequencies and extractive summaries, relationally."""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, sentences, words


def word_frequencies(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``word``, ``n``, ``top`` (the most of any word of the document), without stop words."""
    rows = docs.select(key, F.explode(words(text)).alias("word")).where(~F.col("word").isin(STOP_WORDS))
    return rows.groupBy(key, "word").agg(F.count("*").alias("n")).withColumn("top", F.max("n").over(Window.partitionBy(key)))


@functools.lru_cache(1 << 16)
def _weight(n: int, top: int) -> int:
    """A relative frequency in units of 1e-12, a half rounded up."""
    return int((Decimal(repr(n / top)) * 10**12).quantize(Decimal(1), ROUND_HALF_UP))


def _told(size: int) -> Callable[..., Column]:
    """Array of the places of the sentences that tell most, from the words of each (behind each a line feed) and those of the rest of the text."""

    def places(said: str, rest: str) -> list[int]:
        own = [s.split() for s in said.split("\n")[:-1]]
        n = len(own)
        k = size if size > 0 else max(1, math.ceil(n * -size / 100.0))
        if k >= n:
            return list(range(n))
        counts = Counter(said.split())
        counts.update(rest.split())
        top = max((c for w, c in counts.items() if w not in _STOP), default=1)
        weights = {w: 0 if w in _STOP else _weight(c, top) for w, c in counts.items()}
        scores = []
        for place, all_ in enumerate(own):
            useful = sum(map(weights.__getitem__, all_)) / 10**12
            value = useful / math.sqrt(len(all_)) * (1.25 if place == 0 else 1.0) if all_ else 0.0
            scores.append((-Decimal(repr(value)).quantize(Decimal("1e-9"), ROUND_HALF_UP), place))
        return sorted(place for _, place in sorted(scores)[:k])

    @F.arrow_udf("array<int>")
    def told(said: pa.Array, rest: pa.Array) -> pa.Array:
        # one document at a time is a string here, and only its own words
        return pa.array((places(s.as_py(), r.as_py()) if s.is_valid else None for s, r in zip(said, rest, strict=True)), pa.list_(pa.int32()))

    return told


_STOP = frozenset(STOP_WORDS)


def summary(docs: DataFrame, size: int = 5, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``place`` (from 0), ``sentence`` of the most telling sentences, in their order.

    ``size``: how many, or below 0 how many percent (one at least). A sentence (of
    more than 20 characters) scores the sum of its words' relative frequencies by the
    root of how many words it has, the opening one by a quarter more; ties to the
    earlier one. Sums are taken over whole numbers, so they don't depend on the order.
    Each row is a document and is worked on by itself: sentences and words are told by
    expressions, only the words are counted in Arrow batches, each document as one string,
    and nothing is shuffled. A text's words are those of its sentences, so they are told once.
    """
    every = docs.select(key, sentences(text).alias("_every"))
    every = every.select(key, F.filter("_every", lambda s: F.length(s) > 20).alias("_said"), F.filter("_every", lambda s: F.length(s) <= 20).alias("_short"))
    spaced = lambda s: F.array_join(words(s), " ")
    own = F.array_join(F.transform("_said", lambda s: F.concat(spaced(s), F.lit("\n"))), "")
    said = every.select(key, "_said", _told(size)(own, spaced(F.array_join("_short", " "))).alias("_told"))
    return said.select(key, F.inline(F.transform("_told", lambda p: F.struct(p.alias("place"), F.get("_said", p).alias("sentence")))))


def repeated_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``text`` without lines that stood before in the document, whatever their case; blank lines stay."""
    from ..functions.text import casefold

    line = docs.select(key, F.posexplode(F.split(text, "\n")).alias("place", "line"))
    rank = F.row_number().over(Window.partitionBy(key, casefold("line")).orderBy("place"))
    kept = line.withColumn("rank", rank).where("rank = 1 or line = ''")
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda s: s["line"]), "\n").alias("text"))
