"""Quality classifier (operator 3): histogram gradient-boosted trees over document statistics.

Statistics of a text are counted over its bytes, words and lines in numpy. Trees
are grown on the driver from a bounded sample of labelled rows whose features are
put into at most ``BINS`` quantile bins: gradients are summed by bin, and the best
cut of a node is read from the cumulated sums. A forest is flattened into arrays
(feature, cut, children, value); to score, all rows walk one level at a time.

Scoring is a map over slices of bounded size; the forest is a few kilobytes.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .shared import U64

BINS = 64
#: Byte classes whose share of a text is a feature each.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ",", ".", "!", "?", "|", "#", "$", "%", "&", "*", "@", "'\"", "()[]{}<>", "=+-_/\\^~`", ":;"]


@functools.cache
def classes() -> np.ndarray:
    out = np.full(256, len(CLASSES), np.int64)
    out[128:] = len(CLASSES) + 1
    for k, chars in enumerate(CLASSES):
        out[[ord(c) for c in chars]] = k
    return out


def _distinct_share(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the share of distinct values of each owner, the largest share of one value)."""
    share, top = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
    for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if b > a:
            part = np.sort(values[a:b])
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            share[k], top[k] = (len(cuts) - 1) / (b - a), np.diff(cuts).max() / (b - a)
    return share, top


def statistics(column: pa.Array) -> np.ndarray:
    """A row of features a text; an empty text has zeros."""
    data, at = shared.flat(column)
    n, size = len(column), np.diff(at)
    kinds = classes()[data]
    m = len(CLASSES) + 2
    counts = np.zeros((n, m))
    for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        counts[k] = np.bincount(kinds[a:b], minlength=m)
    some = np.maximum(size, 1)[:, None]
    start, end, owner = shared.word_spans(data, at)
    words = shared.word_hashes(data, start, end)
    cuts = np.searchsorted(owner, np.arange(n + 1))
    number = np.diff(cuts)
    lengths = (end - start).astype(float)
    sums = np.concatenate([[0.0], np.cumsum(lengths)])
    squares = np.concatenate([[0.0], np.cumsum(lengths**2)])
    per = np.maximum(number, 1)
    mean = np.diff(sums[cuts]) / per
    spread = np.sqrt(np.maximum(np.diff(squares[cuts]) / per - mean**2, 0))
    upper = np.concatenate([[0], np.cumsum((data[start] >= 65) & (data[start] <= 90))]) if len(start) else np.zeros(1)
    odd = np.concatenate([[0], np.cumsum((classes()[data[end - 1]] >= 7) & (classes()[data[end - 1]] < len(CLASSES)))]) if len(start) else np.zeros(1)
    distinct, top = _distinct_share(words, cuts)
    # lines: the hash of the bytes up to each line feed
    stop = np.flatnonzero((data == 10) if len(data) else np.zeros(0, bool))
    heads = np.concatenate([at[:-1][size > 0], stop + 1])
    heads = np.unique(heads[heads < len(data)])
    # the next line feed, but at most the end of the text itself
    ends = np.minimum(np.append(stop, len(data))[np.searchsorted(stop, heads)], at[np.searchsorted(at, heads, side="right")]) if len(heads) else heads
    lines = shared.span_hashes(data, heads, ends) if len(heads) else np.zeros(0, U64)
    line_at = np.searchsorted(heads, at)
    line_distinct, line_top = _distinct_share(lines, line_at)
    n_lines = np.diff(line_at)
    columns = [counts / some, np.log1p(size)[:, None], np.log1p(number)[:, None], mean[:, None], spread[:, None], (np.diff(upper[cuts]) / per)[:, None], (np.diff(odd[cuts]) / per)[:, None], distinct[:, None], top[:, None], np.log1p(n_lines)[:, None], (size / np.maximum(n_lines, 1))[:, None], line_distinct[:, None], line_top[:, None]]
    return np.hstack(columns)


@dataclass
class Forest:
    """Trees end to end: node k goes left if its feature is at most its cut; a leaf leads to itself."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[row, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, least: int = 10, penalty: float = 1.0, bins: int = BINS) -> Forest:
    """Logistic loss, Newton leaf values. One class only, or no rows: a constant score."""
    p = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(p / (1 - p)))
    nodes: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "value")}
    roots: list[int] = []

    def leaf(value: float) -> int:
        k = len(nodes["value"])
        for name, v in (("feature", 0), ("cut", 0.0), ("left", k), ("right", k), ("value", value)):
            nodes[name].append(v)
        return k

    if len(y) >= 2 * least and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins, method="lower")) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
        raw = np.full(len(y), base)
        for _ in range(trees):
            q = 1 / (1 + np.exp(-raw))
            g, h = y - q, q * (1 - q)

            def build(rows: np.ndarray, level: int, g=g, h=h) -> int:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                best = (1e-6, -1, -1)
                if level and len(rows) >= 2 * least:
                    for f in range(len(binned)):
                        if not len(cuts[f]):
                            continue
                        b = binned[f, rows]
                        size = len(cuts[f]) + 1
                        hg, hh, hn = (np.bincount(b, weights=w, minlength=size).cumsum()[:-1] for w in (g[rows], h[rows], None))
                        gain = hg**2 / (hh + penalty) + (total_g - hg) ** 2 / (total_h - hh + penalty) - total_g**2 / (total_h + penalty)
                        gain[(hn < least) | (len(rows) - hn < least)] = 0
                        k = int(np.argmax(gain))
                        if gain[k] > best[0]:
                            best = (float(gain[k]), f, k)
                if best[1] < 0:
                    out = leaf(rate * total_g / (total_h + penalty))
                    raw[rows] += nodes["value"][out]
                    return out
                _, f, k = best
                out = leaf(0.0)
                goes = binned[f, rows] <= k
                nodes["feature"][out], nodes["cut"][out] = f, float(cuts[f][k])
                nodes["left"][out] = build(rows[goes], level - 1)
                nodes["right"][out] = build(rows[~goes], level - 1)
                return out

            roots.append(build(np.arange(len(y)), depth))
    return Forest(np.array(roots, int), *(np.array(nodes[k]) for k in ("feature", "cut", "left", "right", "value")), base, depth)


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from learning: crc32 of the id as text, modulo 5, is 0. Null ids are kept from it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def labelled_sample(labels: DataFrame, id_col: str, label: str, most: int) -> DataFrame:
    """``doc_id``, ``label`` of about ``most`` rows at most that may be learnt from, chosen by a hash of the id."""
    open_ = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    open_ = open_.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    n = open_.count()
    share = 1 << 30 if n <= most else int((1 << 30) * most / n)
    return open_.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < share)


def _features(part: pa.RecordBatch) -> pa.RecordBatch:
    x = statistics(part.column("text"))
    return pa.RecordBatch.from_arrays([part.column("label"), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.reshape(-1)))], ["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = 12_000) -> Forest:
    """``most``: the bound of the sample, in rows (about 300 bytes each on the driver)."""
    ids = labelled_sample(labels, id_col, label, most)
    # a row an id, however many rows of ``docs`` repeat it
    rows = shared.texts(docs, id_col, text_col).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    got = rows.mapInArrow(shared.by_slices(_features), "label int, x array<double>").toArrow()
    x = np.array(got.column("x").combine_chunks().flatten()).reshape(got.num_rows, -1) if got.num_rows else np.zeros((0, 1))
    y = got.column("label").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # rows come in any order; sums don't depend on it now
    return grow(x[order], y[order])


def _scored(part: pa.RecordBatch, forest: Forest) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(forest.scores(statistics(part.column("text"))))], ["doc_id", "score"])


def scored(docs: DataFrame, forest: Forest, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for each row.

    The score depends on the text alone. Null text counts as empty; an empty text
    has the score of zero statistics. Null ids are passed on, held out. Repeated
    rows each get a row. Other columns are ignored.
    """
    out = shared.texts(docs, id_col, text_col).mapInArrow(shared.by_slices(functools.partial(_scored, forest=forest)), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, shared.table(spark, sf_dir, "labels")))
