"""How filters that act one after another take each other's documents (operator 11).

Which of five filters a document fails is a mask of five bits. For every mask and
every order of the filters a table of 32 by 120 holds the step at which the
document goes. ``mapInArrow`` looks the masks of a batch up in it, ``np.bincount``
adds up removals by part, order and step (all, good and toxic documents), and the
arrays of all tasks are summed: whatever follows from them is linear in the counts,
so that each task gives its share of every column.

A copy's mask follows from its text, so copies are counted by text before anything
of one text meets in a task: a text that a third of the rows hold is a few rows.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

FILTERS = "ABCDE"
ORDERS = ["".join(order) for order in itertools.permutations(FILTERS)]
STEPS = len(FILTERS)

#: Fixed values of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, "#$%&*|"


@functools.cache
def first_failure() -> np.ndarray:
    """[mask, order]: the step, from 1, at which a document goes that fails the filters of a mask; 0 if it stays."""
    fails = np.arange(1 << STEPS)[:, None, None] >> filters_of()[None] & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2) + 1, 0)


@functools.cache
def filters_of() -> np.ndarray:
    """[order, step - 1]: the filter's number."""
    return np.array([[FILTERS.index(f) for f in order] for order in ORDERS])


def text_masks(column: pa.Array) -> np.ndarray:
    """Which of A to D each text fails, as bits 0 to 3. Null counts as empty."""
    data, at = shared.flat(column)
    n = len(at) - 1
    start, end, owner = shared.word_spans(data, at)
    words = np.bincount(owner, minlength=n)
    _, sets = shared.distinct_sets(shared.span_hashes(data, start, end), owner, n)

    def count(inside: np.ndarray) -> np.ndarray:
        before = np.concatenate([[0], np.cumsum(inside)])
        return before[at[1:]] - before[at[:-1]]

    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    few = words < LEAST_WORDS
    same = 100 * np.diff(sets) < LEAST_DISTINCT * words
    loud = 100 * count((data >= 65) & (data <= 90)) > MOST_CAPITALS * count(data & 0xC0 != 0x80)
    return few | same << 1 | loud << 2 | (count(symbol[data]) > 0) << 3


def _masked(part: pa.RecordBatch) -> pa.RecordBatch:
    mask = pa.array(text_masks(part.column("text")), pa.int32())
    return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), part.column("text_id"), mask], ["doc_id", "part", "text_id", "mask"])


def failures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``doc_id``, ``part``, ``text_id`` (128 bits of SHA-256), ``mask`` (A to D) of each row; a null text or part is empty."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_id", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    return rows.mapInArrow(shared.by_slices(_masked), "doc_id long, part string, text_id binary, mask int")


def counted(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``mask`` (A to E), ``good``, ``toxic``, ``n``: failures by kind of document.

    E: an equal text has a smaller doc_id. A null doc_id is neither smaller nor larger
    than another. Of a text's documents with one part and label only how many they are
    and their smallest id travel on.
    """
    each = rows.groupBy("doc_id", "part", "text_id", "mask").agg(F.count("*").alias("n"))
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias({"quality": "good"}.get(c, c))
    said = labels.select(labels["doc_id"].cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(one("quality"), one("toxic"))
    each = each.join(said, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # rows of one id are one row by now, so that the least struct knows how many have the least id
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    kinds = each.groupBy("part", "text_id", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), least)
    first = F.min("least.doc_id").over(Window.partitionBy("text_id"))
    kinds = kinds.withColumn("first", F.col("unnamed") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    both = F.array(F.struct("mask", F.col("first").alias("n")), F.struct(F.col("mask").bitwiseOR(1 << FILTERS.index("E")).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
    return kinds.select("part", "good", "toxic", F.inline(both)).where("n > 0").select("part", "mask", "good", "toxic", "n")


OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
_NAMES = [x.split()[0] for x in OUT.split(", ")]


def _share(parts: list[str], removed: np.ndarray, masks: np.ndarray) -> pa.RecordBatch:
    """What one task has counted: removed[label, part, order, 0 to 5], masks[part, mask]."""
    fails = np.stack([masks[:, np.arange(1 << STEPS) >> f & 1 == 1].sum(axis=1) for f in range(STEPS)], axis=1)
    only, of = masks[:, 1 << np.arange(STEPS)], filters_of()
    every, good, toxic = removed[:, :, :, 1:]
    shapley = np.stack([every[:, of == f].sum(axis=1) for f in range(STEPS)], axis=1)
    kept = masks.sum(axis=1)[:, None, None] - every.cumsum(axis=2)
    columns = [kept, every, fails[:, of] - every, only[:, of], good, toxic, shapley[:, of]]
    keys = [pa.array(np.repeat(np.array(parts, object), len(ORDERS) * STEPS), pa.string()), pa.array(np.tile(np.repeat(np.array(ORDERS, object), STEPS), len(parts)), pa.string()), pa.array(np.tile(np.arange(1, STEPS + 1), len(parts) * len(ORDERS)), pa.int32())]
    return pa.RecordBatch.from_arrays([*keys, *(pa.array(np.broadcast_to(c, every.shape).ravel(), pa.int64()) for c in columns)], _NAMES)


def _audited(batches: Iterator[pa.RecordBatch], rows: int = 2048, most_parts: int = 256) -> Iterator[pa.RecordBatch]:
    """``rows``: looked up at a time; ``most_parts``: after so many parts a task gives its sums and begins anew."""
    table, width, number = first_failure(), STEPS + 1, {}
    cells = len(ORDERS) * width
    removed, masks = np.zeros((3, 0), np.int64), np.zeros(0, np.int64)

    def added(index: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
        return np.rint(np.bincount(index, weights, size)).astype(np.int64)

    def shares() -> pa.RecordBatch:
        return _share(list(number), removed.reshape(3, len(number), len(ORDERS), width), masks.reshape(len(number), 1 << STEPS))

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            here = batch.slice(at, rows)
            names = here.column("part").to_pylist()
            for name in dict.fromkeys(names):
                number.setdefault(name, len(number))
            size = len(number)
            removed = np.pad(removed, ((0, 0), (0, size * cells - removed.shape[1])))
            masks = np.pad(masks, (0, size * (1 << STEPS) - len(masks)))
            part = np.array([number[x] for x in names])
            mask, n, *labels = (here.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mask", "n", "good", "toxic"))
            masks += added(part << STEPS | mask, n, len(masks))
            index = (part[:, None] * cells + np.arange(len(ORDERS)) * width + table[mask]).ravel()
            for k, weight in enumerate([n, *(n * label for label in labels)]):
                removed[k] += added(index, np.repeat(weight, len(ORDERS)), size * cells)
        if len(number) > most_parts:
            yield shares()
            number, removed, masks = {}, np.zeros((3, 0), np.int64), np.zeros(0, np.int64)
    if number:
        yield shares()


def audit(rows: DataFrame) -> DataFrame:
    """Over ``counted`` rows, for each part, order of the filters and step: what the step's filter does there.

    ``kept`` (after the step), ``removed`` (by it), ``redundant`` (failing, but gone
    before), ``unique_fails`` (failing this filter only), ``good_lost``, ``toxic_lost``
    (of the removed) and ``shapley`` (removed by this filter, summed over all orders).
    No rows: no parts, so no rows. Every part has all 600 rows.
    """
    sums = [F.sum(c).alias(c) for c in _NAMES[3:]]
    return rows.select("part", "mask", "good", "toxic", "n").mapInArrow(_audited, OUT).groupBy("part", "filter_order", "step").agg(*sums)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of whole ``documents`` by language.

    A null text is empty, a null language the part ''. A repeated row counts as often as
    it stands there; rows of one id and text aren't copies of each other. A document is
    good or toxic if a label row of its id says so. Other columns are ignored.
    """
    return audit(counted(failures(shared.table(spark, sf_dir, "documents")), shared.table(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, doc_id, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM d),
m AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails,
        coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM s p JOIN s q ON q.x <> p.x JOIN s r ON r.x NOT IN (p.x, q.x) JOIN s ON s.x NOT IN (p.x, q.x, r.x) JOIN s t ON t.x NOT IN (p.x, q.x, r.x, s.x)),
k AS (SELECT filter_order, step, filter_order[step] AS x, filter_order[1:step - 1] AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
g AS (SELECT part, filter_order, step, x, contains(fails, x) AS hit, fails = x AS alone, fails <> '' AND regexp_matches(fails, '[' || earlier || '0]') AS gone, good, toxic, n FROM m, k),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, x, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN hit AND NOT gone AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost FROM g GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r"""
