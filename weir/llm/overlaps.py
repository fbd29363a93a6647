"""Overlapping intervals of two tables by key, through implicit augmented interval trees (operator 12).

The right side's intervals of a key, sorted by start, are an implicit binary tree:
an array in order, in which every node also knows the largest end below it. The left
side's intervals come in Arrow batches and go down the tree level by level, all of a
batch together; a branch ends where its largest end lies before the interval or its
start behind it. An open end is the largest number there is within a key's stretch.

All keys of a batch stand in one tree: key after key has a stretch of its own on one
long axis, which no interval leaves.

Nothing grows in one place: a key's intervals are cut into shards by their start, so a
shard's tree has a bounded number of different intervals (equal ones are one, with a
count), and a key's left rows are dealt over as many tasks as they fill, each with a
copy of the shard.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Stands for an end that is open. Starts and ends lie between -OPEN and OPEN.
OPEN = 1 << 40
_STRETCH = OPEN << 2

#: [start earlier, equal, later][end earlier, equal, later] of the left interval, seen from the right one.
RELATIONS = ["overlaps", "finished_by", "contains", "starts", "equals", "started_by", "during", "finishes", "overlapped_by"]

DAY = 86_400_000_000


class Tree:
    """Intervals with inclusive ends as an implicit augmented tree; equal starts in any order."""

    def __init__(self, start: np.ndarray, end: np.ndarray):
        self.order = np.argsort(start, kind="stable")
        self.levels = len(start).bit_length()
        size = (1 << self.levels) - 1
        # what fills the tree up lies behind every interval and ends before it
        self.start = np.full(size, np.iinfo(np.int64).max)
        self.end = np.full(size, np.iinfo(np.int64).min)
        self.start[: len(start)], self.end[: len(start)] = start[self.order], end[self.order]
        self.most = self.end.copy()
        for level in range(1, self.levels):
            node = np.arange((1 << level) - 1, size, 2 << level)
            step = 1 << level - 1
            self.most[node] = np.maximum(self.most[node], np.maximum(self.most[node - step], self.most[node + step]))

    def meet(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the interval asked for, number of one in the tree) of every two that share a point."""
        asked, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if self.levels:
            who = np.arange(len(start))
            node = np.full(len(start), (1 << self.levels - 1) - 1)
            for level in range(self.levels - 1, -1, -1):
                reach = self.most[node] >= start[who]
                who, node = who[reach], node[reach]
                begun = self.start[node] <= end[who]
                hit = begun & (self.end[node] >= start[who])
                asked.append(who[hit])
                found.append(node[hit])
                if level:
                    step = 1 << level - 1
                    who, node = np.concatenate([who, who[begun]]), np.concatenate([node - step, node[begun] + step])
        return np.concatenate(asked), self.order[np.concatenate(found)]


def _met(tree: Tree, start: np.ndarray, end: np.ndarray, largest: int, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``Tree.meet`` for as many intervals at a time as give at most ``most`` pairs, when a key has at most ``largest`` intervals."""
    step = max(1, most // max(1, largest))
    for at in range(0, len(start), step):
        asked, found = tree.meet(start[at : at + step], end[at : at + step])
        yield asked + at, found


def _seen(ls: np.ndarray, le: np.ndarray, rs: np.ndarray, re: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(relation's number, points shared, whether both ends are open) of pairs on the axis of all keys."""
    relation = (np.sign(ls - rs) + 1) * 3 + np.sign(le - re) + 1
    ends = np.minimum(le, re)
    return relation, ends - np.maximum(ls, rs) + 1, ends % _STRETCH == OPEN * 2


KEY = ["key", "shard", "part"]
_IN = ["id", "start", "end", "n", "measure"]
OUT = "id long, relation int, n_pairs long, shared long, measure long"


def _related(batches: Iterator[pa.RecordBatch], pairs: bool) -> Iterator[pa.RecordBatch]:
    """Rows come key by key, the right side's first. What a key that goes on in the next batch has of it is held."""
    held = None
    for batch in batches:
        rows = {c: batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in [*KEY, "left", *_IN]}
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
        if not len(rows["key"]):
            continue
        new = np.any([rows[c][1:] != rows[c][:-1] for c in KEY], axis=0)
        rank = np.concatenate([[0], np.cumsum(new)])
        left = rows["left"] > 0
        last = ~left & (rank == rank[-1])
        held = {c: x[last] for c, x in rows.items()}
        if not left.any():
            continue
        on_axis = {c: rank * _STRETCH + rows[c] + OPEN for c in ("start", "end")}
        ls, le, rs, re = (on_axis[c][side] for side in (left, ~left) for c in ("start", "end"))
        tree, n, measure = Tree(rs, re), rows["n"][~left], rows["measure"][~left]
        largest = int(np.bincount(rank[~left]).max(initial=0))
        ids, nameless, times = rows["id"][left], rows["left"][left] == 2, rows["n"][left]
        if pairs:
            for asked, found in _met(tree, ls, le, largest):
                again = times[asked] * n[found]
                asked, found = np.repeat(asked, again), np.repeat(found, again)
                relation, points, both = _seen(ls[asked], le[asked], rs[found], re[found])
                yield _batch(ids[asked], nameless[asked], relation, np.ones(len(asked), np.int64), points, both, measure[found])
            continue
        # equal intervals of a key ask once
        order = np.lexsort((le, ls))
        first = np.concatenate([[True], (ls[order][1:] != ls[order][:-1]) | (le[order][1:] != le[order][:-1])])
        us, ue = ls[order][first], le[order][first]
        who = np.empty(len(ls), np.int64)
        who[order] = np.cumsum(first) - 1
        sums = np.zeros((4, len(us) * len(RELATIONS)), np.int64)
        for asked, found in _met(tree, us, ue, largest):
            relation, points, both = _seen(us[asked], ue[asked], rs[found], re[found])
            at = asked * len(RELATIONS) + relation
            for row, x in zip(sums, (n[found], n[found] * ~both, points * n[found] * ~both, measure[found]), strict=True):
                np.add.at(row, at, x)
        sums = sums.reshape(4, len(us), len(RELATIONS))[:, who]
        row, relation = np.nonzero(sums[0])
        n, closed, points, measure = sums[:, row, relation] * times[row]
        yield _batch(ids[row], nameless[row], relation, n, points, closed == 0, measure)


def _batch(ids, nameless, relation, n, points, no_points, measure) -> pa.RecordBatch:
    columns = [pa.array(ids, mask=nameless), pa.array(relation.astype(np.int32)), pa.array(n), pa.array(points, mask=no_points), pa.array(measure)]
    return pa.RecordBatch.from_arrays(columns, ["id", "relation", "n_pairs", "shared", "measure"])


def floored(x: Column | str, by: int) -> Column:
    """Whole units of ``by`` in a long, also below 0."""
    x = F.col(x) if isinstance(x, str) else x
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))


def _dealt(left: DataFrame, right: DataFrame, keys: DataFrame, span: int, rows: int) -> DataFrame:
    """Both sides by key, shard and part, the right side's rows of each first; the left side's have 1 in ``left``, or 2 without an id."""
    right = right.withColumn("shard", floored("start", span))
    reach = right.groupBy("key", "shard").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / rows).cast("int"))
    put = right.join(reach.select("key", "shard").join(sizes.drop("n"), "key"), ["key", "shard"])
    put = put.select("key", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("left"), F.lit(None).cast("long").alias("id"), "start", "end", "n", "measure")
    # a key's shards are few: as many as its right rows' starts fill
    shards = reach.groupBy("key").agg(F.collect_list(F.struct("shard", "lo", "hi")).alias("shards")).join(sizes, "key")
    ask = shared.spread_join(left.withColumnRenamed("n", "times"), shards, ["key"], keys.count(), ["id", "start", "end"])
    part = F.pmod(F.xxhash64("id", "start", "end"), "parts").cast("int")
    ask = ask.select("key", part.alias("part"), "id", "start", "end", "times", F.inline("shards")).where((F.col("lo") <= F.col("end")) & (F.col("hi") >= F.col("start")))
    ask = ask.select("key", "shard", "part", F.when(F.col("id").isNull(), 2).otherwise(1).alias("left"), "id", "start", "end", F.col("times").alias("n"), F.lit(None).cast("long").alias("measure"))
    return put.unionByName(ask).repartition(*KEY).sortWithinPartitions(*KEY, "left", "start", "end")


def _side(df: DataFrame, *more: str) -> DataFrame:
    """Rows without a key, start or end or whose end lies before the start take no part."""
    return df.select(*(F.col(c).cast("long").alias(c) for c in ("key", "start", "end", *more))).where("key is not null and start <= end")


def _once(rows: DataFrame) -> DataFrame:
    """Equal rows as one, with ``n``."""
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


def joined(left: DataFrame, right: DataFrame, *, span: int = 1024, rows: int = 2048) -> DataFrame:
    """``left_id``, ``right_id``, ``relation``, ``shared`` of every two rows with one key whose intervals share a point.

    Both sides: long ``id``, ``key``, ``start``, ``end`` (inclusive; ``OPEN``: no end).
    ``relation`` is the left interval's towards the right one; ``shared`` the points that
    both have, null if both are open. A key's right rows are cut into shards of ``span``
    starts, its left rows dealt by ``rows``. Repeated rows each have their pairs; a null ``right_id`` counts as 0.
    """
    left, right = _once(_side(left, "id")), _once(_side(right, "id")).withColumnRenamed("id", "measure")
    out = _dealt(left, right, left, span, rows).mapInArrow(functools.partial(_related, pairs=True), OUT)
    return out.select(F.col("id").alias("left_id"), F.col("measure").alias("right_id"), named("relation").alias("relation"), "shared")


def related(left: DataFrame, right: DataFrame, *, keys: DataFrame | None = None, span: int = 1024, rows: int = 2048) -> DataFrame:
    """``id``, ``relation``, ``n_pairs``, ``shared``, ``measure``: the pairs of ``joined`` by left id and relation, never listed.

    ``left`` may have ``n``, how often a row stands there. ``keys``: rows with ``key`` by which the left
    side's keys are sized, where these are cheaper to count than ``left``.
    ``right`` has a long column ``measure`` that is summed. Its equal intervals of a key
    are one entry of the tree, so a shard has at most as many as there are different
    intervals that begin in ``span`` points. ``shared`` is null if all ends are open.
    """
    entries = _side(right, "measure").groupBy("key", "start", "end").agg(F.count("*").alias("n"), F.sum("measure").alias("measure"))
    left = _side(left, "id", "n") if "n" in left.columns else _once(_side(left, "id"))
    out = _dealt(left, entries, left if keys is None else keys, span, rows).mapInArrow(functools.partial(_related, pairs=False), OUT)
    out = out.groupBy("id", "relation").agg(*(F.sum(c).alias(c) for c in ("n_pairs", "shared", "measure")))
    return out.withColumn("relation", named("relation"))


def named(relation: str) -> Column:
    return F.element_at(F.array(*map(F.lit, RELATIONS)), F.col(relation) + 1)


def micros(at: Column | str) -> Column:
    """Whole microseconds since 1970 of a time without a zone."""
    at = F.col(at) if isinstance(at, str) else at
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at.cast("timestamp_ntz"))


def sessions(events: DataFrame, gap: int, *, chunk: int = 288) -> DataFrame:
    """``key``, ``first``, ``last``, ``mark`` of each run of a key's events in which none comes more than ``gap`` after the one before.

    ``events``: long ``key``, ``at``, boolean ``mark``; rows without key or time take no
    part, a null mark is false. ``mark``: whether an event at the run's last time has it.

    Events in one stretch of ``gap`` are never parted, so a stretch is one row before
    anything else happens; runs are found within ``chunk`` stretches, and only the first
    and last run of each chunk meet the key's other chunks.
    """
    stretch = events.where("key is not null and at is not null").withColumn("stretch", floored("at", gap))
    end = F.max(F.struct("at", F.coalesce("mark", F.lit(False)).alias("mark"))).alias("end")
    stretch = stretch.groupBy("key", "stretch").agg(F.min("at").alias("first"), end).withColumn("chunk", floored("stretch", chunk))
    broken = lambda w: (F.col("first") - F.lag("end.at").over(w) > gap).cast("int")
    w = Window.partitionBy("key", "chunk").orderBy("stretch")
    runs = stretch.withColumn("new", F.coalesce(broken(w), F.lit(0))).withColumn("run", F.sum("new").over(w))
    runs = runs.groupBy("key", "chunk", "run").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    runs = runs.withColumn("edge", (F.col("run") == 0) | (F.col("run") == F.max("run").over(Window.partitionBy("key", "chunk"))))
    w = Window.partitionBy("key").orderBy("first")
    edges = runs.where("edge").withColumn("new", F.coalesce(broken(w), F.lit(0))).withColumn("run", F.sum("new").over(w))
    edges = edges.groupBy("key", "run").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    every = runs.where(~F.col("edge")).select("key", "first", "end").unionByName(edges.select("key", "first", "end"))
    return every.select("key", "first", F.col("end.at").alias("last"), F.col("end.mark").alias("mark"))


def op12_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales beside their clients' click sessions, by sale and relation, in days.

    Rows with a null client or time take no part; lines of no sale or without a time don't
    count. A repeated sale has the pairs of each of its rows; sales without an id are one.
    Sales without pairs have no row. Other columns are ignored.
    """
    clicks, sales, lines = (shared.table(spark, sf_dir, t) for t in ("clicks", "sales", "sale_lines"))
    runs = sessions(clicks.select(F.col("client_id").alias("key"), micros("ts").alias("at"), (F.col("kind") == "click").alias("mark")), 300_000_000)
    right = runs.select("key", floored("first", DAY).alias("start"), F.when(F.col("mark"), OPEN).otherwise(floored("last", DAY)).alias("end"), F.crc32(F.col("first").cast("string").cast("binary")).alias("measure"))
    shipped = lines.where("sale_id is not null and shipped_at is not null").groupBy("sale_id").agg(F.max(micros("shipped_at")).alias("shipped"))
    sales = sales.where("client_id is not null and sold_at is not null").groupBy("sale_id", "client_id", "status", micros("sold_at").alias("sold")).agg(F.count("*").alias("n"))
    sold = sales.join(shipped, "sale_id", "left")
    end = F.when(F.col("status") == "held", OPEN).otherwise(floored(F.greatest("sold", "shipped"), DAY))
    left = sold.select(F.col("sale_id").alias("id"), F.col("client_id").alias("key"), floored("sold", DAY).alias("start"), end.alias("end"), "n")
    return related(left, right, keys=sales.select(F.col("client_id").alias("key"))).select(F.col("id").alias("sale_id"), "relation", "n_pairs", F.col("shared").alias("overlap_slots"), F.col("measure").alias("sessions_crc"))


#: CRC-32 in SQL: its table of 256 from the polynomial, then a fold over the digits.
OP12_SQL = """
WITH t AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, [CAST(0 AS BIGINT) FOR _ IN range(8)]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
c AS (SELECT client_id, epoch_us(ts) AS us, coalesce(kind = 'click', false) AS hit FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
g AS (SELECT *, CASE WHEN us - lag(us) OVER w > 300000000 THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY client_id ORDER BY us)),
h AS (SELECT client_id, us, hit, sum(new) OVER (PARTITION BY client_id ORDER BY us) AS run FROM g),
e AS (SELECT *, max(us) OVER (PARTITION BY client_id, run) AS stop FROM h),
s AS (SELECT client_id, min(us) AS first, max(us) AS stop, bool_or(hit AND us = stop) AS open FROM e GROUP BY client_id, run),
r AS (SELECT client_id, CAST(floor(first / 86400000000) AS BIGINT) AS rs, CASE WHEN open THEN 1099511627776 ELSE CAST(floor(stop / 86400000000) AS BIGINT) END AS re,
        list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(first AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda a, b: xor(a >> 8, t.crc[(xor(a, b) & 255) + 1])) AS crc FROM s, t),
n AS (SELECT client_id, rs, re, count(*) AS n, sum(xor(crc, 4294967295)) AS crc FROM r GROUP BY client_id, rs, re),
l AS (SELECT sale_id, epoch_us(max(shipped_at)) AS shipped FROM sale_lines GROUP BY sale_id),
q AS (SELECT sale_id, client_id, CAST(floor(epoch_us(sold_at) / 86400000000) AS BIGINT) AS ls, CASE WHEN status = 'held' THEN 1099511627776 ELSE CAST(floor(greatest(epoch_us(sold_at), shipped) / 86400000000) AS BIGINT) END AS le
        FROM sales LEFT JOIN l USING (sale_id) WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
u AS (SELECT DISTINCT client_id, ls, le FROM q),
p AS (SELECT client_id, ls, le, CASE WHEN ls < rs THEN CASE WHEN le < re THEN 'overlaps' WHEN le = re THEN 'finished_by' ELSE 'contains' END
        WHEN ls = rs THEN CASE WHEN le < re THEN 'starts' WHEN le = re THEN 'equals' ELSE 'started_by' END
        ELSE CASE WHEN le < re THEN 'during' WHEN le = re THEN 'finishes' ELSE 'overlapped_by' END END AS relation,
        CASE WHEN least(le, re) < 1099511627776 THEN least(le, re) - greatest(ls, rs) + 1 END AS slots, n, crc
      FROM u JOIN n USING (client_id) WHERE rs <= le AND ls <= re),
a AS (SELECT client_id, ls, le, relation, sum(n) AS n, sum(n * slots) AS slots, sum(crc) AS crc FROM p GROUP BY client_id, ls, le, relation)
SELECT sale_id, relation, CAST(sum(n) AS BIGINT) AS n_pairs, CAST(sum(slots) AS BIGINT) AS overlap_slots, CAST(sum(crc) AS BIGINT) AS sessions_crc
FROM q JOIN a USING (client_id, ls, le) GROUP BY sale_id, relation"""
