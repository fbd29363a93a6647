"""Paragraphs of segments whose keys may be of any size: each range of (key, seq) is worked on by itself.

Keys that lie within a range are finished there. A key at an end of a range may go on in the
next one: of such a piece is told how it is left, by the number of characters with which it is
entered. What is carried between ranges is one row a piece, so at most two rows a range.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .storage import cut

#: The end of a sentence.
SAID = r"[.!?…]\z"
#: What a range's pass gives: a paragraph (n, text), a row of a piece (text, _piece, _at, _next), or how a piece is left (the rest).
_GIVEN = "n int, text string, _piece long, _at long, _next long, _first double, _last double, _all long, _more array<long>, _to array<long>, _count array<long>, _left array<long>"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
_FIELDS = [pa.field(name, _ARROW[kind]) for name, kind in map(str.split, _GIVEN.split(", "))]


def _heads(keys: pa.Array) -> np.ndarray:
    """Rows at which another key begins, but the first."""
    codes = keys.dictionary_encode("encode").indices.to_numpy()
    return np.flatnonzero(codes[1:] != codes[:-1]) + 1


def _nexts(rows: pa.RecordBatch, heads: np.ndarray, longest: int, pause: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row, the row behind the paragraph that begins there (the number of rows plus one if it doesn't end); pauses, sentence ends, characters so far."""
    m = rows.num_rows
    wait = pc.subtract(rows.column("start").slice(1), rows.column("end").slice(0, m - 1))
    longer = pc.fill_null(pc.or_(pc.greater(wait, pause), pc.is_nan(wait)), False)  # as in SQL, NaN is more than any number
    stop = np.append(longer.to_numpy(zero_copy_only=False), False)
    stop[heads - 1] = True
    stops = np.flatnonzero(stop)
    ends = np.flatnonzero(rows.column("_said").to_numpy(zero_copy_only=False))
    size = rows.column("_size").to_numpy().astype(np.int64)
    far = np.cumsum(size)
    over = np.append(ends, m)[np.searchsorted(far[ends], far - size + longest + 1, "right")]
    return np.minimum(over, np.append(stops, m)[np.searchsorted(stops, np.arange(m))]) + 1, stops, ends, far


def _joined(texts: pa.Array, starts: list[int]) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([*starts, len(texts)], pa.int32()), texts), " ")


def _told(rows: pa.RecordBatch, longest: int, pause: float) -> pa.Table:
    """``n`` and ``text`` of the paragraphs of whole keys."""
    heads = _heads(rows.column(0))
    stops = np.append(heads, rows.num_rows)
    after = _nexts(rows, stops, longest, pause)[0]
    starts, now = [], 0
    while now < rows.num_rows:
        starts.append(now)
        now = int(after[now])
    first = np.searchsorted(starts, np.append(0, heads))
    n = np.arange(len(starts)) - first[np.searchsorted(first, np.arange(len(starts)), "right") - 1]
    return pa.table([rows.column(0).take(pa.array(starts)), pa.array(n.astype(np.int32)), _joined(rows.column("text"), starts)], [rows.schema.names[0], "n", "text"])


def _piece(rows: pa.RecordBatch, piece: int, longest: int, pause: float) -> Iterator[pa.Table]:
    """The rows of a piece with the row that comes after a paragraph from there on, and one row of how it is left.

    Entered with more than ``_more`` characters (the first such: they fall) its first paragraph
    ends before row ``_to``, ``_count`` end in all, and ``_left`` characters are open. There are at
    most ``longest`` of them, as each holds for at least one character less than the one before.
    """
    m, key = rows.num_rows, rows.schema.names[0]
    after, stops, ends, far = _nexts(rows, np.zeros(0, np.int64), longest, pause)
    stop = int(stops[0]) if len(stops) else m
    few = ends[: np.searchsorted(far[ends], longest + 1, "right") + 1]
    few = few[few < stop]
    more, to = (longest + 1 - far[few]).tolist(), (few + 1).tolist()
    if stop < m and (not more or more[-1] >= 0):
        more, to = [*more, -1], [*to, stop + 1]
    held = {m: (0, m)}  # by row: how many paragraphs end from there on, and where the open one begins
    for now in to:
        way = []
        while now not in held:
            if after[now] > m:
                held[now] = (0, now)
            else:
                way.append(now)
                now = int(after[now])
        count, open_ = held[now]
        for k, x in enumerate(reversed(way), 1):
            held[x] = (count + k, open_)
    total = int(far[-1])
    yield pa.table([rows.column(0), rows.column("text"), *map(pa.array, (np.full(m, piece), np.arange(m), after))], [key, "text", "_piece", "_at", "_next"])
    count = [1 + held[x][0] for x in to]
    left = [total - int(far[held[x][1] - 1]) for x in to]
    said = {"_piece": piece, "_first": rows.column("start")[0].as_py(), "_last": rows.column("end")[m - 1].as_py(), "_all": total, "_more": more, "_to": to, "_count": count, "_left": left}
    yield pa.table([rows.column(0).slice(0, 1), *(pa.array([x]) for x in said.values())], [key, *said])


def _shaped(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """With all of the pass's columns, null where ``table`` has none."""
    fields = [table.schema.field(0), *_FIELDS]
    there = {f.name: table.column(f.name).cast(f.type) for f in fields if f.name in table.column_names}
    full = pa.table([there.get(f.name, pa.nulls(table.num_rows, f.type)) for f in fields], pa.schema(fields))
    return iter(full.combine_chunks().to_batches(max_chunksize=1 << 16))


def _read(longest: int, pause: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over a range's rows in the order of key and seq."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, held, at = 0, [], 0  # held: of the key at hand
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column("_range")[0].as_py() * 2
            keys = batch.column(0)
            cuts = _heads(pa.concat_arrays([held[-1].column(0).slice(held[-1].num_rows - 1), keys])) - 1 if held else _heads(keys)
            if not len(cuts):
                held.append(batch)
                continue
            a, z = int(cuts[0]), int(cuts[-1])
            if a:
                held.append(batch.slice(0, a))
            if side == 0:
                for table in _piece(pa.concat_batches(held), at, longest, pause):
                    yield from _shaped(table)
                side, held = 1, []
            if z > a:
                held.append(batch.slice(a, z - a))
            if held:
                yield from _shaped(_told(pa.concat_batches(held), longest, pause))
            held = [batch.slice(z)]
        if held:
            for table in _piece(pa.concat_batches(held), at + side, longest, pause):
                yield from _shaped(table)

    return read


def _entered(pieces: pd.DataFrame) -> pd.DataFrame:
    """Over the pieces of one key: the number of the paragraph that each is entered in, and the row before which that one ends."""
    out, n, left = [], 0, 0
    for _, p in pieces.sort_values("_piece").iterrows():
        if left and p["_waits"]:
            n, left = n + 1, 0
        k = next((k for k, least in enumerate(p["_more"]) if left > least), None)
        out.append((p["_piece"], n, 1 << 60 if k is None else p["_to"][k]))
        n, left = (n, left + p["_all"]) if k is None else (n + p["_count"][k], p["_left"][k])
    return pd.DataFrame(out, columns=["_piece", "_n", "_ends"])


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paragraphs of pieces, as far as a batch has them, with their number and the place of their first row."""
    piece, n, due = None, 0, 0  # due: the row at which the next paragraph begins
    for batch in batches:
        at, after, pieces, said, ends = (batch.column(c).to_numpy() for c in ("_at", "_next", "_piece", "_n", "_ends"))
        starts, numbers = [], []
        for x, y in itertools.pairwise([0, *(np.flatnonzero(pieces[1:] != pieces[:-1]) + 1).tolist(), batch.num_rows]):
            if x == y:
                continue
            if pieces[x] != piece:
                piece, n, due = pieces[x], int(said[x]), int(ends[x])
            shift = x - int(at[x])  # from rows of the piece to rows of the batch
            if due + shift > x:
                starts.append(x)
                numbers.append(n)
            while due + shift < y:
                n += 1
                starts.append(due + shift)
                numbers.append(n)
                due = int(after[due + shift])
        rows = pa.array(starts, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(numbers, pa.int32()), pa.array(pieces[starts]), pa.array(at[starts]), _joined(batch.column("text"), starts)], [batch.schema.names[0], "n", "_piece", "_at", "text"])


def by_ranges(segments: DataFrame, key: str, longest: int, pause: float) -> DataFrame:
    """``key``, ``n``, ``text``, without gathering a key. ``segments``: key, seq, start, end (as doubles), text without nulls.

    Rows are dealt by ranges of (key, seq) once; only those of keys at an end of a range are
    dealt again, when it is known how their pieces are entered. A paragraph's parts then meet.
    """
    spark, longest = segments.sparkSession, max(longest, -1)
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = segments.select(key, "seq", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "text", (F.length("text") + 1).alias("_size"), F.col("text").rlike(SAID).alias("_said"))
    ranged = rows.repartitionByRange(parts, key, "seq").sortWithinPartitions(key, "seq").drop("seq").withColumn("_range", F.spark_partition_id())
    kind = ranged.schema[key]
    given = cut(ranged.mapInArrow(_read(longest, pause), StructType([kind, *StructType.fromDDL(_GIVEN)])))
    pieces = given.where(F.col("_more").isNotNull())
    waits = F.coalesce(F.col("_first") - F.lag("_last").over(Window.partitionBy(key).orderBy("_piece")) > pause, F.lit(False))
    enters = pieces.withColumn("_waits", waits).groupBy(key).applyInPandas(_entered, "_piece long, _n int, _ends long")
    open_ = given.where(F.col("_next").isNotNull()).select(key, "text", "_piece", "_at", "_next").join(F.broadcast(enters), "_piece")  # two rows a range
    open_ = open_.select(key, "text", "_piece", "_at", "_next", "_n", "_ends").repartition(parts, "_piece").sortWithinPartitions("_piece", "_at")
    told = open_.mapInArrow(_parted, StructType([kind, *StructType.fromDDL("n int, _piece long, _at long, text string")]))
    held = F.array_sort(F.collect_list(F.struct("_piece", "_at", "text")))  # of one paragraph
    told = told.groupBy(key, "n").agg(F.array_join(F.transform(held, lambda x: x["text"]), " ").alias("text"))
    return given.where(F.col("n").isNotNull()).select(key, "n", "text").unionByName(told)
