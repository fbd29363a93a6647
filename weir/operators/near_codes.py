"""Pairs of 64-bit codes that differ in few bits, by comparing blocks of codes.

Rows are dealt over shards, and every two shards are a block: one task's work, whose
inputs are bounded by the shards' size and which says what it finds a tile at a time. So
a code is sent once for each shard, and an exclusive or and a count of bits is all that
a pair of codes costs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codes in a shard, the rows and columns of a tile of a block, and the rows of it that are compared at a time.
SHARD, HIGH, WIDE, STEP = 1 << 16, 64, 1 << 13, 8
#: Shards that there are at least, if each has ``LEAST`` codes: so that a few codes are many tasks' work, too.
SHARDS, LEAST = 8, 1 << 10
#: Links that are held before they are joined, and pairs before they are sent: a batch has its price however few rows are in it.
HELD, BATCH = 1 << 20, 1 << 17

Found = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _places(hit: np.ndarray) -> np.ndarray:
    """Places of the few hits of a flat array: found by eights first, which costs a fraction of ``nonzero``."""
    whole = len(hit) & -8
    eights = hit[:whole].view(np.uint64)
    some = np.flatnonzero(eights != 0)
    at = np.flatnonzero(eights[some].view(bool))
    return np.concatenate([some[at >> 3] * 8 + (at & 7), np.flatnonzero(hit[whole:]) + whole])


def _near(codes: np.ndarray, cut: int, distance: int) -> Found:
    """(x, y, distance) of places in ``codes`` of near pairs: of the first ``cut`` ones with the others; of all, x < y, if there are no others.

    ``BATCH`` pairs or a little more at a time, or what a strip of columns has left.
    """
    rows, columns, at = (codes[:cut], codes[cut:], cut) if cut < len(codes) else (codes, codes, 0)
    away, count, hit = np.empty(STEP * WIDE, np.uint64), np.empty(HIGH * WIDE, np.uint8), np.empty(HIGH * WIDE, bool)
    for c in range(0, len(columns), WIDE):
        some = columns[c : c + WIDE]
        wide, held, far, found = len(some), [], [], 0
        # of a shard with itself the tiles below the diagonal say nothing new
        last = len(rows) if at else min(len(rows), c + wide)
        for r in range(0, last, HIGH):
            left = rows[r : r + HIGH, None]
            n, h = count[: len(left) * wide], hit[: len(left) * wide]
            for k in range(0, len(left), STEP):
                few = left[k : k + STEP]
                x = away[: len(few) * wide]
                np.bitwise_xor(few, some, out=x.reshape(len(few), wide))
                np.bitwise_count(x, out=n[k * wide : (k + len(few)) * wide])
            np.less_equal(n, distance, out=h)
            met = _places(h)
            if not at:
                met = met[met // wide + r < met % wide + c]
            held.append(met + r * wide)
            far.append(n[met])
            found += len(met)
            if found and (found >= BATCH or r + HIGH >= last):
                i, j = np.divmod(np.concatenate(held), wide)
                yield i, j + (c + at), np.concatenate(far)
                held, far, found = [], [], 0


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, int]]:
    """(rows, codes, how many are of the first shard) of each block; rows come ordered by block and shard."""

    def whole(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, int]:
        table = pa.Table.from_batches(parts).combine_chunks()
        shard = table.column("shard").to_numpy()
        return table, table.column("code").to_numpy().view(np.uint64), int(np.searchsorted(shard, shard[0], "right"))

    now, held = None, []
    for batch in batches:
        block = batch.column("block").to_numpy()
        starts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for x, y in zip(starts, starts[1:], strict=False):
            if x == y:
                continue
            if block[x] != now:
                if held:
                    yield whole(held)
                now, held = block[x], []
            held.append(batch.slice(x, y - x))
    if held:
        yield whole(held)


def _single(table: pa.Table, cut: int) -> bool:
    """Whether the block is a shard with itself, or one of two shards of which the other is empty: that one has its own block."""
    return cut == table.num_rows


def _pairs(distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, codes, cut in _blocks(batches):
            if _single(table, cut) and not table.column("own")[0].as_py():
                continue
            ids = table.column("id").combine_chunks()
            for a, b, d in _near(codes, cut, distance):
                x, y = ids.take(pa.array(a)), ids.take(pa.array(b))
                found = pa.RecordBatch.from_arrays([pc.min_element_wise(x, y), pc.max_element_wise(x, y), pa.array(d.astype(np.int32))], ["a", "b", "distance"])
                other = pc.not_equal(x, y)
                yield found if pc.all(other).as_py() else found.filter(other)

    return run


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (of each place the least place it hangs together with) after links (a, b)."""
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, up := root[root]):
            root = up


def _links(distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What hangs together in a block, as links to the first of it: at most one for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, codes, cut in _blocks(batches):
            if _single(table, cut) and not table.column("own")[0].as_py():
                continue
            root, held, size = np.arange(len(codes)), [], 0
            for a, b, _ in _near(codes, cut, distance):
                new = root[a] != root[b]
                held.append((a[new], b[new]))
                size += len(held[-1][0])
                if size >= HELD:
                    root, held, size = _joined(root, *map(np.concatenate, zip(*held, strict=True))), [], 0
            if held:
                root = _joined(root, *map(np.concatenate, zip(*held, strict=True)))
            ids, moved = table.column("id").combine_chunks(), np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(moved)), ids.take(pa.array(root[moved]))], ["a", "b"])

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (id, code) once for each block that they belong to."""
    n = rows.count()
    k = max(-(-n // SHARD), min(SHARDS, -(-n // LEAST)), 1)
    shard = F.pmod(F.xxhash64("id", "code"), F.lit(k)).cast("int")
    dealt = rows.select("id", "code", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("other"))
    low, high = F.least("shard", "other"), F.greatest("shard", "other")
    dealt = dealt.select("id", "code", "shard", (F.col("shard") == F.col("other")).alias("own"), (low * k + high).alias("block"))
    # by ranges and not by hash: each block has a task of its own
    return dealt.repartitionByRange(k * (k + 1) // 2, "block").sortWithinPartitions("block", "shard")


def near_rows(rows: DataFrame, distance: int) -> DataFrame:
    """``a``, ``b`` (a < b), ``distance`` of all rows (id, code) at most ``distance`` bits apart, equal codes included."""
    kind = rows.schema["id"].dataType.simpleString()
    return _dealt(rows).mapInArrow(_pairs(distance), f"a {kind}, b {kind}, distance int")


def near_links(rows: DataFrame, distance: int) -> DataFrame:
    """``a``, ``b``: links that join the same rows (id, code) to groups as all pairs of ``near_rows`` do, at most one for each row and block."""
    kind = rows.schema["id"].dataType.simpleString()
    return _dealt(rows).mapInArrow(_links(distance), f"a {kind}, b {kind}")
