"""Repeated byte strings (operator 6).

Every byte covered by a ``length``-byte string that also starts anywhere else is
removed. Suffixes are never sorted as a whole. Blocks of strings with a common
prefix are narrowed down across all rows first, by content-defined places, and what
is left undecided is settled by merging Burrows-Wheeler transforms of shards.

Places: every string of ``length`` bytes begins with a window of ``WINDOW`` k-byte
substrings; the first of those with the least hash is the string's anchor, wherever
the string stands. So strings that start in a row share an anchor (a range of starts
owned by it), and equal strings lie alike around theirs. The bytes from the anchor
on that all its strings hold are its core.

1. Anchors whose core stands nowhere else go: nor do their strings.
2. Ranges that are equal in all their bytes repeat as a whole.
3. The ranges that are left, and one of each block of 2 that shares a core with them,
   are written over an alphabet of bytes and cores: a string becomes ``WINDOW``
   symbols, one of them its core. Equal strings have equal cores, so buckets by core
   are apart. In a bucket each shard of strings gets its BWT, and the BWTs are merged
   by refining their interleave: each pass walks the merged order and deals the rows
   out by the symbol before them, which sorts by one symbol more and parts the blocks
   of rows with a common prefix. A row that is alone in its block is settled and
   leaves the passes, with all that lead on from it. After ``WINDOW`` passes rows that
   share a block have equal strings: the repeated intervals.

Passages: a word's passage are the ``words`` words from it on, or what ``length`` bytes
hold of them, of at least 2 * ``WINDOW`` bytes. Whether one stands elsewhere is found on
the way, at little cost, as it may be shorter than ``length``: the cores of step 1 are
those of the shortest passage. A text with a range that is equal to another one is known
to repeat; of the other texts' ranges, and of those that share a core with them, the
passages are counted by hash.

A core that more than ``most`` ranges hold is too much for one bucket. Its ranges are
parted by further symbols of context: the half of the starts that lie nearer to the
core takes the bytes behind it into the core, the other half those before it. Then 2
and 3 hold for the halves, with half the symbols and passes, and so on.

Scale: blocks are counted by key with partial aggregation, and a key that holds a
large share of the ranges meets its group in many tasks (``shared.spread_join``). A
bucket is bounded by its number of strings, each of at most 2 * ``WINDOW`` symbols; a
task has a fixed number of buckets. Hashes have 64 bits in step 1, which only selects, else 96. Text is moved twice, to its document's ranges.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .shared import U64

WINDOW, GRAM = 128, 16
#: An anchor is the least of (33 bits of hash, place); no text has 2**31 bytes.
_PLACE = U64((1 << 31) - 1)
#: Buckets a task works off one after another, and the most tasks a job is dealt to: beyond, a task has more of them.
BUCKETS_A_TASK, MOST_TASKS = 16, 100_000


def words(data: np.ndarray) -> np.ndarray:
    """The number that eight bytes in a row make, from each place on."""
    if len(data) < 8:
        return np.zeros(0, U64)
    two = data[:-1].astype(np.uint16) | (data[1:].astype(np.uint16) << np.uint16(8))
    four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << np.uint32(16))
    return four[:-4].astype(U64) | (four[4:].astype(U64) << U64(32))


def keys(eight: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of a hash of each span of at least 8 bytes, as long and int: two chains over its words of eight bytes.

    The last word may overlap the one before. Each step is a bijection of the word and of
    the chain, so spans that differ in one word never have one hash; there is no polynomial.
    """
    one, two = (end - start).astype(U64), np.full(len(start), U64(0x243F6A8885A308D3))
    size = int((end - start).max()) if len(start) else 0
    for at in range(0, size, 8):
        word = eight[np.minimum(start + at, end - 8)]
        one ^= word
        one *= U64(0x9E3779B97F4A7C15)
        one ^= one >> U64(32)
        two ^= word
        two *= U64(0xD6E8FEB86659FD93)
        two ^= two >> U64(29)
    return shared.mix(one).view(np.int64), (shared.mix(two) >> U64(32)).astype(np.uint32).view(np.int32)


def grams(eight: np.ndarray) -> np.ndarray:
    """A number for each ``GRAM`` (16) bytes in a row, whose high bits depend on all of them."""
    out = eight[:-8] * U64(0x9E3779B97F4A7C15)
    out += eight[8:] * U64(0xC4CEB9FE1A85EC53)
    out ^= out >> U64(29)
    out *= U64(0xD6E8FEB86659FD93)
    return out


def owners(eight: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of starts with one anchor: (anchor, first start, starts, text's number)."""
    none = np.zeros(0, np.int64)
    n = int(at[-1]) - GRAM + 1
    if n < WINDOW:
        return none, none, none, none
    least = grams(eight)
    least &= ~_PLACE
    least |= np.arange(n, dtype=U64)
    span = 1
    while 2 * span <= WINDOW:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < WINDOW:
        more = WINDOW - span
        least = np.minimum(least[:-more], least[more:])
    anchor = (least & _PLACE).view(np.int64)
    # starts whose whole string lies in its text
    good = np.zeros(int(at[-1]) + 1, np.int32)
    whole = np.flatnonzero(np.diff(at) >= length)
    good[at[:-1][whole]] += 1
    good[at[1:][whole] - length + 1] -= 1
    start = np.flatnonzero(np.cumsum(good[: len(anchor)]) > 0)
    if not len(start):
        return none, none, none, none
    own = anchor[start]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)])
    # texts of exactly `length` bytes in a row have neighbouring starts but are apart
    head = np.zeros(int(at[-1]) + 1, bool)
    head[at[:-1]] = True
    new |= head[start]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    return own[first], start[first], count, np.searchsorted(at, start[first], side="right") - 1


def _least(length: int) -> int:
    return min(2 * WINDOW, length)


def _cores(part: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """The core of each range of step 1."""
    data, at = shared.flat(part.column("text"))
    eight = words(data)
    anchor = owners(eight, at, _least(length))[0]
    return pa.RecordBatch.from_arrays([pa.array(keys(eight, anchor, anchor + _least(length) - WINDOW + 1)[0])], ["near"])


def _anchors(part: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """The ranges; the first ``starts`` of their ``n`` starts have a whole string behind them: their core and bytes."""
    data, at = shared.flat(part.column("text"))
    eight = words(data)
    anchor, start, n, text = owners(eight, at, _least(length))
    count = np.clip(at[text + 1] - length - start + 1, 0, n)
    near = keys(eight, anchor, anchor + _least(length) - WINDOW + 1)[0]
    full = np.flatnonzero(count)
    core, ua, ub = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.zeros(len(n), np.int32)
    core[full] = keys(eight, anchor[full], anchor[full] + length - WINDOW + 1)[0]
    ua[full], ub[full] = keys(eight, start[full], start[full] + count[full] - 1 + length)
    columns = [part.column("row").take(pa.array(text)), pa.array(start - at[text], pa.int32()), pa.array(n, pa.int32()), pa.array(count, pa.int32()), pa.array(anchor - start, pa.int32()), pa.array(near), pa.array(core), pa.array(ua), pa.array(ub)]
    return pa.RecordBatch.from_arrays(columns, ["row", "start", "all", "starts", "back", "near", "core", "ua", "ub"])


def passages(data: np.ndarray, at: np.ndarray, length: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the passage of each word that has one."""
    start, end, text = shared.word_spans(data, at)
    if not len(start):
        return start, end
    last = np.minimum(np.arange(len(start)) + number - 1, len(start) - 1)
    full = (np.arange(len(start)) + number <= len(start)) & (text[last] == text)
    stop = np.minimum(np.where(full, end[last], np.int64(1) << 60), start + length)
    good = (stop <= at[text + 1]) & (stop - start >= _least(length))
    return start[good], stop[good]


#: A range of starts: their strings begin ``low`` to ``high`` bytes before the anchor, which is ``back`` behind the first one.
#: ``open``: whether its own strings are asked for; ``kind``: MERGE, or PASSAGES if its passages are.
RANGE = ["start", "n", "back", "low", "high", "open", "kind"]
MERGE, PASSAGES = 0, 1


def _ranges(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(text's number, then the columns of ``RANGE``) of the ranges of each text."""
    ranges = part.column("ranges")
    counts = np.diff(np.array(ranges.offsets))
    flat = ranges.flatten()
    return np.repeat(np.arange(part.num_rows), counts), *(np.array(flat.field(c), np.int64) for c in RANGE)


def _pieces(part: pa.RecordBatch, length: int, number: int) -> pa.RecordBatch:
    """A row for each range to merge: its core's hash and the bytes before and behind it; a row for each passage: its hash."""
    data, at = shared.flat(part.column("text"))
    eight = words(data)
    every = _ranges(part)
    text, start, n, back, low, high, open_, _ = (x[every[-1] == MERGE] for x in every)
    first = at[text] + start
    core, after = first + back - low, first + back + length - high
    a, b = keys(eight, core, after)

    def cut(x: np.ndarray, y: np.ndarray, more: int) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(y - x), np.full(more, (y - x).sum())])
        flat = data[np.arange((y - x).sum()) + np.repeat(x - ends[: len(x)], y - x)]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x) + more, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())

    own, begin, size, *_, said, _ = (x[every[-1] == PASSAGES] for x in every)
    p, q = passages(data, at, length, number)
    lo = np.searchsorted(p, at[own] + begin)
    count = np.searchsorted(p, at[own] + begin + size) - lo
    which = np.arange(count.sum()) + np.repeat(lo - (np.cumsum(count) - count), count)
    pa_, pb = keys(eight, p[which], q[which])
    own, said, none = np.repeat(own, count), np.repeat(said, count), np.zeros(len(which), np.int32)
    both = lambda x, y, kind=None: pa.array(np.concatenate([x, y]), kind)
    columns = [part.column("row").take(both(text, own)), *(both(c, none, pa.int32()) for c in (start, n, low, high)), both(open_ > 0, said > 0), both(a, pa_), both(b, pb), cut(first, core, len(which)), cut(after, first + n - 1 + length, len(which)), both(np.full(len(text), MERGE), np.full(len(which), PASSAGES), pa.int32())]
    return pa.RecordBatch.from_arrays(columns, ["row", "start", "n", "low", "high", "open", "a", "b", "left_", "right_", "kind"])


def _halves(part: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """The ranges with their starts parted by half the distances from the anchor, and the larger cores of either half."""
    data, at = shared.flat(part.column("text"))
    eight = words(data)
    text, start, n, back, low, high, open_, _ = (np.concatenate([x, x]) for x in _ranges(part))
    far = np.arange(len(text)) >= len(text) // 2
    mid = (low + high) // 2
    low, high = np.where(far, mid + 1, low), np.where(far, high, mid)
    # the starts at distances from high down to low
    first, last = np.maximum(back - high, 0), np.minimum(back - low, n - 1)
    some = first <= last
    text, low, high, open_ = text[some], low[some], high[some], open_[some]
    start, back, n = (start + first)[some], (back - first)[some], (last - first + 1)[some]
    begin = at[text] + start
    core = keys(eight, begin + back - low, begin + back + length - high)[0].view(U64) + low.astype(U64)
    ua, ub = keys(eight, begin, begin + n - 1 + length)
    columns = [part.column("row").take(pa.array(text)), *(pa.array(c, pa.int32()) for c in (start, n, back, low, high)), pa.array(open_ > 0), pa.array(core.view(np.int64)), pa.array(ua), pa.array(ub)]
    return pa.RecordBatch.from_arrays(columns, ["row", "start", "starts", "back", "low", "high", "open", "core", "ua", "ub"])


def suffix_rows(text: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The BWT of a shard: (place of each row's suffix, symbol before it, row of the suffix that begins there).

    ``text``: strings of symbols, each ended by 0; ends count as less than all symbols,
    an earlier one as less. Sorted by prefix doubling; the symbol before a string is 0.
    """
    n = len(text)
    ends = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    span = 1
    while True:
        ahead = np.minimum(np.arange(n) + span, n - 1)
        key = rank * (int(rank.max()) + 1) + rank[ahead]
        order = np.argsort(key)
        new = np.empty(n, np.int64)
        sorted_ = key[order]
        new[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        rank = new
        if rank.max() == n - 1:
            break
        span *= 2
    before = np.maximum(order - 1, 0)
    symbol = text[before].copy()
    whole = np.zeros(n, bool)
    whole[heads] = True
    symbol[whole[order]] = 0
    return order, symbol, rank[before]


def merged_blocks(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges BWTs by iterative interleave refinement: (rows of blocks of two or more in merged order, block of each).

    ``shards``: (symbol before, row there, place in its string) by row. Rows are numbered
    through all shards. After each pass the order is that of one symbol more, ties by
    shard; rows are in one block while as many symbols are equal. Nothing is sorted anew:
    a pass deals the rows out by symbol and keeps their order. Only the rows go along that
    lead to a place with ``depth`` symbols: they begin ``depth`` places behind it. A row
    alone in its block leaves: so would all that a later pass finds by way of it.
    """
    base = np.concatenate([[0], np.cumsum([len(s[0]) for s in shards])])
    symbol = np.concatenate([s[0] for s in shards]).astype(np.uint16)
    follow = np.concatenate([s[1] + b for s, b in zip(shards, base, strict=False)]).astype(np.int32)
    order = np.flatnonzero(np.concatenate([s[2] for s in shards]) >= depth).astype(np.int32)
    block = np.zeros(len(order), np.int32)
    for _ in range(depth):
        met = symbol[order]
        to = np.argsort(met, kind="stable")
        met, was = met[to], block[to]
        edge = np.ones(len(to) + 1, bool)
        edge[1:-1] = (met[1:] != met[:-1]) | (was[1:] != was[:-1])
        stay = ~(edge[:-1] & edge[1:])
        order, block = follow[order[to[stay]]], np.cumsum(edge[:-1], dtype=np.int32)[stay]
        if not len(order):
            break
    return order, block


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, how many each value has)."""
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], np.diff(at)


def repeated_starts(rows: pa.RecordBatch, depth: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(range, start within it) of the strings of a bucket's open ranges that stand elsewhere too; ``depth`` symbols each."""
    left, n_left = _bytes(rows.column("left_"))
    right, n_right = _bytes(rows.column("right_"))
    counts = np.array(rows.column("n"), np.int64)
    pair = np.array(rows.column("a"), np.int64), np.array(rows.column("b"), np.int64)
    _, number = np.unique(np.rec.fromarrays(pair), return_inverse=True)
    made, owners_, places = [], [], []
    sizes = n_left + n_right + 2
    from_left, from_right = np.cumsum(n_left) - n_left, np.cumsum(n_right) - n_right
    for shard in range(min(shards, len(counts))):
        own = np.arange(shard, len(counts), shards)
        heads = np.concatenate([[0], np.cumsum(sizes[own])])
        text = np.zeros(heads[-1], np.uint16)
        for data, starts, n, to in ((left, from_left[own], n_left[own], heads[:-1]), (right, from_right[own], n_right[own], heads[:-1] + n_left[own] + 1)):
            every = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            text[every + np.repeat(to, n)] = data[every + np.repeat(starts, n)].astype(np.uint16) + np.uint16(1)
        text[heads[:-1] + n_left[own]] = 257 + number[own]
        place, symbol, follow = suffix_rows(text, heads[:-1])
        owner = np.repeat(np.arange(len(own)), sizes[own])[place]
        owners_.append(own[owner])
        places.append(place - heads[owner])
        made.append((symbol, follow, places[-1]))
    order, _ = merged_blocks(made, depth)
    owner, place = np.concatenate(owners_)[order], np.concatenate(places)[order]
    good = (place < counts[owner]) & np.array(rows.column("open"))[owner]
    owner, place = owner[good], place[good]
    by = np.lexsort((place, owner))
    return owner[by], place[by]


def _settled(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Rows come bucket by bucket; a bucket may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    unit: tuple | None = None

    def done() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        owner, place = repeated_starts(rows, unit[2] - unit[1] + 1, shards)
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)])) if len(owner) else np.zeros(0, np.int64)
        count, owner, place = np.diff(np.append(new, len(owner))), owner[new], place[new]
        start = np.array(rows.column("start"), np.int64)[owner] + place
        return pa.RecordBatch.from_arrays([rows.column("row").take(pa.array(owner)), pa.array(start, pa.int32()), pa.array(count, pa.int32())], ["row", "start", "n"])

    for batch in batches:
        key = np.stack([np.array(batch.column(c), np.int64) for c in ("bucket", "low", "high")])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if x == y:
                continue
            if unit != (now := tuple(key[:, x].tolist())):
                if sum(b.num_rows for b in held) > 1:
                    yield done()
                unit, held = now, []
            held.append(batch.slice(x, y - x))
    if sum(b.num_rows for b in held) > 1:
        yield done()


def cut_out(text: bytes, starts: list[tuple[int, int]], length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """(what is left, the maximal runs that go) for ranges (first start, number of starts)."""
    runs: list[tuple[int, int]] = []
    for start, n in sorted(starts):
        a, b = start, start + n - 1 + length
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    out, at = [], 0
    for a, b in runs:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]]), runs


def _cut(batches: Iterator[pa.RecordBatch], length: int, digests: bool) -> Iterator[pa.RecordBatch]:
    for part in shared.sliced(batches, "text"):
        rows = []
        data, at = shared.flat(part.column("text"))
        raw = data.tobytes()
        for k, (ranges, again) in enumerate(zip(part.column("ranges").to_pylist(), part.column("again").to_pylist(), strict=True)):
            text = raw[at[k] : at[k + 1]]
            kept, runs = cut_out(text, [(r["start"], r["n"]) for r in ranges or []], length)
            rows.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest() if digests else kept, int(again or bool(runs))))
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string() if digests else pa.binary()), pa.array(columns[4], pa.int32())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digests else "kept", "repeats"])


def _asked(every: DataFrame, blocks: DataFrame, alike: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ranges whose passages are counted by hash: one of each block, and the starts without a whole string behind
    them, and the cores of step 1 that one of a text that isn't known to repeat shares with others."""
    one = blocks.select(F.col("first.row").alias("row"), F.col("first.start").alias("start"), "starts", (F.col("n") == 1).alias("open"), "near")
    tail = every.where(F.col("all") > F.col("starts")).select("row", (F.col("start") + F.col("starts")).alias("start"), (F.col("all") - F.col("starts")).alias("starts"), F.lit(True).alias("open"), "near")
    known = alike.select("row").distinct().withColumn("known", F.lit(True))
    both = one.unionByName(tail).join(known.hint("merge"), "row", "left").withColumn("open", F.col("open") & F.col("known").isNull()).drop("known")
    cores = both.groupBy("near").agg(F.count("*").alias("n"), F.max("open").alias("some")).where("n > 1 and some").select("near", "n")
    return both, cores


def _blocks(some: DataFrame, kept: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the blocks of equal ranges; open ranges that are equal to another one in all their bytes; one range of each block of equal ones that shares
    its core with an undecided one, and how many blocks have the core: ``held``)."""
    key = ["ua", "ub", "starts", "back"]
    # min over structs of small rows keeps the first member of each block
    first = F.min(F.struct("row", "start")).alias("first")
    blocks = kept(some.groupBy(*key).agg(F.count("*").alias("n"), first, F.min("core").alias("core"), *([F.min("near").alias("near")] if "near" in some.columns else []), F.min("low").alias("low"), F.min("high").alias("high"), F.min("open").alias("was")), "blocks")
    alike = blocks.where("n > 1").select(*key, "n")
    whole = shared.spread_join(some.where("open"), alike, key, some.count(), ["row", "start"])
    whole = kept(whole.select("row", "start", F.col("starts").alias("n")), "whole")
    one = blocks.select(F.col("first.row").alias("row"), F.col("first.start").alias("start"), "starts", "back", "low", "high", "core", (F.col("was") & (F.col("n") == 1)).alias("open"))
    cores = one.groupBy("core").agg(F.count("*").alias("n"), F.max("open").alias("undecided")).where("n > 1 and undecided").select("core", "n", F.col("n").alias("held"))
    left = shared.spread_join(one, cores, ["core"], blocks.count(), ["row", "start"])
    return blocks, whole, kept(left.select("row", "start", F.col("starts").alias("n"), "back", "low", "high", "open", F.lit(MERGE).alias("kind"), "held"), "undecided")


def _with_text(plain: DataFrame, ranges: DataFrame) -> DataFrame:
    """``row``, ``text``, ``ranges`` of the texts that have ranges."""
    held = ranges.groupBy("row").agg(F.collect_list(F.struct(*RANGE)).alias("ranges"))
    return plain.select("row", "text").join(held.hint("merge"), "row")


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, words: int = 51, digests: bool = False, bucket: int = 1024, shards: int = 4, most: int = 8192) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` the ``kept`` bytes (or ``kept_sha256``), ``repeats`` for each row.

    Texts are UTF-8 bytes. A byte goes if a string of ``length`` bytes that covers it
    also starts anywhere else, in this or another text; overlaps count, and strings
    are judged on the input. No string crosses texts. ``n_spans``: maximal removed
    runs. ``repeats``: 1 if any byte goes, or if a passage of the text also stands
    elsewhere: from some word on ``words`` words, or what the first ``length`` bytes hold
    of them, 256 bytes (or ``length``, if that is less) at least; else 0. It changes
    nothing in what is removed.
    What is left need not be whole characters, hence bytes. Null text counts
    as empty. Each row is a text of its own, whatever its id: rows with the same or a
    null id are compared like others. Other columns are ignored. ``bucket``: how many
    ranges a bucket holds about; ``most``: beyond how many ranges a core's starts are
    parted by more context.
    """
    if length < WINDOW + GRAM:
        raise ValueError(f"length must be at least {WINDOW + GRAM}")
    spark = docs.sparkSession
    plain = shared.texts(docs, id_col, text_col)
    # a name for each row: its id, and for rows that share one the hash and place among them
    twice = plain.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    if twice:
        plain = shared.keep(plain.withColumn("row", F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.monotonically_increasing_id().cast("string"))), "rows")
        row = "string"
    else:
        plain = plain.withColumn("row", F.col("doc_id"))
        row = "long"
    made: list[shared.Kept] = []

    def kept(df: DataFrame, what: str) -> DataFrame:
        made.append(shared.Kept(df, what))
        return made[-1].df

    # slices whose arrays stay in a core's cache
    by_slices = lambda of: shared.by_slices(functools.partial(of, length=length), most=1 << 18)
    cores = plain.select("text").mapInArrow(by_slices(_cores), "near long").groupBy("near").agg(F.count("*").alias("n")).where("n > 1")
    cores = kept(cores, "cores")
    anchors = plain.select("row", "text").mapInArrow(by_slices(_anchors), f"row {row}, start int, all int, starts int, back int, near long, core long, ua long, ub int")
    total = cores.agg(F.sum("n")).first()[0] or 0
    every = kept(shared.spread_join(anchors, cores, ["near"], total, ["row", "start"]), "anchors")
    some = every.where("starts > 0").withColumns({"low": F.lit(0), "high": F.lit(WINDOW - 1), "open": F.lit(True)})
    blocks, alike, left = _blocks(some, kept)
    both, cores = _asked(every, blocks, alike)
    both, cores = kept(both, "asked"), kept(cores, "cores")
    asked = shared.spread_join(both, cores, ["near"], cores.agg(F.sum("n")).first()[0] or 0, ["row", "start"])
    asked = asked.select("row", "start", F.col("starts").alias("n"), *(F.lit(0).alias(c) for c in ("back", "low", "high")), "open", F.lit(PASSAGES).alias("kind"))
    whole, small = [alike], []
    while True:
        small.append(left.where(F.col("held") <= most))
        hot = left.where(F.col("held") > most)
        if hot.isEmpty():
            break
        some = kept(_with_text(plain, hot).mapInArrow(by_slices(_halves), f"row {row}, start int, starts int, back int, low int, high int, open boolean, core long, ua long, ub int"), "halves")
        _, alike, left = _blocks(some, kept)
        whole.append(alike)
    left = functools.reduce(DataFrame.unionByName, small)
    buckets = max(1, -(-left.count() // bucket))
    tasks = min(max(-(-buckets // BUCKETS_A_TASK), min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))), MOST_TASKS)
    pieces = _with_text(plain, left.drop("held").unionByName(asked)).mapInArrow(
        shared.by_slices(functools.partial(_pieces, length=length, number=words), most=1 << 18),
        f"row {row}, start int, n int, low int, high int, open boolean, a long, b int, left_ binary, right_ binary, kind int",
    )
    pieces = kept(pieces, "pieces")
    said = pieces.where(F.col("kind") == PASSAGES).select("row", "open", "a", "b")
    twins = said.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
    again = shared.spread_join(said.withColumn("x", F.monotonically_increasing_id()), twins, ["a", "b"], said.count(), ["x"]).where("open")
    again = again.select("row").distinct().withColumn("again", F.lit(True))
    pieces = pieces.where(F.col("kind") == MERGE).drop("kind").withColumn("bucket", F.pmod("a", F.lit(buckets))).repartition(tasks, "bucket").sortWithinPartitions("bucket", "low", "high", "row", "start")
    ends = pieces.mapInArrow(functools.partial(_settled, shards=shards), f"row {row}, start int, n int")
    every = functools.reduce(DataFrame.unionByName, [*whole, ends])
    found = every.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    found = shared.keep(found.join(again.hint("merge"), "row", "full"), "found")
    for table in made:
        table.drop()
    out = plain.join(found.hint("merge"), "row", "left").select("doc_id", "text", "ranges", F.coalesce("again", F.lit(False)).alias("again"))
    return out.mapInArrow(functools.partial(_cut, length=length, digests=digests), "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digests else "kept binary") + ", repeats int")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(shared.table(spark, sf_dir, "documents"), digests=True)
