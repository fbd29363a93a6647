"""Large delimited files, each read by many tasks: records are found whatever range of the file they begin in.

Spark cuts a file into byte ranges at line feeds, but a line feed may stand within
quotes. Of a line only two things matter to the next one: whether the line ends within
quotes if it began outside, and if it began inside. So one pass over the lines gives a
range's end for either beginning, with the records that begin there; a running
composition over the ranges (one small row each) says how each range really begins and
with which record; a second pass reads the ranges as records. A record that goes on into
other ranges is put together from its pieces.
"""

from __future__ import annotations

import csv
import io
import itertools
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.storage import cut
from .files import DELIMITERS, delimiter_of

#: Characters from which a file's dialect is told, and the bytes they may take.
SAMPLE = 20_000
_SAMPLE_BYTES = 4 * SAMPLE

#: White space as Python's ``strip`` counts it.
_SPACE = r"\s\p{Z}\x0b\x1c-\x1f\x85"


def _patterns(mark: str) -> dict[str, str]:
    """What a line does: ``open0``/``open1``: it ends within quotes, begun outside or inside; ``blank0``/``blank1``: its cells are blank."""
    d = re.escape(mark)
    rest, inside, space = f"[^{d}]*+", '(?:[^"]++|"")*+', f"[{_SPACE}&&[^{d}]]*+"
    field = f'(?:"{inside}"{rest}|(?!"){rest})'
    opened = f'(?:{field}{d})*+"{inside}\\z'
    nothing = f'(?:"{space}"{space}|{space})'
    ending = f'(?:{nothing}{d})*+(?:"{space}"{space}|"{space}|{space})\\z'
    return {
        "open0": f"(?s)\\A{opened}", "open1": f'(?s)\\A{inside}(?:\\z|"{rest}{d}{opened})',
        "blank0": f"\\A{ending}", "blank1": f'\\A{space}(?:\\z|"{space}(?:\\z|{d}{ending}))',
    }


def _does(what: str, line: Column) -> Column:
    """By the row's delimiter; the patterns are literals, so that each is compiled once."""
    out = F.lit(None).cast("boolean")
    for mark in DELIMITERS:
        out = F.when(F.col("delimiter") == mark, line.rlike(_patterns(mark)[what])).otherwise(out)
    return out


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file`` (a number for its path), ``range`` (where it begins), ``size`` of the file, ``path``, ``value``: lines without their line feed."""
    m = "_metadata."
    return spark.read.format("text").option("lineSep", "\n").load(path).select(F.xxhash64(m + "file_path").alias("file"), F.col(m + "file_block_start").alias("range"), F.col(m + "file_size").alias("size"), F.col(m + "file_path").alias("path"), "value")


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range its first bytes, no more than a sample may take."""
    rows = ((f, r, p, v) for b in batches for f, r, p, v in zip(*(b.column(c).to_pylist() for c in ("file", "range", "path", "value")), strict=True))
    for (file, at, path), part in itertools.groupby(rows, lambda x: x[:3]):
        held, size = [], 0
        for row in part:
            if size < _SAMPLE_BYTES:
                held.append(row[3][:_SAMPLE_BYTES])
                size += len(row[3]) + 1
        yield pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int64()), "range": pa.array([at], pa.int64()), "path": [path], "head": pa.array([b"\n".join(held)[:_SAMPLE_BYTES]], pa.binary())})


@F.pandas_udf(StringType())
def _mark_of(path: pd.Series, head: pd.Series, given: pd.Series) -> pd.Series:
    """The delimiter, told from the text if none is given; null for a text of two-byte characters, which can't be cut at bytes."""

    def one(path: str, head: bytes, given: str | None) -> str | None:
        if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
            return None
        if given is not None:
            return given
        try:
            text = head.decode("utf-8")
        except UnicodeDecodeError as error:  # the sample may end within a character
            text = head.decode("utf-8", "ignore") if error.start > len(head) - 4 else head.decode("cp1252", "replace")
        return delimiter_of(text[:SAMPLE], path)

    return pd.Series([one(*x) for x in zip(path, head, given, strict=True)], dtype=object)


def _dialects(lines: DataFrame, mark: str | None = None) -> DataFrame:
    """``file``, ``path``, ``delimiter`` of each file that isn't empty."""
    if mark is not None and mark not in DELIMITERS:
        raise ValueError(f"a delimiter is one of {DELIMITERS}")
    heads = lines.where(F.col("range") < _SAMPLE_BYTES).select("file", "range", "path", F.col("value").cast("binary").alias("value")).mapInArrow(_beginnings, "file long, range long, path string, head binary")
    held = F.array_sort(F.collect_list(F.struct("range", "head")))  # of the ranges that a sample can reach into
    heads = heads.groupBy("file", "path").agg(F.aggregate(held, F.lit(b""), lambda out, x: F.when(F.length(out) == 0, x["head"]).otherwise(F.concat(out, F.lit(b"\n"), x["head"]))).alias("head"))
    return heads.select("file", "path", "head", _mark_of("path", "head", F.lit(mark).cast("string")).alias("delimiter"))


_SUMMARY = "file long, range long, size long, bytes long, utf8 boolean, end0 boolean, end1 boolean, n0 long, n1 long, last0 long, last1 long"


class _Summary:
    """A range so far, for either beginning: whether it now stands within quotes, the records begun, the last one that isn't blank."""

    def __init__(self):
        self.inside, self.begun, self.last = [0, 1], [0, 0], [None, None]
        self.bytes, self.utf8 = 0, True

    def add(self, open0: np.ndarray, open1: np.ndarray, blank0: np.ndarray, blank1: np.ndarray) -> None:
        at = np.arange(len(open0))
        known = np.maximum.accumulate(np.where(open0 == open1, at, -1))  # the last line whose end doesn't depend on its beginning
        turns = np.cumsum(open0 & ~open1)
        for s in (0, 1):
            ends = np.where(known >= 0, open0[known] ^ ((turns - turns[known]) & 1), self.inside[s] ^ (turns & 1))
            begins = np.concatenate([[self.inside[s]], ends[:-1]]).astype(bool)
            record = self.begun[s] + np.cumsum(~begins) - 1
            said = np.flatnonzero(~np.where(begins, blank1, blank0))
            if len(said):
                self.last[s] = int(record[said[-1]])
            self.inside[s], self.begun[s] = int(ends[-1]), int(record[-1]) + 1


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, now = None, None

    def row() -> pa.RecordBatch:
        values = [*at, now.bytes, now.utf8, bool(now.inside[0]), bool(now.inside[1]), *now.begun, *now.last]
        kinds = {"long": pa.int64(), "boolean": pa.bool_()}
        return pa.RecordBatch.from_pydict({n: pa.array([v], kinds[k]) for v, (n, k) in zip(values, (x.split() for x in _SUMMARY.split(", ")), strict=True)})

    for batch in batches:
        keys = [batch.column(c).to_numpy() for c in ("file", "range", "size")]
        flags = [batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("open0", "open1", "blank0", "blank1")]
        sizes, utf8 = batch.column("bytes").to_numpy(), batch.column("utf8").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])) + 1
        for x, y in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
            if x == y:
                continue
            key = tuple(int(k[x]) for k in keys)
            if key != at:
                if at is not None:
                    yield row()
                at, now = key, _Summary()
            now.add(*(f[x:y] for f in flags))
            now.bytes += int(sizes[x:y].sum()) + y - x
            now.utf8 &= bool(utf8[x:y].all())
    if at is not None:
        yield row()


def ranges(lines: DataFrame, dialects: DataFrame) -> DataFrame:
    """A row a range: ``inside`` (it begins within quotes), ``first`` (number of its first record), ``last`` (the file's last record that isn't blank), ``path``, ``delimiter``, ``utf8``, ``goes_on`` (its last record does), ``no_feed`` (the file ends without a line feed)."""
    line = F.col("value")
    quoted = line.contains('"')
    open_ = {f"open{s}": F.when(quoted, _does(f"open{s}", line)).otherwise(F.lit(bool(s))) for s in (0, 1)}
    blank = {f"blank{s}": _does(f"blank{s}", line) for s in (0, 1)}
    told = lines.drop("path").join(dialects.select("file", "delimiter"), "file").where("delimiter is not null")
    told = told.select("file", "range", "size", F.octet_length("value").cast("long").alias("bytes"), F.call_function("is_valid_utf8", line).alias("utf8"), *(c.alias(n) for n, c in {**open_, **blank}.items()))
    sums = told.mapInArrow(_summed, _SUMMARY)
    w = Window.partitionBy("file").orderBy("range")
    file = Window.partitionBy("file")
    known, turn = F.col("end0") == F.col("end1"), (F.col("end0") & ~F.col("end1")).cast("int")
    sums = sums.withColumn("turns", F.sum(turn).over(w) % 2)
    base = F.last(F.when(known, F.col("end0").cast("int") + F.col("turns")), ignorenulls=True).over(w)
    sums = sums.withColumn("end", (F.coalesce(base, F.lit(0)) + F.col("turns")) % 2 == 1).withColumn("inside", F.lag("end", 1, False).over(w))
    pick = lambda what: F.when(F.col("inside"), F.col(what + "1")).otherwise(F.col(what + "0"))
    sums = sums.withColumn("first", F.sum(pick("n")).over(w) - pick("n"))
    sums = sums.withColumn("last", F.max(F.col("first") + pick("last")).over(file)).withColumn("utf8", F.min("utf8").over(file))
    # a mark of three bytes at a file's beginning isn't among its lines
    return sums.withColumn("no_feed", (F.sum("bytes").over(file) - F.col("size")).isin(1, -2)).join(dialects, "file").select("file", "range", "inside", "first", "last", "utf8", "no_feed", "path", "delimiter", F.col("end").alias("goes_on"))


_ROWS = "path string, delimiter string, row_no long, cells array<string>, error string"
_PIECES = "file long, row_no long, range long, path string, delimiter string, utf8 boolean, no_feed boolean, text binary"


def _decoder(utf8: bool):
    return (lambda b: b.decode("utf-8")) if utf8 else (lambda b: b.decode("cp1252", "replace"))


class _Feed:
    """Lines for a reader that asks for them; what it took for the record it is at is held."""

    def __init__(self, lines: Iterator[bytes], decode):
        self.lines, self.decode, self.held, self.ended, self.before = lines, decode, [], False, ""

    def __iter__(self):
        return self

    def __next__(self) -> str:
        line = next(self.lines, None)
        if line is None:
            self.ended = True
            raise StopIteration
        self.held.append(line)
        before, self.before = self.before, ""
        return before + self.decode(line) + "\n"


def _records(feed: _Feed, mark: str, inside: bool) -> Iterator[tuple[list[str] | None, str | None, bool, list[bytes]]]:
    """(cells, error, whether the record is whole, its lines); the first one is a record's end if the lines begin within quotes."""
    feed.before = '"' if inside else ""
    reader = csv.reader(feed, delimiter=mark)
    while True:
        feed.held = []
        try:
            cells, error = next(reader), None
        except StopIteration:
            return
        except csv.Error as said:
            cells, error = None, str(said)
        yield cells, error, not feed.ended, feed.held


def _parsed(batches: Iterator[pa.RecordBatch], pieces: bool) -> Iterator[pa.RecordBatch]:
    """Whole records of ranges, or the pieces of those that go on from or into other ranges."""
    csv.field_size_limit(sys.maxsize)
    keys = ("file", "range", "inside", "first", "last", "utf8", "no_feed", "path", "delimiter", "value")
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in keys), strict=True))
    out: list[tuple] = []
    for key, part in itertools.groupby(rows, lambda r: r[:-1]):
        file, at, inside, first, last, utf8, no_feed, path, mark = key
        if first is None:
            raise RuntimeError("the file is cut into other ranges than in the first pass: hold spark.sql.files.maxPartitionBytes, and spark.sql.files.minPartitionNum where executors come and go")
        number = first - inside
        for cells, error, whole, lines in _records(_Feed((r[-1] for r in part), _decoder(utf8)), mark, inside):
            here, number = number, number + 1
            if (whole and here >= first) != pieces and here <= (-1 if last is None else last):
                out.append((file, here, at, path, mark, utf8, no_feed, b"\n".join(lines) + b"\n") if pieces else (path, mark, here, cells, error))
            if len(out) >= 4096:
                yield _table(out, pieces)
                out = []
    if out:
        yield _table(out, pieces)


def _table(rows: list[tuple], pieces: bool) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    names = [x.rsplit(" ", 1) for x in (_PIECES if pieces else _ROWS).split(", ")]
    return pa.RecordBatch.from_pydict({n: pa.array(c, kinds[k]) for c, (n, k) in zip(zip(*rows, strict=True), names, strict=True)})


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that have been put together."""
    csv.field_size_limit(sys.maxsize)
    for batch in batches:
        out = []
        for path, mark, number, utf8, no_feed, text in zip(*(batch.column(c).to_pylist() for c in ("path", "delimiter", "row_no", "utf8", "no_feed", "text")), strict=True):
            said = _decoder(utf8)(text)
            feed = io.StringIO(said)
            try:
                cells, error = next(csv.reader(feed, delimiter=mark)), None
                if no_feed and said.count('"') and not _closed(said, mark):
                    cells[-1] = cells[-1].removesuffix("\n")
            except csv.Error as wrong:
                cells, error = None, str(wrong)
            out.append((path, mark, number, cells, error))
        if out:
            yield _table(out, False)


def _closed(text: str, mark: str) -> bool:
    """Whether a record ends outside quotes: then one more line is another record."""
    return next(csv.reader(io.StringIO(text + "x\n"), delimiter=mark)) == next(csv.reader(io.StringIO(text), delimiter=mark))


def split_rows(spark: SparkSession, path: str | list[str], delimiter: str | None = None) -> DataFrame:
    """``source``, ``delimiter``, ``row_no`` (from 0), ``cells``, ``error`` of delimited files, each in its own dialect unless ``delimiter`` is given.

    The rows are those of the standard csv reader over the whole text: line feeds and
    doubled quotes within quotes, quotes within unquoted cells, CR LF, blank rows at a
    file's end left out, cells of any length; UTF-8, or Windows-1252 if any byte of the
    file isn't UTF-8. A file is read by as many tasks as Spark cuts it into ranges
    (``spark.sql.files.maxPartitionBytes``). A lone carriage return outside quotes gives
    a row with ``error``; so does a file in UTF-16, for which see ``files.raw_rows``.
    Either pass has to meet the same ranges; rows of others are an error, not left out.
    """
    lines = _lines(spark, path)
    dialects = cut(_dialects(lines, delimiter).drop("head"))
    held = cut(ranges(lines, dialects))
    told = held.drop("goes_on")
    bytes_ = lines.select("file", "range", F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("value"))
    # a broadcast if the ranges are few enough for one; else both sides are sorted, and the lines put in order again
    in_order = lambda of, rows=bytes_, how="inner": rows.join(of, ["file", "range"], how).sortWithinPartitions("file", "range", "at").drop("at")
    narrow = bytes_.join(dialects.where("delimiter is null").select("file"), "file", "left_anti")
    whole = in_order(told, narrow, "left").mapInArrow(lambda b: _parsed(b, False), _ROWS)
    pieces = in_order(held.where("inside or goes_on").drop("goes_on")).mapInArrow(lambda b: _parsed(b, True), _PIECES)
    text = F.aggregate(F.array_sort(F.collect_list(F.struct("range", "text"))), F.lit(b""), lambda out, x: F.concat(out, x["text"]))
    joined = pieces.groupBy("file", "row_no", "path", "delimiter", "utf8", "no_feed").agg(text.alias("text")).mapInArrow(_whole, _ROWS)
    wide = dialects.where("delimiter is null").select("path", F.lit(None).cast("string").alias("delimiter"), F.lit(0).cast("long").alias("row_no"), F.lit(None).cast("array<string>").alias("cells"), F.lit("UTF-16 isn't read in ranges").alias("error"))
    return whole.unionByName(joined).unionByName(wide).select(F.element_at(F.split("path", "/"), -1).alias("source"), "delimiter", "row_no", "cells", "error")


def table(spark: SparkSession, path: str | list[str], delimiter: str | None = None) -> DataFrame:
    """Delimited files with one header as text columns: blank rows and files' headers left out, empty cells null.

    The header is that of the first file by path. A name that is there twice, whatever its
    case, gets its column's number behind it; an empty one is ``_c`` and the number.
    """
    first = _dialects(_lines(spark, path), delimiter).where("delimiter is not null").orderBy("path").select("head", "delimiter").first()
    if first is None:
        return spark.createDataFrame([], "_c0 string").limit(0)
    try:
        text = bytes(first["head"]).decode("utf-8")
    except UnicodeDecodeError:
        text = bytes(first["head"]).decode("cp1252", "replace")
    header = next(csv.reader(io.StringIO(text), delimiter=first["delimiter"]), [])
    often = [h.lower() for h in header]
    names = [f"_c{k}" if not h else f"{h}{k}" if often.count(h.lower()) > 1 else h for k, h in enumerate(header)]
    rows = split_rows(spark, path, delimiter).where((F.col("row_no") > 0) & (F.size("cells") > 0))
    return rows.select(*(F.nullif(F.get("cells", F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(names)))
