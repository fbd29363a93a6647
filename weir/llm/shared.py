"""What several operators need: tables, lineage cuts, components, Arrow text."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that is worked on at a time in a Python task; a longer text is worked on alone.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local one only for a local session where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weir-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Kept:
    """A DataFrame written once to the shared folder and read again: its lineage is the table.

    A lost executor then costs a re-read, not the iterations before. A table that a
    result still reads stays until ``clear`` or the driver's end; the others are dropped
    by the operator that made them.
    """

    live: list[Kept] = []

    def __init__(self, df: DataFrame, what: str):
        spark = df.sparkSession
        if not Kept.live:
            atexit.register(clear)
        self.path = f"{shared_dir(spark)}/weir-{what}-{uuid.uuid4().hex}"
        schema = df.schema
        Kept.live.append(self)
        df.write.parquet(self.path)
        self.df = spark.read.schema(schema).parquet(self.path)
        self.spark = spark

    def drop(self) -> None:
        if self in Kept.live:
            Kept.live.remove(self)
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame, what: str) -> DataFrame:
    return Kept(df, what).df


def settled(make: Callable[[], DataFrame], what: str) -> Kept:
    """``make()`` kept; the tables that were kept on the way to it are dropped."""
    before = len(Kept.live)
    out = Kept(make(), what)
    for table_ in Kept.live[before:]:
        if table_ is not out:
            table_.drop()
    return out


def clear() -> None:
    """Drops every table that is still kept: for when results have been read, and at the driver's end."""
    for table_ in list(Kept.live):
        try:
            table_.drop()
        except Exception:  # noqa: BLE001  the session has ended: the folder goes with it, or by its owner's rule
            Kept.live.remove(table_) if table_ in Kept.live else None


#: A key is heavy if it holds more than this share of all rows; so there are at most as many heavy keys.
HEAVY = 4096


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, by: list[str]) -> DataFrame:
    """``rows`` joined to ``groups`` (one row a key, with ``n``: how many rows have it) on ``keys``; ``n`` is dropped.

    A heavy key's rows are dealt out by the hash of the columns ``by`` and meet copies of its group:
    no task gets more than about ``total / HEAVY`` rows of one key. Only heavy keys are broadcast, of
    which arithmetic allows ``HEAVY``.
    """
    least = max(1, total // HEAVY)
    heavy = groups.where(F.col("n") > least).select(*keys, F.ceil(F.col("n") / least).cast("int").alias("_parts"))
    salt = F.pmod(F.xxhash64(*by), F.coalesce("_parts", F.lit(1))).cast("int")
    left = rows.join(F.broadcast(heavy), keys, "left").withColumn("_salt", salt).drop("_parts")
    right = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > least, F.ceil(F.col("n") / least).cast("int") - 1).otherwise(0)))).drop("n")
    return left.join(right.hint("merge"), [*keys, "_salt"]).drop("_salt")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star.

    ``edges``: long columns ``a``, ``b``; loops, repeats and either direction are
    allowed, null ends are dropped. Returns ``node``, ``component`` (the smallest
    node reachable) for every node that has an edge to another. Every round is a
    groupBy-min with partial aggregation and a join in which a hub's links are dealt
    over many tasks (``spread_join``); no adjacency list is collected. Rounds go on
    until the links no longer change.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = Kept(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "links")
    size, mark = now.df.count(), None
    for _ in range(max_rounds):
        both = now.df.unionByName(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.sum((F.col("b") > F.col("a")).cast("long")).alias("n")).where("n > 0").select("a", F.least("a", "m").alias("m"), "n")
        large = spread_join(both.where("b > a"), least, ["a"], size, ["b"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        large = Kept(large, "large")
        least = large.df.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = spread_join(large.df, least, ["a"], large.df.count(), ["b"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        then = Kept(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        large.drop()
        now.drop()
        now = then
        said = now.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if said == mark:
            break
        size, mark = said[0], said
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = now.df.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(now.df.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def strings(column: pa.Array) -> pa.Array:
    """As a plain string array without nulls: null counts as empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column.cast(pa.large_string()), "")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all UTF-8 bytes, where each text starts and the last ends)."""
    column = strings(column)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8) if at else np.zeros(1, np.int64)
    if not data:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def sliced(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``most`` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = ends[start] - sizes[start]
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def by_slices(work: Callable[[pa.RecordBatch], pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Callable:
    """A ``mapInArrow`` function from one that turns a slice of rows into rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, text, most):
            yield work(part)

    return run


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, as ``doc_id`` long and ``text`` string."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def repeated(docs: DataFrame, id_col: str) -> bool:
    """Whether rows share an id that isn't null."""
    ids = docs.select(docs[id_col].cast("long").alias("doc_id")).where("doc_id is not null")
    return not ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` written once, with ``_weir_row``: a number for each row that rises with id and text's hash; null for a null id."""
    sort = {"_weir_a": docs[id_col].cast("long"), "_weir_b": F.xxhash64(docs[text_col].cast("string")), "_weir_c": F.monotonically_increasing_id()}
    out = docs.withColumns(sort).orderBy(*sort).withColumn("_weir_row", F.monotonically_increasing_id())
    return keep(out.withColumn("_weir_row", F.when(F.col("_weir_a").isNotNull(), F.col("_weir_row"))).drop(*sort), "rows")


U64 = np.uint64
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """64-bit hashes of spans of an array of numbers below 2**21.

    The hash is the sum of a mixed number for each (place in the span, value): no
    polynomial, so that no pattern of values makes differences cancel out. The work
    grows with the spans' lengths: for spans that hardly overlap.
    """
    size = end - start
    out = np.zeros(len(size), U64)
    full = np.flatnonzero(size > 0)
    if len(full):
        n = size[full]
        ends = np.cumsum(n)
        heads = ends - n
        every = np.arange(ends[-1])
        place = every - np.repeat(heads, n)
        every += np.repeat(start[full] - heads, n)
        key = (place << 21).view(U64)
        key |= data[every].astype(U64)
        key *= U64(seed | 1)
        key ^= key >> U64(32)
        key *= U64(0xD6E8FEB86659FD93)
        key ^= key >> U64(29)
        out[full] = np.add.reduceat(key, heads)
    return mix(out + size.astype(U64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than 0x20 and 0x09-0x0D, never across texts: (start, end, text's number)."""
    inside = ~_SPACE[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = at[1:][at[:-1] < at[1:]] - 1
    last[tails] = inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each word with A-Z in lower case."""
    return span_hashes(_LOWER[data], start, end)


def shingles(words: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` words in a row, and whose they are; a text with fewer words has one, of them all."""
    n = len(words)
    if n >= width:
        whole = text[: n - width + 1] == text[width - 1 :]
        out = np.zeros(n - width + 1, U64)
        for k in range(width):
            out = mix(out * U64(0xD6E8FEB86659FD93) + words[k : n - width + 1 + k])
        out, owner = out[whole], text[: n - width + 1][whole]
    else:
        out, owner = np.zeros(0, U64), np.zeros(0, np.int64)
    ids, first, count = np.unique(text, return_index=True, return_counts=True)
    short = np.flatnonzero(count < width)
    if len(short):
        more = np.zeros(len(short), U64)
        for k in range(width - 1):
            has = count[short] > k
            more[has] = mix(more[has] * U64(0xD6E8FEB86659FD93) + words[first[short][has] + k])
        more = mix(more + count[short].astype(U64) * U64(0xA0761D6478BD642F))
        out, owner = np.concatenate([out, more]), np.concatenate([owner, ids[short]])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


def distinct_sets(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each owner 0..n-1, sorted, end to end; and where each owner's start."""
    ends = np.searchsorted(owner, np.arange(n + 1))
    out = values.copy()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    before = np.concatenate([[0], np.cumsum(new)])
    return out[new], before[ends]
