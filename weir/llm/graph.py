"""Nearest vectors by inner product through robust-pruned directed graphs (operator 13).

Rows are dealt by hash into shards of bounded size. A task reads a shard's rows, builds
its graphs once and streams the queries past them: each query goes to every shard, no
row goes to more than one, and a shard returns k rows a query, which are merged.

A graph is built by inserting rows in batches, each half of what is there at most. A
greedy search over what is there proposes neighbours for a row; of these the nearest is
kept again and again, and those go that lie closer to a kept one, by a relaxed factor,
than to the row; rows get links back, and lists that grow too long are pruned the same
way. All searches of a batch take their steps together, so that a step is a few numpy
calls. A query is a search with a wider beam, whose rows are then scored in double
precision.

The largest inner product is the least distance once every vector of a graph has been
given one more coordinate that makes all equally long. So that no long vector makes all
others look alike, lengths from one power of two to the next have a graph of their own;
so have vectors of another dimension. Equal vectors of a shard are one node. Few nodes
are scanned instead.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Links a node keeps when its list is pruned; links it may have before.
DEGREE, ROOM = 32, 48
#: Rows that a search for neighbours, or for a query, keeps in sight; of these it looks at so many at a step.
BUILD_BEAM, QUERY_BEAM, WIDTH = 64, 160, 4
#: A link goes if a kept one is closer to its end by this factor (in squared distances).
RELAXED = 1.2**2
#: A graph with fewer nodes is scanned.
LEAST_NODES = 512
#: Cells of the table of what a batch of searches has met.
_CELLS = 1 << 23


class Graph:
    def __init__(self, vectors: np.ndarray, seed: int = 1):
        """``vectors``: double, distinct, without zeros, with lengths within a factor of two or so."""
        scale = np.abs(vectors).max()
        near = vectors / scale
        square = (near**2).sum(axis=1)
        self.size, self.far = len(vectors), square.max()
        more = np.sqrt(np.maximum(self.far - square, 0))
        self.points = np.concatenate([near, more[:, None]], axis=1)
        self.links = np.full((self.size, ROOM), -1, np.int32)
        self.degree = np.zeros(self.size, np.int64)
        order = np.random.default_rng(seed).permutation(self.size).astype(np.int32)
        middle = int(np.argmax(self.points @ self.points.mean(axis=0)))
        order = np.concatenate([[middle], order[order != middle]]).astype(np.int32)
        self.entry, done = middle, 1
        while done < self.size:
            new = order[done : done + max(1, min(done // 2, 1024, _CELLS // self.size))]
            self._insert(new)
            done += len(new)
        self._reach()

    def _away(self, closeness: np.ndarray) -> np.ndarray:
        """Squared distance of two points with this inner product."""
        return np.maximum(2 * self.far - 2 * closeness, 0)

    def search(self, wanted: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, inner products) in sight at the end of each search, best first; -1 where there are fewer."""
        n = len(wanted)
        met = np.zeros((n, self.size), bool)
        turn = np.zeros((n, self.size + 1), np.int16)  # the last column is for links there are not
        met[:, self.entry] = True
        nodes = np.full((n, beam), -1, np.int32)
        close = np.full((n, beam), -np.inf)
        nodes[:, 0], close[:, 0] = self.entry, wanted @ self.points[self.entry]
        seen = nodes < 0
        going = np.arange(n)
        while len(going):
            # the best ones that no step has looked at yet
            best = np.argsort(seen[going], axis=1, kind="stable")[:, :WIDTH]
            fresh = ~seen[going[:, None], best]
            some = fresh[:, 0]
            going, best, fresh = going[some], best[some], fresh[some]
            if not len(going):
                break
            seen[going[:, None], best] = True
            at = np.where(fresh, nodes[going[:, None], best], self.entry)
            ahead = self.links[at].reshape(len(going), -1)
            who = going[:, None]
            new = (ahead >= 0) & ~met[who, ahead]
            place = np.broadcast_to(np.arange(ahead.shape[1], dtype=np.int16), ahead.shape)
            turn[who, ahead] = place
            new &= turn[who, ahead] == place  # one of those that a step meets twice
            most = int(new.sum(axis=1).max(initial=0))
            if not most:
                continue
            first = np.argsort(~new, axis=1, kind="stable")[:, :most]
            ahead, new = np.take_along_axis(ahead, first, 1), np.take_along_axis(new, first, 1)
            met[np.broadcast_to(who, new.shape)[new], ahead[new]] = True
            score = np.matmul(self.points[ahead], wanted[going][:, :, None])[:, :, 0]
            score[~new] = -np.inf
            every = np.concatenate([close[going], score], axis=1)
            keep = np.argsort(-every, axis=1, kind="stable")[:, :beam]
            close[going] = np.take_along_axis(every, keep, 1)
            nodes[going] = np.take_along_axis(np.concatenate([nodes[going], np.where(new, ahead, -1)], axis=1), keep, 1)
            seen[going] = np.take_along_axis(np.concatenate([seen[going], ~new], axis=1), keep, 1)
        return nodes, close

    def _pruned(self, of: np.ndarray, ends: np.ndarray, close: np.ndarray) -> np.ndarray:
        """Which of the candidates (best first, -1: none) stay as links: their nodes, -1 behind them."""
        there = self.points[ends]
        between = self._away(np.matmul(there, there.transpose(0, 2, 1)))
        own = self._away(close)
        alive = (ends >= 0) & (ends != of[:, None])
        out = np.full((len(of), DEGREE), -1, np.int32)
        rows = np.arange(len(of))
        for k in range(DEGREE):
            pick = alive.argmax(axis=1)
            has = alive[rows, pick]
            if not has.any():
                break
            out[has, k] = ends[rows, pick][has]
            alive[rows, pick] = False
            alive &= ~((RELAXED * between[rows, pick] <= own) & has[:, None])
        return out

    def _insert(self, new: np.ndarray) -> None:
        nodes, close = self.search(self.points[new], BUILD_BEAM)
        kept = self._pruned(new, nodes, close)
        self.links[new, :DEGREE] = kept
        self.degree[new] = (kept >= 0).sum(axis=1)
        back, to = kept[kept >= 0], np.repeat(new, self.degree[new])
        self._link(back, to)

    def _link(self, of: np.ndarray, to: np.ndarray) -> None:
        """Adds links, and prunes the lists that have no room for them."""
        order = np.argsort(of, kind="stable")
        of, to = of[order], to[order]
        node, first, count = np.unique(of, return_index=True, return_counts=True)
        place = self.degree[of] + np.arange(len(of)) - np.repeat(first, count)
        full = self.degree[node] + count > ROOM
        fits = ~np.repeat(full, count)
        self.links[of[fits], place[fits]] = to[fits]
        self.degree[node[~full]] += count[~full]
        for at in range(0, int(full.sum()), 256):
            here = np.flatnonzero(full)[at : at + 256]
            most = int(count[here].max())
            ends = np.full((len(here), ROOM + most), -1, np.int32)
            ends[:, :ROOM] = self.links[node[here]]
            for row, k in enumerate(here):
                ends[row, ROOM : ROOM + count[k]] = to[first[k] : first[k] + count[k]]
            close = np.matmul(self.points[ends], self.points[node[here]][:, :, None])[:, :, 0]
            close[ends < 0] = -np.inf
            best = np.argsort(-close, axis=1, kind="stable")[:, : ROOM * 2]
            kept = self._pruned(node[here], np.take_along_axis(ends, best, 1), np.take_along_axis(close, best, 1))
            self.links[node[here]] = -1
            self.links[node[here], :DEGREE] = kept
            self.degree[node[here]] = (kept >= 0).sum(axis=1)

    def _reach(self) -> None:
        """Every node is to be found from the entry: one that isn't gets a link from the nearest that is."""
        reached = np.zeros(self.size, bool)
        front = np.array([self.entry])
        while True:
            while len(front):
                reached[front] = True
                ahead = np.unique(self.links[front])
                front = ahead[(ahead >= 0)]
                front = front[~reached[front]]
            lost = np.flatnonzero(~reached)
            if not len(lost):
                return
            node = lost[:1]
            nodes, _ = self.search(self.points[node], BUILD_BEAM)
            free = nodes[0][(nodes[0] >= 0)]
            free = free[self.degree[free] < ROOM]
            if not len(free):  # no room among those near: the last link of the nearest one makes way
                free = nodes[0][:1]
                self.degree[free] -= 1
            self.links[free[0], self.degree[free[0]]] = node[0]
            self.degree[free[0]] += 1
            front = node


class Nodes:
    """A shard's vectors of one dimension and about one length, equal ones as one node."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, k: int):
        _, first, node = np.unique(vectors.view(f"V{vectors.itemsize * vectors.shape[1]}").ravel(), return_index=True, return_inverse=True)
        self.vectors, order = vectors[first], np.lexsort((ids, node.ravel()))
        counts = np.bincount(node.ravel())
        starts = np.cumsum(counts) - counts
        self.ids, self.starts, self.counts = ids[order], starts, np.minimum(counts, k + 1)
        self.graph = Graph(self.vectors) if len(first) >= LEAST_NODES else None

    def near(self, wanted: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's number, id, inner product) of the k + 1 best rows, or more where nodes have several."""
        if self.graph is None:
            nodes = np.broadcast_to(np.arange(len(self.vectors)), (len(wanted), len(self.vectors)))
        else:
            way = wanted / np.abs(wanted).max(axis=1, keepdims=True)
            nodes, _ = self.graph.search(np.concatenate([way, np.zeros((len(way), 1))], axis=1), max(beam, 2 * k))
        score = np.where(nodes >= 0, (self.vectors[nodes] * wanted[:, None, :]).sum(axis=2), -np.inf)
        best = np.lexsort((self.ids[self.starts[nodes]], -score), axis=1)[:, : k + 1]
        nodes, score = np.take_along_axis(nodes, best, 1), np.take_along_axis(score, best, 1)
        there = nodes >= 0
        who, nodes, score = np.nonzero(there)[0], nodes[there], score[there]
        n = self.counts[nodes]
        ends = np.cumsum(n)
        row = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(self.starts[nodes], n)
        return np.repeat(who, n), self.ids[row], np.repeat(score, n)


class Index:
    def __init__(self, ids: np.ndarray, values: np.ndarray, sizes: np.ndarray, k: int):
        self.k, self.of = k, {}
        for size, rows, vectors in _by_size(values, sizes):
            length = _lengths(vectors)
            for band in np.unique(length):
                here = length == band
                self.of.setdefault(size, []).append(Nodes(vectors[here], ids[rows[here]], k))

    def nearest(self, ids: np.ndarray, values: np.ndarray, sizes: np.ndarray, beam: int, at_once: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query's id, id, inner product) of the k nearest rows with another id."""
        for size, rows, vectors in _by_size(values, sizes):
            for at in range(0, len(rows) if size in self.of else 0, at_once):
                own = ids[rows[at : at + at_once]]
                who, found, score = (np.concatenate(x) for x in zip(*(nodes.near(vectors[at : at + at_once], self.k, beam) for nodes in self.of[size]), strict=True))
                other = found != own[who]
                who, found, score = who[other], found[other], score[other]
                order = np.lexsort((found, -score, who))
                who, found, score = who[order], found[order], score[order]
                keep = np.arange(len(who)) - np.searchsorted(who, who) < self.k
                yield own[who[keep]], found[keep], score[keep]


def _by_size(values: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, which vectors have it, these vectors) of vectors that stand end to end."""
    ends = np.cumsum(sizes)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        # 0.0 and -0.0 are one number
        yield int(size), rows, np.ascontiguousarray(values[(ends[rows] - size)[:, None] + np.arange(size)]) + 0.0


def _lengths(vectors: np.ndarray) -> np.ndarray:
    """The power of two below each vector's length."""
    top = np.abs(vectors).max(axis=1)
    return np.floor(np.log2(top) + np.log2(((vectors / top[:, None]) ** 2).sum(axis=1)) / 2)


OUT = "query_id long, vec_id long, score double"


def _searched(batches: Iterator[pa.RecordBatch], k: int, beam: int) -> Iterator[pa.RecordBatch]:
    """Rows come shard by shard, each shard's own rows before the queries."""
    shard, index = None, None
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "query")])
        ids, lists = batch.column("id").to_numpy(), batch.column("vector")
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if x == y:
                continue
            part = ids[x:y], values[offsets[x] : offsets[y]], np.diff(offsets[x : y + 1])
            if key[0, x] != shard:
                shard, index, held = key[0, x], None, []
            if not key[1, x]:
                held.append(part)
                continue
            if index is None and held:
                index, held = Index(*(np.concatenate(c) for c in zip(*held, strict=True)), k), []
            if index is not None:
                out += index.nearest(*part, beam)
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])


def usable(rows: DataFrame, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """``id``, ``vector`` of rows with an id and a vector of numbers that isn't null, empty or all zeros and holds no null, NaN or infinity."""
    vector = F.col(vector_col)
    if rows.schema[vector_col].dataType.simpleString() != "array<float>":
        vector = vector.cast("array<double>")
    out = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return out.where(F.col("id").isNotNull() & F.coalesce(F.forall("vector", lambda x: F.coalesce(number(x), F.lit(False))) & F.exists("vector", lambda x: x != 0), F.lit(False)))


def nearest(queries: DataFrame, rows: DataFrame, k: int, *, shard_rows: int = 1 << 15, beam: int = QUERY_BEAM) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: about the k rows with the largest inner product, ties to the smaller id.

    Both have ``id`` and ``vector``; see ``usable`` for what takes part. Only vectors of
    one dimension are compared. A query doesn't find rows with its own id; of queries that
    share an id the one with the least vector counts. Rows that repeat an id are each
    found. Fewer than k rows: all of them. Other columns are ignored. ``score`` is worked
    out in double precision from the vectors as they are. ``shard_rows``: how many rows a
    shard holds at most, about; ``beam``: how many rows a query keeps in sight there.
    """
    rows, queries = usable(rows), usable(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    n = rows.count()
    shards = max(1, math.ceil(n / shard_rows), min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 16_384))
    both = rows.select(F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("query"), "id", "vector")
    both = both.unionByName(queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("query"), "id", "vector"))
    found = both.repartition(shards, "shard").sortWithinPartitions("shard", "query", "id").mapInArrow(functools.partial(_searched, k=k, beam=beam), OUT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row for each vec_id divisible by 20 over whole ``embeddings``."""
    rows = shared.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(rows.where("id % 20 = 0"), rows, 20)
