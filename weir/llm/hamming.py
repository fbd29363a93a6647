"""Exact top-k search over binary codes by incremental multi-index hashing (operator 5).

A 64-bit code is cut into four segments of 16 bits, each with an index from value
to rows. A query probes the values at distance 0, then 1, ... from its own segment
values, one segment after the other, and verifies what it meets by the full
Hamming distance. With radius r done in segments 0..s and r - 1 in the others,
every code within 4 r + s has been met (else each segment would differ by more
than its radius); a query ends when its kth verified distance is that small.

Rows are dealt by id into shards of bounded size. A task reads a shard's rows, builds
its index once, and then streams the queries past it, a batch at a time: each query
goes to every shard, no row goes to more than one. A shard returns k rows a query,
which are then merged. That is a stated query set against all rows, in blocks.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

SEGMENTS, BITS = 4, 16


def sign_code(embedding: Column | str, bits: int = 64) -> Column:
    """Bit i is whether number i is above 0. Null for null and for another length; a null number gives 0."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    at = F.transform(e, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(e) == bits, F.aggregate(at, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.coalesce(x, F.lit(0).cast("long")))))


@functools.cache
def masks() -> tuple[np.ndarray, list[np.ndarray]]:
    """(how many bits each 16-bit number has, the numbers with 0, 1, ... 16 bits)."""
    count = np.bitwise_count(np.arange(1 << BITS, dtype=np.uint32)).astype(np.uint8)
    order = np.argsort(count, kind="stable")
    return count, np.split(order, np.cumsum(np.bincount(count))[:-1])


class Index:
    def __init__(self, codes: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.codes, self.ids = codes[order], ids[order]
        # the number of the last query that met the row
        self.met, self.queries = np.zeros(len(codes), np.int64), 0
        self.rows, self.starts, self.values = [], [], []
        for s in range(SEGMENTS):
            part = self.segment(self.codes, s)
            self.rows.append(np.argsort(part, kind="stable"))
            counts = np.bincount(part, minlength=1 << BITS)
            self.starts.append(np.concatenate([[0], np.cumsum(counts)]))
            self.values.append(np.flatnonzero(counts))

    @staticmethod
    def segment(codes, s: int):
        return ((codes >> np.uint64(BITS * s)) & np.uint64((1 << BITS) - 1)).astype(np.int64)

    def probe(self, s: int, value: int, radius: int) -> np.ndarray:
        """Rows whose segment lies at ``radius`` from ``value``: by the shorter of the values there are and the values there could be."""
        count, by_count = masks()
        there = self.values[s]
        values = value ^ by_count[radius] if len(by_count[radius]) < len(there) else there[count[there ^ value] == radius]
        starts = self.starts[s]
        low, size = starts[values], starts[values + 1] - starts[values]
        low, size = low[size > 0], size[size > 0]
        if not len(low):
            return low
        ends = np.cumsum(size)
        return self.rows[s][np.arange(ends[-1]) + np.repeat(low - (ends - size), size)]

    def nearest(self, code: np.uint64, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest, ties to the smaller id."""
        k = min(k, len(self.codes))
        self.queries += 1
        met, away = np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = [int(self.segment(code, s)) for s in range(SEGMENTS)]
        for radius in range(BITS + 1):
            for s in range(SEGMENTS):
                rows = self.probe(s, own[s], radius)
                rows = rows[self.met[rows] != self.queries]
                if len(rows):
                    self.met[rows] = self.queries
                    met = np.concatenate([met, rows])
                    away = np.concatenate([away, np.bitwise_count(self.codes[rows] ^ code).astype(np.int64)])
                if len(met) >= k and np.partition(away, k - 1)[k - 1] <= SEGMENTS * radius + s:
                    best = np.lexsort((met, away))[:k]
                    return self.ids[met[best]], away[best]
        raise AssertionError("every row is met at the last radius")


OUT = "query_id long, id long, distance long"


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come shard by shard, each shard's own rows before the queries."""
    shard, index = None, None
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "query")])
        ids, codes = (batch.column(c).to_numpy() for c in ("id", "code"))
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if x == y:
                continue
            if key[0, x] != shard:
                shard, index, held = key[0, x], None, []
            if not key[1, x]:
                held.append((codes[x:y].view(np.uint64), ids[x:y]))
                continue
            if index is None and held:
                index, held = Index(*(np.concatenate(c) for c in zip(*held, strict=True))), []
            if index is not None:
                for query, code in zip(ids[x:y].tolist(), codes[x:y].view(np.uint64), strict=True):
                    found, away = index.nearest(code, k)
                    out.append((np.full(len(found), query), found, away))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "id", "distance"])


def top_k(queries: DataFrame, rows: DataFrame, k: int, *, shard_rows: int = 1 << 18) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id``, ``distance``: the k nearest rows of each query.

    Both have long columns ``id`` and ``code``; rows with a null in either are left
    out. Order: distance, then id. Rows that repeat an id are each found; of queries
    that share an id the one with the least code counts. Fewer than k rows: all of
    them. Other columns are ignored. ``shard_rows``: how many rows a shard holds at most,
    about; few rows are dealt to as many shards as there are shuffle partitions.
    """
    rows = rows.select(F.col("id").cast("long"), F.col("code").cast("long")).where("id is not null and code is not null")
    queries = queries.select(F.col("id").cast("long"), F.col("code").cast("long")).where("id is not null and code is not null").groupBy("id").agg(F.min("code").alias("code"))
    n = rows.count()
    shards = max(1, math.ceil(n / shard_rows), min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 16_384))
    both = rows.select(F.pmod(F.xxhash64("id", "code"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("query"), "id", "code")
    both = both.unionByName(queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("query"), "id", "code"))
    found = both.repartition(shards, "shard").sortWithinPartitions("shard", "query", "id").mapInArrow(functools.partial(_searched, k=k), OUT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = shared.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code"))
    return top_k(codes.where("id % 100 = 0"), codes, 10).withColumnRenamed("id", "vec_id").withColumn("rank", F.col("rank").cast("long"))


OP5_SQL = """
WITH c AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64),
b AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM c),
d AS (SELECT q.vec_id AS query_id, r.vec_id AS vec_id,
        CAST(list_sum(list_transform(list_zip(q.bits, r.bits), lambda p: CASE WHEN p[1] = p[2] THEN 0 ELSE 1 END)) AS BIGINT) AS distance
      FROM (SELECT * FROM b WHERE vec_id % 100 = 0) q CROSS JOIN b r),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM n WHERE rank <= 10"""
