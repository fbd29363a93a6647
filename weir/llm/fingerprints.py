"""Document fingerprints by consistent weighted sampling (operator 4).

A document's terms are its words, weighted by how often they occur. For each of
``samples`` hash functions and each term, r and c are gamma(2, 1) and beta uniform,
all drawn from the term's hash: t = floor(ln w / r + beta), and the sample is the
(term, t) with the least ln a = ln c - r * (t - beta + 1). Two documents share a
sample with the probability of their generalised Jaccard similarity, the sum of
the smaller weights over the sum of the larger ones.

The gamma quantiles are looked up in tables. Within a slice of rows a (term,
weight) pair is sampled once, however many documents hold it. To hold a document
against the next one, rows are dealt into buckets of neighbouring ids, as many as
their bytes ask for; the first row of each bucket also goes to the bucket before. One
shuffle of the texts and one of the ids; what the driver holds is one number for each
``BUCKET_BYTES`` of text, 25 MB for 100 TB. A task streams its bucket in slices.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .shared import U64

SAMPLES = 64
#: Text that a bucket holds about.
BUCKET_BYTES = 1 << 25


@functools.cache
def gamma_table(bits: int) -> np.ndarray:
    """Quantiles of gamma(2, 1), whose distribution function is 1 - exp(-x) * (1 + x)."""
    u = (np.arange(1 << bits) + 0.5) / (1 << bits)
    low, high = np.zeros(len(u)), np.full(len(u), 64.0)
    for _ in range(60):
        mid = (low + high) / 2
        less = -np.expm1(-mid) - mid * np.exp(-mid) < u
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return (low + high) / 2


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    return gamma_table(16).astype(np.float32), np.log(gamma_table(20)).astype(np.float32)


def weighted(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct word of each text, how often, where each text's start)."""
    data, at = shared.flat(column)
    start, end, owner = shared.word_spans(data, at)
    words = shared.word_hashes(data, start, end)
    n = len(column)
    ends = np.searchsorted(owner, np.arange(n + 1))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        words[a:b].sort()
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return words[first], np.diff(np.append(first, len(words))), np.concatenate([[0], np.cumsum(new)])[ends]


def signatures(columns: list[pa.Array], samples: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each column a row of 16-bit samples a text, and which texts have no words."""
    held = [weighted(c) for c in columns]
    terms, counts = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    keys = shared.mix(terms + shared.mix(counts.astype(U64)))
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    term, log_w = terms[first], np.log(counts[first]).astype(np.float32)
    out = [np.zeros((len(c), samples), np.uint16) for c in columns]
    places, base = [], 0
    for _, count, at in held:
        full = np.flatnonzero(at[:-1] < at[1:])
        places.append((full, at[full], inverse[base : base + len(count)]))
        base += len(count)
    quantile, log_quantile = tables()
    for k in range(samples):
        h = shared.mix(term + U64((k + 1) * 0x9E3779B97F4A7C15 & shared._MASK))
        r = quantile[(h & U64(0xFFFF)).astype(np.int32)]
        beta = ((h >> U64(16)) & U64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(log_w / r + beta)
        log_a = log_quantile[(h >> U64(44)).astype(np.int32)] - r * (t - beta + np.float32(1))
        # floats as numbers in the same order, with the sample in the low half: the least holds its sample
        bits = log_a.view(np.uint32)
        order = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000)).astype(U64)
        sample = shared.mix(term ^ (t.astype(np.int64).view(U64) * U64(0xD6E8FEB86659FD93))) >> U64(33)
        both = (order << U64(32)) | sample
        for (full, at, own), target in zip(places, out, strict=True):
            if len(full):
                target[full, k] = (np.minimum.reduceat(both[own], at) & U64(0xFFFF)).astype(np.uint16)
    return [(x, at[:-1] == at[1:]) for x, (_, _, at) in zip(out, held, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, empty_a: np.ndarray, empty_b: np.ndarray) -> np.ndarray:
    """The share of equal samples; 1 for two texts without words, 0 if one has none."""
    return np.where(empty_a | empty_b, (empty_a & empty_b).astype(float), (a == b).mean(axis=1))


def edited(text: str, following: str) -> str:
    """The last floor(n/2) characters replaced by the first as many of the next text."""
    cut = len(text) // 2
    return text[: len(text) - cut] + following[:cut]


def _said(row: np.ndarray, empty: bool) -> str:
    return "" if empty else row.astype(">u2").tobytes().hex()


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _printed(batches: Iterator[pa.RecordBatch], samples: int) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket in the order of ids; one with ``guest`` only ends its bucket. Lone rows (bucket < 0) follow themselves."""
    held: tuple[int, int | None, str, bool] | None = None
    rows: list[tuple[int, int | None, str, bool]] = []

    def done() -> pa.RecordBatch | None:
        """All rows but those whose next row may come."""
        own = [k for k, row in enumerate(rows) if not row[3]]
        pairs = [(k, k if rows[k][0] < 0 or k + 1 == len(rows) or rows[k + 1][0] != rows[k][0] else k + 1) for k in own]
        texts = [row[2] for row in rows]
        changed = [edited(texts[k], texts[n]) for k, n in pairs]
        if not own:
            return None
        (plain, none), (new, none_new) = signatures([pa.array(texts, pa.large_string()), pa.array(changed, pa.large_string())], samples)
        i, n = np.array([k for k, _ in pairs]), np.array([n for _, n in pairs])
        return pa.RecordBatch.from_arrays([
            pa.array([rows[k][1] for k in own], pa.int64()), pa.array([len(texts[k]) for k in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in changed]),
            pa.array([_said(plain[k], none[k]) for k in own]), pa.array([_said(new[j], none_new[j]) for j in range(len(own))]),
            pa.array(likeness(plain[i], new, none[i], none_new)), pa.array(likeness(plain[i], plain[n], none[i], none[n])),
        ], [f.split()[0] for f in OUT.split(", ")])

    for part in shared.sliced(batches, "text"):
        new = list(zip(part.column("bucket").to_pylist(), part.column("doc_id").to_pylist(), shared.strings(part.column("text")).to_pylist(), part.column("guest").to_pylist(), strict=True))
        rows = ([held] if held else []) + new
        held = None
        if not rows[-1][3]:
            # of the last row the next one is unknown: it waits, and stands here as a guest
            held = rows[-1]
            rows[-1] = (*held[:3], True)
        if out := done():
            yield out
    if held:
        rows = [held]
        if out := done():
            yield out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, buckets: int | None = None) -> DataFrame:
    """A row for each row of ``docs``: its fingerprint, that of its edited text, and how alike they are.

    ``n_chars`` counts code points. The edited text ends in the beginning of the
    next document's text, by ascending id; after the last comes the first, and a
    document alone follows itself. ``near_edited`` and ``near_next`` are the shares
    of equal samples with the edited text and the next document. Null text counts
    as empty; a text without words has the fingerprint '' and is like only such
    texts. Of rows with equal ids the order is by text. A null id has no place in the
    order: such a row follows itself. Other columns are ignored.
    """
    spark = docs.sparkSession
    plain = shared.texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    ids = plain.where("doc_id is not null").select("doc_id")
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = buckets or max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    dealt_ids = ids.repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id().alias("b")).agg(F.min("doc_id").alias("m"))
    # where each bucket begins; the first id of a bucket also goes to the bucket before it, the first of all to the last
    firsts = np.unique(np.array([r["m"] for r in dealt_ids.collect()], np.int64))

    @F.pandas_udf("array<int>")
    def targets(x: pd.Series) -> pd.Series:
        values = x.to_numpy()
        own = np.searchsorted(firsts, values, side="right") - 1
        guest = (firsts[own] == values).tolist() if len(firsts) else []
        return pd.Series([[b, (b or len(firsts)) - 1] if g else [b] for b, g in zip(own.tolist(), guest, strict=True)])

    known = F.coalesce("doc_id", F.lit(int(firsts[0]) if len(firsts) else 0))
    lone = F.array((-1 - F.pmod(F.xxhash64("text"), F.lit(n))).cast("int"))
    dealt = plain.select("doc_id", "text", F.posexplode(F.when(F.col("doc_id").isNull(), lone).otherwise(targets(known))).alias("guest", "bucket"))
    dealt = dealt.select("doc_id", "text", (F.col("guest") > 0).alias("guest"), "bucket")
    dealt = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "guest", "doc_id", "text")
    return dealt.mapInArrow(functools.partial(_printed, samples=samples), OUT)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(shared.table(spark, sf_dir, "documents"))
