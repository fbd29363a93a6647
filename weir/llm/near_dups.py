"""MinHash near-dedup (operator 1).

Per text: the minima of many universal hashes ``(a*x + b) >> 32`` over its
shingle set, cut into bands. Texts that share a band are candidates. Links are
then confirmed: first by the share of equal minima (only pairs far below the
threshold go), then on the full sets. Components by large-star and small-star.

Scale: a text with an equal set counts once (its smallest id stands for the
class), so copies cost one row each. Band rows are grouped by key with partial
aggregation and linked to the smallest id of the band only, which gives a few
links a text however large a band is. The components of these raw links hold all
candidates of a text. A small component is confirmed as one unit, a larger one in
pairs of blocks; unlike texts may chain into one that has more blocks than there
are bands: there a unit is a band's bucket (any two candidates share one), so a text
is moved at most once a band. A bucket of more than a block's size is itself
confirmed in pairs of blocks. Blocks are bounded by their number of classes and by
their number of shingles, so that no task holds an unbounded group. A unit's task
searches breadth first among those not yet reached and returns a spanning forest,
never all pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .shared import U64

BANDS, ROWS = 24, 5
#: Standard errors of the estimated similarity below the threshold at which a pair isn't confirmed.
SURE = 5.5


@functools.cache
def _hashes(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 2**63, n, dtype=np.int64).astype(U64) * U64(2) + U64(1), rng.integers(0, 2**63, n, dtype=np.int64).astype(U64)


def sets_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, end to end, and where each text's start."""
    data, at = shared.flat(column)
    start, end, text = shared.word_spans(data, at)
    return shared.distinct_sets(*shared.shingles(shared.word_hashes(data, start, end), text, width), len(column))


def minima(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A row of ``n`` minima for each set that isn't empty."""
    full = np.flatnonzero(at[:-1] < at[1:])
    out = np.empty((len(full), n), np.uint32)
    if len(full):
        for k, (a, b) in enumerate(zip(*_hashes(n), strict=True)):
            out[:, k] = np.minimum.reduceat(((values * a + b) >> U64(32)).astype(np.uint32), at[full])
    return out


def _signed(part: pa.RecordBatch, width: int, bands: int, rows: int) -> pa.RecordBatch:
    values, at = sets_of(part.column("text"), width)
    n, full = np.diff(at), np.flatnonzero(at[:-1] < at[1:])
    one, two = np.zeros(part.num_rows, U64), np.zeros(part.num_rows, U64)
    keys = np.zeros((len(full), bands), U64)
    if len(full):
        one[full] = np.add.reduceat(shared.mix(values + U64(1)), at[full])
        two[full] = np.add.reduceat(shared.mix(values ^ U64(0x5DEECE66D)), at[full])
        least = minima(values, at, bands * rows).astype(U64)
        for b in range(bands):
            key = np.full(len(full), U64(b + 1))
            for r in range(rows):
                key = shared.mix(key * U64(0x9E3779B97F4A7C15) + least[:, b * rows + r])
            keys[:, b] = key
    offsets = np.zeros(part.num_rows + 1, np.int32)
    offsets[1:] = np.cumsum((n > 0) * bands)
    lists = pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64)))
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists], ["doc_id", "n_shingles", "set_a", "set_b", "keys"])


def linked(sets: list[np.ndarray], known: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets: intersection * den >= num * union.

    Breadth first: a set is compared with those that no tree holds yet. ``known``:
    the minima of each; a pair is confirmed on the full sets unless the share of equal
    minima lies ``SURE`` standard errors below the threshold.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    every, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    t = num / den
    enough = (t - SURE * (t * (1 - t) / known.shape[1]) ** 0.5) * known.shape[1]
    left, out, mask = np.ones(n, bool), [], np.zeros(len(every), bool)
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            x = queue.pop()
            rest = np.flatnonzero(left)
            rest = rest[(sizes[rest] * den >= sizes[x] * num) & (sizes[x] * den >= sizes[rest] * num)]
            if len(rest):
                rest = rest[(known[rest] == known[x]).sum(1) >= enough]
            if not len(rest):
                continue
            mask[inverse[at[x] : at[x + 1]]] = True
            same = np.array([np.count_nonzero(mask[inverse[at[y] : at[y + 1]]]) for y in rest])
            mask[inverse[at[x] : at[x + 1]]] = False
            for y in rest[den * same >= num * (sizes[x] + sizes[rest] - same)].tolist():
                left[y] = False
                queue.append(y)
                out.append((x, y))
    return out


def _confirm(batches: Iterator[pa.RecordBatch], width: int, n: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows come unit by unit; a unit may go on in the next batch."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    unit, ids, sets, known = None, [], [], []

    def done() -> pa.RecordBatch:
        links = linked(sets, np.stack(known), num, den) if len(ids) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([ids[x] for x, _ in links], pa.int64()), pa.array([ids[y] for _, y in links], pa.int64())], schema=schema)

    for part in shared.sliced(batches, "text"):
        values, at = sets_of(part.column("text"), width)
        least = minima(values, at, n)
        # a row without words, of an id that also has a text, has no minima and no links
        full = np.cumsum(at[:-1] < at[1:]) - 1
        for row, (unit_of, doc_id) in enumerate(zip(zip(*(part.column(c).to_pylist() for c in ("cluster", "i", "j")), strict=True), part.column("doc_id").to_pylist(), strict=True)):
            if at[row] == at[row + 1]:
                continue
            if unit_of != unit:
                if len(ids) > 1:
                    yield done()
                unit, ids, sets, known = unit_of, [], [], []
            ids.append(doc_id)
            sets.append(values[at[row] : at[row + 1]])
            known.append(least[full[row]])
    if len(ids) > 1:
        yield done()


#: A block holds about so many shingles at most, 32 MB of hashes.
BLOCK_SHINGLES = 1 << 22


def units(cluster: DataFrame, band: DataFrame, bands: int, block: int) -> DataFrame:
    """``doc_id``, ``cluster``, ``i``, ``j``: the units in which the classes of each cluster are confirmed; any two that share a band meet in one.

    ``cluster``: ``node``, ``component``; ``band``: ``doc_id``, ``n_shingles``, ``key``.
    """
    size = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")

    def blocked(rows: DataFrame, total: int) -> DataFrame:
        sizes = rows.groupBy("cluster").agg(size, F.count("*").alias("n"))
        met = shared.spread_join(rows, sizes, ["cluster"], total, ["doc_id"])
        return met.withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))

    mass = band.groupBy("doc_id").agg(F.min("n_shingles").alias("n_shingles"))
    node = cluster.join(mass.hint("merge"), F.col("node") == F.col("doc_id")).select("doc_id", "n_shingles", F.col("component").alias("cluster"))
    every = held = shared.keep(blocked(node, cluster.count()), "sized")
    wide = held.where(F.col("blocks") > bands).select("doc_id")
    if not wide.isEmpty():
        # a bucket's number stands in for the cluster's; of buckets with the same members one is enough
        key = shared.keep(band.join(wide.hint("merge"), "doc_id"), "wide")
        bucket = key.groupBy("key").agg(F.count("*").alias("c"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("s")).where("c > 1")
        first = bucket.groupBy("c", "s").agg(F.min("key").alias("key"), F.min("c").alias("n")).select("key", "n")
        total = key.count()
        again = shared.spread_join(key, first, ["key"], total, ["doc_id"]).select("doc_id", "n_shingles", F.col("key").alias("cluster"))
        every = held.where(F.col("blocks") <= bands).unionByName(blocked(again, total))
    paired = every.select("doc_id", "cluster", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "blocks")
    # of more than two blocks each pair of different ones is a unit: it also holds the pairs within either
    return paired.where("blocks = 1 or mine <> other").select("doc_id", "cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    similarity: tuple[int, int] = (80, 100),
    bands: int = BANDS,
    rows: int = ROWS,
    block: int = 256,
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for each row of ``docs``.

    Words are runs of characters other than space and U+0009-U+000D, with A-Z in
    lower case. A document's set holds its distinct runs of ``words`` words; with
    fewer words the whole sequence is its one member. Two documents are linked if
    intersection * similarity[1] >= similarity[0] * union. ``component_id`` is the
    smallest id that links lead to, ``kept`` whether that is the row's own.

    A pair at a similarity of 0.85 shares none of the default 24 bands of 5 minima
    with probability 8e-7, at 0.8 with 8e-5.

    Null or empty text and text without words: no set, linked with nothing, kept.
    Rows with the same id are one document to the links; each gets a row. A null id
    is linked with nothing: ``component_id`` null, kept. Other columns are ignored.
    """
    num, den = similarity
    both = shared.texts(docs, id_col, text_col)
    signed = both.mapInArrow(
        shared.by_slices(functools.partial(_signed, width=words, bands=bands, rows=rows)),
        "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>",
    )
    signed = shared.keep(signed, "signed")
    plain = signed.where("doc_id is not null and n_shingles > 0")
    classes = shared.keep(plain.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    own = plain.join(classes.select("rep").distinct(), F.col("doc_id") == F.col("rep"), "left_semi")
    band = shared.Kept(own.select("doc_id", "n_shingles", F.explode("keys").alias("key")).distinct(), "bands")
    hubs = band.df.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    met = shared.spread_join(band.df, hubs, ["key"], band.df.count(), ["doc_id"])
    cluster = shared.Kept(shared.components(met.where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))), "clusters")
    member = shared.settled(lambda: units(cluster.df, band.df, bands, block), "units")
    # by a shuffle at any size: the members grow with the input and must not be broadcast while they happen to be few
    unit = both.where("doc_id is not null").join(member.df.hint("merge"), "doc_id").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "doc_id")
    links = unit.select("doc_id", "text", "cluster", "i", "j").mapInArrow(functools.partial(_confirm, width=words, n=bands * rows, num=num, den=den), "a long, b long")
    found = shared.keep(shared.components(links), "components")
    for done in (band, cluster, member):
        done.drop()
    rep = classes.join(found, classes["rep"] == found["node"], "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = signed.drop("keys").join(rep, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``near_duplicates`` keeps.

    Rows with a null id stay. Rows that share an id are texts of their own: of copies
    one row stays.
    """
    columns, row = docs.columns, id_col
    if shared.repeated(docs, id_col):
        docs, row = shared.numbered(docs, id_col, text_col), "_weir_row"
    gone = near_duplicates(docs, id_col=row, text_col=text_col, **options).where("not kept").select(F.col("doc_id").alias("_weir_id")).distinct()
    return docs.join(gone.hint("merge"), docs[row].cast("long") == gone["_weir_id"], "left_anti").select(*(docs[c] for c in columns))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.table(spark, sf_dir, "documents"), words=3, similarity=(85, 100))
