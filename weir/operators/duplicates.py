"""Duplicate groups: exact and by similarity, which copy to keep, and totals."""

from __future__ import annotations

import itertools
import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import hamming, max_distance
from .components import components
from .near_codes import near_links, near_rows
from .spread import heavy_keys, spread_join
from .storage import cut

def _most(c: str) -> list[Column]:
    """Largest first, null last, as keys of which the least counts."""
    return [F.col(c).isNull().alias(f"no_{c}"), (-F.col(c)).alias(f"most_{c}")]


#: What decides which copy stays, best first; lower(path) decides last.
KEEP = {
    "largest": lambda: [*_most("pixels"), *_most("size"), F.col("modified").alias("modified")],
    "oldest": lambda: [F.col("modified").alias("modified"), F.length("path").alias("length")],
    "newest": lambda: [*_most("modified"), F.length("path").alias("length")],
    "shortest": lambda: [F.length("path").alias("length"), F.col("modified").alias("modified")],
}


def exact_groups(files: DataFrame, content: Column | str = "content", *, min_size: int = 0) -> DataFrame:
    """Rows whose content another row has too, with ``group_id`` (the smallest id of the group).

    ``files``: id, path, size, modified, pixels and the content. The content is hashed where it is read
    and goes no further unless the result's content is asked for: what is counted (with partial
    aggregation) and joined are sizes, hashes and ids, and a group that holds a large share of all rows
    is dealt over many tasks.
    """
    c = F.col(content) if isinstance(content, str) else content
    rows = files.where(F.col("size") >= min_size).withColumn("content_hash", F.sha2(c, 256))
    key = ["size", "content_hash"]
    groups = rows.groupBy(*key).agg(F.min("id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return spread_join(rows, groups.drop("n"), key, heavy_keys(groups, key, files.where(F.col("size") >= min_size).count()), ["id"])


def mark(groups: DataFrame, keep: str = "largest") -> DataFrame:
    """With ``keep``: whether the row is the one of its group that stays. A row that is there twice (same id and path) is marked twice.

    The best row is a minimum with partial aggregation, joined back: a group is never sorted in one task.
    """
    best = F.min(F.struct(*KEEP[keep](), F.lower("path").alias("lower"), F.col("path").alias("path"), F.col("id").alias("id")))
    first = groups.groupBy("group_id").agg(best.alias("_best"), F.count("*").alias("n"))
    heavy = heavy_keys(first, ["group_id"], groups.count())
    out = spread_join(groups, first.select("group_id", F.col("_best.path").alias("_path"), F.col("_best.id").alias("_id")), ["group_id"], heavy, ["id"])
    return out.withColumn("keep", F.col("path").eqNullSafe(F.col("_path")) & F.col("id").eqNullSafe(F.col("_id"))).drop("_path", "_id")


def summary(marked: DataFrame) -> DataFrame:
    """One row: groups, files that go, bytes freed."""
    going = F.when(~F.col("keep"), 1).otherwise(0)
    return marked.agg(F.count_distinct("group_id").alias("groups"), F.coalesce(F.sum(going), F.lit(0)).alias("going"), F.coalesce(F.sum(F.when(~F.col("keep"), F.col("size"))), F.lit(0)).alias("freed"))


def freed_by_group(marked: DataFrame) -> DataFrame:
    """``group_id``, ``files``, ``freed``, most bytes first."""
    out = marked.groupBy("group_id").agg(F.count("*").alias("files"), F.sum(F.when(~F.col("keep"), F.col("size")).otherwise(0)).alias("freed"))
    return out.orderBy(F.desc("freed"), "group_id")


def refused(marked: DataFrame) -> DataFrame:
    """Groups of which every member is marked to go: a plan that must not be carried out."""
    return marked.groupBy("group_id").agg(F.bool_and(~F.col("keep")).alias("all_go")).where("all_go").select("group_id", F.lit("keep at least one").alias("problem"))


def _plans(distance: int, bits: int) -> list[tuple[list[int], list[int]]]:
    """(lengths, radii) of ways to cut a code so that codes within ``distance`` are within the radius in one segment at least."""
    out = []
    for segments in range(1, min(distance + 1, bits) + 1):
        share = lambda x, m=segments: [x // m + (k < x % m) for k in range(m)]
        out.append((share(bits), share(distance - segments + 1)))
    return out


def segment_plan(distance: int, n: int, *, bits: int = 64, most: int = 1 << 15) -> tuple[list[int], list[int]]:
    """The way that costs least for ``n`` codes: values looked up, and pairs met by chance, each of which costs as much as four.

    ``most``: values that one code may look up. The result is the same whatever the way.
    """
    near = lambda size, radius: sum(math.comb(size, k) for k in range(radius + 1))

    def cost(plan: tuple[list[int], list[int]]) -> float:
        values = [near(*x) for x in zip(*plan, strict=True)]
        return n * sum(values) + 4 * n * n * sum(v / 2**size for v, size in zip(values, plan[0], strict=True))

    fit = [p for p in _plans(distance, bits) if sum(near(*x) for x in zip(*p, strict=True)) <= most]
    return min(fit, key=cost)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def candidates(reps: DataFrame, distance: int) -> tuple[DataFrame, Column]:
    """(``a``, ``b``, ``ca``, ``cb``, ``segment``: pairs with a < b that are near in a segment; whether it is the first such segment)."""
    n = reps.count()
    sizes, radii = segment_plan(distance, n)
    masks = [((1 << size) - 1) << at for size, at in zip(sizes, itertools.accumulate([0, *sizes]), strict=False)]
    bits = [[b for b in range(64) if m >> b & 1] for m in masks]
    flips = [(k, _signed(sum(1 << b for b in chosen))) for k, r in enumerate(radii) for count in range(r + 1) for chosen in itertools.combinations(bits[k], count)]
    flips = reps.sparkSession.createDataFrame(pa.table({"segment": pa.array([k for k, _ in flips], pa.int32()), "flip": pa.array([f for _, f in flips], pa.int64())}))
    parts = F.array(*(F.struct(F.lit(k).alias("segment"), F.col("code").bitwiseAND(_signed(m)).alias("value")) for k, m in enumerate(masks)))
    own = reps.select("id", "code", F.inline(parts))
    asked = own.join(F.broadcast(flips), "segment").select("segment", F.col("value").bitwiseXOR(F.col("flip")).alias("value"), F.col("id").alias("a"), F.col("code").alias("ca"))
    own = own.select("segment", "value", F.col("id").alias("b"), F.col("code").alias("cb"))
    heavy = heavy_keys(own.groupBy("segment", "value").agg(F.count("*").alias("n")), ["segment", "value"], n)
    met = spread_join(own, asked, ["segment", "value"], heavy, ["b"]).where("a < b").drop("value")
    away = F.col("ca").bitwiseXOR(F.col("cb"))
    earlier = [(F.col("segment") <= k) | (F.bit_count(away.bitwiseAND(_signed(m))) > r) for k, (m, r) in enumerate(zip(masks, radii, strict=True))]
    return met, reduce(lambda x, y: x & y, earlier)


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``id``, ``code`` of one row of each code, the smallest id; links (``a``, ``b``) of the others to it)."""
    # codes may be dear to make, and are read several times
    rows = cut(_coded(rows))
    reps = rows.groupBy("code").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    heavy = heavy_keys(reps, ["code"], rows.count())
    copies = spread_join(rows, reps.select("code", F.col("id").alias("a")), ["code"], heavy, ["id"]).where("id <> a").select("a", F.col("id").alias("b"))
    return cut(reps.select("id", "code")), copies


def _coded(rows: DataFrame) -> DataFrame:
    return rows.where("code is not null and id is not null").select("id", "code")


#: More codes than this are looked up by their segments: then that costs less than comparing them all.
COMPARED = 1 << 23


def similar_pairs(rows: DataFrame, similarity: int = 90) -> DataFrame:
    """``a``, ``b`` (a < b), ``distance`` of rows (id, code) whose 64-bit codes differ in few enough bits.

    Exact: blocks of codes are compared (see ``near_codes``). Of very many codes each
    looks up the values around its own in a few long segments instead: two codes within d
    bits are within a radius in one of them; the pairs so met are verified, each at the
    first segment that shows it.
    Equal codes are one representative first, so copies never make pairs with each other
    here: their links are (smallest id, id). Rows without a code or id take no part; rows
    that share an id and differ in code may make a pair of an id's other code, never (x, x).
    """
    d = max_distance(similarity)
    reps, copies = _classes(rows)
    if reps.count() <= COMPARED:
        near = near_rows(reps, d)
    else:
        met, first = candidates(reps, d)
        apart = hamming(F.col("ca"), F.col("cb"))
        near = met.where(first & (apart <= d)).select("a", "b", apart.cast("int").alias("distance"))
    return near.unionByName(copies.withColumn("distance", F.lit(0)))


def all_similar_pairs(rows: DataFrame, similarity: int = 90) -> DataFrame:
    """As ``similar_pairs``, with every pair of copies and of copies' neighbours: of m equal codes m * (m - 1) / 2."""
    return near_rows(cut(_coded(rows)), max_distance(similarity))


def similar_groups(rows: DataFrame, similarity: int = 90) -> DataFrame:
    """``id``, ``group_id`` (the smallest id): what ``clusters(similar_pairs(rows, similarity))`` gives, without listing the pairs.

    A block of codes says what hangs together in it by one link for each code, however many pairs there are.
    """
    reps, copies = _classes(rows)
    if reps.count() > COMPARED:
        return clusters(similar_pairs(rows, similarity))
    return components(near_links(reps, max_distance(similarity)).unionByName(copies))


def clusters(pairs: DataFrame) -> DataFrame:
    """``id``, ``group_id`` (the smallest id): groups of rows that links (a, b) connect, see ``components``."""
    return components(pairs.select("a", "b"))


def relative_to_root(files: DataFrame, path: str = "path") -> DataFrame:
    """With ``relative``: the path below the deepest folder that all rows share."""
    parts = F.split(F.col(path), "/")
    folder = F.slice(parts, 1, F.size(parts) - 1)
    # of all paths the least and the greatest bound the common beginning
    ends = files.agg(F.min(folder).alias("lo"), F.max(folder).alias("hi"))
    same = F.aggregate(F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, x: F.struct((a["n"] + (a["go"] & x).cast("int")).alias("n"), (a["go"] & x).alias("go")))
    depth = ends.select(same["n"].alias("depth"))
    return files.crossJoin(F.broadcast(depth)).withColumn("relative", F.array_join(F.slice(parts, F.col("depth") + 1, F.greatest(F.size(parts) - F.col("depth"), F.lit(0))), "/")).drop("depth")


def union_distinct(frames: list[DataFrame], key: Column) -> DataFrame:
    """All rows, of equal keys the first in the order of the frames and their ``seq``."""
    tagged = [f.withColumn("_frame", F.lit(k)) for k, f in enumerate(frames)]
    every = reduce(DataFrame.unionByName, tagged)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_frame", "seq"))
    return every.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_frame")
