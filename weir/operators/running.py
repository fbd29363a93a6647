"""Running sums and steps within groups of any size: no group is one task's work.

Rows are put into ranges of (group, order), which are written once, as what is worked
out within the ranges and what is carried between them must see the same ones. What is
carried is one row for each range and group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .storage import cut


def _ranged(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(rows.repartitionByRange(parts, *group, *order).withColumn("_range", F.spark_partition_id()))


def _carried(ranged: DataFrame, group: list[str], order: list[str], said: list[tuple[Column, str]], within: tuple[int, int], beyond: tuple[int, int]) -> DataFrame:
    """With ``_here`` and ``_there`` numbers of each aggregate: over the rows of the range and group, and over its other ranges."""
    here = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(*within)
    across: WindowSpec = Window.partitionBy(*group).orderBy("_range").rowsBetween(*beyond)
    each = ranged.groupBy("_range", *group).agg(*(of(F.col(v)).alias(f"_all{k}") for k, (of, v) in enumerate(said)))
    each = each.select("_range", *group, *(of(F.col(f"_all{k}")).over(across).alias(f"_there{k}") for k, (of, _) in enumerate(said)))
    each = each.where(" or ".join(f"_there{k} is not null" for k in range(len(said))))
    return ranged.withColumns({f"_here{k}": of(F.col(v)).over(here) for k, (of, v) in enumerate(said)}).join(each, ["_range", *group], "left")


def prefix_sum(rows: DataFrame, group: list[str], order: list[str], value: str | list[str], out: str | list[str]) -> DataFrame:
    """With ``out``: the sum of ``value`` over the rows of the same group that come before by ``order``; 0 for the first.

    Columns of ``group`` and ``value`` have no nulls; rows that tie come in any order.
    Several values are summed together.
    """
    values, outs = ([value], [out]) if isinstance(value, str) else (value, out)
    first, last = Window.unboundedPreceding, -1
    both = _carried(_ranged(rows, group, order), group, order, [(F.sum, v) for v in values], (first, last), (first, last))
    sums = {o: F.coalesce(f"_here{k}", F.lit(0)) + F.coalesce(f"_there{k}", F.lit(0)) for k, o in enumerate(outs)}
    return both.withColumns(sums).drop("_range", *(f"{w}{k}" for k in range(len(values)) for w in ("_here", "_there")))


def next_least(rows: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """With ``out``: the least ``value`` of the row and those of its group behind it by ``order``; null if there is none."""
    both = _carried(_ranged(rows, group, order), group, order, [(F.min, value)], (0, Window.unboundedFollowing), (1, Window.unboundedFollowing))
    return both.withColumn(out, F.least("_here0", "_there0")).drop("_range", "_here0", "_there0")


def _pieces(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(range, group, columns) of each run of rows of one range and group."""
    key, held = None, []
    for batch in batches:
        read = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("_range", "_group", *columns)]
        cuts = np.flatnonzero((read[0][1:] != read[0][:-1]) | (read[1][1:] != read[1][:-1])) + 1
        for x, y in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
            if x == y:
                continue
            now = int(read[0][x]), int(read[1][x])
            if now != key:
                if held:
                    yield *key, [np.concatenate(c) for c in zip(*held, strict=True)]
                key, held = now, []
            held.append([c[x:y] for c in read[2:]])
    if held:
        yield *key, [np.concatenate(c) for c in zip(*held, strict=True)]


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the steps from each row leave its range: the steps are squared until all have left."""
    for _, group, (at, step) in _pieces(batches, ["at", "step"]):
        to = step - at[0]
        while (inside := np.flatnonzero(to < len(at))).size:
            to[inside] = to[to[inside]]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), group)), pa.array(at), pa.array(to + at[0])], ["_group", "at", "exit"])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that are reached from where a range is entered."""
    for _, group, (at, step, enters) in _pieces(batches, ["at", "step", "enters"]):
        seen = []
        for now in np.flatnonzero(enters.astype(bool)).tolist():
            while now < len(at):
                seen.append(int(at[now]))
                now = int(step[now] - at[0])
        yield pa.RecordBatch.from_arrays([pa.array([group] * len(seen), pa.int64()), pa.array(seen, pa.int64())], ["_group", "at"])


#: A step that leads nowhere.
END = 1 << 60


def visited(rows: DataFrame) -> DataFrame:
    """``_group``, ``at`` of the rows that are reached from each group's row 0.

    ``rows``: long ``_group``, ``at`` (0, 1, 2 and so on within the group) and ``step``, the
    row that comes after it: larger than ``at``, or ``END``. Within a range steps are
    followed in place; between ranges only the rows count on which a range can be entered,
    and whether they are is found by doubling, so in as many rounds as the logarithm of
    the ranges.
    """
    ranged = _ranged(rows.select("_group", "at", "step"), ["_group"], ["at"])
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = lambda df: df.repartition(parts, "_range").sortWithinPartitions("_range", "_group", "at")
    exits = cut(sorted_(ranged).mapInArrow(_exits, "_group long, at long, exit long"))
    doors = exits.where(F.col("exit") < END // 2).select("_group", F.col("exit").alias("at")).distinct()
    firsts = exits.where("at = 0").select("_group", "at")
    jump = cut(exits.join(doors.unionByName(firsts).distinct(), ["_group", "at"]).where(F.col("exit") < END // 2))
    entered = cut(firsts)
    while not jump.isEmpty():
        entered = cut(entered.unionByName(entered.join(jump, ["_group", "at"]).select("_group", F.col("exit").alias("at"))).distinct())
        jump = cut(jump.join(jump.select("_group", F.col("at").alias("exit"), F.col("exit").alias("then")), ["_group", "exit"]).select("_group", "at", F.col("then").alias("exit")))
    enters = ranged.join(entered.withColumn("enters", F.lit(True)), ["_group", "at"], "left").withColumn("enters", F.coalesce("enters", F.lit(False)))
    return sorted_(enters).mapInArrow(_walked, "_group long, at long")
