"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds more than this share of all rows; so at most as many keys are.
SHARE = 4096
#: Fewer rows than this are no load for a task.
LIGHT = 4096


def heavy_keys(counts: DataFrame, key: list[str], total: int) -> DataFrame:
    """``key``, ``parts`` of the keys whose ``n`` of ``total`` rows are too many for one task: at most ``SHARE`` rows."""
    least = max(LIGHT, total // SHARE)
    return counts.where(F.col("n") > least).select(*key, F.ceil(F.col("n") / least).cast("int").alias("parts"))


def spread_join(rows: DataFrame, others: DataFrame, key: list[str], heavy: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``others`` on ``key``; a heavy key's rows are dealt by the hash of ``by``, and what they meet is copied to each part.

    ``heavy`` is broadcast: it is bounded by arithmetic (``heavy_keys``). ``how``: inner or left.
    """
    few = F.broadcast(heavy)
    dealt = rows.join(few, key, "left").withColumn("_part", F.pmod(F.xxhash64(*by), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copied = others.join(few, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copied, [*key, "_part"], how).drop("_part")
