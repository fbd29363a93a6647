"""Two listings side by side: what is the same, different, or only on one side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import casefold
from ..functions.values import newer

STATUSES = ["identical", "different", "only-left", "only-right"]


def compare(left: DataFrame, right: DataFrame, *, quick: bool = False, dead: float = 2.0) -> DataFrame:
    """``rel``, ``status``, ``newer`` and a nullable struct for either side.

    Either has rel, size, modified, hash. Paths meet whatever their case. ``quick``
    takes equal sizes and times within ``dead`` seconds for the same content. A path
    that occurs in two cases on one side meets every match on the other. One full
    outer join on the folded path.
    """
    side = lambda d, n: d.select(casefold("rel").alias(f"{n}_key"), F.struct("rel", "size", "modified", "hash").alias(n))
    both = side(left, "left").join(side(right, "right"), F.col("left_key") == F.col("right_key"), "full_outer")
    same = (F.abs(F.col("left.modified") - F.col("right.modified")) < dead) if quick else F.coalesce(F.col("left.hash") == F.col("right.hash"), F.lit(False))
    status = F.when(F.col("right").isNull(), "only-left").when(F.col("left").isNull(), "only-right").when((F.col("left.size") == F.col("right.size")) & same, "identical").otherwise("different")
    out = both.select(F.coalesce("left.rel", "right.rel").alias("rel"), status.alias("status"), "left", "right")
    return out.withColumn("newer", F.when(F.col("status") == "different", newer(F.col("left.modified"), F.col("right.modified"), dead)).otherwise(""))


def counts(compared: DataFrame) -> DataFrame:
    """Rows of each status, also of those that don't occur."""
    spark = compared.sparkSession
    every = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    got = compared.groupBy("status").agg(F.count("*").alias("n"))
    return every.join(got, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def copy_plan(compared: DataFrame, direction: str = "both") -> DataFrame:
    """``rel``, ``copy_to`` of the rows that one side lacks; direction lr, rl or both."""
    to = {"lr": ["only-left"], "rl": ["only-right"], "both": ["only-left", "only-right"]}[direction]
    return compared.where(F.col("status").isin(to)).select("rel", F.when(F.col("status") == "only-left", "right").otherwise("left").alias("copy_to"))


def shown(compared: DataFrame, which: str = "all", most: int = 20_000) -> DataFrame:
    """What a screen lists: all, all but identical ('diff'), or one status; at most ``most`` rows, by path."""
    out = compared if which == "all" else compared.where("status <> 'identical'") if which == "diff" else compared.where(F.col("status") == which)
    return out.orderBy(casefold("rel")).limit(most)
