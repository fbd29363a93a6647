"""Connected components by random contraction.

In every round each node goes over to the first, in a random order of that round, of
itself and its neighbours; links then join what their ends have become, and those within
one node vanish. Whatever the graph's shape a constant share of the nodes goes in each
round, so rounds are as many as the logarithm of the size, and all rounds together
handle a multiple of the first one's rows. Nodes with very many links come first in
every order, so that what hangs on them goes over at once. The steps are then walked
back from the last round to the first.

Every step is a minimum with partial aggregation, or a join in which a hub's links are
dealt over tasks; a round's tables are written, so that a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spread import heavy_keys, spread_join
from .storage import cut


def _contracted(links: DataFrame, size: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """(``node``, ``to``: what each node goes over to; the links between those) of links (a, b)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    heavy = cut(heavy_keys(both.groupBy("a").agg(F.count("*").alias("n")), ["a"], 2 * size))
    hubs = F.broadcast(heavy.select(F.col("a").alias("b"), F.lit(False).alias("plain")))
    order = lambda node: F.struct(F.coalesce("plain", F.lit(True)).alias("plain"), F.xxhash64(F.col(node), F.lit(turn)).alias("h"), F.col(node).alias("node"))
    first = both.join(hubs, "b", "left").groupBy("a").agg(F.min(order("b")).alias("least"))
    own = first.join(hubs.withColumnRenamed("b", "a"), "a", "left").select(F.col("a").alias("node"), F.least(order("a"), "least")["node"].alias("to"))
    own = cut(own)
    at = lambda end: spread_join(links, own.select(F.col("node").alias(end), F.col("to").alias("_to")), [end], heavy.withColumnRenamed("a", end), ["a", "b"]).drop(end).withColumnRenamed("_to", end)
    links = at("a")
    links = at("b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return own, links


def components(links: DataFrame, *, rounds: int = 100) -> DataFrame:
    """``id``, ``group_id`` (the smallest id reachable) of every node with a link to another one.

    ``links``: columns ``a``, ``b`` of one type that can be ordered; either direction,
    repeats, loops and null ends are allowed. No links: no rows.
    """
    links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    steps: list[DataFrame] = []
    for turn in range(rounds):
        links = cut(links)
        size = links.count()
        if not size:
            break
        own, links = _contracted(links, size, turn)
        steps.append(own)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if not steps:
        return links.select(F.col("a").alias("id"), F.col("b").alias("group_id")).limit(0)

    def joined(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
        """Many nodes may have gone over to one."""
        heavy = heavy_keys(rows.groupBy(key).agg(F.count("*").alias("n")), [key], rows.count())
        return spread_join(rows, others, [key], heavy, ["node"], "left")

    label = steps.pop()
    while steps:
        later = label.select(F.col("node").alias("to"), F.col("to").alias("last"))
        label = cut(joined(steps.pop(), later, "to").select("node", F.coalesce("last", "to").alias("to")))
    least = label.groupBy("to").agg(F.min("node").alias("group_id"))
    return joined(label, least, "to").select(F.col("node").alias("id"), "group_id")
