"""Names that aren't taken: ``base``, else ``base (2)``, ``base (3)`` and so on, in order of arrival.

Names depend on what came before: 'a (2)' as a base of its own keeps that name from the
copies of 'a' if it comes before they have got there, and else is a copy itself. Yet no
family of names is gone through row by row:

* the bases of the form 'P (n)' are P's literals. A literal holds its number if P's
  copies so far, counted by a running sum, don't reach it: numbers 2 to n - 1 have n - 2
  places, less those that literals below hold. Literals whose parents are settled are
  settled together, so there are as many steps as a name has numbers at its end;
* held numbers leave gaps of free ones; the kth copy's number is k + 1 and as many more
  as there are held numbers with fewer than k free ones before them: a running sum over
  copies and held numbers in one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import casefold
from .running import prefix_sum
from .spread import heavy_keys, spread_join
from .storage import cut

_BASE = ["_family", "_base"]
_PARENT = ["_family", "_parent"]
_NUMBER = r"^(.*) \(([2-9]|[1-9][0-9]{1,17})\)$"


def _bases(rows: DataFrame, there: DataFrame) -> DataFrame:
    """Each base and name that is there: ``first`` (seq of its first row), ``there``, and if it is of the form 'P (n)' ``_parent``, ``n``, ``depth``."""
    both = rows.select(*_BASE, "_seq", F.lit(False).alias("there")).unionByName(there.select(*_BASE, F.lit(None).cast("long").alias("_seq"), F.lit(True).alias("there")))
    out = both.groupBy(*_BASE).agg(F.min("_seq").alias("first"), F.max("there").alias("there"))
    return out.withColumns({
        "_parent": F.nullif(F.regexp_extract("_base", _NUMBER, 1), F.lit("")), "n": F.regexp_extract("_base", _NUMBER, 2).try_cast("long"),
        "depth": F.length(F.regexp_extract("_base", r"((?: \([0-9]+\))*)$", 1)) - F.length(F.regexp_replace(F.regexp_extract("_base", r"((?: \([0-9]+\))*)$", 1), r"\(", "")),
    })


def _held(literals: DataFrame) -> DataFrame:
    """With ``held``: whether a literal's number is still free when it comes. ``copies``: how many of its parent's copies came before.

    A number is held if no more copies came than it has places below: n - 2 less the
    held ones there. What is held is guessed and put right until nothing changes; a
    guess is right up to the first wrong one, and mostly at once.
    """
    now = literals.withColumn("held", F.col("copies") == 0)
    while True:
        now = prefix_sum(now.withColumn("_one", F.col("held").cast("long")), _PARENT, ["n"], "_one", "_below").drop("_one")
        now = cut(now.withColumn("_was", F.col("held")).withColumn("held", F.col("copies") <= F.col("n") - 2 - F.col("_below")))
        if now.where("held <> _was").isEmpty():
            return now.drop("_was", "_below")


def free_names(rows: DataFrame, key: list[str] = (), *, there: DataFrame | None = None, ending: str | None = None) -> DataFrame:
    """With ``name``: ``base`` or, if that is taken, the first ``base (n)`` from 2 on that is free, in the order of ``seq`` (whole numbers, each once), within ``key``, whatever the case.

    ``there``: names taken from the outset, with ``base`` and the columns of ``key`` and
    ``ending``. ``ending``: a column that comes behind the number, as a file's suffix.
    A null base or key counts as empty. Other columns are kept; a column ``name`` is replaced.
    """
    tail = (lambda: F.coalesce(ending, F.lit(""))) if ending else (lambda: F.lit(""))
    tag = lambda df: df.withColumns({"_family": F.concat_ws("\u0001", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key), casefold(tail())), "_base": casefold(F.coalesce("base", F.lit("")))})
    kept = [c for c in rows.columns if c != "name"]
    tagged = tag(rows).select(*_BASE, F.col("seq").cast("long").alias("_seq"), F.struct(*kept).alias("_row"), tail().alias("_tail"))
    taken = tag(there).select(*_BASE) if there is not None else tagged.select(*_BASE).limit(0)
    bases = cut(_bases(tagged, taken))
    families = bases.select("_family", F.col("_base").alias("_parent")).distinct()
    literals = cut(bases.where("_parent is not null").join(families, _PARENT))
    depth = literals.agg(F.max("depth")).first()[0] or 0

    # how many rows of its base came before a row, and of its parent before a literal's first row
    arrivals = literals.where("first is not null").select("_family", F.col("_parent").alias("_base"), F.col("first").alias("_seq"), F.lit(0).alias("_one"), "n")
    events = tagged.withColumns({"_one": F.lit(1), "n": F.lit(None).cast("long")}).unionByName(arrivals, allowMissingColumns=True) if depth else tagged.withColumns({"_one": F.lit(1), "n": F.lit(None).cast("long")})
    events = cut(prefix_sum(events, _BASE, ["_seq"], "_one", "_before"))
    # bases whose plain name none of their rows gets
    displaced = bases.where("there").select(*_BASE)
    held = literals.select("_family", F.col("_parent").alias("_base"), "n").limit(0)
    for level in range(1, depth + 1):
        own = literals.where(F.col("depth") == level).join(events.where("_one = 0").select("_family", F.col("_base").alias("_parent"), "n", F.col("_before").alias("came")), [*_PARENT, "n"], "left")
        own = own.join(displaced.select("_family", F.col("_base").alias("_parent"), F.lit(1).alias("all")), _PARENT, "left")
        copies = F.when(F.col("there") | F.col("first").isNull(), 0).otherwise(F.greatest(F.coalesce("came", F.lit(0)) - 1 + F.coalesce("all", F.lit(0)), F.lit(0)))
        own = _held(own.withColumn("copies", copies).select(*_BASE, "_parent", "n", "there", "copies"))
        displaced = displaced.unionByName(own.where("not held and not there").select(*_BASE))
        held = held.unionByName(own.where("held").select("_family", F.col("_parent").alias("_base"), "n"))

    lost = displaced.withColumn("all", F.lit(1))
    heavy = heavy_keys(tagged.groupBy(*_BASE).agg(F.count("*").alias("n")), _BASE, tagged.count())
    mine = spread_join(events.where("_one = 1").drop("_one", "n"), lost, _BASE, heavy, ["_seq"], "left")
    mine = mine.select(*_BASE, F.col("_before") + F.coalesce("all", F.lit(0)), "_row", "_tail").toDF(*_BASE, "_at", "_row", "_tail")  # 0: the plain name
    if depth:
        # of the free numbers before each held one
        gaps = prefix_sum(held.withColumn("_one", F.lit(1)), _BASE, ["n"], "_one", "_below").select(*_BASE, (F.col("n") - 1 - F.col("_below")).alias("_at"), F.lit(1).alias("_one"))
        both = mine.withColumn("_one", F.lit(0)).unionByName(gaps, allowMissingColumns=True).withColumn("_copy", 1 - F.col("_one"))
        mine = prefix_sum(both, _BASE, ["_at", "_copy"], "_one", "_more").where("_one = 0")
    number = F.col("_at") + 1 + (F.col("_more") if depth else F.lit(0))
    base = F.coalesce("_row.base", F.lit(""))
    name: Column = F.when(F.col("_at") == 0, F.concat(base, "_tail")).otherwise(F.concat(base, F.lit(" ("), number.cast("string"), F.lit(")"), "_tail"))
    return mine.select("_row.*", name.alias("name"))
