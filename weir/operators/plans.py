"""Plans with a problem column: new names, dated folders, numbering, free names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import natural_key, safe_filename, without_number
from ..functions.text import casefold
from ..functions.values import number_text
from .free_names import free_names  # noqa: F401  a plan like the others
from .spread import heavy_keys, spread_join
from .storage import cut


def numbered(rows: DataFrame, order: list[Column], *, start: int = 1, step: int = 1) -> DataFrame:
    """With ``value`` and ``digits`` (enough for the last number), in the given order.

    A running number is one sequence, but rows are counted by range first: the
    number is the count of the ranges before plus the place within the range. The
    ranges are written once, as both counts must see the same ones.
    """
    spark = rows.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.spark_partition_id().cast("long") * (1 << 33))
    ranged = cut(ranged)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    out = ranged.join(F.broadcast(before), "_part")
    value = F.lit(start) + (F.col("_before") + F.col("_at")) * step
    last = F.abs(F.lit(start) + (F.col("_total") - 1) * step)
    out = out.withColumn("value", value).withColumn("digits", F.greatest(F.lit(len(str(abs(start)))), F.length(last.cast("string"))))
    return out.drop("_part", "_at", "_before").withColumnRenamed("_total", "total")


def new_name(name: Column, number: Column, *, style: str = "number_name", text: str = "", separator: str = " - ", drop_number: bool = False) -> Column:
    """The four plain styles: number_name, name_number, text_number, number."""
    base = without_number(name) if drop_number else name
    lead = F.concat(F.lit(text.strip()), F.lit(separator)) if text.strip() else F.lit("")
    out = {
        "number": F.concat(lead, number), "text_number": F.concat(F.lit(text.strip() + " "), number),
        "name_number": F.concat(lead, base, F.lit(separator), number), "number_name": F.concat(lead, number, F.lit(separator), base),
    }[style]
    return safe_filename(out, number, normal=False)


def clashes(plan: DataFrame) -> DataFrame:
    """With ``problem``: rows (parent, name, new_name, seq) that would get a name twice, whatever the case.

    A later row names the first one; the first one names the second. Both are minima with
    partial aggregation, joined back to the rows, of which a name may have any number.
    """
    key = ["_p", "_n"]
    rows = plan.withColumns({"_p": F.coalesce(casefold("parent"), F.lit("")), "_n": F.coalesce(casefold("new_name"), F.lit(""))})
    least = F.min(F.struct("seq", "name"))
    first = rows.groupBy(*key).agg(least.alias("_first"), F.count("*").alias("n")).where("n > 1")
    heavy = heavy_keys(first, key, plan.count())
    rows = spread_join(rows, first.drop("n"), key, heavy, ["seq"], "left")
    second = rows.where(F.col("seq") > F.col("_first.seq")).groupBy(*key).agg(least.alias("_second"))
    rows = spread_join(rows, second, key, heavy, ["seq"], "left")
    other = F.when(F.col("seq") > F.col("_first.seq"), F.col("_first.name")).otherwise(F.col("_second.name"))
    return rows.withColumn("problem", F.when(F.col("_first").isNotNull(), F.concat(F.lit("Same new name as '"), other, F.lit("'"))).otherwise("")).drop(*key, "_first", "_second")


def taken(plan: DataFrame, there: DataFrame) -> DataFrame:
    """With ``problem`` where the target (parent, new_name) is there and isn't itself being renamed."""
    key = lambda d, n: d.select(casefold("parent").alias("_p"), casefold(n).alias("_n")).distinct()
    blocked = key(there, "name").join(key(plan, "name"), ["_p", "_n"], "left_anti").withColumn("_there", F.lit(True))
    out = plan.withColumn("_p", casefold("parent")).withColumn("_n", casefold("new_name")).join(blocked, ["_p", "_n"], "left")
    there_ = F.col("_there").isNotNull() & (F.col("problem") == "") & (F.col("name") != F.col("new_name"))
    return out.withColumn("problem", F.when(there_, "A file or folder with this name is already there").otherwise(F.col("problem"))).drop("_p", "_n", "_there")


def natural_order(rows: DataFrame, name: str = "name", descending: bool = False, by: str = "name") -> DataFrame:
    """2 before 10, whatever the case; ties by the name itself. Descending turns every key.

    ``by``: name, modified, created, taken (else modified) or manual, which is the place in the column ``seq``;
    rows of one date are in the order of their names.
    """
    dates = {"name": [], "modified": ["modified"], "created": ["created"], "taken": ["taken", "modified"], "manual": []}
    keys = [F.col("seq")] if by == "manual" else [*([F.coalesce(*dates[by])] if dates[by] else []), natural_key(name), F.col(name)]
    return rows.orderBy(*(k.desc() if descending else k.asc() for k in keys))


def best_date(taken_: Column, recorded: Column, modified: Column, use_file_date: bool = True) -> Column:
    """struct(when, found_by): the first date there is."""
    by = F.when(taken_.isNotNull(), "date taken").when(recorded.isNotNull(), "recording date")
    if use_file_date:
        by = by.when(modified.isNotNull(), "file date")
    when = F.coalesce(taken_, recorded, modified) if use_file_date else F.coalesce(taken_, recorded)
    return F.struct(when.alias("when"), by.otherwise("no date").alias("found_by"))


def folder_summary(moves: DataFrame) -> DataFrame:
    """One row over (folder, found_by, note): files, folders, undated, left where they are."""
    return moves.agg(F.count("*").alias("files"), F.count_distinct("folder").alias("folders"), F.count_if(F.col("found_by") == "no date").alias("undated"), F.count_if(F.coalesce(F.col("note"), F.lit("")) != "").alias("left"))


def undo(journal: DataFrame) -> DataFrame:
    """The steps back, last first, of (seq, action, source, target, size, target_size): moves return, copies go if they haven't changed."""
    verdict = F.when(F.col("action") == "move", "move back").when(F.col("size") == F.col("target_size"), "delete copy").otherwise("leave: changed since")
    return journal.select("seq", F.col("target").alias("source"), F.col("source").alias("target"), verdict.alias("verdict")).orderBy(F.desc("seq"))


def number_label(value: Column, digits: Column) -> Column:
    return number_text(value, digits)
