"""Codes to print: where their contents come from, their names and problems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import code_problem, safe_filename
from ..functions.text import strip
from .plans import free_names


def of_lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """``seq``, ``content``, ``name`` of each line that isn't blank."""
    line = texts.select(F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("seq", "content"))
    return line.select("seq", strip("content").alias("content")).where("content <> ''").withColumn("name", F.col("content"))


def of_rows(rows: DataFrame, column: int, name_column: int = -1) -> DataFrame:
    """``seq``, ``content``, ``name`` of a table's rows (row_no, cells); the header row is one too."""
    content = strip(F.get("cells", column))
    named = strip(F.get("cells", name_column)) if name_column >= 0 else F.lit(None).cast("string")
    out = rows.select(F.col("row_no").alias("seq"), content.alias("content"), named.alias("name")).where("content <> ''")
    return out.withColumn("name", F.when(F.coalesce("name", F.lit("")) == "", F.col("content")).otherwise(F.col("name")))


def codes(items: DataFrame, kind: str = "qr") -> DataFrame:
    """``seq``, ``content``, ``name`` (free, fit for a file), ``problem``."""
    base = items.select("seq", "content", safe_filename("name", "code", 60).alias("base"))
    return free_names(base).select("seq", "content", "name", code_problem("content", kind).alias("problem"))
