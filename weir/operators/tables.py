"""Many tables into one: by column name, typed cell by cell, without repeated rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import column_key


def _key(name: str) -> str:
    return " ".join(name.split()).lower().replace("ß", "ss")


def merged(frames: dict[str, DataFrame], *, source: str | None = "Source file") -> DataFrame:
    """All rows, columns matched by name whatever case and spaces; the first spelling and place win.

    A column that a table lacks is null there. Cells are text. Of two equal headers
    in one table the later cell wins. ``source``: a column with the table's label.
    Rows whose cells are all blank go.
    """
    names: dict[str, str] = {}
    for df in frames.values():
        for k, c in enumerate(df.columns):
            names.setdefault(_key(c) or f"column {k + 1}", " ".join(c.split()) or f"Column {k + 1}")
    parts = []
    for label, df in frames.items():
        own = {_key(c) or f"column {k + 1}": k for k, c in enumerate(df.columns)}
        flat = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
        cells = [F.col(f"c{own[key]}").cast("string").alias(name) if key in own else F.lit(None).cast("string").alias(name) for key, name in names.items()]
        blank = reduce(lambda a, b: a & b, (F.coalesce(F.trim(F.col(f"c{k}").cast("string")), F.lit("")) == "" for k in own.values()))
        part = flat.where(~blank).select(*cells)
        parts.append(part.withColumn(source, F.lit(label)) if source else part)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_rows(df: DataFrame, order: list[str], without: list[str] = ()) -> DataFrame:
    """Of rows with equal cells (whatever case and spaces, null as '') the first in ``order``."""
    cells = [c for c in df.columns if c not in without and c not in order]
    key = F.concat_ws("\u0001", *(F.coalesce(column_key(F.col(f"`{c}`").cast("string")), F.lit("")) for c in cells))
    rank = F.row_number().over(Window.partitionBy(F.sha2(key, 256)).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
