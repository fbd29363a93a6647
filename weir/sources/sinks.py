"""Rows as files, written so that a reader never sees half a result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import stem, suffix
from ..functions.values import cell_text, formula_guard
from ..operators.free_names import free_names


def as_cells(df: DataFrame, *, comma_decimal: bool = False, guard: bool = False) -> DataFrame:
    """All columns as their canonical text; ``guard``: none of them a formula."""
    out = [cell_text(F.col(f"`{c}`"), kind, comma_decimal) for c, kind in df.dtypes]
    return df.select(*((formula_guard(x) if guard else x).alias(c) for x, c in zip(out, df.columns, strict=True)))


def write_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """A folder of delimited files; with ; numbers get a decimal comma. The committer renames when all is written."""
    as_cells(df, comma_decimal=delimiter == ";").write.mode("overwrite").csv(path, sep=delimiter, header=True, emptyValue="")


def write_dated(df: DataFrame, path: str, folders: list[str]) -> None:
    df.write.mode("overwrite").partitionBy(*folders).parquet(path)


def sheet_names(sheets: DataFrame) -> DataFrame:
    """With ``base``: a name of at most 31 characters without those a workbook refuses; see ``plans.free_names``."""
    bare = F.trim(F.regexp_replace("name", r"[\[\]:*?/\\\\]", " "))
    return sheets.withColumn("base", F.substring(F.when(bare == "", "Sheet").otherwise(bare), 1, 31))


def rendered_lines(rows: DataFrame, key: str, order: str, line: str, separator: str = "\n") -> DataFrame:
    """``key``, ``text``: the lines of a key joined in order."""
    held = F.array_sort(F.collect_list(F.struct(order, line)))
    return rows.groupBy(key).agg(F.array_join(F.transform(held, lambda s: s[line]), separator).alias("text"))


def numbered_outputs(plan: DataFrame, there: DataFrame, *, folder: str | None = None) -> DataFrame:
    """With ``output``: ``name`` if it is free, else the first ``stem (n).ending`` from 2 on, in the order of ``seq``, whatever the case.

    ``there``: names that exist (``name``), in the column ``folder`` if one is named; a
    name given to one row is taken for the next. See ``free_names``.
    """
    parts = lambda df: df.withColumns({"base": stem("name"), "_ending": suffix("name")})
    rows = parts(plan).withColumnRenamed("name", "_name")
    key = [folder] if folder else []
    out = free_names(rows, key, there=parts(there).drop("name"), ending="_ending")
    return out.withColumnsRenamed({"name": "output", "_name": "name"}).drop("base", "_ending")
