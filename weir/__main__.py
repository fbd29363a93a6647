"""``python -m weir``: the operators over folders and tables.

    python -m weir list
    python -m weir run QUERY --tables DIR [--out DIR] [--format parquet|csv|json]
    python -m weir duplicates FOLDER [--min-size N] [--keep oldest]
    python -m weir convert FOLDER --to txt|md|html [--out DIR]
    python -m weir recipe RECIPE.json FOLDER [--out DIR]
    python -m weir tables FILES... [--out DIR]
    python -m weir sheets FILES... [--out DIR]
    python -m weir compare LEFT RIGHT [--quick] [--out DIR]
    python -m weir check (--rename T | --folders T | --pages SPEC)

Without ``--out`` the first rows are printed.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _duplicates(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from .operators import duplicates

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(a.folder)
    files = found.select(F.xxhash64("path").alias("id"), "path", F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("modified"), F.lit(0).alias("pixels"), "content")
    return duplicates.mark(duplicates.exact_groups(files, min_size=a.min_size), keep=a.keep).drop("content")


def _compare(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from .operators import compare
    from .sources import files

    def side(folder: str) -> DataFrame:
        listed = files.listing(spark, folder).select("path", "rel", "size", "modified")
        if a.quick:
            return listed.withColumn("hash", F.lit(None).cast("string"))
        held = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.sha2("content", 256).alias("hash"))
        return listed.join(held, "path")

    return compare.compare(side(a.left), side(a.right), quick=a.quick).select("rel", "status", "newer")


def _sheets(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from .operators import tables
    from .sources import delimited

    return tables.merged({f.rsplit("/", 1)[-1]: delimited.table(spark, f) for f in a.files})


def _convert(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from .operators import documents
    from .sources import files

    return documents.converted(files.texts(spark, a.folder).where("error is null"), a.to, id_col="path")


def _recipe(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from .plans import recipes
    from .sources import files

    with open(a.recipe, encoding="utf-8") as file:
        recipe = recipes.Recipe.from_json(file.read())
    return recipes.run(files.texts(spark, a.folder).where("error is null"), recipe)


def _tables(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from .sources import files

    return files.read_table(spark, a.files)


def _run(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from . import catalog

    if a.query not in catalog.QUERIES:
        raise SystemExit(f"no query {a.query!r}; 'list' names them")
    return catalog.QUERIES[a.query](spark, a.tables)


def _check(a: argparse.Namespace) -> int:
    from .functions import names

    said = names.template_problem(a.rename) if a.rename is not None else names.folder_template_problem(a.folders) if a.folders is not None else None
    if a.pages is not None:
        from .operators import intervals

        said = SparkSession.builder.getOrCreate().range(1).select(intervals.page_spec_problem(F.lit(a.pages))).first()[0]
    print(said or "fine")
    return 1 if said else 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="weir", description="Record- and text-processing operators on Spark.")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, of, what: str, **arguments) -> None:
        one = commands.add_parser(name, help=what)
        for flag, options in arguments.items():
            one.add_argument(*([flag] if not options.pop("option", False) else [f"--{flag.replace('_', '-')}"]), **options)
        one.add_argument("--out", help="folder to write to")
        one.add_argument("--format", choices=["parquet", "csv", "json"], default="parquet")
        one.set_defaults(of=of)

    command("list", None, "the queries there are")
    command("run", _run, "a registered query over a folder of tables", query={}, tables={"option": True, "required": True})
    command("duplicates", _duplicates, "equal files and which to keep", folder={}, min_size={"option": True, "type": int, "default": 1}, keep={"option": True, "default": "oldest"})
    command("compare", _compare, "two folders, by contents or by size and time", left={}, right={}, quick={"option": True, "action": "store_true"})
    command("sheets", _sheets, "delimited files merged by column name", files={"nargs": "+"})
    command("convert", _convert, "Markdown files as txt, md or html", folder={}, to={"option": True, "choices": ["txt", "md", "html"], "required": True})
    command("recipe", _recipe, "a recipe over text files", recipe={}, folder={})
    command("tables", _tables, "delimited files with typed cells", files={"nargs": "+"})
    command("check", None, "a template or a page list", rename={"option": True}, folders={"option": True}, pages={"option": True})
    return out


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "list":
        from . import catalog

        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    if a.command == "check":
        return _check(a)
    rows = a.of(SparkSession.builder.appName("weir").getOrCreate(), a)
    if a.out:
        rows.write.format(a.format).save(a.out)
    else:
        rows.show(truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main())
