"""Recipes: named steps with options, as JSON, run as one chain of DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.values import parse_time


@dataclass
class Kind:
    """A step that recipes can name. ``many``: one row may become several, so it can only stand last.

    ``problem``: why a row's text can't go through it, null where it can. ``guarded``: the
    step works text by text outside Spark's expressions and gives struct(value, error).
    """

    run: Callable[..., DataFrame]
    options: dict = field(default_factory=dict)
    many: bool = False
    problem: Callable[[Column], Column] | None = None
    guarded: Callable[..., Column] | None = None


KINDS: dict[str, Kind] = {}


def kind(name: str, many: bool = False, problem: Callable[[Column], Column] | None = None, **options):
    def add(run):
        KINDS[name] = Kind(run, options, many, problem)
        return run

    return add


class StepError(Exception):
    """What a step says about a text that it can't work on."""


def text_kind(name: str, function: Callable[..., str], **options) -> None:
    """Registers a Python function from text to text as a step; what it raises is that row's error. A null text isn't given to it."""

    def guarded(text: Column, **chosen) -> Column:
        @F.pandas_udf("value string, error string")
        def tried(texts: pd.Series) -> pd.DataFrame:
            def one(text: str | None) -> tuple[str | None, str | None]:
                if text is None:
                    return None, None
                try:
                    return function(text, **chosen), None
                except StepError as error:
                    return None, str(error)
                except Exception as error:  # noqa: BLE001  one row's failure is nobody else's
                    return None, f"Unexpected problem: {error}"

            return pd.DataFrame([one(t) for t in texts], columns=["value", "error"], dtype=object)

        return tried(text)

    def run(df: DataFrame, **chosen) -> DataFrame:
        done = df.withColumn("text", guarded(F.col("text"), **chosen))
        return done.withColumn("text", F.coalesce("text.value", F.when(F.col("text.error").isNotNull(), F.raise_error(F.col("text.error"))).cast("string")))

    KINDS[name] = Kind(run, options, guarded=guarded)


@kind("clean", quotes=True, join_broken=True, unique_lines=False)
def _clean(df: DataFrame, **o) -> DataFrame:
    return df.withColumn("text", T.clean("text", **o))


@kind("html_to_text")
def _html(df: DataFrame) -> DataFrame:
    return df.withColumn("text", T.html_to_text("text"))


@kind("unique_lines")
def _unique(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.array_join(T.first_lines(F.split("text", "\n")), "\n"))


@kind("subtitles")
def _subtitles(df: DataFrame) -> DataFrame:
    return df.withColumn("text", T.subtitles_to_text("text"))


@kind("lower")
def _lower(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.lower("text"))


@kind("seconds", problem=lambda text: F.when(parse_time(text).isNull(), "Write a time as 90, 1:30 or 0:01:30.5"))
def _seconds(df: DataFrame) -> DataFrame:
    return df.withColumn("text", parse_time("text").cast("string"))


@kind("stats")
def _stats(df: DataFrame) -> DataFrame:
    return df.withColumn("stats", T.text_stats("text"))


@kind("sentences", many=True)
def _sentences(df: DataFrame) -> DataFrame:
    return df.select("*", F.posexplode(T.sentences("text")).alias("place", "sentence"))


@dataclass
class Step:
    kind: str
    options: dict = field(default_factory=dict)
    #: SQL condition; rows for which it doesn't hold pass the step unchanged
    only: str | None = None


@dataclass
class Recipe:
    name: str
    steps: list[Step] = field(default_factory=list)

    def problem(self) -> str | None:
        if not self.name.strip():
            return "The recipe has no name."
        if not self.steps:
            return "The recipe has no steps."
        for k, step in enumerate(self.steps):
            if step.kind not in KINDS:
                return f"Unknown step: {step.kind}"
            if KINDS[step.kind].many and k + 1 < len(self.steps):
                return f"{step.kind} makes several rows of one, so it can only stand last."
            if step.only and KINDS[step.kind].many:
                return f"{step.kind} can't be skipped row by row."
        return None

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "steps": [{"kind": s.kind, "options": s.options} | ({"only": s.only} if s.only else {}) for s in self.steps]}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Recipe:
        """Options that a step doesn't know are dropped."""
        held = json.loads(text)
        steps = [Step(s["kind"], {k: v for k, v in (s.get("options") or {}).items() if k in KINDS.get(s["kind"], Kind(None)).options}, s.get("only")) for s in held.get("steps", [])]
        return cls(held.get("name", ""), steps)

    def describe(self) -> str:
        """Each step with the options that aren't the usual ones."""
        said = []
        for s in self.steps:
            odd = [f"{k}={v}" for k, v in s.options.items() if KINDS[s.kind].options.get(k) != v]
            said.append(s.kind + (f" ({', '.join(odd)})" if odd else ""))
        return ", ".join(said)


def _apply(df: DataFrame, step: Step) -> DataFrame:
    done = KINDS[step.kind]
    out = done.run(df, **(done.options | step.options))
    if not step.only:
        return out
    # one expression a column: the new value where the condition holds, else the old one
    old = [c for c in df.columns]
    return done.run(df.withColumn("_old", F.struct(*old)).withColumn("_on", F.coalesce(F.expr(step.only), F.lit(False))), **(done.options | step.options)).select(
        *(F.when(F.col("_on"), F.col(c)).otherwise(F.col("_old")[c]).alias(c) if c in old else F.when(F.col("_on"), F.col(c)).alias(c) for c in out.columns)
    )


def run(df: DataFrame, recipe: Recipe) -> DataFrame:
    """All steps one after the other; raises on a recipe with a problem."""
    problem = recipe.problem()
    if problem:
        raise ValueError(problem)
    return reduce(_apply, recipe.steps, df)


def run_isolated(df: DataFrame, recipe: Recipe) -> DataFrame:
    """All steps, with ``stage`` (done, skipped, failed), ``error`` and ``failed_step`` (from 1): a row that fails stays as it was before that step.

    Every step gives a value or an error, and the steps behind pass an error on. A null
    that a step makes of a text is a value like any other. Skipped are rows that no step
    was for. Columns with these names are replaced. A last step of many rows gives a row
    that failed before it one row, with nulls.
    """
    problem = recipe.problem()
    if problem:
        raise ValueError(problem)
    state = {"error": F.lit(None).cast("string"), "failed_step": F.lit(None).cast("int"), "_worked": F.lit(False)}
    df = df.drop("stage").withColumns(state)
    for n, step in enumerate(recipe.steps, 1):
        what = KINDS[step.kind]
        chosen = what.options | step.options
        df = df.withColumn("_for", F.coalesce(F.expr(step.only), F.lit(False)) if step.only else F.lit(True)).withColumn("_for", F.col("_for") & F.col("error").isNull())
        said = what.problem(F.col("text")) if what.problem else F.lit(None).cast("string")
        df = df.withColumn("_error", F.when(F.col("_for"), said))
        if what.guarded:
            df = df.withColumn("_said", what.guarded(F.when(F.col("_for"), F.col("text")), **chosen)).withColumn("_error", F.coalesce("_error", "_said.error"))
            df = df.withColumn("text", F.when(F.col("_for") & F.col("_error").isNull(), F.col("_said.value")).otherwise(F.col("text"))).drop("_said")
        elif what.many:
            failed = df.where("not _for or _error is not null")
            df = what.run(df.where("_for and _error is null"), **chosen).unionByName(failed, allowMissingColumns=True)
        else:
            old = df.columns
            done = what.run(df.withColumn("_old", F.struct(*old)), **chosen)
            ok = F.col("_old._for") & F.col("_old._error").isNull()
            df = done.select(*(F.when(ok, F.col(c)).otherwise(F.col("_old")[c]).alias(c) if c in old else F.when(ok, F.col(c)).alias(c) for c in done.columns if c != "_old"))
        df = df.withColumns({"error": F.coalesce("error", "_error"), "failed_step": F.coalesce("failed_step", F.when(F.col("_error").isNotNull(), n)), "_worked": F.col("_worked") | F.col("_for")})
    stage = F.when(F.col("error").isNotNull(), "failed").when(F.col("_worked"), "done").otherwise("skipped")
    return df.withColumn("stage", stage).drop("_worked", "_for", "_error")


def isolated(df: DataFrame, value: Column, name: str, message: str) -> DataFrame:
    """With ``name`` and ``error``: a null where there was a source is that row's failure and nobody else's."""
    return df.withColumn(name, value).withColumn("error", F.when(F.col(name).isNull(), message))


def nested_progress(step: Column, steps: int, inner: Column) -> Column:
    """Progress in percent of a step's progress within a chain."""
    return (step * 100.0 + inner) / steps
