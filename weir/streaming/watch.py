"""Files that are new and have stopped changing, each version once.

A look at a folder is rows (tick, path, size, modified). A path is emitted when two
looks in a row show the same size (above 0) and time and that version wasn't emitted
yet; a path that goes is forgotten.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import hidden_or_temporary


def stable_batch(looks: DataFrame, *, include_existing: bool = False) -> DataFrame:
    """``tick``, ``path``, ``size``, ``modified`` of each emission, over all looks at once.

    Ticks are whole numbers; one that a path lacks means that it was gone. A version
    is emitted at its second look in a row. Without ``include_existing`` a version that
    the first tick of all shows isn't emitted while it stays.
    """
    w = Window.partitionBy("path").orderBy("tick")
    fresh = ~F.coalesce((F.lag("tick").over(w) == F.col("tick") - 1) & (F.lag("size").over(w) == F.col("size")) & (F.lag("modified").over(w) == F.col("modified")), F.lit(False))
    rows = looks.withColumn("version", F.sum(fresh.cast("int")).over(w))
    at = F.row_number().over(Window.partitionBy("path", "version").orderBy("tick"))
    began = F.min("tick").over(Window.partitionBy("path", "version"))
    rows = rows.withColumn("at", at).withColumn("began", began)
    if not include_existing:
        first = looks.agg(F.min("tick").alias("first"))
        rows = rows.crossJoin(F.broadcast(first)).where("began > first")  # one row is broadcast
    return rows.where("at = 2 and size > 0").select("tick", "path", "size", "modified")


OUT = "tick long, path string, size long, modified double"
STATE = "tick long, size long, modified double, done boolean"


def _emit(key: tuple, frames: Iterator[pd.DataFrame], state: Any, baseline: int | None, forget_ms: int) -> Iterator[pd.DataFrame]:
    (path,) = key
    if state.hasTimedOut:
        # no look has shown the path for so long: it is gone
        state.remove()
        return
    tick, size, modified, done = state.get if state.exists else (None, None, None, False)
    out = []
    for row in pd.concat(list(frames)).sort_values("tick").itertuples():
        same = tick is not None and row.tick == tick + 1 and (size, modified) == (row.size_, row.modified)
        done = (done and same) or (baseline is not None and row.tick <= baseline)
        if same and not done and row.size_ > 0:
            out.append((row.tick, path, row.size_, row.modified))
            done = True
        tick, size, modified = int(row.tick), int(row.size_), float(row.modified)
    state.update((tick, size, modified, done))
    state.setTimeoutDuration(forget_ms)
    yield pd.DataFrame(out, columns=["tick", "path", "size", "modified"])


def stable_stream(looks: DataFrame, extensions: list[str] = (), *, baseline: int | None = None, forget_ms: int = 3_600_000) -> DataFrame:
    """The same over a stream of looks: a state for each path, kept in the checkpoint, so a restart repeats nothing.

    Hidden and temporary names are left out; ``extensions``: only those endings. ``baseline``: the last tick whose
    paths are taken for done while they stay as they are (None: none is, as with ``include_existing``). A path that
    no look shows for ``forget_ms`` is forgotten, so the state holds what is there and not what ever was; one that
    comes back sooner but lacks a tick is new as well.
    """
    name = F.substring_index("path", "/", -1)
    rows = looks.where(~hidden_or_temporary(name))
    if extensions:
        rows = rows.where(F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).isin(extensions))
    rows = rows.select(F.col("tick").cast("long"), "path", F.col("size").cast("long").alias("size_"), F.col("modified").cast("double"))
    work = functools.partial(_emit, baseline=baseline, forget_ms=forget_ms)
    return rows.groupBy("path").applyInPandasWithState(work, OUT, STATE, "append", "ProcessingTimeTimeout")


def run_each(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "3 seconds"):
    """Starts a query that hands every batch of emissions to ``work``."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def windowed(events: DataFrame, *, time: str = "ts", size: str = "1 hour", late: str = "10 minutes", keys: list[str] = (), value: str = "value") -> DataFrame:
    """An addition of this library: counts and sums by time window, batch or stream, late rows up to the watermark."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", *, key: str, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """An addition of this library: sessions of a key with less than ``gap`` between events."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
