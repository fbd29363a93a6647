"""Where lineage is cut and files are put: the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this driver's own, by path, with a session that can delete them; they go when it ends.
_own: dict[str, SparkSession] = {}


def _goes_at_end(spark: SparkSession, path: str) -> None:
    if not _own:
        atexit.register(clear)
    _own[path] = spark


def clear() -> None:
    """Deletes what ``cut`` and ``folder`` have written: for when results have been read, and at the driver's end."""
    while _own:
        path, spark = _own.popitem()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended: the folder goes by its owner's rule
            continue


def root(spark: SparkSession) -> str:
    """This application's part of the folder that ``spark.checkpoint.dir`` names.

    Where that is unset a local session gets a temporary one; on a cluster, whose machines would not see it, this is an error.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            top = "file://" + tempfile.mkdtemp(prefix="weir-")
        context.setCheckpointDir(top)
        held = context._jsc.sc().getCheckpointDir()
    # Spark gives each application a folder of its own below the one that is named
    _goes_at_end(spark, held.get())
    return held.get()


def folder(spark: SparkSession, what: str) -> str:
    """The path of a folder that isn't there yet, for files of this driver only."""
    return f"{root(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from it: later steps see the same rows, and a lost executor costs a re-read.

    A table and not ``checkpoint()``: a checkpoint hands on all that the planner knew of the rows, which grows with each round of a loop.
    """
    path, schema = folder(df.sparkSession, "cut"), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
