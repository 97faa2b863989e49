"""What an operator needs from the cluster it runs on: a shared folder, written tables, shipped code."""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is missing, a temporary folder is used on a local master (one machine, so
    it is shared by definition); on a cluster that is an error.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = getattr(context, "_trailweave_dir", None)
    if own is None:
        own = context._trailweave_dir = tempfile.mkdtemp(prefix="trailweave-")
    return f"file://{own}"


#: For each thread the written tables of the operators that it computes, innermost last.
_SCOPES = threading.local()


def _scopes() -> list[list[DataFrame]]:
    if not hasattr(_SCOPES, "open"):
        _SCOPES.open = []
    return _SCOPES.open


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here.

    It goes at the end of the innermost ``scratch``, else with the application.
    """
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/trailweave/{spark.sparkContext.applicationId}"
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not getattr(spark.sparkContext, "_trailweave_leaves", False):
        files, folder = _path(spark, top)
        files.deleteOnExit(folder)
        spark.sparkContext._trailweave_leaves = True
    again = spark.read.schema(df.schema).parquet(path)
    again._trailweave_path = path
    if _scopes():
        _scopes()[-1].append(again)
    return again


def deleted(spark: SparkSession, name: str) -> None:
    """Deletes a folder."""
    files, path = _path(spark, name)
    files.delete(path, True)


def dropped(df: DataFrame) -> None:
    """Deletes what ``written`` wrote, once nothing reads it any more."""
    deleted(df.sparkSession, df._trailweave_path)


@contextmanager
def scratch():
    """Tables written inside are deleted at the end, but for those given to ``keep``.

        with scratch() as keep:
            found = keep(written(..., "found"))
    """
    own: list[DataFrame] = []
    kept: list[DataFrame] = []
    scopes = _scopes()
    scopes.append(own)
    try:
        yield lambda df: kept.append(df) or df
    finally:
        scopes.pop()
        for df in own:
            if not any(df is k for k in kept):
                dropped(df)
        if scopes:
            scopes[-1].extend(kept)


@contextmanager
def unscoped():
    """Tables written inside stay as long as the application."""
    scopes = _scopes()
    own, scopes[:] = list(scopes), []
    try:
        yield
    finally:
        scopes[:] = own


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that nothing refers to, which no call deletes."""
    gc.collect()
    spark._jvm.System.gc()


def shipped(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_trailweave_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="trailweave-"), "trailweave.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    context.addPyFile(target)
    context._trailweave_shipped = True
