"""Cut lineage by writing tables into the folder that all executors share."""

from __future__ import annotations

import atexit
import functools
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tallyfold-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own where none is named and driver and executors are one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return named or _own_dir()


@functools.cache
def _app_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one. What nothing has discarded goes with the driver."""
    path = os.path.join(shared_dir(spark), "tallyfold", spark.sparkContext.applicationId)

    def clear() -> None:
        if spark.sparkContext._jsc is not None:  # else the session was stopped before
            _delete(spark, path)

    atexit.register(clear)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: a lost executor then costs no recomputation."""
    spark = df.sparkSession
    path = os.path.join(_app_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyfold_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by materialize() that nothing reads any longer."""
    path = getattr(df, "_tallyfold_path", None)
    if path:
        _delete(df.sparkSession, path)
        df._tallyfold_path = None


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are done: it acts when the driver collects garbage, and needs a moment."""
    import gc
    import time

    for _ in range(2):  # the first round frees what Python's objects held in the JVM
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def _rows_as_read(df: DataFrame) -> bool:
    """Whether df is one table of files, with rows and columns left out at most."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.children().isEmpty() and plan.nodeName() == "LogicalRelation"


def row_key(df: DataFrame) -> tuple[DataFrame, list[Column]]:
    """df, and two columns (file, row) that tell its rows apart: the hash of a row's file, and its place there.

    Rows keep their key however often they are read, in whatever tasks. A df that is more than a table of files,
    less some rows and columns, is written to the shared folder first.
    """

    def key() -> list[Column]:
        meta = df.metadataColumn("_metadata")
        return [F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("row")]

    try:
        if _rows_as_read(df):
            df.select(*key()).schema  # noqa: B018 (analysis tells whether the format numbers its rows)
            return df, key()
    except AnalysisException:
        pass
    df = materialize(df, "rows")
    return df, key()
