"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a fresh local one where none is set and the master is local."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or getattr(spark, "_priorday_shared", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="priorday-")
        spark._priorday_shared = path
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh path in the shared folder, which `clear` deletes unless it is to `keep`."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if not keep:
        spark.__dict__.setdefault("_priorday_written", set()).add(path)
    return path


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Cut lineage: write `df` as Parquet in the shared folder and read it back.

    The path is kept on the returned frame as `written_path` so that `forget`
    can drop a table that nothing reads any more. What a lazy result still reads
    stays until `clear`, which spares tables written to `keep`."""
    spark = df.sparkSession
    path = scratch(spark, name, keep)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")  # the shuffle files of this write are not read again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def exists(df: DataFrame) -> bool:
    """Whether the files of a table made by `written` are still there."""
    jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_path)
    return jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(jpath)


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by `written` that nothing reads any more."""
    df.sparkSession.__dict__.get("_priorday_written", set()).discard(df.written_path)
    _delete(df.sparkSession, df.written_path)


def clear(spark: SparkSession) -> None:
    """Delete all tables and scratch folders that this session has written on the way; call it once the results made from them are saved."""
    for path in spark.__dict__.pop("_priorday_written", set()):
        _delete(spark, path)
