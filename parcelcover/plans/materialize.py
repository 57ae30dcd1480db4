"""Cutting lineage with tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and all runs on one machine, a folder of our own. A
    cluster without that setting is an error: its executors wouldn't see each other's files."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-parcelcover-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written as Parquet to the shared folder and read again: a lost executor costs nothing already written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of a table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(df: DataFrame) -> None:
    """Deletes the files of a materialised table that nothing reads any more."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, parent)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the files of shuffles that no table needs any more.

    It does so once the driver has collected their objects as garbage, which a driver with little to do may not for
    a long time; a second collection takes what the first has only made free.
    """
    for pause in (0.3, 0.0):
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)
