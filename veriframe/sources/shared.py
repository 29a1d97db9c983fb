"""Tables cut to the folder that all executors share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only where that is unset and all runs in one process, as in tests, one of our own;
    on a cluster that is an error, since executors wouldn't see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (folder or os.path.join(tempfile.gettempdir(), "veriframe-checkpoints")).rstrip("/")


def remove_cuts(spark: SparkSession) -> None:
    """Delete all tables that this application has cut; DataFrames made from them can't be used any more."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet; ``remove_cuts`` deletes it."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nobody holds any more, now and not when the driver next collects garbage.

    Worth calling after a large table has been cut: what it was made from is read no more. Twice, as a plan that has only just ended may
    outlive the first collection.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that plans that use it often don't compute it often.

    A lost executor costs no more than the tasks it ran. Files live under ``<shared>/<application id>/``; ``remove_cuts``
    deletes them.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
