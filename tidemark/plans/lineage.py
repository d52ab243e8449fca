"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder(application: str) -> str:
    """A temporary folder for a session on one machine; it goes when the driver ends."""
    path = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir, without which only a local master has a folder that all its tasks see."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_folder(spark.sparkContext.applicationId)


def shared_dir(spark: SparkSession, name: str = "tidemark") -> str:
    """The path of a new folder under the shared one."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, kept when executors are lost, read by column.

    Like checkpoints, the tables stay there after the session; clearing spark.checkpoint.dir is the cluster's affair.
    """
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A loop's step: its plan begins at the table.
cut = written
