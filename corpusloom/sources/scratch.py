"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder from spark.checkpoint.dir; where that is unset a new local one, in local mode only."""
    home = spark.conf.get("spark.checkpoint.dir", None)
    if not home:
        sc = spark.sparkContext
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-loom-"))
        home = sc._jsc.sc().getCheckpointDir().get()
    return home.rstrip("/")


def new_path(spark: SparkSession, kind: str = "loom-steps") -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read back."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
