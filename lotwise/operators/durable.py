"""Materialised intermediate results that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names; a local session may make its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="lotwise-checkpoint-")
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a table that several later steps read."""
    spark = df.sparkSession
    folder = checkpoint_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def store(df: DataFrame) -> DataFrame:
    """The table written once under the checkpoint folder and read back.

    For wide tables that many reports read: Parquet hands every reader only the
    columns it asks for, where a checkpoint would hand it whole rows.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/lotwise-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def written_order() -> Column:
    """Place of a row in a stored table: the order it was written in, however it is read."""
    return F.struct("_metadata.file_name", "_metadata.row_index")
