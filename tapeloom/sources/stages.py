"""Stored stages: results that several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder that all machines of the session share: under the checkpoint folder,
    else under the warehouse if that is no local folder.  A local folder serves only a
    session on one machine; any other session without a shared folder is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    warehouse = spark.conf.get("spark.sql.warehouse.dir", "")
    if not shared and not warehouse.startswith(("file:", "/")) and "://" in warehouse:
        shared = warehouse
    if shared:
        return f"{shared.rstrip('/')}/scratch-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="run-")


def stage(df: DataFrame) -> DataFrame:
    """Write a result that several later steps read, and read it back.

    The table goes to the shared folder, so a lost executor costs nothing, the plan
    behind it is not repeated per reader, and readers get real sizes and pruned columns.
    """
    path = f"{scratch(df.sparkSession)}/stage"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
