"""Written intermediates.

A stage that several branches read is written once to the shared checkpoint folder and
read back as a table, so that losing an executor costs a re-read and not a re-run.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names; a temporary one only for an unset local session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="fragloom-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the checkpoint folder and read back."""
    path = f"{checkpoint_dir(df.sparkSession)}/fragloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
