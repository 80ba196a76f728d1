"""Tables in the folder that driver and executors share, to cut lineage and to fix what later steps read."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the session's checkpoint folder; only where both are unset, as in tests, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return folder or (current.get() if current.isDefined() else "file://" + os.path.join(tempfile.gettempdir(), "checkpoints"))


def stored(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """`df` as a table; `schema`: what it is read as, where that isn't its own (a user-defined type)."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)
