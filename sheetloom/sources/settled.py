"""Tables that are written once in the folder that all executors share, and read again."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to this many rows of a few short columns are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


@functools.cache
def own_folder() -> str:
    return tempfile.mkdtemp(prefix="settled-")


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, or a folder of this process where that is unset and everything runs in it."""
    context = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return folder
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return own_folder()


#: Whether shuffle files of a query are removed when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """Write `df` and read it again. What it shuffled is removed from disk at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame) -> DataFrame:
    """Hint a settled table for broadcast if its count allows that."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
