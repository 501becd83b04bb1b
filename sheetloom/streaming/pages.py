"""Pages as a stream: the stateless operators run on it as they are, and counts by time window allow for late pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import score_pages
from ..sources.pages import page_texts


def read_pages(spark: SparkSession, path: str, schema: str = "source_file string, page_number int, text string, ts timestamp", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def scored(stream: DataFrame, **terms) -> DataFrame:
    """Each page of the stream, scored; no state is kept."""
    return score_pages(page_texts(stream), **terms)


def pages_by_window(stream: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Pages and characters by time window and file; pages later than `late` are left out of closed windows."""
    timed = stream.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "source_file").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "source_file", "pages", "chars")
