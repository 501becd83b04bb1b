"""The corpus pipeline: language ID, exact dedup, n-gram Jaccard join, packing. Part of the subpackage llm.

Every stage works on all that its predecessor kept; between stages the rows are written as Parquet in the folder that all
executors share and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sheetloom.llm.common import shared_folder, table
from sheetloom.llm.stages import exact, languages, near, packed

STAGES = [("language_id", languages), ("exact_dedup", exact), ("ngram_join", near), ("packing", packed)]

#: Language models, tokenizers and set similarity are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
