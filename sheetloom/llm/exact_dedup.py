"""Exact deduplication as a tree-merge of sorted digest runs, in DataFrame functions alone.

Every partition of the input makes one run: its digests, each once, with the best identifier, the count and the check
values of its texts. Runs then meet in rounds: in each of them `fan_in` neighbouring runs, a
power of two, are merged into one, each digest range by a task of its own, until one run is left, spread over its ranges. A digest takes part at most once per
run, so a text that is copied a million times weighs as much as one that is copied once. At every level the identifier is
kept only if the check values (a second digest and the length) of all merged texts agree; if they do not, the job fails. The
rows then learn what stays; digests of very many rows are broadcast for that, so that their rows do not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, spread_join


def digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text_sha256, `check` (length and a second digest) and the number of the run each row belongs to, in sorted runs."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"),
        F.sha2(whole, 256).alias("text_sha256"),
        F.struct(F.octet_length(whole).alias("bytes"), F.xxhash64(whole).alias("hash")).alias("check"),
        F.spark_partition_id().alias("run"),
    )
    return rows.sortWithinPartitions("text_sha256")


def merged(runs: DataFrame, fan_in: int, keep: str) -> DataFrame:
    """Merge every `fan_in` neighbouring runs into one. Check values must agree; one identifier of a digest is retained.

    The aggregate sorts each task's rows by run and digest and folds neighbours before the exchange, and merges the sorted
    rows of all tasks behind it.
    """
    best = F.max("key") if keep == "largest" else F.min("key")
    parent = F.floor(F.col("run") / F.lit(fan_in)).cast("int").alias("run")
    out = runs.groupBy(parent, "text_sha256").agg(best.alias("key"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    clash = F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("long")
    return out.withColumn("n", F.when(F.col("low") == F.col("high"), F.col("n")).otherwise(clash))


def keepers(rows: DataFrame, keep: str = "largest", fan_in: int = 8) -> DataFrame:
    """text_sha256, the key that stays (`key`) and the number of rows (`n`), one row per distinct text."""
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    level = rows.select("run", "text_sha256", "key", F.lit(1).cast("long").alias("n"), F.col("check").alias("low"), F.col("check").alias("high"))
    while True:
        level, runs = merged(level, fan_in, keep), -(-runs // fan_in)
        if runs == 1:
            return level.select("text_sha256", "key", "n")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "largest", fan_in: int = 8) -> DataFrame:
    """One row per input row: `key`'s column, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty. Of equal texts the row of the largest (or `keep="smallest"`)
    key stays. Rows that repeat the key and the text of the row that stays are all marked kept; null keys lose to others,
    and where all keys are null keep_id is null and every row of the group is kept. Other columns are left out. An empty
    table gives no rows.
    """
    rows = settle(digests(docs, key, text))
    best = settle(keepers(rows, keep, fan_in).select(F.col("text_sha256"), F.col("key").alias("keep_id"), F.col("n").alias("group_size")))
    out = spread_join(rows, best, ["text_sha256"], "group_size")
    return out.select(F.col("key").alias(key), "keep_id", "group_size", F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
