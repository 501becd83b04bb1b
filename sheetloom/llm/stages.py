"""Stages of the corpus pipeline: language ID, exact dedup, n-gram Jaccard join, packing.

Each takes (spark, docs, sf_dir) and returns a table; all but the last keep the columns of `documents`, and drop others.
Identifiers may be null or repeated: every decision is about a row. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language_id, ngram_join, packing
from .common import settle, small_side

#: A text is rejected if its words on the mean speak for its best language with less than this share of the probability.
LEAST_SCORE = 0.45

#: Bytes of each of the two generations of a worker's cache in packing: some 190,000 usual words.
PACKING_CACHE = 32 << 20


def columns(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", "lang", "source", "n_chars")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and a clear language stay; those without text or letters go.

    Where no row teaches a language (no labels at all, or only beside texts without words) none can be unclear: all texts with
    letters stay.
    """
    model = language_id.fit(docs, F.lit(True))
    if not model.langs:
        return columns(docs.where(F.col("text").rlike(r"\p{L}")))
    kept = language_id.identify(columns(docs), model, pred="_lang_pred", score="_lang_score")
    return columns(kept.where((F.col("_lang_pred") != language_id.UNDETERMINED) & (F.col("_lang_score") >= LEAST_SCORE)))


def marked(docs: DataFrame) -> DataFrame:
    """With the digest of each text, as exact_dedup has it. It names a row together with the doc_id, which may be null or repeated."""
    return columns(docs).withColumn("_digest", F.sha2(F.coalesce("text", F.lit("")), 256))


def named(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Rows of marked `docs` that `rows` (doc_id, text_sha256) name, or do not (`how`: left_semi, left_anti). The names are
    broadcast if their count allows that; texts then stay put."""
    names = small_side(settle(rows.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()))
    return docs.join(names, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_sha")), how)


def once(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """`docs` with one row for each name that `rows` (doc_id, text_sha256) repeats: the least by text, lang, source, n_chars."""
    repeated = settle(rows.groupBy("doc_id", "text_sha256").count().where("count > 1"))
    if repeated.isEmpty():
        return columns(docs)
    least = F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")
    one = named(marked(docs), repeated, "left_semi").groupBy("doc_id", "_digest").agg(least).select("doc_id", "row.*")
    return columns(named(marked(docs), repeated, "left_anti")).unionByName(columns(one))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row stays: that of the largest doc_id, null if all are; of several such, the least by lang, source, n_chars."""
    decided = settle(exact_dedup.dedup(docs))
    return once(named(marked(docs), decided.where("not kept"), "left_anti"), decided.where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8), one row stays: that of the smallest doc_id, a null
    one last; of several such, the one of the smallest text digest. Rows that repeat doc_id and text count as one; texts
    without words are no near-duplicates and stay."""
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():  # then a doc_id, null included, is one row
        gone = small_side(settle(ngram_join.groups(docs).where("not (doc_id <=> component_id)").select(F.col("doc_id").alias("_id"))))
        return columns(docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti"))
    rows = marked(settle(once(docs, marked(docs).select("doc_id", F.col("_digest").alias("text_sha256")))))
    found = ngram_join.groups(rows, key="_digest").where("n_shingles > 0").select(F.col("_digest").alias("text_sha256"), "component_id").distinct()
    members = settle(rows.select("doc_id", F.col("_digest").alias("text_sha256")).join(settle(found), "text_sha256"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_sha256")
    first = members.groupBy("component_id").agg(F.min(place).alias("first"))
    gone = members.join(first, "component_id").where(~place.eqNullSafe(F.col("first")))
    return columns(named(rows, gone, "left_anti"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 4096 tokens. The cache is smaller than by default, and bounded in bytes: executors hold
    what other stages have used too, and words may be long."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache_size=500_000, cache_bytes=PACKING_CACHE)
