"""Rule-based page scoring: weighted vocabulary terms, each counted once per page, in one projection without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.terms import NEGATIVE, POSITIVE

Term = tuple[str, float, str, str]
MODES = ("case_insensitive", "case_sensitive", "regex")
LEVELS = ((20.0, "high"), (10.0, "medium"), (3.0, "low"))
SHORT_REASON = "-3: very short extracted text"


def term_matches(text: Column, low: Column, term: str, mode: str) -> Column:
    if mode == "case_insensitive":
        return low.contains(term.lower())
    if mode == "case_sensitive":
        return text.contains(term)
    if mode == "regex":
        return text.rlike(f"(?imU){term}")
    raise ValueError(f"unknown match mode {mode!r}; known: {', '.join(MODES)}")


def level_of(score: Column) -> Column:
    out = F.lit("irrelevant")
    for least, name in reversed(LEVELS):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out


def hit(text: Column, low: Column, term: Term, negative: bool) -> Column:
    name, weight, category, mode = term
    words = f"{weight:g}: matched {category} term '{name}'" if negative else f"+{weight:g}: matched {category} term '{name}'"
    found = F.struct(F.lit(name).alias("term"), F.lit(float(weight)).alias("weight"), F.lit(category).alias("category"), F.lit(words).alias("reason"), F.lit(negative).alias("negative"))
    return F.when(term_matches(text, low, name, mode), found)


def score_pages(pages: DataFrame, positive: list[Term] | None = None, negative: list[Term] | None = None) -> DataFrame:
    """source_file, page_number, score, relevance_level, char_count, matched_terms, matched_categories and the reasons.

    `pages` has source_file, page_number, text, char_count. No or empty term lists mean the default ones. Weights are added
    from left to right in the order of the terms, as doubles: the level is decided on the unrounded sum.
    """
    terms = [(t, False) for t in positive or POSITIVE] + [(t, True) for t in negative or NEGATIVE]
    text = F.coalesce(F.col("text"), F.lit(""))
    base = pages.select("source_file", "page_number", text.alias("text"), F.lower(text).alias("low"), F.coalesce(F.col("char_count"), F.length(text)).alias("char_count"))
    found = base.withColumn("hits", F.filter(F.array(*(hit(F.col("text"), F.col("low"), t, n) for t, n in terms)), lambda h: h.isNotNull()))
    added = F.aggregate("hits", F.lit(0.0), lambda total, h: total + h["weight"])
    summed = found.withColumn("sum", added).withColumn("short", F.col("char_count") < 100)
    raw = summed.withColumn("raw", F.greatest(F.when(F.col("short"), F.col("sum") - 3.0).otherwise(F.col("sum")), F.lit(0.0)))
    reasons = lambda negative: F.transform(F.filter("hits", lambda h: h["negative"] == negative), lambda h: h["reason"])
    return raw.select(
        "source_file",
        "page_number",
        F.round("raw", 2).alias("score"),
        level_of(F.col("raw")).alias("relevance_level"),
        "char_count",
        F.transform("hits", lambda h: h["term"]).alias("matched_terms"),
        F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["category"]))).alias("matched_categories"),
        reasons(False).alias("positive_reasons"),
        F.concat(reasons(True), F.when(F.col("short"), F.array(F.lit(SHORT_REASON))).otherwise(F.array().cast("array<string>"))).alias("negative_reasons"),
    )


def score_with(pages: DataFrame, scorer, model: str = "recorded") -> DataFrame:
    """Pages scored by an injected callable, one instance per task: text -> mapping with score, relevance_level,
    useful_for_extraction, likely_content_type, extraction_targets_found and reasoning. Scores outside 0..100 raise."""
    import pandas as pd

    fields = ["relevance_level", "useful_for_extraction", "likely_content_type", "extraction_targets_found", "reasoning"]

    def run(batches):
        for batch in batches:
            found = [scorer(truncated(t)) for t in batch["text"]]
            if bad := [x for x in found if not 0 <= float(x["score"]) <= 100]:
                raise ValueError(f"score outside 0..100: {bad[0]['score']}")
            out = batch[["source_file", "page_number", "char_count"]].copy()
            out["score"] = [round(float(x["score"]), 2) for x in found]
            for f in fields:
                out[f] = pd.Series([x.get(f, [] if f == "extraction_targets_found" else None) for x in found], index=out.index, dtype=object)
            yield out.assign(llm_model=model)

    return pages.mapInPandas(run, "source_file string, page_number int, char_count int, score double, relevance_level string, useful_for_extraction boolean, likely_content_type string, extraction_targets_found array<string>, reasoning string, llm_model string")


def truncated(text: str | None, most: int = 3500) -> str:
    """What a model sees of a page."""
    text = text or ""
    return text if len(text) <= most else text[:most] + "\n\n[TRUNCATED]"
