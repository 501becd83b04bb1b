"""Comparison of two page scorers and selection of pages under three strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["source_file", "page_number"]
STRATEGIES = ("union", "intersection", "hybrid")

# Notes and reasons.
NOTES = {
    "agree": "Both methods agree on relevance level and selection.",
    "level": "Both methods agree on selection, but assign different relevance levels.",
    "rule": "Rule-based scorer selects this page, but LLM-based scorer does not.",
    "llm": "LLM-based scorer selects this page, but rule-based scorer does not.",
}
BOTH = "both scorers selected this page."
NEITHER = "Discarded because neither scorer selected this page."
ONE = {"rule": "the rule-based scorer selected this page.", "llm": "the LLM-based scorer selected this page."}


def ranked(scores: DataFrame) -> DataFrame:
    """Unique rank of each page in its file: higher scores first, ties by page number."""
    order = Window.partitionBy("source_file").orderBy(F.desc("score"), F.asc("page_number"))
    return scores.withColumn("rank", F.row_number().over(order))


def page_mismatches(rule: DataFrame, llm: DataFrame) -> DataFrame:
    """source_file, page_number, missing_in: pages that only one scorer has, and keys that a scorer repeats."""
    missing = lambda a, b, name: a.select(*KEYS).distinct().join(b.select(*KEYS), KEYS, "left_anti").withColumn("missing_in", F.lit(name))
    return missing(llm, rule, "rule-based").unionByName(missing(rule, llm, "LLM-based"))


def repeated_pages(scores: DataFrame) -> DataFrame:
    return scores.groupBy(*KEYS).agg(F.count("*").alias("n")).where("n > 1")


def compare_scores(rule: DataFrame, llm: DataFrame) -> DataFrame:
    """One row per page that both scorers have, with ranks, differences, agreement and a note."""
    chosen = lambda c: F.col(c).isin("high", "medium")
    a = ranked(rule).select(*KEYS, F.round("score", 2).alias("rule_based_score"), F.col("score").alias("_rule"), F.col("relevance_level").alias("rule_based_level"), F.col("rank").alias("rule_based_rank"), F.col("matched_categories").alias("rule_based_matched_categories"))
    b = ranked(llm).select(*KEYS, F.round("score", 2).alias("llm_score"), F.col("score").alias("_llm"), F.col("relevance_level").alias("llm_level"), F.col("rank").alias("llm_rank"), F.coalesce("useful_for_extraction", F.lit(False)).alias("llm_useful_for_extraction"), F.coalesce("likely_content_type", F.lit("")).alias("llm_likely_content_type"), F.coalesce("extraction_targets_found", F.array().cast("array<string>")).alias("llm_extraction_targets_found"))
    both = a.join(b, KEYS).withColumn("rule_based_selected", chosen("rule_based_level")).withColumn("llm_selected", chosen("llm_level"))
    both = both.withColumn("agreement_on_level", F.col("rule_based_level") == F.col("llm_level")).withColumn("agreement_on_selection", F.col("rule_based_selected") == F.col("llm_selected"))
    note = (
        F.when(F.col("agreement_on_selection") & F.col("agreement_on_level"), NOTES["agree"])
        .when(F.col("agreement_on_selection"), NOTES["level"])
        .when(F.col("rule_based_selected"), NOTES["rule"])
        .otherwise(NOTES["llm"])
    )
    return both.select(
        *KEYS, "rule_based_score", "rule_based_level", "rule_based_selected", "rule_based_rank", "llm_score", "llm_level", "llm_selected", "llm_rank",
        "llm_useful_for_extraction", "llm_likely_content_type", "agreement_on_level", "agreement_on_selection",
        (F.col("rule_based_rank") - F.col("llm_rank")).alias("rank_difference"), F.round(F.col("_llm") - F.col("_rule"), 2).alias("score_difference_raw"),
        "rule_based_matched_categories", "llm_extraction_targets_found", note.alias("comparison_note"),
    )


def checked_comparison(rule: DataFrame, llm: DataFrame) -> DataFrame:
    """`compare_scores`, but differing page sets or repeated pages raise."""
    for label, scores in (("rule-based", rule), ("LLM-based", llm)):
        if twice := repeated_pages(scores).first():
            raise ValueError(f"{label} scores repeat page {twice.page_number} of {twice.source_file}")
    if lone := page_mismatches(rule, llm).orderBy(*KEYS).first():
        raise ValueError(f"page sets do not match: page {lone.page_number} of {lone.source_file} is missing in the {lone.missing_in} scores")
    return compare_scores(rule, llm)


def paired(rule: DataFrame, llm: DataFrame) -> DataFrame:
    """`llm` with its file's name as llm_source_file. Where each side holds one file and the names differ, its pages go under
    the rule-based name, so that two scores of one document meet; of several files, those of equal names meet."""
    one = lambda scores: scores.select("source_file").distinct().limit(2).collect()
    own = llm.withColumn("llm_source_file", F.col("source_file"))
    a, b = one(rule), one(llm)
    return own.withColumn("source_file", F.lit(a[0].source_file)) if len(a) == len(b) == 1 else own


def pages_where(condition: Column) -> Column:
    """Ascending page numbers where `condition` holds."""
    return F.sort_array(F.collect_list(F.when(condition, F.col("page_number"))))


def comparison_summary(compared: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row per source file: counts of (dis)agreement, the page lists, and whether both scorers named the file alike.

    `files` (source_file, llm_source_file) has the model's name of each file; without it the names are the same.
    """
    rule, llm = F.col("rule_based_selected"), F.col("llm_selected")
    level, selection = F.col("agreement_on_level"), F.col("agreement_on_selection")
    out = compared.groupBy("source_file").agg(
        F.count("*").alias("page_count"),
        F.count_if(level).alias("agreement_on_level_count"),
        F.count_if(selection).alias("agreement_on_selection_count"),
        F.count_if(~level).alias("disagreement_on_level_count"),
        F.count_if(~selection).alias("disagreement_on_selection_count"),
        pages_where(~level).alias("pages_with_level_disagreement"),
        pages_where(~selection).alias("pages_with_selection_disagreement"),
        pages_where(rule).alias("rule_based_selected_pages"),
        pages_where(llm).alias("llm_based_selected_pages"),
        pages_where(rule & llm).alias("intersection_selected_pages"),
        pages_where(rule & ~llm).alias("rule_only_selected_pages"),
        pages_where(llm & ~rule).alias("llm_only_selected_pages"),
    )
    named = out.withColumn("llm_source_file", F.col("source_file")) if files is None else out.join(files, "source_file", "left")
    same = F.col("source_file").eqNullSafe(F.col("llm_source_file"))
    return named.withColumn("rule_based_source_file", F.col("source_file")).withColumn("same_source_file", same).withColumnRenamed("llm_source_file", "llm_based_source_file")


def strategy_of(name: str) -> str:
    found = name.strip().lower()
    if found not in STRATEGIES:
        raise ValueError(f"unsupported selection strategy {name!r}; expected one of {', '.join(STRATEGIES)}")
    return found


def select_pages(compared: DataFrame, strategy: str = "hybrid") -> DataFrame:
    """Each compared page with selection_status, selected_for_extraction, selection_strategy and decision_reason."""
    name = strategy_of(strategy)
    rule, llm = F.col("rule_based_selected"), F.col("llm_selected")
    either = F.when(rule, ONE["rule"]).otherwise(ONE["llm"])
    if name == "union":
        status, lone = ("selected", "selected"), F.concat(F.lit("Selected because "), either)
    elif name == "intersection":
        status, lone = ("selected", "discarded"), F.concat(F.lit("Discarded because only "), either)
    else:
        status, lone = ("selected_primary", "selected_secondary"), F.concat(F.lit("Selected as secondary because only "), either)
    first = "Selected as primary because " if name == "hybrid" else "Selected because "
    out = compared.withColumn("selection_status", F.when(rule & llm, status[0]).when(rule | llm, status[1]).otherwise("discarded"))
    why = F.when(rule & llm, first + BOTH).when(rule | llm, lone).otherwise(NEITHER)
    return out.select(
        *KEYS, "selection_status", (F.col("selection_status") != "discarded").alias("selected_for_extraction"), F.lit(name).alias("selection_strategy"),
        "rule_based_selected", "rule_based_level", "rule_based_score", "rule_based_rank", "llm_selected", "llm_level", "llm_score", "llm_rank",
        "llm_useful_for_extraction", "llm_likely_content_type", "agreement_on_selection", "agreement_on_level", why.alias("decision_reason"),
    )


def selection_summary(selected: DataFrame) -> DataFrame:
    """One row per source file and strategy; a plain `selected` counts as primary."""
    took, status = F.col("selected_for_extraction"), F.col("selection_status")
    return selected.groupBy("source_file", F.col("selection_strategy").alias("strategy")).agg(
        F.concat(F.lit("page_selection_"), F.first("selection_strategy"), F.lit("_v1")).alias("selection_method"),
        F.count("*").alias("page_count"),
        F.count_if(took).alias("selected_page_count"),
        F.count_if(~took).alias("discarded_page_count"),
        pages_where(took).alias("selected_pages"),
        pages_where(status.isin("selected", "selected_primary")).alias("selected_primary_pages"),
        pages_where(status == "selected_secondary").alias("selected_secondary_pages"),
        pages_where(~took).alias("discarded_pages"),
    )
