"""Writers: parquet or JSON tables, and one nested JSON document per source file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nested(rows: DataFrame, name: str, order: list[str], summary: DataFrame | None = None, **constants: str) -> DataFrame:
    """One row per source_file: constants, the summary's columns as `summary`, and the file's rows in order as `name`."""
    inner = F.struct(*(F.col(c) for c in order), *(F.col(c) for c in rows.columns if c not in {"source_file", *order}))
    out = rows.groupBy("source_file").agg(F.array_sort(F.collect_list(inner)).alias(name))
    if summary is not None:
        out = out.join(summary.select("source_file", F.struct(*(c for c in summary.columns if c != "source_file")).alias("summary")), "source_file")
    return out.select("source_file", *(F.lit(v).alias(k) for k, v in constants.items()), *(["summary"] if summary is not None else []), name)


def page_document(pages: DataFrame) -> DataFrame:
    """Page texts in the shape that the JSON source reads."""
    out = nested(pages.select("source_file", "page_number", "text", "char_count"), "pages", ["page_number"], extraction_method="pypdf")
    return out.withColumn("page_count", F.size("pages"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line; null fields are written."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", by: tuple[str, ...] = ()) -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)


def score_document(scores: DataFrame, method: str, model: str | None = None) -> DataFrame:
    """Rule or model scores, one document per file."""
    extra = {"scoring_method": method} | ({"llm_model": model} if model else {})
    return nested(scores, "pages", ["page_number"], **extra)


def comparison_document(compared: DataFrame, summary: DataFrame) -> DataFrame:
    return nested(compared, "pages", ["page_number"], summary, comparison_method="rule_based_vs_llm_based_v1")


def selection_document(selected: DataFrame, summary: DataFrame) -> DataFrame:
    return nested(selected, "pages", ["page_number"], summary)


def layout_document(blocks: DataFrame, backend: str) -> DataFrame:
    """Blocks of a file in reading order; null boxes are kept."""
    out = nested(blocks, "blocks", ["page_number", "reading_order", "block_index"], layout_backend=backend)
    return out.withColumn("page_count", F.coalesce(F.array_max(F.transform("blocks", lambda b: b["page_number"])), F.lit(0)))


def check_report(checks: DataFrame, summary: DataFrame, kind: str) -> DataFrame:
    """One row: validation_type, passed, summary and the checks."""
    listed = checks.agg(F.array_sort(F.collect_list(F.struct(*checks.columns))).alias("checks"))
    whole = summary.select("passed", F.struct("total_checks", "passed_checks", "failed_checks").alias("summary"))
    return whole.crossJoin(listed).select(F.lit(kind).alias("validation_type"), "passed", "summary", "checks")  # one row each
