"""Page texts: from PDF files, from JSON documents, and as parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise_page

PAGES = "source_file string, page_number int, text string, char_count int"
DOCUMENT = "source_file string, page_count int, extraction_method string, pages array<struct<page_number:int,text:string,char_count:int>>"


def page_texts(raw: DataFrame) -> DataFrame:
    """Normalised pages of `raw` (source_file, page_number, text), with their lengths in code points."""
    text = normalise_page(F.col("text"))
    return raw.select("source_file", F.col("page_number").cast("int").alias("page_number"), text.alias("text"), F.length(text).alias("char_count"))


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Pages of documents of one JSON object per file, or per line. A missing path, and JSON that does not parse, raise."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    page = docs.select("source_file", F.explode("pages").alias("p"))
    return page.select("source_file", "p.page_number", F.coalesce("p.text", F.lit("")).alias("text"), F.coalesce("p.char_count", F.length("p.text"), F.lit(0)).alias("char_count"))


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """Pages of the PDF files under `path`, one row per page from 1. Needs the optional pypdf on the executors; other
    suffixes are an error."""
    files = spark.read.format("binaryFile").load(path)
    if wrong := files.where(~F.lower("path").endswith(".pdf")).select("path").first():
        raise ValueError(f"expected a .pdf file, got: {wrong.path}")

    def run(batches):
        import io

        import pandas as pd
        from pypdf import PdfReader

        for batch in batches:
            rows = [(p, i, page.extract_text()) for p, content in zip(batch["path"], batch["content"], strict=True) for i, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1)]
            yield pd.DataFrame(rows, columns=["source_file", "page_number", "text"])

    return page_texts(files.select("path", "content").mapInPandas(run, "source_file string, page_number int, text string"))


def extraction_summary(pages: DataFrame) -> DataFrame:
    empty = F.col("char_count") == 0
    return pages.groupBy("source_file").agg(F.count("*").alias("page_count"), F.sum("char_count").alias("total_chars"), F.sort_array(F.collect_list(F.when(empty, F.col("page_number")))).alias("empty_pages"))


def read_nested(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Rows of nested documents: source_file and the fields of each of its `pages`, as `schema` gives them."""
    whole = f"source_file string, pages array<struct<{', '.join(f.replace(' ', ':', 1) for f in schema.split(', '))}>>"
    docs = spark.read.schema(whole).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    return docs.select("source_file", F.explode("pages").alias("p")).select("source_file", "p.*")


#: Fields of a page in score and comparison documents.
RULE_SCORES = "page_number int, score double, relevance_level string, char_count int, matched_terms array<string>, matched_categories array<string>, positive_reasons array<string>, negative_reasons array<string>"
MODEL_SCORES = "page_number int, score double, relevance_level string, char_count int, useful_for_extraction boolean, likely_content_type string, extraction_targets_found array<string>, reasoning string"
COMPARISON = "page_number int, rule_based_score double, rule_based_level string, rule_based_selected boolean, rule_based_rank int, llm_score double, llm_level string, llm_selected boolean, llm_rank int, llm_useful_for_extraction boolean, llm_likely_content_type string, agreement_on_level boolean, agreement_on_selection boolean"
