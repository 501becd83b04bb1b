"""Graph-shaped extraction documents as documents, nodes and relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import canonical_json

SCHEMA = (
    "schema_version string, document_id string, source_file string, extraction_scope string, description string, "
    "nodes array<struct<id:string,labels:array<string>,properties:variant>>, "
    "relationships array<struct<source:string,type:string,target:string,target_ref:struct<label:string,key:string,value:variant>,properties:variant>>"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per file; text that does not parse is kept in `_corrupt_record` for the report."""
    return spark.read.schema(SCHEMA + ", _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def texts(properties):
    """Properties as a map of names to canonical JSON text; none are an empty map."""
    pairs = F.coalesce(properties.cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))
    return F.transform_values(pairs, lambda _, v: canonical_json(F.coalesce(F.to_json(v), F.lit("null"))))


def documents(docs: DataFrame) -> DataFrame:
    return docs.select("document_id", "schema_version", "source_file", "extraction_scope", "description")


def nodes(docs: DataFrame) -> DataFrame:
    one = docs.select("document_id", F.posexplode("nodes").alias("node_ord", "n"))
    return one.select("document_id", "node_ord", "n.id", "n.labels", texts(F.col("n.properties")).alias("properties"))


def relationships(docs: DataFrame) -> DataFrame:
    one = docs.select("document_id", F.posexplode("relationships").alias("rel_ord", "r"))
    ref = F.col("r.target_ref")
    ref = F.when(ref.isNotNull(), F.struct(ref["label"].alias("label"), ref["key"].alias("key"), canonical_json(F.to_json(ref["value"])).alias("value")))
    return one.select("document_id", "rel_ord", "r.source", "r.type", "r.target", ref.alias("target_ref"), texts(F.col("r.properties")).alias("properties"))


def unreadable(docs: DataFrame) -> DataFrame:
    """Failed reports of files that did not parse."""
    bad = docs.where(F.col("_corrupt_record").isNotNull())
    return bad.select("document_id", F.lit("graph_shaped_json_validation").alias("validation_type"), F.lit(False).alias("passed"), F.substring("_corrupt_record", 1, 200).alias("error"))
