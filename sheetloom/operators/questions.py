"""Competency questions and schema checks over the typed views of a graph.

An optional step is one left join with the edge and its endpoint joined before, so an edge without endpoint gives no row of
its own. Vocabulary sides are small tables that the planner broadcasts by their size. Nulls sort as the largest values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Views


def end(g: Views, kind: str, table: str, **columns: str) -> DataFrame:
    """src of each edge of a type with the chosen columns (new name = column) of the node that it leads to."""
    node = g[table].select(F.col("key").alias("dst"), *(F.col(c).alias(n) for n, c in columns.items()))
    return g.edges(kind).join(node, "dst").select(F.col("src"), F.lit(True).alias(f"has_{table}"), *columns)


def parameters(g: Views, *equipment: str) -> DataFrame:
    """Each parameter `p` of each piece of equipment `e`."""
    e = g["equipment"].select(F.col("key").alias("e"), F.col("id").alias("equipment_id"), *equipment)
    p = g["technical_parameter"].select(F.col("key").alias("p"), F.col("id").alias("parameter_id"), "raw_label", "value", "value_type")
    return g.edges("HAS_PARAMETER").select(F.col("src").alias("e"), F.col("dst").alias("p")).join(e, "e").join(p, "p")


def step(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    return left.join(right.withColumnRenamed("src", on), on, how)


def types(g: Views) -> DataFrame:
    return end(g, "HAS_PARAMETER_TYPE", "parameter_type", type_name="name", type_display="display_name", type_category="parameter_category", expects_unit="expects_unit")


def units(g: Views) -> DataFrame:
    return end(g, "HAS_UNIT", "unit", unit="symbol", unit_name="name")


def last(*names: str):
    return [F.asc_nulls_last(n) for n in names]


def extracted_equipment(g: Views) -> DataFrame:
    d = g["datasheet"].select(F.col("key").alias("d"), F.col("id").alias("datasheet_id"), "file_name", "document_type")
    e = g["equipment"].select(F.col("key").alias("e"), F.col("id").alias("equipment_id"), "product_model", "manufacturer", "raw_equipment_type")
    kind = end(g, "HAS_EQUIPMENT_TYPE", "equipment_type", normalized_equipment_type="name", normalized_equipment_type_display_name="display_name").drop("has_equipment_type")
    out = g.edges("DESCRIBES").select(F.col("src").alias("d"), F.col("dst").alias("e")).join(d, "d").join(e, "e")
    return step(out, kind, "e", "left").drop("d", "e").orderBy(*last("datasheet_id", "equipment_id"))


def technical_parameters(g: Views) -> DataFrame:
    out = step(step(parameters(g, "product_model", "raw_equipment_type"), types(g), "p"), units(g), "p", "left")
    return out.select(
        "equipment_id", "product_model", "raw_equipment_type", "parameter_id", "raw_label", "value", "value_type", F.col("type_name").alias("normalized_parameter_type"),
        F.col("type_display").alias("parameter_display_name"), F.col("type_category").alias("parameter_category"), "unit", "unit_name",
    ).orderBy(*last("equipment_id", "normalized_parameter_type", "raw_label"))


def parameter_evidence(g: Views) -> DataFrame:
    fields = ["page_number", "content_block_id", "source_text", "evidence_type", "evidence_status", "confidence", "extraction_method"]
    evidence = end(g, "EVIDENCED_BY", "evidence", evidence_id="id", **{f: f for f in fields})
    out = step(step(step(parameters(g, "product_model"), types(g), "p"), units(g), "p", "left"), evidence, "p", "left")
    out = out.select("equipment_id", "product_model", "parameter_id", "raw_label", "value", F.col("type_name").alias("normalized_parameter_type"), "unit", "evidence_id", *fields)
    return out.orderBy(*last("equipment_id", "normalized_parameter_type"), F.desc_nulls_first("confidence"))


def vocabulary_grounding(g: Views) -> DataFrame:
    out = step(step(parameters(g, "product_model"), types(g), "p", "left"), units(g), "p", "left")
    unit = F.when(F.col("has_unit"), "grounded").when(F.col("expects_unit"), "missing_unit_grounding").otherwise("not_required")
    return out.select(
        "equipment_id", "product_model", "parameter_id", "raw_label", "value", F.col("type_name").alias("grounded_parameter_type"), F.col("type_display").alias("parameter_display_name"),
        F.when(F.col("has_parameter_type"), "grounded").otherwise("not_grounded").alias("parameter_type_grounding_status"), F.col("unit").alias("grounded_unit"),
        unit.alias("unit_grounding_status"), F.col("expects_unit").alias("parameter_type_expects_unit"),
    ).orderBy(*last("equipment_id", "parameter_type_grounding_status", "unit_grounding_status", "raw_label"))


#: Up to this many required types are broadcast.
MOST_REQUIRED = 100_000
UNSUPPORTED = "The extracted unit is not listed as an allowed unit for this ParameterType."
MISSING_UNIT = "This ParameterType expects a unit, but the extracted parameter has no HAS_UNIT relationship."


def required_parameter_status(g: Views) -> DataFrame:
    none = F.lit(None).cast("string")
    kinds = g.edges("HAS_PARAMETER_TYPE").select(F.col("src").alias("p"), F.col("dst").alias("t"))
    typed = kinds.join(g["parameter_type"].select(F.col("key").alias("t"), F.col("name").alias("parameter_type"), "expects_unit"), "t")
    has = parameters(g, "product_model").join(typed, "p")
    # every piece of equipment is held against each required type: the vocabulary is broadcast if its count allows that
    needed = g["required_parameter"].select(F.col("key").alias("src"), "reason").join(g.edges("REQUIRES_PARAMETER_TYPE"), "src")
    needed = needed.join(g["parameter_type"].select(F.col("key").alias("dst"), F.col("name").alias("parameter_type")), "dst").select(F.col("dst").alias("t"), "parameter_type", "reason")
    lone = g["equipment"].select(F.col("key").alias("e"), F.col("id").alias("equipment_id"), "product_model").crossJoin(F.broadcast(needed) if needed.count() <= MOST_REQUIRED else needed)
    lone = lone.join(has.select("e", "t").distinct(), ["e", "t"], "left_anti")
    row = lambda df, kind, unit, detail, label, value: df.select("equipment_id", "product_model", F.lit(kind).alias("issue_type"), "parameter_type", label.alias("raw_label"), value.alias("value"), unit.alias("unit"), detail.alias("detail"))
    missing = row(lone, "MISSING_REQUIRED_PARAMETER", none, F.col("reason"), none, none)
    used = g.edges("HAS_UNIT").select(F.col("src").alias("p"), F.col("dst").alias("u")).join(g["unit"].select(F.col("key").alias("u"), F.col("symbol").alias("unit")), "u")
    allowed = g.edges("ALLOWS_UNIT").select(F.col("src").alias("t"), F.col("dst").alias("u"))
    wrong = has.join(used, "p").join(allowed, ["t", "u"], "left_anti")
    label, value = F.col("raw_label"), F.col("value")
    unsupported = row(wrong, "UNSUPPORTED_UNIT", F.col("unit"), F.lit(UNSUPPORTED), label, value)
    bare = row(has.where("expects_unit").join(used, "p", "left_anti"), "MISSING_EXPECTED_UNIT", none, F.lit(MISSING_UNIT), label, value)
    return missing.unionByName(unsupported).unionByName(bare).distinct().orderBy(*last("equipment_id", "issue_type", "parameter_type"))


def parameter_type_vocabulary(g: Views) -> DataFrame:
    return g["parameter_type"].select(F.col("name").alias("parameter_type")).orderBy("parameter_type")


def unit_vocabulary(g: Views) -> DataFrame:
    return g["unit"].select(F.col("symbol").alias("unit")).orderBy("unit")


def equipment_type_vocabulary(g: Views) -> DataFrame:
    return g["equipment_type"].select(F.col("name").alias("equipment_type")).orderBy("equipment_type")


def allowed_units(g: Views) -> DataFrame:
    unit = end(g, "ALLOWS_UNIT", "unit", unit="symbol")
    named = g["parameter_type"].select(F.col("key").alias("src"), F.col("name").alias("parameter_type")).join(unit, "src")
    return named.groupBy("parameter_type").agg(F.sort_array(F.collect_list("unit")).alias("allowed_units")).orderBy("parameter_type")


def required_parameters(g: Views) -> DataFrame:
    kind = end(g, "REQUIRES_PARAMETER_TYPE", "parameter_type", parameter_type="name")
    return g["required_parameter"].select(F.col("key").alias("src"), F.col("id").alias("required_parameter")).join(kind, "src").select("required_parameter", "parameter_type").orderBy("required_parameter")


def relationship_definitions(g: Views) -> DataFrame:
    ends = [end(g, kind, "concept", **{name: "name"}).drop("has_concept") for kind, name in (("FROM_CONCEPT", "from_concept"), ("TO_CONCEPT", "to_concept"))]
    named = g["relationship_definition"].select(F.col("key").alias("src"), F.col("name").alias("relationship"))
    return named.join(ends[0], "src").join(ends[1], "src").select("relationship", "from_concept", "to_concept").orderBy("relationship")


CQS = {"cq1_extracted_equipment": extracted_equipment, "cq2_technical_parameters": technical_parameters, "cq3_parameter_evidence": parameter_evidence, "cq4_vocabulary_grounding": vocabulary_grounding, "cq5_required_parameter_status": required_parameter_status}
SCHEMA_CHECKS = {f.__name__: f for f in (parameter_type_vocabulary, unit_vocabulary, equipment_type_vocabulary, allowed_units, required_parameters, relationship_definitions)}
