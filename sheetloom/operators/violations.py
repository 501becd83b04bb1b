"""Validation of graph-shaped documents as sets of violations.

nodes: document_id, node_ord, id, labels, properties (name -> JSON text). rels: document_id, rel_ord, source, type, target,
target_ref, properties. documents: document_id, schema_version, extraction_scope. Rules that one row tells are arrays of that
row; the others are told by one aggregate by document and id, one by relationship and one by document. None collects.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .graph import plain

# Scopes, statuses, required labels, edges and properties, and the form of vocabulary references.
SCOPES = ["manual_gold_sample", "llm_generated", "llm_repaired", "human_reviewed"]
STATUSES = ["ambiguous", "explicit", "inferred", "missing"]
NEEDED_LABELS = ["Datasheet", "Equipment", "TechnicalParameter", "Evidence", "ExtractionRun"]
NEEDED_EDGES = [("V10", "Datasheet", "DESCRIBES"), ("V11", "Equipment", "HAS_PARAMETER"), ("V12", "TechnicalParameter", "HAS_PARAMETER_TYPE"), ("V13", "TechnicalParameter", "EVIDENCED_BY"), ("V14", "TechnicalParameter", "GENERATED_BY")]
NEEDED_PROPERTIES = [("V16", "Evidence", ["source_document_id", "page_number", "source_text", "evidence_status", "confidence"]), ("V19", "TechnicalParameter", ["raw_label", "value", "value_type"])]
REFERENCES = [("HAS_PARAMETER_TYPE", "ParameterType", "name"), ("HAS_UNIT", "Unit", "symbol"), ("HAS_EQUIPMENT_TYPE", "EquipmentType", "name")]


VIOLATION = "array<struct<rule_id:string,subject_id:string,message:string>>"


def found(rule_id: str, subject: Column | str, pattern: str, *parts: str | Column) -> Column:
    message = F.format_string(pattern, *parts) if parts else F.lit(pattern)
    return F.struct(F.lit(rule_id).alias("rule_id"), (F.col(subject) if isinstance(subject, str) else subject).cast("string").alias("subject_id"), message.alias("message"))


def spread(rows: DataFrame, *lists: Column) -> DataFrame:
    """One row for each violation in the lists of a row."""
    each = F.explode(F.concat(F.array().cast(VIOLATION), *lists)).alias("v")
    return rows.select("document_id", each).select("document_id", "v.*")


def checked(*conditions: tuple[Column, Column]) -> Column:
    """The violations whose conditions hold."""
    return F.filter(F.array(*(F.when(c, v) for c, v in conditions)), lambda v: v.isNotNull())


def held(*conditions: tuple[Column, Column]) -> Column:
    """Whether any condition holds. Rows without a violation are left out by it before lists are made of the others, where
    the planner can also tell it of whole parts of a union."""
    return reduce(Column.__or__, (c for c, _ in conditions))


def times(n: Column, violation: Column) -> Column:
    return F.when(n > 0, F.array_repeat(violation, n.cast("int"))).otherwise(F.array().cast(VIOLATION))


def blank(c: Column | str) -> Column:
    return F.coalesce(strip(F.col(c) if isinstance(c, str) else c) == "", F.lit(True))


def saying(rule_id: str, pattern: str):
    """The violation of a node that a property's name makes."""
    return lambda name: found(rule_id, "id", pattern, "id", name)


def of_nodes(nodes: DataFrame) -> DataFrame:
    """Rules that one node tells: V1, V16 to V19."""
    label = lambda name: F.coalesce(F.array_contains("labels", name), F.lit(False))
    bad = blank("id") | (F.size("labels") < 1) | F.exists("labels", blank)
    rows = nodes.withColumn("status", plain("properties", "evidence_status")).withColumn("raw", F.col("properties")["confidence"])
    given = F.col("raw") != "null"
    number = F.when(F.col("raw") == "true", 1.0).when(F.col("raw") == "false", 0.0).otherwise(F.col("raw").try_cast("double"))  # booleans count as numbers
    allowed = ", ".join(f"'{s}'" for s in STATUSES)
    single = [
        (F.coalesce(bad, F.lit(True)), found("V1", "id", "Node ids and labels must not be empty.")),
        (label("Evidence") & ~F.col("status").isin(STATUSES), found("V17", "id", f"Evidence node '%s' has invalid evidence_status '%s'. Allowed values: [{allowed}].", "id", "status")),
        (label("Evidence") & given & number.isNull(), found("V18", "id", "Evidence node '%s' has non-numeric confidence.", "id")),
        (label("Evidence") & given & ((number < 0) | (number > 1)), found("V18", "id", "Evidence node '%s' has confidence outside [0, 1].", "id")),
    ]
    lists, lacks = [checked(*single)], []
    for rule_id, name, wanted in NEEDED_PROPERTIES:
        words = "Evidence node '%s' is missing required property '%s'." if name == "Evidence" else "TechnicalParameter node '%s' is missing recommended MVP property '%s'."
        lacking = F.array_except(F.array(*map(F.lit, wanted)), F.map_keys("properties"))
        lists.append(F.when(label(name), F.transform(lacking, saying(rule_id, words))).otherwise(F.array().cast(VIOLATION)))
        lacks.append((label(name) & (F.size(lacking) > 0), lacking))
    return spread(rows.where(held(*single, *lacks)), *lists)


def of_relationships(rels: DataFrame) -> DataFrame:
    """Rules that one relationship tells: V2, V15."""
    ref = F.col("target_ref")
    conditions = [(F.col("target").isNotNull() == ref.isNotNull(), found("V2", "source", "Each relationship must define exactly one of 'target' or 'target_ref'."))]
    for kind, label, key in REFERENCES:
        mine = F.col("type") == kind
        conditions.append((mine & ref.isNull(), found("V15", "source", "Relationship '%s' from '%s' should use target_ref instead of local target.", "type", "source")))
        wrong = found("V15", "source", f"Relationship '%s' from '%s' has invalid target_ref. Expected label/key ({label}, {key}), got (%s, %s).", "type", "source", ref["label"], ref["key"])
        conditions.append((mine & ((ref["label"] != label) | (ref["key"] != key)), wrong))
    return spread(rels.where(held(*conditions)), checked(*conditions))


def of_repeats(rels: DataFrame) -> DataFrame:
    """V8: relationships that say what another one says."""
    ref = F.col("target_ref")
    to = F.when(F.col("target").isNotNull(), F.concat(F.lit("target:"), "target")).when(ref.isNotNull(), F.concat(F.lit("target_ref:"), ref["label"], F.lit(":"), ref["key"], F.lit(":"), F.regexp_replace(ref["value"], r'^"|"$', ""))).otherwise("target:none")
    same = rels.groupBy("document_id", "source", "type", to.alias("to")).agg(F.count("*").alias("n")).where("n > 1")
    return spread(same, times(F.col("n") - 1, found("V8", "source", "Duplicate relationship found: source=%s, type=%s, target=%s", "source", "type", "to")))


def of_identities(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """Rules that all nodes and relationships of one id tell: V3, V4, V10 to V14. One aggregate by document and id."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    labels = sorted({label for _, label, _ in NEEDED_EDGES})
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    blanks = lambda names: [none.alias(n) for n in names]
    kinds = [kind for _, _, kind in NEEDED_EDGES]
    facts = nodes.select("document_id", "id", one.alias("nodes"), none.alias("sources"), none.alias("targets"), *(flag(F.array_contains("labels", x)).alias(x) for x in labels), *blanks(kinds))
    starts = rels.select("document_id", F.col("source").alias("id"), none.alias("nodes"), one.alias("sources"), none.alias("targets"), *blanks(labels), *(flag(F.col("type") == k).alias(k) for k in kinds))
    ends = rels.where("target is not null").select("document_id", F.col("target").alias("id"), none.alias("nodes"), none.alias("sources"), one.alias("targets"), *blanks(labels + kinds))
    known = facts.unionByName(starts).unionByName(ends).groupBy("document_id", "id").agg(*(F.sum(x).alias(x) for x in ("nodes", "sources", "targets", *labels, *kinds)))
    lost = F.col("nodes") == 0
    counted = [
        ((F.col("nodes") > 1).cast("int"), found("V3", "id", "Duplicate node IDs found: %s", "id")),
        (F.when(lost & F.col("id").isNotNull(), F.col("sources")).otherwise(none), found("V4", "id", "Relationship source '%s' does not exist in nodes.", "id")),
        (F.when(lost, F.col("targets")).otherwise(none), found("V4", "id", "Relationship target '%s' does not exist in nodes.", "id")),
    ]
    for rule_id, label, kind in NEEDED_EDGES:
        prefix = f"{label} node '%s'" if label != "TechnicalParameter" else f"{label} '%s'"
        counted.append((F.when(F.col(kind) == 0, F.col(label)).otherwise(none), found(rule_id, "id", f"{prefix} has no {kind} relationship.", "id")))
    return spread(known.where(held(*((n > 0, v) for n, v in counted))), *(times(*x) for x in counted))


def totals(documents: DataFrame, nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """Each document with the numbers of its nodes, of those of each needed label and of its relationships, and `sheet`,
    whether its id is that of a Datasheet node. One aggregate by document."""
    none = F.lit(0).cast("long")
    is_a = lambda name: F.coalesce(F.array_contains("labels", name), F.lit(False))
    sheet = F.coalesce((F.col("id") == F.col("document_id")) & is_a("Datasheet"), F.lit(False)).cast("long").alias("sheet")
    facts = nodes.select("document_id", F.lit(1).cast("long").alias("node_count"), none.alias("relationship_count"), sheet, *(is_a(x).cast("long").alias(x) for x in NEEDED_LABELS))
    more = rels.select("document_id", none.alias("node_count"), F.lit(1).cast("long").alias("relationship_count"), none.alias("sheet"), *(none.alias(x) for x in NEEDED_LABELS))
    names = ["node_count", "relationship_count", "sheet", *NEEDED_LABELS]
    counted = facts.unionByName(more).groupBy("document_id").agg(*(F.sum(x).alias(x) for x in names))
    return documents.join(counted, "document_id", "left").na.fill(0, names)


def of_documents(counted: DataFrame) -> DataFrame:
    """Rules that a document's totals tell: V1, V5 to V7, V9."""
    return spread(
        counted,
        checked(
            (blank("document_id") | blank("schema_version"), found("V1", "document_id", "document_id and schema_version must not be empty.")),
            (F.col("sheet") == 0, found("V5", "document_id", "document_id must match the id of a node with label 'Datasheet'.")),
            (~F.coalesce(F.col("extraction_scope").isin(SCOPES), F.lit(False)), found("V6", "extraction_scope", "Unknown extraction_scope.")),
            (F.col("node_count") == 0, found("V7", "document_id", "At least one node is required.")),
            *((F.col(x) == 0, found("V9", F.lit(x), f"At least one {x} node is required.")) for x in NEEDED_LABELS),
        ),
    )


def violations(documents: DataFrame, nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """document_id, rule_id, subject_id, message of all violations. Semantic rules speak also about documents that break
    structural ones. Every table is read three times at most, whatever the number of rules."""
    parts = [of_nodes(nodes), of_relationships(rels), of_repeats(rels), of_identities(nodes, rels), of_documents(totals(documents, nodes, rels))]
    return reduce(DataFrame.unionByName, parts)


def domain_range(rels: DataFrame, nodes: DataFrame, definitions: DataFrame) -> DataFrame:
    """Optional rule: relationships whose ends have labels other than their definition (name, from_concept, to_concept) says."""
    ends = nodes.select("document_id", "id", "labels")
    known = rels.join(definitions.select(F.col("name").alias("type"), "from_concept", "to_concept"), "type")
    src = known.join(ends.select("document_id", F.col("id").alias("source"), F.col("labels").alias("src_labels")), ["document_id", "source"], "left")
    wrong = ~F.expr("array_contains(src_labels, from_concept)")
    return spread(src, checked((wrong, found("X1", "source", "Relationship '%s' must start at %s.", "type", "from_concept"))))


def report(documents: DataFrame, nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """One row per document: passed and the counts of errors, nodes, relationships, parameters and evidence."""
    errors = violations(documents, nodes, rels).groupBy("document_id").agg(F.count("*").alias("error_count"))
    named = {"TechnicalParameter": "technical_parameter_count", "Evidence": "evidence_count"}
    out = totals(documents, nodes, rels).withColumnsRenamed(named).join(errors, "document_id", "left").na.fill(0, ["error_count"])
    counts = ["error_count", "node_count", "relationship_count", "technical_parameter_count", "evidence_count"]
    return out.select("document_id", (F.col("error_count") == 0).alias("passed"), *counts)
