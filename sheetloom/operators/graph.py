"""The property graph as two tables: upsert, clear, counts, constraints and typed views.

nodes: key, labels (sorted), id, properties (name -> JSON text). edges: src, type, dst, properties; src and dst are node keys.
A node's key is its sorted labels and identity, so nodes of other labels may share an id. Values are kept as canonical JSON
text: numbers lose a trailing .0, so 570 and 570.0 are one value.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import vocabulary
from ..sources.settled import settle, small_side

NODES = "key string, labels array<string>, id string, properties map<string,string>"
EDGES = "src string, type string, dst string, properties map<string,string>"

# Labels of extracted data and the types of the edges that extraction writes.
INSTANCE_LABELS = ["Datasheet", "Equipment", "TechnicalParameter", "Evidence", "ExtractionRun", "ValidationIssue"]
INSTANCE_EDGES = ["DESCRIBES", "HAS_EQUIPMENT_TYPE", "HAS_PARAMETER", "HAS_PARAMETER_TYPE", "HAS_UNIT", "EVIDENCED_BY", "GENERATED_BY", "ABOUT"]

LOST = "target_ref did not match an existing node: label=%s, key=%s, value=%s"

#: So many labels are written into a plan at most.
MANY = 1000

#: Identity properties of each label with a uniqueness constraint.
UNIQUE = {label: key for label, key in vocabulary.LABELS.values() if label != "EquipmentType"} | {label: "id" for label in INSTANCE_LABELS}


def canonical(value) -> str:
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        value = int(value)
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def canonical_json(text: Column) -> Column:
    """Canonical form of JSON text of a scalar."""
    return F.regexp_replace(text, r"^(-?\d+)\.0+$", "$1")


def plain(properties: str | Column, name: str) -> Column:
    """A property as plain text: strings unquoted, other values as JSON; null if missing or null."""
    raw = (F.col(properties) if isinstance(properties, str) else properties)[name]
    quoted = F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")
    return F.when(raw != "null", quoted)


def node_key(labels: Column, identity: Column) -> Column:
    return F.concat(F.array_join(F.array_sort(labels), ":"), F.lit("|"), identity)


def control(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the control graph."""
    nodes, edges = vocabulary.control_graph()
    rows = [(f"{label}|{i}", [label], p.get("id"), {k: canonical(v) for k, v in p.items()}) for label, i, p in nodes]
    links = [(f"{a}|{i}", t, f"{b}|{j}", {}) for a, i, t, b, j in edges]
    return spark.createDataFrame(rows, NODES), spark.createDataFrame(links, EDGES)


def merged(rows: DataFrame, keys: list[str], rest: list[str]) -> DataFrame:
    """One row per key: properties of later rows (by `turn`) replace those of earlier ones, and a null takes one away."""
    one = rows.select(*keys, *rest, "turn", F.explode_outer("properties").alias("name", "value"))
    last = one.groupBy(*keys, "name").agg(F.max_by("value", F.struct("turn", "value")).alias("value"), *(F.first(c).alias(c) for c in rest))
    kept = F.when(F.col("name").isNotNull() & F.col("value").isNotNull() & (F.col("value") != "null"), F.struct("name", "value"))
    return last.groupBy(*keys).agg(*(F.first(c).alias(c) for c in rest), F.map_from_entries(F.array_sort(F.collect_list(kept))).alias("properties"))


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Merge `new` (labels, id, properties, turn) into the nodes. A node is the same if all labels and the id agree."""
    own_id = F.create_map(F.lit("id"), F.to_json(F.array("id")))
    own_id = F.transform_values(own_id, lambda _, v: F.substring(v, 2, F.length(v) - 2))  # the array's one element
    given = F.coalesce("properties", F.create_map().cast("map<string,string>"))  # a given id property wins over the node's id
    own_id = F.when(F.array_contains(F.map_keys(given), "id"), F.create_map().cast("map<string,string>")).otherwise(own_id)
    fresh = new.select(node_key(F.col("labels"), F.col("id")).alias("key"), F.array_sort("labels").alias("labels"), "id", F.map_concat(given, own_id).alias("properties"), "turn")
    return merged(nodes.withColumn("turn", F.lit(-1).cast("long")).unionByName(fresh), ["key", "labels"], ["id"]).select("key", "labels", "id", "properties")


def resolved(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Add src and dst, the keys of the nodes that an edge of `new` (source, type, target, target_ref) names.

    Local ends are found by id alone, whatever their labels; vocabulary ends by label and property. An end that is not
    found stays null; an edge whose end is found twice is given twice.
    """
    by_id = nodes.where(F.col("id").isNotNull()).select(F.col("id").alias("_id"), F.col("key").alias("_key"))
    with_src = new.join(by_id, F.col("source") == F.col("_id"), "left").withColumnRenamed("_key", "src").drop("_id")
    local = with_src.where("target_ref is null").join(by_id, F.col("target") == F.col("_id"), "left").withColumnRenamed("_key", "dst").drop("_id")
    # distinct references are few beside the edges that make them: they are matched first, each against the one property it
    # names, and what they lead to is then joined, by broadcast if the planner finds it small
    parts = [F.col(f"target_ref.{x}").alias(f"_{x}") for x in ("label", "key", "value")]
    refs = new.where("target_ref is not null").select(*parts).distinct()
    named = nodes.select(F.col("key").alias("_node"), "properties", F.explode("labels").alias("_label")).join(refs.select("_label", F.col("_key").alias("_name")).distinct(), "_label")
    named = named.select("_node", "_label", "_name", F.col("properties")[F.col("_name")].alias("_value")).where("_value is not null").distinct()
    led = refs.withColumnRenamed("_key", "_name").join(named, ["_label", "_name", "_value"])
    ref = (F.col("target_ref.label") == F.col("_label")) & (F.col("target_ref.key") == F.col("_name")) & (F.col("target_ref.value") == F.col("_value"))
    vocab = with_src.where("target_ref is not null").join(led, ref, "left").withColumnRenamed("_node", "dst").drop("_label", "_name", "_value")
    return local.unionByName(vocab)


def upsert_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge edges in; and the vocabulary references that failed, with a message.

    There is one edge per source, type and target. A local edge without both ends is left out without a word; a
    vocabulary edge without either is an error.
    """
    found = resolved(nodes, new)
    good = found.where("src is not null and dst is not null").select("src", "type", "dst", "properties", "turn")
    out = merged(edges.withColumn("turn", F.lit(-1).cast("long")).unionByName(good), ["src", "type", "dst"], []).select("src", "type", "dst", "properties")
    bad = found.where("target_ref is not null and (src is null or dst is null)")
    message = F.format_string(LOST, "target_ref.label", "target_ref.key", "target_ref.value")
    return out, bad.select("source", "type", message.alias("message")).distinct()


def extracted() -> Column:
    return F.arrays_overlap("labels", F.array(*map(F.lit, INSTANCE_LABELS)))


def of_labels(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Nodes that have a label of the column `label`. Up to MANY labels are told to the planner, which can then leave whole
    parts of a union unread; of more, all nodes are given."""
    labels = [r.label for r in names.select("label").where("label is not null").distinct().limit(MANY + 1).collect()]
    if len(labels) > MANY:
        return nodes
    return nodes.where(F.arrays_overlap("labels", F.array(*map(F.lit, labels)).cast("array<string>")))


def reference_errors(nodes: DataFrame, new: DataFrame, rels: DataFrame) -> DataFrame:
    """The failed vocabulary references alone of an upsert of nodes `new` and edges `rels`, both with document_id.

    A source that its own document has is surely found, so only others are looked for among all nodes.
    """
    ref = ["label", "key", "value"]
    rels = rels.where("target_ref is not null").select("document_id", "source", "type", *(F.col(f"target_ref.{x}").alias(x) for x in ref))
    asked = settle(rels.select(*ref).distinct())
    merged_nodes = upsert_nodes(of_labels(nodes, asked), of_labels(new, asked).select("labels", "id", "properties", "turn"))
    named = merged_nodes.select("properties", F.explode("labels").alias("label")).join(small_side(asked), "label")
    led = small_side(settle(named.where(F.col("properties")[F.col("key")] == F.col("value")).select(*ref).distinct()))
    lost, ended = rels.join(led, ref, "left_anti"), rels.join(led, ref, "left_semi")
    here, there = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = new.where("id is not null").select("document_id", "id", here.alias("nodes"), there.alias("sources")).unionByName(ended.select("document_id", F.col("source").alias("id"), there.alias("nodes"), here.alias("sources")))
    # one aggregate by document and id, which needs no shuffle if both are dealt by document
    strange = both.groupBy("document_id", "id").agg(F.sum("nodes").alias("nodes"), F.sum("sources").alias("sources")).where("nodes = 0 and sources > 0")
    strange = settle(strange.select("id").distinct())
    if not strange.isEmpty():
        seen = nodes.select("id").unionByName(new.select("id")).join(small_side(strange), "id", "left_semi").distinct()
        nowhere = small_side(settle(strange.join(seen, "id", "left_anti"))).withColumnRenamed("id", "_id")
        lost = lost.unionByName(ended.join(nowhere, F.col("source").eqNullSafe(F.col("_id")), "left_semi"))
    return lost.select("source", "type", *ref).distinct().select("source", "type", F.format_string(LOST, *ref).alias("message"))


def upsert_cleared(nodes: DataFrame, edges: DataFrame, new: DataFrame, rels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What clear_instances leaves of an upsert of nodes `new` and edges `rels`. An edge is left if both of its ends are, so
    edges are resolved among the nodes that are left alone. Nodes of other labels are never merged into those."""
    kept, links = clear_instances(upsert_nodes(nodes, new.where(~extracted())), edges)
    kept = small_side(settle(kept))
    return kept, upsert_edges(kept, links, rels)[0]


def clear_instances(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without all extracted nodes and every edge at one of them."""
    gone = extracted()
    keys = nodes.where(gone).select("key")
    left = edges.join(keys.select(F.col("key").alias("src")), "src", "left_anti").join(keys.select(F.col("key").alias("dst")), "dst", "left_anti")
    return nodes.where(~gone), left.select("src", "type", "dst", "properties")


def label_counts(nodes: DataFrame) -> DataFrame:
    chosen = nodes.where(extracted())
    return chosen.groupBy(F.array_join(F.array_sort("labels"), ":").alias("labels")).agg(F.count("*").alias("n"))


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("type").isin(INSTANCE_EDGES)).groupBy("type").agg(F.count("*").alias("n"))


def broken_constraints(nodes: DataFrame) -> DataFrame:
    """label, value, n: values of a label's identity property that several nodes have."""
    rules = F.create_map(*(F.lit(x) for pair in UNIQUE.items() for x in pair))
    one = nodes.select(F.explode("labels").alias("label"), "properties").withColumn("value", F.col("properties")[rules[F.col("label")]])
    return one.where("value is not null").groupBy("label", "value").agg(F.count("*").alias("n")).where("n > 1")


def bad_identifiers(rels: DataFrame, nodes: DataFrame) -> DataFrame:
    """kind, name: labels, property names and relationship types that are no plain ASCII identifiers."""
    word, upper = r"^[A-Za-z_][A-Za-z0-9_]*$", r"^[A-Z_][A-Z0-9_]*$"
    label = nodes.select(F.lit("label").alias("kind"), F.explode("labels").alias("name")).unionByName(rels.where("target_ref is not null").select(F.lit("label").alias("kind"), F.col("target_ref.label").alias("name")))
    key = rels.where("target_ref is not null").select(F.lit("property").alias("kind"), F.col("target_ref.key").alias("name"))
    kind = rels.select(F.lit("relationship").alias("kind"), F.col("type").alias("name"))
    return label.unionByName(key).where(~F.col("name").rlike(word)).unionByName(kind.where(~F.col("name").rlike(upper))).distinct()


def checked_identifiers(rels: DataFrame, nodes: DataFrame) -> None:
    """Raise on the first label, property name or relationship type that is no plain identifier."""
    if bad := bad_identifiers(rels, nodes).first():
        raise ValueError(f"unsafe {bad.kind} name: {bad.name!r}")


def checked_constraints(nodes: DataFrame) -> None:
    """Raise on the first identity value that several nodes of a label have."""
    if twice := broken_constraints(nodes).first():
        raise ValueError(f"{twice.n} nodes of label {twice.label} share the value {twice.value}")


class Views:
    """Typed views of a graph, by label, and its edges by type. The competency questions are asked of them."""

    def __init__(self, tables: dict[str, DataFrame], edges: DataFrame):
        self.tables, self.all_edges = tables, edges

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def edges(self, kind: str) -> DataFrame:
        return self.all_edges.where(F.col("type") == kind).select("src", "dst")

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame) -> Views:
        label = lambda name: nodes.where(F.array_contains("labels", name))
        text = lambda *names: [plain("properties", n).alias(n) for n in names]
        return cls(
            {
                "datasheet": label("Datasheet").select("key", "id", *text("file_name", "document_type")),
                "equipment": label("Equipment").select("key", "id", *text("product_model", "manufacturer", "raw_equipment_type")),
                "technical_parameter": label("TechnicalParameter").select("key", "id", *text("raw_label", "value", "value_type")),
                "evidence": label("Evidence").select("key", "id", *text("content_block_id", "source_text", "evidence_type", "evidence_status", "extraction_method"), plain("properties", "page_number").cast("int").alias("page_number"), plain("properties", "confidence").cast("double").alias("confidence")),
                "parameter_type": label("ParameterType").select("key", *text("name", "display_name", "parameter_category"), (F.col("properties")["expects_unit"] == "true").alias("expects_unit")),
                "unit": label("Unit").select("key", *text("symbol", "name")),
                "equipment_type": label("EquipmentType").select("key", *text("name", "display_name")),
                "required_parameter": label("RequiredParameter").select("key", *text("id", "reason")),
                "relationship_definition": label("RelationshipDefinition").select("key", *text("name")),
                "concept": label("Concept").select("key", *text("name")),
            },
            edges,
        )


def node_by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def nodes_by_label(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.where(F.array_contains("labels", label))


def relationships_by_type(rels: DataFrame, kind: str) -> DataFrame:
    return rels.where(F.col("type") == kind)


def loading_summary(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """One row per document: numbers of nodes, of relationships to local targets and of those to vocabulary targets."""
    n = nodes.groupBy("document_id").agg(F.count("*").alias("nodes_loaded"))
    local = F.col("target_ref").isNull()
    r = rels.groupBy("document_id").agg(F.count_if(local).alias("local_relationships_loaded"), F.count_if(~local).alias("target_ref_relationships_loaded"))
    return n.join(r, "document_id", "full_outer").na.fill(0)
