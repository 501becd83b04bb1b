"""Inputs of the registered queries, derived from the driver's tables.

Texts below are plain SQL that Spark and DuckDB both run; braces stand for tables. They only prepare inputs: the operators
are DataFrame plans, and the oracle in `sql` states the results on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Views, control
from . import vocabulary

# A source's documents are the pages of files of a thousand pages each, so that no file grows with the corpus.
FILE = "concat(source, '_', CAST(floor(doc_id / 1000) AS INT))"
PAGES = f"SELECT {FILE} AS source_file, CAST(doc_id + 1 AS INT) AS page_number, text, CAST(n_chars AS INT) AS char_count FROM {{documents}}"
CHATS = "SELECT concat('conv_', conv_id) AS source_file, CAST(turn + 1 AS INT) AS page_number, text FROM {conversations}"
# Documents in which frequent words became headings, captions, table rows and list items, to exercise the layout rules.
DATASHEETS = f"SELECT {FILE} AS source_file, CAST(doc_id + 1 AS INT) AS page_number, replace(replace(replace(replace(replace(text, ' of ', concat(chr(10), 'Figure 3 of it', chr(10))), ' is ', concat(chr(10), 'Features', chr(10))), ' and ', ' PRODUCT SUMMARY '), ' de ', concat(chr(10), 'PACKAGE DIMENSIONS', chr(10), 'Fig. 2', chr(10))), ' und ', concat(chr(10), 'SYMBOL VALUE UNIT ', chr(10))) AS text FROM {{documents}}"
MARKDOWN = "SELECT concat('doc_', doc_id) AS source_file, replace(replace(replace(replace(replace(replace(text, ' of ', concat(chr(10), '# Features', chr(10))), ' is ', concat(chr(10), '- item', chr(10))), ' and ', concat(chr(10), '| a | --- |', chr(10))), ' to ', concat(chr(10), 'Rev. 1.2, 05-Jan-11 3 Document Number: 7', chr(10))), ' de ', concat(chr(10), chr(10), '## Reel dimensions', chr(10), chr(10))), ' und ', concat(' ', chr(10), chr(10))) AS markdown FROM {documents}"
RECORDED = f"""SELECT {FILE} AS source_file, CAST(d.doc_id + 1 AS INT) AS page_number, CAST(60 * l.quality + 30 * (1 - l.toxic) AS DOUBLE) AS score,
    CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'high' WHEN l.quality = 1 THEN 'medium' WHEN l.toxic = 0 THEN 'low' ELSE 'irrelevant' END AS relevance_level,
    l.quality = 1 AS useful_for_extraction, d.lang AS likely_content_type FROM {{documents}} d JOIN (SELECT doc_id AS label_id, quality, toxic FROM {{labels}}) l ON d.doc_id = l.label_id"""

# Every line item is a parameter. Some references to types and evidence are changed, so that they lead nowhere.
LINES = "SELECT concat('param_', l_orderkey, '_', l_partkey, '_', l_suppkey, '_', l_linenumber) AS id, concat('equipment_', l_partkey) AS e, concat(l_returnflag, l_linestatus, l_linenumber, CASE WHEN l_orderkey % 11 = 3 THEN '?' ELSE '' END) AS raw_label, CAST(CAST(l_quantity AS BIGINT) AS STRING) AS value, CASE WHEN l_tax < 0.02 THEN NULL WHEN l_tax < 0.05 THEN 'mm' ELSE 'nm' END AS unit, CASE WHEN l_orderkey % 10 = 0 THEN -1 - l_orderkey ELSE l_orderkey END AS l_orderkey FROM {lineitem}"
SHEETS = "SELECT concat('datasheet_', s_suppkey) AS id, s_name AS file_name, concat('nation_', s_nationkey) AS document_type FROM {supplier}"
EQUIPMENT = "SELECT concat('equipment_', p_partkey) AS id, p_name AS product_model, p_brand AS manufacturer, p_type AS raw_equipment_type FROM {part}"
KINDS = "SELECT DISTINCT p_type AS name, lower(p_type) AS display_name FROM {part} WHERE p_type <> 'ECONOMY'"
DESCRIBES = "SELECT DISTINCT concat('datasheet_', l_suppkey) AS src, concat('equipment_', l_partkey) AS dst FROM {lineitem}"
EVIDENCE = "SELECT concat('evidence_', o_orderkey) AS id, CAST(o_orderkey % 50 + 1 AS INT) AS page_number, concat('block_', o_orderkey % 7) AS content_block_id, o_orderpriority AS source_text, o_orderstatus AS evidence_type, 'explicit' AS evidence_status, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice / 1000000.0 END AS confidence, 'derived' AS extraction_method FROM {orders}"
LABELS = [f"{flag}{status}{number}" for flag in "ANR" for status in "FO" for number in range(1, 8)]
TYPES = f"SELECT * FROM (VALUES {', '.join(f"('{x}', {str(x[:2] in ('AF', 'AO', 'NF') or (x[:2] == 'RF' and int(x[2]) % 2 == 0)).lower()})" for x in LABELS)}) AS t(name, expects_unit)"
REQUIRED = "SELECT * FROM (VALUES ('AF1'), ('NF1'), ('RF2')) AS t(name)"
ALLOWED = f"SELECT * FROM (VALUES {', '.join(f"('{x}', '{unit}')" for unit in ('mm', 'nm') for x in LABELS if unit == 'mm' or x[:2] not in ('AF', 'NF'))}) AS t(name, unit)"

# One extraction document per supplier, over all its line items, each a parameter with evidence of its own, with faults planted by remainders.
DOC_LINES = "SELECT DISTINCT concat('datasheet_', l_suppkey) AS document_id, l_suppkey, l_partkey, l_orderkey, l_linenumber, l_returnflag FROM {lineitem}"
# The last one has no nodes and a blank version.
DOC_DOCUMENTS = """SELECT concat('datasheet_', s_suppkey) AS document_id, '0.1.0' AS schema_version, CASE WHEN s_suppkey % 11 = 5 THEN 'guessed' ELSE 'llm_generated' END AS extraction_scope, s_suppkey FROM {supplier}
    UNION ALL SELECT 'datasheet_none', chr(9), 'llm_generated', -1"""
DOC_NODES = f"""SELECT document_id, document_id AS id, CASE WHEN s_suppkey % 7 = 3 THEN 'Manual' ELSE 'Datasheet' END AS label, NULL AS status, NULL AS confidence, false AS bare FROM ({DOC_DOCUMENTS}) a WHERE s_suppkey >= 0
    UNION ALL SELECT document_id, chr(9), 'Note', NULL, NULL, false FROM ({DOC_DOCUMENTS}) n WHERE s_suppkey % 17 = 2
    UNION ALL SELECT DISTINCT document_id, concat('equipment_', l_partkey), 'Equipment', NULL, NULL, false FROM ({DOC_LINES}) b
    UNION ALL SELECT document_id, concat('param_', l_orderkey, '_', l_partkey, '_', l_suppkey, '_', l_linenumber), 'TechnicalParameter', NULL, NULL, l_orderkey % 17 = 4 FROM ({DOC_LINES}) c
    UNION ALL SELECT document_id, concat('evidence_', l_orderkey, '_', l_partkey, '_', l_suppkey, '_', l_linenumber), 'Evidence', CASE WHEN l_orderkey % 19 = 2 THEN 'guessed' WHEN l_orderkey % 19 = 3 THEN NULL ELSE 'explicit' END, CASE WHEN l_orderkey % 23 = 1 THEN '1.5' WHEN l_orderkey % 23 = 2 THEN '"sure"' WHEN l_orderkey % 23 = 3 THEN 'true' ELSE '0.5' END, l_orderkey % 29 = 7 FROM ({DOC_LINES}) d
    UNION ALL SELECT document_id, concat('run_', l_suppkey), 'ExtractionRun', NULL, NULL, false FROM (SELECT DISTINCT document_id, l_suppkey FROM ({DOC_LINES}) e WHERE l_suppkey % 13 <> 6) f
    UNION ALL SELECT document_id, concat('param_', l_orderkey, '_', l_partkey, '_', l_suppkey, '_', l_linenumber), 'TechnicalParameter', NULL, NULL, false FROM ({DOC_LINES}) g WHERE l_orderkey % 101 = 9"""
# Two of the three flags stand for types of the control graph, the third is none.
KNOWN_TYPES = f"WHEN 'A' THEN '{vocabulary.PARAMETER_TYPES[0][0]}' WHEN 'R' THEN '{vocabulary.PARAMETER_TYPES[1][0]}'"
DOC_RELS = f"""SELECT document_id, 1 AS part, l_orderkey AS k, document_id AS source, 'DESCRIBES' AS type, concat('equipment_', l_partkey) AS target, NULL AS label, NULL AS refkey, NULL AS value FROM ({DOC_LINES}) a WHERE l_suppkey % 10 <> 4
    UNION ALL SELECT document_id, 2, l_orderkey, concat('equipment_', l_partkey), 'HAS_PARAMETER', concat('param_', l_orderkey, '_', l_partkey, '_', l_suppkey, '_', l_linenumber), NULL, NULL, NULL FROM ({DOC_LINES}) b WHERE l_partkey % 9 <> 1
    UNION ALL SELECT document_id, 3, l_orderkey, concat('param_', l_orderkey, '_', l_partkey, '_', l_suppkey, '_', l_linenumber), 'HAS_PARAMETER_TYPE', CASE WHEN l_orderkey % 31 = 5 THEN 'evidence_lost' END, CASE WHEN l_orderkey % 31 <> 5 THEN CASE WHEN l_orderkey % 37 = 6 THEN 'Unit' ELSE 'ParameterType' END END, CASE WHEN l_orderkey % 31 <> 5 THEN 'name' END, CASE WHEN l_orderkey % 31 <> 5 THEN CASE l_returnflag {KNOWN_TYPES} ELSE l_returnflag END END FROM ({DOC_LINES}) c WHERE l_orderkey % 41 <> 8
    UNION ALL SELECT document_id, 4, l_orderkey, concat('param_', l_orderkey, '_', l_partkey, '_', l_suppkey, '_', l_linenumber), 'EVIDENCED_BY', concat('evidence_', l_orderkey, '_', l_partkey, '_', l_suppkey, '_', l_linenumber), NULL, NULL, NULL FROM ({DOC_LINES}) d WHERE l_orderkey % 43 <> 8
    UNION ALL SELECT document_id, 5, l_orderkey, concat('param_', l_orderkey, '_', l_partkey, '_', l_suppkey, '_', l_linenumber), 'GENERATED_BY', concat('run_', l_suppkey), NULL, NULL, NULL FROM ({DOC_LINES}) e WHERE l_orderkey % 47 <> 8
    UNION ALL SELECT document_id, 6, s_suppkey, document_id, 'ABOUT', NULL, NULL, NULL, NULL FROM ({DOC_DOCUMENTS}) f WHERE s_suppkey % 19 = 3"""


def sql(spark: SparkSession, sf_dir: str, text: str, **given: DataFrame) -> DataFrame:
    """The rows of a text over the driver's tables, or over those that are given instead."""
    import re

    names = sorted(set(re.findall(r"\{(\w+)\}", text)))
    return spark.sql(text, **{n: given[n] if n in given else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def duck(text: str) -> str:
    """The same text for the oracle, whose views have the tables' names."""
    return text.replace("{", "").replace("}", "")


def graph(spark: SparkSession, sf_dir: str) -> Views:
    """A synthetic evidence graph of suppliers, parts and line items, as typed views. Some edges dangle."""
    get = lambda text: sql(spark, sf_dir, text)
    keyed = lambda df, key="id": df.withColumn("key", F.col(key))
    line = get(LINES)
    prefixed = lambda p, c: F.concat(F.lit(p), F.col(c))
    kinds, types = get(KINDS), get(TYPES)
    edge = lambda df, kind, src, dst: df.select(src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst")).distinct()
    edges = [
        edge(get(DESCRIBES), "DESCRIBES", F.col("src"), F.col("dst")),
        edge(get(EQUIPMENT), "HAS_EQUIPMENT_TYPE", F.col("id"), prefixed("EquipmentType|", "raw_equipment_type")),
        edge(line, "HAS_PARAMETER", F.col("e"), F.col("id")),
        edge(line, "HAS_PARAMETER_TYPE", F.col("id"), prefixed("ParameterType|", "raw_label")),
        edge(line.where("unit is not null"), "HAS_UNIT", F.col("id"), prefixed("Unit|", "unit")),
        edge(line, "EVIDENCED_BY", F.col("id"), prefixed("evidence_", "l_orderkey")),
        edge(get(REQUIRED), "REQUIRES_PARAMETER_TYPE", prefixed("required_", "name"), prefixed("ParameterType|", "name")),
        edge(get(ALLOWED), "ALLOWS_UNIT", prefixed("ParameterType|", "name"), prefixed("Unit|", "unit")),
    ]
    return SplitViews(
        {
            "datasheet": keyed(get(SHEETS)),
            "equipment": keyed(get(EQUIPMENT)),
            "technical_parameter": keyed(line.select("id", "raw_label", "value", F.lit("number").alias("value_type")).distinct()),
            "evidence": keyed(get(EVIDENCE)),
            "parameter_type": types.select(prefixed("ParameterType|", "name").alias("key"), "name", prefixed("Type ", "name").alias("display_name"), prefixed("flag_", "name").substr(1, 6).alias("parameter_category"), "expects_unit"),
            "unit": vocabulary.table(spark, "unit").select(prefixed("Unit|", "symbol").alias("key"), "symbol", "name"),
            "equipment_type": kinds.select(prefixed("EquipmentType|", "name").alias("key"), "name", "display_name"),
            "required_parameter": get(REQUIRED).select(prefixed("required_", "name").alias("key"), prefixed("required_", "name").alias("id"), F.concat("name", F.lit(" is required")).alias("reason")),
        },
        dict(zip(EDGE_KINDS, edges, strict=True)),
    )


EDGE_KINDS = ["DESCRIBES", "HAS_EQUIPMENT_TYPE", "HAS_PARAMETER", "HAS_PARAMETER_TYPE", "HAS_UNIT", "EVIDENCED_BY", "REQUIRES_PARAMETER_TYPE", "ALLOWS_UNIT"]


class SplitViews(Views):
    """Views whose edges are held by type, so a question reads only the types it names."""

    def __init__(self, tables: dict[str, DataFrame], by_kind: dict[str, DataFrame]):
        super().__init__(tables, None)
        self.by_kind = by_kind

    def edges(self, kind: str) -> DataFrame:
        return self.by_kind[kind].select("src", "dst")


def control_views(spark: SparkSession) -> Views:
    return Views.of(*control(spark))


#: Partitions for each split of the line items as they are read: a line makes two nodes and five relationships.
PARTS = 8


def by_document(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents and their lines, dealt by document once for all that is derived from them."""
    parts = PARTS * spark.read.parquet(f"{sf_dir}/lineitem.parquet").rdd.getNumPartitions()
    return tuple(whole(sql(spark, sf_dir, text).repartition(parts, "document_id")) for text in (DOC_DOCUMENTS, DOC_LINES))


def whole(df: DataFrame) -> DataFrame:
    """`df` behind a condition that always holds and that the planner neither folds nor passes: what is asked above stays
    above, so every use has the same shuffle below and Spark makes it once."""
    return df.where((F.spark_partition_id() >= 0) | (F.xxhash64(*df.columns) == 0))


def apart(name: str) -> Column:
    """A column as it is, but neither another name of the document's identifier, where it is one, nor with its metadata."""
    return F.concat(name, F.lit("")).alias(name)


def dealt() -> Column:
    """The document's identifier. A union keeps how its parts are dealt only if all say the same of it, word by word, which
    columns out of named subqueries do not; with metadata of its own it is a new column, and they do."""
    return F.col("document_id").alias("document_id", metadata={"dealt": True})


def extraction_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents, nodes and rels with planted faults.

    All three are dealt by document, so that what is grouped or joined by document needs no further shuffle.
    """
    sheets, lines = by_document(spark, sf_dir)
    shared = lambda text: sql(spark, sf_dir, text.replace(f"({DOC_LINES})", "{lines}").replace(f"({DOC_DOCUMENTS})", "{sheets}"), lines=lines, sheets=sheets)
    documents = sheets.drop("s_suppkey")
    raw = shared(DOC_NODES)
    text = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit('"'), F.col(c), F.lit('"'))).otherwise("null")
    entries = lambda pairs: F.map_from_arrays(F.array(*(F.lit(k) for k, _ in pairs)), F.array(*(v for _, v in pairs)))
    one = F.lit('"x"')
    evidence = [("source_document_id", one), ("page_number", F.lit("1")), ("source_text", one), ("evidence_status", text("status")), ("confidence", F.coalesce("confidence", F.lit("null")))]
    parameter = [("raw_label", one), ("value", F.lit("1")), ("value_type", one)]
    properties = (
        F.when((F.col("label") == "Evidence") & F.col("bare"), entries(evidence[1:]))
        .when(F.col("label") == "Evidence", entries(evidence))
        .when((F.col("label") == "TechnicalParameter") & F.col("bare"), entries(parameter[:2]))
        .when(F.col("label") == "TechnicalParameter", entries(parameter))
        .otherwise(entries([("note", one)]))
    )
    nodes = raw.select(dealt(), apart("id"), F.array("label").alias("labels"), properties.alias("properties"))
    rels = shared(DOC_RELS)
    ref = F.when(F.col("label").isNotNull(), F.struct("label", F.col("refkey").alias("key"), text("value").alias("value")))
    order = F.col("part").cast("bigint") * F.lit(10_000_000_000) + F.col("k")
    return documents, nodes, rels.select(dealt(), order.alias("rel_ord"), apart("source"), "type", "target", ref.alias("target_ref"))
