"""The registered queries of the reference's own operators, over inputs derived from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, compare, graph, layout, questions, scoring, violations
from ..sources.pages import extraction_summary, page_texts
from . import derived as D
from . import sql as S
from . import terms as T

Query = Callable[[SparkSession, str], DataFrame]

#: A vocabulary that occurs in the driver's documents, with every match mode.
OWN_POSITIVE = [
    ("the ", 4.0, "function_word", "case_insensitive"),
    ("tion", 3.5, "syllable", "case_insensitive"),
    ("nm", 1.1, "unit", "case_insensitive"),
    (" le ", 2.3, "function_word", "case_insensitive"),
    (" der ", 2.7, "function_word", "case_sensitive"),
    (r"\bun\b", 5.6, "function_word", "regex"),
    (r"\boffer\w*", 9.9, "trade", "regex"),
    ("The", 0.8, "capital", "case_sensitive"),
    ("$", 6.1, "trade", "case_insensitive"),
]
OWN_NEGATIVE = [("license", -5.0, "legal", "case_insensitive"), ("all rights reserved", -4.0, "legal", "case_insensitive"), ("###", -2.2, "markup", "case_insensitive")]


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(D.sql(spark, sf_dir, D.PAGES))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(D.sql(spark, sf_dir, D.CHATS))


def own_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_pages(pages(spark, sf_dir), OWN_POSITIVE, OWN_NEGATIVE)


def recorded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sql(spark, sf_dir, D.RECORDED).withColumn("extraction_targets_found", F.array().cast("array<string>"))


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.compare_scores(own_scores(spark, sf_dir), recorded_scores(spark, sf_dir))


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sql(spark, sf_dir, D.MARKDOWN)


def datasheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(D.sql(spark, sf_dir, D.DATASHEETS))


def raw_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw layout payload per conversation: pages of elements in some of the accepted shapes."""
    turns = D.sql(spark, sf_dir, "SELECT concat('conv_', conv_id) AS source_file, turn, role, text FROM {conversations}")
    box = F.array(*(F.col("turn") * F.lit(10.0) + F.lit(float(i)) for i in range(4)))
    element = F.struct(F.col("role").alias("label"), F.col("text").alias("text"), box.alias("bbox"))
    page = F.struct(F.col("turn").alias("turn"), F.struct(F.col("turn").alias("page_idx"), F.array(element).alias("elements")).alias("page"))
    payload = F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(page)), lambda p: p["page"]).alias("pages")))
    return turns.groupBy("source_file").agg(payload.alias("payload"))


NO_META = [c for c in layout.COLUMNS if c not in ("bbox", "metadata")]


def flat_boxes(blocks: DataFrame) -> DataFrame:
    return blocks.select(*NO_META, *(F.col(f"bbox.{k}").alias(k) for k in ("x0", "y0", "x1", "y1")))


def page_scores_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_pages(pages(spark, sf_dir))


def mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.page_mismatches(own_scores(spark, sf_dir), recorded_scores(spark, sf_dir))


def by_document(rows: DataFrame) -> DataFrame:
    """Rows as they are, the document's identifier without its metadata."""
    return rows.withColumn("document_id", D.apart("document_id"))


def graph_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The control graph with the extraction documents' nodes and edges merged in."""
    _, nodes, rels = D.extraction_documents(spark, sf_dir)
    return merged_tables(spark, nodes, rels)[:2]


def merged_tables(spark: SparkSession, nodes: DataFrame, rels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    start, links = graph.control(spark)
    all_nodes = graph.upsert_nodes(start, new_nodes(nodes))
    edges, errors = graph.upsert_edges(all_nodes, links, new_edges(rels))
    return all_nodes, edges, errors


def new_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("labels", "id", "properties", F.lit(0).cast("long").alias("turn"))


def new_edges(rels: DataFrame) -> DataFrame:
    return rels.select("source", "type", "target", "target_ref", F.create_map().cast("map<string,string>").alias("properties"), F.col("rel_ord").alias("turn"))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.label_counts(graph_tables(spark, sf_dir)[0])


def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_counts(graph_tables(spark, sf_dir)[1])


def reference_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, nodes, rels = D.extraction_documents(spark, sf_dir)
    return graph.reference_errors(graph.control(spark)[0], nodes.withColumn("turn", F.lit(0).cast("long")), rels)


def cleared_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, nodes, rels = D.extraction_documents(spark, sf_dir)
    left, edges = graph.upsert_cleared(*graph.control(spark), new_nodes(nodes), new_edges(rels))
    n = left.agg(F.lit("nodes").alias("kind"), F.count("*").alias("n"))
    return n.unionByName(edges.agg(F.lit("edges").alias("kind"), F.count("*").alias("n")))


def constraint_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that several parts share, as if they were names of parameter types."""
    parts = D.sql(spark, sf_dir, "SELECT p_name AS name FROM {part}")
    return graph.broken_constraints(parts.select(F.array(F.lit("ParameterType")).alias("labels"), F.create_map(F.lit("name"), F.col("name")).alias("properties")))


#: Statements around a name, and whether the guard lets them pass.
FORMS = [
    ("select", "SELECT '{}' AS a", True), ("with", "WITH t AS (SELECT '{}' AS a) SELECT * FROM t;", True), ("comment", "/* {} */ SELECT replace('{}', 'a', 'b') AS a", True),
    ("write", "DELETE FROM t WHERE a = '{}'", False), ("two", "SELECT '{}'; SELECT 1", False), ("hidden", "SELECT 'drop {}' AS a", False),
    ("java", "SELECT reflect('java.lang.System', 'getProperty', '{}')", False), ("file", "SELECT * FROM parquet.`/{}`", False), ("catalog", "SELECT * FROM other.t WHERE a = '{}'", False),
]


def guard_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard over statements made of the parts' types, one of each form."""
    names = D.sql(spark, sf_dir, "SELECT DISTINCT p_type AS name FROM {part}")
    forms = spark.createDataFrame([(k, f) for k, f, _ in FORMS], "kind string, form string")
    verdict = F.udf(lambda q: checks.read_only_problem(q) is None, "boolean", useArrow=True)
    return names.join(F.broadcast(forms)).select("name", "kind", verdict(F.replace("form", F.lit("{}"), F.col("name"))).alias("allowed"))


# What the schema checks must give.
EXPECTED_STATE = {
    "parameter_types": ["AngleOfHalfSensitivity", "DeviceType", "Dimensions", "Manufacturer", "PackageForm", "PackageType", "PeakSensitivityWavelength", "ProductModel"],
    "units": ["V", "bit", "degree", "g", "mm", "nm", "µA", "°C"],
    "equipment_types": ["AmbientLightSensor", "DigitalAccelerometer"],
    "allowed_units": {"AngleOfHalfSensitivity": ["degree"], "Dimensions": ["mm"], "PeakSensitivityWavelength": ["nm"]},
    "required_parameters": {"required_device_type": "DeviceType", "required_dimensions": "Dimensions", "required_package_form": "PackageForm", "required_peak_sensitivity_wavelength": "PeakSensitivityWavelength", "required_product_model": "ProductModel"},
    "relationship_definitions": {
        "ABOUT": {"from": "ValidationIssue", "to": "TechnicalParameter"}, "DESCRIBES": {"from": "Datasheet", "to": "Equipment"}, "EVIDENCED_BY": {"from": "TechnicalParameter", "to": "Evidence"},
        "GENERATED_BY": {"from": "TechnicalParameter", "to": "ExtractionRun"}, "HAS_EQUIPMENT_TYPE": {"from": "Equipment", "to": "Equipment"}, "HAS_PARAMETER": {"from": "Equipment", "to": "TechnicalParameter"},
        "HAS_PARAMETER_TYPE": {"from": "TechnicalParameter", "to": "ParameterType"}, "HAS_UNIT": {"from": "TechnicalParameter", "to": "Unit"},
    },
}
TARGETS = [
    {"check_id": check, "expected_result_key": key}
    for check, key in zip(("parameter_type_vocabulary", "unit_vocabulary", "equipment_type_vocabulary", "allowed_units", "required_parameters", "relationship_definitions"), EXPECTED_STATE, strict=True)
]


def run_schema_checks(spark: SparkSession, expected_state: dict) -> DataFrame:
    g = D.control_views(spark)
    expected = {t["expected_result_key"]: checks.expected_rows(spark, t["check_id"], expected_state[t["expected_result_key"]]) for t in TARGETS}
    return checks.run_checks(spark, TARGETS, expected, lambda t: checks.normalised(t["check_id"], questions.SCHEMA_CHECKS[t["check_id"]](g)))


def schema_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six schema checks against expectations of which two are wrong: a unit and the end of a relationship."""
    wrong = EXPECTED_STATE | {"units": [*EXPECTED_STATE["units"][:-1], "K"], "relationship_definitions": EXPECTED_STATE["relationship_definitions"] | {"HAS_UNIT": {"from": "Equipment", "to": "Unit"}}}
    return run_schema_checks(spark, wrong)


def check_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six schema checks against their fixed expectations, rolled up, beside the same with two wrong expectations."""
    good, bad = checks.rolled_up(run_schema_checks(spark, EXPECTED_STATE)), checks.rolled_up(schema_checks(spark, sf_dir))
    return good.withColumn("expectations", F.lit("right")).unionByName(bad.withColumn("expectations", F.lit("two wrong")))


def scorer(text: str) -> dict:
    """Stands for a model: a score from the length of what a model sees."""
    n = len(text) % 101
    return {"score": n, "relevance_level": "high" if n >= 75 else "medium" if n >= 50 else "low" if n >= 25 else "irrelevant", "useful_for_extraction": n >= 50, "likely_content_type": text[-11:], "reasoning": f"{len(text)} characters"}


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_with(pages(spark, sf_dir), scorer, "length").drop("extraction_targets_found")


MODEL_SCORES = """WITH seen AS (SELECT *, CASE WHEN length(text) <= 3500 THEN text ELSE substr(text, 1, 3500) || chr(10) || chr(10) || '[TRUNCATED]' END AS shown FROM ({pages})),
    n AS (SELECT *, length(shown) % 101 AS n FROM seen)
    SELECT source_file, page_number, char_count, CAST(n AS DOUBLE) AS score, CASE WHEN n >= 75 THEN 'high' WHEN n >= 50 THEN 'medium' WHEN n >= 25 THEN 'low' ELSE 'irrelevant' END AS relevance_level,
        n >= 50 AS useful_for_extraction, right(shown, 11) AS likely_content_type, length(shown) || ' characters' AS reasoning, 'length' AS llm_model FROM n"""


def select_as(strategy: str) -> Query:
    return lambda spark, sf_dir: compare.select_pages(compared(spark, sf_dir), strategy)


def summary_as(strategy: str) -> Query:
    return lambda spark, sf_dir: compare.selection_summary(compare.select_pages(compared(spark, sf_dir), strategy))


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {name: (lambda spark, sf_dir, f=f: f(D.graph(spark, sf_dir))) for name, f in questions.CQS.items()}
    found |= {f"check_{name}": (lambda spark, sf_dir, f=f: f(D.control_views(spark))) for name, f in questions.SCHEMA_CHECKS.items()}
    found |= {
        "page_texts": chats,
        "page_extraction_summary": lambda spark, sf_dir: extraction_summary(pages(spark, sf_dir)),
        "page_scores": own_scores,
        "page_scores_default_terms": page_scores_default,
        "page_scores_model": model_scores,
        "page_comparison": compared,
        "page_comparison_summary": lambda spark, sf_dir: compare.comparison_summary(compared(spark, sf_dir)),
        "page_set_mismatches": mismatches,
        "layout_lines": lambda spark, sf_dir: layout.line_blocks(datasheets(spark, sf_dir)).select(*NO_META),
        "layout_markdown": lambda spark, sf_dir: layout.markdown_blocks(markdown(spark, sf_dir)).select(*NO_META),
        "layout_elements": lambda spark, sf_dir: flat_boxes(layout.element_blocks(raw_layout(spark, sf_dir))),
        "layout_block_counts": lambda spark, sf_dir: layout.block_counts(layout.line_blocks(chats(spark, sf_dir))),
        "graph_violations": lambda spark, sf_dir: by_document(violations.violations(*D.extraction_documents(spark, sf_dir))),
        "graph_report": lambda spark, sf_dir: by_document(violations.report(*D.extraction_documents(spark, sf_dir))),
        "graph_loading_summary": lambda spark, sf_dir: by_document(graph.loading_summary(*D.extraction_documents(spark, sf_dir)[1:])),
        "graph_label_counts": label_counts,
        "graph_edge_counts": edge_counts,
        "graph_reference_errors": reference_errors,
        "graph_cleared": cleared_counts,
        "graph_constraint_breaches": constraint_breaches,
        "guard_verdicts": guard_verdicts,
        "schema_checks": schema_checks,
        "check_report": check_report,
    }
    for strategy in compare.STRATEGIES:
        found |= {f"page_selection_{strategy}": select_as(strategy), f"page_selection_{strategy}_summary": summary_as(strategy)}
    return found


def oracle_sql() -> dict[str, str]:
    pages_sql, chats_sql = S.normalised(D.PAGES), S.normalised(D.CHATS)
    own = S.scores(pages_sql, OWN_POSITIVE, OWN_NEGATIVE)
    both = S.compared(own)
    found = dict(S.CQS) | {f"check_{k}": v for k, v in S.SCHEMA_CHECKS.items()}
    labels = "SELECT label AS labels, count(DISTINCT id) AS n FROM nd WHERE label IN ('Datasheet', 'Equipment', 'TechnicalParameter', 'Evidence', 'ExtractionRun', 'ValidationIssue') GROUP BY label"
    known = f"rl.label = 'ParameterType' AND refkey = 'name' AND value IN ({', '.join(S.q(p) for p in EXPECTED_STATE['parameter_types'])})"
    # a node is its label and id, whatever document names it; ends are found by id alone
    ends = "keys AS (SELECT DISTINCT label, id FROM nd), local AS (SELECT DISTINCT type, s.label AS sl, rl.source, t.label AS tl, rl.target FROM rl JOIN keys s ON s.id = rl.source JOIN keys t ON t.id = rl.target UNION SELECT DISTINCT type, s.label, rl.source, 'ParameterType', rl.value FROM rl JOIN keys s ON s.id = rl.source WHERE " + known + ")"
    found |= {
        "page_texts": chats_sql,
        "page_extraction_summary": f"SELECT source_file, count(*) AS page_count, CAST(sum(char_count) AS BIGINT) AS total_chars, {S.page_list('char_count = 0')} AS empty_pages FROM ({pages_sql}) GROUP BY 1",
        "page_scores": own,
        "page_scores_default_terms": S.scores(pages_sql, T.POSITIVE, T.NEGATIVE),
        "page_scores_model": MODEL_SCORES.replace("{pages}", pages_sql),
        "page_comparison": f"{both} SELECT * FROM c",
        "page_comparison_summary": f"{both} {S.SUMMARY}",
        "page_set_mismatches": f"""WITH r AS (SELECT source_file, page_number FROM ({pages_sql})), l AS (SELECT source_file, page_number FROM ({D.duck(D.RECORDED)}))
            SELECT *, 'LLM-based' AS missing_in FROM (SELECT * FROM r EXCEPT SELECT * FROM l) UNION ALL SELECT *, 'rule-based' FROM (SELECT * FROM l EXCEPT SELECT * FROM r)""",
        "layout_lines": S.line_blocks(S.normalised(D.DATASHEETS)),
        "layout_markdown": S.markdown_blocks(D.duck(D.MARKDOWN)),
        "layout_elements": f"""WITH e AS (SELECT 'conv_' || conv_id AS source_file, CAST(turn + 1 AS INTEGER) AS page_number, 1 AS block_index, {S.strip('text')} AS text, turn, role,
                CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS reading_order FROM conversations),
            t AS (SELECT *, NULL AS section_heading FROM e)
            SELECT source_file, page_number, {S.NUMBERED}, block_index, {ELEMENT_TYPE} AS block_type, text, CAST(length(text) AS INTEGER) AS char_count, reading_order, CAST(NULL AS VARCHAR) AS section_heading,
                turn * CAST(10 AS DOUBLE) AS x0, turn * CAST(10 AS DOUBLE) + 1 AS y0, turn * CAST(10 AS DOUBLE) + 2 AS x1, turn * CAST(10 AS DOUBLE) + 3 AS y1 FROM t""",
        "layout_block_counts": f"WITH blk AS ({S.line_blocks(chats_sql)}) SELECT source_file, page_number, block_type, count(*) AS blocks, max(max(page_number)) OVER (PARTITION BY source_file) AS page_count FROM blk GROUP BY source_file, page_number, block_type",
        "graph_violations": f"{S.VIOLATIONS} SELECT * FROM v",
        "graph_report": S.REPORT,
        "graph_loading_summary": f"""WITH {S.DOCS}, n AS (SELECT document_id, count(*) AS c FROM nd GROUP BY 1), r AS (SELECT document_id, count(*) FILTER (WHERE label IS NULL) AS l, count(*) FILTER (WHERE label IS NOT NULL) AS v FROM rl GROUP BY 1)
            SELECT document_id, coalesce(c, 0) AS nodes_loaded, coalesce(l, 0) AS local_relationships_loaded, coalesce(v, 0) AS target_ref_relationships_loaded FROM n FULL JOIN r USING (document_id)""",
        "graph_label_counts": f"WITH {S.DOCS} {labels}",
        "graph_edge_counts": f"WITH {S.DOCS}, {ends} SELECT type, count(*) AS n FROM local GROUP BY type",
        "graph_reference_errors": f"""WITH {S.DOCS} SELECT DISTINCT source, type, 'target_ref did not match an existing node: label=' || label || ', key=' || refkey || ', value="' || value || '"' AS message FROM rl WHERE label IS NOT NULL AND NOT ({known})""",
        "graph_cleared": f"WITH {S.DOCS} SELECT 'nodes' AS kind, 39 + count(DISTINCT label || id) AS n FROM nd WHERE label IN ('Manual', 'Note') UNION ALL SELECT 'edges', CAST(42 AS BIGINT)",
        "graph_constraint_breaches": "SELECT 'ParameterType' AS label, p_name AS value, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1",
        "guard_verdicts": f"SELECT name, kind, allowed FROM (SELECT DISTINCT p_type AS name FROM part) CROSS JOIN (VALUES {', '.join(f'({S.q(k)}, {str(ok).lower()})' for k, _, ok in FORMS)}) k(kind, allowed)",
        "schema_checks": """SELECT * FROM (VALUES ('parameter_type_vocabulary', true, NULL), ('unit_vocabulary', false, 'rows differ'), ('equipment_type_vocabulary', true, NULL), ('allowed_units', true, NULL),
            ('required_parameters', true, NULL), ('relationship_definitions', false, 'rows differ')) t(check_id, passed, problem)""",
        "check_report": "SELECT CAST(6 AS BIGINT) AS total_checks, CAST(passed AS BIGINT) AS passed_checks, CAST(6 - passed AS BIGINT) AS failed_checks, passed = 6 AS passed, expectations FROM (VALUES (6, 'right'), (4, 'two wrong')) t(passed, expectations)",
    }
    for s in compare.STRATEGIES:
        chosen = f"{both}, {S.selected(s)}"
        found |= {f"page_selection_{s}": f"{chosen} SELECT * FROM t", f"page_selection_{s}_summary": f"{chosen} {S.SELECTION_SUMMARY}"}
    return found


ELEMENT_TYPE = "CASE " + " ".join(
    f"WHEN {' OR '.join(f'contains(lower(role), {S.q(p)})' for p in parts)} THEN {S.q(kind)}" for parts, kind in layout.LABELS
) + " ELSE " + S.legal(
    f"CASE WHEN {S.any_contains('lower(text)', [x.lower() for x in T.ELEMENT_PACKAGE_CUES])} THEN 'package_drawing' WHEN {S.regex('text', T.ELEMENT_FIGURES)} THEN 'figure_or_graph' WHEN {S.PIPES} OR {S.CAPTIONS} OR {S.CUES} THEN 'table_like' WHEN {S.LISTS} THEN 'list' WHEN length(text) < 100 AND {S.UPPER} THEN 'heading' WHEN text <> '' THEN 'paragraph' ELSE 'unknown' END"
) + " END"
