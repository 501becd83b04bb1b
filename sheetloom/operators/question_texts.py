"""The questions and schema checks as SQL over registered views: the texts that a guard reads and a generator may propose.

`register` makes the views: one per label, and `edges` (src, type, dst).
"""

from __future__ import annotations

from .graph import Views

PARAMETERS = """equipment e JOIN edges h ON h.src = e.key AND h.type = 'HAS_PARAMETER' JOIN technical_parameter p ON p.key = h.dst"""
TYPED = """(SELECT g.src, t.* FROM edges g JOIN parameter_type t ON t.key = g.dst WHERE g.type = 'HAS_PARAMETER_TYPE')"""
UNIT = """(SELECT g.src, u.* FROM edges g JOIN unit u ON u.key = g.dst WHERE g.type = 'HAS_UNIT')"""

TEXTS = {
    "cq1_extracted_equipment": """SELECT d.id AS datasheet_id, d.file_name, d.document_type, e.id AS equipment_id, e.product_model, e.manufacturer, e.raw_equipment_type,
        k.name AS normalized_equipment_type, k.display_name AS normalized_equipment_type_display_name
        FROM datasheet d JOIN edges s ON s.src = d.key AND s.type = 'DESCRIBES' JOIN equipment e ON e.key = s.dst
        LEFT JOIN (SELECT g.src, t.* FROM edges g JOIN equipment_type t ON t.key = g.dst WHERE g.type = 'HAS_EQUIPMENT_TYPE') k ON k.src = e.key
        ORDER BY datasheet_id NULLS LAST, equipment_id NULLS LAST""",
    "cq2_technical_parameters": f"""SELECT e.id AS equipment_id, e.product_model, e.raw_equipment_type, p.id AS parameter_id, p.raw_label, p.value, p.value_type,
        t.name AS normalized_parameter_type, t.display_name AS parameter_display_name, t.parameter_category, u.symbol AS unit, u.name AS unit_name
        FROM {PARAMETERS} JOIN {TYPED} t ON t.src = p.key LEFT JOIN {UNIT} u ON u.src = p.key
        ORDER BY equipment_id NULLS LAST, normalized_parameter_type NULLS LAST, raw_label NULLS LAST""",
    "cq3_parameter_evidence": f"""SELECT e.id AS equipment_id, e.product_model, p.id AS parameter_id, p.raw_label, p.value, t.name AS normalized_parameter_type, u.symbol AS unit, v.id AS evidence_id,
        v.page_number, v.content_block_id, v.source_text, v.evidence_type, v.evidence_status, v.confidence, v.extraction_method
        FROM {PARAMETERS} JOIN {TYPED} t ON t.src = p.key LEFT JOIN {UNIT} u ON u.src = p.key
        LEFT JOIN (SELECT g.src, w.* FROM edges g JOIN evidence w ON w.key = g.dst WHERE g.type = 'EVIDENCED_BY') v ON v.src = p.key
        ORDER BY equipment_id NULLS LAST, normalized_parameter_type NULLS LAST, confidence DESC NULLS FIRST""",
    "cq4_vocabulary_grounding": f"""SELECT e.id AS equipment_id, e.product_model, p.id AS parameter_id, p.raw_label, p.value, t.name AS grounded_parameter_type, t.display_name AS parameter_display_name,
        CASE WHEN t.src IS NOT NULL THEN 'grounded' ELSE 'not_grounded' END AS parameter_type_grounding_status, u.symbol AS grounded_unit,
        CASE WHEN u.src IS NOT NULL THEN 'grounded' WHEN t.expects_unit THEN 'missing_unit_grounding' ELSE 'not_required' END AS unit_grounding_status,
        t.expects_unit AS parameter_type_expects_unit
        FROM {PARAMETERS} LEFT JOIN {TYPED} t ON t.src = p.key LEFT JOIN {UNIT} u ON u.src = p.key
        ORDER BY equipment_id NULLS LAST, parameter_type_grounding_status, unit_grounding_status, raw_label NULLS LAST""",
    "cq5_required_parameter_status": f"""WITH has AS (SELECT e.key AS equipment_key, e.id AS equipment_id, e.product_model, p.key AS parameter_key, p.raw_label, p.value, t.key AS type_key, t.name AS parameter_type, t.expects_unit
            FROM {PARAMETERS} JOIN {TYPED} t ON t.src = p.key),
        needed AS (SELECT r.reason, t.key AS type_key, t.name AS parameter_type FROM required_parameter r JOIN edges g ON g.src = r.key AND g.type = 'REQUIRES_PARAMETER_TYPE' JOIN parameter_type t ON t.key = g.dst)
        SELECT e.id AS equipment_id, e.product_model, 'MISSING_REQUIRED_PARAMETER' AS issue_type, n.parameter_type, CAST(NULL AS STRING) AS raw_label, CAST(NULL AS STRING) AS value, CAST(NULL AS STRING) AS unit, n.reason AS detail
        FROM equipment e CROSS JOIN needed n WHERE NOT EXISTS (SELECT 1 FROM has h WHERE h.equipment_key = e.key AND h.type_key = n.type_key)
        UNION SELECT h.equipment_id, h.product_model, 'UNSUPPORTED_UNIT', h.parameter_type, h.raw_label, h.value, u.symbol, 'The extracted unit is not listed as an allowed unit for this ParameterType.'
        FROM has h JOIN {UNIT} u ON u.src = h.parameter_key WHERE NOT EXISTS (SELECT 1 FROM edges a WHERE a.type = 'ALLOWS_UNIT' AND a.src = h.type_key AND a.dst = u.key)
        UNION SELECT h.equipment_id, h.product_model, 'MISSING_EXPECTED_UNIT', h.parameter_type, h.raw_label, h.value, NULL, 'This ParameterType expects a unit, but the extracted parameter has no HAS_UNIT relationship.'
        FROM has h WHERE h.expects_unit AND NOT EXISTS (SELECT 1 FROM {UNIT} u WHERE u.src = h.parameter_key)
        ORDER BY equipment_id NULLS LAST, issue_type, parameter_type NULLS LAST""",
    "parameter_type_vocabulary": "SELECT name AS parameter_type FROM parameter_type ORDER BY parameter_type",
    "unit_vocabulary": "SELECT symbol AS unit FROM unit ORDER BY unit",
    "equipment_type_vocabulary": "SELECT name AS equipment_type FROM equipment_type ORDER BY equipment_type",
    "allowed_units": "SELECT t.name AS parameter_type, sort_array(collect_list(u.symbol)) AS allowed_units FROM parameter_type t JOIN edges a ON a.src = t.key AND a.type = 'ALLOWS_UNIT' JOIN unit u ON u.key = a.dst GROUP BY t.name ORDER BY parameter_type",
    "required_parameters": "SELECT r.id AS required_parameter, t.name AS parameter_type FROM required_parameter r JOIN edges g ON g.src = r.key AND g.type = 'REQUIRES_PARAMETER_TYPE' JOIN parameter_type t ON t.key = g.dst ORDER BY required_parameter",
    "relationship_definitions": "SELECT r.name AS relationship, f.name AS from_concept, c.name AS to_concept FROM relationship_definition r JOIN edges x ON x.src = r.key AND x.type = 'FROM_CONCEPT' JOIN concept f ON f.key = x.dst JOIN edges y ON y.src = r.key AND y.type = 'TO_CONCEPT' JOIN concept c ON c.key = y.dst ORDER BY relationship",
}


def register(g: Views) -> None:
    """Make the views of a graph known to SQL."""
    for name, table in g.tables.items():
        table.createOrReplaceTempView(name)
    g.all_edges.createOrReplaceTempView("edges")
