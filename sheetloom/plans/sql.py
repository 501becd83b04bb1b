"""DuckDB SQL for the rows of the registered queries, stated independently of the DataFrame plans."""

from __future__ import annotations

from . import derived as D
from . import terms as T
from . import vocabulary as V

WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"



def normalised(source: str) -> str:
    text = strip(r"regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g')")
    return f"SELECT source_file, page_number, {text} AS text, CAST(length({text}) AS INTEGER) AS char_count FROM ({D.duck(source)})"


def boundary(pattern: str) -> str:
    """A word pattern with Unicode-aware boundaries, for an engine whose own are ASCII."""
    inner = pattern.removeprefix(r"\b").removesuffix(r"\b")
    return rf"(^|[^\p{{L}}\p{{N}}_]){inner}($|[^\p{{L}}\p{{N}}_])"


def matches(term: str, mode: str) -> str:
    if mode == "case_insensitive":
        return f"contains(lower(text), {q(term.lower())})"
    if mode == "case_sensitive":
        return f"contains(text, {q(term)})"
    return f"regexp_matches(text, {q(boundary(term))}, 'i')"


def scores(pages: str, positive: list, negative: list) -> str:
    """Weights are added from left to right by a chain of additions."""
    terms = [(t, False) for t in positive] + [(t, True) for t in negative]
    flags = ", ".join(f"{matches(t[0], t[3])} AS m{i}" for i, (t, _) in enumerate(terms))
    total = "CAST(0 AS DOUBLE)"
    for i, (t, _) in enumerate(terms):
        total = f"({total} + CASE WHEN m{i} THEN CAST({t[1]} AS DOUBLE) ELSE 0 END)"
    listed = lambda rows: "list_filter([" + ", ".join(rows) + "], lambda v: v IS NOT NULL)"
    names = listed([f"CASE WHEN m{i} THEN {q(t[0])} END" for i, (t, _) in enumerate(terms)])
    kinds = listed([f"CASE WHEN m{i} THEN {q(t[2])} END" for i, (t, _) in enumerate(terms)])
    said = lambda neg: listed([f"CASE WHEN m{i} THEN {q(('' if n else '+') + f'{t[1]:g}: matched {t[2]} term ' + chr(39) + t[0] + chr(39))} END" for i, (t, n) in enumerate(terms) if n == neg] + (["CASE WHEN char_count < 100 THEN '-3: very short extracted text' END"] if neg else []))
    return f"""WITH p AS ({pages}), hit AS (SELECT source_file, page_number, char_count, {flags} FROM p),
        raw AS (SELECT *, greatest({total} - CASE WHEN char_count < 100 THEN 3.0 ELSE 0.0 END, CAST(0 AS DOUBLE)) AS r FROM hit)
        SELECT source_file, page_number, round(r, 2) AS score,
            CASE WHEN r >= 20 THEN 'high' WHEN r >= 10 THEN 'medium' WHEN r >= 3 THEN 'low' ELSE 'irrelevant' END AS relevance_level,
            char_count, {names} AS matched_terms, list_sort(list_distinct({kinds})) AS matched_categories,
            {said(False)} AS positive_reasons, {said(True)} AS negative_reasons FROM raw"""


# --- graph questions -------------------------------------------------------------------------------------------------

GRAPH = f"""line AS ({D.duck(D.LINES)}), sheet AS ({D.duck(D.SHEETS)}), eq AS ({D.duck(D.EQUIPMENT)}), kind AS ({D.duck(D.KINDS)}),
    evidence AS ({D.duck(D.EVIDENCE)}), types AS ({D.duck(D.TYPES)}), required AS ({D.duck(D.REQUIRED)}), allowed AS ({D.duck(D.ALLOWED)}),
    units AS (SELECT * FROM (VALUES {', '.join(f'({q(u[0])}, {q(u[1])})' for u in V.UNITS)}) AS t(symbol, unit_name)),
    has AS (SELECT DISTINCT eq.id AS equipment_id, product_model, raw_equipment_type, l.id AS parameter_id FROM line l JOIN eq ON eq.id = l.e),
    par AS (SELECT DISTINCT id, raw_label, value FROM line), par_type AS (SELECT DISTINCT l.id, t.name, t.expects_unit FROM line l JOIN types t ON t.name = l.raw_label),
    par_unit AS (SELECT DISTINCT l.id, u.symbol, u.unit_name FROM line l JOIN units u ON u.symbol = l.unit),
    base AS (SELECT h.*, p.raw_label, p.value FROM has h JOIN par p ON p.id = h.parameter_id)"""

CQS = {
    "cq1_extracted_equipment": f"""WITH {GRAPH}, d AS ({D.duck(D.DESCRIBES)})
        SELECT sheet.id AS datasheet_id, file_name, document_type, eq.id AS equipment_id, product_model, manufacturer, raw_equipment_type,
            kind.name AS normalized_equipment_type, kind.display_name AS normalized_equipment_type_display_name
        FROM d JOIN sheet ON sheet.id = d.src JOIN eq ON eq.id = d.dst LEFT JOIN kind ON kind.name = eq.raw_equipment_type""",
    "cq2_technical_parameters": f"""WITH {GRAPH} SELECT equipment_id, product_model, raw_equipment_type, parameter_id, raw_label, value, 'number' AS value_type,
            t.name AS normalized_parameter_type, 'Type ' || t.name AS parameter_display_name, 'flag_' || t.name[1] AS parameter_category, u.symbol AS unit, u.unit_name
        FROM base JOIN par_type t ON t.id = parameter_id LEFT JOIN par_unit u ON u.id = parameter_id""",
    "cq3_parameter_evidence": f"""WITH {GRAPH}, ev AS (SELECT DISTINCT l.id AS p, e.* FROM line l JOIN evidence e ON e.id = 'evidence_' || l.l_orderkey)
        SELECT equipment_id, product_model, parameter_id, raw_label, value, t.name AS normalized_parameter_type, u.symbol AS unit, ev.id AS evidence_id,
            page_number, content_block_id, source_text, evidence_type, evidence_status, confidence, extraction_method
        FROM base JOIN par_type t ON t.id = parameter_id LEFT JOIN par_unit u ON u.id = parameter_id LEFT JOIN ev ON ev.p = parameter_id""",
    "cq4_vocabulary_grounding": f"""WITH {GRAPH} SELECT equipment_id, product_model, parameter_id, raw_label, value, t.name AS grounded_parameter_type,
            'Type ' || t.name AS parameter_display_name, CASE WHEN t.name IS NULL THEN 'not_grounded' ELSE 'grounded' END AS parameter_type_grounding_status,
            u.symbol AS grounded_unit, CASE WHEN u.symbol IS NOT NULL THEN 'grounded' WHEN t.expects_unit THEN 'missing_unit_grounding' ELSE 'not_required' END AS unit_grounding_status,
            t.expects_unit AS parameter_type_expects_unit
        FROM base LEFT JOIN par_type t ON t.id = parameter_id LEFT JOIN par_unit u ON u.id = parameter_id""",
    "cq5_required_parameter_status": f"""WITH {GRAPH}, full_set AS (SELECT base.*, t.name, t.expects_unit FROM base JOIN par_type t ON t.id = parameter_id)
        SELECT eq.id AS equipment_id, eq.product_model, 'MISSING_REQUIRED_PARAMETER' AS issue_type, r.name AS parameter_type, NULL AS raw_label, NULL AS value, NULL AS unit, r.name || ' is required' AS detail
        FROM eq CROSS JOIN required r WHERE NOT EXISTS (SELECT 1 FROM full_set f WHERE f.equipment_id = eq.id AND f.name = r.name)
        UNION SELECT equipment_id, product_model, 'UNSUPPORTED_UNIT', name, raw_label, value, u.symbol, 'The extracted unit is not listed as an allowed unit for this ParameterType.'
        FROM full_set f JOIN par_unit u ON u.id = f.parameter_id WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.name = f.name AND a.unit = u.symbol)
        UNION SELECT equipment_id, product_model, 'MISSING_EXPECTED_UNIT', name, raw_label, value, NULL, 'This ParameterType expects a unit, but the extracted parameter has no HAS_UNIT relationship.'
        FROM full_set f WHERE expects_unit AND NOT EXISTS (SELECT 1 FROM par_unit u WHERE u.id = f.parameter_id)""",
}


def values(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(q(x) for x in r) + ')' for r in rows)}) AS t({names})"


SCHEMA_CHECKS = {
    "parameter_type_vocabulary": values([(p[0],) for p in V.PARAMETER_TYPES], "parameter_type"),
    "unit_vocabulary": values([(u[0],) for u in V.UNITS], "unit"),
    "equipment_type_vocabulary": values([(e[0],) for e in V.EQUIPMENT_TYPES], "equipment_type"),
    "allowed_units": f"SELECT parameter_type, list(unit ORDER BY unit) AS allowed_units FROM ({values(V.ALLOWED, 'parameter_type, unit')}) GROUP BY 1",
    "required_parameters": values([(r[0], r[2]) for r in V.REQUIRED], "required_parameter, parameter_type"),
    "relationship_definitions": values([(r[0], r[2], r[3]) for r in V.RELATIONSHIPS], "relationship, from_concept, to_concept"),
}

# --- comparison and selection ----------------------------------------------------------------------------------------


def compared(rule: str) -> str:
    return f"""WITH rule AS ({rule}), llm AS ({D.duck(D.RECORDED)}),
        a AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY score DESC, page_number) AS rank FROM rule),
        b AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY score DESC, page_number) AS rank FROM llm),
        j AS (SELECT a.source_file, a.page_number, round(a.score, 2) AS rule_based_score, a.relevance_level AS rule_based_level, a.relevance_level IN ('high', 'medium') AS rule_based_selected,
            CAST(a.rank AS INTEGER) AS rule_based_rank, round(b.score, 2) AS llm_score, b.relevance_level AS llm_level, b.relevance_level IN ('high', 'medium') AS llm_selected, CAST(b.rank AS INTEGER) AS llm_rank,
            b.useful_for_extraction AS llm_useful_for_extraction, b.likely_content_type AS llm_likely_content_type, round(b.score - a.score, 2) AS score_difference_raw,
            a.matched_categories AS rule_based_matched_categories, CAST([] AS VARCHAR[]) AS llm_extraction_targets_found
            FROM a JOIN b ON a.source_file = b.source_file AND a.page_number = b.page_number),
        c AS (SELECT *, rule_based_level = llm_level AS agreement_on_level, rule_based_selected = llm_selected AS agreement_on_selection, rule_based_rank - llm_rank AS rank_difference,
            CASE WHEN rule_based_selected = llm_selected AND rule_based_level = llm_level THEN 'Both methods agree on relevance level and selection.'
                WHEN rule_based_selected = llm_selected THEN 'Both methods agree on selection, but assign different relevance levels.'
                WHEN rule_based_selected THEN 'Rule-based scorer selects this page, but LLM-based scorer does not.'
                ELSE 'LLM-based scorer selects this page, but rule-based scorer does not.' END AS comparison_note FROM j)"""


def page_list(condition: str) -> str:
    return f"coalesce(list(page_number ORDER BY page_number) FILTER (WHERE {condition}), [])"


SUMMARY = f"""SELECT source_file, count(*) AS page_count, count(*) FILTER (WHERE agreement_on_level) AS agreement_on_level_count, count(*) FILTER (WHERE agreement_on_selection) AS agreement_on_selection_count,
    count(*) FILTER (WHERE NOT agreement_on_level) AS disagreement_on_level_count, count(*) FILTER (WHERE NOT agreement_on_selection) AS disagreement_on_selection_count,
    {page_list('NOT agreement_on_level')} AS pages_with_level_disagreement, {page_list('NOT agreement_on_selection')} AS pages_with_selection_disagreement,
    {page_list('rule_based_selected')} AS rule_based_selected_pages, {page_list('llm_selected')} AS llm_based_selected_pages, {page_list('rule_based_selected AND llm_selected')} AS intersection_selected_pages,
    {page_list('rule_based_selected AND NOT llm_selected')} AS rule_only_selected_pages, {page_list('llm_selected AND NOT rule_based_selected')} AS llm_only_selected_pages,
    source_file AS rule_based_source_file, source_file AS llm_based_source_file, true AS same_source_file FROM c GROUP BY source_file"""

SELECTED = {
    "union": ("'selected'", "'selected'", "'Selected because both scorers selected this page.'", "'Selected because the rule-based scorer selected this page.'", "'Selected because the LLM-based scorer selected this page.'"),
    "intersection": ("'selected'", "'discarded'", "'Selected because both scorers selected this page.'", "'Discarded because only the rule-based scorer selected this page.'", "'Discarded because only the LLM-based scorer selected this page.'"),
    "hybrid": ("'selected_primary'", "'selected_secondary'", "'Selected as primary because both scorers selected this page.'", "'Selected as secondary because only the rule-based scorer selected this page.'", "'Selected as secondary because only the LLM-based scorer selected this page.'"),
}


def selected(strategy: str) -> str:
    both, one, why_both, why_rule, why_llm = SELECTED[strategy]
    return f"""s AS (SELECT source_file, page_number, CASE WHEN rule_based_selected AND llm_selected THEN {both} WHEN rule_based_selected OR llm_selected THEN {one} ELSE 'discarded' END AS selection_status,
        {q(strategy)} AS selection_strategy, rule_based_selected, rule_based_level, rule_based_score, rule_based_rank, llm_selected, llm_level, llm_score, llm_rank, llm_useful_for_extraction, llm_likely_content_type,
        agreement_on_selection, agreement_on_level, CASE WHEN rule_based_selected AND llm_selected THEN {why_both} WHEN rule_based_selected THEN {why_rule} WHEN llm_selected THEN {why_llm}
        ELSE 'Discarded because neither scorer selected this page.' END AS decision_reason FROM c),
        t AS (SELECT *, selection_status <> 'discarded' AS selected_for_extraction FROM s)"""


SELECTION_SUMMARY = f"""SELECT source_file, selection_strategy AS strategy, 'page_selection_' || selection_strategy || '_v1' AS selection_method, count(*) AS page_count,
    count(*) FILTER (WHERE selected_for_extraction) AS selected_page_count, count(*) FILTER (WHERE NOT selected_for_extraction) AS discarded_page_count,
    {page_list('selected_for_extraction')} AS selected_pages, {page_list("selection_status IN ('selected', 'selected_primary')")} AS selected_primary_pages,
    {page_list("selection_status = 'selected_secondary'")} AS selected_secondary_pages, {page_list('NOT selected_for_extraction')} AS discarded_pages FROM t GROUP BY ALL"""

# --- layout ----------------------------------------------------------------------------------------------------------

LONGEST = sorted(T.HEADINGS, key=len, reverse=True)


def any_contains(c: str, items: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(i)})" for i in items) + ")"


def regex(c: str, patterns: list[str]) -> str:
    """Patterns that begin with a boundary, spelled out for Unicode."""
    inner = "|".join(p.removeprefix(r"\b") for p in patterns)
    return rf"regexp_matches({c}, '(^|[^\p{{L}}\p{{N}}_])(?:{inner})', 'i')".replace(r"\d", r"\p{Nd}").replace(r"\s", f"[{WS}]")


def legal(rest: str) -> str:
    return f"CASE WHEN {any_contains('lower(text)', [x.lower() for x in T.LEGAL_CUES])} THEN CASE WHEN length(text) < 300 AND NOT contains(text, 'Legal Disclaimer') THEN 'boilerplate' ELSE 'legal' END ELSE {rest} END"


CUES = "(" + " + ".join(f"CAST(contains(upper(text), {q(x)}) AS INTEGER)" for x in T.TABLE_CUES) + ") >= 3"
SYMBOLS = r"(regexp_matches(upper(text), '(^|[^\p{L}\p{N}_])(VCEO|VECO|IPCE|TAMB|TSTG|PV|IC|TSD)($|[^\p{L}\p{N}_])') AND regexp_matches(text, '((^|[^\p{L}\p{N}_])(V|MA|MW|PF|NM|DEG|K/W|[μµ]A)($|[^\p{L}\p{N}_]))|([\p{L}\p{N}_]°C($|[^\p{L}\p{N}_]))', 'i'))"
DIMENSIONS = f"upper(section_heading) IN ({', '.join(map(q, T.DIMENSION_HEADINGS))})"
UPPER = "(upper(text) = text AND lower(text) <> text)"
LISTS = "(starts_with(text, '- ') OR starts_with(text, '* ') OR starts_with(text, '•'))"
CAPTIONS = regex("text", T.TABLE_CAPTIONS)
PIPES = "(contains(text, '|') AND contains(text, '---'))"
LINE_TYPE = f"CASE WHEN text = '' THEN 'unknown' WHEN upper(text) IN ({', '.join(q(h.upper()) for h in T.HEADINGS)}) THEN 'heading' ELSE " + legal(
    f"CASE WHEN {any_contains('lower(text)', [x.lower() for x in T.PACKAGE_CUES])} OR coalesce({DIMENSIONS}, false) THEN 'package_drawing' WHEN {regex('text', T.LINE_FIGURES)} THEN 'figure_or_graph' WHEN {CUES} OR {SYMBOLS} THEN 'table_like' WHEN starts_with(text, '•') THEN 'list' WHEN length(text) < 80 AND {UPPER} THEN 'heading' ELSE 'paragraph' END"
) + " END"
MARKDOWN_TYPE = "CASE WHEN text = '' THEN 'unknown' WHEN starts_with(text, '#') THEN 'heading' ELSE " + legal(
    f"CASE WHEN {any_contains('lower(text)', [x.lower() for x in T.PACKAGE_CUES])} OR coalesce({DIMENSIONS}, false) THEN 'package_drawing' WHEN {regex('text', T.LINE_FIGURES)} THEN 'figure_or_graph' WHEN {PIPES} OR {CAPTIONS} OR {CUES} OR {SYMBOLS} THEN 'table_like' WHEN {LISTS} THEN 'list' WHEN length(text) < 100 AND {UPPER} THEN 'heading' ELSE 'paragraph' END"
) + " END"
CONTAINED = "CASE " + " ".join(f"WHEN contains(upper(line), {q(h.upper())}) THEN {q(h)}" for h in LONGEST) + " END"
TITLE = f"upper({strip('ltrim(text, chr(35))')})"
TITLE_HEADING = "CASE " + " ".join(f"WHEN {TITLE} = {q(h.upper())} THEN {q(h)}" for h in LONGEST) + " " + " ".join(f"WHEN contains({TITLE}, {q(h.upper())}) THEN {q(h)}" for h in LONGEST) + " END"
NUMBERED = "'page_' || page_number || '_block_' || CASE WHEN block_index < 1000 THEN lpad(CAST(block_index AS VARCHAR), 3, '0') ELSE CAST(block_index AS VARCHAR) END AS block_id"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def line_blocks(pages: str) -> str:
    """A state machine over the lines of each page, as a recursive query: the state is the running heading and whether text
    runs before the line."""
    return f"""WITH RECURSIVE pg AS ({pages}), raw AS (SELECT source_file, page_number, list_filter(list_transform(regexp_split_to_array(text, '{LINE_END}'), lambda x: {strip('x')}), lambda x: x <> '') AS ls FROM pg),
        ln AS (SELECT source_file, page_number, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) AS BIGINT) AS i FROM raw),
        f AS (SELECT *, upper(line) IN ({', '.join(q(h.upper()) for h in T.HEADINGS)}) AS x, {CONTAINED} AS d, {regex('line', T.LINE_FIGURES)} AS fig FROM ln),
        st AS (
            SELECT source_file, page_number, i, line, CASE WHEN x THEN line ELSE d END AS head, CAST(1 AS BIGINT) AS block, NOT x AS runs FROM f WHERE i = 1
            UNION ALL
            SELECT f.source_file, f.page_number, f.i, f.line,
                CASE WHEN f.x THEN f.line WHEN f.d IS NOT NULL AND upper(f.d) <> upper(coalesce(st.head, '')) THEN f.d ELSE st.head END,
                st.block + CASE WHEN f.x OR NOT st.runs OR (f.d IS NOT NULL AND upper(f.d) <> upper(coalesce(st.head, ''))) OR f.fig THEN 1 ELSE 0 END,
                CASE WHEN f.x THEN false WHEN f.fig AND st.runs AND NOT (f.d IS NOT NULL AND upper(f.d) <> upper(coalesce(st.head, ''))) THEN false ELSE true END
            FROM st JOIN f ON f.source_file = st.source_file AND f.page_number = st.page_number AND f.i = st.i + 1),
        b AS (SELECT source_file, page_number, CAST(block AS INTEGER) AS block_index, string_agg(line, chr(10) ORDER BY i) AS text, min(head) AS section_heading FROM st GROUP BY ALL
            UNION ALL SELECT source_file, page_number, 1, '', NULL FROM raw WHERE len(ls) = 0)
        SELECT source_file, page_number, {NUMBERED}, block_index, {LINE_TYPE} AS block_type, text, CAST(length(text) AS INTEGER) AS char_count, block_index AS reading_order, section_heading FROM b"""


def markdown_blocks(docs: str) -> str:
    return rf"""WITH doc AS ({docs}), raw AS (SELECT source_file, list_transform(regexp_split_to_array(coalesce(markdown, ''), '{LINE_END}'), lambda x: {strip('x')}) AS ls FROM doc),
        ln AS (SELECT source_file, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) AS BIGINT) AS i FROM raw),
        k AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN line[1] = '#' THEN 'heading' WHEN line[1] = '|' AND line[-1] = '|' THEN 'table' WHEN starts_with(line, '- ') OR starts_with(line, '* ') OR line[1] = '•' THEN 'list' ELSE 'plain' END AS kind FROM ln),
        c AS (SELECT *, CASE WHEN kind = 'heading' OR lag(kind) OVER w IS NULL OR lag(kind) OVER w <> kind THEN 1 ELSE 0 END AS cut FROM k WINDOW w AS (PARTITION BY source_file ORDER BY i)),
        n AS (SELECT *, sum(cut) OVER (PARTITION BY source_file ORDER BY i ROWS UNBOUNDED PRECEDING) AS n FROM c),
        t AS (SELECT source_file, n, string_agg(line, chr(10) ORDER BY i) AS text FROM n WHERE kind <> 'blank' GROUP BY ALL),
        h AS (SELECT *, {TITLE_HEADING} AS cand, try_cast(regexp_extract(text, 'Rev\.\s*[\d.]+,\s*[\w-]+\s+(\d+)\s+Document Number', 1) AS INTEGER) AS inferred FROM t),
        m AS (SELECT source_file, text, CAST(row_number() OVER w AS INTEGER) AS reading_order, greatest(1, coalesce(max(inferred) OVER (w ROWS UNBOUNDED PRECEDING), 1)) AS page_number,
            last_value(cand IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS section_heading FROM h WINDOW w AS (PARTITION BY source_file ORDER BY n)),
        b AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_file, page_number ORDER BY reading_order) AS INTEGER) AS block_index FROM m)
        SELECT source_file, page_number, {NUMBERED}, block_index, {MARKDOWN_TYPE} AS block_type, text, CAST(length(text) AS INTEGER) AS char_count, reading_order, section_heading FROM b"""

# --- validation of extraction documents --------------------------------------------------------------------------------

DOCS = f"""docs AS ({D.duck(D.DOC_DOCUMENTS)}), nd AS ({D.duck(D.DOC_NODES)}), rl AS ({D.duck(D.DOC_RELS)}),
    ids AS (SELECT DISTINCT document_id, id FROM nd)"""


def lacking(rule_id: str, label: str, kind: str) -> str:
    prefix = f"{label} '" if label == "TechnicalParameter" else f"{label} node '"
    return f"SELECT document_id, '{rule_id}', id, {q(prefix)} || id || {q(chr(39) + f' has no {kind} relationship.')} FROM nd WHERE label = '{label}' AND NOT EXISTS (SELECT 1 FROM rl WHERE rl.document_id = nd.document_id AND rl.source = nd.id AND rl.type = '{kind}')"


VIOLATIONS = f"""WITH {DOCS}, v AS (
    SELECT document_id, 'V3' AS rule_id, id AS subject_id, 'Duplicate node IDs found: ' || id AS message FROM nd GROUP BY document_id, id HAVING count(*) > 1
    UNION ALL SELECT document_id, 'V4', source, 'Relationship source ''' || source || ''' does not exist in nodes.' FROM rl WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.document_id = rl.document_id AND ids.id = rl.source)
    UNION ALL SELECT document_id, 'V4', target, 'Relationship target ''' || target || ''' does not exist in nodes.' FROM rl WHERE target IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ids WHERE ids.document_id = rl.document_id AND ids.id = rl.target)
    UNION ALL SELECT document_id, 'V1', id, 'Node ids and labels must not be empty.' FROM nd WHERE id = chr(9)
    UNION ALL SELECT document_id, 'V1', document_id, 'document_id and schema_version must not be empty.' FROM docs WHERE schema_version = chr(9)
    UNION ALL SELECT document_id, 'V2', source, 'Each relationship must define exactly one of ''target'' or ''target_ref''.' FROM rl WHERE (target IS NULL) = (label IS NULL)
    UNION ALL SELECT document_id, 'V5', document_id, 'document_id must match the id of a node with label ''Datasheet''.' FROM docs WHERE s_suppkey % 7 = 3 OR s_suppkey < 0
    UNION ALL SELECT document_id, 'V6', extraction_scope, 'Unknown extraction_scope.' FROM docs WHERE s_suppkey % 11 = 5
    UNION ALL SELECT document_id, 'V8', source, 'Duplicate relationship found: source=' || source || ', type=' || type || ', target=' || tgt FROM (
        SELECT *, row_number() OVER (PARTITION BY document_id, source, type, tgt ORDER BY k) AS turn FROM (SELECT *, CASE WHEN target IS NOT NULL THEN 'target:' || target ELSE 'target_ref:' || label || ':' || refkey || ':' || value END AS tgt FROM rl)) WHERE turn > 1
    UNION ALL SELECT d.document_id, 'V9', l.label, 'At least one ' || l.label || ' node is required.' FROM docs d CROSS JOIN (VALUES ('Datasheet'), ('Equipment'), ('TechnicalParameter'), ('Evidence'), ('ExtractionRun')) l(label)
        WHERE NOT EXISTS (SELECT 1 FROM nd WHERE nd.document_id = d.document_id AND nd.label = l.label)
    UNION ALL {lacking('V10', 'Datasheet', 'DESCRIBES')} UNION ALL {lacking('V11', 'Equipment', 'HAS_PARAMETER')} UNION ALL {lacking('V12', 'TechnicalParameter', 'HAS_PARAMETER_TYPE')}
    UNION ALL {lacking('V13', 'TechnicalParameter', 'EVIDENCED_BY')} UNION ALL {lacking('V14', 'TechnicalParameter', 'GENERATED_BY')}
    UNION ALL SELECT document_id, 'V15', source, 'Relationship ''' || type || ''' from ''' || source || ''' should use target_ref instead of local target.' FROM rl WHERE type = 'HAS_PARAMETER_TYPE' AND label IS NULL
    UNION ALL SELECT document_id, 'V15', source, 'Relationship ''' || type || ''' from ''' || source || ''' has invalid target_ref. Expected label/key (ParameterType, name), got (' || label || ', ' || refkey || ').' FROM rl WHERE type = 'HAS_PARAMETER_TYPE' AND label <> 'ParameterType'
    UNION ALL SELECT document_id, 'V16', id, 'Evidence node ''' || id || ''' is missing required property ''source_document_id''.' FROM nd WHERE label = 'Evidence' AND bare
    UNION ALL SELECT document_id, 'V19', id, 'TechnicalParameter node ''' || id || ''' is missing recommended MVP property ''value_type''.' FROM nd WHERE label = 'TechnicalParameter' AND bare
    UNION ALL SELECT document_id, 'V17', id, 'Evidence node ''' || id || ''' has invalid evidence_status ''' || status || '''. Allowed values: [''ambiguous'', ''explicit'', ''inferred'', ''missing''].' FROM nd WHERE label = 'Evidence' AND status = 'guessed'
    UNION ALL SELECT document_id, 'V18', id, 'Evidence node ''' || id || ''' has non-numeric confidence.' FROM nd WHERE label = 'Evidence' AND confidence = '"sure"'
    UNION ALL SELECT document_id, 'V18', id, 'Evidence node ''' || id || ''' has confidence outside [0, 1].' FROM nd WHERE label = 'Evidence' AND confidence = '1.5'
    UNION ALL SELECT document_id, 'V7', document_id, 'At least one node is required.' FROM docs WHERE document_id NOT IN (SELECT document_id FROM nd))"""

REPORT = f"""{VIOLATIONS} SELECT document_id, (SELECT count(*) FROM v WHERE v.document_id = docs.document_id) = 0 AS passed,
    (SELECT count(*) FROM v WHERE v.document_id = docs.document_id) AS error_count, (SELECT count(*) FROM nd WHERE nd.document_id = docs.document_id) AS node_count,
    (SELECT count(*) FROM rl WHERE rl.document_id = docs.document_id) AS relationship_count,
    (SELECT count(*) FROM nd WHERE nd.document_id = docs.document_id AND label = 'TechnicalParameter') AS technical_parameter_count,
    (SELECT count(*) FROM nd WHERE nd.document_id = docs.document_id AND label = 'Evidence') AS evidence_count FROM docs"""
