"""Graph documents, upsert, constraints, questions, comparators and the guard, on a small hand-made sensor document."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from sheetloom.operators import checks, graph, questions, violations
from sheetloom.plans import registry
from sheetloom.sources import graph_json, targets


def sensor():
    """One sheet, one sensor, two parameters with evidence."""
    node = lambda i, label, **p: {"id": i, "labels": [label], "properties": p}
    rel = lambda s, t, d: {"source": s, "type": t, "target": d, "properties": {}}
    ref = lambda s, t, label, key, v: {"source": s, "type": t, "target_ref": {"label": label, "key": key, "value": v}, "properties": {}}
    proof = {"source_document_id": "sheet", "page_number": 1, "source_text": "t", "evidence_status": "explicit", "confidence": 0.9}
    return {
        "schema_version": "1", "document_id": "sheet", "extraction_scope": "human_reviewed",
        "nodes": [
            node("sheet", "Datasheet", file_name="s.pdf", document_type="Sheet"), node("dev", "Equipment", product_model="S1", manufacturer="M", raw_equipment_type="Sensor"),
            node("run", "ExtractionRun"), node("p1", "TechnicalParameter", raw_label="Peak", value=570, value_type="number"), node("p2", "TechnicalParameter", raw_label="Model", value="S1", value_type="string"),
            node("e1", "Evidence", **proof), node("e2", "Evidence", **proof),
        ],
        "relationships": [
            rel("sheet", "DESCRIBES", "dev"), ref("dev", "HAS_EQUIPMENT_TYPE", "EquipmentType", "name", "AmbientLightSensor"), rel("dev", "HAS_PARAMETER", "p1"), rel("dev", "HAS_PARAMETER", "p2"),
            ref("p1", "HAS_PARAMETER_TYPE", "ParameterType", "name", "PeakSensitivityWavelength"), ref("p2", "HAS_PARAMETER_TYPE", "ParameterType", "name", "ProductModel"), ref("p1", "HAS_UNIT", "Unit", "symbol", "nm"),
            rel("p1", "EVIDENCED_BY", "e1"), rel("p2", "EVIDENCED_BY", "e2"), rel("p1", "GENERATED_BY", "run"), rel("p2", "GENERATED_BY", "run"),
        ],
    }


def parts(spark, tmp_path, doc, name="d"):
    path = tmp_path / f"{name}.json"
    path.write_text(json.dumps(doc))
    docs = graph_json.read(spark, str(path))
    return graph_json.documents(docs), graph_json.nodes(docs), graph_json.relationships(docs)


def rules(spark, tmp_path, change):
    doc = copy.deepcopy(sensor())
    change(doc)
    return sorted({r.rule_id for r in violations.violations(*parts(spark, tmp_path, doc)).collect()})


def test_clean_document(spark, tmp_path):
    assert rules(spark, tmp_path, lambda d: None) == []
    row = violations.report(*parts(spark, tmp_path, sensor())).first()
    assert tuple(row) == ("sheet", True, 0, 7, 11, 2, 2)


def drop(kind):
    return lambda d: d["relationships"].remove(next(r for r in d["relationships"] if r["type"] == kind))


MUTATIONS = {
    "V1": lambda d: d["nodes"][2].update(labels=[" "]),
    "V2": lambda d: d["relationships"][0].pop("target"),
    "V3": lambda d: d["nodes"].append(d["nodes"][2]),
    "V4": lambda d: d["relationships"][7].update(target="lost"),
    "V5": lambda d: d["nodes"][0].update(labels=["Datasheet2"]),
    "V6": lambda d: d.update(extraction_scope="guessed"),
    "V8": lambda d: d["relationships"].append(d["relationships"][0]),
    "V9": lambda d: d["nodes"][2].update(labels=["Other"]),
    "V10": drop("DESCRIBES"),
    "V11": lambda d: d.update(relationships=[r for r in d["relationships"] if r["type"] != "HAS_PARAMETER"]),
    "V12": drop("HAS_PARAMETER_TYPE"),
    "V13": drop("EVIDENCED_BY"),
    "V14": drop("GENERATED_BY"),
    "V15": lambda d: d["relationships"][6]["target_ref"].update(key="name"),
    "V16": lambda d: d["nodes"][5]["properties"].pop("page_number"),
    "V17": lambda d: d["nodes"][5]["properties"].update(evidence_status="odd"),
    "V18": lambda d: d["nodes"][5]["properties"].update(confidence=1.5),
    "V19": lambda d: d["nodes"][3]["properties"].pop("value_type"),
}


@pytest.mark.parametrize("rule", MUTATIONS)
def test_one_broken_rule_is_named(spark, tmp_path, rule):
    found = rules(spark, tmp_path, MUTATIONS[rule])
    extra = {"V1": {"V9"}, "V5": {"V9"}}.get(rule, set())  # a lost label is also a missing one
    assert rule in found and set(found) <= {rule} | extra


def test_null_properties_and_booleans_pass(spark, tmp_path):
    def change(d):
        d["nodes"][5]["properties"].update(evidence_status=None, confidence=True, page_number=None)

    assert rules(spark, tmp_path, change) == []


def test_unreadable_file_is_a_report(spark, tmp_path):
    (tmp_path / "x.json").write_text("{nope")
    row = graph_json.unreadable(graph_json.read(spark, str(tmp_path / "x.json"))).first()
    assert row.passed is False and "nope" in row.error


def loaded(spark, tmp_path, doc=None):
    _, nodes, rels = parts(spark, tmp_path, doc or sensor())
    return registry.merged_tables(spark, nodes, rels)


def test_questions_on_the_loaded_document(spark, tmp_path):
    nodes, edges, errors = loaded(spark, tmp_path)
    assert errors.isEmpty() and graph.broken_constraints(nodes).isEmpty()
    g = graph.Views.of(nodes, edges)
    assert tuple(questions.extracted_equipment(g).first()) == ("sheet", "s.pdf", "Sheet", "dev", "S1", "M", "Sensor", "AmbientLightSensor", "Ambient light sensor")
    rows = questions.technical_parameters(g).collect()
    assert [(r.parameter_id, r.value, r.unit, r.unit_name) for r in rows] == [("p1", "570", "nm", "nanometre"), ("p2", "S1", None, None)]
    assert [(r.evidence_id, r.page_number, r.confidence) for r in questions.parameter_evidence(g).collect()] == [("e1", 1, 0.9), ("e2", 1, 0.9)]
    assert {r.unit_grounding_status for r in questions.vocabulary_grounding(g).collect()} == {"grounded", "not_required"}
    assert sorted(r.parameter_type for r in questions.required_parameter_status(g).collect()) == ["DeviceType", "Dimensions", "PackageForm"]
    assert {r.labels: r.n for r in graph.label_counts(nodes).collect()} == {"Datasheet": 1, "Equipment": 1, "ExtractionRun": 1, "TechnicalParameter": 2, "Evidence": 2}
    assert sum(r.n for r in graph.edge_counts(edges).collect()) == 11


def test_loading_twice_changes_nothing_and_clearing_leaves_the_vocabulary(spark, tmp_path):
    nodes, edges, _ = loaded(spark, tmp_path)
    _, n, r = parts(spark, tmp_path, sensor())
    again = graph.upsert_nodes(nodes, n.select("labels", "id", "properties", F.lit(1).cast("long").alias("turn")))
    assert again.count() == nodes.count() == 39 + 7
    left, links = graph.clear_instances(nodes, edges)
    assert (left.count(), links.count(), edges.count()) == (39, 42, 53)


def test_upsert_merges_properties(spark, tmp_path):
    nodes, _, _ = loaded(spark, tmp_path)
    new = spark.createDataFrame([(["Equipment"], "dev", {"manufacturer": "null", "extra": "1"}, 5), (["Equipment", "Other"], "dev", {"a": "2"}, 5)], "labels array<string>, id string, properties map<string,string>, turn long")
    out = {r.key: r.properties for r in graph.upsert_nodes(nodes, new).where("id = 'dev'").collect()}
    assert out["Equipment|dev"] == {"id": '"dev"', "product_model": '"S1"', "raw_equipment_type": '"Sensor"', "extra": "1"}
    assert out["Equipment:Other|dev"] == {"id": '"dev"', "a": "2"}


def test_lost_ends(spark, tmp_path):
    doc = sensor()
    doc["relationships"][6]["target_ref"]["value"] = "furlong"  # an error
    doc["relationships"][7]["target"] = "lost"  # left out without a word
    _, edges, errors = loaded(spark, tmp_path, doc)
    assert edges.count() == 51
    assert [r.message for r in errors.collect()] == ['target_ref did not match an existing node: label=Unit, key=symbol, value="furlong"']


def test_dangling_optional_edge_gives_one_null_row(spark, tmp_path):
    nodes, edges, _ = loaded(spark, tmp_path)
    broken = nodes.where("key <> 'Unit|nm'")
    rows = questions.technical_parameters(graph.Views.of(broken, edges)).collect()
    assert [r.unit for r in rows] == [None, None]


def test_identifiers(spark, tmp_path):
    doc = sensor()
    doc["nodes"][2]["labels"] = ["Extraction Run"]
    doc["relationships"][0]["type"] = "describes"
    _, nodes, rels = parts(spark, tmp_path, doc)
    assert sorted((r.kind, r.name) for r in graph.bad_identifiers(rels, nodes).collect()) == [("label", "Extraction Run"), ("relationship", "describes")]


@pytest.mark.parametrize("query,ok", [("SELECT 1", True), ("-- note\nwith a as (select 1) select * from a;", True), ("-- only", False), ("SELECT 'drop'", False), ("SELECT 1; SELECT 2", False), ("UPDATE t SET a = 1", False), ("EXPLAIN SELECT 1", False), ("SELECTED", False), ("/* a; */ SELECT replace(a, 'x', 'y') FROM t", True), ("SELECT reflect('java.lang.System', 'exit')", False), ("SELECT * FROM parquet.`/any`", False), ("SELECT * FROM t JOIN csv.`/any` u ON true", False), ("SELECT * FROM a.t", False), ("SELECT * FROM t, a.u", False), ("WITH a (x) AS (SELECT 1) SELECT count(x) FROM a WHERE x IN (1, 2)", True), ("SELECT t.a, u.b FROM t JOIN u ON t.a = u.b", True)])
def test_guard(query, ok):
    assert (checks.read_only_problem(query) is None) == ok


def test_row_comparison_is_a_multiset(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "i int, s string")
    assert checks.same_rows(a, a.select("s", "i")) and not checks.same_rows(a, a.distinct()) and not checks.same_rows(a, a.withColumnRenamed("s", "t"))
    assert checks.differences(a, a.distinct()).count() == 1


def test_replay_and_roll_up(spark):
    expected = {"one": spark.range(1).selectExpr("1 AS a")}
    made = {"good": "SELECT 1 AS a", "wrong": "SELECT 2 AS a", "alias": "SELECT 1 AS b", "write": "DROP TABLE t", "broken": "SELECT nope FROM nowhere"}
    goals = [{"check_id": k, "expected_result_key": "one"} for k in [*made, "other"]]
    out = checks.replay(spark, goals, expected, lambda t: checks.Candidate("x" if t["check_id"] == "other" else t["check_id"], made.get(t["check_id"], "SELECT 1 AS a")))
    assert {r.check_id for r in out.where("passed").collect()} == {"good"}
    assert tuple(checks.rolled_up(out).first()) == (6, 1, 5, False)
    with pytest.raises(ValueError, match="no expected result"):
        checks.run_checks(spark, [{"check_id": "a", "expected_result_key": "none"}], expected, lambda t: None)


def test_schema_checks_against_expectations(spark):
    g = registry.D.control_views(spark)
    wanted = {"allowed_units": {"AngleOfHalfSensitivity": ["degree"], "Dimensions": ["mm"], "PeakSensitivityWavelength": ["nm"]}, "equipment_type_vocabulary": ["AmbientLightSensor", "DigitalAccelerometer"]}
    for name, value in wanted.items():
        assert checks.same_rows(checks.normalised(name, questions.SCHEMA_CHECKS[name](g)), checks.expected_rows(spark, name, value))
    with pytest.raises(ValueError, match="unsupported check"):
        checks.normalised("nothing", spark.range(1))


def test_target_files(tmp_path):
    good = tmp_path / "t.json"
    good.write_text(json.dumps({"checks": [{"check_id": "a", "expected_result_key": "b"}]}))
    assert targets.load_targets(str(good))[0]["check_id"] == "a"
    for bad in ([], {"checks": {}}, {"checks": [{"check_id": "a"}]}):
        good.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            targets.load_targets(str(good))
    good.write_text("[]")
    with pytest.raises(ValueError):
        targets.load_expected(str(good))


def test_sql_texts_equal_the_plans(spark, tmp_path):
    from sheetloom.operators import question_texts

    doc = sensor()
    doc["relationships"] = [r for r in doc["relationships"] if r["type"] != "HAS_UNIT"]
    nodes, edges, _ = loaded(spark, tmp_path, doc)
    g = graph.Views.of(nodes, edges)
    question_texts.register(g)
    assert set(question_texts.TEXTS) == set(questions.CQS) | set(questions.SCHEMA_CHECKS)
    for name, text in question_texts.TEXTS.items():
        plan = (questions.CQS | questions.SCHEMA_CHECKS)[name](g)
        assert checks.same_rows(checks.run_read_only(spark, text), plan), name


def test_commands(spark, tmp_path, capsys):
    from sheetloom import __main__ as cli
    from sheetloom.sources import pages

    (tmp_path / "d.json").write_text(json.dumps(sensor()))
    pages_doc = {"source_file": "f", "page_count": 1, "extraction_method": "pypdf", "pages": [{"page_number": 1, "text": "FEATURES\nof it", "char_count": 14}]}
    (tmp_path / "p.json").write_text(json.dumps(pages_doc))
    rows = {"cq2": [{"equipment_id": "dev", "product_model": "S1", "raw_equipment_type": "Sensor", "parameter_id": p, "raw_label": l, "value": v, "value_type": k, "normalized_parameter_type": t, "parameter_display_name": d, "parameter_category": c, "unit": u, "unit_name": n} for p, l, v, k, t, d, c, u, n in [("p1", "Peak", 570, "number", "PeakSensitivityWavelength", "Peak sensitivity wavelength", "optical", "nm", "nanometre"), ("p2", "Model", "S1", "string", "ProductModel", "Product model", "identification", None, None)]]}
    (tmp_path / "e.json").write_text(json.dumps(rows))
    (tmp_path / "t.json").write_text(json.dumps({"checks": [{"check_id": "cq2_technical_parameters", "expected_result_key": "cq2"}]}))
    t = str(tmp_path)
    cli.main(["check", "--input", f"{t}/d.json", "--targets", f"{t}/t.json", "--expected", f"{t}/e.json", "--output", f"{t}/report"])
    assert spark.read.json(f"{t}/report").first().passed is True
    cli.main(["load", "--input", f"{t}/d.json", "--output", f"{t}/graph"])
    assert spark.read.parquet(f"{t}/graph/nodes").count() == 46
    cli.main(["validate", "--input", f"{t}/d.json"])
    cli.main(["score", "--input", f"{t}/p.json", "--output", f"{t}/rule"])
    cli.main(["layout", "--input", f"{t}/p.json", "--output", f"{t}/blocks"])
    assert spark.read.json(f"{t}/blocks").first().page_count == 1
    model = pages.read_nested(spark, f"{t}/rule", pages.RULE_SCORES, lines=True).withColumn("useful_for_extraction", F.lit(True))
    from sheetloom.sources import sinks

    sinks.write_json(sinks.score_document(model, "model", "m"), f"{t}/model")
    cli.main(["compare", "--rule", f"{t}/rule", "--llm", f"{t}/model", "--lines", "--output", f"{t}/compared"])
    cli.main(["select", "--input", f"{t}/compared", "--lines", "--strategy", "union", "--output", f"{t}/selected"])
    assert spark.read.json(f"{t}/selected").first().summary.page_count == 1


def propose(target):
    """Stands for a query generator: the registered text of one check, a writing statement for any other."""
    from sheetloom.operators import checks, question_texts

    good = target["check_id"] == "unit_vocabulary"
    return checks.Candidate(target["check_id"], question_texts.TEXTS[target["check_id"]] if good else "DROP TABLE unit")


def test_commands_with_injected_callables(spark, tmp_path):
    from sheetloom import __main__ as cli
    from sheetloom.plans.registry import EXPECTED_STATE

    t = str(tmp_path)
    made = {"source_file": "f", "page_count": 1, "pages": [{"page_number": 1, "text": "FEATURES\nof it", "char_count": 14}]}
    (tmp_path / "p.json").write_text(json.dumps(made))
    (tmp_path / "q.json").write_text(json.dumps(made | {"source_file": "other"}))
    cli.main(["score", "--input", f"{t}/p.json", "--output", f"{t}/rule"])
    cli.main(["score-model", "--input", f"{t}/q.json", "--scorer", "sheetloom.plans.registry:scorer", "--model", "length", "--output", f"{t}/model"])
    assert (found := spark.read.json(f"{t}/model").first()).llm_model == "length" and found.pages[0].score == 14
    cli.main(["compare", "--rule", f"{t}/rule", "--llm", f"{t}/model", "--lines", "--output", f"{t}/compared"])
    one = spark.read.json(f"{t}/compared").first().summary
    assert (one.page_count, one.rule_based_source_file, one.llm_based_source_file, one.same_source_file) == (1, "f", "other", False)

    (tmp_path / "e.json").write_text(json.dumps(EXPECTED_STATE))
    goals = [{"check_id": c, "expected_result_key": k} for c, k in (("unit_vocabulary", "units"), ("equipment_type_vocabulary", "equipment_types"), ("allowed_units", "allowed_units"))]
    (tmp_path / "t.json").write_text(json.dumps({"checks": goals[:2]}))
    (tmp_path / "all.json").write_text(json.dumps({"checks": goals}))
    cli.main(["propose", "--targets", f"{t}/t.json", "--generator", f"{__name__}:propose", "--output", f"{t}/candidates"])
    cli.main(["replay", "--kind", "schema", "--targets", f"{t}/all.json", "--expected", f"{t}/e.json", "--candidates", f"{t}/candidates", "--output", f"{t}/report"])
    report = spark.read.json(f"{t}/report").first()
    assert not report.passed and {c.check_id: c.passed for c in report.checks} == {"unit_vocabulary": True, "equipment_type_vocabulary": False, "allowed_units": False}
    cli.main(["replay", "--kind", "schema", "--first", "--targets", f"{t}/all.json", "--expected", f"{t}/e.json", "--candidates", f"{t}/candidates", "--output", f"{t}/first"])
    assert spark.read.json(f"{t}/first").first().passed
    cli.main(["check", "--kind", "schema", "--targets", f"{t}/all.json", "--expected", f"{t}/e.json", "--output", f"{t}/checked"])
    assert spark.read.json(f"{t}/checked").first().passed


def test_lookups_and_settings(spark, tmp_path, monkeypatch):
    from sheetloom.sources.settings import resolve

    _, nodes, rels = parts(spark, tmp_path, sensor())
    assert graph.node_by_id(nodes, "p1").count() == 1 and graph.nodes_by_label(nodes, "Evidence").count() == 2 and graph.relationships_by_type(rels, "HAS_UNIT").count() == 1
    assert tuple(graph.loading_summary(nodes, rels).first()) == ("sheet", 7, 7, 4)
    monkeypatch.setenv("SHEETLOOM_MODEL", " m ")
    assert (resolve("given", "model", "d"), resolve(None, "model", "d"), resolve("", "other", "d")) == ("given", "m", "d")


def strangers(spark, tmp_path):
    """Two documents: the second one speaks of a parameter of the first one, of one that is nowhere and of a lost unit."""
    second = {"schema_version": "1", "document_id": "more", "extraction_scope": "human_reviewed", "nodes": [{"id": "more", "labels": ["Manual"], "properties": {}}, {"id": "q", "labels": ["Note"], "properties": {}}], "relationships": [
        {"source": s, "type": "HAS_UNIT", "target_ref": {"label": "Unit", "key": "symbol", "value": v}, "properties": {}} for s, v in (("p1", "nm"), ("nowhere", "nm"), ("q", "furlong"), ("q", "mm"))
    ] + [{"source": "more", "type": "ABOUT", "target": t, "properties": {}} for t in ("q", "p1", "nowhere")]}
    one, two = parts(spark, tmp_path, sensor()), parts(spark, tmp_path, second, "e")
    return tuple(a.unionByName(b) for a, b in zip(one[1:], two[1:], strict=True))


def test_reference_errors_alone_are_those_of_the_upsert(spark, tmp_path):
    nodes, rels = strangers(spark, tmp_path)
    alone = graph.reference_errors(graph.control(spark)[0], nodes.withColumn("turn", F.lit(0).cast("long")), rels)
    assert sorted((r.source, r.message.split("value=")[1]) for r in alone.collect()) == [("nowhere", '"nm"'), ("q", '"furlong"')]
    assert checks.same_rows(alone, registry.merged_tables(spark, nodes, rels)[2])


def test_clearing_before_the_merge_leaves_what_clearing_after_it_does(spark, tmp_path):
    nodes, rels = strangers(spark, tmp_path)
    kept, edges = graph.upsert_cleared(*graph.control(spark), registry.new_nodes(nodes), registry.new_edges(rels))
    after = graph.clear_instances(*registry.merged_tables(spark, nodes, rels)[:2])
    assert (kept.count(), edges.count()) == (39 + 2, 42 + 2)
    assert sorted(r.key for r in kept.collect()) == sorted(r.key for r in after[0].collect())
    assert sorted((r.src, r.type, r.dst) for r in edges.collect()) == sorted((r.src, r.type, r.dst) for r in after[1].collect())
