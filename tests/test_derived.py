"""The inputs of the registered queries hold every row of the driver's tables."""

import duckdb
import pytest

from sheetloom.plans import derived as D
from sheetloom.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines():
    return duckdb.sql(f"SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, concat(l_returnflag, l_linestatus, l_linenumber) AS label FROM '{FOLDER}/lineitem.parquet'").fetchall()


def test_every_line_item_is_a_parameter(spark, lines):
    ids = {"_".join(map(str, ("param", *r[:4]))) for r in lines}
    tables = D.graph(spark, FOLDER)
    assert {r.id for r in tables.edges("EVIDENCED_BY").select("src").withColumnRenamed("src", "id").collect()} == ids
    assert {r.parameter_id for r in registry.queries()["cq4_vocabulary_grounding"](spark, FOLDER).select("parameter_id").collect()} == ids
    _, nodes, _ = D.extraction_documents(spark, FOLDER)
    assert {r.id for r in nodes.where("labels[0] = 'TechnicalParameter'").collect()} == ids
    assert {r.id for r in nodes.where("labels[0] = 'Evidence'").collect()} == {i.replace("param", "evidence") for i in ids}


def test_vocabulary_covers_every_label_and_orders_are_evidence(spark, lines):
    assert {r[-1] for r in lines} <= {r.name for r in D.sql(spark, FOLDER, D.TYPES).collect()} & {r.name for r in D.sql(spark, FOLDER, D.ALLOWED).collect()}
    orders = {f"evidence_{r[0]}" for r in duckdb.sql(f"SELECT o_orderkey FROM '{FOLDER}/orders.parquet'").fetchall()}
    assert {r.id for r in D.sql(spark, FOLDER, D.EVIDENCE).collect()} == orders
    rows = registry.queries()["cq3_parameter_evidence"](spark, FOLDER).select("evidence_id").collect()
    assert {r.evidence_id is None for r in rows} == {True, False}  # planted references still dangle


def shuffles(df):
    """What the plan deals rows by, without the dealing of lines and documents themselves."""
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    return {re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\((.*?), \d+\), ENSURE", plan)} - {"document_id, l_suppkey, l_partkey, l_orderkey, l_linenumber, l_returnflag"}


def test_violations_shuffle_lines_and_no_nodes_or_relationships(spark):
    assert shuffles(registry.queries()["graph_violations"](spark, FOLDER)) == set()
