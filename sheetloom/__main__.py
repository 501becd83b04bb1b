"""Commands over files: `python -m sheetloom COMMAND --help`."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import checks, compare, graph, layout, question_texts, questions, scoring, violations
from .sources import graph_json, pages, sinks, targets


def session() -> SparkSession:
    return SparkSession.builder.appName("sheetloom").getOrCreate()


def put(df: DataFrame, path: str | None) -> None:
    if path:
        sinks.write_json(df, path, "overwrite")
    else:
        df.show(50, truncate=120)


def extract(spark: SparkSession, a) -> None:
    found = pages.read_pdf(spark, a.input)
    put(sinks.page_document(found), a.output)
    pages.extraction_summary(found).show(truncate=False)


def score(spark: SparkSession, a) -> None:
    scores = scoring.score_pages(pages.read_json(spark, a.input, a.lines))
    put(sinks.score_document(scores, "rule_based_v1"), a.output)
    scores.orderBy(F.desc("score"), "page_number").select("source_file", "page_number", "score", "relevance_level").show(20)


def called(name: str):
    """The callable that `module:name` names."""
    module, _, inner = name.partition(":")
    return getattr(importlib.import_module(module), inner)


def score_model(spark: SparkSession, a) -> None:
    """Page scores by a model: a callable named as module:name, from a page's text to a mapping, importable on every executor."""
    scores = scoring.score_with(pages.read_json(spark, a.input, a.lines), called(a.scorer), a.model)
    put(sinks.score_document(scores, "llm_based_v1", a.model), a.output)


def compared(spark: SparkSession, a) -> None:
    rule = pages.read_nested(spark, a.rule, pages.RULE_SCORES, a.lines)
    if not a.llm:  # rule scores alone
        return put(sinks.score_document(rule, "rule_based_v1"), a.output)
    model = compare.paired(rule, pages.read_nested(spark, a.llm, pages.MODEL_SCORES, a.lines))
    found = compare.checked_comparison(rule, model)
    files = model.select("source_file", "llm_source_file").distinct()
    put(sinks.comparison_document(found, compare.comparison_summary(found, files)), a.output)


def select(spark: SparkSession, a) -> None:
    found = compare.select_pages(pages.read_nested(spark, a.input, pages.COMPARISON, a.lines), a.strategy)
    put(sinks.selection_document(found, compare.selection_summary(found)), a.output)


def lay_out(spark: SparkSession, a) -> None:
    if a.backend == "pypdf":
        source = pages.read_json(spark, a.input, a.lines)
    else:
        column = "markdown" if a.backend == "docling" else "payload"
        source = spark.read.text(a.input, wholetext=True).select(F.input_file_name().alias("source_file"), F.col("value").alias(column))
    blocks = layout.analyse(a.backend, source)
    put(sinks.layout_document(blocks, a.backend), a.output)
    layout.block_counts(blocks).show()


def documents(spark: SparkSession, path: str):
    docs = graph_json.read(spark, path)
    good = docs.where("document_id is not null")
    return docs, graph_json.documents(good), graph_json.nodes(good), graph_json.relationships(good)


def validate(spark: SparkSession, a) -> None:
    docs, *parts = documents(spark, a.input)
    put(violations.report(*parts), a.output)
    violations.violations(*parts).show(50, truncate=120)
    graph_json.unreadable(docs).show(truncate=120)


def loaded(spark: SparkSession, path: str, standing: str | None = None, clear: bool = False) -> tuple[graph.Views, DataFrame, DataFrame]:
    """The graph under `standing`, or the control graph, with the documents under `path` merged in; with `clear`, extracted
    nodes and their edges go first. Any violation, unsafe name, failed reference or broken constraint raises."""
    _, *parts = documents(spark, path)
    if bad := violations.violations(*parts).first():
        raise ValueError(f"{bad.document_id}: {bad.rule_id} {bad.message}")
    graph.checked_identifiers(parts[2], parts[1])
    nodes, rels = parts[1].withColumn("turn", F.col("node_ord").cast("long")), parts[2].withColumn("turn", F.col("rel_ord").cast("long"))
    start, links = (spark.read.parquet(f"{standing}/nodes"), spark.read.parquet(f"{standing}/edges")) if standing else graph.control(spark)
    if clear:
        start, links = graph.clear_instances(start, links)
    all_nodes = graph.upsert_nodes(start, nodes.select("labels", "id", "properties", "turn"))
    graph.checked_constraints(all_nodes)
    edges, errors = graph.upsert_edges(all_nodes, links, rels.select("source", "type", "target", "target_ref", "properties", "turn"))
    if lost := errors.first():
        raise ValueError(lost.message)
    return graph.Views.of(all_nodes, edges), all_nodes, edges


def load(spark: SparkSession, a) -> None:
    """Merge documents into a graph; the result is written to a folder of its own, the standing graph stays as it is."""
    if a.standing and a.output and a.standing.rstrip("/") == a.output.rstrip("/"):
        raise ValueError("the output folder must not be the standing graph's")
    _, nodes, edges = loaded(spark, a.input, a.standing, a.clear)
    if a.output:
        sinks.write_parquet(nodes, f"{a.output}/nodes", "overwrite")
        sinks.write_parquet(edges, f"{a.output}/edges", "overwrite")
    graph.label_counts(nodes).show()
    graph.edge_counts(edges).show()


def goals_of(spark: SparkSession, a):
    """The targets, their expected rows, and what brings an answer into the form of those; the views are registered."""
    wanted, goals = targets.load_expected(a.expected), targets.load_targets(a.targets)
    goals = goals[:1] if a.first else goals
    if a.kind == "schema":
        g = graph.Views.of(*graph.control(spark))
        of = lambda t, rows: checks.expected_rows(spark, t["check_id"], rows)
        shape = lambda t, rows: checks.normalised(t["check_id"], rows)
    else:
        g = loaded(spark, a.input)[0]
        of = lambda t, rows: expected_answers(spark, t["check_id"], g, rows)
        shape = lambda t, rows: rows
    question_texts.register(g)
    return goals, {t["expected_result_key"]: of(t, wanted[t["expected_result_key"]]) for t in goals}, shape


def check(spark: SparkSession, a) -> None:
    """Targets against expected results, by the registered SQL texts."""
    goals, expected, shape = goals_of(spark, a)
    found = checks.run_checks(spark, goals, expected, lambda t: shape(t, checks.run_read_only(spark, question_texts.TEXTS[t["check_id"]])))
    put(sinks.check_report(found, checks.rolled_up(found), f"{a.kind}_validation"), a.output)


def propose(spark: SparkSession, a) -> None:
    """Queries that a generator, a callable named as module:name, proposes for the targets."""
    generate, goals = called(a.generator), targets.load_targets(a.targets)
    found = [generate(t) for t in (goals[:1] if a.first else goals)]
    put(spark.createDataFrame([(c.check_id, c.query, c.explanation) for c in found], "check_id string, query string, explanation string"), a.output)


def replay(spark: SparkSession, a) -> None:
    """Proposed queries against expected results; a target without a proposal fails."""
    goals, expected, shape = goals_of(spark, a)
    proposed = spark.read.json(a.candidates, schema="check_id string, query string, explanation string").collect()  # one for each target
    by_check = {r.check_id: checks.Candidate(*r) for r in proposed}
    found = checks.replay(spark, goals, expected, lambda t: by_check[t["check_id"]], shape)
    put(sinks.check_report(found, checks.rolled_up(found), f"{a.kind}_candidate_validation"), a.output)


def expected_answers(spark: SparkSession, check_id: str, g: graph.Views, rows: list[dict]) -> DataFrame:
    """Expected rows in the columns and types of the question; values are canonical text."""
    schema = questions.CQS[check_id](g).schema
    text = lambda v: v if v is None or isinstance(v, str) else graph.canonical(v)
    kept = [tuple(text(r.get(f.name)) if f.dataType.simpleString() == "string" else r.get(f.name) for f in schema) for r in rows]
    return spark.createDataFrame(kept, schema)


def main(arguments: list[str]) -> None:
    top = argparse.ArgumentParser(prog="sheetloom", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(name: str, run, *options: str):
        one = commands.add_parser(name, help=run.__doc__)
        for o in options:
            one.add_argument(f"--{o}", required=o in ("rule", "expected", "targets", "scorer", "generator", "candidates"))
        if "input" in options or "rule" in options:
            one.add_argument("--lines", action="store_true", help="one JSON document per line")
        one.add_argument("--output", help="folder for JSON or parquet; shown if left out")
        one.set_defaults(run=run)
        return one

    command("extract", extract, "input")
    command("score", score, "input")
    command("score-model", score_model, "input", "scorer").add_argument("--model", default="recorded", help="name that the scores carry")
    command("compare", compared, "rule", "llm")
    command("select", select, "input").add_argument("--strategy", default="hybrid")
    command("layout", lay_out, "input").add_argument("--backend", choices=list(layout.BACKENDS), default="pypdf")
    command("validate", validate, "input")
    command("load", load, "input", "standing").add_argument("--clear", action="store_true", help="extracted nodes and edges of the standing graph go first")
    for one in (command("check", check, "input", "targets", "expected"), command("replay", replay, "input", "targets", "expected", "candidates")):
        one.add_argument("--kind", choices=["schema", "cq"], default="cq")
        one.add_argument("--first", action="store_true", help="only the first target")
    command("propose", propose, "targets", "generator").add_argument("--first", action="store_true", help="only the first target")
    args = top.parse_args(arguments)
    args.run(session(), args)


if __name__ == "__main__":
    main(sys.argv[1:])
