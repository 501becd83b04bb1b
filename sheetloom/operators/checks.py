"""Comparison of results with expectations, the read-only guard, and runners over registered or recorded queries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that no read-only query holds, and how one begins.
FORBIDDEN = ["INSERT", "UPDATE", "DELETE", "MERGE", "CREATE", "DROP", "ALTER", "TRUNCATE", "REPLACE", "LOAD", "CALL", "SET", "REFRESH", "CACHE", "UNCACHE", "GRANT", "REVOKE", "EXECUTE"]
ALLOWED_STARTS = ["SELECT", "WITH"]


#: What a proposed query may call. Functions that reach Java classes, files or the session are not among them.
FUNCTIONS = """abs any_value approx_count_distinct array array_agg array_contains array_distinct array_join array_max array_min
array_size array_sort arrays_overlap avg bool_and bool_or cast ceil coalesce collect_list collect_set concat concat_ws contains
count count_if date_format dense_rank element_at endswith every exists explode filter first first_value flatten floor format_number
get_json_object greatest if ifnull initcap instr isnotnull isnull lag last last_value lead least left length like lower lpad ltrim
map_keys map_values max max_by min min_by named_struct nullif nvl percentile rank regexp_extract regexp_like regexp_replace replace
reverse right round row_number rpad rtrim size some sort_array split startswith string_agg struct substr substring sum transform
translate trim try_cast upper listagg""".split()
#: Words of the language that a parenthesis may follow.
WORDS = "all and any as between by case distinct else except exists filter from having in intersect is join lateral like not on or order over partition rlike select then union using values when where with".split()


def plain_text(query: str) -> tuple[str, str]:
    """A query in upper case without comments, with its literals and with each literal as one quoted x."""
    kept, bare, at = [], [], 0
    for m in re.finditer(r"""'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/""", query, re.DOTALL):
        between, token = query[at : m.start()], m[0]
        comment = token.startswith(("--", "/*"))
        kept += [between, " " if comment else token]
        bare += [between, " " if comment else token if token[0] == "`" else "'x'"]
        at = m.end()
    return tuple(re.sub(r"\s+", " ", "".join([*x, query[at:]])).strip().upper() for x in (kept, bare))


def read_only_problem(query: str) -> str | None:
    """Why a SQL text is no single read-only query; None if it is one. Writing words count within literals too, comments do
    not. Only known functions may be called and only plain names be read: neither files nor tables of other catalogs."""
    body, bare = (x.removesuffix(";").strip() for x in plain_text(query))
    if not body:
        return "the query is empty"
    if not re.match(rf"(?:{'|'.join(ALLOWED_STARTS)})\b", body):
        return f"only queries that start with {' or '.join(ALLOWED_STARTS)} are allowed"
    if found := re.search(rf"\b(?:{'|'.join(FORBIDDEN)})\b", re.sub(r"\bREPLACE ?\(", "", body)):
        return f"forbidden word: {found[0]}"
    if ";" in bare:
        return "more than one statement"
    if "/*" in bare or "*/" in bare:
        return "an open comment"
    if found := re.search(r"(?:\b(?:FROM|JOIN)|,) ?(?:`[^`]*`|\w+) ?\. ?`", bare) or re.search(r"\b(?:FROM|JOIN) \(*(?:`[^`]*`|\w+) ?\. ?\w", bare) or re.search(r"`[^`]*[/:][^`]*`", bare) or re.search(r"\bFROM (?:(?!\b(?:WHERE|GROUP|ORDER|HAVING|LIMIT|UNION|ON|SELECT)\b)[^()])*, ?\w+ ?\. ?\w", bare):
        return f"only plain names may be read: {found[0]}"
    names = {n.lower() for n in re.findall(r"(`[^`]*`|\b\w+) ?\(", bare)}
    # a name before a parenthesis may also be a common table expression with its columns
    defined = {n.lower() for n in re.findall(r"(?:\bWITH|,) (\w+) ?\([\w ,]*\) AS ?\(", bare)}
    if unknown := sorted(names - set(FUNCTIONS) - set(WORDS) - defined):
        return f"unknown function: {unknown[0]}"
    return None


def run_read_only(spark: SparkSession, query: str) -> DataFrame:
    if problem := read_only_problem(query):
        raise ValueError(problem)
    return spark.sql(query.strip().removesuffix(";"))


def same_rows(actual: DataFrame, expected: DataFrame) -> bool:
    """Equal columns by name and equal rows as multisets, in any order."""
    if sorted(actual.columns) != sorted(expected.columns):
        return False
    a = actual.select(*expected.columns)
    return a.exceptAll(expected).isEmpty() and expected.exceptAll(a).isEmpty()


def differences(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows that one side has more often, with `side`."""
    a = actual.select(*expected.columns)
    return a.exceptAll(expected).withColumn("side", F.lit("actual")).unionByName(expected.exceptAll(a).withColumn("side", F.lit("expected")))


def normalised(check_id: str, rows: DataFrame) -> DataFrame:
    """A schema check's rows as (key, value): nulls dropped; of repeated keys the last one by value wins; lists sorted."""
    shapes = {
        "parameter_type_vocabulary": ("parameter_type", None),
        "unit_vocabulary": ("unit", None),
        "equipment_type_vocabulary": ("equipment_type", None),
        "allowed_units": ("parameter_type", F.array_join(F.sort_array(F.coalesce("allowed_units", F.array().cast("array<string>"))), ",")),
        "required_parameters": ("required_parameter", F.col("parameter_type")),
        "relationship_definitions": ("relationship", F.concat_ws("->", "from_concept", "to_concept")),
    }
    if check_id not in shapes:
        raise ValueError(f"unsupported check {check_id!r}")
    key, value = shapes[check_id]
    if value is None:
        return rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.lit(None).cast("string").alias("value"))
    out = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), value.alias("value")).where("value is not null")
    return out.groupBy("key").agg(F.max("value").alias("value"))


def expected_rows(spark: SparkSession, check_id: str, value) -> DataFrame:
    """An expected list, mapping to lists, mapping, or mapping to from/to pairs as (key, value) rows."""
    if isinstance(value, list):
        rows = [(x, None) for x in value]
    elif check_id == "allowed_units":
        rows = [(k, ",".join(sorted(v))) for k, v in value.items()]
    elif check_id == "relationship_definitions":
        rows = [(k, f"{v['from']}->{v['to']}") for k, v in value.items()]
    else:
        rows = list(value.items())
    return spark.createDataFrame(rows, "key string, value string")


@dataclass(frozen=True)
class Candidate:
    """A query proposed for a check, by whatever generator."""

    check_id: str
    query: str
    explanation: str = ""


CHECK = "check_id string, passed boolean, problem string"


def run_checks(spark: SparkSession, targets: Iterable[dict], expected: dict[str, DataFrame], answer: Callable[[dict], DataFrame]) -> DataFrame:
    """One row per target. A target without an expectation raises; `answer` gives a target's rows."""
    rows = []
    for t in targets:
        key = t["expected_result_key"]
        if key not in expected:
            raise ValueError(f"no expected result {key!r} for check {t['check_id']!r}")
        ok = same_rows(answer(t), expected[key])
        rows.append((t["check_id"], ok, None if ok else "rows differ"))
    return spark.createDataFrame(rows, CHECK)


def replay(spark: SparkSession, targets: Iterable[dict], expected: dict[str, DataFrame], generate: Callable[[dict], Candidate], shape: Callable[[dict, DataFrame], DataFrame] = lambda t, rows: rows) -> DataFrame:
    """As `run_checks`, with queries from a generator: the id must match, the guard must pass, the rows must be equal; any
    exception fails the check and the next one goes on. `shape` brings a target's rows into the form of the expected ones."""
    rows = []
    for t in targets:
        try:
            c = generate(t)
            if c.check_id != t["check_id"]:
                raise ValueError(f"the candidate is for check {c.check_id!r}")
            ok = same_rows(shape(t, run_read_only(spark, c.query)), expected[t["expected_result_key"]])
            rows.append((t["check_id"], ok, None if ok else "rows differ"))
        except Exception as e:  # whatever a proposed query does is its failure
            rows.append((t["check_id"], False, f"{type(e).__name__}: {str(e)[:200]}"))
    return spark.createDataFrame(rows, CHECK)


def rolled_up(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count("*").alias("total_checks"), F.count_if("passed").alias("passed_checks"), F.count_if(~F.col("passed")).alias("failed_checks"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"))
