"""Page normalisation, scoring, comparison and selection on hand-made rows."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from sheetloom.functions import text as X
from sheetloom.operators import compare, scoring
from sheetloom.sources import pages, sinks


def scored(spark, texts, **terms):
    df = spark.createDataFrame([("f", i, t, None) for i, t in enumerate(texts, 1)], "source_file string, page_number int, text string, char_count int")
    return {r.page_number: r for r in scoring.score_pages(df, **terms).collect()}


def test_strip_only_searches_the_ends(spark):
    """Every white-space character at both ends, and a run of spaces inside that a search from each place would not finish."""
    texts = [c + "a" + c + "b" + c for c in map(chr, range(1, 0x3100))] + ["", " ", "x" + " " * 300_000 + "y "]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "i int, s string")
    got = {r.i: r.t for r in df.select("i", X.strip(F.col("s")).alias("t")).collect()}
    assert got == {i: t.strip() for i, t in enumerate(texts)} | {-1: None}


def test_strip_and_lines_like_python(spark):
    samples = ["\t a ", "　x y\x85", "a\r\nb\rc\n\nd", "", "\x1c\x1fz ", "é  "]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    rows = df.select("i", X.strip(F.col("s")).alias("t"), X.lines(F.col("s")).alias("l")).collect()
    for r in rows:
        assert r.t == samples[r.i].strip()
        assert r.l == [x.strip() for x in samples[r.i].splitlines() if x.strip()]


def test_normalised_pages(spark):
    raw = spark.createDataFrame([("f", 1, None), ("f", 2, " a\r\nb\rc \n"), ("f", 3, "")], "source_file string, page_number int, text string")
    assert [(r.text, r.char_count) for r in pages.page_texts(raw).orderBy("page_number").collect()] == [("", 0), ("a\nb\nc", 5), ("", 0)]


def test_word_terms_have_unicode_boundaries(spark):
    found = scored(spark, ["5 V." + "x" * 200, "aµV b" + " " * 200, "mV" + "x" * 200, "V" + " y" * 100], positive=[(r"\bV\b", 1.0, "unit", "regex")], negative=[("nothing at all", -1.0, "none", "case_sensitive")])
    assert [bool(found[i].matched_terms) for i in (1, 2, 3, 4)] == [True, False, False, True]


def test_overlapping_negatives_floor_and_short_page(spark):
    found = scored(spark, ["Legal Disclaimer", None])
    assert found[1].negative_reasons == ["-8: matched legal_disclaimer term 'Legal Disclaimer'", "-1: matched legal_disclaimer term 'Disclaimer'", "-3: very short extracted text"]
    assert found[1].score == 0.0 and found[1].relevance_level == "irrelevant"
    assert found[2].matched_terms == [] and found[2].char_count == 0


def test_both_micro_signs_are_terms(spark):
    assert scored(spark, ["μA µA" + " " * 100])[1].matched_terms == ["μA", "µA"]


def test_levels_follow_the_left_fold(spark):
    """Sums of doubles in term order; where an exact sum would reach a bucket, the fold decides."""
    weights = [0.1] * 10 + [2.0]  # folds to 2.9999999999999996
    positive = [(f"w{i}x", w, "c", "case_insensitive") for i, w in enumerate(weights)]
    found = scored(spark, [" ".join(f"w{i}x" for i in range(11)) + " " * 100], positive=positive, negative=[("zz", -1.0, "n", "case_insensitive")])
    total = 0.0
    for w in weights:
        total += w
    assert (found[1].relevance_level == "low") == (total >= 3) and found[1].score == 3.0


def test_unknown_mode_raises():
    with pytest.raises(ValueError, match="unknown match mode"):
        scoring.term_matches(None, None, "x", "fuzzy")


def test_injected_scorer(spark):
    df = spark.createDataFrame([("f", 1, "x" * 4000, 4000)], pages.PAGES)
    row = scoring.score_with(df, lambda t: {"score": len(t) / 100, "relevance_level": "high", "useful_for_extraction": True, "likely_content_type": "t", "reasoning": "r"}).first()
    assert row.score == round(len(scoring.truncated("x" * 4000)) / 100, 2) and row.extraction_targets_found == []


SCORES = "source_file string, page_number int, score double, relevance_level string, matched_categories array<string>, useful_for_extraction boolean, likely_content_type string, extraction_targets_found array<string>"


def both(spark):
    levels = list(itertools.product(["high", "low"], repeat=2))
    make = lambda k: spark.createDataFrame([("f", i, 5.0, lv[k], ["a"], None, None, None) for i, lv in enumerate(levels, 1)], SCORES)
    return make(0), make(1)


@pytest.mark.parametrize("strategy,status", [("union", ["selected", "selected", "selected", "discarded"]), (" Intersection ", ["selected", "discarded", "discarded", "discarded"]), ("hybrid", ["selected_primary", "selected_secondary", "selected_secondary", "discarded"])])
def test_selection_table(spark, strategy, status):
    rows = compare.select_pages(compare.checked_comparison(*both(spark)), strategy).orderBy("page_number").collect()
    assert [r.selection_status for r in rows] == status
    assert [r.rule_based_rank for r in rows] == [1, 2, 3, 4]  # ties by page number


def test_mismatched_and_repeated_pages_raise(spark):
    rule, llm = both(spark)
    with pytest.raises(ValueError, match="page sets do not match"):
        compare.checked_comparison(rule, llm.where("page_number > 1"))
    with pytest.raises(ValueError, match="repeat page"):
        compare.checked_comparison(rule.union(rule), llm)
    with pytest.raises(ValueError, match="unsupported selection strategy"):
        compare.select_pages(rule, "best")


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("f", 2, "b", 1), ("f", 1, "a\nc", 3), ("g", 1, "", 0)], pages.PAGES)
    sinks.write_json(sinks.page_document(df), str(tmp_path / "out"))
    back = pages.read_json(spark, str(tmp_path / "out"), lines=True).orderBy("source_file", "page_number").collect()
    assert [tuple(r) for r in back] == [("f", 1, "a\nc", 3), ("f", 2, "b", 1), ("g", 1, "", 0)]


def test_bad_json_raises(spark, tmp_path):
    (tmp_path / "x.json").write_text("{nope")
    with pytest.raises(Exception):
        pages.read_json(spark, str(tmp_path / "x.json")).collect()
    (tmp_path / "y.json").write_text(json.dumps({"source_file": "f", "pages": [{"page_number": 1, "text": "ab"}]}))
    assert pages.read_json(spark, str(tmp_path / "y.json")).first().char_count == 2


def test_summary_of_extraction(spark):
    df = spark.createDataFrame([("f", 1, "", 0), ("f", 2, "ab", 2)], pages.PAGES)
    assert tuple(pages.extraction_summary(df).first()) == ("f", 2, 2, [1])
