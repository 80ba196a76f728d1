"""Scores of cases by hand, and gates at their thresholds."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillmill.operators import evaluation as E


def test_case_scores(spark):
    rows = [(["a", "b"], ["b", "c", "c"]), ([], []), (None, ["x"]), (["x"], None), (["a"], ["a"]), (["a"], ["b"])]
    df = spark.createDataFrame(rows, "g array<string>, p array<string>")
    got = df.select(E.code_jaccard(F.col("g"), F.col("p")).alias("j"), E.flag_f1(F.col("g"), F.col("p")).alias("f"), E.extra_critical(F.col("g"), F.col("p"), ("x",), ("c",)).alias("c")).collect()
    assert [r.j for r in got] == pytest.approx([1 / 3, 1, 0, 0, 1, 0])
    assert [tuple(r.f) for r in got] == [(0.5, 1, 1), (1.0, 0, 0), (0.0, 1, 0), (0.0, 0, 1), (1.0, 0, 0), (0.0, 1, 1)]
    assert [r.c for r in got] == [["c"], [], ["x"], [], [], []]


def test_texts(spark):
    rows = [("Note\n\n one two ", "note\none two three"), (None, None), ("a", None), ("INDICATION: x", "Plan")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(E.text_similarity(F.col("a"), F.col("b")).alias("s"), E.missing_sections(F.col("a"), ("Indication", "Plan")).alias("m")).collect()
    clean = lambda t: "\n".join(x.strip() for x in (t or "").splitlines() if x.strip())
    assert [r.s for r in got] == [SequenceMatcher(None, clean(a), clean(b)).ratio() for a, b in rows]
    assert [r.m for r in got] == [["Indication", "Plan"]] * 3 + [["Plan"]]


def test_micro_and_macro(spark):
    rows = [("a", True, True), ("a", True, False), ("b", False, True), ("c", True, True), ("c", False, False)]
    got = E.f1_scores(spark.createDataFrame(rows, "label string, g boolean, p boolean"), "label", "g", "p").first()
    assert (got.micro_f1, got.macro_f1, got.labels) == (pytest.approx(4 / 6), pytest.approx((2 / 3 + 1) / 2), 2)
    assert tuple(E.f1_scores(spark.createDataFrame([], "label string, g boolean, p boolean"), "label", "g", "p").first()) == (0.0, 0.0, 0)


def test_gates(spark):
    df = spark.createDataFrame([(0.95, 0.98999, 0.03, None)], "parse_success_rate double, render_success_rate double, critical_extra_flag_rate double, avg_flag_f1 double")
    got = {r.gate: (r.observed, r.passed, r.advice) for r in E.gates(df).collect()}
    assert got == {"parse_success_rate": (0.95, True, False), "render_success_rate": (0.99, False, False), "avg_code_jaccard": (0.0, False, False), "avg_flag_f1": (0.0, False, False), "critical_extra_flag_rate": (0.03, True, False), "avg_text_similarity": (0.0, False, True)}
