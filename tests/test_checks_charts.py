"""Registry, checks, display labels and coefficient panels on hand-made rows."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from stancelab.operators import charts as ch
from stancelab.operators import checks as ck
from stancelab.operators.prompts import normalise_bank, union_banks
from stancelab.sources.tables import read_table, table_path


def test_registry_names():
    assert table_path("/data", "covid").endswith("responses/covid")
    with pytest.raises(ValueError):
        table_path("/data", "nope")


def test_read_table_prunes(spark):
    df = read_table(spark, "/root/testdata/sf0.001", "part", ["p_partkey", "p_type"])
    assert df.columns == ["p_partkey", "p_type"]
    with pytest.raises(ValueError):
        read_table(spark, "/root/testdata/sf0.001", "not_a_table")


def test_shape_check_and_note(spark):
    resp = spark.createDataFrame([(1, 0), (1, 0), (2, 1)], "prompt_no int, question_no int")
    counts = ck.summary_counts(resp, "covid", {"prompts": "prompt_no", "questions": "question_no"})
    row = ck.shape_check(counts, {"rows": 3, "prompts": 2, "questions": 2}).first()
    assert (row.check, row.status) == ("covid_response_shape", "pass")
    assert row.observed == "3 rows, 2 prompts, 2 questions"
    bad = ck.shape_check(counts, {"rows": 4, "prompts": 2, "questions": 2}).first()
    assert bad.status == "review"
    noted = ck.with_note(ck.shape_check(counts, ck.EXPECTED_SHAPES["covid"])).first()
    assert noted.status == "review" and noted.note == ck.FORECAST_NOTE


def test_missing_keys_and_required_inputs(spark):
    left = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "label string")
    right = spark.createDataFrame([("b",)], "label string")
    assert sorted(r.label for r in ck.missing_keys(left, right, ["label"]).collect()) == ["a", "c"]
    d = tempfile.mkdtemp(prefix="req-")
    rows = {r.check: r.status for r in ck.required_inputs(spark, [d, os.path.join(d, "missing.csv")]).collect()}
    assert rows[f"input:{os.path.basename(d)}"] == "pass" and rows["input:missing.csv"] == "review"


def test_display_label(spark):
    df = spark.createDataFrame([("a_b", "kw"), ("x", None), ("known", "kw")], "code string, keyword string")
    got = [r[0] for r in df.select(ch.display_label("code", {"known": "Known item"}, F.col("keyword"))).collect()]
    assert got == ["kw", "X", "Known item"]


def test_coefficient_panels(spark):
    rows = [("g1", 1, "q2", 0.2, 0.1, 0.3, "a", "b"), ("g1", 1, "q1", -0.05, -0.2, 0.1, "a", "b"),
            ("g1", 3, "q1", 0.0, -0.01, 0.01, "c", "d"), ("g2", 2, "q1", 0.01, 0.0, 0.02, "a", "b")]
    coefs = spark.createDataFrame(rows, "fig string, issue int, q string, coef double, ci_low double, "
                                        "ci_high double, label_1 string, label_2 string")
    out = {(r.fig, r.issue, r.q): r for r in ch.coefficient_panels(coefs, "fig", ["issue"], ["q"],
                                                                  F.lit("p")).collect()}
    a = out[("g1", 1, "q1")]
    assert (a.panel_no, a.x_pos) == (1, 0) and out[("g1", 1, "q2")].x_pos == 1 and out[("g1", 3, "q1")].panel_no == 2
    assert abs(a.y_min - (-0.21)) < 1e-12 and abs(a.y_max - 0.31) < 1e-12 and a.mixed_axes is True
    b = out[("g2", 2, "q1")]
    assert (b.y_min, b.y_max, b.mixed_axes) == (-0.08, 0.08, False)
    assert abs(a.err_low - 0.15) < 1e-12 and abs(a.err_high - 0.15) < 1e-12


def test_union_banks(spark):
    a = normalise_bank(spark.createDataFrame([(0, "p", "k", "0", "x", 1, 0)],
                                             "issue_no int, prompt string, keywords string, endings string, "
                                             "labels string, topic_no int, reverse_code int"), "covid")
    b = normalise_bank(spark.createDataFrame([(5, "q", "k2 , ", "1", "y")],
                                             "issue_no int, prompt string, keywords string, endings string, "
                                             "labels string"), "validation")
    rows = {r.dataset: r for r in union_banks([a, b]).collect()}
    assert rows["validation"].reverse_code is None and rows["validation"].keywords == "k2"
    assert rows["covid"].topic_no == 1


def test_distinct_counts_without_expand(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", 2.0), (2, "a", 2.0), (None, "a", 3.0)], "p int, q string, r double")
    got = ck.distinct_counts(df, {"ps": "p", "qs": "q", "rs": "r"}, {"rows": F.count(F.lit(1)), "most": F.max("p")})
    assert got.first().asDict() == {"rows": 4, "most": 2, "ps": 2, "qs": 2, "rs": 2}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    empty = ck.distinct_counts(df.limit(0), {"ps": "p"}, {"rows": F.count(F.lit(1))}).first()
    assert (empty.rows, empty.ps) == (0, 0)


def test_bar_layout(spark):
    """Bars in the order of the tests, labels wrapped as text is, an empty segment without a text."""
    import textwrap

    from stancelab.functions.text import wrap_words
    from stancelab.operators import significance as sig
    names = ["", "one", "Health And Side Effects Of It", "Incomprehensibilities Of", "a b c d e f g h i j", "exactly sixteen c d",
             "sixteen letters!"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(wrap_words("n").alias("w")).collect()
    assert [r.w for r in got] == ["\n".join(textwrap.wrap(n, width=16, break_long_words=False)) for n in names]
    tests = spark.createDataFrame(
        [("d", "zeta_vs_ref", 3, 1, 0, 4, 0.01, 0), ("d", "alpha_vs_ref", 1, 2, 0, 4, 0.5, 1), ("e", "ref_vs_x", 1, 7, 0, 0, None, 2)],
        "domain string, comparison string, lib_right long, con_right long, lib_left long, con_left long, p_value_greater double, test_no int")
    bars = sig.bar_segments(sig.tests_to_bars(tests, ["test_no"], with_position=True), labels={"ref": "Reference"}, titles={"d": "First"})
    rows = sorted(bars.collect(), key=lambda r: (r.domain, r.x_pos))
    assert [(r.domain, r.x_pos, r.category, r.category_label, r.panel_label) for r in rows] == [
        ("d", 0, "zeta", "Zeta", "First"), ("d", 1, "ref", "Reference", "First"), ("d", 2, "alpha", "Alpha", "First"),
        ("e", 0, "ref", "Reference", "E"), ("e", 1, "x", "X", "E")]
    assert [(r.liberal_text, r.conservative_text) for r in rows] == [
        ("3\n(75.0%)", "1\n(25.0%)"), (None, "4\n(100.0%)"), ("1\n(33.3%)", "2\n(66.7%)"), ("1\n(12.5%)", "7\n(87.5%)"), (None, None)]
    assert "bar_no" not in sig.tests_to_bars(tests, ["test_no"]).columns
