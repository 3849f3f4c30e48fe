"""Two-proportion tests, bars, forecast verdicts and tables against hand values and shipped rows."""

import math

from pyspark.sql import functions as F

from stancelab.operators import forecast as fc
from stancelab.operators import significance as sig

# Shipped result rows (domain, comparison, lib_right, con_right, lib_left, con_left, z, p).
SHIPPED = [
    ("vaccine_get", "personal_social_responsibility_vs_trust_science_government", 172, 121, 226, 235,
     2.595035752816515, 0.0047290539949729855),
    ("vaccine_get", "risk_weighing_vs_trust_science_government", 335, 207, 226, 235,
     4.064278845304325, 2.4090598858340147e-05),
    ("vaccine_get", "fear_disease_vs_trust_science_government", 230, 120, 226, 235,
     4.745322113710894, 1.0408739549743895e-06),
    ("appendix_mask_mandate_for_alt1", "public_health_economic_vs_political_identity", 239, 152, 250, 177,
     0.7509193631741772, 0.22635059317716932),
]


def test_two_proportion_reproduces_shipped(spark):
    df = spark.createDataFrame([r[2:6] for r in SHIPPED], "lr long, cr long, ll long, cl long")
    got = df.select(*sig.two_proportion_columns("lr", "cr", "ll", "cl")).collect()
    for g, s in zip(got, SHIPPED):
        assert abs(g.z - s[6]) < 1e-12
        assert abs(g.p_value_greater - s[7]) / s[7] < 1e-11


def test_two_proportion_edges(spark):
    rows = [(0, 0, 5, 5), (5, 0, 5, 0), (0, 5, 0, 5), (1, 9, 9, 1)]
    df = spark.createDataFrame(rows, "lr long, cr long, ll long, cl long")
    got = df.select(*sig.two_proportion_columns("lr", "cr", "ll", "cl")).collect()
    assert got[0].p_right is None and got[0].z is None            # empty side
    assert got[1].z is None and got[2].z is None                  # pooled share 1 and 0
    assert got[3].z < 0 and got[3].p_value_greater > 0.99         # negative z
    n_r, n_l, p_r, p_l = 10, 10, 0.1, 0.9
    pooled = 0.5
    z = (p_r - p_l) / math.sqrt(pooled * (1 - pooled) * (1 / n_r + 1 / n_l))
    assert abs(got[3].z - z) < 1e-12
    assert abs(got[3].p_value_greater - 0.5 * math.erfc(z / math.sqrt(2))) < 1e-13


def test_bars_first_seen(spark):
    tests = spark.createDataFrame([
        ("d", "b_vs_a", 3, 1, 2, 2, 0.01, 1),
        ("d", "c_vs_b", 1, 1, 30, 10, 0.5, 2),     # b seen first as right side of test 1
        ("d", "a_vs_c_vs_x", 9, 9, 1, 1, 0.2, 3),  # a seen first as reference; left keeps later _vs_
    ], "domain string, comparison string, lib_right long, con_right long, lib_left long, con_left long, "
       "p_value_greater double, test_no int")
    bars = {r.category: r for r in sig.tests_to_bars(tests, ["test_no"]).collect()}
    assert set(bars) == {"a", "b", "c", "c_vs_x"}
    assert (bars["b"].liberal, bars["b"].p_value_greater) == (3, 0.01)
    assert (bars["a"].liberal, bars["a"].p_value_greater) == (2, None)
    assert bars["c"].liberal == 1 and bars["c"].p_value_greater == 0.5
    assert abs(bars["b"].liberal_share - 0.75) < 1e-15


def test_bar_share_zero_total(spark):
    tests = spark.createDataFrame([("d", "a_vs_b", 0, 0, 1, 1, None, 1)],
                                  "domain string, comparison string, lib_right long, con_right long, "
                                  "lib_left long, con_left long, p_value_greater double, test_no int")
    bars = {r.category: r for r in sig.tests_to_bars(tests, ["test_no"]).collect()}
    assert bars["a"].liberal_share == 0.0 and bars["a"].total == 0
    seg = {r.category: r for r in sig.bar_segments(sig.tests_to_bars(tests, ["test_no"])).collect()}
    assert seg["a"].star is False and abs(seg["b"].y_limit - 2 * 1.14) < 1e-12


def test_forecast_rules(spark):
    coefs = spark.createDataFrame([
        (1, "Closing Businesses", "liberal"),   # override, mixed case
        (1, "other", "conservative"),           # reverse_code 0 -> liberal expected -> wrong
        (2, "x", "conservative"),               # reverse_code 1 -> correct
        (3, "y", "liberal"),                    # reverse_code NULL -> wrong
        (4, "z", "no_effect"),
    ], "issue_no int, keyword string, direction string")
    bank = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (3, None), (4, 1)], "issue_no int, reverse_code int")
    f = {(r.issue_no, r.keyword): r.derived_forecast_result for r in fc.forecast_table(coefs, bank).collect()}
    assert f == {(1, "Closing Businesses"): "correct", (1, "other"): "wrong", (2, "x"): "correct",
                 (3, "y"): "wrong", (4, "z"): "no_effect"}
    counts = {r.verdict: r.n for r in fc.verdict_counts(fc.forecast_table(coefs, bank)).collect()}
    assert counts == {"correct": 2, "wrong": 2, "no_effect": 1}
    empty = coefs.where(F.col("direction") != "no_effect")
    counts = {r.verdict: r.n for r in fc.verdict_counts(fc.forecast_table(empty, bank)).collect()}
    assert counts["no_effect"] == 0                     # verdict category with zero rows
    chk = fc.count_check(fc.verdict_counts(fc.forecast_table(coefs, bank)), {"correct": 2, "wrong": 2,
                                                                              "no_effect": 1}).first()
    assert chk.status == "pass"


def test_forecast_tests_table(spark):
    rows = [("k1", "correct")] * 3 + [("k1", "wrong")] + [("k2", "no_effect")] * 2 + [("k3", "wrong")]
    f = spark.createDataFrame(rows, "issue_no_key string, derived_forecast_result string")
    t = {(r.level, r.null_handling): (r.correct, r.total) for r in fc.forecast_tests(f, ["issue_no_key"]).collect()}
    assert t[("prompt", "count_null_as_wrong")] == (3, 7)
    assert t[("prompt", "exclude_null")] == (3, 5)
    assert t[("issue", "count_null_as_wrong")] == (1, 3)
    assert t[("issue", "exclude_null")] == (1, 2)
