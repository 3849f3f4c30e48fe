"""Two-group effect: every undefined path on hand-made rows."""

import math


from stancelab.operators.effects import coefficient_table, two_group_effect

SCHEMA = "g string, x double, y double, o long"


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = two_group_effect(df, ["g"], "x", "y", first_attrs=["o"], first_by=["o"])
    return {r.g: r for r in out.collect()}


def test_plain_effect_matches_welch(spark):
    rows = [("a", 1.0, v, i) for i, v in enumerate([1.0, 2.0, 4.0])] + \
           [("a", 0.0, v, 10 + i) for i, v in enumerate([0.0, 1.0])]
    r = run(spark, rows)["a"]
    m1, m0 = 7 / 3, 0.5
    v1 = sum((v - m1) ** 2 for v in [1, 2, 4]) / 2
    v0 = 0.5
    se = math.sqrt(v1 / 3 + v0 / 2)
    assert abs(r.coef - (m1 - m0)) < 1e-12 and abs(r.se - se) < 1e-12
    assert r.n == 5 and r.o == 0
    assert abs(r.ci_low - (m1 - m0 - 1.98 * se)) < 1e-12
    assert r.direction == "no_effect"


def test_undefined_paths(spark):
    rows = [
        ("only0", 0.0, 1.0, 1), ("only0", 0.0, 2.0, 2),                      # wording with only x = 0
        ("one_side", 1.0, 5.0, 3), ("one_side", 0.0, 1.0, 4), ("one_side", 0.0, 2.0, 5),  # one row on a side
        ("x2", 1.0, 1.0, 6), ("x2", 0.0, 1.0, 7), ("x2", 2.0, 1.0, 8),        # x = 2 present
        ("nulls", None, 1.0, 9), ("nulls", 1.0, None, 10), ("nulls", 1.0, float("nan"), 11),
        ("nulls", 1.0, 3.0, 12), ("nulls", 1.0, 4.0, 13), ("nulls", 0.0, 1.0, 14), ("nulls", 0.0, 1.5, 15),
        (None, 1.0, 1.0, 16),                                                # null group key dropped
        ("lib", 1.0, 10.0, 17), ("lib", 1.0, 10.5, 18), ("lib", 0.0, 0.0, 19), ("lib", 0.0, 0.5, 20),
    ]
    r = run(spark, rows)
    assert None not in r
    assert r["only0"].coef is None and r["only0"].se is None and r["only0"].n == 2
    assert r["only0"].direction == "no_effect"
    assert r["one_side"].coef == 5.0 - 1.5 and r["one_side"].se is None
    assert r["one_side"].direction == "no_effect" and r["one_side"].ci_low is None
    assert r["x2"].coef is None and r["x2"].n == 3
    assert r["nulls"].n == 4 and abs(r["nulls"].coef - (3.5 - 1.25)) < 1e-12
    assert r["lib"].direction == "liberal"


def test_conservative_direction(spark):
    rows = [("c", 1.0, 0.0, 1), ("c", 1.0, 0.1, 2), ("c", 0.0, 5.0, 3), ("c", 0.0, 5.1, 4)]
    assert run(spark, rows)["c"].direction == "conservative"


def test_coefficient_table_named_primes_and_first_row(spark):
    rows = [
        # issue_no_key, question_no, issue_no, keyword, ending, end_type, labels, liberal, proj, named, prompt, compl
        (14.1, 0, 14, "closing businesses", "e", "I think...", "good idea, bad idea", 1, 0.5, 1, 1, 0),
        (14.1, 0, 14, "closing businesses", "e", "I think...", "good idea, bad idea", 1, 0.6, 1, 1, 1),
        (14.1, 0, 14, "closing businesses", "e", "I think...", "good idea, bad idea", 0, 0.1, 1, 0, 0),
        (14.1, 0, 14, "closing businesses", "e", "I think...", "good idea, bad idea", 0, 0.2, 1, 0, 1),
        (14.1, 0, 14, "closing businesses", "e", "I think...", "good idea, bad idea", 0, 9.9, 0, 5, 0),
        (3.1, 1, 3, None, "e2", "In my opinion...", "safe", 1, 0.1, 1, 2, 0),
    ]
    schema = ("issue_no_key double, question_no int, issue_no int, keyword string, ending string, "
              "end_type string, labels string, liberal int, proj double, named_prime int, prompt_no int, "
              "completion_no int")
    out = {r.issue_no_key: r for r in coefficient_table(spark.createDataFrame(rows, schema)).collect()}
    a = out[14.1]
    assert a.n == 4 and abs(a.coef - 0.4) < 1e-12
    assert (a.label_1, a.label_2) == ("good idea", "bad idea")
    b = out[3.1]
    assert (b.label_1, b.label_2) == ("safe", "") and b.keyword is None and b.coef is None


def test_hot_group_matches_pandas(spark):
    """One wording holds a third of all rows, spread over many partitions."""
    import random

    import pandas as pd
    random.seed(11)
    rows = []
    for i in range(6000):
        g = "hot" if i % 3 == 0 else f"g{i % 50}"
        x = random.randint(0, 1)
        rows.append((g, float(x), random.gauss(0.3 * x, 1.0), i))
    df = spark.createDataFrame(rows, SCHEMA).repartition(16)
    got = {r.g: r for r in two_group_effect(df, ["g"], "x", "y", first_attrs=["o"], first_by=["o"]).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "x", "y", "o"])
    for g, sub in pdf.groupby("g"):
        y1, y0 = sub[sub.x == 1].y, sub[sub.x == 0].y
        coef = y1.mean() - y0.mean()
        se = math.sqrt(y1.var(ddof=1) / len(y1) + y0.var(ddof=1) / len(y0))
        assert abs(got[g].coef - coef) < 1e-9 and abs(got[g].se - se) < 1e-9
        assert got[g].n == len(sub) and got[g].o == sub.o.min()
    assert got["hot"].n == 2000


def test_first_row_by_packed_key(spark):
    """Attributes of the first row, whatever the types of the order, with nulls first and ties broken."""
    from pyspark.sql import functions as F

    from stancelab.operators import effects as ef
    rows = [("a", 1.0, 1.0, 5, 1, 9, "late"), ("a", 0.0, 2.0, 5, 0, 9, "second"), ("a", 1.0, 3.0, 5, 0, 8, "first"),
            ("b", 1.0, 1.0, None, 7, 1, "null first"), ("b", 0.0, 2.0, -(2**63), 0, 1, "least"),
            ("c", 1.0, 1.0, 2**63 - 1, 2**31 - 1, 1, "c2"), ("c", 0.0, 1.0, 2**63 - 1, -(2**31), None, "c1"),
            ("d", 0.0, 1.0, 0, None, 3, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double, o long, p int, q long, name string")
    want = {"a": "first", "b": "null first", "c": "c1", "d": None}
    for order in (["o", "p", "q"], ["o", "p"]):  # q does not fit in the packed key
        got = ef.two_group_effect(df, ["g"], "x", "y", first_attrs=["name", "o"], first_by=["o", "p", "q"])
        assert {r.g: r.name for r in got.collect()} == want
    plain = ef.two_group_effect(df.withColumn("o", F.col("o").cast("double")), ["g"], "x", "y",
                                first_attrs=["name"], first_by=["o", "p", "q"])  # cannot be packed
    assert {r.g: r.name for r in plain.collect()} == want
    dated = df.select("*", F.date_add(F.lit("2020-01-01"), F.col("p") % 7).alias("day"), (F.col("q") > 8).alias("flag"))
    by_day = ef.two_group_effect(dated, ["g"], "x", "y", first_attrs=["name"], first_by=["flag", "day", "o"])
    by_struct = dated.groupBy("g").agg(F.min_by("name", F.struct("flag", "day", "o")).alias("name"))
    assert {r.g: r.name for r in by_day.collect()} == {r.g: r.name for r in by_struct.collect()}


def test_first_row_is_hash_aggregated(spark):
    from stancelab.operators import effects as ef
    df = spark.createDataFrame([("a", 1.0, 1.0, 5, 1, "n")], "g string, x double, y double, o long, p int, name string")
    plan = ef.grouped_effects(df, ["g"], ef.effect_aggregates("x", "y"), ef.packed_order(df, ["o", "p"]))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text
    whole = ef.two_group_effect(df, ["g"], "x", "y", first_attrs=["name"], first_by=["o", "p"])
    text = whole._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text
