"""Forecast verdicts (P10, P11, J1, Q3), verdict counts (A4, Q2) and test table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from .significance import binomial_test

VERDICTS = ("correct", "wrong", "no_effect")

# Expected verdict counts of the study and keyword overrides of the
# expected direction (business and school open/closed prompts follow the keyword).
EXPECTED_COUNTS = {"correct": 112, "wrong": 9, "no_effect": 58}
KEYWORD_OVERRIDES = {
    "closing businesses": "liberal",
    "keeping businesses open": "liberal",
    "closing schools": "liberal",
    "keeping schools open": "liberal",
}


def _literal_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])


def expected_direction(keyword: str | Column, reverse_code: str | Column,
                       overrides: Mapping[str, str] = KEYWORD_OVERRIDES) -> Column:
    """P10: lower-cased keyword override, else reverse_code 0 -> liberal, 1 -> conservative."""
    from_code = (F.when(col(reverse_code) == 0, F.lit("liberal"))
                 .when(col(reverse_code) == 1, F.lit("conservative")))
    if not overrides:
        return from_code
    return F.coalesce(F.element_at(_literal_map(overrides), F.lower(col(keyword))), from_code)


def forecast_result(direction: str | Column, expected: str | Column) -> Column:
    """no_effect passes through; a known direction equal to a known expectation is correct;
    anything else, unknown values included, is wrong."""
    d, e = col(direction), col(expected)
    return (F.when(d == "no_effect", F.lit("no_effect"))
            .when(d == e, F.lit("correct"))
            .otherwise(F.lit("wrong")))


def forecast_table(coefs: DataFrame, bank: DataFrame, issue: str = "issue_no",
                   keyword: str = "keyword", overrides: Mapping[str, str] = KEYWORD_OVERRIDES) -> DataFrame:
    """Coefficients left-joined to the distinct (issue, reverse_code) of the bank.

    One row per issue, so the join cannot fan out.  An issue with two different codes has no
    known expectation: its code is NULL here, and :func:`conflicting_codes` lists it.
    """
    meta = bank.groupBy(issue).agg(
        F.when(F.min("reverse_code") == F.max("reverse_code"), F.min("reverse_code")).alias("reverse_code"))
    joined = coefs.join(meta, issue, "left")
    exp = expected_direction(keyword, "reverse_code", overrides)
    return (joined.withColumn("expected_direction", exp)
            .withColumn("derived_forecast_result", forecast_result("direction", "expected_direction")))


def conflicting_codes(bank: DataFrame, issue: str = "issue_no") -> DataFrame:
    """J1 check: issues with more than one reverse code, with status ``review``."""
    return (bank.groupBy(issue).agg(F.min("reverse_code").alias("least_code"), F.max("reverse_code").alias("greatest_code"))
            .where(F.col("least_code") != F.col("greatest_code")).withColumn("status", F.lit("review")))


def verdict_counts(forecast: DataFrame, verdict: str = "derived_forecast_result") -> DataFrame:
    """A4: count per verdict, absent verdicts reported as 0 (one row per verdict)."""
    counts = forecast.groupBy(verdict).agg(F.count(F.lit(1)).alias("n"))
    cats = [F.struct(F.lit(i).alias("verdict_no"), F.lit(v).alias("verdict")) for i, v in enumerate(VERDICTS)]
    agg = counts.agg(*[F.sum(F.when(F.col(verdict) == v, F.col("n")).otherwise(0)).alias(v) for v in VERDICTS])
    return (agg.select(F.explode(F.array(*[F.struct(c["verdict_no"], c["verdict"],
                                                    F.coalesce(F.col(v), F.lit(0)).cast("long").alias("n"))
                                           for c, v in zip(cats, VERDICTS)])).alias("r"))
            .select("r.verdict_no", "r.verdict", "r.n"))


def count_check(counts: DataFrame, expected: Mapping[str, int] = EXPECTED_COUNTS,
                name: str = "forecast_counts") -> DataFrame:
    """Q2: compare verdict counts with the expectation; status pass or review."""
    obs = counts.agg(*[F.max(F.when(F.col("verdict") == v, F.col("n"))).alias(v) for v in VERDICTS])
    observed = F.concat_ws(", ", *[F.concat(F.lit(f"{v}="), F.coalesce(F.col(v), F.lit(0)).cast("string"))
                                   for v in VERDICTS])
    exp_text = ", ".join(f"{v}={int(expected.get(v, 0))}" for v in VERDICTS)
    ok = F.lit(True)
    for v in VERDICTS:
        ok = ok & (F.coalesce(F.col(v), F.lit(0)) == int(expected.get(v, 0)))
    return obs.select(F.lit(name).alias("check"), observed.alias("observed"), F.lit(exp_text).alias("expected"),
                      F.when(ok, "pass").otherwise("review").alias("status"))


MAJORITY_RULE = "majority of the issue's correct and wrong wordings"


def forecast_tests(forecast: DataFrame, issue_key: Sequence[str], p: float = 0.5,
                   verdict: str = "derived_forecast_result",
                   issue_counts: tuple[int, int, int] | None = None) -> DataFrame:
    """Exact binomial tests at prompt and issue level, counting no_effect as wrong
    or excluding it.  Four rows: level, null_handling, correct, total, p_value_greater, rule.

    ``issue_counts`` = (correct, wrong, all) issues, where a study has its own issue verdicts;
    without it an issue is judged by the majority of its wordings (ours; a tie or no effect at
    all counts for neither).  ``rule`` names what was used at each level.

    One per-issue aggregate feeds both levels: prompt-level counts are its sums.
    """
    per_issue = forecast.groupBy(*issue_key).agg(
        F.count_if(F.col(verdict) == "correct").alias("_c"),
        F.count_if(F.col(verdict) == "wrong").alias("_w"),
        F.count(F.lit(1)).alias("_t"))
    t = per_issue.agg(
        F.sum("_c").alias("pc"), F.sum("_w").alias("pw"), F.sum("_t").alias("pt"),
        F.count_if(F.col("_c") > F.col("_w")).alias("ic"), F.count_if(F.col("_w") > F.col("_c")).alias("iw"),
        F.count(F.lit(1)).alias("it"))

    issue_rule = MAJORITY_RULE
    if issue_counts is not None:
        right, wrong, every = issue_counts
        t = t.withColumns({"ic": F.lit(right), "iw": F.lit(wrong), "it": F.lit(every)})
        issue_rule = "given counts"

    def row(level: str, handling: str, correct: str, total: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), F.lit(handling).alias("null_handling"),
                        F.coalesce(F.col(correct), F.lit(0)).cast("long").alias("correct"),
                        F.coalesce(total, F.lit(0)).cast("long").alias("total"),
                        F.lit("wordings" if level == "prompt" else issue_rule).alias("rule"))

    rows = t.select(F.explode(F.array(
        row("prompt", "count_null_as_wrong", "pc", F.col("pt")),
        row("prompt", "exclude_null", "pc", F.col("pc") + F.col("pw")),
        row("issue", "count_null_as_wrong", "ic", F.col("it")),
        row("issue", "exclude_null", "ic", F.col("ic") + F.col("iw")),
    )).alias("r")).select("r.*")
    return binomial_test(rows, "correct", "total", p)
