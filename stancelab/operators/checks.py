"""Consistency checks (A3, Q1, Q4, Q5, Q7) and the JSON-style summary rows.

Checks are aggregates over the full tables (exact distinct counts, never the
approximate variant) turned into ``(check, observed, expected, status)`` rows.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import path_exists

CHECK_SCHEMA = "check string, observed string, expected string, status string"

# Expected response-table shapes of the two study datasets.
EXPECTED_SHAPES = {
    "covid": {"rows": 179000, "prompts": 358, "questions": 179},
    "validation": {"rows": 143000, "prompts": 286, "questions": 143},
}
FORECAST_NOTE = (
    "Verdicts are per wording. The expected direction is the issue's reverse code, unless the wording's keyword has an "
    "override of its own (open or closed businesses and schools)."
)


def distinct_counts(df: DataFrame, units: Mapping[str, str | Column], totals: Mapping[str, Column]) -> DataFrame:
    """One row: the exact number of distinct non-null values of each unit, and plain aggregates ``totals``.

    Each unit is de-duplicated on its own, over a scan of its one column, then counted.  Several
    ``count(DISTINCT)`` in one aggregate would copy every row once per unit instead.
    """
    rows = [df.agg(*[t.cast("long").alias(name) for name, t in totals.items()]).select(
        F.explode(F.array(*[F.struct(F.lit(name).alias("unit"), F.col(name).alias("n")) for name in totals])).alias("r"))
        .select("r.*")]
    for name, c in units.items():
        each = df.select((F.col(c) if isinstance(c, str) else c).alias("value")).where("value IS NOT NULL").distinct()
        rows.append(each.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("unit"), "n"))
    return reduce(DataFrame.unionByName, rows).agg(
        *[F.max(F.when(F.col("unit") == name, F.col("n"))).alias(name) for name in (*totals, *units)])


def summary_counts(df: DataFrame, dataset: str, units: Mapping[str, str]) -> DataFrame:
    """A3: one row: dataset, rows, and exact distinct counts named by ``units``
    (e.g. ``{"prompts": "prompt_no", "questions": "question_no", "issues": "issue_no"}``)."""
    counts = distinct_counts(df, units, {"rows": F.count(F.lit(1))})
    return counts.select(F.lit(dataset).alias("dataset"), "*")


def shape_check(counts: DataFrame, expected: Mapping[str, int | Column],
                names: Sequence[str] = ("rows", "prompts", "questions"), check: str | None = None) -> DataFrame:
    """Q1: ``observed`` vs ``expected`` text for the named counts; pass only if all equal.

    ``expected`` values are ints or Columns over ``counts`` (checks derived from data).
    """
    exp_cols = {n: (F.lit(v) if isinstance(v, int) else v).cast("long") for n, v in expected.items()}
    observed = F.concat_ws(", ", *[F.concat(F.col(n).cast("string"), F.lit(f" {n}")) for n in names])
    expected_txt = F.concat_ws(", ", *[F.concat(exp_cols[n].cast("string"), F.lit(f" {n}")) for n in names])
    ok = F.lit(True)
    for n in names:
        ok = ok & F.col(n).eqNullSafe(exp_cols[n])
    name = F.lit(check) if check else F.concat(F.col("dataset"), F.lit("_response_shape"))
    return counts.select(name.alias("check"), observed.alias("observed"), expected_txt.alias("expected"),
                         F.when(ok, "pass").otherwise("review").alias("status"))


def with_note(checks: DataFrame, note: str = FORECAST_NOTE) -> DataFrame:
    """Q4: attach the explanatory note to every check row."""
    return checks.withColumn("note", F.lit(note))


def missing_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``left`` absent from ``right`` (left anti join)."""
    return left.select(*keys).dropDuplicates().join(right.select(*keys).dropDuplicates(), list(keys), "left_anti")


def required_inputs(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Q5: one check row per required input path (pass when it exists).  Existence is
    asked of Spark's reader, so shared storage is checked, not the driver's disk."""
    found = {p: path_exists(spark, p) for p in paths}
    rows = [(f"input:{os.path.basename(p.rstrip('/'))}", "present" if ok else "missing", "present",
             "pass" if ok else "review") for p, ok in found.items()]
    return spark.createDataFrame(rows, CHECK_SCHEMA)
