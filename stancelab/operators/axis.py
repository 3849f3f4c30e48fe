"""Semantic-axis scoring (P12, P13, P14) and per-group mean vectors.

Anchors reach the vectors either as a scalar subquery (a single anchor pair:
Spark evaluates it once and fails if it returns more than one row, so its size
is proven) or through an equi-join on the issue key (one anchor pair per issue;
the planner broadcasts it only below the size threshold).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import axis_projection


def projection_sign(proj: str | Column) -> Column:
    """1 when the projection is positive, else 0 (exactly 0 counts as 0); NULL stays NULL."""
    p = F.col(proj) if isinstance(proj, str) else proj
    return F.when(p.isNotNull(), (p > 0).cast("int"))


def single_vector(df: DataFrame, vec: str) -> Column:
    """A vector as a scalar subquery Column; at most one row may qualify."""
    return df.select(F.col(vec).cast("array<double>")).scalar()


def mean_vector_by(df: DataFrame, keys: Sequence[str], vec: str, name: str = "mean_vec") -> DataFrame:
    """Element-wise mean vector per key, by the mergeable ``Summarizer`` aggregate."""
    return (df.select(*keys, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
            .groupBy(*keys).agg(Summarizer.mean(F.col("_v")).alias("_m"))
            .select(*keys, vector_to_array("_m").alias(name)))


def project(df: DataFrame, vec: str, positive: Column, negative: Column) -> DataFrame:
    """Add proj = cos(v, positive) - cos(v, negative) and its sign proj_b.

    The anchors are first bound to columns (a scalar subquery may not sit inside a
    higher-order function), then scored.
    """
    bound = df.withColumn("_pos_anchor", positive).withColumn("_neg_anchor", negative)
    return (bound.withColumn("proj", axis_projection(vec, "_pos_anchor", "_neg_anchor"))
            .withColumn("proj_b", projection_sign("proj"))
            .drop("_pos_anchor", "_neg_anchor"))


def project_by_issue(responses: DataFrame, anchors: DataFrame, vec: str, issue: str = "issue_no") -> DataFrame:
    """Responses joined to their issue's (positive_vec, negative_vec) anchors, then scored."""
    j = responses.join(anchors.select(issue, "positive_vec", "negative_vec"), issue)
    return project(j, vec, F.col("positive_vec"), F.col("negative_vec")).drop("positive_vec", "negative_vec")
