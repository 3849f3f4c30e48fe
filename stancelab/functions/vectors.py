"""Dense-vector expressions over ``array<float|double>`` columns.

Higher-order array functions keep the arithmetic in the JVM; arrays are widened
to double first so products and sums are float64 like the reference's NumPy.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col


def as_double_array(c: str | Column) -> Column:
    return col(c).cast("array<double>")


def array_sum(c: str | Column) -> Column:
    return F.aggregate(col(c), F.lit(0.0), lambda acc, v: acc + v)


def dot(a: str | Column, b: str | Column) -> Column:
    return array_sum(F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x * y))


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """dot / (|a| |b|); NULL (not NaN, not an error) when either vector is all zeros."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def sq_dist(a: str | Column, b: str | Column) -> Column:
    return array_sum(F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: (x - y) * (x - y)))


def dist(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(sq_dist(a, b))


def axis_projection(v: str | Column, positive: str | Column, negative: str | Column) -> Column:
    """Semantic-axis score: cos(v, positive) - cos(v, negative)."""
    return cosine(v, positive) - cosine(v, negative)
