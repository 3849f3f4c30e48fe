"""Small numeric Column helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_double(c: str | Column) -> Column:
    """Cast to double and turn NaN into NULL (pandas drops both; Spark's NaN > 0 is true)."""
    v = col(c).cast("double")
    return F.when(~F.isnan(v), v)


def safe_div(a: str | Column, b: str | Column) -> Column:
    """Division that is NULL for a zero or NULL divisor instead of raising under ANSI."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def r6(c: str | Column, digits: int = 6) -> Column:
    """Round for engine-independent comparison; ``+ 0.0`` folds -0.0 into 0.0."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)
