"""Comma-list cells (prompt banks keep lists as ``"a, b ,c"`` strings)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col
from .text import py_strip


def split_list(c: str | Column, sep: str = ",") -> Column:
    """NULL -> []; split on ``sep``, strip every item, drop empty items."""
    parts = F.transform(F.split(col(c), sep), lambda s: py_strip(s))
    kept = F.filter(parts, lambda s: s != F.lit(""))
    return F.coalesce(kept, F.array().cast("array<string>"))


def normalise_list(c: str | Column, sep: str = ",") -> Column:
    """Re-join the cleaned items with a bare ``sep`` (``" a , ,b"`` -> ``"a,b"``)."""
    return F.array_join(split_list(c, sep), sep)


def list_item(arr: str | Column, i: int) -> Column:
    """i-th item (0-based) or ``''`` past the end; ``get`` never raises under ANSI."""
    return F.coalesce(F.get(col(arr), i), F.lit(""))


def none_to_null(c: str | Column) -> Column:
    """The banks spell a missing keyword list as the literal word ``None``."""
    v = py_strip(col(c))
    return F.when((v != F.lit("None")) & (v != F.lit("")), col(c))


def split_comparison(c: str | Column, sep: str = "_vs_") -> tuple[Column, Column]:
    """``right, left = c.split(sep, 1)``: the left part keeps any later separator."""
    parts = F.split(col(c), sep, 2)
    return F.get(parts, 0), F.get(parts, 1)
