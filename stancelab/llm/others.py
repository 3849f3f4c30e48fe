"""Columns that an operator only carries along, in one struct: no name of theirs can meet one of its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACK = "_carried"


def packed(docs: DataFrame, *own: str) -> DataFrame:
    """The columns ``own`` of ``docs``, as far as it has them, and all others in the struct ``_carried``."""
    others = [c for c in docs.columns if c not in own]
    kept = [F.col(f"`{c}`") for c in docs.columns if c in own]
    return docs.select(*kept, F.struct(*[F.col(f"`{c}`") for c in others]).alias(PACK)) if others else docs.select(*kept)


def unpacked(df: DataFrame, columns: Sequence[str], *results: str) -> DataFrame:
    """``columns``, the carried ones out of their struct, then ``results``, which replace columns of their names."""
    own = [c for c in df.columns if c != PACK]
    return df.select(*[F.col(f"`{c}`") if c in own else F.col(PACK)[c].alias(c) for c in columns if c not in results],
                     *results)
