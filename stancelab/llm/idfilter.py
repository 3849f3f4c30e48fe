"""Which rows may have an id of a given set: a bitmap of fixed size, so whole texts need not be shuffled to be told.

The bitmap has 2**25 bits (4 MiB, in pieces of 4 KiB) however many ids there are.  With very many ids it fills
up and rules out less; what it does not rule out is for an exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25


def _bit(key: Column) -> Column:
    """The bit of an id, from 1 as the bitmap functions count; null is an id of its own."""
    return F.pmod(F.xxhash64(key.cast("long")), F.lit(BITS)) + 1


def mark_suspects(rows: DataFrame, key: str, ids: DataFrame, name: str = "_suspect") -> DataFrame:
    """``rows`` plus boolean ``name``: false only where ``key`` is not in the one column of ``ids``."""
    bit = _bit(F.col(ids.columns[0]))
    bitmap = ids.groupBy(F.bitmap_bucket_number(bit).alias("_piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bits"))
    at = F.bitmap_bit_position(_bit(F.col(key)))
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = rows.join(F.broadcast(bitmap), F.bitmap_bucket_number(_bit(F.col(key))) == F.col("_piece"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns],
                         F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias(name))
