"""Sharding by rendezvous hashing of a stable record key over weighted shards.

Every (key, shard) pair has a fixed hash u in (0, 1); a record goes to the shard with the least
-ln(u) / weight.  A key's shard depends on the key and the shard list alone, shards get records in
proportion to their weights, and one more shard only takes records into itself, about its share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import row_index
from .others import packed, unpacked

#: Width, in doc ids, of the blocks that number the slots of a shard.
BLOCK = 1 << 16


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number 0 .. len(weights) - 1 of a string key; a null key is a key of its own.

    Equal scores (2**-52 apart) go to the smaller shard.  Weights must be positive.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one per shard")
    return F.array_min(F.array(*_scores(key, weights)))["shard"]


def _scores(key: Column, weights: Sequence[float]) -> list[Column]:
    key = F.coalesce(key, F.lit("null"))
    out = []
    for i, w in enumerate(weights):
        digits = F.substring(F.md5(F.concat(key, F.lit(f":{i}"))), 1, 13)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
        out.append(F.struct((-F.log(u) / F.lit(float(w))).alias("score"), F.lit(i).alias("shard")))
    return out


def shard_documents(docs: DataFrame, shards: int = 24, weights: Sequence[float] | None = None) -> DataFrame:
    """``docs`` plus size, text_crc32, law, shard, slot and grown_shard.

    The key is doc_id (null: one key of its own); repeated rows and repeated ids go together.
    size: UTF-8 bytes of the text (null: none) plus 8.  text_crc32: of the text's bytes (null: of
    none).  slot: gapless from 0 within a shard, by (doc_id, text_crc32, size).  grown_shard: the
    shard after one more of weight 1 is added.  Columns of ``docs`` with these names are replaced.
    """
    weights = list(weights) if weights is not None else [1.0] * shards
    key = F.col("doc_id").cast("string")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    scored = (packed(docs, "doc_id", "text")
              .withColumn("size", F.octet_length(text).cast("long") + 8)
              .withColumn("text_crc32", F.crc32(F.encode(text, "UTF-8")))
              .withColumn("_scores", F.array(*_scores(key, [*weights, 1.0])))
              .withColumn("law", F.lit("key"))
              .withColumn("shard", F.coalesce(F.array_min(F.slice("_scores", 1, len(weights)))["shard"], F.lit(0)))
              .withColumn("grown_shard", F.array_min("_scores")["shard"])
              .drop("_scores"))
    block = F.coalesce(F.floor(F.col("doc_id") / F.lit(BLOCK)).cast("long"), F.lit(-(1 << 62)))
    done = row_index(scored, ["doc_id", "text_crc32", "size"], "slot", partition=["shard"], block=block)
    return unpacked(done, docs.columns, "size", "text_crc32", "law", "shard", "grown_shard", "slot")
