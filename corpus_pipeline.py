"""Corpus pipeline: each stage is one operator, written as Parquet and read again by the next.

toxicity -> near-dedup -> benchmark decontamination -> mixing -> sharding.  A stage works on all its
predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelab.llm.decontam import decontaminate
from stancelab.llm.idfilter import mark_suspects
from stancelab.llm.mixing import mix_sources, repeat_documents
from stancelab.llm.neardup import near_duplicates
from stancelab.llm.others import packed, unpacked
from stancelab.llm.scratch import TEXT_ROWS, Scratch
from stancelab.llm.shards import shard_documents
from stancelab.llm.toxicity import score_documents, train

SHARDS = 24


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it is fitted on the labelled rows of ``docs``.

    What it calls toxic is noted first, by doc_id and digest of the text, so texts go to Python a few
    rows at a time and none comes back.  Only rows that may have a noted id are joined with the notes;
    the others stay where they are.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    digest = F.sha2(F.col("text").cast("string"), 256)
    scored = score_documents(docs.select("doc_id", "text", digest.alias("_digest")), train(docs, labels), keep_text=False)
    noted = scored.where("predicted = 1").select(F.col("doc_id").alias("_id"), "_digest")
    noted = Scratch(spark, "toxic").table(noted, batch_rows=TEXT_ROWS)
    rows = mark_suspects(packed(docs, "doc_id", "text"), "doc_id", noted.select("_id"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (digest == F.col("_digest"))
    asked = rows.where("_suspect").join(noted, same, "left_anti")
    return unpacked(rows.where("NOT _suspect").unionByName(asked).drop("_suspect"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (5-word shingles, similarity 0.8).

    A row goes if no row of its doc_id is kept.  Only rows that may have an id with a row to drop are
    joined with the kept ids; the others stay where they are.
    """
    found = Scratch(spark, "copies").table(near_duplicates(docs.select("doc_id", "text")).select("doc_id", "kept"))
    rows = mark_suspects(packed(docs, "doc_id", "text"), "doc_id", found.where("NOT kept").select("doc_id"))
    kept = found.where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    asked = rows.where("_suspect").join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    return unpacked(rows.where("NOT _suspect").unionByName(asked).drop("_suspect"), docs.columns)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it: none, one or two rows."""
    mixed = mix_sources(packed(docs, "doc_id", "source", "text"))
    return unpacked(repeat_documents(mixed).drop("size", "source_size", "target", "times", "taken"), docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row; copies of a document go to one shard."""
    return shard_documents(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_test_items),
    ("mixing", mix),
    ("sharding", shard),
]

#: None: SQL cannot express the trained classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``; each but the last is cut at a Parquet table."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.table(docs, name)
    return docs
