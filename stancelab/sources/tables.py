"""Dataset registry and Parquet readers.

Parquet is the storage format at rest: readers only name tables and columns,
so Catalyst prunes columns and pushes filters into the scan.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Logical study datasets -> relative table paths (S3).  Unknown names raise.
STUDY_TABLES = {
    "covid": "responses/covid",
    "validation": "responses/validation",
    "bank_covid": "prompts/covid",
    "bank_generation_covid": "prompts/generation_covid",
    "bank_validation": "prompts/validation",
    "axis_labels": "prompts/labels",
    "justification_labels": "justifications/labelled",
    "justification_comparisons": "justifications/comparisons",
    "embedding_archive": "justifications/archive",
    "embedding_manifest": "justifications/manifest",
    "justification_texts": "justifications/texts",
}

RESPONSE_CONTRACT = ("named_prime", "issue_no_key", "full_prompt")


def table_path(root: str, name: str) -> str:
    """Where a registered study table lies under ``root``."""
    if name not in STUDY_TABLES:
        raise ValueError(f"{name!r} is not a registered study table (known: {', '.join(sorted(STUDY_TABLES))})")
    return os.path.join(root, STUDY_TABLES[name])


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Read one driver table (``{sf_dir}/{name}.parquet``), optionally projected."""
    if name not in DRIVER_TABLES:
        raise ValueError(f"Unknown table {name!r}; expected one of {DRIVER_TABLES}")
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def read_study(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read a registered study dataset stored as Parquet (S4); missing paths raise."""
    return spark.read.parquet(table_path(root, name))


def require_columns(df: DataFrame, required: Iterable[str] = RESPONSE_CONTRACT, what: str = "input") -> DataFrame:
    """Schema contract (S5): fail before any job runs when a column is missing."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {', '.join(missing)}")
    return df
