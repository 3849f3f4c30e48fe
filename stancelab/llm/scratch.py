"""Lineage cuts as Parquet tables in the shared checkpoint folder, and module shipping."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

#: Rows of an Arrow batch in jobs whose rows hold one or two whole texts each.
TEXT_ROWS = 1000

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    A session that ships the package itself (``--py-files``, an image) is unaffected.
    """
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = ":".join([*parts, _ROOT])


@contextmanager
def _batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """The session's limit of rows a batch, lowered to ``rows`` meanwhile."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if rows is None or 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables of one run under ``spark.checkpoint.dir``; each survives the loss of any executor."""

    def __init__(self, spark: SparkSession, name: str):
        ready(spark)
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def table(self, df: DataFrame, tag: str = "t", compression: str = "snappy",
              batch_rows: int | None = None) -> DataFrame:
        """Write ``df`` and read it back: one job, a plan cut, sizes known to the planner.

        ``batch_rows``: rows of an Arrow batch in this job, at most; for rows that hold whole texts.
        """
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{tag}"
        with _batches_of(self.spark, batch_rows):
            df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads, through Hadoop's file system."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)
