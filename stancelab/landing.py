"""Tables written once in the shared checkpoint folder, and modules for Python workers.

A table that several plans read, or that an iteration goes on from, is written there: it is computed
once, its size is known to the planner, and the loss of an executor repeats one job at most.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from .session import checkpoint_dir

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Let local Python workers import this package; on a cluster it must be shipped (``--py-files``, an image)."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = ":".join([*parts, _ROOT])


class Landing:
    """Tables of one run in a folder of its own under ``spark.checkpoint.dir``.

    They stay until ``drop`` or ``close`` is called, as a DataFrame that a caller got may read them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self._spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self._paths: dict[int, str] = {}
        self._n = 0

    def table(self, df: DataFrame, tag: str = "t") -> DataFrame:
        """Write ``df`` and read it back: one job, after which its plan is a scan."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{tag}"
        df.write.parquet(path)
        out = self._spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(self._paths.pop(id(t)))

    def close(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self._spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
