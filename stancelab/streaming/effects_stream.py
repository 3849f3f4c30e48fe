"""The two-group effect maintained incrementally over arriving response files.

Response dumps land as Parquet files in a folder; a Structured Streaming query
keeps the mergeable sufficient statistics per wording (counts, means and
variances per arm - one state row per group, whatever the number of responses)
and emits the updated coefficient rows after every micro-batch.  The state
store and offsets live in the query's checkpoint location, so a restarted or
re-scheduled query continues where it stopped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.effects import Z_CRIT, effect_aggregates, effect_columns, with_known_keys


def effect_stream(spark: SparkSession, source_dir: str, schema: str, keys: Sequence[str],
                  x: str, y: str, z_crit: float = Z_CRIT, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of coefficient rows per ``keys`` (use output mode update/complete).

    Rows whose key is NULL or NaN are dropped, as in :func:`~stancelab.operators.effects.two_group_effect`.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    agg = with_known_keys(stream, keys).groupBy(*keys).agg(*effect_aggregates(x, y))
    return agg.select(*keys, *effect_columns(z_crit))


_POINTER = "_current"
_FOLDER = "batch-"


def _hadoop(spark: SparkSession, where: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return path(where).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def read_published(spark: SparkSession, sink_path: str) -> DataFrame:
    """The table that was published last; an error before the first one."""
    fs, path = _hadoop(spark, sink_path)
    for name in (_POINTER, f"{_POINTER}.new"):
        if fs.exists(path(f"{sink_path}/{name}")):
            size = fs.getFileStatus(path(f"{sink_path}/{name}")).getLen()
            if size:
                source = fs.open(path(f"{sink_path}/{name}"))
                folder = bytes(source.readNBytes(size)).decode()
                source.close()
                return spark.read.parquet(f"{sink_path}/{folder}")
    raise ValueError(f"nothing has been published in {sink_path}")


def start_effect_stream(spark: SparkSession, source_dir: str, schema: str, keys: Sequence[str], x: str, y: str,
                        checkpoint_location: str, sink_path: str, available_now: bool = False) -> StreamingQuery:
    """Run :func:`effect_stream` and publish the full coefficient table under ``sink_path`` after each
    micro-batch; :func:`read_published` reads it.  Both paths must be on shared storage.

    A table is a numbered folder of its own, and the pointer is moved to it when it is whole, so a
    reader always finds one, also after a crash; a repeated batch writes its own folder again.  The
    folder before the current one stays for readers that have just opened it, older ones go.
    """
    frame = effect_stream(spark, source_dir, schema, keys, x, y)

    def publish(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_path}/{_FOLDER}{epoch:012d}")
        fs, path = _hadoop(spark, sink_path)
        out = fs.create(path(f"{sink_path}/{_POINTER}.new"), True)
        out.writeBytes(f"{_FOLDER}{epoch:012d}")
        out.close()
        # the old pointer goes only when the new one is whole; readers fall back on the new one
        fs.delete(path(f"{sink_path}/{_POINTER}"), False)
        fs.rename(path(f"{sink_path}/{_POINTER}.new"), path(f"{sink_path}/{_POINTER}"))
        for status in fs.listStatus(path(sink_path)):
            name = status.getPath().getName()
            if name.startswith(_FOLDER) and int(name[len(_FOLDER):]) < epoch - 1:
                fs.delete(status.getPath(), True)

    writer = (frame.writeStream.outputMode("complete").option("checkpointLocation", checkpoint_location)
              .foreachBatch(publish))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
