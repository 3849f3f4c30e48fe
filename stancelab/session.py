"""Session helpers: a tuned local session for tests/bench and checkpoint-dir handling."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(app: str = "stancelab", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    Master, heap and shuffle partitions are set for local use only: when ``master`` (or
    $SPARK_MASTER) names a local one, or when nothing else names any - no ``spark-submit``, whose
    options arrive in $PYSPARK_SUBMIT_ARGS or through a running gateway.  On a cluster all three
    are left to the submitter.
    """
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = master or os.environ.get("SPARK_MASTER")
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ or "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "")
    if wanted is None and not submitted:
        wanted = f"local[{cpus}]"
    builder = SparkSession.builder.appName(app)
    if wanted:
        builder = builder.master(wanted)
    if wanted and wanted.startswith("local"):
        builder = (builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
                   .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g")))
    elif shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def broadcast_limit(spark: SparkSession) -> int:
    """The session's broadcast threshold in bytes (<= 0 means never broadcast)."""
    raw = str(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")).strip().lower()
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    raw = raw[:-1] if raw.endswith("b") else raw
    try:
        return int(float(raw[:-1]) * units[raw[-1]]) if raw and raw[-1] in units else int(raw)
    except ValueError:
        return 10 * 1024 * 1024


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A folder set with ``setCheckpointDir`` is honoured too.  When there is neither (local tests
    only) a fresh folder under
    the system temp dir is created and registered.  On a cluster the setting must
    point at shared storage; it is never overridden here.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    already = spark.sparkContext.getCheckpointDir()
    if already:  # set with setCheckpointDir, by the caller or below
        return already
    master = spark.sparkContext.master or ""
    if not master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder when running on a cluster "
                         f"(master {master!r}); a machine-local folder would not survive executor loss")
    folder = tempfile.mkdtemp(prefix="stancelab-ckpt-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder
