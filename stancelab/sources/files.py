"""File sources and sinks.

CSV is only an interchange format here: banks and raw response dumps are read
once with explicit options and landed as Parquet, which every later plan reads
with column pruning and filter pushdown.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prompts import normalise_bank

BANK_INT_COLUMNS = ("issue_no", "topic_no", "reverse_code")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True,
             **options: str) -> DataFrame:
    """Header CSV where quoted fields may hold commas, doubled quotes and newlines.

    ``multi_line`` keeps quoted newlines inside one record, at the price of one task per file;
    turn it off for large files whose fields hold none, which are then split.  ``escape='"'``
    reads ``""`` as a literal quote; a UTF-8 byte-order mark is dropped by the reader.  Without
    ``schema`` every column is a string (no inference pass).
    """
    reader = (spark.read.option("header", True).option("multiLine", multi_line)
              .option("escape", '"').option("quote", '"').option("encoding", "UTF-8"))
    for k, v in options.items():
        reader = reader.option(k, v)
    if schema:
        reader = reader.schema(schema)
    return reader.csv(path)


def read_prompt_bank(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """A prompt bank CSV as a normalised table (P1-P4): list cells cleaned, the integer
    columns typed (``try_cast``: a malformed cell becomes NULL), optional columns added."""
    raw = read_csv(spark, path)
    bank = normalise_bank(raw, dataset)
    for c in BANK_INT_COLUMNS:
        if c in bank.columns:
            bank = bank.withColumn(c, F.col(c).try_cast("int"))
    return bank


def land_csv(spark: SparkSession, src: str, dest: str, schema: str | None = None, force: bool = False,
             partitions: int | None = None, partition_by: Sequence[str] = (), multi_line: bool = True) -> DataFrame:
    """Read a (possibly gzip-compressed) CSV once and land it as Parquet.

    A gzip or multi-line file is one input split, so the rows are spread before the write, by
    default over the session's parallelism; ``force=False`` keeps an existing landing (mode
    ``ignore``).
    """
    df = read_csv(spark, src, schema, multi_line)
    if partition_by:
        df = df.repartition(*partition_by) if partitions is None else df.repartition(partitions, *partition_by)
    else:
        df = df.repartition(partitions or spark.sparkContext.defaultParallelism)
    writer = df.write.mode("overwrite" if force else "ignore")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(dest)
    return spark.read.parquet(dest)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Overwrite a table; CSV gets a header and prints NULL as empty.
    ``partition_by`` writes one directory per value (one table per topic group)."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "").option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def summary_row(spark: SparkSession, counts: Mapping[str, object]) -> DataFrame:
    """A one-row summary with keys in sorted order."""
    keys = sorted(counts)
    return spark.createDataFrame([tuple(counts[k] for k in keys)], keys)


def write_summary(df: DataFrame, path: str) -> None:
    """Write a (one-row) summary DataFrame as JSON with sorted columns."""
    df.select(*sorted(df.columns)).coalesce(1).write.mode("overwrite").json(path)


# Vector files are named {sentiment}_embed_{prompt_no}_{connector}_2_fin.* and their
# texts {sentiment}_lst_{prompt_no}_1.* (the text name always ends in _1).
VECTOR_FILE_PATTERN = r"^(pos|neg)_embed_(\d+)_(\d+)_2_fin\.[A-Za-z0-9.]+$"


def file_footers(spark: SparkSession, vectors_path: str) -> DataFrame:
    """(embedding_file, promised, error): the rows that each vector file's footer promises, or why it cannot be read.

    Only paths travel: the executors open each file through Arrow's file systems and read its footer,
    some kilobytes however large the file.  In a store that Arrow does not know, Spark hands over the
    files' contents instead, of files up to its limit of 2 GB.
    """
    listed = spark.read.format("binaryFile").load(vectors_path).where(
        F.regexp_extract("path", r"([^/]+)$", 1).rlike(VECTOR_FILE_PATTERN))
    by_path = _arrow_opens(listed.select("path").limit(1).collect())

    def read_footers(frames):
        import io
        import re

        import pyarrow as pa
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq
        for f in frames:
            promised, errors = [], []
            for at in f.column("at").to_pylist():
                try:
                    if by_path:
                        # Spark writes local paths as file:/path, without escapes
                        store, path = ((pafs.LocalFileSystem(), re.sub("^file:/+", "/", at)) if at.startswith("file:")
                                       else pafs.FileSystem.from_uri(at))
                        source = store.open_input_file(path)
                    else:
                        source = io.BytesIO(at)
                    with source:
                        promised.append(pq.read_metadata(source).num_rows)
                    errors.append(None)
                except (pa.ArrowException, OSError, ValueError) as exc:
                    promised.append(None)
                    errors.append(f"{type(exc).__name__}: {exc}"[:200])
            yield pa.record_batch({"embedding_file": f.column("embedding_file"), "promised": pa.array(promised, pa.int64()),
                                   "error": pa.array(errors, pa.string())})

    return (listed.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("embedding_file"),
                          F.col("path" if by_path else "content").alias("at"))
            .mapInArrow(read_footers, "embedding_file string, promised long, error string"))


def _arrow_opens(paths) -> bool:
    """Whether Arrow has a file system for the store of the first path (true if there is none)."""
    import pyarrow as pa
    import pyarrow.fs as pafs
    try:
        for row in paths:
            if not row["path"].startswith("file:"):
                pafs.FileSystem.from_uri(row["path"])
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def file_inventory(spark: SparkSession, vectors_path: str, texts_path: str | None = None,
                   vector_col: str = "embedding", summary_path: str | None = None) -> DataFrame:
    """One row per vector file: slice keys parsed from the file name, vector count,
    dimension, the matching text file name ('' when that file is absent) and ``error``.

    File names come from the ``_metadata`` column, so no driver-side listing or
    per-file loop is involved; counting is one aggregate over all files.  What a file
    should hold is asked of its own footer, on the executors: a file whose footer cannot be
    read is a row with only ``embedding_file`` and ``error`` (the reader's words), a file that
    gave fewer vectors than its footer promises keeps its count and says so in ``error``, and an
    empty file is a row with ``n`` 0.  When ``vectors_path`` does not exist and
    a saved summary (Parquet) does, the summary is returned instead.
    """
    if not path_exists(spark, vectors_path) and summary_path and path_exists(spark, summary_path):
        return spark.read.parquet(summary_path)
    vec = (spark.read.option("ignoreCorruptFiles", "true").parquet(vectors_path)
           .select(F.col("_metadata.file_name").alias("embedding_file"), F.size(vector_col).alias("_dim")))
    counts = vec.groupBy("embedding_file").agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.max("_dim").cast("int").alias("dimensions"))
    footers = file_footers(spark, vectors_path)
    files = footers.join(counts, "embedding_file", "left")
    short = F.concat(F.lit("read "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" of "),
                     F.col("promised").cast("string"), F.lit(" vectors"))
    bad = files.where("error IS NOT NULL").select("embedding_file", "error")
    inv = files.where("error IS NULL").select(
        "embedding_file", F.coalesce("n", F.lit(0)).alias("n"), "dimensions",
        F.when(F.coalesce("n", F.lit(0)) < F.col("promised"), short).alias("error"))
    parts = [F.regexp_extract("embedding_file", VECTOR_FILE_PATTERN, i) for i in (1, 2, 3)]
    inv = inv.select(parts[1].cast("int").alias("prompt_no"), parts[2].cast("int").alias("connector"),
                     parts[0].alias("sentiment"), "embedding_file", "n", "dimensions", "error")
    stem = F.concat(F.col("sentiment"), F.lit("_lst_"), F.col("prompt_no").cast("string"), F.lit("_1"))
    inv = inv.withColumn("_stem", stem)
    if texts_path is None:
        inv = inv.withColumn("text_file", F.lit("")).drop("_stem")
    else:
        texts = (spark.read.parquet(texts_path).select(F.col("_metadata.file_name").alias("text_file")).distinct()
                 .withColumn("_stem", F.regexp_extract("text_file", r"^(.*?)\.[A-Za-z0-9.]+$", 1)))
        inv = (inv.join(texts, "_stem", "left")
               .withColumn("text_file", F.coalesce("text_file", F.lit(""))).drop("_stem"))
    columns = [c for c in inv.columns if c != "error"] + ["error"]
    return inv.select(*columns).unionByName(bad, allowMissingColumns=True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists: the reader resolves paths when the DataFrame is created."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException:
        return False
    return True


def slice_points_from_files(spark: SparkSession, vectors_path: str, vector_col: str = "embedding") -> DataFrame:
    """The per-slice vector files as clustering input - slice keys parsed from each
    file name and ``position`` = the row's index inside its file (``_metadata.row_index``),
    so the positional text join (J5) works without any driver-side file loop."""
    df = spark.read.parquet(vectors_path).select(
        F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("position"),
        F.col(vector_col).alias("embedding"))
    df = df.where(F.col("_file").rlike(VECTOR_FILE_PATTERN))
    parts = [F.regexp_extract("_file", VECTOR_FILE_PATTERN, i) for i in (1, 2, 3)]
    return df.select(parts[1].cast("int").alias("prompt_no"), parts[2].cast("int").alias("connector"),
                     parts[0].alias("sentiment"), F.col("position").cast("long").alias("position"), "embedding")
