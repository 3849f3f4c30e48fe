"""Embedding archives, slice manifests and positional text joins.

An archive is a table ``(archive_file, row_no, embedding)``; a slice is a
contiguous row range ``[archive_offset, archive_offset + n)`` of one archive,
named by ``(prompt_no, connector, sentiment)``.

All slices are read in ONE range join.  The range is turned into an equi-join
on ``(archive_file, row_no div B)``: each manifest row is exploded into the
buckets its range touches, so the join spreads over many keys (no broadcast is
required and no archive file lands in a single task), and the range predicate
only filters within a bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..landing import Landing
from .ordering import MOST_ROWS, prefix_sum, row_index

SLICE_KEYS = ("prompt_no", "connector", "sentiment")
RANGE_BUCKET = 4096


def slice_manifest(archive: DataFrame, keys: Sequence[str] = SLICE_KEYS, dimension: Column | None = None) -> DataFrame:
    """Manifest of the slices stored in an archive.

    n and dimensions come from one aggregate; ``dimension`` is for archives that are listed without
    their vectors (default: the size of ``embedding``); ``archive_offset`` is the slice's
    first row; ``global_offset`` is the running total of n over
    (archive_file, archive_offset) - a blocked prefix sum, not a global window.
    """
    keys = list(keys)
    # only the dimension of a vector is wanted: whole vectors go no further than the scan
    m = archive.select(*keys, "archive_file", "row_no", (F.size("embedding") if dimension is None else dimension).alias("_dim")).groupBy(
        *keys, "archive_file").agg(
        F.min("row_no").cast("long").alias("archive_offset"),
        F.count(F.lit(1)).cast("long").alias("n"),
        F.max("_dim").cast("int").alias("dimensions"))
    return prefix_sum(m, F.col("n"), ["archive_file", "archive_offset"], "global_offset",
                      block=F.col("archive_file"), most=MOST_ROWS)


def read_slices(archive: DataFrame, manifest: DataFrame, keys: Sequence[str] = SLICE_KEYS,
                bucket: int = RANGE_BUCKET) -> DataFrame:
    """Every vector of every manifest slice with its position in the slice.

    A manifest without ``archive_file`` belongs to one archive: ``offset`` is then where a slice
    begins, and the rows' own ``archive_file``, if any, is not asked.  A slice that the archive does
    not have gives no rows here; :func:`read_slice` raises, :func:`manifest_integrity` reports it.
    """
    keys = list(keys)
    if "archive_file" not in manifest.columns:
        manifest = manifest.withColumn("archive_file", F.lit("")).withColumn("archive_offset", F.col("offset"))
        archive = archive.withColumn("archive_file", F.lit(""))
    m = manifest.select(*keys, "archive_file", "archive_offset", "n").where(F.col("n") > 0)
    first_b = F.floor(F.col("archive_offset") / bucket).cast("long")
    last_b = F.floor((F.col("archive_offset") + F.col("n") - 1) / bucket).cast("long")
    m = m.select("*", F.explode(F.sequence(first_b, last_b)).alias("_bucket"))
    a = archive.drop(*[k for k in keys if k in archive.columns]).withColumn(
        "_bucket", F.floor(F.col("row_no") / bucket).cast("long"))
    j = a.join(m, ["archive_file", "_bucket"]).where(
        (F.col("row_no") >= F.col("archive_offset")) & (F.col("row_no") < F.col("archive_offset") + F.col("n")))
    return j.select(*keys, (F.col("row_no") - F.col("archive_offset")).alias("position"),
                    *[c for c in a.columns if c not in ("archive_file", "row_no", "_bucket")],
                    "archive_file", "row_no")


def _named(df: DataFrame, which: Mapping[str, object]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in which.items()]))


def read_slice(archive: DataFrame, manifest: DataFrame, which: Mapping[str, object]) -> DataFrame:
    """The vectors of one slice, e.g. ``{"prompt_no": 3, "connector": 1, "sentiment": "pos"}``.

    The first manifest row counts where a slice is listed twice; a slice that is not listed is an error.
    """
    own = _named(manifest, which)
    at = "archive_offset" if "archive_file" in manifest.columns else "offset"
    first = own.orderBy(*[c for c in ("archive_file", at) if c in own.columns]).limit(1)
    if not first.count():
        raise ValueError("No embedding slice for " + ", ".join(f"{k}={v!r}" for k, v in which.items()))
    return read_slices(archive, first, list(which))


def read_slice_texts(texts: DataFrame, which: Mapping[str, object], order: str = "justification_no") -> DataFrame:
    """The texts of one slice by position; a slice without any is an error."""
    own = _named(texts, which)
    if not own.limit(1).count():
        raise ValueError("No justification texts for " + ", ".join(f"{k}={v!r}" for k, v in which.items()))
    return texts_by_position(own, list(which), order)


def texts_by_position(texts: DataFrame, keys: Sequence[str] = SLICE_KEYS, order: str = "justification_no") -> DataFrame:
    """Texts of each slice numbered 0, 1, ... by ``order`` (NULL text becomes '')."""
    keys = list(keys)
    block = F.struct(*[F.col(k) for k in keys], F.floor(F.col(order) / 65536))
    out = row_index(texts, [order], "position", partition=keys, block=block, most=MOST_ROWS)
    return out.withColumn("justification", F.coalesce(F.col("justification"), F.lit("")))


def pair_texts(vectors: DataFrame, texts: DataFrame, keys: Sequence[str] = SLICE_KEYS) -> DataFrame:
    """I-th vector with i-th text of the same slice.  Extra texts drop out (they are cut off);
    a vector without a text stays, with a NULL text and ``missing_text`` true."""
    told = texts.withColumn("_told", F.lit(True))
    return (vectors.join(told, [*keys, "position"], "left")
            .withColumn("missing_text", F.col("_told").isNull()).drop("_told"))


def store_by_position(df: DataFrame, table: str, path: str, buckets: int, keys: Sequence[str] = SLICE_KEYS) -> DataFrame:
    """Land rows as the table ``table`` under ``path``, bucketed and sorted by slice and position.

    Vectors and texts stored with the same number of buckets are paired by :func:`pair_texts` without
    a shuffle, as often as they are read.  A slice's rows lie in all buckets, so a large one is as
    spread as any.  ``path`` must be shared storage; the rows are shuffled once, here.
    """
    by = [*keys, "position"]
    (df.repartition(buckets, *by).sortWithinPartitions(*by).write.mode("overwrite").format("parquet")
     .bucketBy(buckets, by[0], *by[1:]).sortBy(by[0], *by[1:]).option("path", path).saveAsTable(table))
    return df.sparkSession.table(table)


def manifest_integrity(manifest: DataFrame, texts: DataFrame, keys: Sequence[str] = SLICE_KEYS,
                       vectors: DataFrame | None = None) -> DataFrame:
    """Q6: per slice - text count vs vector count and contiguity inside its archive.

    With ``vectors`` (the rows of :func:`read_slices`) ``n_read`` says how many of a slice's
    vectors the archive really has; fewer than promised is ``missing_slice`` or ``short_slice``.

    Contiguity is an equi-join of each slice's end to the next slice's start, so
    no window is needed: ``contiguous`` is false when nothing starts where the
    slice ends, unless the slice is the last of its file.
    """
    keys = list(keys)
    # one row a slice, used five times: computed once
    manifest = Landing(manifest.sparkSession, "manifest").table(manifest, "manifest")
    tc = texts.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("n_texts"))
    ends = manifest.select(*keys, "archive_file", "archive_offset", "n",
                           (F.col("archive_offset") + F.col("n")).alias("_end"))
    starts = (manifest.select("archive_file", F.col("archive_offset").alias("_end")).dropDuplicates()
              .withColumn("_has_next", F.lit(True)))
    file_end = manifest.groupBy("archive_file").agg(F.max(F.col("archive_offset") + F.col("n")).alias("_file_end"))
    dup = manifest.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    j = (ends.join(starts, ["archive_file", "_end"], "left").join(file_end, "archive_file")
         .join(dup, keys).join(tc, keys, "left"))
    n_texts = F.coalesce(F.col("n_texts"), F.lit(0)).cast("long")
    n_read = F.col("n")
    if vectors is not None:
        found = vectors.groupBy(*keys, "archive_file").agg(F.count(F.lit(1)).cast("long").alias("_read"))
        j = j.join(found, [*keys, "archive_file"], "left")
        n_read = F.coalesce(F.col("_read"), F.lit(0)).cast("long")
    contiguous = F.coalesce(F.col("_has_next"), F.lit(False)) | (F.col("_end") == F.col("_file_end"))
    status = (F.when(F.col("_copies") > 1, "duplicate_slice")
              .when((n_read == 0) & (F.col("n") > 0), "missing_slice")
              .when(n_read < F.col("n"), "short_slice")
              .when(~contiguous, "gap_after")
              .when(n_texts < F.col("n"), "fewer_texts")
              .when(n_texts > F.col("n"), "more_texts")
              .otherwise("ok"))
    return j.select(*keys, "archive_file", "archive_offset", F.col("n").alias("n_vectors"),
                    *([n_read.alias("n_read")] if vectors is not None else []), n_texts.alias("n_texts"), contiguous.alias("contiguous"), status.alias("status"))
