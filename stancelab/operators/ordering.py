"""Order-dependent numbering without single-task windows.

A window with ``orderBy`` and no ``partitionBy`` moves every row into one task.
``prefix_sum`` instead cuts the order into blocks (a key that is monotone in the
order, e.g. ``id div 65536``):

1. block totals: one partial/final aggregate;
2. block offsets: a running sum over the block table only (#rows / block width),
   itself split into super-blocks when the block key is integral;
3. within-block running sums: a window partitioned by block, so one task holds
   at most one block;
4. offsets joined back on the block key, NULL equal to NULL.

Every step is a plain DataFrame operation and the result is exact.

A block key is only as good as the ids it is cut from: repeated, null or non-numeric ones may all
lie in one block.  Without a block key of the caller's own, or with ``most``, the largest block is
looked at first, and if it is too large the rows are cut by sampled ranges instead
(``ranged_sum``): over partition, order and a tie-breaker, so that any number of equal rows are cut
too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..landing import Landing

DEFAULT_BLOCK_WIDTH = 1 << 16
#: Rows of a block beyond which the rows are cut by ranges.
MOST_ROWS = 4 * DEFAULT_BLOCK_WIDTH
#: Distinct values that may be broadcast: strings of some 100 bytes, about 10 MB.
BROADCAST_VALUES = 100_000


def default_block(order_col: str | Column, width: int = DEFAULT_BLOCK_WIDTH) -> Column:
    """Block key for a numeric leading order column."""
    return F.floor(col(order_col).cast("double") / F.lit(float(width))).cast("long")


def _match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` in which NULL equals NULL, as it does in a window's partitions."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    # plain equality where no NULL can be: the join then keeps the window's partitioning
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) if left.schema[k].nullable else F.col(k) == F.col(f"_r_{k}")
          for k in keys]
    return left.join(renamed, on).drop(*[f"_r_{k}" for k in keys])


def _block_offsets(totals: DataFrame, part: list[str], fanout: int) -> DataFrame:
    """Exclusive running sum of ``_blk_total`` over ``_blk`` within ``part``.

    An integral block key is grouped once more into super-blocks of ``fanout``
    blocks, so no window ever sorts more than ``fanout`` blocks or the (N / width /
    fanout)-row super-block table.
    """
    before = Window.unboundedPreceding
    if dict(totals.dtypes)["_blk"] not in ("bigint", "int", "smallint", "tinyint"):
        w = Window.partitionBy(*part).orderBy("_blk").rowsBetween(before, -1)
        return totals.select(*part, "_blk", F.coalesce(F.sum("_blk_total").over(w), F.lit(0)).alias("_blk_off"))
    t = totals.withColumn("_sup", F.floor(F.col("_blk") / F.lit(fanout)).cast("long"))
    sup = t.groupBy(*part, "_sup").agg(F.sum("_blk_total").alias("_sup_total"))
    w_sup = Window.partitionBy(*part).orderBy("_sup").rowsBetween(before, -1)
    sup = sup.select(*part, "_sup", F.coalesce(F.sum("_sup_total").over(w_sup), F.lit(0)).alias("_sup_off"))
    w_in = Window.partitionBy(*part, "_sup").orderBy("_blk").rowsBetween(before, -1)
    inner = t.select(*part, "_sup", "_blk", F.coalesce(F.sum("_blk_total").over(w_in), F.lit(0)).alias("_in_sup"))
    return _match(inner, sup, [*part, "_sup"]).select(
        *part, "_blk", (F.col("_sup_off") + F.col("_in_sup")).alias("_blk_off"))


def prefix_sum(df: DataFrame, value: str | Column, order: Sequence[str], name: str,
               partition: Sequence[str] = (), block: Column | None = None,
               inclusive: bool = False, fanout: int = 4096, most: int | None = None) -> DataFrame:
    """Add ``name`` = sum of ``value`` over the rows before (or up to) each row in ``order``
    within ``partition``.

    ``order`` should be a total order inside the partition; rows that tie in it are numbered one
    after the other, in no order of their own.  ``most``: rows that the caller's ``block`` may hold
    before ranges are cut instead; without a block the default key is always looked at.
    """
    part = list(partition)
    order = list(order)
    v = col(value).cast("long") if isinstance(value, str) else value
    if block is None:
        numeric = dict(df.dtypes)[order[0]].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
        block, most = (default_block(order[0]) if numeric else F.lit(0)), most or MOST_ROWS
    if most is not None:
        sizes = df.groupBy(*part, block.alias("_blk")).count()
        if (sizes.agg(F.max("count")).first()[0] or 0) > most:
            return ranged_sum(df, v, order, name, part, inclusive, most)
    blk = block
    staged = df.withColumn("_blk", blk).withColumn("_val", v)
    totals = staged.groupBy(*part, "_blk").agg(F.sum("_val").alias("_blk_total"))
    offsets = _block_offsets(totals, part, fanout)
    upto = 0 if inclusive else -1
    w_rows = Window.partitionBy(*part, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    inner = staged.withColumn("_in_blk", F.coalesce(F.sum("_val").over(w_rows), F.lit(0)))
    return (_match(inner, offsets, [*part, "_blk"])
            .withColumn(name, F.col("_blk_off") + F.col("_in_blk"))
            .drop("_blk", "_val", "_blk_off", "_in_blk"))


def ranged_sum(df: DataFrame, value: Column, order: Sequence[str], name: str, partition: Sequence[str] = (),
               inclusive: bool = False, rows: int = MOST_ROWS) -> DataFrame:
    """``prefix_sum`` for any keys: ranges of about ``rows`` rows, cut by a sample, are the blocks.

    The ranged rows are written once, as another run of the sample would cut them elsewhere.  A
    range has one total per partition key in it, so the running sum over totals sorts at most as
    many rows as there are ranges for one key.
    """
    part, order = list(partition), list(order)
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    staged = df.withColumns({"_val": value, "_tie": F.monotonically_increasing_id()})
    ranged = Landing(df.sparkSession, "ranges").table(
        staged.repartitionByRange(n, *part, *order, "_tie").withColumn("_blk", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(*part, "_blk").agg(F.sum("_val").alias("_total"))
    before = Window.partitionBy(*part).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*part, "_blk", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_off"))
    if totals.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES:
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy("_blk", *part).orderBy(*order, "_tie").rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    # a range to a task: dealt by hash, some tasks would get several
    summed = ranged.repartitionByRange(n, "_blk").withColumn("_in", F.coalesce(F.sum("_val").over(inside), F.lit(0)))
    return (_match(summed, offsets, [*part, "_blk"]).withColumn(name, F.col("_off") + F.col("_in"))
            .drop("_blk", "_val", "_tie", "_off", "_in"))


def row_index(df: DataFrame, order: Sequence[str], name: str = "row_no",
              partition: Sequence[str] = (), block: Column | None = None, fanout: int = 4096,
              most: int | None = None) -> DataFrame:
    """0-based position of each row in ``order`` within ``partition`` (row_number() - 1)."""
    return prefix_sum(df, F.lit(1).cast("long"), order, name, partition, block, fanout=fanout, most=most)


def first_k(df: DataFrame, k: int, order: Sequence[str], partition: Sequence[str],
            name: str = "rank_in_group") -> DataFrame:
    """The first ``k`` rows of every group in ``order`` (W2), with their 0-based rank.

    A plain ``row_number() <= k``: Spark keeps k rows per group and task before the shuffle
    (window group limit), so a group's size does not matter.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(name, (F.row_number().over(w) - 1).cast("long")).where(F.col(name) < k)


def first_seen_rank(df: DataFrame, value: str, order: str, name: str = "first_seen_rank",
                    block: Column | None = None) -> DataFrame:
    """1, 2, 3... by first appearance of each value in ``order``; NULL and '' share a rank.

    The distinct values (one row each, after a partial/final ``min``) are numbered, then joined
    back to every row.  They are broadcast if a count shows at most ``BROADCAST_VALUES`` of them;
    with more values than that no single one need be hot, and the join is shuffled.
    """
    key = F.coalesce(F.col(value).cast("string"), F.lit(""))
    keyed = df.withColumn("_rank_key", key)
    firsts = keyed.groupBy("_rank_key").agg(F.min(order).alias("_first"))
    numbered = row_index(firsts, ["_first"], "_r", block=block)
    ranks = numbered.select("_rank_key", (F.col("_r") + 1).alias(name))
    if firsts.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES:
        ranks = F.broadcast(ranks)
    return keyed.join(ranks, "_rank_key").drop("_rank_key")
