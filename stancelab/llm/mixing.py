"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Targets: the mix has ``share`` times the size of all documents; each source gets its share of that
by weight, but at most ``max_epochs`` times its own size.  Sources above are clamped, and what they
cannot take is shared by weight among the others, until none is above.

Taking: a source with target e * size is taken floor(e) whole times, and in a seeded order each
document that still fits into the remainder is taken once more.  What is then still missing goes to
the one document left whose size comes nearest to it, if that helps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .others import packed, unpacked
from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Hash digits that cut a source's seeded order into 65,536 slices, so no task sorts a source.
SLICE_DIGITS = 4


def water_fill(sources: DataFrame, share: float, max_epochs: float, scratch: Scratch) -> DataFrame:
    """sources (source, source_size, weight) -> plus target, by rounds of clamping.

    Only two sums per round reach the driver.  Each round clamps at least one more source; sources
    of size 0 have target 0; a weight that is null or not positive gets nothing.
    """
    total, weights = sources.select(
        F.sum("source_size"), F.sum(F.when(F.col("weight") > 0, F.col("weight")))).first()
    left, open_weight = share * float(total or 0), float(weights or 0)
    level = 0.0
    cap = F.col("source_size") * F.lit(float(max_epochs))
    while open_weight > 0:
        level = left / open_weight
        above = (F.col("weight") > 0) & (F.col("weight") * F.lit(level) > cap)
        taken, clamped = sources.where(above).select(F.sum(cap), F.sum("weight")).first()
        rest = share * float(total or 0) - float(taken or 0)
        rest_weight = float(weights) - float(clamped or 0)
        if rest_weight == open_weight:
            break
        left, open_weight = rest, rest_weight
        if rest_weight <= 0:  # every source is clamped
            level = float("inf")
    fill = F.when(F.col("weight") > 0, F.col("weight") * F.lit(level)).otherwise(F.lit(0.0))
    target = F.when(F.col("weight") > 0, cap).otherwise(F.lit(0.0)) if level == float("inf") else F.least(fill, cap)
    return sources.withColumn("target", target)


def cyclic_weights(sources: DataFrame, cycle: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """Weights by the sources' code-point order, null last, repeating ``cycle``.

    Ranges of sources are numbered side by side; only one row per range is summed up in order.
    """
    scratch = Scratch(sources.sparkSession, "weights")
    key = F.col("source").asc_nulls_last()
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.table(sources.repartitionByRange(parts, key).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    at = F.col("_start") + F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (at % len(cycle) + 1).cast("int"))
    return ranged.join(starts, "_p").withColumn("weight", weight).drop("_p", "_start")


def _rounds(thin: DataFrame, scratch: Scratch) -> DataFrame:
    """(_from, _rounds): per source the stops of its seeded order, each with the gap before and after it.

    A round sums up the documents that are no longer than the gap and stand behind the last stop; the
    first that does not fit any more is the next stop.  A source is done when no document fits.
    What is left of the gap is less than the document at the stop, and all later ones are no longer
    than that: every round but the last takes a document or drops one, and in seeded order the gap
    falls by a factor on the average, so there are some log(gap) rounds.
    """
    todo = scratch.table(thin.where((F.col("size") > 0) & (F.col("_rest") > 0) & (F.col("size") <= F.col("_rest"))).select(
        "_source", F.substring("_key", 1, SLICE_DIGITS).alias("_slice"), "size", "_key", "_nth",
        F.col("_rest").alias("_gap")), "todo")
    slices_before = Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    rows_before = (Window.partitionBy("_source", "_slice").orderBy("_key", "_nth")
                   .rowsBetween(Window.unboundedPreceding, -1))
    done: list[DataFrame] = []
    while True:
        slices = todo.groupBy("_source", "_slice", "_gap").agg(F.sum("size").alias("_n")).withColumn(
            "_at", F.coalesce(F.sum("_n").over(slices_before), F.lit(0)))
        # only the slice in which the gap ends is looked at row by row
        crossed = slices.where("_at <= _gap AND _at + _n > _gap").select(
            F.col("_source").alias("_from"), F.col("_slice").alias("_s"), "_at")
        stops = (todo.join(crossed, F.col("_source").eqNullSafe(F.col("_from")) & (F.col("_slice") == F.col("_s")))
                 .withColumn("_start", F.col("_at") + F.coalesce(F.sum("size").over(rows_before), F.lit(0)))
                 .where("_start + size > _gap").groupBy("_from")
                 .agg(F.min(F.struct("_key", "_nth", "_start")).alias("_stop")))
        ends = slices.groupBy("_source", "_gap").agg(F.sum("_n").alias("_all"))
        stopped = scratch.table(
            ends.join(stops, F.col("_source").eqNullSafe(F.col("_from")), "left").select(
                F.col("_source").alias("_from"), F.lit(len(done)).alias("_round"), "_gap",
                F.col("_stop._key").alias("_stop_key"), F.col("_stop._nth").alias("_stop_nth"),
                (F.col("_gap") - F.coalesce(F.col("_stop._start"), F.col("_all"))).alias("_left")), "stops")
        done.append(stopped)
        behind = (F.col("_key") > F.col("_stop_key")) | (
            (F.col("_key") == F.col("_stop_key")) & (F.col("_nth") > F.col("_stop_nth")))
        later = scratch.table(
            todo.join(stopped.drop("_gap"), F.col("_source").eqNullSafe(F.col("_from")))
            .where(behind & (F.col("size") <= F.col("_left")))
            .select("_source", "_slice", "size", "_key", "_nth", F.col("_left").alias("_gap")), "todo")
        scratch.drop(todo)
        todo = later
        if todo.isEmpty():
            break
    return reduce(DataFrame.unionByName, done).groupBy("_from").agg(F.sort_array(F.collect_list(
        F.struct("_round", "_gap", "_stop_key", "_stop_nth", "_left"))).alias("_rounds"))


def mix_sources(docs: DataFrame, weights=cyclic_weights, share: float = 1.5, max_epochs: float = 2.0,
                seed: str = "mix") -> DataFrame:
    """``docs`` plus size, source_size, target (double), times (long) and taken (long).

    weights: sources (source, source_size) -> plus weight.  size: words ``[^\x20\x09-\x0D]+`` of
    the text (null: 0).  times: how often the mix takes the document, 0 up to max_epochs rounded
    up; taken = times * size.  A null source is a source; one source may hold any part of the
    rows.  Order: md5 of seed, doc_id and the text's md5 (null: empty), so reruns agree; rows equal
    in both are interchangeable.  Empty documents are taken while there is room.  In each
    source, each document that still fits is taken in that order, last the one that comes nearest.
    Columns of ``docs`` named like a result are replaced.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    base = packed(docs, "doc_id", "source", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text)))
    sized = base.withColumn("size", F.regexp_count(text, F.lit(WORD)).cast("long")).withColumn("_key", key)
    # the plan of the mix needs sources, sizes and keys alone
    narrow = scratch.table(sized.select("source", "size", "_key"), "sizes")
    sources = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = scratch.table(water_fill(scratch.table(weights(sources), "sources"), share, max_epochs, scratch)
                            .select(F.col("source").alias("_source"), "source_size", "target"), "targets")

    def wanted(rows: DataFrame) -> DataFrame:
        """Rows with what is wanted of their source."""
        at = rows.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        return at.withColumns({"_whole": whole, "_rest": F.col("target") - whole * F.col("source_size")})

    def numbered(rows: DataFrame) -> DataFrame:
        """Rows with their number among those of their source and key."""
        return rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_source", "_key").orderBy("_key")))

    def before_stop(r: Column) -> Column:
        return r["_stop_key"].isNull() | (F.col("_key") < r["_stop_key"]) | (
            (F.col("_key") == r["_stop_key"]) & (F.col("_nth") < r["_stop_nth"]))

    thin = scratch.table(numbered(wanted(narrow)), "numbered")
    rounds = scratch.table(_rounds(thin, scratch), "rounds")
    # the gap of the round in which a document's turn comes; null: behind the last stop
    gap = F.get(F.filter("_rounds", before_stop), F.lit(0))["_gap"]
    fits = F.coalesce(F.col("size") <= gap, F.lit(False))
    taken = (F.col("_rest") > 0) & ((F.col("size") == 0) | fits)
    left = F.coalesce(F.element_at("_rounds", -1)["_left"], F.col("_rest"))
    miss = F.abs(left - F.col("size"))
    by_source = F.col("_source").eqNullSafe(F.col("_from"))
    picks = scratch.table(
        thin.join(rounds, by_source, "left").where(~taken & (F.col("_rest") > 0) & (miss < left))
        .groupBy(F.col("_source").alias("_of")).agg(F.min(F.struct(miss.alias("m"), "_key", "_nth")).alias("_pick"))
        .select("_of", F.col("_pick._key").alias("_pick_key"), F.col("_pick._nth").alias("_pick_nth")), "picks")
    extra = taken | F.coalesce(
        (F.col("_key") == F.col("_pick_key")) & (F.col("_nth") == F.col("_pick_nth")), F.lit(False))
    # a number decides only between rows of one key, and only at a stop or a pick: whole texts are
    # shuffled for those alone
    turns = rounds.select("_from", F.explode("_rounds._stop_key").alias("_turn")).union(
        picks.select("_of", "_pick_key")).where("_turn IS NOT NULL").distinct()
    at_turn = F.col("_source").eqNullSafe(F.col("_from")) & (F.col("_key") == F.col("_turn"))
    several = scratch.table(turns.join(thin.where("_nth = 2"), at_turn, "left_semi"), "several")
    rows = wanted(sized)
    if several.isEmpty():
        rows = rows.withColumn("_nth", F.lit(1))
    else:
        rows = rows.join(several, at_turn, "left_anti").withColumn("_nth", F.lit(1)).unionByName(
            numbered(rows.join(several, at_turn, "left_semi")))
    done = (rows.join(rounds, by_source, "left").join(picks, F.col("_source").eqNullSafe(F.col("_of")), "left")
            .withColumn("times", (F.col("_whole") + F.when(extra, 1).otherwise(0)).cast("long"))
            .withColumn("taken", F.col("times") * F.col("size")))
    kept = done.select(*base.columns, "size", "source_size", "target", "times", "taken")
    return unpacked(kept, docs.columns, "size", "source_size", "target", "times", "taken")


def repeat_documents(mixed: DataFrame) -> DataFrame:
    """Each row of ``mix_sources`` as often as it is taken."""
    one = packed(mixed, "times").where("times > 0")
    copies = F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("_copy")
    return unpacked(one.select(*one.columns, copies).drop("_copy"), mixed.columns)
