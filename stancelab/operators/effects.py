"""Two-group effect per wording (A1, A2) with CI bounds and direction labels.

The estimate is mean(y | x=1) - mean(y | x=0) with the unequal-variance standard
error sqrt(var1/n1 + var0/n0) (sample variances).  It is computed as ONE
``groupBy().agg`` of conditional count/avg/var_samp aggregates: every aggregate
is mergeable, so Spark does a map-side partial aggregation and shuffles only
one partial row per group and map task - a hot group holding a third of all
rows costs no more shuffle than a cold one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_double, col
from ..functions.lists import list_item, split_list
from ..landing import Landing
from ..session import broadcast_limit

Z_CRIT = 1.98  # critical value used for the coefficient bounds (not 1.96)

EFFECT_COLUMNS = ("coef", "se", "n", "ci_low", "ci_high", "direction")


def effect_aggregates(x: str | Column, y: str | Column) -> list[Column]:
    """Mergeable sufficient statistics of the two-group effect.

    Rows with NULL/NaN x or y are dropped (pandas ``dropna``).  ``_n_other`` counts
    kept rows whose x is neither 0 nor 1: any such row makes the effect undefined.
    """
    xv = clean_double(x)
    yv = clean_double(y)
    keep = xv.isNotNull() & yv.isNotNull()
    y1 = F.when(keep & (xv == 1.0), yv)
    y0 = F.when(keep & (xv == 0.0), yv)
    return [
        F.count(y1).alias("_n1"),
        F.avg(y1).alias("_mean1"),
        F.var_samp(y1).alias("_var1"),
        F.count(y0).alias("_n0"),
        F.avg(y0).alias("_mean0"),
        F.var_samp(y0).alias("_var0"),
        F.count_if(keep & (xv != 1.0) & (xv != 0.0)).alias("_n_other"),
        F.count_if(keep).alias("n"),
    ]


def effect_columns(z_crit: float = Z_CRIT) -> list[Column]:
    """coef, se, n, ci_low, ci_high, direction from the ``effect_aggregates`` columns.

    Undefined values stay NULL (never NaN): NaN compares greater than every number
    in Spark and would turn an undefined bound into a ``liberal`` label.
    """
    defined = (F.col("_n1") > 0) & (F.col("_n0") > 0) & (F.col("_n_other") == 0)
    coef = F.when(defined, F.col("_mean1") - F.col("_mean0"))
    se = F.when(defined, F.sqrt(F.col("_var1") / F.col("_n1") + F.col("_var0") / F.col("_n0")))
    ci_low = coef - F.lit(z_crit) * se
    ci_high = coef + F.lit(z_crit) * se
    return [
        coef.alias("coef"),
        se.alias("se"),
        F.col("n").cast("long").alias("n"),
        ci_low.alias("ci_low"),
        ci_high.alias("ci_high"),
        direction(ci_low, ci_high).alias("direction"),
    ]


def direction(ci_low: Column, ci_high: Column) -> Column:
    """liberal when the interval is above 0, conservative when below, else no_effect."""
    return (F.when(ci_low > 0, F.lit("liberal"))
            .when(ci_high < 0, F.lit("conservative"))
            .otherwise(F.lit("no_effect")))


def two_group_effect(df: DataFrame, keys: Sequence[str], x: str | Column, y: str | Column,
                     first_attrs: Sequence[str] = (), first_by: Sequence[str] = (),
                     z_crit: float = Z_CRIT) -> DataFrame:
    """Effect of x (0/1) on y per group of ``keys``.

    ``first_attrs`` are taken from the group's first row in ``first_by`` order
    (deterministic when ``first_by`` is a total order, unlike ``first()``).  Rows
    whose group key is NULL or NaN are dropped, as pandas ``groupby`` does.

    Plan: one hash aggregate on either side of one shuffle of partial rows.  The first row is found
    in it as the least value of a fixed-width key (:func:`packed_order`).  The groups are then
    written once, and their attributes fetched from the input by a join with (keys, packed key),
    broadcast after its size has been checked: no row of the input is shuffled for them.  Where the
    order cannot be packed or the groups are too many to broadcast, the first row is a ``min_by``
    over a struct, which Spark aggregates by a local sort of each task's rows.  When the attribute
    is the order column itself it is a plain ``min``.
    """
    keys = list(keys)
    kept = with_known_keys(df, keys)
    aggs = effect_aggregates(x, y)
    if not first_attrs:
        return kept.groupBy(*keys).agg(*aggs).select(*keys, *effect_columns(z_crit))
    if not first_by:
        raise ValueError("first_attrs needs a first_by order")
    if len(first_by) == 1 and set(first_attrs) == {first_by[0]}:
        grouped = kept.groupBy(*keys).agg(*aggs, F.min(first_by[0]).alias("_first_" + first_by[0]))
        return grouped.select(*keys, F.col("_first_" + first_by[0]).alias(first_by[0]), *effect_columns(z_crit))
    least = F.min_by(F.struct(*[col(a) for a in first_attrs]), F.struct(*[col(c) for c in first_by])).alias("_first")
    attrs = [F.col("_first").getField(a).alias(a) for a in first_attrs]
    packed = packed_order(df, first_by)
    if packed is not None:
        groups = Landing(df.sparkSession, "effects").table(grouped_effects(kept, keys, aggs, packed), "groups")
        wanted = groups.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_least")
        if _bytes_of(wanted) <= broadcast_limit(df.sparkSession):
            same = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
            firsts = (kept.withColumn("_packed", packed)
                      .join(F.broadcast(wanted), [*same, F.col("_packed") == F.col("_least")])
                      .groupBy(*keys).agg(least))  # a row a group, more where the packed part of the order ties
            return groups.join(firsts, keys).select(*keys, *attrs, *effect_columns(z_crit))
    return kept.groupBy(*keys).agg(*aggs, least).select(*keys, *attrs, *effect_columns(z_crit))


def with_known_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows without a NULL or NaN among ``keys``."""
    real = {k for k in keys if dict(df.dtypes)[k] in ("double", "float")}
    known = [F.col(k).isNotNull() & (~F.isnan(k) if k in real else F.lit(True)) for k in keys]
    return df.where(reduce(lambda a, b: a & b, known, F.lit(True)))


def grouped_effects(kept: DataFrame, keys: Sequence[str], aggs: Sequence[Column], packed: Column) -> DataFrame:
    """The effect statistics of each group and ``_least``, its least packed order; hash-aggregated."""
    return kept.groupBy(*keys).agg(*aggs, F.min(packed).alias("_least"))


#: Bits of the types that can be packed.
PACKED_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64, "boolean": 1, "date": 32}


def packed_order(df: DataFrame, order: Sequence[str]) -> Column | None:
    """One decimal that sorts as the leading columns of ``order`` do, NULL first.

    As many whole-number, boolean or date columns as 38 digits hold; None if the first is of
    another type.  A decimal has a fixed width, so its least value is kept in a hash map.
    """
    types = dict(df.dtypes)
    packed, room = None, 10**38
    for c in order:
        bits = PACKED_BITS.get(types.get(c))
        if bits is None or room // ((1 << bits) + 1) == 0:
            break
        room //= (1 << bits) + 1
        number = F.datediff(c, F.lit("1970-01-01")) if types[c] == "date" else F.col(c)
        number = number.cast("int").cast("decimal(38,0)") if types[c] == "boolean" else number.cast("decimal(38,0)")
        low = 0 if types[c] == "boolean" else -(1 << (bits - 1))
        place = F.coalesce(number - F.lit(str(low - 1)).cast("decimal(38,0)"), F.lit("0").cast("decimal(38,0)"))
        place = place.cast("decimal(38,0)")
        packed = place if packed is None else (
            packed * F.lit(str((1 << bits) + 1)).cast("decimal(20,0)")).cast("decimal(38,0)") + place
        packed = packed.cast("decimal(38,0)")
    return packed


def _bytes_of(table: DataFrame) -> int:
    """Size of a written table's rows in memory, from one small aggregate over it."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in table.dtypes if t in ("string", "binary")]
    shape = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(reduce(lambda a, b: a + b, texts, F.lit(0))), F.lit(0)).alias("text")).first()
    return shape["n"] * 16 * (len(table.columns) + 1) + shape["text"]


def axis_labels(labels: str | Column) -> list[Column]:
    """label_1 / label_2 from a comma list of anchors (only the first two form the axis)."""
    items = split_list(labels)
    return [list_item(items, 0).alias("label_1"), list_item(items, 1).alias("label_2")]


def coefficient_table(responses: DataFrame, z_crit: float = Z_CRIT) -> DataFrame:
    """Study coefficient table: named primes, one row per (issue_no_key, question_no).

    Attributes come from the first response of the group by (prompt_no, completion_no).
    """
    named = responses.where(F.col("named_prime") == 1)
    eff = two_group_effect(
        named, ["issue_no_key", "question_no"], "liberal", "proj",
        first_attrs=["issue_no", "keyword", "ending", "end_type", "labels"],
        first_by=["prompt_no", "completion_no"], z_crit=z_crit)
    return eff.select("issue_no_key", "question_no", "issue_no", "keyword", "ending", "end_type",
                      *axis_labels("labels"), *EFFECT_COLUMNS)


def assign_topic(df: DataFrame, topics: dict[str, Sequence[int]] | DataFrame,
                 key: str = "issue_no", name: str = "topic_group") -> DataFrame:
    """Attach a topic group to each row whose ``key`` is listed (semi-join semantics).

    A fixed mapping becomes a literal map lookup, so no join is planned at all; a
    topics DataFrame is joined without a hint (AQE broadcasts it only if small).
    """
    if isinstance(topics, DataFrame):
        return df.join(topics, on=key, how="inner")
    pairs = [(k, g) for g, ks in topics.items() for k in ks]
    lookup = F.create_map(*[F.lit(v) for k, g in pairs for v in (k, g)])
    return df.withColumn(name, F.element_at(lookup, F.col(key)) if pairs else F.lit(None)) \
             .where(F.col(name).isNotNull())
