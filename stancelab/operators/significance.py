"""Contingency counts and hypothesis tests (A10, T1, T2, T4, T5 with W3, P18, P19, P23).

Counting is a partial/final aggregate; the tests themselves are per-row Column
expressions (:mod:`stancelab.functions.stats`), so a table of millions of tests
runs as a narrow projection with no Python in the loop.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, safe_div
from ..functions.lists import split_comparison
from ..functions.stats import binom_sf, normal_sf
from ..functions.text import wrap_words
from .charts import display_label

TEST_COLUMNS = ("p_right", "p_left", "difference", "z", "p_value_greater")


def contingency(df: DataFrame, keys: Sequence[str], prime: str | Column, liberal_value: int = 1) -> DataFrame:
    """Liberal / conservative counts per key (A10): one partial+final aggregate."""
    p = col(prime)
    return df.groupBy(*keys).agg(
        F.count_if(p == liberal_value).cast("long").alias("liberal"),
        F.count_if(p.isNotNull() & (p != liberal_value)).cast("long").alias("conservative"),
    )


def two_proportion_columns(lib_right: str | Column, con_right: str | Column,
                           lib_left: str | Column, con_left: str | Column) -> list[Column]:
    """Pooled one-sided two-proportion z test (T2), no continuity correction.

    Successes are liberal counts.  An empty side or a pooled share of 0 or 1 gives
    NULL statistics instead of a division error.
    """
    lr, cr, ll, cl = (col(c).cast("double") for c in (lib_right, con_right, lib_left, con_left))
    n_r = lr + cr
    n_l = ll + cl
    p_r = safe_div(lr, n_r)
    p_l = safe_div(ll, n_l)
    pooled = safe_div(lr + ll, n_r + n_l)
    se = F.sqrt(pooled * (F.lit(1.0) - pooled) * (safe_div(F.lit(1.0), n_r) + safe_div(F.lit(1.0), n_l)))
    z = safe_div(p_r - p_l, F.when(se > 0, se))
    return [p_r.alias("p_right"), p_l.alias("p_left"), (p_r - p_l).alias("difference"),
            z.alias("z"), normal_sf(z).alias("p_value_greater")]


def comparisons_vs_reference(counts: DataFrame, domain: str, category: str, reference: Column) -> DataFrame:
    """Every category of a domain against the domain's reference category.

    ``reference`` is a Column over ``counts`` naming the reference category (for
    example ``F.lit('view')``).  Returns (domain, right, left).
    """
    return (counts.select(domain, category, reference.alias("left"))
            .where(F.col(category) != F.col("left"))
            .select(domain, F.col(category).alias("right"), "left"))


def two_proportion_tests(counts: DataFrame, comparisons: DataFrame, domain: str = "domain",
                         category: str = "category") -> DataFrame:
    """T4: join each (domain, right, left) comparison to its two count rows, then T2.

    Both joins are left equi-joins on (domain, category), so a comparison whose category has no
    rows keeps its place: that side counts 0 and the statistics are NULL.  AQE picks broadcast or
    shuffle by the observed size of ``counts``.
    """
    right = counts.select(F.col(domain), F.col(category).alias("right"),
                          F.col("liberal").alias("lib_right"), F.col("conservative").alias("con_right"))
    left = counts.select(F.col(domain), F.col(category).alias("left"),
                         F.col("liberal").alias("lib_left"), F.col("conservative").alias("con_left"))
    joined = (comparisons.join(right, [domain, "right"], "left").join(left, [domain, "left"], "left")
              .fillna(0, ["lib_right", "con_right", "lib_left", "con_left"]))
    return joined.select(
        domain,
        F.concat_ws("_vs_", "right", "left").alias("comparison"),
        "lib_right", "con_right", "lib_left", "con_left",
        *two_proportion_columns("lib_right", "con_right", "lib_left", "con_left"),
    )


def tests_to_bars(tests: DataFrame, order: Sequence[str], domain: str = "domain", with_position: bool = False) -> DataFrame:
    """T5: one bar per (domain, category), first seen in test order, right side first.

    ``with_position`` adds ``bar_no``, the bar's place in its panel.

    The right category keeps the test's p-value, the left one gets NULL.  The
    first-seen rule is a ``min_by`` on (order..., side): mergeable, no window.
    """
    right, left = split_comparison("comparison")
    sides = F.array(
        F.struct(F.lit(0).alias("side"), right.alias("category"), F.col("lib_right").alias("liberal"),
                 F.col("con_right").alias("conservative"), F.col("p_value_greater").alias("p_value_greater")),
        F.struct(F.lit(1).alias("side"), left.alias("category"), F.col("lib_left").alias("liberal"),
                 F.col("con_left").alias("conservative"), F.lit(None).cast("double").alias("p_value_greater")),
    )
    # bars keep the order in which the tests name them: ``bar_no`` from 0 within the domain
    exploded = tests.select(domain, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)],
                            F.explode(sides).alias("b"))
    rank_key = F.struct(*[F.col(f"_o{i}") for i in range(len(order))], F.col("b.side"))
    first = exploded.groupBy(domain, F.col("b.category").alias("category")).agg(
        F.min_by(F.col("b"), rank_key).alias("b"), F.min(rank_key).alias("_at"))
    first = first.withColumn("bar_no", (F.row_number().over(Window.partitionBy(domain).orderBy("_at")) - 1).cast("long"))
    total = (F.col("b.liberal") + F.col("b.conservative")).cast("long")
    return first.select(
        domain, "category",
        F.col("b.liberal").cast("long").alias("liberal"),
        F.col("b.conservative").cast("long").alias("conservative"),
        total.alias("total"),
        F.coalesce(safe_div(F.col("b.liberal"), total), F.lit(0.0)).alias("liberal_share"),
        F.col("b.p_value_greater").alias("p_value_greater"),
        *(["bar_no"] if with_position else []),
    )


def significant(p: str | Column, alpha: float = 0.05) -> Column:
    """P is known and below alpha."""
    return F.coalesce(col(p) < alpha, F.lit(False))


def bar_segments(bars: DataFrame, group: Column | None = None, domain: str = "domain",
                 labels: Mapping[str, str] | None = None, titles: Mapping[object, str] | None = None) -> DataFrame:
    """Stacked-bar geometry per bar.

    Bars that carry ``bar_no`` (:func:`tests_to_bars` with positions) also get their place ``x_pos`` in
    the panel, the axis label ``category_label`` (``labels``, else the title-cased category wrapped at
    16 characters), the panel's title ``panel_label`` (``titles``, else the title-cased domain), and
    the texts written into the two segments (NULL in an empty one).

    ``group`` names the figure a domain is drawn in (default: the domain itself);
    the y-limit is 1.14 x the largest total in that figure, the star height uses
    the largest total of the bar's own domain.
    """
    g = group if group is not None else F.col(domain)
    # bars are one row per (domain, category): windows over them sort only those rows
    j = (bars.withColumn("figure_group", g)
         .withColumn("_fig_max", F.max("total").over(Window.partitionBy("figure_group")))
         .withColumn("_dom_max", F.max("total").over(Window.partitionBy(domain))))
    lib = F.col("liberal").cast("double")
    con = F.col("conservative").cast("double")
    return j.select(
        "figure_group", domain, "category", "liberal", "conservative", "total",
        (lib / F.lit(2.0)).alias("liberal_label_y"),
        (lib + con / F.lit(2.0)).alias("conservative_label_y"),
        "liberal_share",
        F.coalesce(safe_div(con, F.col("total")), F.lit(0.0)).alias("conservative_share"),
        significant("p_value_greater").alias("star"),
        (F.col("total") + F.col("_dom_max") * F.lit(0.035)).alias("star_y"),
        (F.col("_fig_max") * F.lit(1.14)).alias("y_limit"),
        *(_bar_texts(domain, labels, titles) if "bar_no" in bars.columns else []),
    )


def _bar_texts(domain: str, labels: Mapping[str, str] | None, titles: Mapping[object, str] | None) -> list[Column]:
    def written(n: str) -> Column:
        share = F.bround(safe_div(F.col(n).cast("double"), F.col("total")) * F.lit(100.0), 1)
        return F.when(F.col(n) > 0, F.format_string("%d\n(%.1f%%)", F.col(n), share))

    return [F.col("bar_no").alias("x_pos"),
            display_label("category", labels, fallback=wrap_words(display_label("category"))).alias("category_label"),
            display_label(domain, titles).alias("panel_label"),
            written("liberal").alias("liberal_text"), written("conservative").alias("conservative_text")]


def binomial_test(df: DataFrame, successes: str = "correct", trials: str = "total", p: float = 0.5) -> DataFrame:
    """Attach the exact one-sided binomial p-value P(X >= successes)."""
    return df.withColumn("p_value_greater", binom_sf(successes, trials, p))
