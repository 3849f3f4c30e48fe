"""Chart-ready tables (G1, A5, A6, P20, P21); rendering itself is out of scope.

Inputs are coefficient tables - one row per wording, already aggregated - so
the windows here are partitioned by figure or panel and sort only those rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col

Y_PAD = 0.01
Y_FLOOR = 0.08


def display_label(code: str | Column, labels: Mapping[object, str] | None = None,
                  fallback: Column | None = None) -> Column:
    """P20: mapped label, else ``fallback`` (e.g. the keyword), else the title-cased code."""
    c = col(code)
    title = F.initcap(F.replace(c.cast("string"), F.lit("_"), F.lit(" ")))
    mapped = (F.element_at(F.create_map(*[F.lit(v) for kv in labels.items() for v in kv]), c)
              if labels else F.lit(None).cast("string"))
    parts = [mapped] + ([fallback] if fallback is not None else []) + [title]
    return F.coalesce(*parts)


def coefficient_panels(coefs: DataFrame, figure: str, panel: Sequence[str], x_order: Sequence[str],
                       panel_label: Column) -> DataFrame:
    """G1: panel number (dense rank of the panel key inside its figure), x position inside
    the panel, error-bar lengths, the figure's shared y range (A5) and mixed-axis flag (A6)."""
    panel = list(panel)
    w_panel = Window.partitionBy(figure).orderBy(*panel)
    w_x = Window.partitionBy(figure, *panel).orderBy(*x_order)
    fig = coefs.groupBy(figure).agg(
        F.least(F.lit(-Y_FLOOR), F.min("ci_low") - F.lit(Y_PAD)).alias("y_min"),
        F.greatest(F.lit(Y_FLOOR), F.max("ci_high") + F.lit(Y_PAD)).alias("y_max"),
        (F.count_distinct(F.struct("label_1", "label_2")) > 1).alias("mixed_axes"))
    out = (coefs.withColumn("panel_no", F.dense_rank().over(w_panel))
           .withColumn("x_pos", F.row_number().over(w_x) - 1)
           .withColumn("err_low", F.col("coef") - F.col("ci_low"))
           .withColumn("err_high", F.col("ci_high") - F.col("coef"))
           .withColumn("panel_label", panel_label))
    return out.join(fig, figure)
