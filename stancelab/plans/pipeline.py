"""The study's three flows as lazy Spark plans over study-shaped tables.

* :func:`effects_flow` - responses -> coefficient table -> per-topic tables ->
  forecast verdicts -> checks (Entry 1);
* :func:`tests_flow` - labelled justifications -> contingency -> two-proportion
  tests -> bars and bar geometry (Entry 2);
* :func:`clusters_flow` - embedding archive + manifest + texts -> slices ->
  k-means per slice -> assignments with texts, metrics, labelling prompts (Entry 3).

Each returns a dict of DataFrames; :func:`write_outputs` lands them (Parquet by
default, CSV on request, per-topic partitioning for the coefficient table).
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import charts as ch
from ..operators import checks as ck
from ..operators import forecast as fc
from ..operators import kmeans as km
from ..operators import significance as sig
from ..operators import slices as sl
from ..operators import text as tx
from ..operators.effects import assign_topic, coefficient_table
from ..sources.files import path_exists, write_table
from ..sources.tables import RESPONSE_CONTRACT, read_study, require_columns, table_path

# Topic groups of the COVID issues (coefficient tables are split by them).
COVID_TOPICS = {
    "vaccine": list(range(0, 10)) + [20, 22, 25, 26, 28, 31, 32],
    "masks": [17, 18, 19, 21, 27, 29, 30, 36, 37],
    "lockdown_travel": [10, 11, 12, 13, 14, 15, 16, 23, 24],
    "cdc_virus_misc": [33, 34, 35, 38, 39],
}
VALIDATION_TOPICS = {"part1": list(range(0, 12)), "part2": list(range(12, 28))}
# The figure each justification domain is drawn in.
STUDY_FIGURES = {
    "vaccine": ["vaccine_get", "vaccine_not_get"],
    "mask_mandate": ["mask_mandate_for", "mask_mandate_against"],
    "fear_virus": ["fear_virus_for", "fear_virus_against"],
    "appendix": ["appendix_mask_mandate_for_alt1", "appendix_mask_mandate_against_alt",
                 "appendix_mask_mandate_for_alt2"],
}


def effects_flow(responses: DataFrame, bank: DataFrame, dataset: str = "covid",
                 topics: Mapping[str, Sequence[int]] = COVID_TOPICS,
                 expected_shape: Mapping[str, int] | None = None,
                 expected_counts: Mapping[str, int] = fc.EXPECTED_COUNTS,
                 overrides: Mapping[str, str] = fc.KEYWORD_OVERRIDES,
                 panel_labels: Mapping[float, str] | None = None) -> dict[str, DataFrame]:
    """Entry 1.  ``responses`` must carry the contract columns (checked before any job).

    Panel titles prefer the wording's keyword, then ``panel_labels`` (issue key ->
    title), then the issue key itself.
    """
    require_columns(responses, RESPONSE_CONTRACT, f"{dataset} responses")
    coefs = coefficient_table(responses)
    by_topic = assign_topic(coefs, topics, key="issue_no", name="topic_group")
    title = F.coalesce(F.col("keyword"), ch.display_label("issue_no_key", panel_labels or None))
    panels = ch.coefficient_panels(by_topic, "topic_group", ["issue_no", "issue_no_key"], ["question_no"], title)
    forecast = fc.forecast_table(coefs, bank, overrides=overrides)
    counts = fc.verdict_counts(forecast)
    summary = ck.summary_counts(responses, dataset, {"prompts": "prompt_no", "questions": "question_no",
                                                     "issues": "issue_no"})
    shape = ck.shape_check(summary, expected_shape or ck.EXPECTED_SHAPES.get(dataset, {
        "rows": 0, "prompts": 0, "questions": 0}))
    checks = ck.with_note(shape.unionByName(fc.count_check(counts, expected_counts)))
    return {
        "coefficients": coefs,
        "coefficients_by_topic": by_topic,
        "panels": panels,
        "forecast": forecast,
        "verdict_counts": counts,
        "forecast_tests": fc.forecast_tests(forecast, ["issue_no_key"]),
        "summary": summary,
        "checks": checks,
    }


def tests_flow(labelled: DataFrame, comparisons: DataFrame, domain: str = "domain",
               category: str = "category", prime: str = "liberal",
               order: Sequence[str] = ("test_no",), figure_group=None) -> dict[str, DataFrame]:
    """Entry 2.  ``labelled`` has one row per classified justification (domain, category,
    liberal 0/1); ``comparisons`` lists (domain, right, left, test_no)."""
    counts = sig.contingency(labelled, [domain, category], prime).withColumnRenamed(domain, "domain") \
        .withColumnRenamed(category, "category")
    tests = sig.two_proportion_tests(counts, comparisons.select("domain", "right", "left", *order))
    ordered = tests.join(comparisons.select("domain", F.concat_ws("_vs_", "right", "left").alias("comparison"),
                                            *order), ["domain", "comparison"])
    bars = sig.tests_to_bars(ordered, order=list(order))
    if figure_group is None:   # the study's figures; other domains get a figure of their own
        lookup = F.create_map(*[F.lit(v) for fig, doms in STUDY_FIGURES.items() for d in doms for v in (d, fig)])
        figure_group = F.coalesce(F.element_at(lookup, F.col("domain")), F.col("domain"))
    return {"counts": counts, "tests": tests, "bars": bars, "segments": sig.bar_segments(bars, figure_group)}


def clusters_flow(archive: DataFrame, manifest: DataFrame, texts: DataFrame, k: int = 4, restarts: int = 10,
                  seed: int = 42, examples_per_cluster: int = 20) -> dict[str, DataFrame]:
    """Entry 3 for every slice of the manifest at once (the reference clusters one
    slice per run; one slice is just a filter on the outputs)."""
    keys = list(sl.SLICE_KEYS)
    vectors = sl.read_slices(archive, manifest)
    numbered = sl.texts_by_position(texts)
    points = vectors.select(*keys, F.col("position").alias("point_id"),
                            F.col("embedding").cast("array<double>").alias("vec"))
    assigned, centroids, inertia = km.kmeans(points, keys, k=k, restarts=restarts, seed=seed)
    told = numbered.select(*keys, F.col("position").alias("point_id"), "justification", F.lit(True).alias("_told"))
    with_text = (assigned.join(told, [*keys, "point_id"], "left")
                 .withColumn("missing_text", F.col("_told").isNull()).drop("_told"))
    metrics = km.quality_metrics(assigned.join(points, [*keys, "point_id"]), keys)
    prompts = tx.labelling_prompts(with_text.withColumn("slice_cluster", F.concat_ws(
        ":", *[F.col(c).cast("string") for c in keys], F.col("cluster").cast("string"))),
        "slice_cluster", "justification", ["point_id"], k=examples_per_cluster)
    return {
        "inventory": manifest,
        "integrity": sl.manifest_integrity(manifest, texts, vectors=vectors),
        "assignments": with_text.select(*keys, "cluster", "justification", "point_id", "missing_text"),
        "metrics": metrics,
        "centroids": centroids,
        "inertia": inertia,
        "labelling_prompts": prompts,
        "summary": manifest.agg(F.count(F.lit(1)).cast("long").alias("cache_files"))
                           .withColumn("mode", F.lit("summary_only")),
    }


# O1: coefficient rows are written in (issue, issue key, question) order.
SINK_ORDER = {
    "coefficients": ("issue_no", "issue_no_key", "question_no"),
    "coefficients_by_topic": ("issue_no", "issue_no_key", "question_no"),
    "forecast": ("issue_no", "issue_no_key", "question_no"),
}


def write_outputs(outputs: Mapping[str, DataFrame], out_dir: str, fmt: str = "parquet") -> None:
    """Land every output; the per-topic coefficient table is partitioned by topic.

    Ordered outputs are range-partitioned and sorted (a distributed sort) or, when
    split by topic, sorted inside each topic's files.
    """
    for name, df in outputs.items():
        parts = ["topic_group"] if name == "coefficients_by_topic" else []
        order = [c for c in SINK_ORDER.get(name, ()) if c in df.columns]
        if order:
            df = df.repartition(*parts).sortWithinPartitions(*parts, *order) if parts else df.orderBy(*order)
        write_table(df, os.path.join(out_dir, name), fmt=fmt, partition_by=parts)


def run_study(spark, root: str, out_dir: str, fmt: str = "parquet",
              datasets: Mapping[str, Mapping[str, Sequence[int]]] | None = None,
              k: int = 4, restarts: int = 10, seed: int = 42) -> list[str]:
    """The whole cached-data study as one function (the reference's script runner).

    Reads the registered tables under ``root`` (see ``sources.tables.STUDY_TABLES``),
    runs Entry 1 for every response dataset present, Entry 2 when the labelled
    justifications and comparisons are present and Entry 3 when the embedding
    archive, manifest and texts are present; writes every output under
    ``out_dir/<flow>/<table>``.  Returns the flows that ran.
    """
    def have(*names: str) -> bool:
        return all(path_exists(spark, table_path(root, n)) for n in names)

    ran = []
    topics = datasets or {"covid": COVID_TOPICS, "validation": VALIDATION_TOPICS}
    for dataset, groups in topics.items():
        if have(dataset, f"bank_{dataset}"):
            out = effects_flow(read_study(spark, root, dataset), read_study(spark, root, f"bank_{dataset}"),
                               dataset=dataset, topics=groups)
            write_outputs(out, os.path.join(out_dir, f"effects_{dataset}"), fmt)
            ran.append(f"effects_{dataset}")
    if have("justification_labels", "justification_comparisons"):
        out = tests_flow(read_study(spark, root, "justification_labels"),
                         read_study(spark, root, "justification_comparisons"))
        write_outputs(out, os.path.join(out_dir, "tests"), fmt)
        ran.append("tests")
    if have("embedding_archive", "embedding_manifest", "justification_texts"):
        out = clusters_flow(read_study(spark, root, "embedding_archive"), read_study(spark, root, "embedding_manifest"),
                            read_study(spark, root, "justification_texts"), k=k, restarts=restarts, seed=seed)
        write_outputs(out, os.path.join(out_dir, "clusters"), fmt)
        ran.append("clusters")
    return ran
