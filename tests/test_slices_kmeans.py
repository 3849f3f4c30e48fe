"""Slices, positional text joins and grouped k-means on small fixtures."""

import math
import random

from pyspark.sql import functions as F

from stancelab.operators import kmeans as km
from stancelab.operators import slices as sl

ARCHIVE = "archive_file string, row_no long, embedding array<float>"
MANIFEST = "prompt_no int, connector int, sentiment string, archive_file string, archive_offset long, n long"
TEXTS = "prompt_no int, connector int, sentiment string, justification_no long, justification string"


def test_read_slices_and_pairing(spark):
    arch = spark.createDataFrame([("p1", i, [float(i), 0.0]) for i in range(10)] +
                                 [("p2", i, [100.0 + i, 1.0]) for i in range(5)], ARCHIVE)
    man = spark.createDataFrame([(1, 1, "pos", "p1", 0, 4), (1, 1, "neg", "p1", 4, 6), (2, 1, "pos", "p2", 0, 5)],
                                MANIFEST)
    got = sl.read_slices(arch, man, bucket=3)
    rows = sorted((r.prompt_no, r.sentiment, r.position, r.row_no) for r in got.collect())
    assert len(rows) == 15
    assert (1, "neg", 0, 4) in rows and (1, "neg", 5, 9) in rows and (2, "pos", 4, 4) in rows
    texts = spark.createDataFrame([(1, 1, "pos", j, f"t{j}") for j in (7, 3, 5, 9, 11)] +   # more texts than vectors
                                  [(1, 1, "neg", 1, None), (1, 1, "neg", 2, "b")], TEXTS)  # fewer texts
    paired = sl.pair_texts(got, sl.texts_by_position(texts)).collect()
    pos = sorted((r.position, r.justification) for r in paired if r.sentiment == "pos" and r.prompt_no == 1)
    assert pos == [(0, "t3"), (1, "t5"), (2, "t7"), (3, "t9")]
    neg = sorted(((r.position, r.justification) for r in paired if r.sentiment == "neg"), key=lambda t: t[0])
    assert neg == [(0, ""), (1, "b"), (2, None), (3, None), (4, None), (5, None)]  # no vector is lost
    assert len(paired) == 15 and sum(r.missing_text for r in paired) == 4 + 5
    short = sl.manifest_integrity(man, texts, vectors=sl.read_slices(
        arch.where((F.col("archive_file") == "p1") & (F.col("row_no") != 5)), man))
    assert {(r.prompt_no, r.sentiment): (r.n_read, r.status) for r in short.collect()} == {
        (1, "pos"): (4, "more_texts"), (1, "neg"): (5, "short_slice"), (2, "pos"): (0, "missing_slice")}
    nulls = spark.createDataFrame([(1, 1, "pos", None, "x"), (1, 1, "pos", 2, "y")], TEXTS)
    assert sorted((r.position, r.justification) for r in sl.texts_by_position(nulls).collect()) == [(0, "x"), (1, "y")]
    integ = {(r.prompt_no, r.sentiment): r.status for r in sl.manifest_integrity(man, texts).collect()}
    assert integ == {(1, "pos"): "more_texts", (1, "neg"): "fewer_texts", (2, "pos"): "fewer_texts"}


def test_manifest_from_archive_and_gap(spark):
    arch = spark.createDataFrame([("p1", i, [0.0, 1.0, 2.0]) for i in range(6)], ARCHIVE) \
        .withColumn("prompt_no", F.when(F.col("row_no") < 2, 0).otherwise(1)) \
        .withColumn("connector", F.lit(1)).withColumn("sentiment", F.lit("pos"))
    m = {r.prompt_no: r for r in sl.slice_manifest(arch).collect()}
    assert (m[0].archive_offset, m[0].n, m[0].global_offset, m[0].dimensions) == (0, 2, 0, 3)
    assert (m[1].archive_offset, m[1].n, m[1].global_offset) == (2, 4, 2)
    gap = spark.createDataFrame([(1, 1, "pos", "p1", 0, 2), (2, 1, "pos", "p1", 3, 2)], MANIFEST)
    st = {r.prompt_no: (r.contiguous, r.status) for r in sl.manifest_integrity(gap, gap.limit(0).select(
        "prompt_no", "connector", "sentiment")).collect()}
    assert st[1] == (False, "gap_after") and st[2] == (True, "fewer_texts")


def blobs(seed=3, n=40):
    random.seed(seed)
    centres = [(0, 0), (10, 10), (0, 10), (10, 0)]
    rows = []
    for s in ("A", "B"):
        for i in range(n):
            c = centres[i % 4]
            rows.append((s, i, [c[0] + random.gauss(0, 0.3), c[1] + random.gauss(0, 0.3)]))
    return rows


def test_kmeans_recovers_blobs(spark):
    pts = spark.createDataFrame(blobs(), "s string, point_id long, vec array<double>")
    assigned, cents, inertia = km.kmeans(pts, ["s"], k=4, restarts=3, seed=42)
    rows = assigned.collect()
    assert len(rows) == 80
    for s in ("A", "B"):
        groups = {}
        for r in rows:
            if r.s == s:
                groups.setdefault(r.cluster, set()).add(r.point_id % 4)
        assert len(groups) == 4 and all(len(v) == 1 for v in groups.values())
    m = {r.s: r for r in km.quality_metrics(assigned.join(pts, ["s", "point_id"]), ["s"]).collect()}
    assert m["A"].silhouette_sqeuclidean > 0.9 and m["A"].davies_bouldin < 0.2 and m["A"].k == 4


def test_kmeans_edge_cases(spark):
    rows = [("one", 0, [0.0, 0.0]), ("one", 1, [0.0, 0.0]), ("one", 2, [0.0, 0.0]),   # identical + zero vectors
            ("few", 0, [1.0, 1.0]), ("few", 1, [2.0, 2.0])]                             # k >= n
    pts = spark.createDataFrame(rows, "s string, point_id long, vec array<double>")
    assigned, _, _ = km.kmeans(pts, ["s"], k=3, restarts=2, seed=1)
    assert assigned.count() == 5
    m = {r.s: r for r in km.quality_metrics(assigned.join(pts, ["s", "point_id"]), ["s"]).collect()}
    assert m["one"].silhouette_sqeuclidean is None and m["few"].silhouette_sqeuclidean is None
    assigned1, _, _ = km.kmeans(pts, ["s"], k=1, restarts=1, seed=1)
    assert {r.cluster for r in assigned1.collect()} == {0}


def test_quality_metrics_brute_force(spark):
    rows = [("s", i, [float(i % 3), float(i % 5), float(i % 7)], i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "s string, point_id long, vec array<double>, cluster int")
    got = km.quality_metrics(df, ["s"]).first()
    pts = [(r[2], r[3]) for r in rows]

    def d2(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))
    sil = []
    for i, (x, c) in enumerate(pts):
        own = [d2(x, y) for j, (y, cc) in enumerate(pts) if cc == c and j != i]
        a = sum(own) / len(own)
        b = min(sum(d2(x, y) for y, cc in pts if cc == o) / sum(1 for _, cc in pts if cc == o)
                for o in {0, 1, 2} - {c})
        sil.append((b - a) / max(a, b))
    assert abs(got.silhouette_sqeuclidean - sum(sil) / len(sil)) < 1e-12
    cents = {c: [sum(x[d] for x, cc in pts if cc == c) / 10 for d in range(3)] for c in range(3)}
    spread = {c: sum(math.sqrt(d2(x, cents[c])) for x, cc in pts if cc == c) / 10 for c in range(3)}
    db = sum(max((spread[i] + spread[j]) / math.sqrt(d2(cents[i], cents[j])) for j in range(3) if j != i)
             for i in range(3)) / 3
    assert abs(got.davies_bouldin - db) < 1e-12


def test_clusters_flow_end_to_end(spark):
    from stancelab.plans.pipeline import clusters_flow
    random.seed(5)
    centres = [(0, 0), (10, 10)]
    arch_rows, man_rows, text_rows = [], [], []
    offset = 0
    for prompt_no, sentiment, n in ((1, "pos", 12), (1, "neg", 10), (2, "pos", 8)):
        for i in range(n):
            c = centres[i % 2]
            arch_rows.append(("part1", offset + i, [c[0] + random.gauss(0, 0.2), c[1] + random.gauss(0, 0.2)]))
        man_rows.append((prompt_no, 1, sentiment, "part1", offset, n))
        offset += n
        if prompt_no == 1:   # slice 2 has no texts at all; slice (1, pos) gets two extra texts
            extra = 2 if sentiment == "pos" else 0
            text_rows += [(prompt_no, 1, sentiment, j, f"{sentiment}{j}") for j in range(n + extra)]
    arch = spark.createDataFrame(arch_rows, ARCHIVE)
    man = spark.createDataFrame(man_rows, MANIFEST)
    texts = spark.createDataFrame(text_rows, TEXTS)
    out = clusters_flow(arch, man, texts, k=2, restarts=2, seed=3, examples_per_cluster=3)
    assigned = out["assignments"].collect()
    assert len(assigned) == 30                 # every vector stays; extra texts dropped
    assert sum(r.missing_text for r in assigned) == 8
    for s in ("pos", "neg"):
        groups = {}
        for r in assigned:
            if r.sentiment == s and r.prompt_no == 1:
                groups.setdefault(r.cluster, set()).add(r.point_id % 2)
        assert sorted(len(v) for v in groups.values()) == [1, 1]
    metrics = {(r.prompt_no, r.sentiment): r for r in out["metrics"].collect()}
    assert len(metrics) == 3 and metrics[(1, "pos")].silhouette_sqeuclidean > 0.9
    integ = {(r.prompt_no, r.sentiment): r.status for r in out["integrity"].collect()}
    assert integ == {(1, "pos"): "more_texts", (1, "neg"): "ok", (2, "pos"): "fewer_texts"}
    prompts = out["labelling_prompts"].collect()
    assert len(prompts) == 4 and all(p.labeling_prompt.count("\n- ") == 3 for p in prompts)
    assert out["summary"].first().cache_files == 3


def test_clustering_queries_return_assignments_and_metrics(spark):
    import numpy as np

    from stancelab.plans import queries
    from tests.conftest import SF_SMALL
    got = queries.queries()["kmeans_assignments"](spark, SF_SMALL).collect()
    vectors = {(r["slice"], r["point_id"]): np.array(r["vec"], float) for r in queries._points(spark, SF_SMALL).collect()}
    assert sorted((r["slice"], r["vec_id"]) for r in got) == sorted(vectors)
    metrics = {r["slice"]: r for r in queries.queries()["cluster_metric_values"](spark, SF_SMALL).collect()}
    assert set(metrics) == {r["slice"] for r in got}
    for s, m in metrics.items():
        x = np.array([vectors[s, r["vec_id"]] for r in got if r["slice"] == s])
        own = np.array([r["cluster"] for r in got if r["slice"] == s])
        ks = sorted(set(own))
        mean = np.array([x[own == k].mean(0) for k in ks])
        to = np.array([[((x[own == k] - v) ** 2).sum(1).mean() for k in ks] for v in x])
        mine = np.searchsorted(ks, own)
        n = np.array([(own == k).sum() for k in ks])[mine]
        a = to[np.arange(len(x)), mine] * n / np.maximum(n - 1, 1)
        to[np.arange(len(x)), mine] = np.inf
        b = to.min(1)
        silhouette = np.where(n > 1, (b - a) / np.maximum(a, b), 0).mean()
        spread = np.array([np.sqrt(((x[own == k] - c) ** 2).sum(1)).mean() for k, c in zip(ks, mean)])
        db = np.mean([max((spread[i] + spread[j]) / np.linalg.norm(mean[i] - mean[j]) for j in range(len(ks)) if j != i)
                      for i in range(len(ks))])
        assert abs(m["silhouette_sqeuclidean"] - silhouette) < 1e-3 and abs(m["davies_bouldin"] - db) < 1e-3


def test_metrics_far_from_the_origin(spark):
    """The silhouette of points moved by 1e8 is that of the points where they were."""
    df = spark.createDataFrame([(0, c, [c * 4.0 + i % 3, float(i % 5)]) for c in range(3) for i in range(10)],
                               "s int, cluster int, vec array<double>")
    moved = df.withColumn("vec", F.transform("vec", lambda x: x + 1e8))
    here, there = (km.quality_metrics(d, ["s"]).first() for d in (df, moved))
    for name in ("silhouette_sqeuclidean", "calinski_harabasz", "davies_bouldin"):
        assert math.isclose(here[name], there[name], rel_tol=1e-6), name


def test_kmeans_joined_agrees_with_the_kernels(spark):
    """Where no task may hold the centres, the joined form finds as good a clustering."""
    pts = spark.createDataFrame(blobs(), "s string, point_id long, vec array<double>")
    by_kernel, by_join = (km.kmeans(pts, ["s"], k=4, restarts=3, seed=42, kernel_bytes=b) for b in (1 << 20, 0))
    best = [{r.s: r.inertia for r in x[2].groupBy("s").agg(F.min("inertia").alias("inertia")).collect()} for x in (by_kernel, by_join)]
    assert best[0].keys() == best[1].keys() and all(math.isclose(best[0][s], best[1][s], rel_tol=1e-9) for s in best[0])
    assert [x.columns for x in by_kernel] == [x.columns for x in by_join]


def test_kmeans_takes_slices_in_waves(spark):
    pts = spark.createDataFrame(blobs(), "s string, point_id long, vec array<double>")
    room = 2 * 8 * 3 * (1 + 8 * km.SEED_ROUNDS)  # one slice of two dimensions at a time
    whole, waves = (km.kmeans(pts, ["s"], k=4, restarts=3, seed=42, kernel_bytes=b) for b in (1 << 20, room))
    for x, y in zip(whole, waves):
        assert sorted(map(str, x.collect())) == sorted(map(str, y.collect()))


def test_kmeans_of_odd_rows(spark):
    """Null and non-finite vectors take no part, a null key is a key, equal points are one cluster too many."""
    rows = [(None, i, [float(i % 2), 0.0]) for i in range(6)] + [("a", 1, None), ("a", 2, [1.0, float("nan")]),
            ("a", 3, [float("inf"), 1.0]), ("a", 4, [None, 1.0]), ("a", 5, []), ("b", 1, [2.0, 2.0]), ("b", 1, [2.0, 2.0])]
    pts = spark.createDataFrame(rows, "s string, point_id long, vec array<double>")
    assigned, cents, inertia = km.kmeans(pts, ["s"], k=2, restarts=2, seed=1)
    got = assigned.collect()
    assert sorted((str(r.s), r.point_id) for r in got) == [("None", i) for i in range(6)] + [("b", 1), ("b", 1)]
    assert all(r.sq_dist == 0 for r in got) and inertia.count() == 4
    assert len({r.cluster for r in got if r.s is None}) == 2
    empty = km.kmeans(pts.where("point_id > 99"), ["s"], k=2, restarts=2)
    assert [x.count() for x in empty] == [0, 0, 0]


def test_single_slices(spark):
    """S7 and S8 of one slice: a manifest of one archive has ``offset``; absent slices and texts are errors."""
    import pytest
    arch = spark.createDataFrame([("whatever", i, [float(i)]) for i in range(9)], ARCHIVE)
    man = spark.createDataFrame([(1, 1, "pos", 0, 4), (1, 1, "neg", 4, 5), (1, 1, "neg", 0, 1)],
                                "prompt_no int, connector int, sentiment string, offset long, n long")
    every = sl.read_slices(arch, man.where("offset > 0 OR n > 1"))
    assert sorted((r.sentiment, r.position, r.embedding[0]) for r in every.collect()) == sorted(
        [("pos", i, float(i)) for i in range(4)] + [("neg", i, 4.0 + i) for i in range(5)])
    which = {"prompt_no": 1, "connector": 1, "sentiment": "neg"}
    assert [r.position for r in sl.read_slice(arch, man, which).collect()] == [0]  # the first listed
    listed = man.withColumns({"archive_file": F.lit("whatever"), "archive_offset": F.col("offset")})
    pos = sl.read_slice(arch, listed, which | {"sentiment": "pos"}).collect()
    assert sorted((r.position, r.embedding[0]) for r in pos) == [(i, float(i)) for i in range(4)]
    with pytest.raises(ValueError, match="No embedding slice for prompt_no=2"):
        sl.read_slice(arch, man, which | {"prompt_no": 2})
    texts = spark.createDataFrame([(1, 1, "neg", 3, None), (1, 1, "neg", 2, "b")], TEXTS)
    assert sorted((r.position, r.justification) for r in sl.read_slice_texts(texts, which).collect()) == [(0, "b"), (1, "")]
    with pytest.raises(ValueError, match="No justification texts"):
        sl.read_slice_texts(texts, which | {"sentiment": "pos"})


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_slices_are_paired_without_a_shuffle(spark, tmp_path):
    vec = spark.range(400).select((F.col("id") % 3).cast("int").alias("prompt_no"), F.lit(1).alias("connector"),
                                  F.lit("pos").alias("sentiment"), F.floor(F.col("id") / 3).alias("position"), "id")
    told = vec.where("id % 7 <> 0").withColumnRenamed("id", "text_no")
    stored = [sl.store_by_position(df, f"test_stored_{name}", str(tmp_path / name), 6) for name, df in (("v", vec), ("t", told))]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = sl.pair_texts(*stored)
        assert "Exchange" not in plan_of(pairs) and "SortMergeJoin" in plan_of(pairs)
        assert sorted((r.id, r.text_no) for r in pairs.collect()) == [(i, i if i % 7 else None) for i in range(400)] or \
            {(r.id, r.text_no) for r in pairs.collect()} == {(i, i if i % 7 else None) for i in range(400)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in "vt":
            spark.sql(f"DROP TABLE IF EXISTS test_stored_{name}")


def test_manifest_integrity_reads_the_manifest_once(spark):
    """The manifest is a table of its own in the plan, and the numbering is not repeated."""
    arch = spark.createDataFrame([("p1", i, [0.0]) for i in range(6)], ARCHIVE).withColumns(
        {"prompt_no": (F.col("row_no") / 2).cast("int"), "connector": F.lit(1), "sentiment": F.lit("pos")})
    found = sl.manifest_integrity(sl.slice_manifest(arch), arch.select("prompt_no", "connector", "sentiment"))
    plan = plan_of(found)
    assert "FileScan parquet" in plan and "Window" not in plan and plan.count("Scan ExistingRDD") <= 1
