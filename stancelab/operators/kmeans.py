"""Grouped k-means with restarts (C1) and cluster quality metrics.

Every slice and every restart is clustered at once:

* points ``(slice..., point_id, vec)`` are spread once over the cluster's parallelism and
  persisted; slices are numbered through a broadcast of their keys;
* a pass over the points is one Arrow kernel per partition (:mod:`.centroids`): it holds the
  centres of a wave of slices, whose size has been checked, and gives one partial result per
  (slice, restart), merged behind one small shuffle.  A step of all unconverged restarts is one job;
* slices are taken in waves whose candidate tables stay within ``kernel_bytes``; where one slice
  alone exceeds it, or there would be too many waves, steps are joins in the JVM instead
  (``_kmeans_joined``): the nearest centre is an ``array_min`` over a ``transform`` of squared
  distances, new centres are ``Summarizer.mean``, and centres are checkpointed every step.

Seeding is k-means|| made deterministic: a first point, then ``SEED_ROUNDS`` rounds that each draw
2 k points with probability proportional to the squared distance from those drawn (an exponential
race over a seeded hash of the point's id), then one pass that weighs the candidates by their
nearest points, and k-means++ on the weighted candidates.  The passes do not depend on k.

Silhouette needs all pairwise distances for the Euclidean metric, so it is
computed for the *squared* Euclidean metric, which decomposes exactly into
per-cluster sums (count, sum of vectors, sum of squared norms).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import array_sum, sq_dist
from ..landing import Landing, ship
from ..session import broadcast_limit, checkpoint_dir
from . import centroids as kernels

#: Bytes of the candidate centres that a kernel holds; slices beyond it wait for the next wave.
KERNEL_BYTES = 64 << 20
#: Waves, and slices on the driver, before the joined form takes over.
MAX_WAVES = 64
MAX_SLICES = 100_000
#: Rounds of the seeding that draw 2 k candidates each.
SEED_ROUNDS = 5


def _sq_dists(vec: Column, cents: Column) -> Column:
    return F.transform(cents, lambda c: sq_dist(vec, c))


def _argmin(arr: Column) -> Column:
    """0-based position of the smallest element (first on ties).

    Non-nullable on purpose: a nullable cluster id lets the optimizer infer an
    ``isnotnull`` constraint that it pushes into the join and so evaluates all
    distance expressions twice.
    """
    return F.coalesce((F.array_position(arr, F.array_min(arr)) - 1).cast("int"), F.lit(-1))


def assign(points: DataFrame, centroids: DataFrame, keys: Sequence[str], vec: str = "vec",
           broadcast_centroids: bool | None = None) -> DataFrame:
    """Nearest centroid per point (and restart): adds ``cluster`` and ``sq_dist``.

    With ``broadcast_centroids`` the points stream through the join in their own partitions.  It is
    for callers that have bounded the centroid table; None asks the table for its size.
    """
    if broadcast_centroids is None:
        shape = centroids.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("cents")).alias("k"),
                              F.max(F.size(F.get("cents", 0))).alias("d")).first()
        broadcast_centroids = centroid_table_fits(points.sparkSession, shape["n"], 1, shape["k"] or 0, shape["d"] or 0)
    j = points.join(F.broadcast(centroids) if broadcast_centroids else centroids, list(keys))
    d = _sq_dists(F.col(vec), F.col("cents"))
    return (j.withColumn("_d", d)
            .withColumn("cluster", _argmin(F.col("_d")))
            .withColumn("sq_dist", F.array_min("_d"))
            .drop("_d", "cents"))


def _uniform(*cols: Column) -> Column:
    """Seeded uniform in (0, 1] from a 64-bit hash."""
    h = F.xxhash64(*cols)
    return (F.abs(h % F.lit(1 << 53)).cast("double") + F.lit(1.0)) / F.lit(float(1 << 53))


def _checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; the data is persisted first so it is computed only once."""
    checkpoint_dir(df.sparkSession)
    df = df.persist()
    out = df.checkpoint(eager=True)
    df.unpersist()
    return out


def _pick(scored: DataFrame, keys: Sequence[str], point_id: str) -> DataFrame:
    """Per (slice, restart): the point with the smallest ``_score``, ties to the smallest id.

    Two hash aggregates over a narrow (keys, restart, id, score) table - no sort of
    the vector-carrying rows, which a struct-ordered ``min_by`` would need.
    """
    best = scored.groupBy(*keys, "restart").agg(F.min("_score").alias("_best"))
    ties = scored.join(best, [*keys, "restart"]).where(F.col("_score") == F.col("_best"))
    return ties.groupBy(*keys, "restart").agg(F.min(point_id).alias(point_id))


def init_centroids(points: DataFrame, keys: Sequence[str], k: int, restarts: int, seed: int,
                   vec: str = "vec", point_id: str = "point_id", broadcast_centroids: bool = False) -> DataFrame:
    """Seeded k-means++ starts for every (slice, restart): (keys..., restart, cents)."""
    keys = list(keys)
    rs = F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("restart")
    vectors = points.select(*keys, point_id, vec)
    cents = None
    for step in range(k):
        if cents is None:
            base = points.select(*keys, point_id, rs)
            score = _uniform(F.col(point_id), F.lit(seed), F.col("restart"), F.lit(0))
        else:
            base = points.join(F.broadcast(cents) if broadcast_centroids else cents, keys)
            dmin = F.array_min(_sq_dists(F.col(vec), F.col("cents")))
            u = _uniform(F.col(point_id), F.lit(seed), F.col("restart"), F.lit(step))
            score = F.when(dmin > 0, -F.log(u) / dmin).otherwise(F.lit(float("inf")))
        scored = base.select(*keys, "restart", point_id, score.alias("_score")).persist()
        chosen = _pick(scored, keys, point_id).join(vectors, [*keys, point_id])
        if cents is None:
            nxt = chosen.select(*keys, "restart", F.array(vec).alias("cents"))
        else:
            nxt = cents.join(chosen, [*keys, "restart"]).select(
                *keys, "restart", F.concat("cents", F.array(vec)).alias("cents"))
        cents = _checkpoint(nxt)
        scored.unpersist()
    return cents


def centroid_table_fits(spark, n_slices: int, restarts: int, k: int, dim: int) -> bool:
    """Exact size bound of the centroid table (slices x restarts x k x dim doubles)
    against the session's broadcast threshold; above it the join is left to the planner."""
    limit = broadcast_limit(spark)
    return limit > 0 and n_slices * restarts * k * dim * 8 <= limit


def _update(points: DataFrame, cents: DataFrame, keys: Sequence[str], vec: str, k: int,
            broadcast_centroids: bool = False) -> DataFrame:
    """One Lloyd step: assign, mean per (slice, restart, cluster), new centre arrays; an
    empty cluster keeps its centre.  Means are grouped by cluster (a weighted
    ``Summarizer`` per cluster would fail on a cluster left empty), packed per
    (slice, restart) and joined to the old centres."""
    keys = list(keys)
    a = assign(points, cents, keys, vec, broadcast_centroids)
    means = (a.select(*keys, "restart", "cluster", array_to_vector(F.col(vec)).alias("_v"))
             .groupBy(*keys, "restart", "cluster").agg(Summarizer.mean(F.col("_v")).alias("_m")))
    packed = means.groupBy(*keys, "restart").agg(
        F.collect_list(F.struct("cluster", vector_to_array("_m").alias("m"))).alias("_ms"))
    j = cents.join(packed, [*keys, "restart"], "left")
    new = F.array(*[F.coalesce(
        F.get(F.filter(F.coalesce("_ms", F.array()), lambda m: m.getField("cluster") == c), 0).getField("m"),
        F.get("cents", c)) for c in range(k)])
    return j.select(*keys, "restart", new.alias("_new"), F.col("cents").alias("_old")).select(
        *keys, "restart", F.col("_new").alias("cents"),
        array_sum(F.zip_with("_old", "_new", lambda o, n: sq_dist(o, n))).alias("_shift"))


def _usable(vec: str) -> Column:
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def kmeans(points: DataFrame, keys: Sequence[str], k: int = 4, restarts: int = 10, seed: int = 42,
           max_iter: int = 100, tol: float = 1e-4, vec: str = "vec", point_id: str = "point_id",
           kernel_bytes: int = KERNEL_BYTES):
    """Cluster every slice; returns (assignments, centroids, inertia per slice and restart).

    Centroids and inertia carry ``n_iter``, the steps that (slice, restart) took, and ``converged``,
    false where ``max_iter`` ended it.  A (slice, restart) has converged when the summed squared
    centre shift of a step is at most ``tol`` x the slice's mean feature variance; from then on it
    is frozen.  An empty cluster keeps its centre.

    ``assignments``: keys..., point_id, cluster, sq_dist for the best restart of each
    slice (lowest inertia, then lowest restart number).

    Vectors that are null, empty or hold a null or non-finite component take no part; those of one
    slice must have one length.  A null key is a key like others.  The results are tables in the
    checkpoint folder.
    """
    keys = list(keys)
    spark = points.sparkSession
    pts = (points.select(*keys, point_id, F.col(vec).cast("array<double>").alias("vec")).where(_usable("vec")))
    slices = pts.groupBy(*keys).agg(F.max(F.size("vec")).alias("_dim")).orderBy(*keys).limit(MAX_SLICES + 1).toArrow()
    dims = slices["_dim"].to_pylist()
    one = [d * 8 * restarts * (1 + 2 * k * SEED_ROUNDS) for d in dims]
    waves: list[list[int]] = []
    room = 0
    for s, size in enumerate(one):
        if size > room:
            waves.append([])
            room = kernel_bytes
        waves[-1].append(s)
        room -= size
    if len(dims) > MAX_SLICES or len(waves) > MAX_WAVES or max(one, default=0) > kernel_bytes:
        return _kmeans_joined(pts, keys, k, restarts, seed, max_iter, tol, "vec", point_id)
    ship(spark)
    landing = Landing(spark, "kmeans")
    key_schema = pts.select(*keys).schema
    unit_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_schema) + ", restart int, converged boolean, n_iter int"
    key_rows = list(zip(*[slices[c].to_pylist() for c in keys]))
    done = []
    for wave in waves or [[]]:
        numbers = spark.createDataFrame([(*key_rows[s], s) for s in wave], ", ".join(
            f"`_k{i}` {f.dataType.simpleString()}" for i, f in enumerate(key_schema)) + ", _s int")
        own = (pts.join(F.broadcast(numbers), [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)])
               .select("_s", F.xxhash64(point_id).alias("_h"), *keys, point_id, "vec")
               # spread the distance work once, before iterating
               .repartition(spark.sparkContext.defaultParallelism).persist())
        found = _cluster(own.select("_s", "_h", "vec"), {s: dims[s] for s in wave}, k, restarts, seed, max_iter, tol)
        best = {s: min(range(restarts), key=lambda r: (found[s, r][1], r)) for s in wave}
        sent = spark.sparkContext.broadcast({s: {0: found[s, best[s]][0]} for s in wave})
        assigned = kernels.nearest(own, {s: dims[s] for s in wave}, sent, [*keys, point_id])
        rows = [(*key_rows[s], r, *found[s, r][2:], found[s, r][1]) for s in wave for r in range(restarts)]
        centres = [(*key_rows[s], best[s], *found[s, best[s]][2:], found[s, best[s]][0].tolist()) for s in wave]
        done.append((landing.table(assigned, "assigned"),
                     landing.table(spark.createDataFrame(centres, f"{unit_schema}, cents array<array<double>>"), "centroids"),
                     landing.table(spark.createDataFrame(rows, f"{unit_schema}, inertia double"), "inertia")))
        own.unpersist()
        sent.destroy()
    assigned, centres, inertia = done[0]
    for more in done[1:]:
        assigned, centres, inertia = (x.unionByName(y) for x, y in zip((assigned, centres, inertia), more))
    return (assigned, centres.select(*keys, "restart", "cents", "converged", "n_iter"),
            inertia.select(*keys, "restart", "inertia", "converged", "n_iter"))


def _cluster(points: DataFrame, dims: dict[int, int], k: int, restarts: int, seed: int, max_iter: int, tol: float):
    """{(slice, restart): (centres, inertia, converged, n_iter)} of one wave of slices."""
    if not dims:
        return {}
    context = points.sparkSession.sparkContext
    units = [(s, r) for s in dims for r in range(restarts)]

    def with_centres(centres, run):
        by_slice: dict[int, dict[int, np.ndarray]] = {}
        for (s, r), c in centres.items():
            by_slice.setdefault(s, {})[r] = c
        sent = context.broadcast(by_slice)
        out = run(sent)
        sent.destroy()
        return out

    candidates = kernels.draw(points, dims, restarts, None, 1, (seed, 0))
    for i in range(SEED_ROUNDS):
        more = with_centres(candidates, lambda sent: kernels.draw(points, dims, restarts, sent, 2 * k, (seed, i + 1)))
        candidates = {u: np.concatenate([c, more[u]]) if u in more else c for u, c in candidates.items()}
    weights, spread = with_centres(candidates, lambda sent: kernels.weigh(points, dims, restarts, sent))
    centres = {u: kernels.reduce_candidates(candidates[u], weights[u], k, np.random.default_rng([seed, *u])) for u in units}
    state = {u: (False, 0) for u in units}
    for n in range(1, max_iter + 1):
        active = {u: centres[u] for u in units if not state[u][0]}
        if not active:
            break
        for u, (_, counts, sums) in with_centres(active, lambda sent: kernels.step(points, dims, sent)).items():
            new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1.0)[:, None], centres[u])
            state[u] = float(((new - centres[u]) ** 2).sum()) <= tol * spread[u[0]], n
            centres[u] = new
    last = with_centres(centres, lambda sent: kernels.step(points, dims, sent))
    return {u: (centres[u], float(last[u][0]), *state[u]) for u in units}


def _kmeans_joined(points: DataFrame, keys: Sequence[str], k: int, restarts: int, seed: int,
                   max_iter: int, tol: float, vec: str, point_id: str):
    """``kmeans`` for centre tables that no task holds: steps are joins, centres are checkpointed.

    Rows with a null key drop out of the joins.
    """
    keys = list(keys)
    spark = points.sparkSession
    pts = points.select(*keys, point_id, F.col(vec).cast("array<double>").alias(vec))
    parallelism = spark.sparkContext.defaultParallelism
    # spread the distance work once, before iterating; asking how it lies now would run the plan
    pts = pts.repartition(parallelism).persist()
    shape = pts.agg(F.count_distinct(F.struct(*keys)).alias("s"), F.max(F.size(vec)).alias("d")).first()
    bcast = centroid_table_fits(spark, shape["s"] or 0, restarts, k, shape["d"] or 0)
    spread = (pts.select(*keys, array_to_vector(F.col(vec)).alias("_v")).groupBy(*keys)
              .agg(Summarizer.variance(F.col("_v")).alias("_var"))
              .select(*keys, (F.lit(tol) * F.aggregate(vector_to_array("_var"), F.lit(0.0), lambda a, x: a + x)
                              / F.size(vector_to_array("_var"))).alias("_tol")))
    spread = _checkpoint(spread)
    checkpoint_dir(spark)
    cents = init_centroids(pts, keys, k, restarts, seed, vec, point_id, bcast).withColumns(
        {"done": F.lit(False), "n_iter": F.lit(0)})
    tol_tab = F.broadcast(spread) if bcast else spread
    for step in range(1, max_iter + 1):
        # only unconverged (slice, restart) pairs take another step; converged ones are
        # frozen, as each restart stops at its own convergence
        active = cents.where(~F.col("done")).select(*keys, "restart", "cents")
        stepped = (_update(pts, active, keys, vec, k, bcast).join(tol_tab, keys)
                   .select(*keys, "restart", "cents", (F.col("_shift") <= F.col("_tol")).alias("done"),
                           F.lit(step).alias("n_iter")))
        # union adds the two inputs' partitions; coalesce keeps the count fixed per step
        merged = cents.where(F.col("done")).unionByName(stepped).coalesce(parallelism).persist()
        remaining = merged.where(~F.col("done")).count()
        # a step refers to the previous centres twice, so without a cut the plan doubles
        # every step; the reliable checkpoint (written from the cache) keeps it constant
        cents = merged.checkpoint(eager=True)
        merged.unpersist()
        if remaining == 0:
            break
    cents = cents.withColumnRenamed("done", "converged")
    final = assign(pts, cents.select(*keys, "restart", "cents"), keys, vec, bcast).select(*keys, "restart", point_id, "cluster", "sq_dist").persist()
    inertia = (final.groupBy(*keys, "restart").agg(F.sum("sq_dist").alias("inertia"))
               .join(cents.select(*keys, "restart", "converged", "n_iter"), [*keys, "restart"]).checkpoint(eager=True))
    best = inertia.groupBy(*keys).agg(F.min_by("restart", F.struct("inertia", "restart")).alias("restart"))
    chosen = (final.join(F.broadcast(best) if bcast else best, [*keys, "restart"])
              .select(*keys, point_id, "cluster", "sq_dist").checkpoint(eager=True))
    best_cents = cents.join(best, [*keys, "restart"])
    # outputs now live in the checkpoint directory; release everything this call cached
    final.unpersist()
    pts.unpersist()
    return chosen, best_cents, inertia


def cluster_stats(assigned: DataFrame, keys: Sequence[str], vec: str = "vec") -> DataFrame:
    """Per (slice, cluster): size, centroid and ``w_c``, the squared distances to it in total.

    Means and variances are merged about the means, so nothing cancels far from the origin.
    """
    keys = list(keys)
    g = (assigned.select(*keys, "cluster", array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
         .groupBy(*keys, "cluster").agg(Summarizer.metrics("mean", "variance").summary(F.col("_v")).alias("_m"),
                                        F.count(F.lit(1)).alias("n_c")))
    return g.select(*keys, "cluster", "n_c", vector_to_array("_m.mean").alias("centroid"),
                    (array_sum(vector_to_array("_m.variance")) * (F.col("n_c") - 1)).alias("w_c"))


def quality_metrics(assigned: DataFrame, keys: Sequence[str], vec: str = "vec",
                    broadcast_clusters: bool | None = None) -> DataFrame:
    """C3-C5 per slice for a given assignment (cluster ids need not be dense).

    silhouette_sqeuclidean, calinski_harabasz, davies_bouldin; NULL unless the slice
    has at least 2 clusters and more points than clusters (the reference's rule).

    The per-slice cluster table (clusters x dim doubles) is broadcast to the points
    only when that exact size - one small aggregate when ``broadcast_clusters`` is
    None - is under the broadcast threshold; otherwise the join is shuffled.
    """
    keys = list(keys)
    spark = assigned.sparkSession
    stats = cluster_stats(assigned, keys, vec)
    per_slice = stats.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("cluster", "n_c", "w_c", "centroid"))).alias("cl"),
        F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"))
    if broadcast_clusters is None:
        shape = assigned.agg(F.count_distinct(F.struct(*keys, "cluster")).alias("c"),
                             F.max(F.size(vec)).alias("d")).first()
        broadcast_clusters = centroid_table_fits(spark, shape["c"] or 0, 1, 1, shape["d"] or 0)
    side = F.broadcast(per_slice) if broadcast_clusters else per_slice
    pts = assigned.select(*keys, "cluster", F.col(vec).cast("array<double>").alias("_x")).join(side, keys)
    x = F.col("_x")
    # squared distances from x to all members of a cluster: n_c |x - mu_c|^2 + w_c
    sums = F.transform("cl", lambda c: F.struct(
        c.getField("cluster").alias("cluster"), c.getField("n_c").alias("n_c"),
        (c.getField("n_c") * sq_dist(x, c.getField("centroid")) + c.getField("w_c")).alias("s")))
    own = F.filter("_sums", lambda c: c.getField("cluster") == F.col("cluster"))
    others = F.filter("_sums", lambda c: c.getField("cluster") != F.col("cluster"))
    a_i = F.try_divide(F.get(own, 0).getField("s"), F.get(own, 0).getField("n_c") - 1)
    b_i = F.array_min(F.transform(others, lambda c: c.getField("s") / c.getField("n_c")))
    s_i = F.when(F.get(own, 0).getField("n_c") <= 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(b_i - a_i, F.greatest(a_i, b_i)), F.lit(0.0)))
    own_c = F.get(F.filter("cl", lambda c: c.getField("cluster") == F.col("cluster")), 0).getField("centroid")
    per_point = pts.withColumn("_sums", sums).select(
        *keys, "cluster", s_i.alias("_s"),
        sq_dist(x, own_c).alias("_w"), F.sqrt(sq_dist(x, own_c)).alias("_dist"))
    # numeric-only aggregates (hash-based); the small per-slice cluster table is joined back after
    by_cluster = per_point.groupBy(*keys, "cluster").agg(
        F.sum("_s").alias("_s_sum"), F.sum("_w").alias("_w_sum"), F.avg("_dist").alias("_spread"))
    agg = by_cluster.groupBy(*keys).agg(
        F.sum("_s_sum").alias("_s_tot"), F.sum("_w_sum").alias("W"),
        F.sort_array(F.collect_list(F.struct("cluster", "_spread"))).alias("_sp")).join(side, keys)
    n = F.col("n").cast("double")
    k = F.col("k").cast("double")
    grand = F.transform(
        F.get(F.col("cl"), 0).getField("centroid"),
        lambda _v, i: array_sum(F.transform("cl", lambda c: c.getField("n_c") * F.get(c.getField("centroid"), i))) / n)
    between = array_sum(F.transform("cl", lambda c: c.getField("n_c") * sq_dist(c.getField("centroid"), grand)))
    ch = F.try_divide(between / (k - 1), F.col("W") / (n - k))
    ratios = F.transform(F.sequence(F.lit(0), F.col("k").cast("int") - 1), lambda i: F.array_max(F.transform(
        F.filter(F.sequence(F.lit(0), F.col("k").cast("int") - 1), lambda j: j != i),
        lambda j: F.try_divide(F.get("_sp", i).getField("_spread") + F.get("_sp", j).getField("_spread"),
                               F.sqrt(sq_dist(F.get("cl", i).getField("centroid"),
                                              F.get("cl", j).getField("centroid")))))))
    db = array_sum(F.transform(ratios, lambda r: F.coalesce(r, F.lit(0.0)))) / k
    valid = (F.col("k") > 1) & (F.col("n") > F.col("k"))
    return agg.select(*keys, F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k"),
                      F.col("W").alias("inertia"),
                      F.when(valid, F.col("_s_tot") / n).alias("silhouette_sqeuclidean"),
                      F.when(valid, ch).alias("calinski_harabasz"),
                      F.when(valid, db).alias("davies_bouldin"))
