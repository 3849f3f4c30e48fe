"""Arrow kernels of the grouped k-means (C1): each is one pass over the points, centres broadcast.

A unit is one restart of one slice.  Points come as rows (``_s`` slice number, ``_h`` a hash of the
point's id, ``vec``).  A kernel reads a partition's batches, takes the distances to all centres of a
slice as one matrix product, and puts out one row per unit: (slice, restart, part, payload).  The
payloads of a unit are then merged, in the order of the partitions, by a second kernel behind one
shuffle.  What a task holds, and what reaches the driver, is as large as the centre table, which
the caller has bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Centres = Mapping[int, Mapping[int, np.ndarray]]  # slice -> restart -> (centres, dimensions)
UNIT = "s int, r int, part int, payload array<double>"
#: Cells of a matrix of distances, and of the rows it is taken from.
CELLS = 1 << 20
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def uniform(h: np.ndarray, *salt: int) -> np.ndarray:
    """Seeded uniforms in (0, 1], one for each hash."""
    x = h.astype(np.int64).view(np.uint64)
    for s in salt:
        x = _mix(x ^ _mix(np.array([s + 1], np.uint64) * _U(0x9E3779B97F4A7C15)))
    return ((x >> _U(11)).astype(np.float64) + 1.0) / float(1 << 53)


def sq_dists(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres, taken about the centres' mean so that little cancels."""
    mean = c.mean(axis=0)
    x, c = x - mean, c - mean
    d = np.einsum("ij,ij->i", x, x)[:, None] - 2.0 * (x @ c.T) + np.einsum("ij,ij->i", c, c)
    return np.maximum(d, 0.0)


def _slices(frames: Iterator[pa.RecordBatch], dims: Mapping[int, int], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(slice, rows in the batch, vectors, hashes, batch) in pieces of at most CELLS numbers."""
    for b in frames:
        number, h = b.column("_s").to_numpy(), b.column("_h").to_numpy()
        vec = b.column("vec")
        at, values = vec.offsets.to_numpy(), vec.values.to_numpy(zero_copy_only=False)
        for s in np.unique(number).tolist():
            if s not in dims:
                continue
            rows = np.flatnonzero(number == s)
            if (at[rows + 1] - at[rows] != dims[s]).any():
                raise ValueError(f"the vectors of one slice differ in length from {dims[s]}")
            step = max(1, CELLS // max(dims[s], width))
            for i in range(0, len(rows), step):
                own = rows[i:i + step]
                yield s, own, values[at[own][:, None] + np.arange(dims[s])], h[own], b


def _put(units: Mapping[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    for (s, r), payload in units.items():
        yield pa.record_batch({"s": pa.array([s], pa.int32()), "r": pa.array([r], pa.int32()), "part": pa.array([part], pa.int32()),
                               "payload": pa.array([payload.ravel()], pa.list_(pa.float64()))})


def _merge(combine: Callable[[int, np.ndarray, np.ndarray], np.ndarray]):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in frames:
            payload = b.column("payload")
            at, values = payload.offsets.to_numpy(), payload.values.to_numpy(zero_copy_only=False)
            for i, unit in enumerate(zip(b.column("s").to_pylist(), b.column("r").to_pylist())):
                new = values[at[i]:at[i + 1]]
                held[unit] = combine(unit[0], held[unit], new) if unit in held else new.copy()
        yield from _put(held)
    return run


def passed(points: DataFrame, kernel, combine) -> dict[tuple[int, int], np.ndarray]:
    """One job: the kernel on each partition, the payloads of each unit merged, as {(slice, restart): payload}."""
    units = points.mapInArrow(kernel, UNIT).repartition("s", "r").sortWithinPartitions("s", "r", "part")
    got = units.mapInArrow(_merge(combine), UNIT).select("s", "r", "payload").toArrow().combine_chunks()
    if not len(got):
        return {}
    payload = got["payload"].combine_chunks()
    at, values = payload.offsets.to_numpy(), payload.values.to_numpy(zero_copy_only=False)
    return {u: values[at[i]:at[i + 1]] for i, u in enumerate(zip(got["s"].to_pylist(), got["r"].to_pylist()))}


def add(_: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x + y


# ---- seeding ---------------------------------------------------------------------------------

def _least(rows: np.ndarray, n: int) -> np.ndarray:
    """The n rows of the smallest first column."""
    return rows[np.argsort(rows[:, 0], kind="stable")[:n]]


def draw(points: DataFrame, dims: Mapping[int, int], restarts: int, centres, n: int, salt: tuple[int, ...]) -> dict[tuple[int, int], np.ndarray]:
    """n further points of each unit, with probability in proportion to the distance from its centres.

    An exponential race: the points of the n least -ln(u) / D.  ``centres`` (a broadcast, or None for
    the first draw, in which all points are alike).  Points on a centre are never drawn.
    """
    def kernel(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Centres = centres.value if centres else {}
        held: dict[tuple[int, int], np.ndarray] = {}
        width = max((len(c) for own in known.values() for c in own.values()), default=1) * restarts
        for s, _, x, h, _ in _slices(frames, dims, width):
            if known:
                own = known[s]
                d = sq_dists(x, np.concatenate([own[r] for r in range(restarts)]))
                cuts = np.cumsum([len(own[r]) for r in range(restarts)])[:-1]
                near = [part.min(axis=1) for part in np.split(d, cuts, axis=1)]
            for r in range(restarts):
                race = -np.log(uniform(h, *salt, r))
                if known:
                    race = np.where(near[r] > 0, race / np.where(near[r] > 0, near[r], 1.0), np.inf)
                pick = np.argpartition(race, min(n, len(race)) - 1)[:n] if len(race) > n else np.arange(len(race))
                pick = pick[np.isfinite(race[pick])]
                new = np.concatenate([race[pick, None], x[pick]], axis=1)
                held[s, r] = _least(np.concatenate([held[s, r], new]) if (s, r) in held else new, n)
        yield from _put(held)

    def least(s: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return _least(np.concatenate([x, y]).reshape(-1, dims[s] + 1), n).ravel()

    got = passed(points, kernel, least)
    return {u: rows.reshape(-1, dims[u[0]] + 1)[:, 1:] for u, rows in got.items()}


def weigh(points: DataFrame, dims: Mapping[int, int], restarts: int, candidates) -> tuple[dict, dict[int, float]]:
    """How many points are nearest to each candidate of a unit; the mean variance of each slice's features."""
    def kernel(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Centres = candidates.value
        held: dict[tuple[int, int], np.ndarray] = {}
        width = max(len(c) for own in known.values() for c in own.values()) * restarts
        for s, _, x, _, _ in _slices(frames, dims, width):
            for r in range(restarts):
                own = known[s][r]
                n = np.bincount(sq_dists(x, own).argmin(axis=1), minlength=len(own)).astype(np.float64)
                held[s, r] = held[s, r] + n if (s, r) in held else n
            off = x - known[s][0][0]  # moments about a point of the slice
            moments = np.concatenate([[float(len(x))], off.sum(axis=0), (off * off).sum(axis=0)])
            held[s, -1] = held[s, -1] + moments if (s, -1) in held else moments
        yield from _put(held)

    got = passed(points, kernel, add)
    spread = {}
    for s, d in dims.items():
        if (s, -1) in got:
            n, total, squares = got[s, -1][0], got[s, -1][1:d + 1], got[s, -1][d + 1:]
            spread[s] = float(np.mean((squares - total * total / n) / (n - 1))) if n > 1 else 0.0
    return {u: w for u, w in got.items() if u[1] >= 0}, spread


def reduce_candidates(c: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator, steps: int = 20,
                      trials: int = 4) -> np.ndarray:
    """k starts from weighted candidates: greedy k-means++ on them, then a few weighted steps."""
    out = c[[rng.choice(len(c), p=weight / weight.sum())]]
    near = sq_dists(c, out)[:, 0]
    while len(out) < k:
        cost = near * weight
        if not cost.sum() > 0:  # fewer different points than centres
            out = np.concatenate([out, c[[len(out) % len(c)]]])
            continue
        tried = rng.choice(len(c), size=trials, p=cost / cost.sum())
        left = np.minimum(near[:, None], sq_dists(c, c[tried]))
        best = int((left * weight[:, None]).sum(axis=0).argmin())
        out, near = np.concatenate([out, c[[tried[best]]]]), left[:, best]
    for _ in range(steps):
        near = sq_dists(c, out).argmin(axis=1)
        new = out.copy()
        for i in range(k):
            own = near == i
            if weight[own].sum() > 0:
                new[i] = np.average(c[own], axis=0, weights=weight[own])
        if np.array_equal(new, out):
            break
        out = new
    return out


# ---- steps -----------------------------------------------------------------------------------

def step(points: DataFrame, dims: Mapping[int, int], centres) -> dict[tuple[int, int], tuple[float, np.ndarray, np.ndarray]]:
    """Of each unit that has centres: inertia, and for each cluster the number of points and their sum."""
    def kernel(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Centres = centres.value
        held: dict[tuple[int, int], np.ndarray] = {}
        own_dims = {s: d for s, d in dims.items() if s in known}
        width = max(sum(map(len, own.values())) for own in known.values())
        for s, _, x, _, _ in _slices(frames, own_dims, width):
            restarts = sorted(known[s])
            stacked = np.concatenate([known[s][r] for r in restarts])
            k = len(known[s][restarts[0]])
            d = sq_dists(x, stacked).reshape(len(x), len(restarts), k)
            near = d.argmin(axis=2)
            one_hot = np.zeros((len(x), len(restarts) * k))
            one_hot[np.arange(len(x))[:, None], near + np.arange(len(restarts)) * k] = 1.0
            sums = (one_hot.T @ x).reshape(len(restarts), k, -1)
            counts = one_hot.sum(axis=0).reshape(len(restarts), k)
            inertia = np.take_along_axis(d, near[:, :, None], axis=2).sum(axis=(0, 2))
            for i, r in enumerate(restarts):
                new = np.concatenate([[inertia[i]], counts[i], sums[i].ravel()])
                held[s, r] = held[s, r] + new if (s, r) in held else new
        yield from _put(held)

    out = {}
    for (s, r), payload in passed(points, kernel, add).items():
        k = (len(payload) - 1) // (dims[s] + 1)
        out[s, r] = payload[0], payload[1:k + 1], payload[k + 1:].reshape(k, dims[s])
    return out


def nearest(points: DataFrame, dims: Mapping[int, int], centres, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every point, its ``cluster`` and ``sq_dist``; distances by differences.

    centres: one array per slice, as restart 0.
    """
    schema = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in keep)

    def kernel(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Centres = centres.value
        width = max((own[0].size for own in known.values()), default=1)
        for s, rows, x, _, b in _slices(frames, dims, width):
            d = np.stack([((x - c) ** 2).sum(axis=1) for c in known[s][0]], axis=1)
            near = d.argmin(axis=1)
            kept = b.select(keep).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])],
                names=[*keep, "cluster", "sq_dist"])

    return points.mapInArrow(kernel, f"{schema}, cluster int, sq_dist double")
