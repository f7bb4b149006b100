"""k-means, on a bounded sample in the driver or over a whole table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.errors import InsufficientTrainingData, InvalidParameter
from nearfield.functions.metrics import Metric, prepare_array
from nearfield.functions.rng import SplitMix64

MOST_CENTROIDS = 256


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = (x**2).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids**2).sum(1)[None, :]
    return np.maximum(out, 0)


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroid of each row (the lowest of equal ones) and the squared distance to it."""
    which, d = np.empty(len(x), np.int64), np.empty(len(x))
    for a in range(0, len(x), 8192):
        near = squared_distances(x[a : a + 8192], centroids)
        which[a : a + 8192] = near.argmin(1)
        d[a : a + 8192] = near.min(1)
    return which, d


def spread_out(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ starts: each next one drawn with probability in proportion to its squared distance from those before."""
    rng = SplitMix64(seed)
    chosen = [rng.below(len(x))]
    d = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        total = d.sum()
        at = int(np.searchsorted(np.cumsum(d), rng.next_f64() * total, side="right")) if total > 0 else rng.below(len(x))
        chosen.append(min(at, len(x) - 1))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen].copy()


def _check(count: int, k: int) -> None:
    if not 1 <= k <= MOST_CENTROIDS:
        raise InvalidParameter(f"k={k} is not within 1 and {MOST_CENTROIDS}")
    if count < k:
        raise InsufficientTrainingData(k, count)


def _settled(before: float, now: float) -> bool:
    return abs(before - now) <= 1e-6 * max(abs(before), 1.0)


def kmeans(x: np.ndarray, k: int, iterations: int = 25, seed: int = 0) -> np.ndarray:
    """Lloyd's iterations until the total squared distance settles.

    A cluster without rows moves to the row that is served worst; a row serves one
    such cluster an iteration.
    """
    x = np.asarray(x, np.float64)
    _check(len(x), k)
    centroids = spread_out(x, k, seed)
    before = np.inf
    for turn in range(iterations):
        which, d = nearest_centroid(x, centroids)
        total = d.sum()
        counts = np.bincount(which, minlength=k)
        sums = np.stack([np.bincount(which, x[:, j], k) for j in range(x.shape[1])], 1)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            worst = np.argsort(-d, kind="stable")[: len(empty)]
            centroids[empty[: len(worst)]] = x[worst]
        if turn and _settled(before, total):
            break
        before = total
    return centroids


def bounded_sample(vectors: DataFrame, most: int, seed: int, vector_col: str = "vector", id_col: str = "id") -> np.ndarray:
    """At most ``most`` vectors, those of least hash of id and seed: the same ones however the table is split."""
    rows = vectors.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(most).select(vector_col).collect()
    return np.array([r[0] for r in rows], np.float64)


def kmeans_table(vectors: DataFrame, k: int, metric: str | Metric = "l2", iterations: int = 25, seed: int = 0, start_rows: int = 20_000) -> np.ndarray:
    """k-means over all rows of ``vectors(id, vector)``.

    Starts come from a bounded sample; an iteration sends k sums from each
    partition, and the worst-served rows one from each, so the driver sees
    nothing that grows with the table.
    """
    metric = Metric.parse(metric)
    start = prepare_array(metric, bounded_sample(vectors, start_rows, seed))
    _check(len(start), k)
    centroids = spread_out(start, k, seed)
    before = np.inf
    for turn in range(iterations):
        now = centroids

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            count, total, inertia = np.zeros(k, np.int64), np.zeros_like(now), 0.0
            worst: list[tuple[float, np.ndarray]] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = prepare_array(metric, batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                which, d = nearest_centroid(x, now)
                count += np.bincount(which, minlength=k)
                total += np.stack([np.bincount(which, x[:, j], k) for j in range(x.shape[1])], 1)
                inertia += float(d.sum())
                worst = sorted(worst + [(float(d[i]), x[i]) for i in np.argsort(-d)[:8]], key=lambda w: -w[0])[:8]
            rows = [(c, int(count[c]), total[c].tolist(), inertia if c == 0 else 0.0) for c in range(k)] + [(-1, 0, x.tolist(), d) for d, x in worst]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64()), strict=True)], names=["c", "n", "v", "d"])

        parts = vectors.where("vector is not null").select(F.col("vector").cast("array<double>")).mapInArrow(sums, "c int, n long, v array<double>, d double")
        added = parts.where("c >= 0").select("c", "n", "d", F.posexplode("v").alias("at", "x")).groupBy("c", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("d").alias("d"))
        rows = added.groupBy("c").agg(F.max("n").alias("n"), F.max("d").alias("d"), F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).collect()
        centroids = now.copy()
        empty = []
        total = 0.0
        for r in rows:
            total += r.d
            if r.n:
                centroids[r.c] = np.array([e.x for e in r.v]) / r.n
            else:
                empty.append(r.c)
        if empty:
            far = parts.where("c = -1").orderBy(F.col("d").desc()).limit(len(empty)).collect()
            for c, r in zip(sorted(empty), far, strict=False):
                centroids[c] = np.array(r.v)
        if turn and _settled(before, total):
            break
        before = total
    return centroids
