"""Exact top-k inner-product search as a Voronoi kNN join.

Pivots are the k-means centres of a sample, about the square root of the number of
vectors.  Data rows belong to the cell of their nearest pivot, and a cell's summary
holds its number of rows, the inner and outer radius about the pivot, the least and
largest norm, and the widest angle to the pivot.

Each query first goes to the cells whose pivots score best, just enough of them to
hold k candidates, and is solved there: its k-th best score is a threshold.  Then it
goes to every other cell whose upper bound reaches the threshold, the bound being the
least of three: by the ball about the pivot, by the ring between both radii, and by
the cone.  Cells and query sets of any size are split into blocks, so a task's memory is bounded.

How much the bounds exclude depends on the data: cells that are small against the
distances between them are skipped, while in many dimensions without clusters any
exact method compares nearly all.  ``figures`` reports it.

Of equal vectors only those of the k + 1 least distinct ids, k rows of each, can be
among anyone's k best; the others are left out before anything is dealt.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.storage import materialize

EXACT = 1 << 53


def quantized(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component as long; null unless all are there, finite and in the range of long."""
    fine = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) * scale >= float(1 << 62)))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point where no sum can leave 53 bits."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 62:
        return a @ b.T
    return np.array([[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a], object)


def centres(rows: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """At most ``n`` k-means centres of ``rows``, which begin with distinct vectors in random order."""
    x = rows.astype(np.float64)
    c = x[:n].copy()
    square = (x**2).sum(1)
    for _ in range(rounds):
        near = np.concatenate([(-2 * x[a : a + 4096] @ c.T + (c**2).sum(1)).argmin(1) for a in range(0, len(x), 4096)])
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[count > 0] = total[count > 0] / count[count > 0, None]
        empty = np.flatnonzero(count == 0)
        if len(empty):  # to the rows farthest from their centres
            away = square - 2 * (x * c[near]).sum(1) + (c[near] ** 2).sum(1)
            c[empty] = x[np.argsort(-away, kind="stable")[: len(empty)]]
    return c


class Pivots:
    """Pivots by length of vector; vectors of a length without pivots have a cell of their own."""

    def __init__(self, rows: list[tuple[int, ...]], share: float):
        self.cells: dict[int, tuple[int, np.ndarray]] = {}
        base = 0
        for dim in sorted({len(r) for r in rows}):
            own = np.array([r for r in rows if len(r) == dim], np.float64).reshape(-1, dim)
            self.cells[dim] = (base, centres(own, max(1, int(len(own) * share))))
            base += len(self.cells[dim][1])

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cell, distance from its pivot, norm, and cosine of the angle to the pivot of each row."""
        v = x.astype(np.float64)
        norm = np.sqrt((v**2).sum(1))
        if x.shape[1] not in self.cells:
            return np.full(len(x), -1 - x.shape[1]), np.zeros(len(x)), norm, np.ones(len(x))
        base, p = self.cells[x.shape[1]]
        step = max(1, (1 << 22) // len(p))
        near = np.concatenate([(-2 * v[a : a + step] @ p.T + (p**2).sum(1)).argmin(1) for a in range(0, len(v), step)])
        long = norm * np.sqrt((p[near] ** 2).sum(1))
        cosine = np.divide((v * p[near]).sum(1), long, out=np.ones(len(v)), where=long > 0)
        return base + near, np.sqrt(((v - p[near]) ** 2).sum(1)), norm, cosine


CELL = np.dtype([("cell", int), ("n", int), ("inner", float), ("outer", float), ("low", float), ("high", float), ("cosine", float)])


def upper_bounds(q: np.ndarray, p: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """What no row of each cell exceeds in its inner product with each query; ``p`` are the cells' pivots."""
    v = q.astype(np.float64)
    norm = np.sqrt((v**2).sum(1))[:, None]
    size = np.sqrt((p**2).sum(1))[None, :]
    product = v @ p.T
    ball = product + norm * cells["outer"]
    away = np.sqrt(np.maximum(norm**2 + size**2 - 2 * product, 0))
    gap = np.maximum(np.maximum(away - cells["outer"], cells["inner"] - away) - 1e-6 * (norm + size), 0)
    ring = (norm**2 + cells["high"] ** 2 - gap**2) / 2
    long = norm * size
    angle = np.arccos(np.clip(np.divide(product, long, out=np.ones_like(product), where=long > 0), -1, 1))
    widest = np.arccos(np.clip(cells["cosine"], -1, 1)) + 1e-6
    best = np.cos(np.maximum(angle - widest, 0))
    cone = np.where(long > 0, norm * np.where(best > 0, cells["high"], cells["low"]) * best, np.inf)
    slack = 1e-9 * (1 + norm**2 + cells["high"] ** 2)
    return np.minimum(np.minimum(ball, ring), cone) + slack


def _by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = np.diff(np.asarray(vectors.offsets))
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield at, _matrix(vectors.take(pa.array(at)))


def _assign(pivots: Pivots) -> Callable:
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("cell", pa.int32()), ("away", pa.float64()), ("norm", pa.float64()), ("cosine", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_length(batch.column(1)):
                cell, *others = pivots.assign(x)
                some = pa.array(at)
                yield pa.record_batch([batch.column(0).take(some), batch.column(1).take(some), pa.array(cell, pa.int32()), *map(pa.array, others)], schema=schema)

    return run


def _route(pivots: Pivots, summary: np.ndarray, k: int, first: bool) -> Callable:
    """Each query and its first cells, or the further ones that may hold a row that reaches its threshold.

    ``own`` of the rows have the query's id and don't count as candidates.
    """
    schema = pa.schema([("query_id", pa.int64()), ("q", pa.list_(pa.int64())), ("q_cell", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, q in _by_length(batch.column(1)):
                dim = q.shape[1]
                if dim not in pivots.cells:
                    if first:
                        some = pa.array(at)
                        yield pa.record_batch([batch.column(0).take(some), batch.column(1).take(some), pa.array(np.full(len(q), -1 - dim), pa.int32())], schema=schema)
                    continue
                base, p = pivots.cells[dim]
                cells = summary[(summary["cell"] >= base) & (summary["cell"] < base + len(p))]
                p = p[cells["cell"] - base]
                own, least = batch.column(2).to_numpy()[at], batch.column(3).to_numpy(zero_copy_only=False)[at].astype(float)
                step = max(1, (1 << 20) // max(len(cells), 1))
                for a in range(0, len(q), step):
                    part = slice(a, a + step)
                    order = np.argsort(-(q[part].astype(np.float64) @ p.T), axis=1, kind="stable")
                    before = np.cumsum(cells["n"][order], axis=1) - cells["n"][order]
                    nearest = np.empty(order.shape, bool)
                    np.put_along_axis(nearest, order, before < k + own[part, None], 1)
                    if first:
                        row, col = np.nonzero(nearest)
                    else:
                        low = np.where(np.isnan(least[part]), -np.inf, least[part])[:, None]
                        row, col = np.nonzero(~nearest & (upper_bounds(q[part], p, cells) >= low))
                    some = pa.array(at[part][row])
                    yield pa.record_batch([batch.column(0).take(some), batch.column(1).take(some), pa.array(cells["cell"][col], pa.int32())], schema=schema)

    return run


def _solve(k: int) -> Callable:
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        if not data.num_rows or not queries.num_rows:
            return schema.empty_table()
        ids, qids = data.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
        order = np.argsort(ids, kind="stable")  # then the first of equal scores has the least id
        ids, x = ids[order], _matrix(data.column("v"))[order]
        q = _matrix(queries.column("q"))
        out = []
        for a in range(0, len(q), 256):
            scores = _products(q[a : a + 256], x)
            for i, row in enumerate(scores):
                own = np.flatnonzero(ids != qids[a + i])
                some = row[own]
                if len(some) > k:
                    edge = np.partition(some, len(some) - k)[len(some) - k]
                    above = own[some > edge]
                    own = np.concatenate([above, own[some == edge][: k - len(above)]])
                out.append((np.full(len(own), qids[a + i]), ids[own], row[own]))
        return pa.table([pa.array(np.concatenate([o[j] for o in out]).astype(np.int64)) for j in range(3)], schema=schema)

    return run


def search(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024, sample: int = 16, block: int = 16384, figures: dict | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best other rows of each row for which ``is_query`` holds.

    Components become ``floor(scale * x)``; a score is the integer inner product;
    of equal scores the smaller id is better.  Queries with fewer than ``k``
    candidates get all of them.

    Rows with a null id, a null vector, or a vector with a null or non-finite
    component take no part.  Vectors meet only vectors of their own length.
    Repeated rows: a row repeated with its id and vector is one query, and a
    candidate as often as it occurs (up to ``k`` times).  A query's own id is
    never its candidate.  Other columns are ignored; an empty table gives no rows.
    Of n vectors ``sample * sqrt(n)`` (those of least hash) come to the driver, to
    place sqrt(n) pivots.  ``figures`` receives how many pairs there are, and how many were compared.
    """
    spark = vectors.sparkSession
    whole = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantized(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("vec_id is not null and v is not null")
    equal = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    distinct = materialize(whole.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("place", equal).where(F.col("place") <= k + 1).drop("place"), "voronoi-distinct")
    root = max(1, math.isqrt(distinct.count()))
    chosen = distinct.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample * root).collect()
    pivots = Pivots(list(dict.fromkeys(tuple(r.v) for r in chosen)), 1 / sample)
    data = distinct.select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k))))).drop("col")
    placed = materialize(data.mapInArrow(_assign(pivots), "vec_id long, v array<long>, cell int, away double, norm double, cosine double"), "voronoi-data")
    # one row a cell: about the square root of the table, and one for each further length of vector
    limits = [f("away") for f in (F.min, F.max)] + [f("norm") for f in (F.min, F.max)] + [F.min("cosine")]
    summary = np.array(sorted(tuple(r) for r in placed.groupBy("cell").agg(F.count(F.lit(1)), *limits).collect()), CELL)
    repeated = placed.groupBy("vec_id").agg(F.count(F.lit(1)).alias("own")).where("own > 1")
    asking = whole.where("asks").select("vec_id", "v").dropDuplicates().join(repeated, "vec_id", "left").select("vec_id", "v", F.coalesce("own", F.lit(1)).alias("own"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))

    def solve(queries: DataFrame, first: bool) -> DataFrame:
        routed = materialize(queries.mapInArrow(_route(pivots, summary, k, first), "query_id long, q array<long>, q_cell int"), "voronoi-queries")
        asked = {r.q_cell: r.n for r in routed.groupBy("q_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        if figures is not None:
            figures["compared"] = figures.get("compared", 0) + sum(n * asked.get(cell, 0) for cell, n in zip(summary["cell"].tolist(), summary["n"].tolist(), strict=True))
        sizes = [(cell, -(-n // block), -(-asked[cell] // block)) for cell, n in zip(summary["cell"].tolist(), summary["n"].tolist(), strict=True) if cell in asked]
        blocks = F.broadcast(spark.createDataFrame(sizes, "cell int, parts int, q_parts int"))  # one row a cell
        left = placed.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)).alias("q_part"), "vec_id", "v")
        right = routed.join(blocks.withColumnRenamed("cell", "q_cell"), "q_cell").select("q_cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("of_part"), F.pmod(F.xxhash64("query_id"), "q_parts").cast("int").alias("own_part"), "query_id", "q")
        found = left.groupBy("cell", "part", "q_part").cogroup(right.groupBy("q_cell", "of_part", "own_part")).applyInArrow(_solve(k), "query_id long, vec_id long, score long")
        return found.withColumn("rank", best).where(F.col("rank") <= k)

    near = materialize(solve(asking.withColumn("least", F.lit(None).cast("double")), True), "voronoi-first")
    # a score as double may be off in its last bits, so the threshold is lowered by as much
    least = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), (F.col("score") - F.abs("score") * 1e-12).cast("double").alias("least"))
    far = solve(asking.join(least, "vec_id", "left").select("vec_id", "v", "own", "least"), False)
    if figures is not None:
        figures["pairs"] = int(summary["n"].sum()) * asking.count()
    both = near.unionByName(far).withColumn("rank", best).where(F.col("rank") <= k)
    return both.select("query_id", "rank", "vec_id", "score")
