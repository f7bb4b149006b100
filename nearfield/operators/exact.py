"""Exact nearest neighbours and the measures of approximate ones.

Single queries plan as TakeOrderedAndProject.  Batches keep the k best of each
block next to the rows (numpy) and then of each query (a ranked window, which
Spark limits before its shuffle).  A query set of up to ``small`` rows is sent to
all tasks; a larger one is cut into blocks that meet blocks of rows.  Vectors of
another length than the queries fail both, as they do the plan of columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.errors import DimensionMismatch
from nearfield.functions.metrics import Metric, distance_prepared, distances_batch, l2_squared_batch, prepare, prepare_array, vector_literal

HITS = "qid long, id long, distance double"
_HITS = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])


def check_width(vectors: DataFrame, dim: int, vector_col: str = "vector") -> None:
    """Raise if a vector hasn't ``dim`` components; one aggregation over the lengths."""
    low, high = vectors.agg(F.min(F.size(vector_col)), F.max(F.size(vector_col))).first()
    for n in (low, high):
        if n is not None and n != dim:
            raise DimensionMismatch(dim, n)


def check_one_width(queries: DataFrame) -> int:
    """The length of all queries' vectors; 0 without any."""
    low, high = queries.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if low != high:
        raise DimensionMismatch(low, high)
    return low or 0


def of_width(vector: Column, dim: Column) -> Column:
    """``vector``, null where it is null; the query fails where it hasn't ``dim`` components."""
    wrong = F.raise_error(F.concat(F.lit("dimension mismatch: expected "), dim.cast("string"), F.lit(", got "), F.size(vector).cast("string")))
    return F.when(vector.isNull() | (F.size(vector) == dim), vector).otherwise(wrong.cast("array<double>"))


def knn(vectors: DataFrame, query: list[float], k: int, metric: str | Metric = "l2", where: Column | None = None) -> DataFrame:
    """``(id, distance)`` of the ``k`` rows of ``vectors(id, vector, ...)`` nearest to one query, ties by id.

    ``where`` is applied before distances, so it reaches the scan.  A vector of
    another length fails the query.
    """
    metric = Metric.parse(metric)
    q = [float(x) for x in prepare_array(metric, np.asarray(query, np.float64))]
    rows = vectors if where is None else vectors.where(where)
    near = rows.select("id", distance_prepared(metric, prepare(metric, of_width(F.col("vector"), F.lit(len(q)))), vector_literal(q)).alias("distance"))
    return near.where("distance is not null").orderBy("distance", "id").limit(max(k, 0))


def best_rows(distances: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k least (distance, id)."""
    if len(ids) > 4 * k:
        edge = np.partition(distances, k - 1)[k - 1]
        some = np.flatnonzero(distances <= edge)
    else:
        some = np.arange(len(ids))
    return some[np.lexsort((ids[some], distances[some]))[:k]]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``dim`` components; a row of another length raises."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wrong = (sizes := np.diff(np.asarray(column.offsets))) != dim
    if wrong.any():
        raise DimensionMismatch(dim, int(sizes[wrong][0]))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _nearest(metric: Metric, qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, block: np.ndarray, k: int) -> list[np.ndarray]:
    """Columns of :data:`HITS`; both sides prepared."""
    parts: list[tuple] = []
    square = (block**2).sum(1) if metric is Metric.L2 else None
    for a in range(0, len(queries), 64):
        some = queries[a : a + 64]
        if square is None or len(block) <= 4 * k:
            near = [(np.arange(len(block)), row) for row in distances_batch(metric, some, block)]
        else:  # by one product, which is off by less than the slack; those within reach again by differences
            own = (some**2).sum(1)
            rough = square - 2 * some @ block.T
            edge = np.partition(rough, k - 1, axis=1)[:, k - 1] + 1e-9 * (own + square.max())
            near = [(at, l2_squared_batch(q, block[at])) for q, at in zip(some, (np.flatnonzero(r <= e) for r, e in zip(rough, edge, strict=True)), strict=True)]
        for i, (at, row) in enumerate(near):
            best = best_rows(row, ids[at], k)
            parts.append((np.full(len(best), qids[a + i]), ids[at[best]], row[best]))
    return [np.concatenate([p[j] for p in parts]) if parts else np.zeros(0) for j in range(3)]


def _scan(metric: Metric, qids: np.ndarray, queries: np.ndarray, k: int) -> Callable:
    return best_of_batches(lambda ids, v: _nearest(metric, qids, queries, ids, prepare_array(metric, _matrix(v, queries.shape[1])), k), k)


def best_of_batches(near: Callable, k: int) -> Callable:
    """For ``mapInArrow``: of the hits that ``near(ids, *other columns)`` finds in each batch, the ``k`` best of each query in all of a task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(near(batch.column(0).to_numpy(), *batch.columns[1:]))
            if len(kept) > 8:
                kept = [_merge(kept, k)]
        if kept:
            columns = _merge(kept, k)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _HITS, strict=True)], schema=_HITS)

    return run


def _merge(kept: list[list[np.ndarray]], k: int) -> list[np.ndarray]:
    qid, ids, d = (np.concatenate([x[j] for x in kept]) for j in range(3))
    order = np.lexsort((ids, d, qid))
    qid, ids, d = qid[order], ids[order], d[order]
    first = np.searchsorted(qid, qid)
    own = np.arange(len(qid)) - first < k
    return [qid[own], ids[own], d[own]]


def rank_hits(found: DataFrame, k: int) -> DataFrame:
    """``(qid, rank, id, distance)``: the k best of each query, ranks from 1."""
    order = Window.partitionBy("qid").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "distance")


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, metric: str | Metric = "l2", where: Column | None = None, strategy: str = "numpy", small: int = 4096, block: int = 4096, spread: int | None = None) -> DataFrame:
    """``(qid, rank, id, distance)`` for each row of ``queries(qid, vector)``.

    ``strategy``: ``numpy`` or ``sql`` (column expressions only; for small query
    sets).  Rows and queries must have vectors of one length, or the query fails
    with a dimension mismatch; rows with a null vector take no part.  ``k`` of 0 or less gives no rows.
    """
    metric = Metric.parse(metric)
    rows = vectors if where is None else vectors.where(where)
    rows = rows.where("vector is not null").select("id", "vector")
    asked = queries.where("vector is not null").select("qid", "vector")
    if k <= 0:
        return rank_hits(rows.limit(0).select(F.col("id").alias("qid"), "id", F.lit(0.0).alias("distance")), 0)
    if strategy == "sql":
        return _by_columns(rows, asked, k, metric, small)
    first = asked.limit(small + 1).collect()
    if len(first) <= small:
        if not first:
            return rank_hits(rows.limit(0).select(F.col("id").alias("qid"), "id", F.lit(0.0).alias("distance")), k)
        width = {len(r.vector) for r in first}
        if len(width) > 1:
            raise DimensionMismatch(min(width), max(width))
        qids = np.array([r.qid for r in first], np.int64)
        q = prepare_array(metric, np.array([r.vector for r in first], np.float64))
        if spread:
            rows = rows.repartition(spread)
        return rank_hits(rows.mapInArrow(_scan(metric, qids, q, k), HITS), k)
    dim = check_one_width(asked)

    def near(qids: np.ndarray, q: pa.Array, ids: np.ndarray, v: pa.Array) -> list[np.ndarray]:
        return _nearest(metric, qids, prepare_array(metric, _matrix(q, dim)), ids, prepare_array(metric, _matrix(v, dim)), k)

    return rank_hits(in_blocks(rows, asked, near, block), k)


#: Vectors of up to so many components become a column for each, which Spark compiles; rows that bound the distances first.
COLUMNS, BOUND_ROWS = 64, 4096


def _by_columns(rows: DataFrame, asked: DataFrame, k: int, metric: Metric, small: int) -> DataFrame:
    """:func:`knn_batch` by column expressions only.

    The k-th best among about :data:`BOUND_ROWS` rows bounds each query's k-th
    distance, so that only the few pairs within it are ranked.
    """
    dim = check_one_width(asked)
    flat = 0 < dim <= COLUMNS

    def side(table: DataFrame, key: str, name: str, *more: str) -> DataFrame:
        vector = prepare(metric, of_width(F.col("vector"), F.lit(dim)) if dim else F.col("vector"))
        table = table.select(key, vector.alias(name), *more)
        if not flat:
            return table
        return table.where(~F.exists(name, lambda x: x.isNull())).select(key, *[F.coalesce(F.get(name, F.lit(i)), F.lit(0.0)).alias(f"{name}{i}") for i in range(dim)], *more)

    def away() -> Column:
        if not flat:
            return distance_prepared(metric, F.col("q"), F.col("v"))
        out = F.lit(0.0)
        for i in range(dim):
            q, v = F.col(f"q{i}"), F.col(f"v{i}")
            out = out + ((q - v) * (q - v) if metric is Metric.L2 else q * v)
        return out if metric is Metric.L2 else 1 - out if metric is Metric.COSINE else -out

    def pairs(some: DataFrame, queries: DataFrame) -> DataFrame:
        return side(some, "id", "v").crossJoin(F.broadcast(queries) if sent else queries)

    sent = asked.limit(small * 16 + 1).count() <= small * 16
    parts = max(1, rows.count() // BOUND_ROWS)
    if parts > 1:
        some = rows.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == 0)
        best = rank_hits(pairs(some, side(asked, "qid", "q")).select("qid", "id", away().alias("distance")).where("distance is not null"), k)
        bounds = best.where(F.col("rank") == k).groupBy("qid").agg(F.max("distance").alias("bound"))
        asked = asked.join(bounds, "qid", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))).localCheckpoint()
        near = pairs(rows, side(asked, "qid", "q", "bound")).where(away() <= F.col("bound"))
    else:
        near = pairs(rows, side(asked, "qid", "q"))
    return rank_hits(near.select("qid", "id", away().alias("distance")).where("distance is not null"), k)


def in_blocks(rows: DataFrame, asked: DataFrame, near: Callable, block: int) -> DataFrame:
    """:data:`HITS` by ``near(qids, vectors, ids, what)`` of each block of ``asked(qid, vector)`` and each of ``rows``, an id and another column."""
    what = next(c for c in rows.columns if c != "id")
    parts = max(1, -(-rows.count() // (8 * block)))
    q_parts = max(1, -(-asked.count() // block))
    left = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))).alias("q_part"), "id", what)
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("of_part"), F.pmod(F.xxhash64("qid"), F.lit(q_parts)).cast("int").alias("own_part"), "qid", F.col("vector").alias("q"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _HITS.empty_table()
        columns = near(b.column("qid").to_numpy(), b.column("q"), a.column("id").to_numpy(), a.column(what))
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _HITS, strict=True)], schema=_HITS)

    return left.groupBy("part", "q_part").cogroup(right.groupBy("of_part", "own_part")).applyInArrow(meet, HITS)


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row ``recall``: shared ids among the first k of each query, over k times the queries of ``truth``; 0 if there are none."""
    if k <= 0:
        return truth.sparkSession.range(1).select(F.lit(0.0).alias("recall"))
    a = found.where(F.col("rank") <= k).select("qid", "id").distinct()
    b = truth.where(F.col("rank") <= k).select("qid", "id").distinct()
    shared = a.join(b, ["qid", "id"]).agg(F.count(F.lit(1)).alias("shared"))
    asked = truth.agg(F.count_distinct("qid").alias("asked"))
    return shared.crossJoin(asked).select(F.coalesce(F.try_divide(F.col("shared").cast("double"), F.col("asked") * k), F.lit(0.0)).alias("recall"))


def mrr(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row ``mrr``: mean over all queries of one over the rank at which the true nearest id was found, 0 if it wasn't."""
    best = truth.where("rank = 1").select("qid", "id")
    at = best.join(found.groupBy("qid", "id").agg(F.min("rank").alias("rank")), ["qid", "id"], "left")
    return at.agg(F.coalesce(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"))
