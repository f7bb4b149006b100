"""Product quantization: one of up to 256 centroids for each part of a vector."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.errors import DimensionMismatch, InvalidParameter
from nearfield.operators.clustering import MOST_CENTROIDS, kmeans, nearest_centroid, squared_distances
from nearfield.operators.exact import HITS, best_of_batches, best_rows, in_blocks, rank_hits


@dataclass(frozen=True, eq=False)
class ProductQuantizer:
    """``codebooks[part, centroid]`` is a vector of ``dim / m`` components."""

    codebooks: np.ndarray

    def __post_init__(self):
        if self.codebooks.ndim != 3 or not 1 <= self.codebooks.shape[1] <= MOST_CENTROIDS or 0 in self.codebooks.shape:
            raise InvalidParameter(f"codebooks of shape {self.codebooks.shape}")

    @property
    def m(self) -> int:
        return self.codebooks.shape[0]

    @property
    def ksub(self) -> int:
        return self.codebooks.shape[1]

    @property
    def dim(self) -> int:
        return self.codebooks.shape[0] * self.codebooks.shape[2]

    @property
    def code_len(self) -> int:
        return self.m

    @property
    def codebook_bytes(self) -> int:
        return 4 * self.codebooks.size

    @classmethod
    def train_array(cls, x: np.ndarray, m: int, ksub: int = 256, iterations: int = 25, seed: int = 0) -> ProductQuantizer:
        x = np.asarray(x, np.float64)
        if m < 1 or x.shape[1] % m:
            raise InvalidParameter(f"{x.shape[1]} dimensions don't split into {m} parts")
        parts = x.reshape(len(x), m, -1)
        return cls(np.stack([kmeans(parts[:, s], ksub, iterations, seed + s) for s in range(m)]))

    @classmethod
    def train(cls, vectors: DataFrame, m: int, ksub: int = 256, iterations: int = 25, train_limit: int = 100_000, seed: int = 0) -> ProductQuantizer:
        """Train on a bounded sample of ``vectors(id, vector)``, one task for each part.

        ``train_limit`` of 0 means all rows, which the sample's tasks must then hold.
        """
        rows = vectors.where("vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector"))
        if train_limit:
            rows = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(train_limit)
        first = rows.select(F.size("vector")).first()
        dim = first[0] if first else 0
        if not dim or m < 1 or dim % m:
            raise InvalidParameter(f"{dim} dimensions don't split into {m} parts")
        width = dim // m
        cut = rows.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda s: F.slice("vector", s * width + 1, width))).alias("part", "piece"))

        def fit(key: tuple, table: pa.Table) -> pa.Table:
            part = key[0].as_py()
            table = table.sort_by("id")
            x = table.column("piece").combine_chunks().flatten().to_numpy().reshape(table.num_rows, width)
            book = kmeans(x, ksub, iterations, seed + part)
            return pa.table({"part": pa.array([part] * ksub, pa.int32()), "centroid": pa.array(range(ksub), pa.int32()), "vector": pa.array(book.tolist(), pa.list_(pa.float64()))})

        books = cut.groupBy("part").applyInArrow(fit, "part int, centroid int, vector array<double>").orderBy("part", "centroid").collect()
        return cls(np.array([r.vector for r in books]).reshape(m, ksub, width))

    @classmethod
    def from_table(cls, books: DataFrame) -> ProductQuantizer:
        """From rows ``(part, centroid, vector)``, of which there are at most 256 a part."""
        rows = books.orderBy("part", "centroid").collect()
        m = max(r.part for r in rows) + 1
        if len(rows) % m:
            raise InvalidParameter("parts have unequal numbers of centroids")
        return cls(np.array([r.vector for r in rows]).reshape(m, len(rows) // m, -1))

    def to_table(self, spark) -> DataFrame:
        return spark.createDataFrame([(s, c, [float(x) for x in v]) for s, book in enumerate(self.codebooks) for c, v in enumerate(book)], "part int, centroid int, vector array<double>")

    def encode_array(self, x: np.ndarray) -> np.ndarray:
        if x.shape[1] != self.dim:
            raise DimensionMismatch(self.dim, x.shape[1])
        parts = np.asarray(x, np.float64).reshape(len(x), self.m, -1)
        return np.stack([nearest_centroid(parts[:, s], self.codebooks[s])[0] for s in range(self.m)], 1).astype(np.int16)

    def encode(self, vectors: DataFrame) -> DataFrame:
        """``(id, codes)`` of ``vectors(id, vector)``."""
        quantizer = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    yield pa.record_batch([batch.column(0), pa.array(list(quantizer.encode_array(x)), pa.list_(pa.int16()))], names=["id", "codes"])

        return vectors.where("vector is not null").select("id", "vector").mapInArrow(run, "id long, codes array<short>")

    def decode_array(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.codebooks[s][codes[:, s]] for s in range(self.m)], 1)

    def distance_table(self, query: np.ndarray) -> np.ndarray:
        """Squared distance of each part of the query to each centroid, for asymmetric distances."""
        if len(query) != self.dim:
            raise DimensionMismatch(self.dim, len(query))
        parts = np.asarray(query, np.float64).reshape(self.m, 1, -1)
        return np.stack([squared_distances(parts[s], self.codebooks[s])[0] for s in range(self.m)])

    def distances(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of each query to each row of codes, added up part by part."""
        if queries.shape[1] != self.dim:
            raise DimensionMismatch(self.dim, queries.shape[1])
        parts = np.asarray(queries, np.float64).reshape(len(queries), self.m, 1, -1)
        out = np.zeros((len(queries), len(codes)))
        for s in range(self.m):
            out += np.take(((parts[:, s] - self.codebooks[s]) ** 2).sum(2), codes[:, s], axis=1)
        return out

    def nearest(self, qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, codes: np.ndarray, k: int, decimals: int | None = None, scale: float = 1.0) -> list[np.ndarray]:
        """``qid``, ``id`` and ``scale`` times the distance, as arrays, of the ``k`` rows of codes nearest to each query, ties by id."""
        parts: list[tuple] = []
        for a in range(0, len(queries), 64):
            d = self.distances(queries[a : a + 64], codes) * scale
            d = d if decimals is None else np.round(d, decimals)
            for i, row in enumerate(d):
                best = best_rows(row, ids, k)
                parts.append((np.full(len(best), qids[a + i]), ids[best], row[best]))
        return [np.concatenate([p[j] for p in parts]) if parts else np.zeros(0) for j in range(3)]

    def search(self, codes: DataFrame, queries: DataFrame, k: int, decimals: int | None = None, small: int = 4096, block: int = 4096) -> DataFrame:
        """``(qid, rank, id, distance)``: for each of ``queries(qid, vector)`` the ``k`` rows of ``codes(id, codes)`` of least asymmetric distance.

        The best are kept next to the codes, so pairs never become rows.  Up to ``small``
        queries are sent to all tasks, more meet the codes in blocks.  Distances
        are ranked after rounding to ``decimals``, if given.
        """
        asked = queries.where("vector is not null").select("qid", F.col("vector").cast("array<double>").alias("vector"))
        if k <= 0:
            return rank_hits(codes.limit(0).select(F.col("id").alias("qid"), "id", F.lit(0.0).alias("distance")), 0)
        first = asked.limit(small + 1).collect()
        near: Callable = lambda qids, q, ids, c: self.nearest(qids, q, ids, _rows_of(c, self.m), k, decimals)
        for r in first:
            if len(r.vector) != self.dim:
                raise DimensionMismatch(self.dim, len(r.vector))
        codes = codes.select("id", "codes")
        if len(first) > small:
            return rank_hits(in_blocks(codes, asked, lambda qids, q, ids, c: near(qids, _rows_of(q, self.dim), ids, c), block), k)
        qids, q = np.array([r.qid for r in first], np.int64), np.array([r.vector for r in first], np.float64).reshape(len(first), self.dim)
        return rank_hits(codes.mapInArrow(best_of_batches(lambda ids, c: near(qids, q, ids, c), k), HITS), k)

    @staticmethod
    def distance_from_table(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return table[np.arange(table.shape[0]), codes].sum(axis=-1)

    def distance(self, query: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.distance_from_table(self.distance_table(query), codes)


def _rows_of(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wrong = (sizes := np.diff(np.asarray(column.offsets))) != width
    if wrong.any():
        raise DimensionMismatch(width, int(sizes[wrong][0]))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def distances_by_join(codes: DataFrame, queries: DataFrame, books: DataFrame, most_sent: int = 4096, block: int = 1024) -> DataFrame:
    """``(qid, id, distance)`` of each query and coded row, from given codebooks, with columns only.

    The look-up table has a row for each query, with 256 numbers a part at most.
    That of up to ``most_sent`` queries is sent to all tasks; a larger one is
    dealt into blocks of queries that meet blocks of codes.  The result has a row
    for each pair; for the nearest alone take :meth:`ProductQuantizer.search`.
    """
    m = F.broadcast(books.groupBy().agg((F.max("part") + 1).alias("m")))
    cut = queries.crossJoin(m).select("qid", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda s: F.slice("vector", (s * (F.size("vector") / F.col("m"))).cast("int") + 1, (F.size("vector") / F.col("m")).cast("int")))).alias("part", "piece"))
    square = F.aggregate(F.zip_with(F.col("piece").cast("array<double>"), F.col("vector"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    entries = cut.join(F.broadcast(books), "part").select("qid", "part", "centroid", square.alias("d"))
    tables = entries.groupBy("qid", "part").agg(F.sort_array(F.collect_list(F.struct("centroid", "d"))).alias("row")).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "row"))), lambda p: F.transform(p["row"], lambda e: e["d"])).alias("parts"))
    if queries.limit(most_sent + 1).count() <= most_sent:
        pairs = codes.crossJoin(F.broadcast(tables))
    else:
        q_parts, parts = -(-queries.count() // block), max(1, -(-codes.count() // (64 * block)))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = codes.select("*", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("of_codes"), every(q_parts).alias("of_queries"))
        right = tables.select("*", F.pmod(F.xxhash64("qid"), F.lit(q_parts)).cast("int").alias("of_queries"), every(parts).alias("of_codes"))
        pairs = left.join(right, ["of_codes", "of_queries"])
    looked = F.zip_with("codes", "parts", lambda c, row: F.element_at(row, c.cast("int") + 1))
    return pairs.select("qid", "id", F.aggregate(looked, F.lit(0.0), lambda s, x: s + x).alias("distance"))
