"""Inverted-file indexes, flat or product-quantized, persisted as Parquet by list.

A search ranks the lists for each query in the driver (at most 256 centroids),
reads only those that some query probes (a literal filter on the partition
column, so Spark prunes the others), and scores a list's rows for the queries that
probe it, keeping the best of each query in a task.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.errors import DimensionMismatch, EmptyIndex, InsufficientTrainingData, InvalidParameter
from nearfield.functions.metrics import Metric, distance, prepare_array
from nearfield.operators.clustering import MOST_CENTROIDS, bounded_sample, kmeans, nearest_centroid, squared_distances
from nearfield.operators.exact import HITS, _nearest, best_of_batches, rank_hits
from nearfield.operators.product_quantizer import ProductQuantizer
from nearfield.sources import files


#: Queries that one search sends to all tasks.
TOGETHER = 65_536


@dataclass(frozen=True)
class IvfConfig:
    """``pq_m`` of 0 keeps the vectors; ``residual`` codes what is left after the list's centroid."""

    nlist: int = 256
    nprobe: int = 16
    pq_m: int = 0
    ksub: int = 256
    list_iterations: int = 25
    pq_iterations: int = 25
    train_limit: int = 100_000
    seed: int = 1
    residual: bool = True

    def check(self, dim: int, metric: Metric) -> None:
        if not 1 <= self.nlist <= MOST_CENTROIDS:
            raise InvalidParameter(f"nlist={self.nlist} is not within 1 and {MOST_CENTROIDS}")
        if self.pq_m and dim % self.pq_m:
            raise InvalidParameter(f"{dim} dimensions don't split into {self.pq_m} parts")
        if self.pq_m and not 1 <= self.ksub <= MOST_CENTROIDS:
            raise InvalidParameter(f"ksub={self.ksub} is not within 1 and {MOST_CENTROIDS}")
        if self.pq_m and metric is Metric.INNER_PRODUCT:
            raise InvalidParameter("product-quantized lists don't serve inner product")
        if self.train_limit < 1:
            raise InvalidParameter("train_limit must be positive")


class IvfIndex:
    """An index under a folder: ``model.json`` and rows ``(id, seq, live, vector, codes)`` partitioned by ``list``.

    Writes append; the newest row of an id counts, so an upsert may move it to
    another list.  ``compact`` rewrites the newest rows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        model = json.loads(files.read_text(spark, f"{self.path}/model.json"))
        self.dim, self.metric, self.config = model["dim"], Metric.parse(model["metric"]), IvfConfig(**model["config"])
        self.version = model["version"]
        self.pure = model["pure"]  # every id has one row, so that no search needs to look for newer ones
        self.centroids = np.array(model["centroids"])
        self.quantizer = ProductQuantizer(np.array(model["codebooks"])) if model["codebooks"] else None

    # building

    @classmethod
    def train(cls, vectors: DataFrame, path: str, metric: str | Metric = "l2", config: IvfConfig = IvfConfig()) -> IvfIndex:  # noqa: B008
        """Train on a bounded sample of ``vectors(id, vector)`` and store all of them."""
        metric = Metric.parse(metric)
        spark = vectors.sparkSession
        sample = bounded_sample(vectors, config.train_limit, config.seed)
        if not len(sample):
            raise EmptyIndex("no vectors to train on")
        config.check(sample.shape[1], metric)
        x = prepare_array(metric, sample)
        if len(x) < max(config.nlist, config.ksub if config.pq_m else 0):
            raise InsufficientTrainingData(max(config.nlist, config.ksub if config.pq_m else 0), len(x))
        centroids = kmeans(x, config.nlist, config.list_iterations, config.seed)
        books = None
        if config.pq_m:
            rest = x - centroids[nearest_centroid(x, centroids)[0]] if config.residual else x
            books = ProductQuantizer.train_array(rest, config.pq_m, config.ksub, config.pq_iterations, config.seed).codebooks.tolist()
        model = {"dim": sample.shape[1], "metric": str(metric), "config": asdict(config), "centroids": centroids.tolist(), "codebooks": books, "version": 0, "pure": True}
        files.write_text(spark, f"{path.rstrip('/')}/model.json", json.dumps(model))
        index = cls(spark, path)
        index.insert(vectors)
        return index

    def _folder(self) -> str:
        return f"{self.path}/lists-{self.version}"

    def _rows(self) -> DataFrame:
        return self.spark.read.schema("id long, seq long, live boolean, vector array<double>, codes array<short>, list int").parquet(self._folder())

    def _exists(self) -> bool:
        return files.exists(self.spark, self._folder())

    def _next_seq(self) -> int:
        return (self._rows().agg(F.max("seq")).first()[0] or 0) + 1 if self._exists() else 1

    def insert(self, vectors: DataFrame) -> None:
        """Append ``vectors(id, vector)``; an id that is there is replaced."""
        placed = vectors.where("vector is not null").select(F.col("id").cast("long"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(self._place(), "id long, vector array<double>, codes array<short>, list int")
        self._append(placed.select("id", F.lit(self._next_seq()).alias("seq"), F.lit(True).alias("live"), "vector", "codes", "list"))

    def delete(self, ids: DataFrame) -> int:
        """Mark ids as deleted; returns how many live ones were among them."""
        here = self.live().join(ids.select("id").distinct(), "id", "left_semi")
        n = here.count()
        if n:
            self._append(here.select("id", F.lit(self._next_seq()).alias("seq"), F.lit(False).alias("live"), F.lit(None).cast("array<double>").alias("vector"), F.lit(None).cast("array<short>").alias("codes"), "list"))
        return n

    def _set(self, **changes) -> None:
        path = f"{self.path}/model.json"
        files.write_text(self.spark, path, json.dumps(json.loads(files.read_text(self.spark, path)) | changes))

    def _append(self, rows: DataFrame) -> None:
        if self._exists() and self.pure:
            self.pure = False  # before the rows are there: a reader that comes between looks for newer ones in vain
            self._set(pure=False)
        rows.repartition("list").write.mode("append").partitionBy("list").parquet(self._folder())

    def _place(self) -> Callable:
        dim, metric, centroids, quantizer, residual = self.dim, self.metric, self.centroids, self.quantizer, self.config.residual
        schema = pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.float64())), ("codes", pa.list_(pa.int16())), ("list", pa.int32())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                lengths = np.diff(np.asarray(batch.column(1).offsets))
                if (lengths != dim).any():
                    raise DimensionMismatch(dim, int(lengths[lengths != dim][0]))
                x = prepare_array(metric, batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                where, _ = nearest_centroid(x, centroids)  # by squared distance for every metric
                if quantizer is None:
                    codes, kept = pa.nulls(len(x), pa.list_(pa.int16())), pa.array(list(x), pa.list_(pa.float64()))
                else:
                    codes = pa.array(list(quantizer.encode_array(x - centroids[where] if residual else x)), pa.list_(pa.int16()))
                    kept = pa.nulls(len(x), pa.list_(pa.float64()))
                yield pa.record_batch([batch.column(0), kept, codes, pa.array(where, pa.int32())], schema=schema)

        return run

    def live(self) -> DataFrame:
        """The newest row of each live id."""
        newest = F.row_number().over(Window.partitionBy("id").orderBy(F.col("seq").desc()))
        return self._rows().withColumn("newest", newest).where("newest = 1 and live").drop("newest", "live")

    # searching

    def probe_order(self, queries: np.ndarray, nprobe: int | None = None) -> np.ndarray:
        """The nearest lists of each query, ties by number."""
        n = min(max(nprobe or self.config.nprobe, 1), len(self.centroids))
        return np.argsort(squared_distances(prepare_array(self.metric, queries), self.centroids), axis=1, kind="stable")[:, :n]

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """``(qid, rank, id, distance)`` for ``queries(qid, vector)``; ``allowed(id)`` limits the hits.

        Up to :data:`TOGETHER` queries are sent to the tasks at once; a larger set is searched part by part.
        """
        if k <= 0:
            return rank_hits(self.spark.createDataFrame([], HITS), k)
        return rank_hits(self._hits(queries.select("qid", "vector"), k, nprobe, allowed), k)

    def _hits(self, queries: DataFrame, k: int | None, nprobe: int | None, allowed: DataFrame | None = None) -> DataFrame:
        """The ``k`` best of each query in each task; without ``k``, all rows nearer than the query's ``reach``."""
        asked = queries.limit(TOGETHER + 1).collect()
        if len(asked) > TOGETHER:
            parts = 2 * (-(-queries.count() // TOGETHER))
            each = [self._hits(queries.where(F.pmod(F.xxhash64("qid", F.lit(parts)), F.lit(parts)) == i), k, nprobe, allowed) for i in range(parts)]
            return functools.reduce(DataFrame.unionByName, each)
        if not asked:
            return self.spark.createDataFrame([], HITS)
        for r in asked:
            if len(r.vector) != self.dim:
                raise DimensionMismatch(self.dim, len(r.vector))
        raw = np.array([r.vector for r in asked], np.float64)
        qids = np.array([r.qid for r in asked], np.int64)
        reach = np.array([r.reach for r in asked]) if k is None else None
        probes = self.probe_order(raw, nprobe)
        wanted = sorted({int(c) for c in probes.reshape(-1)})
        rows = self._rows().where(F.col("list").isin(wanted)) if self.pure else self.live().where(F.col("list").isin(wanted))
        if allowed is not None:
            rows = rows.join(allowed.select("id").distinct(), "id", "left_semi")
        by_list = {c: np.flatnonzero((probes == c).any(axis=1)) for c in wanted}
        score = self._score(qids, prepare_array(self.metric, raw), by_list, k, reach)
        return rows.select("id", "list", "vector", "codes").mapInArrow(score, HITS)

    def _score(self, qids: np.ndarray, queries: np.ndarray, by_list: dict[int, np.ndarray], k: int | None, reach: np.ndarray | None) -> Callable:
        metric, centroids, quantizer, residual = self.metric, self.centroids, self.quantizer, self.config.residual
        half = 0.5 if metric is Metric.COSINE else 1.0  # squared distances of unit vectors
        schema = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])

        def lists(ids: np.ndarray, list_: pa.Array, vectors: pa.Array, codes: pa.Array) -> Iterator[tuple]:
            of = list_.to_numpy()
            for c in np.unique(of):
                at, own = np.flatnonzero(of == c), by_list.get(int(c), np.zeros(0, np.int64))
                block = (vectors if quantizer is None else codes).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                yield ids[at], own, queries[own] - (centroids[c] if quantizer is not None and residual else 0), block

        def near(ids: np.ndarray, *columns: pa.Array) -> list[np.ndarray]:
            found = [_nearest(metric, qids[own], q, i, block, k) if quantizer is None else quantizer.nearest(qids[own], q, i, block, k, scale=half) for i, own, q, block in lists(ids, *columns)]
            return [np.concatenate([f[j] for f in found]) for j in range(3)]

        def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, own, q, block in lists(batch.column(0).to_numpy(), *batch.columns[1:]) if batch.num_rows else ():
                    for a in range(0, len(own), 64):
                        some = own[a : a + 64]
                        d = quantizer.distances(q[a : a + 64], block) * half
                        which, at = np.nonzero(d < reach[some][:, None])
                        yield pa.record_batch([pa.array(qids[some][which]), pa.array(ids[at]), pa.array(d[which, at])], schema=schema)

        return best_of_batches(near, k) if reach is None else within

    def search_reranked(self, queries: DataFrame, originals: DataFrame, k: int, shortlist: int = 64, nprobe: int | None = None) -> DataFrame:
        """The ``k`` best by exact distance to ``originals(id, vector)`` of a shortlist and of all rows that codes place within its error.

        The shortlist's exact distances show by how much codes err.  Whichever row's
        distance by codes, moved by their mean error less three standard deviations, is
        below the shortlist's ``k``-th best is compared exactly too, however many there are.
        """
        asked = queries.select("qid", F.col("vector").alias("q"))

        def compared(short: DataFrame) -> DataFrame:
            pairs = short.withColumnRenamed("distance", "rough").join(originals.select("id", "vector"), "id").join(asked, "qid")
            return pairs.select("qid", "id", "rough", distance(self.metric, F.col("q"), F.col("vector")).alias("distance"))

        first = compared(self.search(queries, max(shortlist, k), nprobe).select("qid", "id", "distance"))
        if k <= 0 or self.quantizer is None:
            return rank_hits(first.drop("rough"), k)
        first = first.persist()
        off = F.col("distance") - F.col("rough")
        seen = first.groupBy("qid").agg(F.sort_array(F.collect_list("distance")).alias("all"), F.avg(off).alias("mean"), F.stddev_pop(off).alias("spread"), F.max("rough").alias("last"), F.count(F.lit(1)).alias("n"))
        kth = F.element_at("all", F.least(F.lit(k), F.col("n")).cast("int"))
        reach = seen.where(F.col("n") >= max(shortlist, k)).select("qid", "last", (kth - F.col("mean") + 3 * F.col("spread") - 1e-9 * (1 + F.abs(kth))).alias("reach")).where("reach > last").drop("last")
        more = self._hits(queries.select("qid", "vector").join(reach, "qid"), None, nprobe).join(first.select("qid", "id"), ["qid", "id"], "left_anti")
        return rank_hits(first.drop("rough").unionByName(compared(more).drop("rough")), k)

    # upkeep

    def get(self, id: int) -> list[float] | None:
        """The prepared vector of a live id; none if only codes are kept."""
        row = self.live().where(F.col("id") == id).select("vector").first()
        return list(row.vector) if row and row.vector else None

    def contains(self, id: int) -> bool:
        return not self.live().where(F.col("id") == id).isEmpty()

    def list_of(self, id: int) -> int | None:
        """The list of a live id."""
        row = self.live().where(F.col("id") == id).select("list").first()
        return row.list if row else None

    def compact(self) -> None:
        """Rewrite the newest live rows, without training again."""
        old, rows = self._folder(), self.live().select("id", F.lit(1).cast("long").alias("seq"), F.lit(True).alias("live"), "vector", "codes", "list")
        self.version += 1
        self._append(rows)
        self.pure = True
        self._set(version=self.version, pure=True)
        files.remove(self.spark, old)

    def list_sizes(self) -> DataFrame:
        """``(list, n)`` of every list, empty ones too."""
        every = self.spark.range(len(self.centroids)).select(F.col("id").cast("int").alias("list"))
        return every.join(self.live().groupBy("list").agg(F.count(F.lit(1)).alias("n")), "list", "left").select("list", F.coalesce("n", F.lit(0)).alias("n"))

    def stats(self) -> dict:
        sizes = self.list_sizes().agg(F.sum("n").alias("live"), F.count_if(F.col("n") == 0).alias("empty_lists"), F.min("n").alias("list_min"), F.max("n").alias("list_max"), F.avg("n").alias("list_mean")).first().asDict()
        total = self._rows().select("id").distinct().count()
        row = self.config.pq_m if self.quantizer else 4 * self.dim
        return sizes | {"deleted": total - sizes["live"], "memory_bytes": sizes["live"] * (8 + row) + 4 * self.centroids.size + (self.quantizer.codebook_bytes if self.quantizer else 0)}

    def verify(self) -> None:
        """Raise unless every live row is of a known list and holds what the index needs."""
        need = "codes" if self.quantizer else "vector"
        size = self.config.pq_m if self.quantizer else self.dim
        bad = self.live().where((F.col("list") < 0) | (F.col("list") >= len(self.centroids)) | F.col(need).isNull() | (F.size(need) != size))
        if not bad.isEmpty():
            raise InvalidParameter("the index has rows that don't fit its model")

