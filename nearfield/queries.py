"""Queries over the shared tables, one or more for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.api import Index
from nearfield.errors import InvalidParameter
from nearfield.functions import metrics
from nearfield.functions.rng import SplitMix64
from nearfield.operators import exact, hnsw
from nearfield.operators.clustering import kmeans_table, nearest_centroid
from nearfield.operators.ivf import IvfConfig, IvfIndex
from nearfield.operators.product_quantizer import ProductQuantizer
from nearfield.operators.scalar_quantizer import ScalarQuantizer
from nearfield.plans import filters
from nearfield.sources.collection import Collection
from nearfield.sources.vectors import from_numpy, parse_vector, read_jsonl, read_queries, sample
from nearfield.streaming.ingest import start_ingest
from nearfield.tables import described, queries_of, read, vectors, work_dir

#: Vectors of one index in memory.
INDEX_ROWS = 10_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# SQL pieces.  Distances are sums over zipped components, in double precision.
SCALED = "SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (1 + label)) AS v FROM embeddings"
L2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
NORM = "sqrt(list_sum(list_transform({a}, lambda x: x * x)))"


def _metric_sql(metric: str, a: str, b: str) -> str:
    if metric == "l2":
        return L2.format(a=a, b=b)
    if metric == "inner_product":
        return "-" + DOT.format(a=a, b=b)
    return f"1 - {DOT.format(a=a, b=b)} / ({NORM.format(a=a)} * {NORM.format(a=b)})"


def _top(pairs: str, k: int) -> str:
    """The k best of rows (qid, id, d)."""
    return f"""SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(d, 6) + 0 AS distance FROM (
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM ({pairs})) WHERE rank <= {k}"""


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "rank", "id", (F.round("distance", 6) + 0.0).alias("distance"))  # no negative zero


def _knn_sql(metric: str, k: int = 10, rows: str = SCALED, where: str = "true") -> str:
    return f"WITH s AS ({rows}) " + _top(f"SELECT q.id AS qid, c.id, {_metric_sql(metric, 'q.v', 'c.v')} AS d FROM s q JOIN s c ON {where} WHERE q.id % 50 = 0", k)


# Exact search


@query(_knn_sql("l2"))
def knn_l2_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return _rounded(exact.knn_batch(rows, queries_of(rows), 10, "l2"))


@query(_knn_sql("cosine"))
def knn_cosine_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return _rounded(exact.knn_batch(rows, queries_of(rows), 10, "cosine"))


@query(_knn_sql("inner_product"))
def knn_inner_product_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return _rounded(exact.knn_batch(rows, queries_of(rows), 10, "inner_product"))


@query(_knn_sql("l2", 5))
def knn_columns_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return _rounded(exact.knn_batch(rows, queries_of(rows), 5, "l2", strategy="sql"))


@query(_knn_sql("l2", 10))
def knn_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way for query sets too large to send to all tasks."""
    rows = vectors(spark, sf_dir)
    return _rounded(exact.knn_batch(rows, queries_of(rows), 10, "l2", small=0, block=256))


@query(f"WITH s AS ({SCALED}) SELECT c.id, round({L2.format(a='q.v', b='c.v')}, 6) AS distance FROM s c CROSS JOIN (SELECT v FROM s ORDER BY id LIMIT 1) q ORDER BY {L2.format(a='q.v', b='c.v')}, c.id LIMIT 20")
def knn_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    first = rows.orderBy("id").first()
    return exact.knn(rows, list(first.vector), 20, "l2").select("id", F.round("distance", 6).alias("distance"))


@query(f"""WITH s AS ({SCALED}), q AS (SELECT v FROM s ORDER BY id LIMIT 1)
SELECT c.id, round({L2.format(a='q.v', b='c.v')}, 6) AS l2, round(-{DOT.format(a='q.v', b='c.v')}, 6) AS inner_product,
    round({_metric_sql('cosine', 'q.v', 'c.v')}, 6) + 0 AS cosine FROM s c CROSS JOIN q""")
def distance_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    q = metrics.vector_literal(rows.orderBy("id").first().vector)
    return rows.select("id", *[(F.round(metrics.distance(m, q, F.col("vector")), 6) + 0.0).alias(m) for m in ("l2", "inner_product", "cosine")])


@query(f"WITH s AS ({SCALED}) SELECT id, unnest(range(len(v))) AS place, round(unnest(v) / {NORM.format(a='v')}, 6) AS x FROM s")
def normalized_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", F.posexplode(metrics.l2_normalize(F.col("vector"))).alias("place", "x")).select("id", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("x"))


# Measures


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Hits by the first half of the components, and the truth."""
    rows = vectors(spark, sf_dir)
    half = rows.select("id", F.slice("vector", 1, 32).alias("vector"))
    return exact.knn_batch(half, queries_of(half), 10, "l2"), exact.knn_batch(rows, queries_of(rows), 10, "l2")


def _halves_sql(tail: str) -> str:
    rank = "row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank"
    pairs = "SELECT q.id AS qid, c.id, {} AS d FROM s q CROSS JOIN s c WHERE q.id % 50 = 0"
    return f"""WITH s AS ({SCALED}), found AS (SELECT * FROM (SELECT *, {rank} FROM ({pairs.format(L2.format(a='q.v[1:32]', b='c.v[1:32]'))})) WHERE rank <= 10),
        truth AS (SELECT * FROM (SELECT *, {rank} FROM ({pairs.format(L2.format(a='q.v', b='c.v'))})) WHERE rank <= 10) {tail}"""


@query(_halves_sql("SELECT (SELECT count(*) FROM found JOIN truth USING (qid, id)) / (10.0 * (SELECT count(DISTINCT qid) FROM truth)) AS recall"))
def recall_of_half_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.recall(*_halves(spark, sf_dir), 10)


@query(_halves_sql("SELECT round(avg(coalesce(1.0 / f.rank, 0)), 9) AS mrr FROM truth t LEFT JOIN found f USING (qid, id) WHERE t.rank = 1"))
def mrr_of_half_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mrr(*_halves(spark, sf_dir)).select(F.round("mrr", 9).alias("mrr"))


# Filters

DESCRIBED = """SELECT e.vec_id AS id, CAST(e.embedding AS DOUBLE[]) AS v, e.label, d.lang, d.source, d.n_chars, y.quality, y.toxic,
    CASE WHEN d.lang IS NOT NULL THEN [d.lang, d.source] END AS tags
    FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN labels y ON y.doc_id = e.vec_id"""


def _with_boolean(rows: DataFrame) -> DataFrame:
    return rows.withColumn("good", F.col("quality") == 1)


def _filter_query(name: str, text: str, sql: str) -> None:
    """Ids that pass a filter, over typed columns and over the metadata map, which must agree."""

    def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _with_boolean(described(spark, sf_dir))
        return rows.where(filters.to_column(text, filters.TypedColumns(rows.schema))).select("id")

    def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
        return described_map(spark, sf_dir).where(filters.to_column(text, filters.TaggedMap(F.col("metadata")))).select("id")

    for kind, f in (("columns", columns), ("map", maps)):
        QUERIES[f"filter_{name}_{kind}"] = f
        SQL[f"filter_{name}_{kind}"] = f"WITH s AS ({DESCRIBED}) SELECT id FROM s WHERE {sql}"


def described_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, metadata)`` of :func:`described`, fields that are null being absent."""
    rows = _with_boolean(described(spark, sf_dir))

    def value(name: str, kind: str) -> Column:
        c = F.col(name)
        none = {"kind": "string", "b": "boolean", "n": "double", "s": "string"}
        parts = {"kind": F.lit(kind), "b": c if kind == "bool" else F.lit(None).cast("boolean"), "n": c.cast("double") if kind == "num" else F.lit(None).cast("double"), "s": F.array_join(c, ",") if kind == "list" else c.cast("string")}
        item = "struct<kind: string, b: boolean, n: double, s: string>"
        items = F.transform(c, lambda x: F.struct(F.lit("str").alias("kind"), F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("double").alias("n"), x.alias("s"))) if kind == "list" else F.lit(None).cast(f"array<{item}>")
        full = F.struct(*[parts[k].cast(none[k]).alias(k) for k in parts], items.alias("items"))
        return F.when(c.isNotNull(), F.array(F.struct(F.lit(name).alias("key"), full.cast(filters.VALUE).alias("value")))).otherwise(F.array().cast(f"array<struct<key: string, value: {filters.VALUE}>>"))

    kinds = {"label": "num", "lang": "str", "source": "str", "n_chars": "num", "quality": "num", "toxic": "num", "tags": "list", "good": "bool"}
    return rows.select("id", "vector", F.map_from_entries(F.concat(*[value(n, k) for n, k in kinds.items()])).alias("metadata"))


_filter_query("boolean", "good == true OR NOT good EXISTS AND label < 2", "coalesce(quality = 1, false) OR (quality IS NULL AND label < 2)")
_filter_query("range", "label >= 3 AND label < 7 AND n_chars > 1500", "label >= 3 AND label < 7 AND n_chars > 1500")
_filter_query("missing_not_equal", "quality != 1", "quality <> 1")
_filter_query("not_of_missing", "NOT quality == 1", "NOT coalesce(quality = 1, false)")
_filter_query("in_and_or", "(lang IN ('de', 'fr') OR label IN (1, 2)) AND NOT (toxic == 1 OR n_chars < 1000)", "(coalesce(lang IN ('de', 'fr'), false) OR label IN (1, 2)) AND NOT (coalesce(toxic = 1, false) OR coalesce(n_chars < 1000, false))")
_filter_query("contains", "tags CONTAINS en OR source CONTAINS '1'", "coalesce(list_contains(tags, 'en'), false) OR coalesce(contains(source, '1'), false)")
_filter_query("exists", "quality EXISTS AND NOT toxic == 1 AND lang EXISTS", "quality IS NOT NULL AND NOT coalesce(toxic = 1, false) AND lang IS NOT NULL")
_filter_query("cross_type", "label == '3' OR lang > 5 OR n_chars == \"1000\"", "label = 3 OR coalesce(n_chars = 1000, false)")


@query("WITH s AS (" + DESCRIBED + ") " + _top(f"SELECT q.id AS qid, c.id, {L2.format(a='q.v', b='c.v')} AS d FROM s q CROSS JOIN s c WHERE q.id % 50 = 0 AND c.label >= 4 AND NOT coalesce(c.lang = 'de', false)", 10))
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = described(spark, sf_dir)
    passes = filters.to_column("label >= 4 AND NOT lang == de", filters.TypedColumns(rows.schema))
    return _rounded(exact.knn_batch(rows, queries_of(rows), 10, "l2", where=passes))


# Quantizers

BOUNDS = f"s AS ({SCALED}), x AS (SELECT id, unnest(range(len(v))) AS place, unnest(v) AS x FROM s), b AS (SELECT place, min(x) AS low, CASE WHEN max(x) > min(x) THEN (max(x) - min(x)) / 255 ELSE 1 END AS scale FROM x GROUP BY place)"


@query(f"WITH {BOUNDS} SELECT place, round(low, 9) AS low, round(scale, 9) AS scale FROM b")
def sq8_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = ScalarQuantizer.train(vectors(spark, sf_dir))
    return spark.createDataFrame(list(zip(range(model.dim), model.low, model.scale, strict=True)), "place long, low double, scale double").select("place", F.round("low", 9).alias("low"), F.round("scale", 9).alias("scale"))


@query(f"WITH {BOUNDS} SELECT id, place, CAST(floor(least(greatest((x - low) / scale, 0), 255) + 0.5) AS INTEGER) AS code FROM x JOIN b USING (place)")
def sq8_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    model = ScalarQuantizer.train(rows)
    return rows.select("id", F.posexplode(model.encode(F.col("vector"))).alias("place", "code")).select("id", F.col("place").cast("long").alias("place"), F.col("code").cast("int").alias("code"))


@query(f"WITH {BOUNDS}, r AS (SELECT id, place, x, scale, low + floor(least(greatest((x - low) / scale, 0), 255) + 0.5) * scale AS y FROM x JOIN b USING (place)) SELECT id, round(max(abs(x - y)), 6) AS error, max(abs(x - y)) <= (SELECT max(scale) / 2 + 1e-9 FROM b) AS within FROM r GROUP BY id")
def sq8_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    model = ScalarQuantizer.train(rows)
    again = model.decode(model.encode(F.col("vector")))
    error = F.array_max(F.zip_with("vector", again, lambda x, y: F.abs(x - y)))
    return rows.select("id", F.round(error, 6).alias("error"), (error <= model.max_abs_error + 1e-9).alias("within"))


def fixed_books(rows: DataFrame) -> DataFrame:
    """Codebooks that SQL can name: the parts of the 16 vectors of least id, in 8 parts."""
    first = rows.orderBy("id").limit(16)
    parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda s: F.slice("vector", s * 8 + 1, 8))
    rank = first.selectExpr("row_number() over (order by id) - 1 as centroid", "vector")
    return rank.select(F.col("centroid").cast("int"), F.posexplode(parts).alias("part", "piece")).select("part", "centroid", F.col("piece").alias("vector"))


BOOKS = f"s AS ({SCALED}), w AS (SELECT row_number() OVER (ORDER BY id) - 1 AS c, v FROM s ORDER BY id LIMIT 16), p AS (SELECT unnest(range(8)) AS part), books AS (SELECT part, c, v[part * 8 + 1 : part * 8 + 8] AS v FROM w CROSS JOIN p), codes AS (SELECT id, part, arg_min(c, d) AS code FROM (SELECT id, p.part, c, {L2.format(a='s.v[p.part * 8 + 1 : p.part * 8 + 8]', b='books.v')} AS d FROM s CROSS JOIN p JOIN books ON books.part = p.part) GROUP BY id, part)"


@query(f"WITH {BOOKS} SELECT id, CAST(part AS INTEGER) AS part, CAST(code AS INTEGER) AS code FROM codes")
def pq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    quantizer = ProductQuantizer.from_table(fixed_books(rows))
    return quantizer.encode(rows).select("id", F.posexplode("codes").alias("part", "code")).select("id", "part", F.col("code").cast("int").alias("code"))


PQ_SQL = f"WITH {BOOKS}, t AS (SELECT q.id AS qid, books.part, books.c, {L2.format(a='q.v[books.part * 8 + 1 : books.part * 8 + 8]', b='books.v')} AS d FROM s q CROSS JOIN books WHERE q.id % 50 = 0) " + _top("SELECT t.qid, k.id, round(sum(t.d), 9) AS d FROM codes k JOIN t ON t.part = k.part AND t.c = k.code GROUP BY ALL", 10)


@query(PQ_SQL)
def pq_asymmetric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    quantizer = ProductQuantizer.from_table(fixed_books(rows))
    return _rounded(quantizer.search(quantizer.encode(rows), queries_of(rows), 10, decimals=9))


@query("SELECT true AS reached")
def pq_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained codebooks: asymmetric distances find a fifth of the nearest (vectors without clusters, 8 bytes each)."""
    rows = vectors(spark, sf_dir)
    quantizer = ProductQuantizer.train(rows, 8, 64, 10)
    found = quantizer.search(quantizer.encode(rows), queries_of(rows), 10)
    return _reached(exact.recall(found, exact.knn_batch(rows, queries_of(rows), 10), 10), 0.2)


def _reached(measured: DataFrame, least: float) -> DataFrame:
    return measured.select((F.col("recall") >= least).alias("reached"))


@query("SELECT count(*) AS assigned, true AS few_clusters, true AS nearer FROM embeddings")
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is in one of 16 clusters, which are nearer to their rows than 16 rows taken as centres."""
    rows = vectors(spark, sf_dir)
    first = np.array([r.vector for r in rows.orderBy("id").limit(16).collect()])

    def inertia(centroids: np.ndarray) -> DataFrame:
        table = from_numpy(spark, np.arange(len(centroids)), centroids).select(F.col("id").cast("int").alias("cluster"), F.col("vector").alias("centre"))
        placed = _assigned(rows, centroids).join(rows, "id").join(F.broadcast(table), "cluster")  # 16 rows
        return placed.agg(F.sum(metrics.l2_squared(F.col("vector"), F.col("centre"))).alias("inertia"), F.count(F.lit(1)).alias("assigned"), (F.count_distinct("cluster") <= 16).alias("few_clusters"))

    trained = inertia(kmeans_table(rows, 16, iterations=8))
    return trained.crossJoin(inertia(first).select(F.col("inertia").alias("other"))).select("assigned", "few_clusters", (F.col("inertia") < F.col("other")).alias("nearer"))


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.record_batch([b.column(0), pa.array(nearest_centroid(x, centroids)[0], pa.int32())], names=["id", "cluster"])

    return rows.select("id", "vector").mapInArrow(run, "id long, cluster int")


@query(f"WITH s AS ({SCALED}), w AS (SELECT row_number() OVER (ORDER BY id) - 1 AS c, v FROM s ORDER BY id LIMIT 16) SELECT s.id, CAST(arg_min(c, {L2.format(a='s.v', b='w.v')}) AS INTEGER) AS cluster FROM s CROSS JOIN w GROUP BY s.id")
def nearest_of_fixed_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return _assigned(rows, np.array([r.vector for r in rows.orderBy("id").limit(16).collect()]))


# Indexes


def _ivf(spark: SparkSession, rows: DataFrame, metric: str = "l2", **config) -> IvfIndex:
    return IvfIndex.train(rows, work_dir(spark, "ivf"), metric, IvfConfig(**({"nlist": 16, "list_iterations": 8, "pq_iterations": 8} | config)))


@query(_knn_sql("l2"))
def ivf_flat_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return _rounded(_ivf(spark, rows).search(queries_of(rows), 10, nprobe=16))


@query("SELECT true AS some, true AS rising, true AS complete")
def ivf_flat_some_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall doesn't fall with more lists: one list finds something, all lists everything."""
    rows = vectors(spark, sf_dir)
    index, truth = _ivf(spark, rows), exact.knn_batch(rows, queries_of(rows), 10).persist()
    recalls = [exact.recall(index.search(queries_of(rows), 10, nprobe=n), truth, 10).first()[0] for n in (1, 2, 4, 8, 16)]
    return spark.createDataFrame([(recalls[0] > 0, recalls == sorted(recalls), recalls[-1] == 1.0)], "some boolean, rising boolean, complete boolean")


@query("SELECT true AS reached, CAST(0 AS BIGINT) AS wrong_distances, CAST(count(*) FILTER (WHERE vec_id % 50 = 0) AS BIGINT) * 10 AS hits FROM embeddings")
def ivf_pq_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortlist of 128 by codes of 16 bytes: nine in ten of the nearest are found, each with its exact distance."""
    rows = vectors(spark, sf_dir)
    hits = _ivf(spark, rows, "cosine", pq_m=16, ksub=64).search_reranked(queries_of(rows), rows, 10, shortlist=128, nprobe=16).persist()
    asked = queries_of(rows).withColumnRenamed("vector", "q")
    right = metrics.distance("cosine", F.col("q"), F.col("vector"))
    wrong = hits.join(asked, "qid").join(rows, "id").agg(F.count_if(F.abs(right - F.col("distance")) > 1e-9).alias("wrong_distances"))
    return _reached(exact.recall(hits, exact.knn_batch(rows, asked.withColumnRenamed("q", "vector"), 10, "cosine"), 10), 0.9).crossJoin(wrong).crossJoin(hits.agg(F.count(F.lit(1)).alias("hits")))


def _clustered(spark: SparkSession, metric: str = "l2", count: int = 4000) -> DataFrame:
    """A seeded corpus in 64 clusters, on which recall is held to fixed floors."""
    return from_numpy(spark, *sample(count, 32, metric, 64, 7)).select("id", F.col("vector").cast("array<double>").alias("vector"))


@query("SELECT true AS codes, true AS reranked")
def ivf_pq_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the nearest by codes alone, nine in ten after reranking."""
    rows = _clustered(spark)
    index = _ivf(spark, rows, pq_m=8, ksub=128)
    truth = exact.knn_batch(rows, queries_of(rows), 10).persist()
    codes = _reached(exact.recall(index.search(queries_of(rows), 10, nprobe=16), truth, 10), 0.5).withColumnRenamed("reached", "codes")
    return codes.crossJoin(_reached(exact.recall(index.search_reranked(queries_of(rows), rows, 10, shortlist=100, nprobe=16), truth, 10), 0.9).withColumnRenamed("reached", "reranked"))


@query("WITH s AS (" + SCALED + ") " + _top(f"SELECT q.id AS qid, c.id, {L2.format(a='q.v', b='c.v')} AS d FROM s q CROSS JOIN s c JOIN embeddings e ON e.vec_id = c.id WHERE q.id % 50 = 0 AND e.label < 5", 10))
def ivf_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    allowed = read(spark, sf_dir, "embeddings").where("label < 5").select(F.col("vec_id").alias("id"))
    return _rounded(_ivf(spark, rows).search(queries_of(rows), 10, nprobe=16, allowed=allowed))


@query(f"WITH s AS (SELECT id, CASE WHEN id % 3 = 0 THEN list_transform(v, lambda x: -x) ELSE v END AS v FROM ({SCALED})) " + _top(f"SELECT q.id AS qid, c.id, {L2.format(a='q.v', b='c.v')} AS d FROM ({SCALED}) q CROSS JOIN s c WHERE q.id % 50 = 0", 10))
def ivf_moved_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third vector is replaced by its opposite, which moves it to another list."""
    rows = vectors(spark, sf_dir)
    index = _ivf(spark, rows)
    index.insert(rows.where("id % 3 = 0").select("id", F.transform("vector", lambda x: -x).alias("vector")))
    return _rounded(index.search(queries_of(rows), 10, nprobe=16))


@query("SELECT count(*) AS listed, true AS nearest_list, true AS found FROM embeddings")
def ivf_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists hold every row once, each the list of its nearest centroid, and a row is found by its id."""
    rows = vectors(spark, sf_dir)
    index = _ivf(spark, rows)
    placed = index.live().join(_assigned(rows, index.centroids), "id")
    first = rows.orderBy("id").first()
    found = index.contains(first.id) and not index.contains(-1) and index.get(first.id) == list(first.vector) and index.list_of(first.id) == index.probe_order(np.array([first.vector]), 1)[0, 0]
    return placed.agg(F.count(F.lit(1)).alias("listed"), F.every(F.col("list") == F.col("cluster")).alias("nearest_list")).withColumn("found", F.lit(bool(found)))


@query(f"WITH s AS ({SCALED} WHERE vec_id % 11 <> 0) " + _top(f"SELECT q.id AS qid, c.id, {L2.format(a='q.v', b='c.v')} AS d FROM ({SCALED}) q CROSS JOIN s c WHERE q.id % 50 = 0", 10))
def ivf_after_delete_and_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    index = _ivf(spark, rows)
    index.delete(rows.where("id % 11 = 0").select("id"))
    index.compact()
    index.verify()
    return _rounded(index.search(queries_of(rows), 10, nprobe=16))


@query("SELECT count(*) AS live, CAST(count(*) FILTER (WHERE vec_id % 11 = 0) AS BIGINT) AS deleted, 4 * 64 + 8 AS bytes_a_vector, count(*) AS in_lists FROM embeddings")
def ivf_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    index = _ivf(spark, rows)
    before = index.stats()
    a_vector = (before["memory_bytes"] - 4 * index.centroids.size) // max(before["live"], 1)
    in_lists = index.list_sizes().agg(F.sum("n")).first()[0]
    index.delete(rows.where("id % 11 = 0").select("id"))
    return spark.createDataFrame([(before["live"], index.stats()["deleted"], a_vector, in_lists)], "live long, deleted long, bytes_a_vector int, in_lists long")


def _graphs(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, int, hnsw.HnswConfig]:
    config = hnsw.HnswConfig(m=12, m0=24, ef_construction=60)
    dim = rows.select(F.size("vector")).first()[0]
    path = work_dir(spark, "graphs")
    hnsw.build(rows, dim, "l2", config, 8).write.parquet(path)
    return spark.read.schema(hnsw.HnswGraph.SCHEMA).parquet(path), dim, config


def hnsw_recall_value(spark: SparkSession, sf_dir: str) -> float:
    rows = vectors(spark, sf_dir)
    graphs, _, config = _graphs(spark, rows)
    return exact.recall(hnsw.search(graphs, queries_of(rows), 10, "l2", 64, config), exact.knn_batch(rows, queries_of(rows), 10), 10).first()[0]


@query("SELECT true AS reached")
def hnsw_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(hnsw_recall_value(spark, sf_dir) >= 0.95,)], "reached boolean")


@query("SELECT metric, CAST(ef AS INTEGER) AS ef, true AS reached FROM (VALUES ('l2'), ('cosine'), ('inner_product')) m(metric), (VALUES (64), (256)) e(ef)")
def hnsw_recall_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the clustered corpus, one graph: 0.90 at ef 64 and 0.95 at ef 256."""
    out = []
    for metric in ("l2", "cosine", "inner_product"):
        rows = _clustered(spark, metric)
        graphs, truth = hnsw.build(rows, 32, metric, shards=1).persist(), exact.knn_batch(rows, queries_of(rows), 10, metric).persist()
        out += [(metric, ef, exact.recall(hnsw.search(graphs, queries_of(rows), 10, metric, ef), truth, 10).first()[0] >= least) for ef, least in ((64, 0.90), (256, 0.95))]
    return spark.createDataFrame(out, "metric string, ef int, reached boolean")


@query("SELECT count(*) AS live, CAST(0 AS BIGINT) AS broken, true AS reached, true AS found FROM embeddings")
def hnsw_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A persisted graph of every other row, into which the others are inserted."""
    rows = vectors(spark, sf_dir)
    graphs, dim, config = _graphs(spark, rows.where("id % 2 = 0"))
    path = work_dir(spark, "graphs")
    hnsw.insert(graphs, rows.where("id % 2 = 1"), dim, "l2", config, 8).write.parquet(path)
    graphs = spark.read.schema(hnsw.HnswGraph.SCHEMA).parquet(path)
    last = rows.orderBy(F.desc("id")).first()
    found = hnsw.contains(graphs, last.id) and hnsw.get(graphs, last.id) == list(last.vector) and not hnsw.contains(graphs, -1)
    reached = _reached(exact.recall(hnsw.search(graphs, queries_of(rows), 10, "l2", 96, config), exact.knn_batch(rows, queries_of(rows), 10), 10), 0.95)
    return hnsw.stats(graphs).select("live").crossJoin(hnsw.broken_links(graphs).agg(F.count(F.lit(1)).alias("broken"))).crossJoin(reached).withColumn("found", F.lit(bool(found)))


@query("SELECT CAST(count(*) FILTER (WHERE vec_id % 11 <> 0) AS BIGINT) AS nodes, CAST(0 AS BIGINT) AS broken FROM embeddings")
def hnsw_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    graphs, dim, config = _graphs(spark, rows)
    smaller = hnsw.compact(hnsw.delete(graphs, rows.where("id % 11 = 0")), dim, "l2", config, 4).persist()
    return smaller.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(hnsw.broken_links(smaller).agg(F.count(F.lit(1)).alias("broken")))


@query("SELECT count(*) AS live, CAST(count(*) FILTER (WHERE vec_id % 11 = 0) AS BIGINT) AS deleted_later, CAST(0 AS BIGINT) AS broken FROM embeddings")
def hnsw_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    graphs, _, _ = _graphs(spark, rows)
    gone = hnsw.stats(hnsw.delete(graphs, rows.where("id % 11 = 0"))).select(F.col("deleted").alias("deleted_later"))
    broken = hnsw.broken_links(graphs).agg(F.count(F.lit(1)).alias("broken"))
    return hnsw.stats(graphs).select("live").crossJoin(gone).crossJoin(broken)


@query("SELECT true AS reached, CAST(0 AS BIGINT) AS outside")
def hnsw_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    graphs, _, config = _graphs(spark, rows)
    allowed = read(spark, sf_dir, "embeddings").where("label < 5").select(F.col("vec_id").alias("id"))
    truth = exact.knn_batch(rows.join(allowed, "id", "left_semi"), queries_of(rows), 10)
    hits = hnsw.search(graphs, queries_of(rows), 10, "l2", 96, config, allowed).persist()
    outside = hits.join(allowed, "id", "left_anti").agg(F.count(F.lit(1)).alias("outside"))
    return _reached(exact.recall(hits, truth, 10), 0.95).crossJoin(outside)


# Collections

#: Upsert all; upsert again every 7th, doubled; delete every 11th; upsert again every 77th, tripled.
LIVE = """SELECT vec_id AS id, list_transform(CAST(embedding AS FLOAT[]), lambda x: CAST(x * CASE WHEN vec_id % 77 = 0 THEN 3 WHEN vec_id % 7 = 0 THEN 2 ELSE 1 END AS FLOAT)) AS v
    FROM embeddings WHERE vec_id % 11 <> 0 OR vec_id % 77 = 0"""


def changed_collection(spark: SparkSession, sf_dir: str, metric: str = "l2", graph_shards: int = 0) -> Collection:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    dim = rows.select(F.size("vector")).first()[0]
    times = lambda n: F.transform("vector", lambda x: (x * n).cast("float")).alias("vector")
    c = Collection.create(spark, work_dir(spark, "collections"), "changed", dim, metric)
    c.upsert(rows)
    c.flush(graph_shards)
    c.upsert(rows.where("id % 7 = 0").select("id", times(2)))
    c.delete(rows.where("id % 11 = 0").select("id"))
    c.flush(graph_shards)
    c.upsert(rows.where("id % 77 = 0").select("id", times(3)))
    return c


@query(f"WITH s AS ({LIVE}) SELECT id, round(CAST(v[1] AS DOUBLE), 5) AS first, round(CAST(v[len(v)] AS DOUBLE), 5) AS last FROM s")
def collection_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = changed_collection(spark, sf_dir).live()
    return live.select("id", *[F.round(F.element_at("vector", at).cast("double"), 5).alias(n) for at, n in ((1, "first"), (-1, "last"))])


COLLECTION_SQL = f"WITH s AS (SELECT id, CAST(v AS DOUBLE[]) AS v FROM ({LIVE})) " + _top(f"SELECT q.vec_id AS qid, c.id, {L2.format(a='CAST(q.embedding AS DOUBLE[])', b='c.v')} AS d FROM embeddings q CROSS JOIN s c WHERE q.vec_id % 50 = 0", 10)


def _plain_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("vector"))


@query(COLLECTION_SQL)
def collection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(changed_collection(spark, sf_dir).search(_plain_queries(spark, sf_dir), 10))


@query(COLLECTION_SQL)
def collection_compacted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = changed_collection(spark, sf_dir)
    c.compact()
    c.verify()
    return _rounded(Collection.open(spark, c.root, c.name).search(_plain_queries(spark, sf_dir), 10))


@query("SELECT true AS reached")
def collection_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = changed_collection(spark, sf_dir, graph_shards=4)
    asked = _plain_queries(spark, sf_dir)
    return _reached(exact.recall(c.search(asked, 10, ef=96, strategy="graph"), c.search(asked, 10), 10), 0.95)


@query(f"WITH s AS ({LIVE}) SELECT id, round(CAST(v[1] AS DOUBLE), 5) AS first FROM s")
def collection_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opened again with nothing sealed but the first segment: all later changes are pending parts."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    times = lambda n: F.transform("vector", lambda x: (x * n).cast("float")).alias("vector")
    c = Collection.create(spark, work_dir(spark, "collections"), "replayed", rows.select(F.size("vector")).first()[0])
    c.upsert(rows)
    c.change(rows.where("id % 7 = 0 and id % 11 <> 0").select("id", times(2)), rows.where("id % 11 = 0").select("id"))
    c.upsert(rows.where("id % 77 = 0").select("id", times(3)))
    live = Collection.open(spark, c.root, c.name).live()
    return live.select("id", F.round(F.element_at("vector", 1).cast("double"), 5).alias("first"))


@query("SELECT doc_id AS id, CAST(quality AS DOUBLE) AS quality FROM labels WHERE doc_id % 5 <> 0 AND quality IS NOT NULL AND doc_id % 3 <> 0 UNION ALL SELECT doc_id, 2.0 FROM labels WHERE doc_id % 5 <> 0 AND doc_id % 3 = 0")
def collection_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps set, replaced for every third id, cleared for every fifth, rewritten and read again."""
    rows = read(spark, sf_dir, "labels").where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").cast("double").alias("quality"))
    c = Collection.create(spark, work_dir(spark, "collections"), "described", 1)
    value = lambda n: F.map_from_arrays(F.array(F.lit("quality")), F.array(F.struct(F.lit("num").alias("kind"), F.lit(None).cast("boolean").alias("b"), n.cast("double").alias("n"), F.lit(None).cast("string").alias("s"), F.lit(None).alias("items")).cast(filters.VALUE))).alias("metadata")
    c.set_metadata(rows.where("quality is not null").select("id", value(F.col("quality"))))
    c.set_metadata(rows.where("id % 3 = 0").select("id", value(F.lit(2.0))))
    c.clear_metadata(rows.where("id % 5 = 0").select("id"))
    c.rewrite_metadata()
    c.verify()
    return Collection.open(spark, c.root, c.name).metadata().select("id", F.col("metadata")["quality"]["n"].alias("quality"))


@query(f"WITH m AS ({DESCRIBED}), s AS (SELECT l.id, CAST(l.v AS DOUBLE[]) AS v, m.quality FROM ({LIVE}) l JOIN m ON m.id = l.id WHERE m.label >= 3 AND NOT coalesce(m.toxic = 1, false)) "
       + f"SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(d, 6) + 0 AS distance, CAST(quality AS DOUBLE) AS quality FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM (SELECT q.vec_id AS qid, c.id, {L2.format(a='CAST(q.embedding AS DOUBLE[])', b='c.v')} AS d, c.quality FROM embeddings q CROSS JOIN s c WHERE q.vec_id % 50 = 0)) WHERE rank <= 10")
def collection_filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = changed_collection(spark, sf_dir)
    c.set_metadata(described_map(spark, sf_dir).select("id", "metadata"))
    hits = c.search(_plain_queries(spark, sf_dir), 10, filter="label >= 3 AND NOT toxic == 1", include_metadata=True)
    return hits.select("qid", "rank", "id", F.round("distance", 6).alias("distance"), F.try_element_at("metadata", F.lit("quality"))["n"].alias("quality"))


@query(f"SELECT (SELECT count(*) FROM ({LIVE})) AS live, CAST(2 AS BIGINT) AS segments, (SELECT count(*) FROM embeddings WHERE vec_id % 77 = 0) AS pending")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = changed_collection(spark, sf_dir).stats()
    return spark.createDataFrame([(s["live"], s["segments"], s["pending"])], "live long, segments long, pending long")


# Sources and streams


@query("SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dim, round(CAST(embedding[1] AS DOUBLE), 5) AS first FROM embeddings")
def jsonl_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "jsonl")
    read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.lit("x").alias("other")).write.json(path)
    return read_jsonl(spark, path, 64).select("id", F.size("vector").alias("dim"), F.round(F.element_at("vector", 1).cast("double"), 5).alias("first"))


# SplitMix64 in SQL: number i, from 0, of a generator in state s.
_Z = "({s} + ({i} + 1) * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT"


def _splitmix(numbers: str, state: str) -> str:
    """Rows ``(i, u)`` of ``numbers(i)``."""
    m = "18446744073709551616::UHUGEINT"
    return f"""SELECT i, xor(z, z // 2147483648::UHUGEINT) AS u FROM (SELECT i, (xor(z, z // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % {m} AS z
        FROM (SELECT i, (xor(z, z // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % {m} AS z FROM (SELECT i, {_Z.format(s=state, i="i::UHUGEINT")} AS z FROM {numbers})))"""


_STATE = "((({}) + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)"
_SEED_11, _SEED_5 = _STATE.format("11::UHUGEINT"), _STATE.format("5::UHUGEINT")


@query(f"""WITH n AS ({_splitmix("(SELECT unnest(range(8 * 16 + 500 * 17)) AS i)", _SEED_11)}), f AS (SELECT i, u, CAST(u // 2048::UHUGEINT AS DOUBLE) * pow(2, -53) AS f FROM n),
    centres AS (SELECT i // 16 AS c, i % 16 AS j, CAST(f * 2 - 1 AS FLOAT) AS x FROM f WHERE i < 128),
    r AS (SELECT (i - 128) // 17 AS id, (i - 128) % 17 AS j, u, f FROM f WHERE i >= 128),
    x AS (SELECT r.id, r.j - 1 AS j, CAST(c.x + CAST((r.f * 2 - 1) * 0.35::DOUBLE AS FLOAT) AS DOUBLE) AS x FROM r JOIN r o ON o.id = r.id AND o.j = 0 JOIN centres c ON c.c = CAST(o.u % 8::UHUGEINT AS BIGINT) AND c.j = r.j - 1)
    SELECT id, round(CAST(CAST(max(x) FILTER (WHERE j = 0) / sqrt(sum(x * x)) AS FLOAT) AS DOUBLE), 5) AS first FROM x GROUP BY id""")
def sampled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = from_numpy(spark, *sample(500, 16, "cosine", 8, 11))
    return rows.select("id", F.round(F.element_at("vector", 1).cast("double"), 5).alias("first"))


@query(f"WITH n AS ({_splitmix('(SELECT unnest(range(100)) AS i)', _SEED_5)}) SELECT i AS place, CAST(u AS VARCHAR) AS whole, CAST(u // 2048::UHUGEINT AS DOUBLE) * pow(2, -53) AS fraction, CAST(u % 10::UHUGEINT AS BIGINT) AS below_ten FROM n")
def seeded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, fraction, below = (SplitMix64(5) for _ in range(3))
    return spark.createDataFrame([(i, str(whole.next_u64()), fraction.next_f64(), below.below(10)) for i in range(100)], "place long, whole string, fraction double, below_ten long")


@query(f"""WITH RECURSIVE n AS ({_splitmix('(SELECT unnest(range(29)) AS i)', _SEED_5)}), turns AS (SELECT 29 - i AS last, CAST(u % CAST(30 - i AS UHUGEINT) AS BIGINT) AS other FROM n),
    s AS (SELECT CAST(30 AS BIGINT) AS last, range(30) AS items UNION ALL
        SELECT t.last, list_transform(range(30), lambda j: CASE WHEN j = t.last THEN s.items[t.other + 1] WHEN j = t.other THEN s.items[t.last + 1] ELSE s.items[j + 1] END) FROM s JOIN turns t ON t.last = s.last - 1)
    SELECT unnest(range(30)) AS place, unnest(items) AS item FROM s WHERE last = 1""")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = list(range(30))
    SplitMix64(5).shuffle(items)
    return spark.createDataFrame(list(enumerate(items)), "place long, item long")


@query("SELECT * FROM (VALUES ('l2', 'l2'), ('Euclidean', 'l2'), ('cosine', 'cosine'), (' COS ', 'cosine'), ('ip', 'inner_product'), ('inner_product', 'inner_product'), ('hamming', 'none')) t(name, metric)")
def metric_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    def parsed(name: str) -> str:
        try:
            return str(metrics.Metric.parse(name))
        except InvalidParameter:
            return "none"

    return spark.createDataFrame([(n, parsed(n)) for n in ("l2", "Euclidean", "cosine", " COS ", "ip", "inner_product", "hamming")], "name string, metric string")


@query("SELECT vec_id AS qid, CAST(len(embedding) AS INTEGER) AS dim, round(CAST(embedding[2] AS DOUBLE), 5) AS second FROM embeddings")
def jsonl_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "jsonl")
    read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).write.json(path)
    return read_queries(spark, path, 64).select("qid", F.size("vector").alias("dim"), F.round(F.element_at("vector", 2).cast("double"), 5).alias("second"))


@query("SELECT * FROM (VALUES ('1, 2.5', 2, 3.5::DOUBLE), ('[0.25,-1e2,3]', 3, -96.75::DOUBLE), ('x', 0, NULL), ('', 0, NULL)) t(text, n, total)")
def vector_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    def parsed(text: str) -> list[float]:
        try:
            return parse_vector(text)
        except InvalidParameter:
            return []

    return spark.createDataFrame([(t, len(v := parsed(t)), sum(v) if v else None) for t in ("1, 2.5", "[0.25,-1e2,3]", "x", "")], "text string, n int, total double")


@query("SELECT true AS reached, true AS removed, count(*) - 1 AS left_over FROM embeddings")
def index_in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index class over the embeddings, one index of at most about INDEX_ROWS vectors in a task's memory; every query asks all."""
    import pyarrow as pa

    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    n, first = rows.agg(F.count(F.lit(1)), F.min("id")).first()
    shards = max(1, -(-n // INDEX_ROWS))
    asked = queries_of(rows)
    matrix = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)

    def one(own: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if own.num_rows:
            own = own.sort_by("id")
            ids, x = own.column("id").to_numpy(), matrix(own.column("vector"))
            index = Index(x.shape[1], m=12, ef_construction=60)
            index.add_batch(x, ids)
            for qid, q in zip(queries.column("qid").to_pylist(), matrix(queries.column("q")) if queries.num_rows else (), strict=True):
                out += [(qid, i, d, None, None) for i, d in index.search(q, 10, 96)]
            removed = ids[0] != first or (index.remove(first) and not index.remove(first) and first not in {i for i, _ in index.search(x[0], 10)})
            out.append((None, None, None, bool(removed), index.compact().node_count))
        types = (pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64())
        return pa.table([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names=["qid", "id", "distance", "removed", "left_over"])

    left = rows.select(hnsw.shard_of(F.col("id"), shards).alias("shard"), "id", "vector")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("of_shard"), "qid", F.col("vector").alias("q"))
    path = work_dir(spark, "indexes")
    left.groupBy("shard").cogroup(right.groupBy("of_shard")).applyInArrow(one, "qid long, id long, distance double, removed boolean, left_over long").write.parquet(path)
    found = spark.read.parquet(path)
    hits = exact.rank_hits(found.where("qid is not null").select("qid", "id", "distance"), 10)
    upkeep = found.where("qid is null").agg(F.every("removed").alias("removed"), F.sum("left_over").alias("left_over"))
    return _reached(exact.recall(hits, exact.knn_batch(rows, asked, 10), 10), 0.95).crossJoin(upkeep)


@query("SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE) * 2, 5) AS first FROM embeddings WHERE vec_id % 3 <> 0")
def stream_into_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file stream of changes: each id is upserted twice, and every third then deleted."""
    base = work_dir(spark, "stream")
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    twice = F.transform("vector", lambda x: (x * 2).cast("float"))
    first = rows.select("id", F.lit("upsert").alias("op"), "vector", F.lit(1).alias("at"))
    second = rows.select("id", F.lit("upsert").alias("op"), twice.alias("vector"), F.lit(2).alias("at"))
    third = rows.where("id % 3 = 0").select("id", F.lit("delete").alias("op"), F.lit(None).cast("array<float>").alias("vector"), F.lit(3).alias("at"))
    changes = first.unionByName(second).unionByName(third)
    changes.write.parquet(f"{base}/changes")
    Collection.create(spark, f"{base}/root", "streamed", rows.select(F.size("vector")).first()[0])
    stream = spark.readStream.schema(changes.schema).parquet(f"{base}/changes")
    run = start_ingest(stream, spark, f"{base}/root", "streamed", f"{base}/checkpoint")
    run.awaitTermination()
    live = Collection.open(spark, f"{base}/root", "streamed").live()
    return live.select("id", F.round(F.element_at("vector", 1).cast("double"), 5).alias("first"))


# Ordinary queries over the other tables: extensions, not operators of the engine


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def extension_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer
    JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""")
def extension_revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li, n = (read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "nation"))
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
