import numpy as np
import pytest

from nearfield.api import Index
from nearfield.errors import InsufficientTrainingData, InvalidParameter
from nearfield.operators import exact, hnsw
from nearfield.operators.clustering import kmeans, kmeans_table, nearest_centroid
from nearfield.operators.hnsw import HnswConfig, HnswGraph
from nearfield.operators.ivf import IvfConfig, IvfIndex
from nearfield.operators.product_quantizer import ProductQuantizer, distances_by_join
from nearfield.sources.vectors import from_numpy, sample


@pytest.fixture(scope="module")
def corpus(spark):
    ids, x = sample(400, 16, "l2", 8, 11)
    rows = from_numpy(spark, ids, x).cache()
    return x, rows, rows.where("id % 40 = 0").withColumnRenamed("id", "qid")


def test_kmeans(spark, corpus):
    x, rows, _ = corpus
    centroids = kmeans(x, 8, 20, 3)
    _, d = nearest_centroid(x.astype(float), centroids)
    assert d.mean() < ((x - x.mean(0)) ** 2).sum(1).mean() / 2
    table = kmeans_table(rows, 8, iterations=10, seed=3)
    assert nearest_centroid(x.astype(float), table)[1].mean() < 1.5 * d.mean()
    with pytest.raises(InsufficientTrainingData):
        kmeans(x[:3], 8)
    with pytest.raises(InvalidParameter):
        kmeans(x, 257)
    same = kmeans(np.ones((5, 2)), 3, 4)
    assert np.isfinite(same).all()


def test_product_quantizer(spark, corpus):
    x, rows, asked = corpus
    q = ProductQuantizer.train(rows, 4, 16, 8)
    codes = q.encode_array(x)
    assert np.allclose(q.distance(x[0], codes), ((q.decode_array(codes) - x[0]) ** 2).sum(1), atol=1e-6)
    joined = {(r.qid, r.id): r.distance for r in distances_by_join(q.encode(rows), asked, q.to_table(spark)).collect()}
    want = q.distance(x[40], codes)
    assert all(abs(joined[(40, i)] - want[i]) < 1e-6 for i in range(400))
    assert (ProductQuantizer.from_table(q.to_table(spark)).codebooks == q.codebooks).all() and q.code_len == 4 and q.codebook_bytes == 4 * 16 * 16
    with pytest.raises(InvalidParameter):
        ProductQuantizer.train_array(x, 5)


@pytest.mark.parametrize("metric", ["l2", "cosine", "inner_product"])
def test_ivf_with_all_lists_is_exact(spark, corpus, tmp_path, metric):
    x, rows, asked = corpus
    index = IvfIndex.train(rows, f"file://{tmp_path}/ivf", metric, IvfConfig(nlist=8, list_iterations=5))
    want = exact.knn_batch(rows, asked, 5, metric).orderBy("qid", "rank").collect()
    got = index.search(asked, 5, nprobe=99).orderBy("qid", "rank").collect()
    assert [(r.qid, r.id) for r in got] == [(r.qid, r.id) for r in want]
    some = exact.recall(index.search(asked, 5, nprobe=3), exact.knn_batch(rows, asked, 5, metric), 5).first()[0]
    assert some <= 1 and index.stats()["live"] == 400


def test_ivf_upkeep(spark, corpus, tmp_path):
    x, rows, asked = corpus
    index = IvfIndex.train(rows, f"file://{tmp_path}/ivf", "l2", IvfConfig(nlist=8, list_iterations=5))
    index.insert(spark.createDataFrame([(0, [9.0] * 16), (1000, [9.5] * 16)], "id long, vector array<double>"))
    assert index.delete(spark.createDataFrame([(1,), (555,)], "id long")) == 1
    assert index.get(0) == [9.0] * 16 and not index.contains(1) and index.contains(1000)
    far = spark.createDataFrame([(0, [10.0] * 16)], "qid long, vector array<double>")
    assert [r.id for r in index.search(far, 2, nprobe=8).orderBy("rank").collect()] == [1000, 0]
    index.compact()
    again = IvfIndex(spark, f"file://{tmp_path}/ivf")
    again.verify()
    assert again.stats()["live"] == 400 and again.stats()["deleted"] == 0
    only = spark.createDataFrame([(5,), (6,)], "id long")
    assert {r.id for r in again.search(far, 9, nprobe=8, allowed=only).collect()} == {5, 6}


def test_ivf_product_quantized(spark, corpus, tmp_path):
    x, rows, asked = corpus
    index = IvfIndex.train(rows, f"file://{tmp_path}/pq", "cosine", IvfConfig(nlist=8, list_iterations=5, pq_m=8, ksub=32, pq_iterations=5))
    truth = exact.knn_batch(rows, asked, 10, "cosine")
    assert exact.recall(index.search(asked, 10, nprobe=8), truth, 10).first()[0] >= 0.5
    assert exact.recall(index.search_reranked(asked, rows, 10, 64, nprobe=8), truth, 10).first()[0] >= 0.9
    assert index.get(3) is None
    index.verify()
    for bad in (dict(nlist=257), dict(nlist=8, pq_m=5)):
        with pytest.raises(InvalidParameter):
            IvfIndex.train(rows, f"file://{tmp_path}/bad", "l2", IvfConfig(**bad))
    with pytest.raises(InvalidParameter):
        IvfIndex.train(rows, f"file://{tmp_path}/bad", "inner_product", IvfConfig(nlist=8, pq_m=8))


def test_rerank_reaches_as_far_as_codes_err(spark, tmp_path):
    """Vectors without clusters under coarse codes: a fixed shortlist holds few of the nearest."""
    x = np.random.default_rng(2).normal(size=(4000, 32))
    rows = from_numpy(spark, np.arange(4000), x).cache()
    asked = rows.where("id % 100 = 0").withColumnRenamed("id", "qid")
    index = IvfIndex.train(rows, f"file://{tmp_path}/coarse", "cosine", IvfConfig(nlist=4, list_iterations=4, pq_m=8, ksub=16, pq_iterations=4))
    hits = index.search_reranked(asked, rows, 10, 20, nprobe=4)
    assert exact.recall(hits, exact.knn_batch(rows, asked, 10, "cosine"), 10).first()[0] >= 0.9 and hits.count() == 400


def test_graph_in_memory():
    ids, x = sample(300, 8, "l2", 6, 2)
    index = Index(8, m=8, m0=16, ef_construction=60)
    assert index.add_batch(x, ids) == 300 and index.len == 300
    hits = sum(len({i for i, _ in index.search(x[q], 10)} & set(np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[:10].tolist())) for q in range(0, 300, 10))
    assert hits / 300 >= 0.95
    assert index.remove(5) and not index.remove(5) and 5 not in {i for i, _ in index.search(x[5], 10)}
    index.add(x[5] + 0.001, 5)  # lives again, with the links it had
    assert index.search(x[5] + 0.001, 2)[0][0] == 5 and index.node_count == 300
    index.remove(7)
    small = index.compact()
    assert small.node_count == 299 and small.memory_bytes > 0
    small.graph.verify()
    assert small.search(x[0], 0) == [] and Index(3).search([0, 0, 0], 4) == []
    with pytest.raises(InvalidParameter):
        HnswConfig(m=64, m0=32)


def test_every_node_of_a_graph_is_met():
    """Long vectors among short ones: pruning drops the links towards them, which a search must still find."""
    x = np.random.default_rng(5).normal(size=(1200, 32))
    x *= (1 + np.arange(1200) % 10)[:, None] / np.linalg.norm(x, axis=1)[:, None]
    graph = HnswGraph(32, "l2", HnswConfig(m=12, m0=24, ef_construction=60))
    graph.insert_batch(range(0, 1200, 2), x[::2])
    graph = HnswGraph.from_arrow(graph.to_arrow(0), graph.metric, graph.config)
    graph.insert_batch(range(1, 1200, 2), x[1::2])
    asked = range(0, 1200, 12)
    assert all(graph.search(x[i], 1, 96)[0][0] == i for i in asked)
    hits = sum(len({i for i, _ in graph.search(x[q], 10, 96)} & set(np.argsort(((x - x[q]) ** 2).sum(1))[:10].tolist())) for q in asked)
    assert hits >= 0.95 * 10 * len(asked)
    graph.verify()


def test_sharded_graphs(spark, corpus):
    x, rows, asked = corpus
    config = HnswConfig(m=8, m0=16, ef_construction=50)
    graphs = hnsw.build(rows, 16, "l2", config, 3).cache()
    truth = exact.knn_batch(rows, asked, 10)
    assert exact.recall(hnsw.search(graphs, asked, 10, "l2", 64, config), truth, 10).first()[0] >= 0.95
    assert hnsw.broken_links(graphs).count() == 0 and hnsw.stats(graphs).first().live == 400
    allowed = rows.where("id < 50").select("id")
    got = hnsw.search(graphs, asked, 5, "l2", 200, config, allowed)
    assert got.where("id >= 50").count() == 0
    gone = hnsw.delete(graphs, rows.where("id % 2 = 0").select("id"))
    assert hnsw.search(gone, asked, 5, "l2", 64, config).where("id % 2 = 0").count() == 0
    assert hnsw.compact(gone, 16, "l2", config, 2).count() == 200
    graph = HnswGraph(16, "l2", config)
    graph.insert_batch(range(400), x)
    again = HnswGraph.from_arrow(graph.to_arrow(0), graph.metric, config)
    assert again.search(x[3], 5) == graph.search(x[3], 5)


def test_persisted_graphs_take_more_vectors(spark, corpus):
    x, rows, asked = corpus
    config = HnswConfig(m=8, m0=16, ef_construction=50)
    graphs = hnsw.build(rows.where("id < 300"), 16, "l2", config, 3).cache()
    changed = rows.where("id >= 300").unionByName(rows.where("id = 5").selectExpr("id", "transform(vector, x -> x + 100) as vector"))
    more = hnsw.insert(graphs, changed, 16, "l2", config, 3).cache()
    assert hnsw.broken_links(more).count() == 0 and hnsw.stats(more).first().live == 400
    assert hnsw.contains(more, 399) and not hnsw.contains(graphs, 399) and hnsw.get(more, 5)[0] == pytest.approx(x[5][0] + 100)
    truth = exact.knn_batch(rows.where("id <> 5").unionByName(changed.where("id = 5")), asked, 10)
    assert exact.recall(hnsw.search(more, asked, 10, "l2", 64, config), truth, 10).first()[0] >= 0.95
    few = hnsw.search(more, asked, 10, "l2", 64, config)
    assert sorted(map(tuple, hnsw.search(more, asked, 10, "l2", 64, config, small=3).collect())) == sorted(map(tuple, few.collect()))


def test_damaged_graphs_are_refused():
    import pyarrow as pa

    from nearfield.errors import Corrupted

    graph = HnswGraph(4, "l2", HnswConfig(m=4, m0=8, ef_construction=20))
    graph.insert_batch(range(60), np.random.default_rng(1).normal(size=(60, 4)))
    table = graph.to_arrow(0)
    assert HnswGraph.from_arrow(table, graph.metric, graph.config).stats() == graph.stats()
    links = table.column("links").to_pylist()

    def damaged(column, values):
        at = table.column_names.index(column)
        return table.set_column(at, column, pa.array(values, table.schema.field(column).type))

    far = [[[99]], *links[1:]]
    own = [[[0]], *links[1:]]
    for bad in (damaged("links", far), damaged("links", own), damaged("id", [1] * 60), damaged("node", [0, *range(59)]), damaged("vector", [[1.0]] + table.column("vector").to_pylist()[1:]), damaged("links", [[list(range(1, 30))], *links[1:]]), damaged("links", [[[-3]], *links[1:]])):
        with pytest.raises(Corrupted):
            HnswGraph.from_arrow(bad, graph.metric, graph.config)


def test_inverted_files_take_any_number_of_queries(spark, corpus, tmp_path, monkeypatch):
    from nearfield.operators import ivf

    x, rows, asked = corpus
    index = ivf.IvfIndex.train(rows, f"file://{tmp_path}/ivf", "l2", ivf.IvfConfig(nlist=4, list_iterations=4))
    want = sorted(map(tuple, index.search(asked, 5, nprobe=2).collect()))
    monkeypatch.setattr(ivf, "TOGETHER", max(2, asked.count() // 2))
    assert sorted(map(tuple, index.search(asked, 5, nprobe=2).collect())) == want


def test_asymmetric_distances_in_blocks(spark, corpus):
    x, rows, asked = corpus
    quantizer = ProductQuantizer.train(rows, 4, 16, 4)
    codes, books = quantizer.encode(rows), quantizer.to_table(spark)
    one, two = (sorted(map(tuple, distances_by_join(codes, asked, books, **o).collect())) for o in ({}, {"most_sent": 2, "block": 3}))
    assert one == two and len(one) == 400 * asked.count()


@pytest.mark.parametrize("options", [{}, {"small": 2, "block": 3}])
def test_nearest_by_codes_keep_no_pairs(spark, corpus, options):
    x, rows, asked = corpus
    quantizer = ProductQuantizer.train(rows, 4, 16, 4)
    codes = quantizer.encode(rows)
    want = exact.rank_hits(distances_by_join(codes, asked, quantizer.to_table(spark)).selectExpr("qid", "id", "round(distance, 9) distance"), 7)
    found = quantizer.search(codes, asked, 7, decimals=9, **options)
    key = lambda r: (r.qid, r.rank, r.id, round(r.distance, 6))
    assert sorted(map(key, found.collect())) == sorted(map(key, want.collect()))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString() and quantizer.search(codes, asked, 0).isEmpty()
    assert quantizer.search(codes, asked.limit(0), 7).isEmpty()
    with pytest.raises(Exception, match="dimension"):
        quantizer.search(codes, asked.selectExpr("qid", "slice(vector, 1, 3) vector"), 7, **options)
