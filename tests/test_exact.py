import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.errors import DimensionMismatch, InvalidParameter
from nearfield.functions import metrics
from nearfield.functions.metrics import Metric
from nearfield.functions.rng import SplitMix64
from nearfield.operators import exact
from nearfield.operators.scalar_quantizer import ScalarQuantizer


def frame(spark, rows, key="id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"{key} long, vector array<double>")


def test_metric_names():
    assert Metric.parse(" Euclidean ") is Metric.L2 and Metric.parse("ip") is Metric.INNER_PRODUCT and Metric.parse("cos") is Metric.COSINE
    with pytest.raises(InvalidParameter):
        Metric.parse("hamming")


def test_cosine_ignores_length_and_zero_vectors_are_at_one(spark):
    rows = frame(spark, [(1, [1, 0, 0, 0]), (2, [0, 1, 0, 0]), (3, [0, 0, 0, 0])])
    got = exact.knn(rows, [3, 0, 0, 0], 3, "cosine").collect()
    assert [r.id for r in got] == [1, 2, 3] and got[0].distance < 1e-9 and got[2].distance == 1
    assert metrics.prepare_array(Metric.COSINE, np.zeros(3)).tolist() == [0, 0, 0]


@pytest.mark.parametrize("options", [{}, {"strategy": "sql"}, {"small": 0, "block": 2}, {"spread": 3}])
def test_ties_and_bounds_of_k(spark, options):
    rows = frame(spark, [(9, [1, 0]), (3, [0.5, 0.5]), (1, [0.5, 0.5]), (4, None or [0, 9])])
    asked = frame(spark, [(0, [0.5, 0.5]), (7, [1, 0])], "qid")
    got = [(r.qid, r.rank, r.id) for r in exact.knn_batch(rows, asked, 3, **options).orderBy("qid", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 3), (0, 3, 9), (7, 1, 9), (7, 2, 1), (7, 3, 3)]
    assert exact.knn_batch(rows, asked, 0, **options).count() == 0
    assert exact.knn_batch(rows, asked, 99, **options).count() == 8
    assert exact.knn_batch(rows, asked.limit(0), 3, **options).count() == 0


@pytest.mark.parametrize("metric", ["l2", "cosine", "inner_product"])
def test_batch_equals_columns(spark, metric):
    rng = np.random.default_rng(3)
    rows = frame(spark, list(enumerate(rng.normal(size=(60, 5)))))
    asked = frame(spark, list(enumerate(rng.normal(size=(7, 5)))), "qid")
    a = exact.knn_batch(rows, asked, 4, metric).orderBy("qid", "rank").collect()
    b = exact.knn_batch(rows, asked, 4, metric, strategy="sql").orderBy("qid", "rank").collect()
    assert [(r.qid, r.id) for r in a] == [(r.qid, r.id) for r in b]
    assert np.allclose([r.distance for r in a], [r.distance for r in b])


def test_widths_are_checked(spark):
    rows = frame(spark, [(1, [1, 0])])
    with pytest.raises(DimensionMismatch):
        exact.check_width(rows, 3)
    with pytest.raises(DimensionMismatch):
        metrics.l2_squared_batch(np.zeros(2), np.zeros((4, 3)))


def test_recall_and_mrr(spark):
    truth = spark.createDataFrame([(0, 1, 10), (0, 2, 11), (1, 1, 12), (1, 2, 13)], "qid long, rank int, id long")
    found = spark.createDataFrame([(0, 1, 11), (0, 2, 10)], "qid long, rank int, id long")
    assert exact.recall(found, truth, 2).first()[0] == 0.5
    assert exact.mrr(found, truth).first()[0] == 0.25
    assert exact.recall(found, truth, 0).first()[0] == 0 and exact.recall(found, truth.limit(0), 2).first()[0] == 0


def test_generator_is_fixed():
    rng = SplitMix64(0)
    first = [rng.next_u64() for _ in range(2)]
    assert first == [0x6E789E6AA1B965F4, 0x06C45D188009454F]  # of the published sequence, from its second number on
    items = list(range(10))
    SplitMix64(1).shuffle(items)
    assert sorted(items) == list(range(10)) and 0 <= SplitMix64(3).next_f64() < 1


def test_scalar_quantizer(spark):
    rows = frame(spark, [(1, [0, 5]), (2, [255, 5]), (3, [100.5, 5])])
    model = ScalarQuantizer.train(rows)
    codes = {r.id: list(r.c) for r in rows.select("id", model.encode(F.col("vector")).alias("c")).collect()}
    assert codes == {1: [0, 0], 2: [255, 0], 3: [101, 0]} and model.scale == (1.0, 1.0) and model.max_abs_error == 0.5
    assert model.dim == model.code_len == 2 and model.param_bytes == 16
    back = rows.select(model.decode(model.encode(F.col("vector"))).alias("v")).collect()
    assert [list(r.v) for r in back] == [[0, 5], [255, 5], [101, 5]]
    with pytest.raises(InvalidParameter):
        ScalarQuantizer((0.0,), (0.0,))


@pytest.mark.parametrize("options", [{}, {"small": 1}, {"strategy": "sql"}])
def test_vectors_of_another_length_fail_the_search(spark, options):
    rows = spark.createDataFrame([(1, [0.0, 1.0, 2.0]), (2, [0.0])], "id long, vector array<double>")
    asked = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0])], "qid long, vector array<double>")
    with pytest.raises(Exception, match="dimension"):
        exact.knn_batch(rows, asked, 2, **options).collect()
    with pytest.raises(Exception, match="dimension"):
        exact.knn(rows, [0.0, 0.0], 2).collect()
    with pytest.raises(DimensionMismatch):
        exact.knn_batch(rows, spark.createDataFrame([(0, [0.0]), (1, [1.0, 0.0])], "qid long, vector array<double>"), 2, **options)


@pytest.mark.parametrize("metric", ["l2", "cosine", "inner_product"])
def test_columns_rank_only_pairs_within_a_bound(spark, metric, monkeypatch):
    monkeypatch.setattr(exact, "BOUND_ROWS", 20)
    x = np.random.default_rng(4).normal(size=(90, 6))
    rows = frame(spark, list(enumerate(np.concatenate([x, x[:30]]))))  # copies tie
    asked = frame(spark, list(enumerate(x[:5])), "qid")
    a, b = ([(r.qid, r.rank, r.id) for r in exact.knn_batch(rows, asked, 4, metric, strategy=s).orderBy("qid", "rank").collect()] for s in ("numpy", "sql"))
    assert a == b and len(b) == 20
