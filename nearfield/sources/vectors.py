"""Where vectors come from: JSON lines, text literals, numpy arrays, and a seeded generator."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.errors import DimensionMismatch, EmptyIndex, InvalidParameter
from nearfield.functions.metrics import Metric, prepare_array
from nearfield.functions.rng import SplitMix64, floats, integers

MOST_ID = (1 << 63) - 1


def read_jsonl(spark: SparkSession, path: str, dim: int | None = None, *, need_rows: bool = False) -> DataFrame:
    """``(id, vector)`` of lines ``{"id": ..., "vector": [...]}``; other fields and blank lines are passed over.

    A malformed line, a record without id or vector, or one of another length than
    ``dim`` fails the read.
    """
    lines = spark.read.schema("id long, vector array<float>").option("mode", "FAILFAST").json(path)
    broken = F.col("id").isNull() | F.col("vector").isNull() | F.exists("vector", lambda x: x.isNull())
    if dim is not None:
        broken = broken | (F.size("vector") != dim)
    checked = F.when(broken, F.raise_error(F.concat(F.lit("bad vector record: "), F.to_json(F.struct("id", "vector"))))).otherwise(F.col("vector"))
    out = lines.select("id", checked.cast("array<float>").alias("vector"))
    if need_rows and out.isEmpty():
        raise EmptyIndex(f"{path} has no records")
    return out


def read_queries(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    return read_jsonl(spark, path, dim, need_rows=True).withColumnRenamed("id", "qid")


def parse_vector(text: str) -> list[float]:
    """``"0.1, 0.2"`` as numbers; brackets are allowed."""
    try:
        values = [float(x) for x in text.strip().removeprefix("[").removesuffix("]").split(",") if x.strip()]
    except ValueError as e:
        raise InvalidParameter(f"not a vector: {text!r}") from e
    if not values:
        raise InvalidParameter("empty vector")
    return values


def from_numpy(spark: SparkSession, ids, vectors) -> DataFrame:
    """``(id, vector)`` of an (n,) and an (n, dim) array, by Arrow."""
    x = np.asarray(vectors, np.float32)
    i = np.asarray(ids)
    if x.ndim != 2 or i.shape != (len(x),):
        raise DimensionMismatch(len(i), len(x) if x.ndim == 2 else x.ndim)
    if len(i) and (int(i.max()) > MOST_ID or int(i.min()) < 0):
        raise InvalidParameter("ids must be from 0 to 2^63 - 1")
    if not np.isfinite(x).all():
        raise InvalidParameter("vectors must be finite")
    column = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float32())) if x.size else pa.array([[]] * len(x), pa.list_(pa.float32()))
    return spark.createDataFrame(pa.table({"id": pa.array(i.astype(np.int64)), "vector": column}))


def sample(count: int, dim: int, metric: str | Metric = "l2", clusters: int = 16, seed: int = 7, spread: float = 0.35) -> tuple[list[int], np.ndarray]:
    """A clustered corpus from a seed: centres within [-1, 1), rows within ``spread`` of one; unit length for cosine."""
    if count < 1 or dim < 1 or clusters < 1:
        raise InvalidParameter("count, dim and clusters must be positive")
    metric = Metric.parse(metric)
    rng = SplitMix64(seed)
    centres = (floats(rng.state, np.arange(clusters * dim)).reshape(clusters, dim) * 2 - 1).astype(np.float32)
    rng.skip(clusters * dim)
    # each row takes one number for its centre and then one a component
    first = np.arange(count) * (dim + 1)
    centre = (integers(rng.state, first) % np.uint64(clusters)).astype(np.int64)
    out = np.empty((count, dim), np.float32)
    for component in range(dim):
        away = (floats(rng.state, first + 1 + component) * 2 - 1) * spread
        out[:, component] = centres[centre, component] + away.astype(np.float32)
    return list(range(count)), prepare_array(metric, out).astype(np.float32)
