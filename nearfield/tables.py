"""The shared tables as vectors, metadata and change logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, vector)``: embeddings scaled by their label, so that metrics rank them differently."""
    rows = read(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (1 + F.col("label"))).alias("vector"))


def queries_of(rows: DataFrame) -> DataFrame:
    """Every row whose id is divisible by 50, as a query."""
    return rows.where("id % 50 = 0").select(F.col("id").alias("qid"), "vector")


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, vector, label, lang, source, n_chars, quality, toxic, tags)``: fields are null where an embedding has no document or label."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    y = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    tags = F.when(F.col("lang").isNotNull(), F.array("lang", "source"))
    return e.join(d, "id", "left").join(y, "id", "left").withColumn("tags", tags)


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder under the session's shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="nearfield-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
