"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that the one before has left and returns those
that go on, with the columns of ``documents``; the last returns token pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import mixing, ngram_join, packing, substring, toxicity
from nearfield.llm.queries import tokenizer_path
from nearfield.llm.storage import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL expresses neither the classifier nor the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, trained on the labelled ones, gives less than one half."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, keep=COLUMNS).where(F.col("score") < 0.5).select(*COLUMNS)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The documents and a number for each row, written once, so that a number names the same row in every read."""
    return materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows connected by links of similarity 0.8 or more, or with the same words, one: that of the least id, null last.

    Rows without words are no copies of each other.  Every row counts by itself,
    also where ids are null or repeated.
    """
    rows = numbered(docs, "near-rows")
    classes = ngram_join.join(rows, id_col="row").select(F.col("doc_id").alias("row"), "class_id")
    keyed = materialize(rows.select("row", "doc_id").join(classes, "row"), "near-classes")
    kept = keyed.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")).select("first.row")
    copies = keyed.select("row").join(kept, "row", "left_anti")
    return rows.join(copies, "row", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 13 words or more that a document with a smaller id holds.

    A text that loses nothing stays as it is; a document that loses all its words goes.
    """
    cut = substring.deduplicate(docs, keep=["doc_id", "lang", "source"], as_they_are=True)
    cut = cut.where("n_removed = 0 or n_removed < n_words")
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, also where ids are null or repeated.

    Rows are numbered and written once, so that a number names the same row in
    both reads; only rows alike in all columns are told apart by it.
    """
    rows = numbered(docs, "mix-rows")
    mixed = mixing.mix(rows.withColumn("key", F.struct("doc_id", F.xxhash64(*COLUMNS).alias("mark"))), id_col="key", keep=["row"])
    taken = rows.join(mixed.where("copies > 0").select("row", F.col("copies").cast("int").alias("copies")), "row")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("mixing sources", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
