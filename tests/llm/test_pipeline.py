import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_duplicates import brute_cut, brute_join

import corpus_pipeline
from nearfield.llm import mixing, queries

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = [f"word{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    base = rng.choices(vocabulary, k=120)
    docs, labels = [], []
    for i in range(300):
        w = rng.choices(vocabulary, k=rng.randint(20, 120))
        if i % 10 == 3:
            w = list(base)
            w[rng.randrange(len(w))] = "changed"
        if i % 7 == 5:
            w += passage
        toxic = i % 4 == 1
        if toxic:
            for _ in range(8):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum", "moron"]))
        docs.append((i, "  ".join(w), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    docs += [(400, None, None, None, None), (401, "", "en", "s1", 0)]
    folder = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where("doc_id % 3 <> 0").write.parquet(f"{folder}/labels.parquet")
    return folder, {d[0]: d[1] for d in docs}


def test_stages(spark, tables):
    folder, texts = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "substring dedup", "mixing sources", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = [f for _, f in corpus_pipeline.STAGES]
    clean = stage[0](spark, docs, folder).cache()
    left = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == docs.columns
    assert {i for i in left if i % 4 == 1 and i < 300} == set() and len(left) >= 0.9 * (302 - 75)  # few labels to learn from
    single = stage[1](spark, clean, folder).cache()
    groups = brute_join(left)
    assert {r.doc_id for r in single.collect()} == {i for i in left if groups[i][1] == i} and single.columns == docs.columns
    left = {r.doc_id: r.text for r in single.collect()}
    cut = stage[2](spark, single, folder).cache()
    want = brute_cut(left)
    assert {r.doc_id for r in cut.collect()} == {i for i, (n, gone, _) in want.items() if not gone or gone < n}
    for r in cut.collect():
        n, gone, _ = want[r.doc_id]
        assert len(r.text.split()) == n - gone and r.n_chars == len(r.text) and (gone or r.text == (left[r.doc_id] or ""))
    mixed = stage[3](spark, cut, folder).cache()
    assert mixed.columns == docs.columns
    words = lambda d: d.select(F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))).alias("n")).first().n
    assert abs(words(mixed) - 1.5 * words(cut)) <= 0.01 * words(cut)
    assert mixed.groupBy("doc_id").count().where("count > 2").isEmpty()
    pieces = stage[4](spark, mixed, folder)
    tokens = pieces.agg(F.sum("length").alias("n"), F.count_if(F.col("start") == 0).alias("docs")).first()
    assert tokens.docs == mixed.count()
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()


def test_no_documents(spark, tables, tmp_path):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the shared tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_results_equal_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        db.sql(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    want = db.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF_DIR)
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert sorted(map(str, want.project(", ".join(columns)).fetchall())) == sorted(str(tuple(r)) for r in got.select(*columns).collect())


def test_mixing_takes_each_row_by_itself(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(5, 60))) for _ in range(240)]
    docs = [(None if i % 2 else i // 8, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    docs += docs[:20]
    table = spark.createDataFrame(docs, SCHEMA)
    number = spark.createDataFrame([(i, *d[1:]) for i, d in enumerate(docs)], SCHEMA)
    want = {docs[r.doc_id][3]: r.target for r in mixing.mix(number).collect()}
    mixed = [corpus_pipeline.mix_sources(spark, t, "").collect() for t in (table, table.repartition(7))]
    for source, target in want.items():
        words = sum(len(r.text.split()) for r in mixed[0] if r.source == source)
        assert abs(words - target) <= 5
    assert sorted(map(str, mixed[0])) == sorted(map(str, mixed[1]))


def test_near_copies_under_null_and_repeated_ids(spark):
    rng = random.Random(5)
    base = rng.choices([f"w{i}" for i in range(500)], k=80)
    near = " ".join([*base[:-1], "end"])
    text = " ".join(base)
    rows = [(None, text), (7, near), (7, text), (7, text), (9, "something else altogether, and short"), (9, "another text of the same id"), (None, None), (None, ""), (3, " ")]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = corpus_pipeline.drop_near_copies(spark, table.repartition(3), "").collect()
    assert sum(r.doc_id == 7 and r.text in (near, text) for r in got) == 1 and len(got) == 6
    assert sorted(str(r.doc_id) for r in got) == ["3", "7", "9", "9", "None", "None"]
