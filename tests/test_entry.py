import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
TABLES = "customer documents embeddings labels lineitem nation orders pages part region supplier".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the shared tables are not here")
NAMES = ["knn_cosine_batch", "knn_filtered", "filter_in_and_or_map", "sq8_encode", "pq_asymmetric_search", "ivf_after_delete_and_compact", "collection_filtered_search", "stream_into_collection"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).columns == ["qid", "rank", "id", "distance"]


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_results_equal_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    want = db.sql(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    rows = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).itertuples(index=False, name=None)))
    assert [r.replace(".0,", ",") for r in rows(want)] == [r.replace(".0,", ",") for r in rows(got)]


@needs_data
def test_indexes_in_memory_are_built_in_tasks(spark, monkeypatch):
    """Shards of bounded size; the table isn't collected in the driver."""
    from nearfield import queries
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(*_):
        raise AssertionError("the driver collects the table")

    monkeypatch.setattr(queries, "INDEX_ROWS", 150, raising=False)
    monkeypatch.setattr(DataFrame, "toPandas", refuse)
    assert [tuple(r) for r in queries.index_in_memory(spark, SF_DIR).collect()] == [(True, True, 499)]
