import json

import numpy as np
import pytest

from nearfield.__main__ import main
from nearfield.api import Service
from nearfield.errors import Conflict, Corrupted, DimensionMismatch, InvalidParameter, NotFound, NumericError, TooLarge
from nearfield.sources import files
from nearfield.sources.collection import Collection, check_name, list_collections
from nearfield.sources.vectors import from_numpy, parse_vector, read_jsonl
from nearfield.streaming.ingest import start_ingest


def rows(spark, pairs):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in pairs], "id long, vector array<float>")


def ids(spark, *values):
    return spark.createDataFrame([(i,) for i in values], "id long")


def test_newest_wins_through_flush_and_reopen(spark, tmp_path):
    root = f"file://{tmp_path}"
    c = Collection.create(spark, root, "c", 2)
    assert c.upsert(rows(spark, [(1, [1, 1]), (2, [2, 2]), (3, [3, 3])])) == 3
    assert c.flush() and c.flush() is None
    c.upsert(rows(spark, [(1, [9, 9])]))
    assert c.delete(ids(spark, 2, 77)) == 1
    c.flush(graph_shards=1)
    again = Collection.open(spark, root, "c")
    assert {r.id: list(r.vector) for r in again.live().collect()} == {1: [9, 9], 3: [3, 3]}
    asked = spark.createDataFrame([(0, [9.0, 9.0])], "qid long, vector array<double>")
    for strategy in ("exact", "graph"):
        assert [r.id for r in again.search(asked, 5, strategy=strategy).orderBy("rank").collect()] == [1, 3]
    again.verify()
    assert again.contains(3) and not again.contains(2) and len(again) == 2 and again.stats()["superseded"] == 4
    again.compact()
    assert again.stats()["rows"] == 2 and len(Collection.open(spark, root, "c")) == 2
    again.delete(ids(spark, 1, 3))
    assert again.compact() is None and len(again) == 0


def test_errors_and_recovery(spark, tmp_path):
    root = f"file://{tmp_path}"
    c = Collection.create(spark, root, "c", 2, "cosine")
    with pytest.raises(Conflict):
        Collection.create(spark, root, "c", 2)
    with pytest.raises(NotFound):
        Collection.open(spark, root, "d")
    with pytest.raises(DimensionMismatch):
        c.upsert(rows(spark, [(1, [1, 2, 3])]))
    with pytest.raises(NumericError):
        c.upsert(rows(spark, [(1, [float("nan"), 1])]))
    for bad in ("..", "a/b", "", "x" * 129):
        with pytest.raises(InvalidParameter):
            check_name(bad)
    assert c.upsert(rows(spark, [])) == 0
    c.upsert(rows(spark, [(1, [3, 4])]))
    assert c.get(1) == pytest.approx([0.6, 0.8])
    orphan = "pending-0000000001-dead"  # of a writer that died before its commit
    rows(spark, [(5, [1, 1])]).write.parquet(f"{root}/c/{orphan}")
    assert len(Collection.open(spark, root, "c")) == 1 and orphan in files.names(spark, f"{root}/c")
    c.clean()
    assert len(Collection.open(spark, root, "c")) == 1 and orphan not in files.names(spark, f"{root}/c")
    part = c.manifest["pending"][0]["part"]
    files.remove(spark, f"{root}/c/{part}")
    with pytest.raises(Corrupted):
        c.verify()


def test_metadata_and_filters(spark, tmp_path):
    c = Collection.create(spark, f"file://{tmp_path}", "c", 2)
    c.upsert(rows(spark, [(i, [i, 0]) for i in range(6)]))
    c.set_metadata_rows({0: {"group": "even", "tags": ["t"]}, 1: {"group": "odd"}, 2: {"group": "even", "score": 3}})
    c.set_metadata_rows({1: {"group": "even"}})
    c.clear_metadata(ids(spark, 0))
    found = lambda f, **k: sorted(r.id for r in c.matching(f, **k).collect())
    assert found("group == even") == [1, 2] and found("NOT group EXISTS") == [0, 3, 4, 5]
    assert found("NOT group == odd", require_metadata=True) == [1, 2]
    asked = spark.createDataFrame([(0, [0.0, 0.0])], "qid long, vector array<double>")
    got = c.search(asked, 1, filter="score >= 3", include_metadata=True).collect()
    assert [(r.id, r.metadata["group"]["s"]) for r in got] == [(2, "even")]
    c.rewrite_metadata()
    assert c.metadata().count() == 2 and found("group == even") == [1, 2]
    c.verify()


def test_service(spark, tmp_path):
    s = Service(spark, f"file://{tmp_path}")
    s.create("c", 2, m=8)
    assert s.upsert("c", [{"id": 1, "vector": [0, 0], "metadata": {"k": "x"}}, {"id": 2, "vector": [5, 5]}]) == {"upserted": 2}
    assert s.search("c", [[0, 1]], 2, include_metadata=True)[0][0] == {"id": 1, "distance": 1.0, "metadata": {"k": "x"}}
    assert s.search("c", [[0, 1]], 2, filter="k EXISTS") == [[{"id": 1, "distance": 1.0}]]
    assert s.delete("c", [1, 9]) == {"deleted": 1} and s.flush("c")["segment"]
    assert s.verify("c") == {"ok": True} and s.stats("c")["live"] == 1 and s.metrics()["calls"]["search"] == 2
    for bad, error in ((lambda: s.search("c", [], 1), InvalidParameter), (lambda: s.search("c", [[0, 0]], 0), InvalidParameter), (lambda: s.search("c", [[0, 0]], 1001), TooLarge), (lambda: s.upsert("c", [{"id": 1, "vector": [1]}]), DimensionMismatch), (lambda: s.stats("nope"), NotFound)):
        with pytest.raises(error) as e:
            bad()
        assert e.value.payload()["error"]["code"] == error.code
    s.drop("c")
    assert s.list() == [] and s.health()["status"] == "ok"


def test_sources(spark, tmp_path):
    path = tmp_path / "v.jsonl"
    path.write_text('{"id": 1, "vector": [1, 2], "more": {}}\n\n{"id": 2, "vector": [3, 4]}\n')
    assert {r.id: list(r.vector) for r in read_jsonl(spark, f"file://{path}", 2).collect()} == {1: [1, 2], 2: [3, 4]}
    with pytest.raises(Exception, match="bad vector record"):
        read_jsonl(spark, f"file://{path}", 3).collect()
    assert parse_vector("0.1, 0.2") == [0.1, 0.2]
    for bad in ("", "a, b"):
        with pytest.raises(InvalidParameter):
            parse_vector(bad)
    with pytest.raises(InvalidParameter):
        from_numpy(spark, np.array([1 << 63], np.uint64), np.zeros((1, 2)))


def test_command_line(spark, tmp_path, capsys):
    root = ["--root", f"file://{tmp_path}", "--json"]
    run = lambda *a: (main([*root, *a], spark), json.loads((lambda o: o.out or o.err)(capsys.readouterr())))
    assert run("sample", "s", "--count", "50", "--dim", "4")[1] == {"sampled": 50}
    code, hits = run("search", "s", "--vector", "0,0,0,0", "--k", "3")
    assert code == 0 and [h["rank"] for h in hits] == [1, 2, 3]
    assert run("delete", "s", str(hits[0]["id"]))[1] == {"deleted": 1} and run("stats", "s")[1]["live"] == 49
    assert run("compact", "s")[0] == 0 and run("verify", "s")[1] == {"ok": True} and run("list")[1] == ["s"] == list_collections(spark, root[1])
    assert run("stats", "missing")[0] == 1
    assert run("create", "t", "--dim", "4", "--m", "8", "--ef-construction", "50")[0] == 0
    made = Collection.open(spark, root[1], "t").config
    assert (made.m, made.m0, made.ef_construction) == (8, 16, 50)


def test_stream(spark, tmp_path):
    root = f"file://{tmp_path}"
    Collection.create(spark, root, "c", 1)
    schema = "id long, op string, vector array<float>, at long"
    spark.createDataFrame([(1, "upsert", [1.0], 1), (1, "upsert", [2.0], 2), (2, "upsert", [3.0], 1), (2, "delete", None, 2)], schema).write.parquet(f"{root}/in")
    start_ingest(spark.readStream.schema(schema).parquet(f"{root}/in"), spark, root, "c", f"{root}/check").awaitTermination()
    assert {r.id: list(r.vector) for r in Collection.open(spark, root, "c").live().collect()} == {1: [2.0]}


def test_readers_and_writers_meet(spark, tmp_path):
    root = f"file://{tmp_path}"
    c = Collection.create(spark, root, "c", 2)
    c.upsert(rows(spark, [(1, [1, 1])]))
    part = c._write("pending", c._log(rows(spark, [(2, [2, 2])]), "upsert"))  # written, not yet committed
    reader = Collection.open(spark, root, "c")
    reader.clean()
    Service(spark, root).stats("c")
    assert len(reader) == 1
    c._commit(pending=[*c.manifest["pending"], part], next_seq=c.manifest["next_seq"] + 1)
    c.verify()
    assert len(c) == 2 and len(Collection.open(spark, root, "c")) == 2
    # of two writers the second fails, keeps its state, and may try again
    one, two = (Collection.open(spark, root, "c") for _ in range(2))
    one.upsert(rows(spark, [(3, [3, 3])]))
    with pytest.raises(Conflict):
        two.upsert(rows(spark, [(4, [4, 4])]))
    two.refresh()
    two.upsert(rows(spark, [(4, [4, 4])]))
    assert sorted(r.id for r in two.live().collect()) == [1, 2, 3, 4]
    # a reader outlives one flush
    old = Collection.open(spark, root, "c").live()
    two.flush()
    assert old.count() == 4
    two.clean()
    assert sorted(n.split("-")[0] for n in files.names(spark, f"{root}/c") if not n.startswith(("manifest", "."))) == ["pending"] * 4 + ["segment"]
    two.upsert(rows(spark, [(5, [5, 5])]))
    two.compact()
    assert sorted(n.split("-")[0] for n in files.names(spark, f"{root}/c") if not n.startswith(("manifest", "."))) == ["pending", "segment", "segment"] and len(two) == 5


def test_plan_doesnt_grow_with_parts(spark, tmp_path):
    c = Collection.create(spark, f"file://{tmp_path}", "c", 1)
    sizes = []
    for n in range(12):
        c.upsert(rows(spark, [(n, [n]), (0, [n])]))
        plan = c.live()._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(plan.count("Relation"))
    assert sizes[-1] == sizes[1] <= 3
    assert {r.id: list(r.vector) for r in c.live().collect()} == {n: [float(n or 11)] for n in range(12)}


def test_python_surface(spark, tmp_path):
    c = Collection.create(spark, f"file://{tmp_path}", "c", 2)
    c.add([1, 2], 7)
    assert c.add_batch([[0, 0], [5, 5], [3, 4]], [1, 2, 1]) == 2 and c.remove(2) and not c.remove(2)
    assert c.search_one([3, 4], 5) == [(1, 0.0), (7, 8.0)]
    with pytest.raises(InvalidParameter):
        c.add_batch([1, 2], [3])
    upserts = spark.createDataFrame([(9, [1.0, 1.0], 1), (9, [2.0, 2.0], 3), (9, [0.0, 0.0], 2)], "id long, vector array<float>, at int").repartition(3)
    assert c.upsert(upserts, order="at") == 1 and c.get(9) == [2.0, 2.0]


def test_service_uses_graphs(spark, tmp_path):
    s = Service(spark, f"file://{tmp_path}")
    s.create("c", 2, ef_search=8)
    s.upsert("c", [{"id": i, "vector": [i, i % 7]} for i in range(60)])
    s.flush("c")
    s.upsert("c", [{"id": 5, "vector": [500, 0]}, {"id": 60, "vector": [20.2, 6]}])
    assert s.stats("c")["graphs"] == 1
    got = s.search("c", [[20, 6], [5, 5]], 2, ef=64)
    assert [h["id"] for h in got[0]] == [20, 60] and 5 not in [h["id"] for h in got[1]]
    text = s.metrics_text()
    assert 'nearfield_collection_graphs{collection="c"} 1' in text and 'nearfield_calls_total{operation="search"} 1' in text


def test_batches_are_flushed_and_applied_once(spark, tmp_path):
    root = f"file://{tmp_path}"
    c = Collection.create(spark, root, "c", 1)
    schema = "id long, op string, vector array<float>, at long"
    for n in range(7):
        spark.createDataFrame([(n, "upsert", [float(n)], n), (n - 2, "delete", None, n)], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    start_ingest(stream, spark, root, "c", f"{root}/check", flush_parts=2, compact_segments=2).awaitTermination()
    c.refresh()
    assert len(c.manifest["pending"]) < 2 and len(c.manifest["segments"]) < 2 and c.manifest["streams"][f"{root}/check"] == 6
    assert len(c) == 2
    c.verify()
