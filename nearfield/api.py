"""Session-level classes: an in-memory index, and the functions of a service without its transport."""

from __future__ import annotations

import time
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession

from nearfield.errors import DimensionMismatch, Forbidden, InvalidParameter, NearfieldError, TooLarge
from nearfield.functions.metrics import Metric
from nearfield.operators.hnsw import HnswConfig, HnswGraph
from nearfield.plans import filters
from nearfield.sources import collection as collections
from nearfield.sources.collection import Collection
from nearfield.sources.vectors import from_numpy, sample

__all__ = ["Collection", "Index", "Service", "sample"]


class Index:
    """An index in the driver's memory, for corpora that fit it."""

    def __init__(self, dim: int, metric: str = "l2", m: int = 16, m0: int = 32, ef_construction: int = 200, seed: int | None = None):
        config = HnswConfig(m, m0, ef_construction, seed=1 if seed is None else seed)
        self.graph = HnswGraph(dim, Metric.parse(metric), config)

    dim = property(lambda self: self.graph.dim)
    metric = property(lambda self: str(self.graph.metric))
    len = property(lambda self: len(self.graph))
    node_count = property(lambda self: self.graph.node_count)
    memory_bytes = property(lambda self: self.graph.memory_bytes)

    def __len__(self) -> int:
        return len(self.graph)

    def add(self, vector, id: int) -> None:
        self.graph.insert(id, vector)

    def add_batch(self, vectors, ids) -> int:
        vectors = np.asarray(vectors, np.float32)
        if vectors.ndim != 2 or len(vectors) != len(ids):
            raise InvalidParameter("need an (n, dim) array and n ids")
        self.graph.insert_batch(ids, vectors)
        return len(vectors)

    def remove(self, id: int) -> bool:
        return self.graph.delete(id)

    def search(self, vector, k: int, ef: int | None = None) -> list[tuple[int, float]]:
        return self.graph.search(vector, k, ef)

    def compact(self) -> Index:
        new = object.__new__(Index)
        new.graph = self.graph.compact()
        return new


@dataclass(frozen=True)
class Limits:
    points: int = 4096
    deletes: int = 100_000
    queries: int = 64
    k: int = 1000
    filter_bytes: int = 4096


@dataclass
class Service:
    """What an HTTP front end would call: checked requests in, plain rows out."""

    spark: SparkSession
    root: str
    limits: Limits = field(default_factory=Limits)
    read_only: bool = False
    #: Vectors of a segment in one graph.
    graph_rows: int = 100_000

    def __post_init__(self):
        self.started = time.time()
        self.counts: Counter = Counter()
        self.seconds: Counter = Counter()

    def _call(self, name: str, act):
        began = time.perf_counter()
        try:
            return act()
        except NearfieldError:
            self.counts[f"{name}_errors"] += 1
            raise
        finally:
            self.counts[name] += 1
            self.seconds[name] += time.perf_counter() - began

    def _writable(self) -> None:
        if self.read_only:
            raise Forbidden("the service is read-only")

    def _open(self, name: str) -> Collection:
        return Collection.open(self.spark, self.root, name)

    def health(self) -> dict:
        return {"status": "ok", "seconds": time.time() - self.started}

    def list(self) -> list[dict]:
        return self._call("list", lambda: [self._open(n).stats() for n in collections.list_collections(self.spark, self.root)])

    def create(self, name: str, dim: int, metric: str = "l2", m: int | None = None, m0: int | None = None, ef_construction: int = 200, ef_search: int = 64) -> dict:
        self._writable()
        m = 16 if m is None else m
        config = HnswConfig(m, m0 if m0 is not None else 2 * m, ef_construction, ef_search)
        return self._call("create", lambda: Collection.create(self.spark, self.root, name, dim, metric, config).stats())

    def drop(self, name: str) -> None:
        self._writable()
        self._call("drop", lambda: collections.drop(self.spark, self.root, name))

    def stats(self, name: str) -> dict:
        return self._call("stats", lambda: self._open(name).stats())

    def upsert(self, name: str, points: list[dict]) -> dict:
        """Points ``{"id", "vector", "metadata"?}``; a point without metadata keeps what the id had."""
        self._writable()
        if len(points) > self.limits.points:
            raise TooLarge(f"at most {self.limits.points} points")

        def act() -> dict:
            c = self._open(name)
            if not points:
                return {"upserted": 0}
            width = {len(p["vector"]) for p in points}
            if width != {c.dim}:
                raise DimensionMismatch(c.dim, next(iter(width - {c.dim})))
            last = {p["id"]: p for p in points}
            n = c.upsert(from_numpy(self.spark, np.array(list(last)), np.array([p["vector"] for p in last.values()])))
            if rows := {i: p["metadata"] for i, p in last.items() if p.get("metadata") is not None}:
                c.set_metadata_rows(rows)
            return {"upserted": n}

        return self._call("upsert", act)

    def delete(self, name: str, ids: list[int]) -> dict:
        self._writable()
        if len(ids) > self.limits.deletes:
            raise TooLarge(f"at most {self.limits.deletes} ids")

        def act() -> dict:
            c = self._open(name)
            rows = self.spark.createDataFrame([(i,) for i in ids], "id long")
            n = c.delete(rows)
            c.clear_metadata(rows)
            return {"deleted": n}

        return self._call("delete", act)

    def flush(self, name: str) -> dict:
        self._writable()
        return self._call("flush", lambda: {"segment": (c := self._open(name)).flush(-(-c.pending_rows // self.graph_rows))})

    def compact(self, name: str) -> dict:
        self._writable()
        return self._call("compact", lambda: {"segment": (c := self._open(name)).compact(-(-c.gauges()["rows"] // self.graph_rows))})

    def verify(self, name: str) -> dict:
        return self._call("verify", lambda: self._open(name).verify() or {"ok": True})

    def search(self, name: str, queries: list[list[float]], k: int, *, filter: str | None = None, ef: int | None = None, include_metadata: bool = False) -> list[list[dict]]:
        if not queries:
            raise InvalidParameter("no queries")
        if len(queries) > self.limits.queries or k > self.limits.k or len((filter or "").encode()) > self.limits.filter_bytes:
            raise TooLarge(f"at most {self.limits.queries} queries, k of {self.limits.k} and filters of {self.limits.filter_bytes} bytes")
        if k < 1:
            raise InvalidParameter("k must be positive")

        def act() -> list[list[dict]]:
            c = self._open(name)
            asked = self.spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(queries)], "qid long, vector array<double>")
            out: list[list[dict]] = [[] for _ in queries]
            for r in c.search(asked, k, filter=filter, ef=ef, strategy="auto", include_metadata=include_metadata).orderBy("qid", "rank").collect():
                hit = {"id": r.id, "distance": r.distance}
                if include_metadata:
                    hit["metadata"] = {key: filters.untagged(v.asDict()) for key, v in r.metadata.items()} if r.metadata else None
                out[r.qid].append(hit)
            return out

        return self._call("search", act)

    def metrics(self) -> dict:
        """Calls, errors and seconds by operation, and gauges of each collection from its manifest."""
        gauges = {n: self._open(n).gauges() for n in collections.list_collections(self.spark, self.root)}
        return {"calls": dict(self.counts), "seconds": dict(self.seconds), "collections": gauges}

    def metrics_text(self) -> str:
        """:meth:`metrics` in the text format that monitoring systems collect."""
        m = self.metrics()
        lines = ["# TYPE nearfield_uptime_seconds gauge", f"nearfield_uptime_seconds {time.time() - self.started:.3f}"]
        for name, kind, values in (("nearfield_calls_total", "counter", m["calls"]), ("nearfield_call_seconds_total", "counter", m["seconds"])):
            lines += [f"# TYPE {name} {kind}", *(f'{name}{{operation="{k}"}} {v}' for k, v in sorted(values.items()))]
        for gauge in ("rows", "pending", "segments", "graphs"):
            name = f"nearfield_collection_{gauge}"
            lines += [f"# TYPE {name} gauge", *(f'{name}{{collection="{c}"}} {g[gauge]}' for c, g in sorted(m["collections"].items()))]
        return "\n".join(lines) + "\n"
