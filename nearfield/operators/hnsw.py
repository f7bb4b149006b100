"""Sharded HNSW graphs.

A shard is one graph, built and searched in one task by array operations; a table
of any size is many shards, dealt by the hash of the id.  The persisted form has a
row for each node.  A search asks every shard and ranks what they find, so recall
doesn't fall with the number of shards.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.errors import Corrupted, DimensionMismatch, InvalidParameter
from nearfield.functions.metrics import Metric, distances_batch, prepare_array
from nearfield.functions.rng import SplitMix64
from nearfield.operators.exact import HITS, rank_hits

MOST_LEVELS = 32


@dataclass(frozen=True)
class HnswConfig:
    m: int = 16
    m0: int = 32
    ef_construction: int = 200
    ef_search: int = 64
    seed: int = 1

    def __post_init__(self):
        if self.m < 2 or self.m0 < self.m or self.ef_construction < 1 or self.ef_search < 1:
            raise InvalidParameter("need m >= 2, m0 >= m and positive ef")


#: Entries of the matrices that a step of construction makes at once, and vectors that are linked at once.
ENTRIES, TOGETHER = 1 << 22, 512


def _select(metric: Metric, vectors: np.ndarray, near: np.ndarray, distance: np.ndarray, most: int) -> np.ndarray:
    """Of each row's nodes, which come by distance, up to ``most`` that are nearer to the row's own node than to any chosen before; -1 fills up."""
    rows = np.arange(len(near))
    x = vectors[near]
    if metric is Metric.L2:  # differences are small numbers, which single precision holds well
        x = x - x[:, :1]
    x = x.astype(np.float32)
    between = x @ x.transpose(0, 2, 1)
    if metric is Metric.L2:
        square = (x**2).sum(2)
        between = square[:, :, None] + square[:, None, :] - 2 * between
    else:
        between = 1 - between if metric is Metric.COSINE else -between
    free = near >= 0
    chosen = np.full((len(near), most), -1, np.int32)
    for t in range(most):
        first = free.argmax(1)
        has = free[rows, first]
        if not has.any():
            break
        chosen[has, t] = near[rows, first][has]
        free &= between[rows, first] >= distance
        free[rows, first] = False
    return chosen


@dataclass
class HnswGraph:
    """One graph in memory.

    Nodes are numbered in the order of insertion; deleted ones stay until
    :meth:`compact`.  Each level has an array with a row of neighbours for each
    node, filled up with -1.  Vectors are linked in batches that grow with the graph: the
    candidates of each are the exact nearest among those before it, by matrix
    products, and the diverse ones are chosen for all of a batch at once.
    """

    dim: int
    metric: Metric
    config: HnswConfig = field(default_factory=HnswConfig)

    def __post_init__(self):
        self.metric = Metric.parse(self.metric)
        self.vectors = np.zeros((16, self.dim))
        self.near = [np.full((16, self.config.m0), -1, np.int32)]
        self.levels = np.zeros(16, np.int8)
        self.ids: list[int] = []
        self.live: list[bool] = []
        self.node_of: dict[int, int] = {}
        self.entry: int | None = None
        self.rng = SplitMix64(self.config.seed)
        self.connected = True  # whether connect has seen the last vectors

    def __len__(self) -> int:
        return sum(self.live)

    @property
    def node_count(self) -> int:
        return len(self.ids)

    @property
    def top(self) -> int:
        return int(self.levels[self.entry]) if self.entry is not None else -1

    @property
    def memory_bytes(self) -> int:
        return 4 * self.dim * self.node_count + 17 * self.node_count + 4 * sum(int((x >= 0).sum()) for x in self.near)

    def _prepare(self, vectors) -> np.ndarray:
        x = np.asarray(vectors, np.float64)
        if x.shape[-1:] != (self.dim,):
            raise DimensionMismatch(self.dim, x.shape[-1] if x.ndim else 0)
        return prepare_array(self.metric, x)

    def draw_level(self) -> int:
        u = max(self.rng.next_f64(), 2.0**-53)
        return min(int(-math.log(u) / math.log(self.config.m)), MOST_LEVELS)

    def insert(self, id: int, vector) -> None:
        """Add a vector; an id that is there gets the vector and keeps its links, and lives again if deleted."""
        self.insert_batch([id], np.asarray(vector, np.float64)[None])

    def insert_batch(self, ids, vectors) -> None:
        """Add vectors under ids; of equal ids the last counts, at the place of the first."""
        x = self._prepare(vectors)
        if x.ndim != 2 or len(x) != len(ids):
            raise InvalidParameter("need an (n, dim) array and n ids")
        self.connected = False
        start, rows = self.node_count, []
        for row, id in enumerate(map(int, ids)):
            node = self.node_of.setdefault(id, start + len(rows))
            if node < start:
                self.vectors[node], self.live[node] = x[row], True
            elif node == start + len(rows):
                rows.append(row)
                self.ids.append(id)
                self.live.append(True)
            else:
                rows[node - start] = row
        self._grow(self.node_count)
        self.vectors[start : self.node_count] = x[rows]
        for node in range(start, self.node_count):
            self.levels[node] = self.draw_level()
        while len(self.near) <= self.levels[: self.node_count].max(initial=0):
            self.near.append(np.full((len(self.vectors), self.config.m), -1, np.int32))
        while start < self.node_count:
            end = min(start + max(1, min(start, TOGETHER)), self.node_count)
            self._link(start, end)
            start = end

    def _grow(self, n: int) -> None:
        if (more := max(n, 2 * len(self.vectors)) - len(self.vectors)) and n > len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros((more, self.dim))])
            self.levels = np.concatenate([self.levels, np.zeros(more, np.int8)])
            self.near = [np.concatenate([x, np.full((more, x.shape[1]), -1, np.int32)]) for x in self.near]

    def _link(self, a: int, b: int) -> None:
        """Link nodes a to b - 1 with those before them, on all their levels."""
        for level in range(int(self.levels[a:b].max()) + 1):
            others = np.flatnonzero(self.levels[:b] >= level)
            own = others[others >= a]
            if len(others) < 2:
                continue
            some = self.vectors[others]
            count = min(self.config.ef_construction, len(others))
            step = max(1, ENTRIES // max(len(others), count * count))
            for i in range(0, len(own), step):
                new = own[i : i + step]
                d = self._rough(self.vectors[new], some)
                d[others[None, :] >= new[:, None]] = np.inf
                at = np.argpartition(d, count - 1, axis=1)[:, :count] if count < len(others) else np.broadcast_to(np.arange(len(others)), d.shape)
                d = np.take_along_axis(d, at, 1)
                order = np.lexsort((others[at], d), axis=1)
                d = np.take_along_axis(d, order, 1)
                near = np.where(np.isinf(d), -1, others[np.take_along_axis(at, order, 1)])
                self.near[level][new] = _select(self.metric, self.vectors, near, d, self.near[level].shape[1])
            row, _ = np.nonzero((links := self.near[level][own]) >= 0)
            self._link_back(level, links[links >= 0], own[row])
        best = a + int(self.levels[a:b].argmax())
        if self.entry is None or self.levels[best] > self.levels[self.entry]:
            self.entry = best

    def _rough(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.metric is Metric.L2:
            return (queries**2).sum(1)[:, None] + (rows**2).sum(1) - 2 * queries @ rows.T
        return distances_batch(self.metric, queries, rows)

    def _link_back(self, level: int, to: np.ndarray, new: np.ndarray) -> None:
        """Give nodes ``to`` their new neighbours; those that have too many keep the diverse ones."""
        most = self.near[level].shape[1]
        order = np.lexsort((new, to))
        to, new = to[order], new[order]
        node, first, count = np.unique(to, return_index=True, return_counts=True)
        have = (self.near[level][node] >= 0).sum(1)
        fits = have + count <= most
        of = np.repeat(np.arange(len(node)), count)
        rank = np.arange(len(to)) - first[of]
        small = fits[of]
        self.near[level][to[small], have[of][small] + rank[small]] = new[small]
        full = np.flatnonzero(~fits)
        full = full[np.argsort(count[full], kind="stable")]
        while len(full):
            step = max(1, ENTRIES // int(most + count[full[min(len(full), 64) - 1]]) ** 2)
            part, full = full[: min(step, 64)], full[min(step, 64) :]
            width = int(count[part].max())
            place = np.arange(width)[None, :] < count[part][:, None]
            more = np.where(place, new[np.minimum(first[part][:, None] + np.arange(width), len(new) - 1)], -1)
            near = np.concatenate([self.near[level][node[part]], more], axis=1)
            d = np.stack([self._rough(self.vectors[n][None], self.vectors[x])[0] for n, x in zip(node[part], near, strict=True)])
            d[near < 0] = np.inf
            order = np.lexsort((near, d), axis=1)
            self.near[level][node[part]] = _select(self.metric, self.vectors, np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1), most)

    def connect(self) -> None:
        """See that every node has links towards it, and can be walked to, on the lowest level.

        Pruning drops links to nodes far from all others (long vectors among short
        ones), which a search then meets late or never.  Nodes with less than ``m0`` get
        links from the nearest nodes that have room, those that can't be reached from the nearest that can be.
        """
        if self.connected or self.entry is None:
            return
        n, links = self.node_count, self.near[0]
        need = min(self.config.m0, n - 1)
        for _ in range(16):
            got = np.bincount(links[:n][links[:n] >= 0], minlength=n)
            few = np.flatnonzero(got < need)
            if not len(few) or not len(self._link_from(np.flatnonzero((links[:n] < 0).any(1)), few, need - got[few])):
                break
        reached, fresh = np.zeros(n, bool), np.array([self.entry])
        for _ in range(n):
            while len(fresh):
                reached[fresh] = True
                fresh = np.unique(links[fresh])
                fresh = fresh[fresh >= 0]
                fresh = fresh[~reached[fresh]]
            if not len(lost := np.flatnonzero(~reached)):
                break
            hosts = np.flatnonzero(reached & (links[:n] < 0).any(1))
            if len(hosts):
                fresh = self._link_from(hosts, lost, np.ones(len(lost), np.int64))
            else:  # all are full: a last link makes way
                links[self._nearest(np.flatnonzero(reached), lost[:1], 1)[0, 0], -1] = lost[0]
                reached, fresh = np.zeros(n, bool), np.array([self.entry])
        self.connected = True

    def _nearest(self, hosts: np.ndarray, nodes: np.ndarray, count: int) -> np.ndarray:
        """For each of ``nodes`` up to ``count`` of the nearest other hosts, nearest first; -1 fills up."""
        count = min(count, len(hosts))
        out, step = [], max(1, ENTRIES // len(hosts))
        for i in range(0, len(nodes), step):
            some = nodes[i : i + step]
            d = self._rough(self.vectors[some], self.vectors[hosts])
            d[some[:, None] == hosts[None, :]] = np.inf
            at = np.argpartition(d, count - 1, axis=1)[:, :count]
            d = np.take_along_axis(d, at, 1)
            order = np.lexsort((at, d), axis=1)
            out.append(np.where(np.isinf(np.take_along_axis(d, order, 1)), -1, hosts[np.take_along_axis(at, order, 1)]))
        return np.concatenate(out)

    def _link_from(self, hosts: np.ndarray, nodes: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Link ``nodes`` from up to ``count`` of the nearest hosts each, as far as these have room; the nodes that got a link."""
        links, n = self.near[0], self.node_count
        if not len(hosts):
            return hosts
        at = self._nearest(hosts, nodes, int(count.max()) + 4)
        fits = (at >= 0) & ~(links[np.maximum(at, 0)] == nodes[:, None, None]).any(2)
        fits &= np.cumsum(fits, axis=1) <= count[:, None]
        row, place = np.nonzero(fits)
        order = np.lexsort((nodes[row], place, at[row, place]))  # a host takes those first to whom it is nearest
        host, node = at[row, place][order], nodes[row][order]
        rank = np.arange(len(host)) - np.searchsorted(host, host)
        have = (links[host] >= 0).sum(1)
        fits = have + rank < links.shape[1]
        links[host[fits], (have + rank)[fits]] = node[fits]
        return np.unique(node[fits])

    def _distances(self, q: np.ndarray, nodes) -> np.ndarray:
        return distances_batch(self.metric, q, self.vectors[nodes])

    def neighbours(self, node: int, level: int) -> np.ndarray:
        row = self.near[level][node]
        return row[row >= 0]

    def _greedy(self, q: np.ndarray, at: tuple[float, int], level: int) -> tuple[float, int]:
        while len(near := self.neighbours(at[1], level)):
            d = self._distances(q, near)
            best = int(d.argmin())
            if d[best] >= at[0]:
                break
            at = (float(d[best]), int(near[best]))
        return at

    def _layer(self, q: np.ndarray, start: tuple[float, int], ef: int, passes) -> list[tuple[float, int]]:
        """The up to ``ef`` nearest nodes met on the lowest level that pass, nearest first; others are walked through but not kept."""
        seen = np.zeros(self.node_count, bool)
        seen[start[1]] = True
        frontier = [start]
        kept = [(-start[0], -start[1])] if passes is None or passes[start[1]] else []
        while frontier:
            d, node = heapq.heappop(frontier)
            if len(kept) >= ef and d > -kept[0][0]:
                break
            fresh = self.neighbours(node, 0)
            fresh = fresh[~seen[fresh]]
            if not len(fresh):
                continue
            seen[fresh] = True
            away = self._distances(q, fresh)
            if len(kept) >= ef:
                near = away <= -kept[0][0]
                fresh, away = fresh[near], away[near]
            for x, n in zip(away.tolist(), fresh.tolist(), strict=True):
                if len(kept) < ef or (-x, -n) > kept[0]:
                    heapq.heappush(frontier, (x, n))
                    if passes is None or passes[n]:
                        heapq.heappush(kept, (-x, -n))
                        if len(kept) > ef:
                            heapq.heappop(kept)
        return sorted((-d, -n) for d, n in kept)

    def search(self, vector, k: int, ef: int | None = None, passes=None) -> list[tuple[int, float]]:
        """Up to ``k`` of ``(id, distance)``; ``passes`` is a test of ids, or what it says of each node as an array."""
        q = self._prepare(vector)
        if k <= 0 or self.entry is None:
            return []
        self.connect()
        at = self.entry_descent(q)
        ok = np.array(self.live)
        if passes is not None:
            ok &= passes if isinstance(passes, np.ndarray) else np.array([passes(i) for i in self.ids])
        found = self._layer(q, at, max(ef or self.config.ef_search, k), None if ok.all() else ok)
        return sorted(((self.ids[n], d) for d, n in found), key=lambda h: (h[1], h[0]))[:k]

    def entry_descent(self, q: np.ndarray) -> tuple[float, int]:
        """Distance and node at which a walk from the entry down to the lowest level arrives."""
        at = (float(self._distances(q, [self.entry])[0]), self.entry)
        for level in range(self.top, 0, -1):
            at = self._greedy(q, at, level)
        return at

    def delete(self, id: int) -> bool:
        """Whether a live vector was there."""
        node = self.node_of.get(id)
        if node is None or not self.live[node]:
            return False
        self.live[node] = False
        return True

    def contains(self, id: int) -> bool:
        return id in self.node_of and self.live[self.node_of[id]]

    def get(self, id: int) -> np.ndarray | None:
        """The prepared vector of a live id."""
        return self.vectors[self.node_of[id]].copy() if self.contains(id) else None

    def compact(self) -> HnswGraph:
        new = HnswGraph(self.dim, self.metric, self.config)
        live = np.flatnonzero(self.live)
        if len(live):
            new.insert_batch([self.ids[n] for n in live], self.vectors[live])
        return new

    def stats(self) -> dict:
        n = max(self.node_count, 1)
        return {"live": len(self), "deleted": self.node_count - len(self), "levels": self.top + 1, "mean_degree": int((self.near[0] >= 0).sum()) / n, "memory_bytes": self.memory_bytes, "kernel": "numpy"}

    def verify(self) -> None:
        n = self.node_count
        for level, near in enumerate(self.near):
            node, at = np.nonzero(near >= 0)
            other = near[node, at]
            inside = (node < n) & (other < n)
            bad = ~inside | (other == node) | (self.levels[node] < level) | (self.levels[np.where(inside, other, 0)] < level)
            if bad.any():
                raise InvalidParameter(f"node {node[bad][0]} has a bad link to {other[bad][0]} at level {level}")
        if self.entry is not None and self.levels[self.entry] != self.levels[:n].max():
            raise InvalidParameter("the entry isn't at the top level")

    # persisted form

    SCHEMA = "shard int, node int, id long, live boolean, vector array<double>, links array<array<int>>"

    def to_arrow(self, shard: int) -> pa.Table:
        self.connect()
        n = self.node_count
        lists = self.levels[:n].astype(np.int64) + 1
        outer = np.concatenate([[0], np.cumsum(lists)])
        sizes = np.zeros(outer[-1], np.int64)
        for level, near in enumerate(self.near):
            has = np.flatnonzero(lists > level)
            sizes[outer[has] + level] = (near[has] >= 0).sum(1)
        inner = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.zeros(inner[-1], np.int32)
        for level, near in enumerate(self.near):
            has = np.flatnonzero(lists > level)
            row, at = np.nonzero(near[has] >= 0)
            rank = np.cumsum(near[has] >= 0, axis=1)[row, at] - 1
            flat[inner[outer[has] + level][row] + rank] = near[has][row, at]
        links = pa.ListArray.from_arrays(pa.array(outer, pa.int32()), pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(flat)))
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * self.dim, pa.int32()), pa.array(self.vectors[:n].reshape(-1)))
        return pa.table({"shard": pa.array(np.full(n, shard), pa.int32()), "node": pa.array(np.arange(n), pa.int32()), "id": pa.array(self.ids, pa.int64()), "live": pa.array(self.live, pa.bool_()), "vector": vectors, "links": links})

    @classmethod
    def from_arrow(cls, table: pa.Table, metric: Metric, config: HnswConfig, dim: int | None = None) -> HnswGraph:
        """The graph that :meth:`to_arrow` wrote, checked: numbers of nodes, ids, lengths, and every link."""
        table = table.sort_by("node")
        v = table.column("vector").combine_chunks()
        n = len(v)
        dim = dim if dim is not None else len(v[0]) if n else 0
        graph = cls(dim, metric, config)
        if (table.column("node").to_numpy() != np.arange(n)).any():
            raise Corrupted("nodes of a graph are missing or repeated")
        if (np.diff(np.asarray(v.offsets)) != dim).any() or v.flatten().null_count:
            raise Corrupted("vectors of a graph differ in length")
        graph.ids = table.column("id").to_pylist()
        graph.live = table.column("live").to_pylist()
        graph.node_of = {id: node for node, id in enumerate(graph.ids)}
        if len(graph.node_of) != n or None in graph.node_of or None in graph.live:
            raise Corrupted("ids of a graph are missing or repeated")
        graph._grow(n)
        graph.vectors[:n] = v.flatten().to_numpy().reshape(n, dim)
        links = table.column("links").combine_chunks()
        if links.null_count or links.flatten().null_count:
            raise Corrupted("links of a graph are missing")
        outer = np.asarray(links.offsets) - (links.offsets[0].as_py() if n else 0)
        inner_lists = links.flatten()
        inner = np.asarray(inner_lists.offsets)
        inner = inner - inner[0]
        flat = inner_lists.flatten().to_numpy(zero_copy_only=False)
        lists = np.diff(outer)
        if n and (lists.min() < 1 or lists.max() > MOST_LEVELS + 1):
            raise Corrupted("levels of a graph don't fit")
        graph.levels[:n] = lists - 1
        for level in range(int(lists.max(initial=0))):
            if level:
                graph.near.append(np.full((len(graph.vectors), config.m), -1, np.int32))
            has = np.flatnonzero(lists > level)
            first, last = inner[outer[has] + level], inner[outer[has] + level + 1]
            if (last - first).max(initial=0) > graph.near[level].shape[1]:
                raise Corrupted(f"a node has too many links at level {level}")
            row = np.repeat(np.arange(len(has)), last - first)
            at = np.arange(len(row)) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
            values = flat[first[row] + at]
            if (values < 0).any():
                raise Corrupted("a link leads to no node")
            graph.near[level][has[row], at] = values
        if n:
            graph.entry = int(graph.levels[:n].argmax())
        try:
            graph.verify()
        except InvalidParameter as e:
            raise Corrupted(str(e)) from e
        graph.rng.skip(n)
        return graph


def shard_of(id: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(id), F.lit(shards)).cast("int")


def _vectors_of(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    v = column.combine_chunks()
    wrong = (sizes := np.diff(np.asarray(v.offsets))) != dim
    if wrong.any():
        raise DimensionMismatch(dim, int(sizes[wrong][0]))
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), dim)


def build(vectors: DataFrame, dim: int, metric: str | Metric, config: HnswConfig = HnswConfig(), shards: int = 8) -> DataFrame:  # noqa: B008
    """Graphs of ``vectors(id, vector)``, a row for each node; choose ``shards`` so that one fits a task (about 1e5 vectors)."""
    metric = Metric.parse(metric)

    def one(table: pa.Table) -> pa.Table:
        graph = HnswGraph(dim, metric, config)
        table = table.sort_by("id")
        graph.insert_batch(table.column("id").to_pylist(), _vectors_of(table.column("vector"), dim))
        return graph.to_arrow(table.column("shard")[0].as_py())

    return vectors.select(shard_of(F.col("id"), shards).alias("shard"), "id", "vector").groupBy("shard").applyInArrow(one, HnswGraph.SCHEMA)


def insert(graphs: DataFrame, vectors: DataFrame, dim: int, metric: str | Metric, config: HnswConfig, shards: int) -> DataFrame:
    """The graphs with ``vectors(id, vector)`` inserted; ``shards`` is the number they were built with.

    Only the new vectors are linked; a known id gets its vector and keeps its
    links.  Shards without new vectors pass through as they are.
    """
    metric = Metric.parse(metric)

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return left
        shard = right.column("of_shard")[0].as_py()
        graph = HnswGraph.from_arrow(left, metric, config, dim)
        right = right.sort_by("new_id")
        graph.insert_batch(right.column("new_id").to_pylist(), _vectors_of(right.column("new_vector"), dim))
        return graph.to_arrow(shard)

    new = vectors.select(shard_of(F.col("id"), shards).alias("of_shard"), F.col("id").alias("new_id"), F.col("vector").alias("new_vector"))
    return graphs.groupBy("shard").cogroup(new.groupBy("of_shard")).applyInArrow(one, HnswGraph.SCHEMA)


def get(graphs: DataFrame, id: int) -> list[float] | None:
    """The prepared vector of a live id; the test of the id reaches the scan."""
    row = graphs.where((F.col("id") == id) & F.col("live")).select("vector").first()
    return list(row.vector) if row else None


def contains(graphs: DataFrame, id: int) -> bool:
    return not graphs.where((F.col("id") == id) & F.col("live")).select("id").isEmpty()


def search(graphs: DataFrame, queries: DataFrame, k: int, metric: str | Metric, ef: int | None = None, config: HnswConfig = HnswConfig(), allowed: DataFrame | None = None, small: int = 65_536) -> DataFrame:  # noqa: B008
    """``(qid, rank, id, distance)`` from the graphs for ``queries(qid, vector)``.

    ``allowed`` is a table of the ids that may be hits; the walk still goes
    through the other nodes.  Every query asks every shard: a set of up to ``small`` is
    sent to the tasks, a larger one is dealt into parts of that size that meet the shards.
    """
    metric = Metric.parse(metric)
    out = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])

    def ask(table: pa.Table, asked) -> pa.Table:
        table = table.sort_by("node")
        graph = HnswGraph.from_arrow(table.drop_columns("passes"), metric, config)
        passes = table.column("passes").to_numpy(zero_copy_only=False).astype(bool)
        rows = [(qid, id, d) for qid, vector in asked for id, d in graph.search(vector, k, ef, passes)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out) if rows else out.empty_table()

    if allowed is None:
        graphs = graphs.withColumn("passes", F.lit(True))
    else:
        ids = allowed.select("id").distinct().withColumn("passes", F.lit(True))
        graphs = graphs.join(ids, "id", "left").withColumn("passes", F.coalesce("passes", F.lit(False)))
    columns = ["shard", "node", "id", "live", "vector", "links", "passes"]
    asked = [(r.qid, r.vector) for r in queries.select("qid", "vector").limit(small + 1).collect()]
    if len(asked) <= small:
        return rank_hits(graphs.select(*columns).groupBy("shard").applyInArrow(lambda t: ask(t, asked), HITS), k)
    parts = -(-queries.count() // small)
    shards = graphs.select("shard").distinct()
    left = graphs.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), *columns)
    right = queries.select(F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int").alias("of_part"), "qid", F.col("vector").alias("q")).join(F.broadcast(shards.withColumnRenamed("shard", "of_shard")))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return out.empty_table()
        return ask(a.select(columns), zip(b.column("qid").to_pylist(), b.column("q").to_pylist(), strict=True))

    return rank_hits(left.groupBy("part", "shard").cogroup(right.groupBy("of_part", "of_shard")).applyInArrow(meet, HITS), k)


def delete(graphs: DataFrame, ids: DataFrame) -> DataFrame:
    """The graphs with the nodes of ``ids(id)`` marked as deleted."""
    gone = ids.select("id").distinct().withColumn("gone", F.lit(True))
    return graphs.join(gone, "id", "left").select("shard", "node", "id", (F.col("live") & F.col("gone").isNull()).alias("live"), "vector", "links")


def compact(graphs: DataFrame, dim: int, metric: str | Metric, config: HnswConfig = HnswConfig(), shards: int = 8) -> DataFrame:  # noqa: B008
    return build(graphs.where("live").select("id", "vector"), dim, metric, config, shards)


def stats(graphs: DataFrame) -> DataFrame:
    """One row of counts, levels, mean number of neighbours at the lowest level, and bytes."""
    links = F.aggregate("links", F.lit(0), lambda s, x: s + F.size(x))
    return graphs.agg(
        F.count_if("live").alias("live"),
        F.count_if(~F.col("live")).alias("deleted"),
        F.count_distinct("shard").alias("shards"),
        F.max(F.size("links")).alias("levels"),
        F.avg(F.size(F.element_at("links", 1))).alias("mean_degree"),
        F.sum(4 * F.size("vector") + 17 + 4 * links).alias("memory_bytes"),
    )


def broken_links(graphs: DataFrame) -> DataFrame:
    """Links to the node itself, to no node, or to a node that isn't at the level; empty for sound graphs."""
    links = graphs.select("shard", "node", F.posexplode("links").alias("level", "near")).select("shard", "node", "level", F.explode("near").alias("other"))
    ends = graphs.select("shard", F.col("node").alias("other"), F.size("links").alias("levels"))
    return links.join(ends, ["shard", "other"], "left").where("levels is null or level >= levels or node = other")

