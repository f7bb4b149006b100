"""Durable collections of vectors: Parquet parts named by a manifest.

Every write is a new part with a rising sequence number, and only parts that the
manifest names exist.  A part is written first and the next version of the manifest
created after, so a writer that dies leaves the collection as it was.  The newest row of an id
counts.  ``flush`` turns pending parts into a sealed segment, ``compact`` leaves one
segment of live rows.

Manifests are numbered, and a version is created only if it isn't there: of two
writers the second fails with a conflict and may refresh and try again.  A part can be
committed only while the manifest's next number is its own, so an unnamed part
of a smaller number is garbage; writers remove such parts when they flush or compact,
readers never remove anything.  Parts that a flush or a compaction replaces stay
until the next one, for readers that opened an earlier manifest.

A read is two scans, whatever the number of parts: the first part, which is large
between compactions, without the ids of later parts, and all later parts, of
which each id's row of the greatest number counts.  A compacted collection is
scanned as it is.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from nearfield.errors import Conflict, Corrupted, DimensionMismatch, InvalidParameter, NotFound, NumericError
from nearfield.functions.metrics import Metric, prepare
from nearfield.operators import hnsw
from nearfield.operators.exact import HITS, knn_batch, rank_hits
from nearfield.plans import filters
from nearfield.sources import files
from nearfield.sources.vectors import from_numpy

FORMAT = 1
MOST_DIMENSIONS = 65_536
LOG = "seq long, id long, op string, vector array<float>"
METADATA_LOG = f"seq long, id long, op string, metadata {filters.METADATA}"
#: Metadata parts are rewritten once they hold so many records and twice those that count.
METADATA_REWRITE = 1024
#: Later parts of at most so many rows, as the manifest counts them, send their ids to all tasks.
MOST_SENT = 1_000_000
#: Manifest versions that stay for readers.
VERSIONS = 8


def check_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9._-]{1,128}", name) or name in (".", ".."):
        raise InvalidParameter(f"bad collection name {name!r}")
    return name


class Collection:
    def __init__(self, spark: SparkSession, root: str, name: str, manifest: dict):
        self.spark, self.root, self.name, self.manifest = spark, root.rstrip("/"), name, manifest
        self.dim, self.metric = manifest["dim"], Metric.parse(manifest["metric"])
        self.config = hnsw.HnswConfig(**manifest["config"])

    # opening

    @classmethod
    def create(cls, spark: SparkSession, root: str, name: str, dim: int, metric: str | Metric = "l2", config: hnsw.HnswConfig = hnsw.HnswConfig()) -> Collection:  # noqa: B008
        check_name(name)
        if not 1 <= dim <= MOST_DIMENSIONS:
            raise InvalidParameter(f"dim={dim} is not within 1 and {MOST_DIMENSIONS}")
        if cls.versions(spark, root, name):
            raise Conflict(f"collection {name} exists")
        manifest = {"format": FORMAT, "name": name, "dim": dim, "metric": str(Metric.parse(metric)), "config": asdict(config), "next_seq": 1, "segments": [], "pending": [], "metadata": [], "retired": [], "streams": {}, "version": 0}
        collection = cls(spark, root, name, manifest)
        collection._commit()
        return collection

    @classmethod
    def open(cls, spark: SparkSession, root: str, name: str) -> Collection:
        """Open the newest manifest, checking it; nothing is changed."""
        versions = cls.versions(spark, root, check_name(name))
        if not versions:
            raise NotFound(f"no collection {name}")
        try:
            manifest = json.loads(files.read_text(spark, cls._manifest_path(root, name, versions[-1])))
        except ValueError as e:
            raise Corrupted(f"manifest of {name}: {e}") from e
        if manifest.get("format") != FORMAT or manifest.get("name") != name or not 1 <= manifest.get("dim", 0) <= MOST_DIMENSIONS:
            raise Corrupted(f"manifest of {name} doesn't fit")
        return cls(spark, root, name, manifest)

    @classmethod
    def open_or_create(cls, spark: SparkSession, root: str, name: str, dim: int, metric: str | Metric = "l2") -> Collection:
        return cls.open(spark, root, name) if cls.versions(spark, root, check_name(name)) else cls.create(spark, root, name, dim, metric)

    @staticmethod
    def _manifest_path(root: str, name: str, version: int) -> str:
        return f"{root.rstrip('/')}/{name}/manifest-{version:010d}.json"

    @staticmethod
    def versions(spark: SparkSession, root: str, name: str) -> list[int]:
        found = (re.fullmatch(r"manifest-(\d{10})\.json", n) for n in files.names(spark, f"{root.rstrip('/')}/{name}"))
        return sorted(int(m[1]) for m in found if m)

    @property
    def path(self) -> str:
        return f"{self.root}/{self.name}"

    def _commit(self, **changes) -> None:
        """Create the next version of the manifest, or leave this one as it is and raise."""
        new = self.manifest | changes | {"version": self.manifest["version"] + 1}
        if not files.create_text(self.spark, self._manifest_path(self.root, self.name, new["version"]), json.dumps(new, indent=1)):
            raise Conflict(f"another writer has changed {self.name} since version {self.manifest['version']}")
        self.manifest = new

    def _named(self) -> set[str]:
        parts = self.manifest["segments"] + self.manifest["pending"] + self.manifest["metadata"]
        return {p["part"] for p in parts} | {p["graph"] for p in parts if p.get("graph")}

    def clean(self) -> None:
        """Remove parts that can't be committed any more and old versions of the manifest; for writers."""
        keep = self._named() | set(self.manifest["retired"])
        for found in files.names(self.spark, self.path):
            part = re.fullmatch(r"(?:pending|segment|graph|metadata)-(\d{10})-[0-9a-f]+", found)
            manifest = re.fullmatch(r"manifest-(\d{10})\.json", found)
            if (part and int(part[1]) < self.manifest["next_seq"] and found not in keep) or (manifest and int(manifest[1]) <= self.manifest["version"] - VERSIONS):
                files.remove(self.spark, f"{self.path}/{found}")

    def refresh(self) -> None:
        """See what another writer has committed."""
        self.manifest = Collection.open(self.spark, self.root, self.name).manifest

    # writing

    def _new_part(self, kind: str) -> str:
        return f"{kind}-{self.manifest['next_seq']:010d}-{uuid.uuid4().hex[:8]}"

    def _write(self, kind: str, rows: DataFrame) -> dict:
        part = self._new_part(kind)
        seen = Observation()
        rows.observe(seen, *self._sums(rows)).write.parquet(f"{self.path}/{part}")  # counted as they are written
        return {"part": part, "rows": seen.get["rows"], "sum": seen.get["sum"] or 0}

    @staticmethod
    def _sums(rows: DataFrame) -> list[Column]:
        """Number of rows and a checksum that doesn't depend on their order."""
        content = F.xxhash64("seq", "id", "op", "vector") if "vector" in rows.columns else F.xxhash64("seq", "id", "op", F.to_json("metadata"))
        return [F.count(F.lit(1)).alias("rows"), F.bit_xor(content).alias("sum")]

    def upsert(self, vectors: DataFrame, order: str | None = None, stream: tuple[str, int] | None = None) -> int:
        """Commit ``vectors(id, vector)`` and return the number of ids.

        Of rows with one id that of the greatest ``order`` counts, of equal ones the greatest vector.
        Without the name of such a column it is the last one in the order of the
        partitions, which isn't the same on every run of a table that was shuffled.
        """
        newest = self._checked(vectors, order)
        return 0 if newest is None else self._append(self._log(newest, "upsert"), stream)

    def _checked(self, vectors: DataFrame, order: str | None = None) -> DataFrame | None:
        """One row an id; none without rows."""
        bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        ids = vectors.withColumn("at", F.monotonically_increasing_id() if order is None else F.struct(F.col(order), F.col("vector")))
        newest = ids.groupBy("id").agg(F.max_by("vector", "at").cast("array<float>").alias("vector"))
        state = vectors.agg(F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high"), F.count_if(bad | F.col("vector").isNull() | F.col("id").isNull() | (F.col("id") < 0)).alias("bad")).first()
        if state.low is None and not state.bad:
            return None
        if state.bad:
            raise NumericError("ids must be there and not negative, and vectors finite")
        for n in (state.low, state.high):
            if n != self.dim:
                raise DimensionMismatch(self.dim, n)
        return newest

    def _log(self, rows: DataFrame, op: str) -> DataFrame:
        vector = F.col("vector") if op == "upsert" else F.lit(None).cast("array<float>").alias("vector")
        return rows.select(F.lit(self.manifest["next_seq"]).cast("long").alias("seq"), F.col("id").cast("long").alias("id"), F.lit(op).alias("op"), vector)

    def delete(self, ids: DataFrame, count: bool = True) -> int | None:
        """Commit the deletion of ``ids(id)``, known or not.  Returns how many were live, for which it reads the collection's ids; none without ``count``."""
        rows = ids.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct()
        gone = self.live().select("id").join(rows, "id", "left_semi").count() if count else None
        self._append(self._log(rows, "delete"))
        return gone

    def change(self, vectors: DataFrame, ids: DataFrame, order: str | None = None, stream: tuple[str, int] | None = None) -> int:
        """Commit upserts of ``vectors(id, vector)`` and deletions of ``ids(id)`` together; no id may be in both.

        ``stream`` names a stream and the number of its batch, which the same commit keeps.
        """
        newest = self._checked(vectors, order)
        rows = self._log(ids.where("id is not null").select("id").distinct(), "delete")
        return self._append(rows if newest is None else self._log(newest, "upsert").unionByName(rows), stream)

    def _append(self, rows: DataFrame, stream: tuple[str, int] | None = None) -> int:
        part = self._write("pending", rows)
        streams = self.manifest["streams"] | ({stream[0]: stream[1]} if stream else {})
        self._commit(pending=[*self.manifest["pending"], part], next_seq=self.manifest["next_seq"] + 1, streams=streams)
        return part["rows"]

    # one vector at a time, for small collections

    def add(self, vector, id: int) -> None:
        self.add_batch([vector], [id])

    def add_batch(self, vectors, ids) -> int:
        """Upsert an (n, dim) array under n ids; of equal ids the last counts."""
        vectors = np.asarray(vectors, np.float32)
        if vectors.ndim != 2 or len(vectors) != len(ids):
            raise InvalidParameter("need an (n, dim) array and n ids")
        if not len(ids):
            return 0
        last = {int(i): at for at, i in enumerate(ids)}
        return self.upsert(from_numpy(self.spark, np.array(list(last)), vectors[list(last.values())]))

    def remove(self, id: int) -> bool:
        return bool(self.delete(self.spark.createDataFrame([(int(id),)], "id long")))

    def search_one(self, vector, k: int, ef: int | None = None, filter: str | None = None) -> list[tuple[int, float]]:
        """``(id, distance)`` of the k nearest to one vector."""
        asked = self.spark.createDataFrame([(0, [float(x) for x in vector])], "qid long, vector array<double>")
        return [(r.id, r.distance) for r in self.search(asked, k, filter=filter, ef=ef, strategy="auto").orderBy("rank").collect()]

    # reading

    def _parts(self) -> list[dict]:
        return self.manifest["segments"] + self.manifest["pending"]

    def _read(self, *parts: str, schema: str = LOG) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{p}" for p in parts))

    def _newest(self, parts: list[dict], schema: str = LOG) -> DataFrame:
        """The newest row of each id of these parts, which are in the order of writing and have an id once each."""
        if not parts:
            return self.spark.createDataFrame([], schema)
        base = self._read(parts[0]["part"], schema=schema)
        if len(parts) == 1:
            return base
        later = self._read(*(p["part"] for p in parts[1:]), schema=schema)
        value = base.columns[-1]
        newest = later.groupBy("id").agg(F.max_by(F.struct("seq", "op", value), "seq").alias("last")).select("last.seq", "id", "last.op", f"last.{value}")
        ids = later.select("id")
        if sum(p["rows"] for p in parts[1:]) <= MOST_SENT:
            ids = F.broadcast(ids)
        return base.join(ids, "id", "left_anti").select(*base.columns).unionByName(newest)

    def live(self) -> DataFrame:
        """``(id, vector)`` of what the collection holds."""
        return self._newest(self._parts()).where("op = 'upsert'").select("id", "vector")

    def get(self, id: int) -> list[float] | None:
        """The vector as searches see it, normalised for cosine."""
        row = self.live().where(F.col("id") == id).select(prepare(self.metric, F.col("vector")).alias("v")).first()
        return list(row.v) if row else None

    def contains(self, id: int) -> bool:
        return not self.live().where(F.col("id") == id).isEmpty()

    def __len__(self) -> int:
        return self.live().count()

    @property
    def pending_rows(self) -> int:
        return sum(p["rows"] for p in self.manifest["pending"])

    # upkeep

    def flush(self, graph_shards: int = 0) -> str | None:
        """Seal pending parts as one segment; with ``graph_shards`` also build its search graphs.  The segment's folder, or none."""
        pending = self.manifest["pending"]
        if not pending:
            return None
        segment = self._write("segment", self._newest(pending))
        self._graph(segment, graph_shards)
        self._replace([*self.manifest["segments"], segment], {p["part"] for p in pending})
        return f"{self.path}/{segment['part']}"

    def compact(self, graph_shards: int = 0) -> str | None:
        """Rewrite live rows as one segment and drop the rest; none if nothing is live."""
        old = self._named() - {p["part"] for p in self.manifest["metadata"]}
        if not old:
            return None
        segment = self._write("segment", self._newest(self._parts()).where("op = 'upsert'"))
        kept = [segment] if segment["rows"] else []
        if kept:
            self._graph(segment, graph_shards)
        self._replace(kept, old)
        return f"{self.path}/{segment['part']}" if kept else None

    def _replace(self, segments: list[dict], old: set[str]) -> None:
        """Commit these segments without pending parts, and drop what the replacement before this one retired."""
        self._commit(segments=segments, pending=[], retired=sorted(old), next_seq=self.manifest["next_seq"] + 1)
        self.clean()

    def _graph(self, segment: dict, shards: int) -> None:
        if shards:
            segment["graph"] = segment["part"].replace("segment", "graph")
            rows = self._read(segment["part"]).where("op = 'upsert'").select("id", "vector")
            hnsw.build(rows, self.dim, self.metric, self.config, shards).write.parquet(f"{self.path}/{segment['graph']}")

    def verify(self) -> None:
        """Raise unless every committed part holds the rows it was committed with."""
        for kind, schema in (("segments", LOG), ("pending", LOG), ("metadata", METADATA_LOG)):
            for p in self.manifest[kind]:
                try:
                    rows = self._read(p["part"], schema=schema)
                    now = rows.agg(*self._sums(rows)).first()
                except Exception as e:
                    raise Corrupted(f"part {p['part']} can't be read") from e
                if (now["rows"], now["sum"] or 0) != (p["rows"], p["sum"]):
                    raise Corrupted(f"part {p['part']} has changed")

    def gauges(self) -> dict:
        """What the manifest knows, without reading a part."""
        segments, pending = self.manifest["segments"], self.manifest["pending"]
        return {"rows": sum(p["rows"] for p in segments + pending), "pending": self.pending_rows, "segments": len(segments), "graphs": sum(1 for p in segments if p.get("graph"))}

    def stats(self) -> dict:
        live = len(self)
        total = sum(p["rows"] for p in self.manifest["segments"] + self.manifest["pending"])
        return {"name": self.name, "dim": self.dim, "metric": str(self.metric), "live": live, "pending": self.pending_rows, "rows": total, "superseded": total - live, "segments": len(self.manifest["segments"]), "graphs": sum(1 for p in self.manifest["segments"] if p.get("graph")), "kernel": "numpy"}

    # metadata

    def set_metadata(self, metadata: DataFrame) -> None:
        """Commit ``metadata(id, metadata)``, the map being of type ``filters.METADATA``; it replaces the id's former map."""
        self._append_metadata(metadata.select(F.col("id").cast("long"), F.lit("set").alias("op"), F.col("metadata").cast(filters.METADATA)))

    def set_metadata_rows(self, rows: dict[int, dict]) -> None:
        data = [(i, {k: filters.tagged(v) for k, v in m.items()}) for i, m in rows.items()]
        self.set_metadata(self.spark.createDataFrame(data, f"id long, metadata {filters.METADATA}"))

    def clear_metadata(self, ids: DataFrame) -> None:
        self._append_metadata(ids.select(F.col("id").cast("long"), F.lit("clear").alias("op"), F.lit(None).cast(filters.METADATA).alias("metadata")))

    def _append_metadata(self, rows: DataFrame) -> None:
        once = rows.withColumn("at", F.monotonically_increasing_id()).groupBy("id").agg(F.max_by(F.struct("op", "metadata"), "at").alias("last"))
        part = self._write("metadata", once.select(F.lit(self.manifest["next_seq"]).cast("long").alias("seq"), "id", "last.op", "last.metadata"))
        self._commit(metadata=[*self.manifest["metadata"], part], next_seq=self.manifest["next_seq"] + 1)
        records = sum(p["rows"] for p in self.manifest["metadata"])
        if len(self.manifest["metadata"]) > 1 and records >= METADATA_REWRITE and records >= 2 * self.metadata().count():
            self.rewrite_metadata()

    def metadata(self) -> DataFrame:
        """``(id, metadata)`` as it counts now; it outlives its vector unless cleared."""
        return self._newest(self.manifest["metadata"], METADATA_LOG).where("op = 'set'").select("id", "metadata")

    def rewrite_metadata(self) -> None:
        part = self._write("metadata", self.metadata().select(F.lit(self.manifest["next_seq"]).cast("long").alias("seq"), "id", F.lit("set").alias("op"), "metadata"))
        old = [p["part"] for p in self.manifest["metadata"]]
        self._commit(metadata=[part], retired=sorted({*self.manifest["retired"], *old}), next_seq=self.manifest["next_seq"] + 1)

    def matching(self, filter: str, require_metadata: bool = False) -> DataFrame:
        """``(id)`` of live rows that pass; one without metadata has no fields, unless ``require_metadata`` leaves it out."""
        rows = self.live().select("id").join(self.metadata(), "id", "inner" if require_metadata else "left")
        return rows.where(filters.to_column(filter, filters.TaggedMap(F.col("metadata")))).select("id")

    # searching

    def search(self, queries: DataFrame, k: int, *, filter: str | None = None, ef: int | None = None, strategy: str = "exact", include_metadata: bool = False, require_metadata: bool = False) -> DataFrame:
        """``(qid, rank, id, distance)`` for ``queries(qid, vector)``, with ``metadata`` if asked for.

        The filter comes before the ranking, so k hits are found if k rows pass.
        ``strategy`` ``graph`` asks the graphs of sealed segments, with ``ef``, and scans the rest;
        ``auto`` does so if there are graphs, and else scans all, as ``exact`` does.
        """
        widths = queries.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
        for n in widths:
            if n is not None and n != self.dim:
                raise DimensionMismatch(self.dim, n)
        if strategy == "auto":
            strategy = "graph" if any(p.get("graph") for p in self.manifest["segments"]) else "exact"
        rows = self.live()
        allowed = self.matching(filter, require_metadata) if filter else None
        if strategy == "exact":
            hits = knn_batch(rows if allowed is None else rows.join(allowed, "id", "left_semi"), queries, k, self.metric)
        elif strategy == "graph":
            hits = self._graph_search(queries, k, ef, allowed)
        else:
            raise InvalidParameter(f"unknown strategy {strategy!r}")
        if include_metadata:
            hits = hits.join(self.metadata(), "id", "left").select("qid", "rank", "id", "distance", "metadata")
        return hits

    def _graph_search(self, queries: DataFrame, k: int, ef: int | None, allowed: DataFrame | None) -> DataFrame:
        parts = self._parts()
        with_graph = [p for p in parts if p.get("graph")]
        others = [p["part"] for p in parts if not p.get("graph")]
        # (id, seq) of what counts; a single part counts as a whole
        newest = None if len(parts) < 2 else self._read(*(p["part"] for p in parts)).groupBy("id").agg(F.max("seq").alias("seq"))

        def own(*names: str) -> DataFrame:
            rows = self._read(*names).where("op = 'upsert'")
            rows = rows if newest is None else rows.join(newest, ["id", "seq"], "left_semi")
            return rows.select("id", "vector") if allowed is None else rows.join(allowed, "id", "left_semi").select("id", "vector")

        found = knn_batch(own(*others), queries, k, self.metric).select("qid", "id", "distance") if others else self.spark.createDataFrame([], HITS)
        for p in with_graph:
            graphs = self.spark.read.schema(hnsw.HnswGraph.SCHEMA).parquet(f"{self.path}/{p['graph']}")
            ids = None if newest is None and allowed is None else own(p["part"]).select("id")
            found = found.unionByName(hnsw.search(graphs, queries, k, self.metric, ef, self.config, ids).select("qid", "id", "distance"))
        return rank_hits(found, k)


def list_collections(spark: SparkSession, root: str) -> list[str]:
    return [n for n in files.names(spark, root) if Collection.versions(spark, root, n)]


def drop(spark: SparkSession, root: str, name: str) -> None:
    if not Collection.versions(spark, root, check_name(name)):
        raise NotFound(f"no collection {name}")
    files.remove(spark, f"{root.rstrip('/')}/{name}")
