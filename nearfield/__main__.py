"""Command line: ``python -m nearfield --root DIR COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from nearfield.errors import NearfieldError
from nearfield.operators.hnsw import HnswConfig
from nearfield.sources import collection as collections
from nearfield.sources.collection import Collection
from nearfield.sources.vectors import from_numpy, parse_vector, read_jsonl, read_queries, sample


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="nearfield")
    parser.add_argument("--root", default="collections")
    parser.add_argument("--json", action="store_true")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("create", "insert", "delete", "search", "flush", "compact", "verify", "stats", "sample"):
        sub.add_parser(name).add_argument("name")
    sub.add_parser("list")
    sub.choices["create"].add_argument("--dim", type=int, required=True)
    sub.choices["create"].add_argument("--metric", default="l2")
    for option, default in (("--m", 16), ("--m0", None), ("--ef-construction", 200), ("--ef-search", 64)):
        sub.choices["create"].add_argument(option, type=int, default=default)
    sub.choices["insert"].add_argument("path")
    sub.choices["delete"].add_argument("ids", type=int, nargs="+")
    search = sub.choices["search"]
    search.add_argument("--vector")
    search.add_argument("--queries")
    search.add_argument("--k", type=int, default=10)
    search.add_argument("--filter")
    search.add_argument("--ef", type=int)
    search.add_argument("--strategy", default="auto", choices=["auto", "exact", "graph"])
    for name in ("flush", "compact"):
        sub.choices[name].add_argument("--graph-shards", type=int, default=0)
    for option, default in (("--count", 1000), ("--dim", 16), ("--clusters", 16), ("--seed", 7)):
        sub.choices["sample"].add_argument(option, type=int, default=default)
    sub.choices["sample"].add_argument("--metric", default="l2")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("nearfield").getOrCreate()
    try:
        result = run(spark, args)
    except NearfieldError as e:
        print(json.dumps(e.payload()) if args.json else f"error: {e}", file=sys.stderr)
        return 1
    print(json.dumps(result) if args.json else "\n".join(map(str, result)) if isinstance(result, list) else result)
    return 0


def run(spark: SparkSession, args: argparse.Namespace):
    if args.command == "list":
        return collections.list_collections(spark, args.root)
    if args.command == "create":
        config = HnswConfig(args.m, 2 * args.m if args.m0 is None else args.m0, args.ef_construction, args.ef_search)
        return Collection.create(spark, args.root, args.name, args.dim, args.metric, config).stats()
    if args.command == "sample":
        c = Collection.open_or_create(spark, args.root, args.name, args.dim, args.metric)
        n = c.upsert(from_numpy(spark, *sample(args.count, args.dim, args.metric, args.clusters, args.seed)))
        c.flush()
        return {"sampled": n}
    c = Collection.open(spark, args.root, args.name)
    if args.command == "insert":
        return {"inserted": c.upsert(read_jsonl(spark, args.path, c.dim))}
    if args.command == "delete":
        return {"deleted": c.delete(spark.createDataFrame([(i,) for i in args.ids], "id long"))}
    if args.command == "search":
        if args.vector:
            queries = spark.createDataFrame([(0, parse_vector(args.vector))], "qid long, vector array<double>")
        else:
            queries = read_queries(spark, args.queries, c.dim)
        hits = c.search(queries.select("qid", F.col("vector").cast("array<double>")), args.k, filter=args.filter, ef=args.ef, strategy=args.strategy)
        return [r.asDict() for r in hits.orderBy("qid", "rank").collect()]
    if args.command in ("flush", "compact"):
        return {"segment": getattr(c, args.command)(args.graph_shards)}
    if args.command == "verify":
        c.verify()
        return {"ok": True}
    return c.stats()


if __name__ == "__main__":
    sys.exit(main())
