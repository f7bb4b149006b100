"""Deterministic, sharded WARC writing and reading.

Records are range-sorted by id into shards of bounded payload size; the
boundaries come from exact counts over id ranges, split again where they are heavy,
so the same table always gives the same files.  A shard's task writes files that roll at a
compressed size, each under a temporary name that is renamed when the file is
complete; a lost or repeated task writes the same bytes again.  A manifest of all
files, itself renamed into place last, commits the archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.storage import materialize

#: Id ranges that are counted at once to place shard boundaries, and the least number that a heavy one is split into.
CELLS, SPLIT = 1 << 15, 64
MANIFEST = "manifest"


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _header_safe(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(page_id: int | None, repeat: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit (``refers_to``) with the HTTP head only."""
    name = lambda p, k=0: f"<urn:x-page:{'none' if p is None else p}:{k}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id, repeat)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_header_safe(url) if url else name(page_id)[1:-1]}",
        f"WARC-Payload-Digest: sha1:{_base32(digest)}",
        f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).hexdigest())}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int) -> bytes:
    """A gzip member without a time stamp."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def members(data: bytes) -> Iterator[bytes]:
    view, at = memoryview(data), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof and at < len(view):
            piece = view[at : at + 8192]  # what follows a member is copied, so not the whole rest
            out.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        if not z.eof:
            raise ValueError("gzip member breaks off")
        yield b"".join(out)


def parse_record(record: bytes) -> tuple[int | None, int, str, str, int | None]:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)``, with lengths and digests checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record length is wrong")
    if f"sha1:{_base32(hashlib.sha1(block).hexdigest())}" != fields["WARC-Block-Digest"]:
        raise ValueError("block digest is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload digest is wrong")
    number = lambda text: None if (x := text.split(":")[2]) == "none" else int(x)
    refers = number(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return number(fields["WARC-Record-ID"]), size, digest, kind, refers


def _range_of(width: str) -> Column:
    """Number of a row's range of ``width`` ids; null without an id or a width."""
    return F.expr(f"page_id div {width} - if(page_id % {width} < 0, 1, 0)")


def _located(rows: DataFrame, first_width: int, levels: list[list[tuple]]) -> DataFrame:
    """``rows`` with the shard of their range and its parts, and the node and width of ranges that are still to be split."""
    columns = rows.columns
    rows = rows.select("*", F.lit(0).alias("node"), F.lit(first_width).cast("long").alias("width"), F.lit(None).cast("int").alias("shard"), F.lit(None).cast("int").alias("parts"))
    for level in levels:
        table = rows.sparkSession.createDataFrame(level, "of_node int, of_range long, to_node int, to_width long, to_shard int, to_parts int")
        rows = rows.withColumn("range", _range_of("width")).join(F.broadcast(table), (F.col("node") == F.col("of_node")) & F.col("range").eqNullSafe(F.col("of_range")), "left")
        rows = rows.select(*columns, F.col("to_node").alias("node"), F.col("to_width").alias("width"), F.coalesce("shard", "to_shard").alias("shard"), F.coalesce("parts", "to_parts").alias("parts"))
    return rows


def _ranges(pages: DataFrame, shard_bytes: int) -> tuple[int, list[list[tuple]]]:
    """Levels of id ranges for :func:`_located`.

    Ranges of more than ``shard_bytes`` are split again by exact counts until they
    hold one id.  What is then still too large, or has no id, gets several shards.
    A level has at most ``CELLS`` + 2 ranges, or ``SPLIT`` + 1 for each that is split.
    """
    low, high = pages.agg(F.min("page_id"), F.max("page_id")).first()
    low, high = (0, 0) if low is None else (low, high)
    first_width = max(1, -(-(high - low + 1) // CELLS))
    levels: list[list[list]] = []
    leaves, nodes, split = [], 0, True
    while split:
        rows = _located(pages, first_width, [[tuple(r) for r in level] for level in levels]).where("node is not null")
        counted = rows.groupBy("node", _range_of("width").alias("range")).agg(F.sum(F.col("payload_bytes") + 512).alias("bytes"), F.min("page_id").alias("low"), F.max("page_id").alias("high")).collect()
        split = [r for r in counted if r.bytes > shard_bytes and r.low != r.high]
        each = max(SPLIT, CELLS // max(1, len(split)))
        level = []
        for r in counted:
            row = [r.node, r.range, None, None, None, None]
            if r.bytes > shard_bytes and r.low != r.high:
                nodes += 1
                row[2:4] = nodes, -(-(r.high - r.low + 1) // each)
            else:
                leaves.append((r.low is not None, r.low or 0, r.bytes, r.low == r.high, row))
            level.append(row)
        levels.append(level)
    shard, filled = 0, 0
    for _, _, size, single, row in sorted(leaves, key=lambda x: x[:2]):
        parts = -(-size // shard_bytes) if single else 1
        if filled and filled + size > shard_bytes:
            shard, filled = shard + 1, 0
        row[4:] = shard, parts
        shard, filled = (shard + parts, 0) if parts > 1 else (shard, filled + size)
    return first_width, [[tuple(r) for r in level] for level in levels]


def _dealt(base: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """Rows with their shard, how often each is written, and the number of the first record of its id in the shard; and the number of shards.

    Rows of an id with several shards go there by a hash of URL and payload; slices
    of rows that are equal in all go to one shard after the other.
    """
    first_width, levels = _ranges(base.select("page_id", F.octet_length("html").cast("long").alias("payload_bytes")), shard_bytes)
    shards = max((r[4] + r[5] for level in levels for r in level if r[4] is not None), default=1)
    placed = _located(base, first_width, levels)
    columns = ["shard", "page_id", "url", "html"]
    rows = placed.select(*columns, F.lit(1).cast("long").alias("times"), F.lit(0).cast("long").alias("before"))
    if all(r[5] is None or r[5] == 1 for level in levels for r in level):
        return rows, shards
    rows = placed.where("parts = 1").select(*rows.columns[:4], F.lit(1).cast("long").alias("times"), F.lit(0).cast("long").alias("before"))
    alike = placed.where("parts > 1").groupBy(*columns, "parts").agg(F.count(F.lit(1)).alias("n"))
    alike = alike.withColumn("most", F.greatest(F.lit(1), F.floor(shard_bytes / 8 / (F.octet_length("html") + 512))).cast("long"))
    alike = alike.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div most"))).alias("slice"))
    part = F.pmod(F.pmod(F.xxhash64("url", "html"), F.col("parts")) + F.col("slice"), F.col("parts")).cast("int")
    alike = alike.select((F.col("shard") + part).alias("shard"), "page_id", "url", "html", F.least("most", F.col("n") - F.col("slice") * F.col("most")).alias("times"), F.col("shard").alias("of_shard"))
    alike = materialize(alike, "warc-split-ids")
    # one row a shard
    before, last, total = [], None, 0
    for r in alike.groupBy("of_shard", "shard").agg(F.sum("times").alias("n")).orderBy("of_shard", "shard").collect():
        total = total if r.of_shard == last else 0
        before.append((r.shard, total))
        last, total = r.of_shard, total + r.n
    before = F.broadcast(base.sparkSession.createDataFrame(before, "shard int, before long"))
    return rows.unionByName(alike.drop("of_shard").join(before, "shard")), shards


def write(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit: int = 1000, shard_bytes: int = 24 << 20, roll_bytes: int = 16 << 20, level: int = 6, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a WARC record for every row of ``pages`` under ``folder`` and return the manifest.

    Of rows with equal payloads of at least ``least_revisit`` bytes the one with
    the largest id is a response and the others revisit it; all other rows are
    responses.  A null payload is empty.  Rows with null ids come first and revisit
    a row with an id if there is one; a null URL is replaced by the record's name.
    Repeated rows get a record each.  A shard holds at most about ``shard_bytes`` of
    payload or a single row; rows of one id, or without one, share several shards
    if they are more.  Other columns are ignored.  An empty table
    gives an archive without files.  ``folder`` is any URI that pyarrow's file
    systems open; it must be new.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("html"))
    light = base.select("page_id", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha1(F.col("html").cast("binary")).alias("digest"))
    rows, shards = _dealt(base, shard_bytes)
    there = rows.select("shard", "page_id", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha1(F.col("html").cast("binary")).alias("digest"))
    equal = light.where(F.col("payload_bytes") >= least_revisit).groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    revisits = there.join(equal, ["digest", "payload_bytes"]).where("page_id is null or page_id < refers_to")
    revisits = revisits.select("shard", "page_id", "digest", "refers_to").distinct()
    revisits = revisits.select(*[F.col(c).alias(f"revisit_{c}") for c in revisits.columns])
    schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])

    def shard(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyarrow import fs

        if not left.num_rows:
            return schema.empty_table()
        system, root = fs.FileSystem.from_uri(folder)
        number = left.column("shard")[0].as_py()
        refers = {(p, d): r for p, d, r in zip(*(right.column(f"revisit_{c}").to_pylist() for c in ("page_id", "digest", "refers_to")), strict=True)}
        left = left.sort_by([("page_id", "ascending"), ("url", "ascending"), ("html", "ascending")])
        nulls = left.column("page_id").is_null().to_pylist()
        order = [i for i, x in enumerate(nulls) if x] + [i for i, x in enumerate(nulls) if not x]
        ids, urls, bodies, times, before = (left.column(c) for c in ("page_id", "url", "html", "times", "before"))
        done: list[tuple] = []
        stream, temporary, size, count, hashed, last, repeat = None, "", 0, 0, None, object(), 0
        system.create_dir(root, recursive=True)

        def finish() -> None:
            stream.close()
            name = f"part-{number:07d}-{len(done):04d}.warc.gz"
            there = system.get_file_info(f"{root}/{name}")
            if there.type == fs.FileType.File and there.size == size and _digest(system, there.path) == hashed.hexdigest():
                system.delete_file(temporary)  # an earlier try of this task has written it
            else:
                system.move(temporary, f"{root}/{name}")
            done.append((name, count, size, hashed.hexdigest()))

        for i in (i for i in order for _ in range(times[i].as_py())):
            page_id, payload = ids[i].as_py(), bodies[i].as_py().encode()
            digest = hashlib.sha1(payload).hexdigest()
            repeat = repeat + 1 if page_id == last else before[i].as_py()
            last = page_id
            packed = member(record_bytes(page_id, repeat, urls[i].as_py(), payload, digest, refers.get((page_id, digest)), date), level)
            if stream is not None and size + len(packed) > roll_bytes:
                finish()
                stream = None
            if stream is None:
                temporary = f"{root}/.writing-{number:07d}-{uuid.uuid4().hex}"
                stream, size, count, hashed = system.open_output_stream(temporary), 0, 0, hashlib.sha256()
            stream.write(packed)
            hashed.update(packed)
            size, count = size + len(packed), count + 1
        finish()
        return pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in done], schema)

    # as many partitions as shards, so that a task has one or a few whatever the size of the table
    written = rows.repartition(shards, "shard").groupBy("shard").cogroup(revisits.groupBy("revisit_shard")).applyInArrow(shard, "file string, records long, bytes long, sha256 string")
    written.write.json(f"{folder}/_{MANIFEST}.writing")
    _rename(spark, f"{folder}/_{MANIFEST}.writing", f"{folder}/_{MANIFEST}")
    _sweep(spark, folder)
    return manifest(spark, folder)


def _digest(system, path: str) -> str:
    digest = hashlib.sha256()
    with system.open_input_stream(path) as stream:
        while piece := stream.read(1 << 20):
            digest.update(piece)
    return digest.hexdigest()


def _sweep(spark: SparkSession, folder: str) -> None:
    """Delete files that lost tasks left under temporary names; all tasks have ended."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/.writing-*")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in system.globStatus(path) or []:
        system.delete(found.getPath(), False)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.rename(path(old), path(new)):
        raise OSError(f"could not rename {old}")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("file string, records long, bytes long, sha256 string").json(f"{folder}/_{MANIFEST}")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of every record of a committed archive.

    Lengths and digests are checked record by record, and the files against the
    manifest by name, size, number of records and SHA-256: the archive is parsed once,
    into a table in the shared folder, before this returns.
    """
    listed = manifest(spark, folder)
    if listed.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    files = spark.read.option("pathGlobFilter", "part-*.warc.gz").format("binaryFile").load(folder)

    def differs(there: DataFrame, keys: list[str]) -> bool:
        return not there.join(listed, keys, "left_anti").isEmpty() or not listed.join(there, keys, "left_anti").isEmpty()

    if differs(files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes")), ["file", "bytes"]):
        raise ValueError(f"files under {folder} are not those of the manifest")

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
        for batch in parts:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer().to_pybytes()
                rows = [parse_record(r) for r in members(data)]
                # what is known of the file goes with its first record
                first = (path.rsplit("/", 1)[-1], len(rows), len(data), hashlib.sha256(data).hexdigest())
                rows = [row + (first if i == 0 else (None,) * 4) for i, row in enumerate(rows)]
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    parsed = materialize(files.select("path", "content").mapInArrow(parse, f"{columns}, file string, records long, bytes long, sha256 string"), "warc-parsed")
    keys = ["file", "records", "bytes", "sha256"]
    if differs(parsed.where("file is not null").select(*keys), keys):
        raise ValueError(f"files under {folder} are not those of the manifest")
    return parsed.drop(*keys)
