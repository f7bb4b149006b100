import hashlib
import io
import json
import random
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import telephony, url_lists, voronoi, warc
from nearfield.llm.storage import fresh_dir

PAGES = "page_id long, url string, html string"


def test_tables_are_g711():
    # anchors of the standard: extremes, zero, and symmetry of sign
    assert telephony.MULAW[0x00] == -32124 and telephony.MULAW[0x80] == 32124 and telephony.MULAW[0xFF] == 0 and telephony.MULAW[0x7F] == 0
    assert telephony.ALAW[0xD5] == 8 and telephony.ALAW[0x55] == -8 and telephony.ALAW[0xAA] == 32256 and telephony.ALAW[0x2A] == -32256
    assert (telephony.MULAW[:128] == -telephony.MULAW[128:]).all() and (telephony.ALAW[:128] == -telephony.ALAW[128:]).all()


def one_block(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(telephony.ADPCM_STEPS[index])
            d = step >> 3
            for bit, part in ((1, step >> 2), (2, step >> 1), (4, step)):
                d += part if nibble & bit else 0
            value = max(-32768, min(32767, value + (-d if nibble & 8 else d)))
            index = max(0, min(88, index + int(telephony.ADPCM_CHANGES[nibble & 7])))
            out.append(value)
    return out


def test_adpcm_blocks_decode_together():
    rng = np.random.default_rng(2)
    blocks = rng.integers(0, 256, (7, 36), np.uint8)
    assert telephony.decode_adpcm(blocks).tolist() == [one_block(b.tobytes()) for b in blocks]


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "ima_adpcm", None])
def test_clips(spark, codec):
    texts = {1: "hello", 2: None, 3: "", 4: "é" * 400, 5: "x" * 576, 6: "hello", 7: "long " * 40_000}
    docs = spark.createDataFrame([*texts.items(), (None, "hello")], "doc_id long, text string").withColumns({"media": F.lit(1), "rate": F.lit(2)})
    got = telephony.store_texts(docs, codec=codec, with_media=True).collect()
    assert len(got) == 8
    for r in got:
        raw = (texts.get(r.doc_id, "hello") or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        kind, rate, block, stored = telephony.read_wav(r.media)
        assert (kind, rate, bytes(stored)) == (codec or telephony.BY_LENGTH[len(raw) % 3], 8000, payload)
        pcm = [x for a in range(0, len(payload), 576) for x in one_block(payload[a : a + 576])] if kind == "ima_adpcm" else [int((telephony.MULAW if kind == "mulaw" else telephony.ALAW)[x]) for x in payload]
        twice = [y for x, z in zip(pcm, [*pcm[1:], pcm[-1]]) for y in (x, (x + z) >> 1)]
        power, crossings = sum(x * x for x in twice) // len(twice), sum((x < 0) != (z < 0) for x, z in zip(twice, twice[1:]))
        assert r.feature == f"codec={kind} samples={len(twice)} power={power} crossings={crossings} peak={max(map(abs, twice))}"
        with wave.open(io.BytesIO(r.pcm)) as clip:
            assert clip.getparams()[:4] == (1, 2, 16000, len(twice)) and np.frombuffer(clip.readframes(len(twice)), "<i2").tolist() == twice
        assert (r.rate, r.pcm_bytes, r.pcm_sha256) == (16000, len(r.pcm), hashlib.sha256(r.pcm).hexdigest())
    assert len({tuple(r)[1:] for r in got if r.doc_id in (1, 6, None)}) == 1
    assert telephony.store_texts(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        telephony.read_wav(b"RIFF\0\0\0\0WAVE")


def test_archive_round_trip(spark):
    rng = random.Random(4)
    body = "".join(rng.choice("abc <>é\r\n") for _ in range(3000))
    pages = {i: (f"http://h{i % 3}.example/{i}", rng.choice([body, body[:900], "", f"<p>{i}</p>" * rng.randint(1, 400)])) for i in range(0, 600, 3)}
    rows = [(i, u, h) for i, (u, h) in pages.items()] + [(1000, None, None), (1001, "http://x/ y\r\nz", body), (1002, "u", body), (1002, "u", body), (None, "u", body)]
    table = spark.createDataFrame(rows, PAGES).repartition(3).withColumns({"shard": F.lit(9), "digest": F.lit(1), "cell": F.lit(2)})
    folders = [fresh_dir(spark, "warc") for _ in range(2)]
    manifests = [warc.write(t, f, shard_bytes=60_000, roll_bytes=5_000) for t, f in zip((table, table.repartition(5)), folders, strict=True)]
    one, two = (sorted(map(tuple, m.collect())) for m in manifests)
    assert one == two and len(one) > 5 and sum(m[1] for m in one) == len(rows)
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(top.get(h or "", -1), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= 1000 and (i is None or i < top[h or ""])
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top[h or ""] if revisit else None))
    got = [tuple(r) for r in warc.read(spark, folders[0]).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_archive_of_nothing_and_damage(spark):
    folder = fresh_dir(spark, "warc")
    warc.write(spark.createDataFrame([], PAGES), folder)
    assert warc.read(spark, folder).count() == 0
    record = warc.record_bytes(1, 0, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, "2024-01-01T00:00:00Z")
    assert warc.parse_record(record)[:2] == (1, 7)
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"payload\r\n\r\n", b"Payload\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.members(warc.member(record, 6)[:-9]))
    folder = fresh_dir(spark, "warc")
    warc.write(spark.createDataFrame([(1, "u", "x")], PAGES), folder)
    from pathlib import Path

    extra = Path(folder.removeprefix("file://")) / "part-9999999-0000.warc.gz"
    extra.write_bytes(b"more")
    with pytest.raises(ValueError):
        warc.read(spark, folder)
    extra.unlink()
    part = next(extra.parent.glob("part-*.gz"))
    for checksum in extra.parent.glob(".part-*.crc"):
        checksum.unlink()
    other = warc.member(warc.record_bytes(1, 0, "u", b"y", hashlib.sha1(b"y").hexdigest(), None, "2024-01-01T00:00:00Z"), 6)
    assert warc.read(spark, folder).count() == 1
    listed = warc.manifest(spark, folder).first()
    changed = {**listed.asDict(), "bytes": len(other)}
    part.write_bytes(other)  # a whole record of the size listed, but another one
    for old in extra.parent.glob("_manifest/part-*"):
        old.write_text(json.dumps(changed) + "\n")
    for checksum in extra.parent.glob("_manifest/.*.crc"):
        checksum.unlink()
    with pytest.raises(ValueError):
        warc.read(spark, folder)



def plain(kind, pattern):
    if pattern is None or kind == "nonsense":
        return None
    host, slash, path = pattern.partition("/")
    host = host.lower().rstrip(".")
    return host.lstrip(".") if kind == "domain" else host if kind == "host" else f"{host}/{path}"


@pytest.mark.parametrize("most_broadcast", [1 << 20, 0])
def test_url_lists_equal_brute_force(spark, most_broadcast):
    from urllib.parse import urlsplit

    rng = random.Random(9)
    patterns = [("host", "a.x.org"), ("domain", ".X.org"), ("domain", "org"), ("prefix", "a.x.org/d/"), ("prefix", "A.X.org/d/"), ("prefix", "a.x.org/d/e"), ("prefix", "a.x.org/D/"), ("prefix", "x.org"), ("host", "B.Y.com"), ("host", "[2001:db8::1]"), ("domain", "[2001:DB8::2]"), ("host", "["), ("nonsense", "a"), ("domain", None)]
    log = [(*rng.choice(patterns), rng.choice(["l1", "l2"]), rng.choice([*range(12), None]), rng.choice(["add", "remove", "add"])) for _ in range(200)]
    entries = spark.createDataFrame(log, "kind string, pattern string, list_name string, at int, action string")
    urls = ["http://a.x.org/d/e", "https://u:p@A.x.org:80/d/e?q#f", "http://a.x.org/d/ef", "http://x.org", "http://xx.org/d/", "http://b.y.com./", "nothing", "", None, "http://a.x.org/d", "http://u@[2001:DB8::1]:8080/d/x", "http://[2001:db8::2]", "http://a.x.org?/d/"]
    captures = [(i, rng.choice(urls), rng.choice([*range(-1, 14), None])) for i in range(250)]
    captures += captures[:5]
    table = spark.createDataFrame(captures, "pid long, u string, t int").withColumns({"key": F.lit(1), "spans": F.lit(2), "url": F.lit(3)})
    got = url_lists.judge(table, entries, id_col="pid", url_col="u", at_col="t", most_broadcast=most_broadcast).collect()
    assert len(got) == len(captures)
    by = {r.id: r for r in got}
    log = [(k, plain(k, p), *rest) for k, p, *rest in log]
    for i, u, t in captures:
        n = 0
        if u and u.startswith("http") and t is not None:
            parts = urlsplit(u)
            host, path = parts.hostname.rstrip("."), parts.path or "/"
            host = f"[{host}]" if ":" in host else host
            for kind, pattern in {(k, p) for k, p, *_ in log if p}:
                whole = host + path
                hit = host == pattern if kind == "host" else host == pattern or host.endswith("." + pattern) if kind == "domain" else whole == pattern or (pattern.endswith("/") and whole.startswith(pattern))
                n += sum(hit and active_ties(log, kind, pattern, name, t) for name in ("l1", "l2"))
        assert by[i].n_matches == n and by[i].blocked == (n > 0), (u, t)
    assert url_lists.judge(table.limit(0), entries, id_col="pid", url_col="u", at_col="t").count() == 0
    assert url_lists.judge(table, entries.limit(0), id_col="pid", url_col="u", at_col="t").where("blocked").count() == 0


def active_ties(log, kind, pattern, name, t):
    own = {}
    for k, p, n, at, action in log:
        if (k, p, n) == (kind, pattern, name) and at is not None and at <= t:
            own[at] = own.get(at, False) or action == "add"
    return bool(own) and own[max(own)]


VECTORS = "vec_id long, embedding array<float>"


def brute_top(rows, k=10):
    import math

    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in {(i, tuple(v)) for i, v in good if i % 4 == 0}:
        best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v)))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("options", [{}, {"sample": 2, "block": 16}, {"sample": 1}])
def test_voronoi_equals_brute_force(spark, options):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(160)]
    rows += [(i, [0.5] * 6) for i in range(200, 260)] + [(300, None), (304, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (308, [float("nan")] * 6), (312, [float("inf")] * 6), (None, [1.0] * 6), (316, [1.0, 2.0]), (317, [3.0, 4.0]), (320, [0.0] * 6)]
    table = spark.createDataFrame(rows, VECTORS).withColumns({"v": F.lit(1), "cell": F.lit(2), "score": F.lit(3)})
    got = {tuple(r) for r in voronoi.search(table, F.col("vec_id") % 4 == 0, **options).collect()}
    assert got == brute_top(rows)


def test_voronoi_of_few_rows_and_large_values(spark):
    assert voronoi.search(spark.createDataFrame([], VECTORS), F.lit(True)).count() == 0
    rows = [(0, [1e9, -1e9]), (4, [2e9, 1e9]), (4, [2e9, 1e9]), (5, [-1e9, 0.5])]
    got = sorted(tuple(r) for r in voronoi.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 4 == 0, scale=1).collect())
    assert [(q, r, i) for q, r, i, _ in got] == [(0, 1, 4), (0, 2, 4), (0, 3, 5), (4, 1, 0), (4, 2, 5)]


@pytest.mark.parametrize("repeats", [2, 11])
@pytest.mark.parametrize("options", [{}, {"sample": 2, "block": 16}])
def test_voronoi_of_repeated_query_rows(spark, repeats, options):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(1, 80, 2)]
    rows += [(100, [0.9] * 6)] * repeats + [(i, [0.9] * 6) for i in range(201, 226, 2)]
    # the own rows of 400 and 404, under one vector and under several, are all that is near them
    rows += [(400, [9.0] * 6)] * repeats + [(404, [-9.0 - i] * 6) for i in range(repeats)]
    rows += [(501, [0.1] * 6)] * 12
    got = sorted(tuple(r) for r in voronoi.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 4 == 0, **options).collect())
    want = []
    floors = [(i, tuple(int(np.floor(1024 * float(np.float32(x)))) for x in v)) for i, v in rows]
    for q in (100, 400, 404):
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for v in {v for i, v in floors if i == q} for i, w in floors if i != q)[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == want


def test_archive_of_skewed_ids(spark):
    from pathlib import Path

    body = "b" * 1500
    rows = [(i, f"u{i}", f"<p>{i}</p>") for i in range(300)] + [(10**15, "far", "x"), (-(2**63), "least", "y"), (2**63 - 1, "most", body)]
    rows += [(None, f"n{i}", [body, "short"][i % 2]) for i in range(200)]
    rows += [(150, "same", "same")] * 150 + [(151, f"v{i}", "other") for i in range(150)]
    table = spark.createDataFrame(rows, PAGES)
    folders = [fresh_dir(spark, "warc") for _ in range(2)]
    size = 20_000
    manifests = [warc.write(t, f, shard_bytes=size) for t, f in zip((table.repartition(3), table.repartition(5)), folders, strict=True)]
    one, two = (sorted(map(tuple, m.collect())) for m in manifests)
    assert one == two and sum(m[1] for m in one) == len(rows)
    records = {}
    names = []
    for file in Path(folders[0].removeprefix("file://")).glob("part-*"):
        for record in warc.members(file.read_bytes()):
            p, n, *_ = warc.parse_record(record)
            records.setdefault(file.name.split("-")[1], []).append((p is None or p in (150, 151), n + 512))
            names += [x for x in record.split(b"\r\n") if x.startswith(b"WARC-Record-ID")]
    assert len(set(names)) == len(rows)
    for shard in records.values():  # hashed rows of one id come near the bound only
        assert sum(n for _, n in shard) <= (2 * size if any(s for s, _ in shard) else size)
    want = [(i, len(h), hashlib.sha1(h.encode()).hexdigest(), "revisit" if h == body and i is None else "response", 2**63 - 1 if h == body and i is None else None) for i, _, h in rows]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in warc.read(spark, folders[0]).collect())


def test_voronoi_bounds_exclude_most_pairs_of_clustered_data(spark):
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(20, 16))
    rows = [(i, (middles[i * 7 % 20] + 0.05 * rng.normal(size=16)).tolist()) for i in range(1200)]
    table = spark.createDataFrame(rows, VECTORS)
    figures: dict = {}
    got = {tuple(r) for r in voronoi.search(table, F.col("vec_id") % 4 == 0, figures=figures).collect()}
    assert got == brute_top(rows)
    assert figures["pairs"] == 1200 * 300 and figures["compared"] < figures["pairs"] / 4


def test_voronoi_bounds_hold():
    rng = np.random.default_rng(9)
    rows = [tuple(int(x) for x in v) for v in np.concatenate([rng.integers(-50, 50, (300, 5)), rng.integers(900, 1000, (200, 5)), np.zeros((3, 5), int)])]
    pivots = voronoi.Pivots(rows, 0.05)
    x = np.array(rows)
    cell, away, norm, cosine = pivots.assign(x)
    summary = np.array([(c, n := int((cell == c).sum()), away[cell == c].min(), away[cell == c].max(), norm[cell == c].min(), norm[cell == c].max(), cosine[cell == c].min()) for c in np.unique(cell)], voronoi.CELL)
    q = np.concatenate([x[::7], -x[::11], rng.integers(-5, 5, (20, 5))])
    most = voronoi.upper_bounds(q, pivots.cells[5][1][summary["cell"]], summary)
    for j, c in enumerate(summary["cell"]):
        assert ((q @ x[cell == c].T).max(1) <= most[:, j]).all()
