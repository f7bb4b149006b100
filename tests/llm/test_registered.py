"""The registered queries over the smallest shared tables, against plain recomputation from their contracts."""

import hashlib
import os
import zlib

import numpy as np
import pytest

from nearfield.llm import queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the shared tables are not here")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def test_op1_pieces(spark, texts):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(queries.tokenizer_path())
    ids = {i: np.array([*coder.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    rows = queries.op1_packing(spark, SF_DIR).collect()
    covered, sequences = {}, {}
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans, whole in ((covered, {i: len(x) for i, x in ids.items()}), (sequences, {})):
        for key, parts in spans.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at and length > 0
                at += length
            assert at == whole.get(key, at) and (spans is covered or at <= 2048)
    assert set(covered) == set(ids)
    assert sum(sum(n for _, n in p) == 2048 for p in sequences.values()) >= 0.9 * len(sequences)


def test_op4_columns(spark, texts):
    rows = queries.op4_mixing(spark, SF_DIR).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    size = {i: len(t.encode().split()) for i, t in texts.items()}
    total, taken, target = {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        total[s] = total.get(s, 0) + size[r.doc_id]
        taken[s], target[s] = taken.get(s, 0) + r.taken, r.target
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.source_size == total[source[r.doc_id]] for r in rows)
    assert sum(target.values()) == pytest.approx(1.5 * sum(total.values()))
    assert all(target[s] <= 2 * total[s] and abs(taken[s] - target[s]) <= 0.03 * target[s] + 2 for s in total)  # ten documents a source


@pytest.mark.parametrize(("name", "modulus", "rest"), [("op5_quality", 3, 1), ("op7_toxicity", 5, 0)])
def test_op5_and_op7_columns(spark, texts, name, modulus, rest):
    rows = queries.queries()[name](spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op8_columns(spark, texts):
    rows = queries.op8_telephony(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes > len(payload) and len(r.media_sha256) == len(r.pcm_sha256) == 64 and r.feature.startswith("codec=")
