"""Telephony audio columns: G.711 and ADPCM decoding, WAV storage, resampled PCM.

mu-law and A-law bytes expand through 256-entry tables built from their formulas;
ADPCM blocks decode together, one numpy step for each sample position over all
blocks.  A stored clip is a WAV file with 8-bit samples or ADPCM blocks, so any payload of bytes
survives unchanged.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.textops import slices

RATE = 8000
FORMATS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 17}


def mulaw_table() -> np.ndarray:
    """PCM of each mu-law byte: sign, 3 bits of exponent, 4 of mantissa, all inverted, with a bias of 132."""
    code = ~np.arange(256, dtype=np.uint8)
    exponent, mantissa = (code >> 4) & 7, code & 15
    size = (((mantissa.astype(np.int32) << 3) + 132) << exponent) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of each A-law byte: even bits inverted, the lowest exponent linear."""
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    exponent, mantissa = ((code >> 4) & 7).astype(np.int32), (code & 15).astype(np.int32)
    size = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()

# Fixed values of the IMA ADPCM format: quantizer steps and index changes.
ADPCM_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
ADPCM_CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM mono blocks, one a row of bytes: a 16-bit first sample, a step index, a spare byte, then nibbles, low first."""
    blocks = np.ascontiguousarray(blocks, np.uint8)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(ADPCM_STEPS) - 1)
    body = blocks[:, 4:]
    out = np.empty((len(blocks), 1 + 2 * body.shape[1]), np.int16)
    out[:, 0] = value
    for k in range(2 * body.shape[1]):
        nibble = (body[:, k // 2] >> (4 * (k % 2))) & 15
        step = ADPCM_STEPS[index]
        size = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * ((nibble >> 1) & 1) + step * ((nibble >> 2) & 1)
        value = np.clip(value + np.where(nibble & 8, -size, size), -32768, 32767)
        index = np.clip(index + ADPCM_CHANGES[nibble & 7], 0, len(ADPCM_STEPS) - 1)
        out[:, k + 1] = value
    return out


def write_wav(payload: bytes, codec: str = "mulaw", rate: int = RATE, block: int = 1) -> bytes:
    """A mono WAV file whose data chunk is ``payload``; ``block`` is the block size of ADPCM."""
    bits = 4 if codec == "ima_adpcm" else 8
    extra = struct.pack("<HH", 2, 2 * (block - 4) + 1) if codec == "ima_adpcm" else struct.pack("<H", 0)
    samples = len(payload) // block * (2 * (block - 4) + 1) if codec == "ima_adpcm" else len(payload)
    speed = rate * block // (2 * (block - 4) + 1) if codec == "ima_adpcm" else rate
    head = struct.pack("<HHIIHH", FORMATS[codec], 1, rate, speed, block, bits) + extra
    pad = b"\0" * (len(payload) % 2)
    chunks = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload))
    return b"RIFF" + struct.pack("<I", len(chunks) + len(payload) + len(pad)) + chunks + payload + pad


def read_wav(data: bytes) -> tuple[str, int, int, memoryview]:
    """Codec, rate, block size and stored bytes of a WAV file; chunks it doesn't know are passed over."""
    view = memoryview(data)
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, rate, block = 12, "", 0, 1
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if name == b"fmt ":
            code, _, rate, _, block, _ = struct.unpack_from("<HHIIHH", view, at + 8)
            kind = {v: k for k, v in FORMATS.items()}.get(code, "")
        elif name == b"data":
            if not kind:
                raise ValueError("WAV codec isn't a telephony one")
            return kind, rate, block, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("WAV file without data")


def decode(codec: str, stored: memoryview | bytes, block: int = 1) -> np.ndarray:
    """16-bit PCM of stored samples; a last ADPCM block that isn't whole is left out."""
    raw = np.frombuffer(stored, np.uint8)
    if codec == "ima_adpcm":
        whole = len(raw) // block
        return decode_adpcm(raw[: whole * block].reshape(whole, block)).reshape(-1)
    return (MULAW if codec == "mulaw" else ALAW)[raw]


def decoded(codec: str, stored: memoryview, block: int, piece: int = 1 << 19) -> Iterator[np.ndarray]:
    """PCM of stored samples, piece by piece; ADPCM blocks don't depend on each other."""
    step = max(1, piece // block) * block
    for a in range(0, len(stored), step):
        yield decode(codec, stored[a : a + step], block)


def double_rate(pcm: np.ndarray) -> np.ndarray:
    """PCM at twice the rate: each sample, then the rounded-down mean of it and the next (the last one repeats)."""
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    nxt = np.append(pcm[1:], pcm[-1:]).astype(np.int32)
    out[1::2] = (pcm.astype(np.int32) + nxt) >> 1
    return out


def doubled(pieces: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """:func:`double_rate` of all pieces as if they were one."""
    last = np.zeros(0, np.int16)
    for pcm in pieces:
        if len(pcm):
            yield double_rate(np.concatenate([last, pcm]))[:-2]
            last = pcm[-1:]
    yield double_rate(last)


class Meter:
    """Length, mean square, sign changes and peak of PCM in pieces, in whole numbers."""

    def __init__(self):
        self.samples = self.power = self.crossings = self.peak = 0
        self.low: np.ndarray = np.zeros(0, bool)

    def add(self, pcm: np.ndarray) -> None:
        for a in range(0, len(pcm), 1 << 20):  # sums below 2^53 are exact
            x = pcm[a : a + (1 << 20)].astype(np.float64)
            self.power += int(np.dot(x, x))
            self.peak = max(self.peak, int(np.abs(x).max()))
        low = np.concatenate([self.low, pcm < 0])
        self.crossings += int(np.count_nonzero(low[1:] != low[:-1]))
        self.samples += len(pcm)
        self.low = low[-1:]

    def __str__(self) -> str:
        return f"samples={self.samples} power={self.power // max(1, self.samples)} crossings={self.crossings} peak={self.peak}"


def features(pcm: np.ndarray) -> str:
    meter = Meter()
    meter.add(pcm)
    return str(meter)


def pcm_head(samples: int, rate: int) -> bytes:
    """All of a mono WAV file of 16-bit PCM that comes before its samples."""
    return b"RIFF" + struct.pack("<I", 36 + 2 * samples) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", 2 * samples)


BY_LENGTH = ("mulaw", "alaw", "ima_adpcm")
COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pcm_bytes long, pcm_sha256 string, feature string, rate int"
_TYPES = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", codec: str | None = None, unit: int = 576, fill: int = 255, resample: bool = True, with_media: bool = False) -> DataFrame:
    """Store each whole text as a telephony clip, read it back, decode and resample it, store that as PCM, and describe it.

    The payload is the text's UTF-8 bytes and bytes ``fill`` up to a positive
    multiple of ``unit``; a null or empty text is ``unit`` such bytes.  The hash
    and checksum columns come from the bytes read back from the stored file.
    Without ``codec`` the number of bytes, modulo three, chooses among :data:`BY_LENGTH`;
    with ``ima_adpcm`` the payload is a row of blocks of ``unit`` bytes.
    pcm_bytes and pcm_sha256 are of the WAV file of 16-bit PCM, at twice the rate if ``resample``.
    ``with_media`` adds both files (``media`` and ``pcm``).

    Rows with null ids and repeated rows pass through; equal texts get equal
    values; other columns are ignored.  Texts are decoded in slices of a few rows,
    a long one alone and its PCM in pieces, of which only ``with_media`` keeps all.
    """
    names = [tuple(c.split(" ")) for c in f"doc_id long, {COLUMNS}{', media binary, pcm binary' if with_media else ''}".split(", ")]
    schema = pa.schema([(name, _TYPES[kind]) for name, kind in names])

    def pcm_of(clips: list[tuple[str, int, int, memoryview]]) -> list[Iterator[np.ndarray]]:
        """PCM of each clip in pieces; the ADPCM blocks of all small clips are decoded together."""
        small = [i for i, (kind, _, _, stored) in enumerate(clips) if kind == "ima_adpcm" and len(stored) <= 1 << 19]
        out = [decoded(kind, stored, block) for kind, _, block, stored in clips]
        if small:
            pcm = decode("ima_adpcm", b"".join(clips[i][3] for i in small), unit)
            ends = np.cumsum([len(clips[i][3]) // unit for i in small]) * (len(pcm) // max(1, sum(len(clips[i][3]) for i in small) // unit))
            for i, one in zip(small, np.split(pcm, ends[:-1]), strict=True):
                out[i] = iter([one])
        return out

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for a, b, buf, off in slices(batch.column(1)):
                media, clips, rows, sizes = [], [], [], np.diff(off).tolist()
                for i, n in enumerate(sizes):
                    payload = buf[off[i] : off[i + 1]].tobytes() + bytes([fill]) * (max(1, -(-n // unit)) * unit - n)
                    kind = codec or BY_LENGTH[n % 3]
                    media.append(write_wav(payload, kind, RATE, unit if kind == "ima_adpcm" else 1))
                    clips.append(read_wav(media[-1]))
                for (kind, rate, _, stored), pieces, file, n, doc in zip(clips, pcm_of(clips), media, sizes, batch.column(0).slice(a, b - a).to_pylist(), strict=True):
                    samples = len(stored) // unit * (2 * (unit - 4) + 1) if kind == "ima_adpcm" else len(stored)
                    times = 2 if resample else 1
                    head, meter, kept = pcm_head(times * samples, times * rate), Meter(), []
                    hashed = hashlib.sha256(head)
                    for pcm in doubled(pieces) if resample else pieces:
                        meter.add(pcm)
                        raw = pcm.astype("<i2").tobytes()
                        hashed.update(raw)
                        if with_media:
                            kept.append(raw)
                    row = (doc, n, len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-32:]), len(file), hashlib.sha256(file).hexdigest(), len(head) + 2 * meter.samples, hashed.hexdigest(), f"codec={kind} {meter}", times * rate)
                    rows.append(row + (file, head + b"".join(kept)) * with_media)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ", ".join(" ".join(c) for c in names))
