"""Exact substring deduplication with prefix-partitioned suffix trees.

A window is ``length`` consecutive words of one document.  A window repeats if its
words also occur, in that order, in a document with a smaller id, and every word
that a repeating window covers is removed.

A repeat of at least ``length`` words holds one of the text's anchors, which are
the least, by hash, of the ``seed``-word runs of some window, and equal windows
have equal anchors.  So the trees are sparse: their suffixes begin at anchors and carry the words
left of it, up to where a window that holds the anchor can begin.

1. Documents are dealt into chunks of bounded size.  A chunk sends each of its
   distinct anchors once, with the number of windows where that is large.  An
   anchor found in one document only is a leaf above the depth and needs no tree.
2. Suffixes are split by prefixes of variable length, chosen by those counts: the
   anchor's own ``seed`` words, or, where they are frequent, each window is a
   suffix of its own, split by its first words, the more of them the more
   frequent the anchor is, up to the whole window, which a chunk sends once.
   Windows that repeat within a chunk are settled there, so a passage costs a task
   one entry a chunk, however often it occurs.
3. Each group of suffixes is a subtree, built by sorting the suffixes by their
   words with the common prefixes of neighbours.  An inner node of depth d is a run of
   suffixes with common prefixes of d words; split by the words left of the
   anchor, o of them, it gives the repeats of d + o words.  Those with d + o =
   ``length`` are the repeating windows, and longer maximal repeats are runs of
   them, which the chunk of a document puts together when it cuts them out.

Words are compared as they are: a number for each distinct word is drawn from
hashes, but only after all words with one hash were compared byte by byte.
All three steps use one shuffle of the documents by chunk, which Spark reuses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.textops import U64, buffers, give_back, gram_hashes, inside, mix, owners, ragged, slices, span_hashes, word_spans

LENGTH, SEED = 13, 5
NO_ID = (1 << 63) - 1


def _seeds(words: np.ndarray, bounds: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all documents: first word, hash of the seed, and the seed's offset."""
    if len(words) < length:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    grams = gram_hashes(words, seed, 3)
    span = length - seed + 1
    offset = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1)
    start = np.flatnonzero(inside(bounds, length, len(words)))
    offset = offset[start]
    return start, grams[start + offset], offset


def word_numbers(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each word, equal exactly where the words' bytes are equal."""
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    group = np.cumsum(new) - 1
    number = np.empty(len(order), np.int64)
    number[order] = group
    first = order[new][number]
    sizes = ends - starts
    fine = (sizes == sizes[first]).all()
    for a in range(0, len(order), 1 << 17):
        b = a + (1 << 17)
        fine = fine and (buf[ragged(starts[a:b], sizes[a:b])] == buf[ragged(starts[first[a:b]], sizes[a:b])]).all()
    if fine:
        return number
    known: dict[bytes, int] = {}  # two words with one hash
    return np.array([known.setdefault(buf[x:y].tobytes(), len(known)) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)


class Chunk:
    """Words of a chunk's documents, in an order that depends on nothing but their ids and texts."""

    def __init__(self, table: pa.Table):
        ids = table.column("row id").fill_null(NO_ID).to_numpy()
        mark = table.column("row mark").fill_null(0).to_numpy()
        self.order = np.lexsort((mark, ids))
        self.ids = ids[self.order]
        self.column = table.column("row text").combine_chunks().take(pa.array(self.order))
        if isinstance(self.column, pa.ChunkedArray):
            self.column = self.column.combine_chunks()
        self.buf, place = buffers(self.column)
        hashes, bounds, spans, before = [np.zeros(0, U64)], [np.zeros(1, np.int64)], [np.zeros((2, 0), np.int64)], 0
        for row, _, buf, off in slices(self.column):
            starts, ends, b = word_spans(buf, off)
            hashes.append(span_hashes(buf, starts, ends))
            bounds.append(b[1:] + before)
            spans.append(np.stack([starts, ends]) + place[row])
            before += len(starts)
        self.words, self.bounds = np.concatenate(hashes), np.concatenate(bounds)
        self.starts, self.ends = np.concatenate(spans, axis=1)

    def numbers(self, start: np.ndarray, length: int) -> np.ndarray:
        """Numbers of the words of the windows that begin at ``start``; other words have none."""
        cover = np.zeros(len(self.words) + 1, np.int64)
        cover[start] += 1  # each place occurs once
        cover[start + length] -= 1
        own = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
        out = np.full(len(self.words), -1, np.int64)
        out[own] = word_numbers(self.buf, self.starts[own], self.ends[own], self.words[own])
        return out

    def joined(self, words: np.ndarray) -> bytes:
        """The words at the given places, a blank after each."""
        out = []
        for a in range(0, len(words), 1 << 17):
            at = words[a : a + (1 << 17)]
            sizes = self.ends[at] - self.starts[at]
            text = self.buf[np.minimum(ragged(self.starts[at], sizes + 1), len(self.buf) - 1)]
            text[np.cumsum(sizes + 1) - 1] = 0x20
            out.append(text.tobytes())
        return b"".join(out)


def _parts(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> U64(40)) % U64(n)).astype(np.int64)


def _split(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that has members, with their places."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    first = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1]))
    for p, at in zip(part[order[first]].tolist(), np.split(order, first[1:]), strict=True):
        yield p, at


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    give_back()
    if not rows:
        return schema.empty_table()
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


SENT = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("data", pa.binary())])
BACK = pa.schema([("to_chunk", pa.int32()), ("data", pa.binary())])


def _send_seeds(table: pa.Table, parts: int, length: int, seed: int, frequent: int) -> pa.Table:
    """Of each part: the chunk's distinct seeds: of one document, of several, and with numbers of windows where these are large."""
    chunk = table.column("chunk")[0].as_py()
    c = Chunk(table)
    start, key, _ = _seeds(c.words, c.bounds, length, seed)
    if not len(key):
        return SENT.empty_table()
    doc = c.ids[owners(c.bounds)[start]]
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    windows = np.diff(np.append(first, len(key)))
    key = key[first]
    kind = np.where(several, np.where(windows > frequent, 2, 1), 0)
    rows = []
    for p, at in _split(_parts(key, parts)):
        one, more, many = (at[kind[at] == i] for i in range(3))
        rows.append((p, chunk, np.array([len(one), len(more), len(many)]).tobytes() + key[np.concatenate([one, more, many])].tobytes() + windows[many].tobytes()))
    return _rows(rows, SENT)


def _shared_seeds(table: pa.Table, frequent: int, length: int, seed: int) -> pa.Table:
    """Back to each chunk: those of its seeds that several documents hold; first the frequent ones, each with the length of its prefixes."""
    chunks = table.column("chunk").to_pylist()
    keys, several, weights, of = [], [], [], []
    for i, data in enumerate(table.column("data")):
        raw = data.as_buffer()
        one, more, many = np.frombuffer(raw, np.int64, 3)
        n = int(one + more + many)
        keys.append(np.frombuffer(raw, U64, n, 24))
        several.append(np.arange(n) >= one)
        weights.append(np.ones(n, np.int64))
        weights[-1][n - many :] = np.frombuffer(raw, np.int64, -1, 24 + 8 * n)
        of.append(np.full(n, i))
    key, many, weight, of_ = np.concatenate(keys), np.concatenate(several), np.concatenate(weights), np.concatenate(of)
    order = np.argsort(key, kind="stable")
    key, many, weight, of_ = key[order], many[order], weight[order], of_[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(first, len(key)))
    shared = (count > 1) | np.logical_or.reduceat(many, first)
    heavy = np.add.reduceat(weight, first)
    size = np.zeros(len(first), np.int64)
    hot = heavy > frequent
    size[hot] = np.minimum(length, seed + 1 + np.log2(heavy[hot] // frequent).astype(np.int64))
    size, shared = np.repeat(size, count), np.repeat(shared, count)
    rows = []
    order = np.argsort(of_[shared], kind="stable")
    of_s, key_s, size_s = of_[shared][order], key[shared][order], size[shared][order]
    ends = np.searchsorted(of_s, np.arange(len(chunks) + 1))
    for i, chunk in enumerate(chunks):
        k, n = key_s[ends[i] : ends[i + 1]], size_s[ends[i] : ends[i + 1]]
        if len(k):
            rows.append((chunk, np.int64((n > 0).sum()).tobytes() + k[n > 0].tobytes() + n[n > 0].astype(U64).tobytes() + k[n == 0].tobytes()))
    return _rows(rows, BACK)


ENTRY = np.dtype([("doc", "<i8"), ("row", "<i4"), ("start", "<i4"), ("offset", "u1"), ("windows", "u1")])


def _settle(c: Chunk, start: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's windows: those that stand for the others, those found to repeat, and pairs of one that stands for another of its document."""
    number = c.numbers(start, length)
    whole = gram_hashes(c.words, length, 7)[start]
    by = np.lexsort((start, doc, whole))  # the least document first, then its first occurrence
    new = np.append(True, whole[by][1:] != whole[by][:-1])
    lead = by[new][np.cumsum(new) - 1]
    same = np.ones(len(by), bool)
    for j in range(length):
        same &= number[start[by] + j] == number[start[lead] + j]
    later = same & (doc[by] > doc[lead])
    again = same & (doc[by] == doc[lead]) & (by != lead)
    return np.sort(by[~later & ~again]), by[later], np.stack([lead[again], by[again]], 1)


def _send_suffixes(table: pa.Table, back: pa.Table, parts: int, length: int, seed: int) -> pa.Table:
    """Of each part: the chunk's suffixes at shared anchors, with the words left of them.

    Of equal windows of one chunk only the first of the least document is sent; those
    of other documents repeat, which is passed on as part -1 - chunk, as are
    those of the same document, which share the first one's lot.
    """
    if not table.num_rows or not back.num_rows:
        return SENT.empty_table()
    chunk = table.column("chunk")[0].as_py()
    c = Chunk(table)
    hot, sizes, cold = [], [], []
    for data in back.column("data"):
        raw = np.frombuffer(data.as_buffer(), U64)
        n = int(raw[0])
        hot.append(raw[1 : 1 + n])
        sizes.append(raw[1 + n : 1 + 2 * n].astype(np.int64))
        cold.append(raw[1 + 2 * n :])
    hot, sizes = np.concatenate(hot), np.concatenate(sizes)
    shared = np.sort(np.concatenate([hot, *cold]))
    start, key, offset = _seeds(c.words, c.bounds, length, seed)
    own = shared[np.minimum(np.searchsorted(shared, key), len(shared) - 1)] == key
    start, key, offset = start[own], key[own], offset[own]
    if not len(start):
        return SENT.empty_table()
    row = owners(c.bounds)[start]
    doc = c.ids[row]
    lead, later, again = _settle(c, start, doc, length)
    rows = []
    if len(later) or len(again):
        at = start - c.bounds[row]
        local = np.stack([row[later], at[later]], 1).astype("<i4")
        pairs = np.stack([row[again[:, 0]], at[again[:, 0]], row[again[:, 1]], at[again[:, 1]]], 1).astype("<i4")
        rows.append((-1 - chunk, chunk, np.int64(len(local)).tobytes() + local.tobytes() + pairs.tobytes()))
    start, key, offset, row, doc = (x[lead] for x in (start, key, offset, row, doc))
    size = np.zeros(len(start), np.int64)
    if len(hot):
        order = np.argsort(hot)
        at = order[np.minimum(np.searchsorted(hot[order], key), len(hot) - 1)]
        size = np.where(hot[at] == key, sizes[at], 0)
    alone = size > 0
    follows = np.zeros(len(start), bool)
    follows[1:] = (start[1:] == start[:-1] + 1) & (key[1:] == key[:-1]) & (offset[1:] == offset[:-1] - 1) & (row[1:] == row[:-1]) & ~alone[1:]
    first = np.flatnonzero(~follows)
    windows = np.diff(np.append(first, len(start)))
    entry = np.zeros(len(first), ENTRY)
    entry["doc"], entry["row"], entry["windows"] = doc[first], row[first], windows
    entry["offset"] = np.where(alone[first], 0, offset[first])
    entry["start"] = start[first] - c.bounds[row[first]]
    prefix = mix(key[first])
    for n in np.unique(size[first][alone[first]]).tolist():
        at = size[first] == n
        prefix[at] = gram_hashes(c.words, n, 11)[start[first[at]]]
    for p, at in _split(_parts(prefix, parts)):
        words = ragged(start[first[at]], windows[at] + length - 1)
        rows.append((p, chunk, np.int64(len(at)).tobytes() + entry[at].tobytes() + c.joined(words)))
    return _rows(rows, SENT)


def repeated_windows(doc: np.ndarray, anchor: np.ndarray, offset: np.ndarray, windows: np.ndarray, number: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(o, suffixes)``: suffixes whose window that begins o words left of the anchor also begins one in a smaller document.

    Suffix i begins at word ``anchor[i]`` of ``number`` and has the windows that begin
    ``offset[i]`` words before it and the ``windows[i] - 1`` next ones.
    """
    n = len(anchor)
    least = offset - windows + 1
    right = np.zeros((n, length), np.int32)  # 0 beyond a suffix's end
    for j in range(length):
        some = np.flatnonzero(least + j < length)
        right[some, j] = number[anchor[some] + j] + 1
    order = np.lexsort(right.T[::-1])
    common = np.zeros(n, np.int64)  # words that a suffix has in common with the one before it
    if n > 1:
        common[1:] = np.cumprod(right[order][1:] == right[order][:-1], axis=1).sum(1)
    left = np.zeros(n, np.int64)  # class of the o words left of the anchor
    for o in range(int(offset.max(initial=0)) + 1):
        if o:
            has = np.flatnonzero(offset >= o)
            left[has] = np.unique(left[has] * (int(number.max(initial=0)) + 1) + number[anchor[has] - o], return_inverse=True)[1]
        node = np.empty(n, np.int64)
        node[order] = np.cumsum(common < length - o)  # inner node at depth length - o
        some = np.flatnonzero((least <= o) & (o <= offset))
        if not len(some):
            continue
        key = node[some] * (int(left[some].max()) + 1) + left[some]
        by = np.lexsort((doc[some], key))
        new = np.append(True, key[by][1:] != key[by][:-1])
        first = doc[some][by[new]][np.cumsum(new) - 1]
        hit = some[by[doc[some][by] > first]]
        if len(hit):
            yield o, hit


def _read_words(text: bytes, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of :meth:`Chunk.joined`, in pieces that end at a blank."""
    out, a = [np.zeros((3, 0), np.int64)], 0
    while a < len(text):
        b = text.find(b" ", min(a + piece, len(text) - 1)) + 1
        buf = np.frombuffer(text, np.uint8, b - a, a)
        starts, ends, _ = word_spans(buf, np.array([0, len(buf)]))
        out.append(np.stack([starts + a, ends + a, span_hashes(buf, starts, ends).view(np.int64)]))
        a = b
    starts, ends, hashes = np.concatenate(out, axis=1)
    return starts, ends, hashes.view(U64)


def _subtree(table: pa.Table, length: int) -> pa.Table:
    """Back to each chunk: rows and first words of its windows that a document with a smaller id holds."""
    chunks = table.column("chunk").to_pylist()
    entries, texts, of, out = [], [], [], []
    for i, (part, data) in enumerate(zip(table.column("part").to_pylist(), table.column("data"), strict=True)):
        buf = data.as_buffer()
        if part < 0:
            out.append((chunks[i], buf.to_pybytes()))
            continue
        n = int(np.frombuffer(buf, np.int64, 1)[0])
        entries.append(np.frombuffer(buf, ENTRY, n, 8))
        texts.append(memoryview(buf)[8 + n * ENTRY.itemsize :])
        of.append(np.full(n, i))
    if entries:
        entry, of_, text = np.concatenate(entries), np.concatenate(of), b"".join(texts)
        number = word_numbers(np.frombuffer(text, np.uint8), *_read_words(text))
        offset, windows = entry["offset"].astype(np.int64), entry["windows"].astype(np.int64)
        size = windows + length - 1
        anchor = np.cumsum(size) - size + offset
        found, source = [np.zeros((0, 2), "<i4")], [np.zeros(0, np.int64)]
        for o, hit in repeated_windows(entry["doc"], anchor, offset, windows, number, length):
            found.append(np.stack([entry["row"][hit], entry["start"][hit] + offset[hit] - o], 1).astype("<i4"))
            source.append(of_[hit])
        hits, source = np.concatenate(found), np.concatenate(source)
        for i, at in _split(source):
            out.append((chunks[i], np.int64(len(at)).tobytes() + hits[at].tobytes()))
    return _rows(out, BACK)


def _windows_of(c: Chunk, back: pa.Table) -> np.ndarray:
    """Places of the repeating windows in the chunk's words."""
    hits, pairs = [np.zeros((0, 2), "<i4")], [np.zeros((0, 4), "<i4")]
    for data in back.column("data"):
        raw = data.as_buffer()
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        hits.append(np.frombuffer(raw, "<i4", 2 * n, 8).reshape(-1, 2))
        pairs.append(np.frombuffer(raw, "<i4", -1, 8 + 8 * n).reshape(-1, 4))
    hit, pair = np.concatenate(hits), np.concatenate(pairs)
    at = np.unique(c.bounds[hit[:, 0]] + hit[:, 1])
    one, other = c.bounds[pair[:, 0]] + pair[:, 1], c.bounds[pair[:, 2]] + pair[:, 3]
    return np.union1d(at, other[np.isin(one, at)])


def _cut(table: pa.Table, back: pa.Table, length: int, plain: bool) -> pa.Table:
    """The chunk's rows with the number of words, of removed words, the removed spans, and the kept words joined by blanks."""
    c = Chunk(table)
    cover = np.zeros(len(c.words) + length + 1, np.int32)
    at = _windows_of(c, back)
    cover[at] += 1
    cover[at + length] -= 1
    gone = np.cumsum(cover)[: len(c.words)] > 0
    upto = np.concatenate([[0], np.cumsum(gone)])
    total, removed = np.diff(c.bounds), upto[c.bounds[1:]] - upto[c.bounds[:-1]]
    kept: list[str | None] = []
    texts = c.column.cast(pa.binary())
    for i, (n, r) in enumerate(zip(total, removed, strict=True)):
        if plain and not r:
            kept.append(texts[i].as_py().decode())
            continue
        if n == r:
            kept.append("")
            continue
        words = texts[i].as_py().split()
        if r:
            a = c.bounds[i]
            words = [w for w, x in zip(words, gone[a : a + n], strict=True) if not x]
        kept.append(b" ".join(words).decode())
    table = table.take(pa.array(c.order))
    drop = {"chunk", "row id", "row mark", "row text"}
    columns = [table.column(n) for n in table.column_names if n not in drop]
    names = [n for n in table.column_names if n not in drop]
    own = owners(c.bounds)
    other = np.append(True, own[1:] != own[:-1])
    first = np.flatnonzero(gone & (other | ~np.append(False, gone[:-1])))
    last = np.flatnonzero(gone & np.append(other[1:] | ~gone[1:], True)) if len(gone) else first
    spans = pa.StructArray.from_arrays([pa.array(first - c.bounds[own[first]], pa.int64()), pa.array(last - first + 1, pa.int64())], names=["start", "words"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(first, c.bounds), pa.int32()), spans)
    give_back()
    return pa.table([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), spans, pa.array(kept, pa.string())], names=[*names, "n_words", "n_removed", "removed_spans", "kept_text"])


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, length: int = LENGTH, seed: int = SEED, chunk_bytes: int = 8 << 20, frequent: int = 64, as_they_are: bool = False) -> DataFrame:
    """Columns ``keep`` (the id, if not given) of every row, ``n_words``, ``n_removed``, ``removed_spans`` and ``kept_text``.

    Words are runs of characters other than U+0020 and U+0009..U+000D.  kept_text
    is the words not removed, joined by single blanks; with ``as_they_are`` a text
    that loses nothing keeps its white space too.  removed_spans are the passages
    that were cut out: first word and number of words.  ``frequent`` is the number
    of suffixes from which on a prefix is lengthened; ``length`` is at most 255.

    A null text has no words.  A null id counts as the largest.  Rows with one id
    are one document for the comparison: none of them repeats another; they may
    have different texts.  A text of
    fewer than ``length`` words keeps them all.  ``keep`` may name any columns but
    the four that are added; others are dropped.  An empty
    table gives no rows.  A row is held whole in one task, and rows of one id and one text share it.
    """
    keep = [id_col] if keep is None else keep
    total, rows_ = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.count(F.lit(1))).first()
    chunks = max(1, -(-(total or 0) // chunk_bytes), -(-rows_ // 200_000))
    parts = chunks
    spread = docs.select(
        F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")), F.lit(chunks)).cast("int").alias("chunk"),
        F.col(id_col).cast("long").alias("row id"),
        F.xxhash64(F.col(text_col).cast("string")).alias("row mark"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("row text"),
        *[F.col(f"`{c}`") for c in keep],
    )
    # as many partitions as chunks, so that a task has one or a few whatever the size of the table
    spread = spread.repartition(chunks, "chunk")
    sent = "part int, chunk int, data binary"
    # the exchanges below deal by the same key and hold the same columns, so one shuffle serves all three
    seeds = spread.groupBy("chunk").applyInArrow(lambda t: _send_seeds(t, parts, length, seed, frequent), sent)
    shared = seeds.repartition(parts, "part").groupBy("part").applyInArrow(lambda t: _shared_seeds(t, frequent, length, seed), "to_chunk int, data binary")
    suffixes = spread.groupBy("chunk").cogroup(shared.groupBy("to_chunk")).applyInArrow(lambda t, b: _send_suffixes(t, b, parts, length, seed), sent)
    hits = suffixes.repartition(parts, "part").groupBy("part").applyInArrow(lambda t: _subtree(t, length), "to_chunk int, data binary")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spread.schema if f.name in keep)

    def cut(t: pa.Table, b: pa.Table) -> pa.Table:
        return _cut(t, b, length, as_they_are)

    return spread.groupBy("chunk").cogroup(hits.groupBy("to_chunk")).applyInArrow(cut, f"{schema}, n_words long, n_removed long, removed_spans array<struct<start: long, words: long>>, kept_text string")
