"""Packing documents into token windows by online sum-of-squares bin packing.

A shard (one Spark partition) keeps ``level[h]``, the number of open windows
filled up to ``h`` tokens, and puts each piece where the sum of the squared
counts afterwards is least.  That keeps all fill levels about equally common, so
later pieces find gaps that they fill exactly.  Shards work alone, without a
shuffle; a shard holds at most ``most_open`` open windows and ends with at most
one window that isn't full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.bpe import CachedBPE
from nearfield.llm.textops import give_back, slices

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Levels:
    """Open windows of one shard, by fill level."""

    def __init__(self, capacity: int, first: int, most_open: int):
        self.capacity, self.next_id, self.most_open = capacity, first, most_open
        self.count = np.zeros(capacity + 1, np.int64)
        self.windows: list[list[list]] = [[] for _ in range(capacity + 1)]  # by level: windows, each [id, pieces]
        self.open = 0
        self.done: list[tuple] = []

    def choose(self, size: int) -> int:
        """Fill level of the window that ``size`` tokens go to; 0 is a new one.

        Moving a window from h to h + size changes the sum of squares by
        2 (count[h + size] - count[h]) + 2, by 1 - 2 count[h] if it becomes
        full, and a new window by 2 count[size] + 1.  Of equal changes the
        fullest window wins.
        """
        c, count = self.capacity, self.count
        if size == c:
            return 0
        change = 2 * (count[size:] - count[: c - size + 1]) + 2
        change[-1] = 1 - 2 * count[c - size]
        change[count[: c - size + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * count[size] + 1
        return int(c - size - np.argmin(change[::-1]))

    def put(self, piece: tuple) -> None:
        """piece: (document and its length, start, ids)."""
        size = len(piece[2])
        h = self.choose(size)
        if h:
            window = self.windows[h].pop()
            self.count[h] -= 1
            self.open -= 1
        else:
            window = [self.next_id, []]
            self.next_id += 1
        window[1].append(piece)
        self._keep(window, h + size)
        if self.open >= self.most_open:
            self.close()

    def _keep(self, window: list, level: int) -> None:
        if level == self.capacity:
            at = 0
            for doc, start, ids in window[1]:
                self.done.append((doc, start, window[0], at, ids))
                at += len(ids)
        else:
            self.windows[level].append(window)
            self.count[level] += 1
            self.open += 1

    def close(self) -> None:
        """Fill the fuller open windows with cut pieces of the emptier ones; at most one stays open."""
        order = [(h, w) for h in range(self.capacity - 1, 0, -1) for w in self.windows[h]]
        self.windows = [[] for _ in range(self.capacity + 1)]
        self.count[:] = 0
        self.open = 0
        loose = 0  # order[loose:] are whole
        while loose < len(order):
            h, window = order[loose]
            loose += 1
            while h < self.capacity and loose < len(order):
                last, donor = order[-1]
                doc, start, ids = donor[1].pop()
                keep = max(0, len(ids) - (self.capacity - h))  # the end of the piece moves
                window[1].append((doc, start + keep, ids[keep:]))
                h += len(ids) - keep
                last -= len(ids) - keep
                if keep:
                    donor[1].append((doc, start, ids[:keep]))
                if last:
                    order[-1] = (last, donor)
                else:
                    order.pop()
            self._keep(window, h)

    def flush(self) -> list[tuple]:
        done, self.done = self.done, []
        return done

    def end(self) -> list[tuple]:
        self.close()
        for h in range(1, self.capacity):
            for window in self.windows[h]:
                at = 0
                for doc, start, ids in window[1]:
                    self.done.append((doc, start, window[0], at, ids))
                    at += len(ids)
        return self.flush()


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, most_open: int = 8192) -> DataFrame:
    """Pack every document of ``docs`` into sequences of at most ``capacity`` tokens.

    A document is its ids by the tokenizer file ``tokenizer`` without special
    tokens, then ``end_id``; a null or empty text is ``end_id`` alone.  Documents
    of ``capacity`` tokens or more are first cut into full windows.  Returns a row
    for each piece: its document, its first id's position in the document, its
    length, the document's length, its sequence, its place there, and its ids as
    little-endian unsigned 32-bit numbers.

    Nulls: a null id stays null in its pieces.  Repeated rows are packed as often
    as they occur.  Other columns are ignored, whatever their names.  An empty
    table gives no rows.  A shard's last sequence may be shorter than
    ``capacity``; every other sequence is full, so padding is under one window a
    shard.  A shard holds at most ``most_open`` open windows, which bounds its memory:
    when there are that many, which mixed lengths don't reach in a shard of ordinary
    size, the fuller ones are filled up with cut pieces of the emptier ones, and the
    level array begins anew; no token is lost or padded by that.  Rows depend on the input's partitions and on the order in them only.
    """

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        coder = CachedBPE(tokenizer)
        context = TaskContext.get()
        levels = Levels(capacity, (context.partitionId() if context else 0) << 33, most_open)
        schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            docs_, starts, seqs, at, ids = zip(*pieces, strict=True)
            return pa.record_batch(
                [pa.array([d[0] for d in docs_], pa.int64()), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([d[1] for d in docs_], pa.int64()), pa.array(seqs, pa.int64()), pa.array(at, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                schema=schema,
            )

        for batch in batches:
            for a, b, buf, off in slices(batch.column(1)):
                ids, before = coder.encode(buf, off)
                for i, doc in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    own = np.append(ids[before[i] : before[i + 1]], np.uint32(end_id)).astype("<u4")
                    whole = (doc, len(own))
                    for start in range(0, len(own), capacity):
                        levels.put((whole, start, own[start : start + capacity].copy()))
                if done := levels.flush():
                    yield rows(done)
        if done := levels.end():
            yield rows(done)
        del coder, levels
        give_back()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(shard, PIECES)
