"""Hashed subword features, per-word caches and training samples for the text classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.textops import U64, give_back, gram_hashes, inside, mix, owners, ragged, slices, span_hashes, word_spans

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def word_features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, grams: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word (the word, then its character n-grams) and how many each word has.

    n-grams know whether they begin or end the word, as if it stood in brackets.
    """
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    first, last = np.searchsorted(lead, starts), np.searchsorted(lead, ends)
    lead = np.append(lead, len(buf))
    chars = last - first
    parts, of = [mix(span_hashes(buf, starts, ends))], [np.arange(len(starts))]
    for n in grams:
        k = np.maximum(chars - n + 1, 0)
        at = ragged(first, k)
        word = np.repeat(np.arange(len(starts)), k)
        h = span_hashes(buf, lead[at], np.minimum(lead[at + n], ends[word]))
        flag = (at == first[word]).astype(U64) + U64(2) * (at + n == last[word]).astype(U64)
        parts.append(mix(h + flag * U64(0xA24BAED4963EE407) + U64(n)))
        of.append(word)
    order = np.argsort(np.concatenate(of), kind="stable")
    return (np.concatenate(parts)[order] % U64(buckets)).astype(np.int64), np.bincount(np.concatenate(of), minlength=len(starts))


class WordTable:
    """Row of numbers of each distinct word, worked out once and kept for up to ``most`` words."""

    def __init__(self, width: int, of_words: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], distinct: bool = False, most: int = 300_000):
        self.width, self.of_words, self.distinct, self.most = width, of_words, distinct, most
        self.keys, self.rows = np.zeros(0, U64), np.zeros((0, width), np.float32)

    def sums(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of its words' rows for each document, and its number of words; each word counts once if ``distinct``."""
        starts, ends, bounds = word_spans(buf, off)
        counts = np.diff(bounds)
        if not len(starts):
            return np.zeros((len(counts), self.width)), counts
        keys, at, which = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.keys, self.rows = self.keys[:0], self.rows[:0]
        place = np.searchsorted(self.keys, keys)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == keys[known]
        own = np.empty((len(keys), self.width), np.float32)
        own[known] = self.rows[place[known]]
        new = np.flatnonzero(~known)
        for i in range(0, len(new), 50_000):
            some = new[i : i + 50_000]
            a, n = starts[at[some]], (ends - starts)[at[some]]
            own[some] = self.of_words(buf[ragged(a, n)], np.cumsum(n) - n, np.cumsum(n))
        if len(new):
            both = np.concatenate([self.keys, keys[new]])
            order = np.argsort(both, kind="stable")
            self.keys, self.rows = both[order], np.concatenate([self.rows, own[new]])[order]
        doc = owners(bounds)
        if self.distinct:
            pairs = np.unique(doc * len(keys) + which)
            doc, which = pairs // len(keys), pairs % len(keys)
            counts = np.bincount(doc, minlength=len(counts))
        return np.stack([np.bincount(doc, own[which, j], len(counts)) for j in range(self.width)], 1), counts


def crc_of(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string"))


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, *, id_col: str, text_col: str, label_col: str, most_rows: int, most_bytes: int) -> list[tuple[int, str, int]]:
    """At most ``most_rows`` rows ``(id, text, label)`` of each label, by the least hash of the id.

    ``learn`` says which ids may be used.  Texts over ``most_bytes`` and null ones are
    left to others, which bounds what the driver holds.  Ids with both labels are
    left out; of an id's different texts the one of least hash counts.
    """
    good = labels.where(learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("low"), F.max(label_col).alias("high")).where("low = high")
    texts = docs.select(F.col(id_col).cast("long").alias("sample_id"), F.col(text_col).cast("string").alias("sample_text")).where(F.octet_length("sample_text") <= most_bytes)
    good = good.select(F.col(id_col).cast("long").alias("sample_id"), F.col("low").cast("int").alias("sample_label")).join(texts.select("sample_id"), "sample_id", "left_semi")
    picked = []
    for value in (0, 1):
        picked += good.where(F.col("sample_label") == value).orderBy(F.xxhash64("sample_id"), "sample_id").limit(most_rows).collect()
    if not picked:
        return []
    chosen = F.broadcast(docs.sparkSession.createDataFrame(picked, good.schema))  # 2 * most_rows rows at most
    rows = texts.join(chosen, "sample_id").groupBy("sample_id", "sample_label").agg(F.min(F.struct(F.xxhash64("sample_text"), "sample_text"))["sample_text"].alias("sample_text"))
    return sorted((r.sample_id, r.sample_text, r.sample_label) for r in rows.collect())


def sparse_documents(texts: list[str], grams: tuple[int, ...], buckets: int, lower: bool = False, distinct: bool = False, order: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Of each text: its distinct buckets, their weights (a word's features share weight 1; those of :func:`order_features` have 1 each, if ``order``) and its number of words."""
    for _, _, buf, off in slices(pa.array(texts, pa.string()), 1 << 19):
        buf = LOWER[buf] if lower else buf
        starts, ends, bounds = word_spans(buf, off)
        if distinct:
            doc, keys = owners(bounds), span_hashes(buf, starts, ends)
            by = np.lexsort((keys, doc))
            new = np.ones(len(by), bool)
            new[1:] = (keys[by][1:] != keys[by][:-1]) | (doc[by][1:] != doc[by][:-1])
            one = np.sort(by[new])
            starts, ends, bounds = starts[one], ends[one], np.searchsorted(one, bounds)
        flat, n = word_features(buf, starts, ends, grams, buckets)
        upto = np.concatenate([[0], np.cumsum(n)])
        of, more = order_features(buf, off, buckets) if order else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        sort = np.argsort(of, kind="stable")
        more, of = more[sort], np.searchsorted(of[sort], np.arange(len(off)))
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            some = np.concatenate([flat[upto[a] : upto[b]], more[of[k] : of[k + 1]]])
            weight = np.concatenate([np.repeat(1.0 / n[a:b], n[a:b]), np.ones(of[k + 1] - of[k])])
            ids, which = np.unique(some, return_inverse=True)
            yield ids.astype(np.int32), np.bincount(which, weight, len(ids)).astype(np.float32), int(b - a)


def batches(docs: list[tuple[np.ndarray, np.ndarray, int]], order: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Minibatches: rows, their distinct buckets, and the dense matrix of weights."""
    for i in range(0, len(order), size):
        rows = order[i : i + size]
        ids = np.concatenate([docs[r][0] for r in rows])
        used, which = np.unique(ids, return_inverse=True)
        row = np.repeat(np.arange(len(rows)), [len(docs[r][0]) for r in rows])
        x = np.zeros((len(rows), len(used)), np.float32)
        x[row, which] = np.concatenate([docs[r][1] for r in rows])
        yield rows, used, x


def score_batches(text_at: int, last: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable:
    """mapInArrow function: appends the scores of column ``text_at`` to the first ``last`` columns."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            scores = [np.zeros(0)]
            for _, _, buf, off in slices(batch.column(text_at)):
                scores.append(score(buf, off))
            columns = [batch.column(i) for i in range(last)]
            yield pa.record_batch([*columns, pa.array(np.concatenate(scores), pa.float64())], names=[*batch.schema.names[:last], "score"])
            give_back()

    return run


def to_score(docs: DataFrame, keep: list[str], text_col: str) -> tuple[DataFrame, int, str]:
    """Columns ``keep`` and the text, which comes once; its place; and the schema of the scored rows."""
    if text_col in keep and docs.schema[text_col].dataType.simpleString() == "string":
        chosen, at = docs.select(*keep), keep.index(text_col)
    else:
        chosen, at = docs.select(*keep, F.col(text_col).cast("string").alias("text to score")), len(keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[: len(keep)])
    return chosen, at, f"{fields}, score double"


def order_features(buf: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket of each word bigram, of each word like the one before, and of each run of four words seen before in the document.

    The last two kinds have a bucket each, at the end of the table.
    """
    starts, ends, bounds = word_spans(buf, off)
    words, doc = span_hashes(buf, starts, ends), owners(bounds)
    if len(words) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair = inside(bounds, 2, len(words))
    same = pair & (words[1:] == words[:-1])
    pairs = (gram_hashes(words, 2, 5)[pair] % U64(buckets)).astype(np.int64)
    four = np.flatnonzero(inside(bounds, 4, len(words)))
    key = mix(gram_hashes(words, 4, 5)[four] + doc[four].astype(U64) * U64(0x8CB92BA72F3D8DD7))
    again = np.ones(len(four), bool)
    again[np.unique(key, return_index=True)[1]] = False
    return np.concatenate([doc[1:][pair], doc[1:][same], doc[four[again]]]), np.concatenate([pairs, np.full(int(same.sum()), buckets - 1), np.full(int(again.sum()), buckets - 2)])
