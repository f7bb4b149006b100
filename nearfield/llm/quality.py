"""Quality classifier: supervised subword embeddings.

Words, their character n-grams and word bigrams hash into buckets, each with a
learned vector; two buckets stand for any word repeated at once and any four
words seen before in the document.  A word is the mean of its buckets' vectors, a
document the sum of its words and bigrams over its number of words; a softmax layer on top gives the probability of each label.  Vectors and layer are
trained together by stochastic gradient descent in numpy on a bounded sample.

A document's logits are linear in its buckets, so scoring folds the layer into
one number a bucket and works out each distinct word once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.subwords import WordTable, batches, labelled_sample, order_features, score_batches, sparse_documents, to_score, word_features
from nearfield.llm.textops import give_back

GRAMS = (2, 3, 4)


@dataclass
class SubwordModel:
    """Difference of the two labels' logits, folded into one weight a bucket."""

    weights: np.ndarray
    bias: float
    grams: tuple[int, ...]

    def of_words(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        flat, n = word_features(buf, starts, ends, self.grams, len(self.weights))
        return (np.add.reduceat(self.weights[flat], np.cumsum(n) - n) / n)[:, None]

    def scores(self, table: WordTable, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        sums, counts = table.sums(buf, off)
        doc, bucket = order_features(buf, off, len(self.weights))
        sums = sums[:, 0] + np.bincount(doc, self.weights[bucket], len(counts))
        return 1 / (1 + np.exp(-np.clip(sums / np.maximum(counts, 1) + self.bias, -30, 30)))


def train(texts: list[str], labels: list[int], *, buckets: int = 1 << 17, width: int = 12, epochs: int = 8, rate: float = 0.8, batch: int = 32, seed: int = 11) -> SubwordModel:
    """Fit vectors and softmax layer; with no rows, or one label only, the score is that label's share."""
    y = np.asarray(labels, np.int64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    if len(set(labels)) < 2:
        return SubwordModel(np.zeros(buckets, np.float32), float(np.log(share / (1 - share))), GRAMS)
    docs = [(i, w / max(n, 1), n) for i, w, n in sparse_documents(texts, GRAMS, buckets, order=True)]
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / width, 1 / width, (buckets, width)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (width, 2)).astype(np.float32), np.zeros(2, np.float32)
    squared, squared_layer = np.full(buckets, 1e-8, np.float32), np.float32(1e-8)
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)).astype(np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for rows, used, x in batches(docs, rng.permutation(len(docs)), batch):
            hidden = x @ vectors[used]
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= balance[rows, None] / len(rows)
            down = x.T @ (p @ layer.T)
            squared[used] += (down**2).mean(1)
            gradient = hidden.T @ p
            squared_layer += (gradient**2).mean()
            vectors[used] -= 0.3 * step * down / np.sqrt(squared[used])[:, None]
            layer -= 0.1 * step * gradient / np.sqrt(squared_layer)
            bias -= 0.1 * step * p.sum(0)
    fold = layer[:, 1] - layer[:, 0]
    return SubwordModel(vectors @ fold, float(bias[1] - bias[0]), GRAMS)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn=None, most_rows: int = 1000, most_bytes: int = 50_000) -> SubwordModel:
    """Train on at most ``most_rows`` labelled rows of each label (texts up to ``most_bytes``) that ``learn`` allows."""
    rows = labelled_sample(docs, labels, F.lit(True) if learn is None else learn, id_col=id_col, text_col=text_col, label_col=label_col, most_rows=most_rows, most_bytes=most_bytes)
    model = train([t for _, t, _ in rows], [y for _, _, y in rows])
    give_back()  # what training took; the driver goes on
    return model


def score(docs: DataFrame, model: SubwordModel, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of every row and ``score``, the probability of label 1, from the whole text.

    A null or empty text, having no words, gets the score of the bias alone.
    Repeated rows and null ids pass through; columns not in ``keep`` are ignored.
    """
    chosen, at, schema = to_score(docs, keep, text_col)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # one number a bucket

    def run(parts):
        m = shared.value
        table = WordTable(1, m.of_words)
        yield from score_batches(at, len(keep), lambda buf, off: m.scores(table, buf, off))(parts)

    return chosen.mapInArrow(run, schema)
