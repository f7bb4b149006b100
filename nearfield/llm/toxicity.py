"""Toxicity: a factorization machine over hashed terms.

Terms are words and their character n-grams, hashed.  With x a document's
vector of terms, each distinct word weighing 1 / sqrt(distinct words), the logit is

    w0 + sum_t w_t x_t + 1/2 sum_f ((sum_t v_tf x_t)^2 - sum_t (v_tf x_t)^2)

so pairs of terms, such as an insult and a mention of a group, count beyond what
each weighs alone.  All sums run over words, so each distinct word is worked out
once and scoring takes one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.subwords import LOWER, WordTable, batches, labelled_sample, score_batches, sparse_documents, to_score, word_features
from nearfield.llm.textops import give_back

GRAMS = (4,)


@dataclass
class FactorizationMachine:
    linear: np.ndarray
    factors: np.ndarray
    bias: float
    grams: tuple[int, ...]

    def of_words(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each word: linear weight, factors, and squared length of the factors; its terms share weight 1."""
        flat, n = word_features(buf, starts, ends, self.grams, len(self.linear))
        at = np.cumsum(n) - n
        share = (1.0 / np.repeat(n, n)).astype(np.float32)
        v = self.factors[flat] * share[:, None]
        return np.column_stack([np.add.reduceat(self.linear[flat] * share, at), np.add.reduceat(v, at, axis=0), np.add.reduceat((v**2).sum(1), at)])

    def link(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        n = np.maximum(counts, 1)
        logit = self.bias + sums[:, 0] / np.sqrt(n) + 0.5 * ((sums[:, 1:-1] ** 2).sum(1) - sums[:, -1]) / n
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train(texts: list[str], labels: list[int], *, buckets: int = 1 << 17, width: int = 6, epochs: int | None = None, factor_rate: float = 0.2, spread: float = 0.05, least_docs: int = 3, start: float = 6.0, least_z: float = 2.5, rate: float = 0.4, batch: int = 32, penalty: float = 1e-4, seed: int = 7) -> FactorizationMachine:
    """Fit by stochastic gradient descent with per-bucket steps; with one label only, the score is that label's share.

    Linear weights start from log odds and are kept for terms whose odds differ
    from even by ``least_z`` standard errors; factors are learned for all terms of
    at least ``least_docs`` documents.  Rare and neutral terms would else add noise
    that hides a few telling words in a long text.
    """
    y = np.asarray(labels, np.float32)
    share = float((y.sum() + 0.5) / (len(y) + 1))
    rng = np.random.default_rng(seed)
    linear = np.zeros(buckets, np.float32)
    factors = rng.normal(0, spread, (buckets, width)).astype(np.float32)
    bias = float(np.log(share / (1 - share)))
    if len(set(labels)) < 2:
        return FactorizationMachine(linear, factors * 0, bias, GRAMS)
    docs = [(i, w / np.float32(np.sqrt(max(n, 1))), n) for i, w, n in sparse_documents(texts, GRAMS, buckets, lower=True, distinct=True)]
    # terms of fewer than least_docs documents would only be learned by heart
    found = np.zeros((2, buckets))
    for (ids, _, _), label in zip(docs, labels, strict=True):
        found[int(label), ids] += 1
    known = found.sum(0) >= least_docs
    docs = [(i[known[i]], w[known[i]], n) for i, w, n in docs]
    factors[~known] = 0
    rate_of = (found + 0.5) / (np.array([[len(y) - y.sum()], [y.sum()]]) + 1)
    odds = np.log(rate_of[1] / rate_of[0])
    telling = known & (np.abs(odds) >= least_z * np.sqrt((1 / (found + 0.5)).sum(0)))
    linear[telling] = start * odds[telling]
    squared, squared_factors = np.full(buckets, 1e-6, np.float32), np.full(buckets, 1e-6, np.float32)
    bias = 0.0
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    epochs = epochs or max(6, min(20, 10_000 // len(docs)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for rows, used, x in batches(docs, rng.permutation(len(docs)), batch):
            v = factors[used]
            inner = x @ v
            logit = bias + x @ linear[used] + 0.5 * ((inner**2).sum(1) - (x**2) @ (v**2).sum(1))
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]) * balance[rows] / len(rows)
            down = (x.T @ error + penalty / len(rows) * linear[used]) * telling[used]
            down_v = x.T @ (error[:, None] * inner) - v * ((x**2).T @ error)[:, None] + penalty / len(rows) * v
            squared[used] += down**2
            squared_factors[used] += (down_v**2).mean(1)
            linear[used] -= step * down / np.sqrt(squared[used])
            factors[used] -= factor_rate * step * down_v / np.sqrt(squared_factors[used])[:, None]
            bias -= step * float(error.sum())
    return FactorizationMachine(linear, factors, bias, GRAMS)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn=None, most_rows: int = 2000, most_bytes: int = 50_000) -> FactorizationMachine:
    """Train on at most ``most_rows`` labelled rows of each label (texts up to ``most_bytes``) that ``learn`` allows."""
    rows = labelled_sample(docs, labels, F.lit(True) if learn is None else learn, id_col=id_col, text_col=text_col, label_col=label_col, most_rows=most_rows, most_bytes=most_bytes)
    model = train([t for _, t, _ in rows], [y for _, _, y in rows])
    give_back()  # what training took; the driver goes on
    return model


def score(docs: DataFrame, model: FactorizationMachine, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of every row and ``score``, the probability of toxicity, from the whole text.

    A null or empty text gets the score of the bias alone.  Repeated rows and null
    ids pass through; columns not in ``keep`` are ignored.
    """
    chosen, at, schema = to_score(docs, keep, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x (width + 1) numbers

    def run(parts):
        m = shared.value
        table = WordTable(m.factors.shape[1] + 2, m.of_words, distinct=True)
        yield from score_batches(at, len(keep), lambda buf, off: m.link(*table.sums(LOWER[buf], off)))(parts)

    return chosen.mapInArrow(run, schema)
