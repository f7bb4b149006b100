import random

import pytest
from pyspark.sql import functions as F

from nearfield.llm import mixing, quality, toxicity
from nearfield.llm.subwords import labelled_sample

SCHEMA = "doc_id long, text string, source string"


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        target = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if target[s] >= most * sizes[s]]
        if not over:
            return capped | target
        capped |= {s: most * sizes[s] for s in over}
        if len(capped) == len(order):
            return capped


def test_targets_and_taken_words(spark):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        source = rng.choice(["a", "b", "b", "b", "Z", "é", "", None])
        rows.append((i, " ".join("w" * rng.choice([0, 1]) or "v" for _ in range(int(rng.lognormvariate(3, 1)))), source))
    rows += [(1000, None, "a"), (1001, "", "none"), (1002, "x y", "tiny")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as size", "2 as copies", "3 as n", "4 as target")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size_of = {i: len((t or "").split()) for i, t, _ in rows}
    source_of = {i: s for i, _, s in rows}
    sizes = {}
    for i, s in source_of.items():
        sizes[s] = sizes.get(s, 0) + size_of[i]
    targets = brute_targets(sizes)
    taken = {}
    for r in got:
        s = source_of[r.doc_id]
        assert r.size == size_of[r.doc_id] and r.source_size == sizes[s] and r.taken <= 2 * r.size
        assert r.target == pytest.approx(targets[s])
        assert r.copies * r.size == r.taken
        taken[s] = taken.get(s, 0) + r.taken
    for s, want in targets.items():
        assert abs(taken[s] - want) <= max(2, 0.01 * want), (s, taken[s], want)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rates_are_an_exponential_tilt(spark):
    rows = [(i, "w " * (1 + i % 40), "a") for i in range(400)] + [(1000 + i, "w " * 30, "b") for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).where("target < 1.999 * source_size").select("size", "source_size", "rate", "target").distinct().collect()
    import math

    tilts = {}
    for r in got:
        if 0.01 < r.rate < 1.99:
            tilts.setdefault(r.source_size, set()).add(round(math.log(r.rate / (2 - r.rate)) / r.size, 4))
    assert tilts and all(max(t) - min(t) < 1e-3 for t in tilts.values())


def test_mix_of_nothing_and_one_large_class(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(i % 2500, "a b c", "s") for i in range(5000)] + [(i, "q", "t") for i in range(9000, 9400)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == 5400 and got.where("taken > 2 * size").isEmpty()
    for r in got.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 3


def labelled(seed, n=500):
    rng = random.Random(seed)
    good = [f"w{rng.randrange(10**6)}" for _ in range(800)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(good) for _ in range(rng.randint(5, 80))]
        toxic, bad = rng.random() < 0.3, rng.random() < 0.3
        for _ in range(max(1, len(w) // 15) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(["idiot", "Idiots.", "scum"]) + rng.choice(["", "x", ","])
        if bad:
            w = [x + "%%%" for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


@pytest.mark.parametrize("module, column", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy_and_odd_rows(spark, module, column):
    docs, labels = labelled(8)
    long = "word " * 60_000
    odd = [(9000, None), (9001, ""), (9002, " "), (None, "x"), (3, docs[3][1]), (9003, long)]
    table = spark.createDataFrame(docs + odd, "doc_id long, text string").selectExpr("*", "1 as score", "2 as sample_id")
    known = spark.createDataFrame(labels + [(5000, None, None), (None, 1, 1), (7, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    model = module.fit(table, known, learn=F.col("doc_id") % 3 != 1, label_col=column, most_rows=150)
    got = module.score(table, model, keep=["doc_id"]).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in got)
    truth = {i: (q if column == "quality" else t) for i, q, t in labels}
    held = [r for r in got if r.doc_id in truth and r.doc_id % 3 == 1]
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in held) / len(held) >= 0.95
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[3]) == 1 and by[9000] == by[9001] == by[9002]
    again = module.fit(table.repartition(5), known, learn=F.col("doc_id") % 3 != 1, label_col=column, most_rows=150)
    assert {r.score for r in module.score(table, again, keep=["doc_id"]).collect()} == {r.score for r in got}


@pytest.mark.parametrize("module", [quality, toxicity])
def test_nothing_to_learn_from(spark, module):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = module.score(docs, module.fit(docs, none), keep=["doc_id"]).collect()
    assert [r.score for r in got] == [0.5, 0.5]
    assert module.score(docs.limit(0), module.fit(docs, none), keep=["doc_id"]).count() == 0


def test_samples_are_bounded(spark):
    docs, labels = labelled(1, 100)
    rows = labelled_sample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True), id_col="doc_id", text_col="text", label_col="toxic", most_rows=5, most_bytes=10_000)
    assert len(rows) == 10 and sum(y for _, _, y in rows) == 5


def test_pairs_of_terms_count_beyond_their_sum():
    rng = random.Random(0)
    filler = [f"f{i}" for i in range(30)]
    texts, y = [], []
    for _ in range(600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(rng.sample(filler, 4) + ["insult"] * a + ["groupname"] * b))
        y.append(int(a != b))  # no additive weights separate this
    model = toxicity.train(texts[:450], y[:450], epochs=30, buckets=1 << 12)
    import numpy as np
    import pyarrow as pa

    from nearfield.llm.subwords import WordTable
    from nearfield.llm.textops import buffers

    scores = model.link(*WordTable(model.factors.shape[1] + 2, model.of_words, distinct=True).sums(*buffers(pa.array(texts[450:]))))
    assert np.mean((scores >= 0.5) == np.array(y[450:])) >= 0.9


def plain_words(text, lower, distinct):
    words = text.encode().split()
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words] if lower else words
    return list(dict.fromkeys(words)) if distinct else words


def buckets_of(word, grams, buckets):
    import numpy as np

    from nearfield.llm.subwords import word_features

    flat, _ = word_features(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]), grams, buckets)
    return flat.tolist()


TEXTS = ["an idiot and a clown, an IDIOT", "", "one", "été été word Word", "w1 w2 w3 w4 w1 w2 w3 w4 w4", "\t long-word-with-many-grams \n x"]


def test_toxicity_scores_equal_a_plain_forward_pass(spark):
    import math

    docs, labels = labelled(4, 200)
    model = toxicity.train([t for _, t in docs], [y for _, _, y in labels], buckets=1 << 12, epochs=3)
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), model, keep=["doc_id"]).collect()}
    for i, text in enumerate(TEXTS):
        terms = []
        words = plain_words(text, True, True)
        for w in words:
            own = buckets_of(w, model.grams, len(model.linear))
            terms += [(b, 1 / len(own) / math.sqrt(len(words))) for b in own]
        logit = model.bias + sum(float(model.linear[b]) * x for b, x in terms)
        for a in range(len(terms)):
            for b in range(a):
                logit += sum(float(p) * float(q) for p, q in zip(model.factors[terms[a][0]], model.factors[terms[b][0]])) * terms[a][1] * terms[b][1]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, logit)))), abs=1e-4)


def test_quality_scores_equal_a_plain_forward_pass(spark):
    import math

    docs, labels = labelled(4, 200)
    model = quality.train([t for _, t in docs], [q for _, q, _ in labels], buckets=1 << 12, epochs=3)
    n = len(model.weights)
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), model, keep=["doc_id"]).collect()}
    import numpy as np

    from nearfield.llm.textops import gram_hashes, span_hashes

    for i, text in enumerate(TEXTS):
        words = plain_words(text, False, False)
        total = 0.0
        for w in words:
            own = buckets_of(w, model.grams, n)
            total += sum(float(model.weights[b]) for b in own) / len(own)
        keys = [int(span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words]
        seen = set()
        for a in range(len(words)):
            if a:
                total += float(model.weights[int(gram_hashes(np.array(keys[a - 1 : a + 1], np.uint64), 2, 5)[0]) % n])
                total += float(model.weights[n - 1]) if words[a] == words[a - 1] else 0.0
            four = tuple(words[a : a + 4])
            if len(four) == 4:
                total += float(model.weights[n - 2]) if four in seen else 0.0
                seen.add(four)
        logit = total / max(len(words), 1) + model.bias
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, logit)))), abs=1e-4)


def test_a_repeated_id_brings_one_text(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, None), (3, "x" * 100), (4, "fine")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 5)], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, F.lit(True), id_col="doc_id", text_col="text", label_col="toxic", most_rows=2, most_bytes=50)
    assert sorted(i for i, _, _ in rows) == [1, 4]
