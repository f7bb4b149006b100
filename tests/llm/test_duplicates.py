import hashlib
import random

import numpy as np
import pytest

from nearfield.llm import ngram_join, substring
from nearfield.llm.components import components

SCHEMA = "doc_id long, text string"


def words(text):
    return (text or "").encode().split()


def brute_join(rows, threshold=0.8):
    classes = {}
    for i, t in rows.items():
        if words(t):
            classes.setdefault(tuple(words(t)), []).append(i)
    sets = {min(ids): frozenset(w[a : a + 5] for a in range(len(w) - 4)) if len(w) >= 5 else frozenset([w]) for w, ids in classes.items()}
    size = {min(ids): len(ids) for ids in classes.values()}
    parent = {i: i for i in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(rows, 0)
    reps = sorted(sets)
    for n, a in enumerate(reps):
        for b in reps[:n]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += size[b]
                links[b] += size[a]
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    out = {}
    for i, t in rows.items():
        r = min(classes[tuple(words(t))]) if words(t) else i
        out[i] = (r, find(r), links[r], size.get(r, 1))
    return out


def brute_cut(rows, length=13):
    first = {}
    for i in sorted(rows):
        w = words(rows[i])
        for a in range(len(w) - length + 1):
            first.setdefault(tuple(w[a : a + length]), i)
    out = {}
    for i, t in rows.items():
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - length + 1):
            if first[tuple(w[a : a + length])] < i:
                gone[a : a + length] = [True] * length
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["été", "x y", "A.", "a."]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    base = [rng.choice(vocabulary) for _ in range(90)]
    rows = {}
    for i in range(n):
        kind = rng.random()
        if kind < 0.3:
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind < 0.5:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))] + passage[rng.randint(0, 20) :] + [rng.choice(vocabulary) for _ in range(9)]
        elif kind < 0.6:
            w = ["same"] * rng.randint(1, 40)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 100))]
        rows[rng.randrange(10**6)] = rng.choice([" ", "\n", " \t"]).join(w)
    return rows | {10**7: None, 10**7 + 1: "", 10**7 + 2: " \n", 10**7 + 3: "one two", 10**7 + 4: "one  two"}


@pytest.mark.parametrize("options", [{}, {"block": 8}])
def test_join_equals_brute_force(spark, options):
    rows = corpus(1)
    docs = spark.createDataFrame(list(rows.items()), SCHEMA).selectExpr("*", "1 as keys", "2 as id", "'x' as mark")
    got = {r.doc_id: (r.copy_of, r.class_id, r.n_links, r.n_copies) for r in ngram_join.join(docs, **options).collect()}
    assert got == brute_join(rows)


def test_join_of_nothing_repeated_rows_and_long_texts(spark):
    assert ngram_join.join(spark.createDataFrame([], SCHEMA)).count() == 0
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (2, long + " end"), (None, long), (3, "a b c d e f g"), (4, None)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}


def test_target_recall_sets_the_depth():
    depth = ngram_join.matched_depth(0.8, 14, 8, 0.999)
    assert 1 - (1 - 0.8**depth) ** 14 >= 0.999 > 1 - (1 - 0.8 ** (depth + 1)) ** 14


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 150), rng.randrange(100, 150)) for _ in range(25)] + [(7, 7), (None, 3), (200, 200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 4000}, {"chunk_bytes": 1500, "frequent": 1}])
def test_substrings_equal_brute_force(spark, options):
    rows = corpus(4)
    docs = spark.createDataFrame(list(rows.items()), SCHEMA).selectExpr("*", "1 as chunk", "2 as data", "'x' as `row id`")
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring.deduplicate(docs, **options).collect()}
    assert got == brute_cut(rows)


def test_substrings_of_nothing_ties_and_long_texts(spark):
    assert substring.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0
    long = " ".join(f"t{i % 9001}" for i in range(50_000))
    rows = [(5, long), (5, long), (9, "start " + long[:600] + "\nend"), (None, long), (7, "k  eep\nme")]
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_removed) for r in substring.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect())
    n = len(("start " + long[:600]).split()) + 1
    assert got[0][1:] == got[1][1:] == (50_000, 0) and got[-1][1:] == (50_000, 50_000)
    assert got[3][1] == n and 0 < got[3][2] <= n - 2
    kept = substring.deduplicate(spark.createDataFrame(rows, SCHEMA), as_they_are=True).where("doc_id = 7").first().kept_text
    assert kept == "k  eep\nme"


def test_similar_blocks():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30))).astype(np.uint64) for _ in range(25)]
    want = [[len(set(a) & set(b)) >= 0.5 * len(set(a) | set(b)) for b in sets] for a in sets]
    assert (ngram_join._similarity(sets, list(sets)) >= 0.5).tolist() == want
    inner = ngram_join._similarity(sets, sets) >= 0.5
    np.fill_diagonal(inner, True)
    assert inner.tolist() == want


@pytest.mark.parametrize("block_bytes", [1, 100, 700])
def test_links_of_blocks_that_stay_empty(spark, block_bytes):
    base = [f"w{i}" for i in range(60)]
    rows = {10 * g + i: " ".join([f"g{g}", *base[g:], *(["end"] * i)]) for g in range(0, 60, 15) for i in range(3)}
    got = {r.doc_id: (r.copy_of, r.class_id, r.n_links, r.n_copies) for r in ngram_join.join(spark.createDataFrame(list(rows.items()), SCHEMA), block_bytes=block_bytes).collect()}
    assert got == brute_join(rows)


def links_of(spark, pairs, **options):
    rows = [(2 * i + j, " ".join(t)) for i, pair in enumerate(pairs) for j, t in enumerate(pair)]
    got = {r.doc_id: r.class_id for r in ngram_join.join(spark.createDataFrame(rows, SCHEMA), **options).collect()}
    return [got[2 * i + 1] == 2 * i for i in range(len(pairs))]


def pair_of(rng, n, changed):
    """Two texts of n shingles each, the last ``changed`` of them not shared."""
    w = [f"v{rng.randrange(10**6)}" for _ in range(n + 4)]
    return w, w[: n + 4 - changed] + [f"z{rng.randrange(10**6)}" for _ in range(changed)]


def test_recall_of_pairs_just_above_the_threshold(spark):
    rng = random.Random(6)
    # (n - c) / (n + c) from 0.80 to 0.85
    pairs = [pair_of(rng, n, c) for n in range(60, 260) for c in [-(-n * 4 // 45)]]
    assert all(0.8 <= (n - c) / (n + c) <= 0.85 for n in range(60, 260) for c in [-(-n * 4 // 45)])
    got = links_of(spark, pairs)
    assert sum(got) >= 0.99 * len(got)


@pytest.mark.parametrize(("changed", "levels"), [(1, [(6, None)]), (3, [(6, None), (5, 6)]), (5, [(6, None), (4, 6)])])
def test_prefixes_shorten_as_far_as_links_need(spark, monkeypatch, changed, levels):
    rng = random.Random(7)
    seen = []
    verify = ngram_join._verify
    monkeypatch.setattr(ngram_join, "_verify", lambda *a: seen.append(a[-2:]) or verify(*a))
    assert all(links_of(spark, [pair_of(rng, 50, changed) for _ in range(30)]))
    assert seen == levels


def test_components_of_busy_nodes(spark, monkeypatch):
    from nearfield.llm import components as module

    monkeypatch.setattr(module, "BUSY", 3)
    edges = [(1, i) for i in range(2, 40)] + [(i, 100 + i) for i in range(2, 40)] + [(500, 501)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 500 if n >= 500 else 1 for e in edges for n in e}


@pytest.mark.parametrize("collide", [False, True])
def test_repeated_windows_are_nodes_of_the_tree(monkeypatch, collide):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(3, 40))).encode() for _ in range(12)]
    text = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts, ends, _ = substring.word_spans(text, np.array([0, len(text)]))
    hashes = substring.span_hashes(text, starts, ends)
    number = substring.word_numbers(text, starts, ends, hashes * np.uint64(0) if collide else hashes)
    bounds = np.cumsum([0] + [len(t.split()) for t in texts])
    length, suffixes, seen = 6, [], {}
    for doc, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        for s in range(a, b - length + 1):
            seen.setdefault(tuple(text[starts[s + j]] for j in range(length)), doc)
        for s in range(a, b - length + 1, 3):  # anchors two words into every third window; up to three windows each
            suffixes.append((doc, s + 2, 2, min(3, b - length + 1 - s)))
    doc, anchor, offset, windows = np.array(suffixes).T
    got = set()
    for o, hit in substring.repeated_windows(doc, anchor, offset, windows, number, length):
        got |= {int(anchor[i] - o) for i in hit}
    for i, (d, a, l, n) in enumerate(suffixes):
        for s in range(a - l, a - l + n):
            # only windows at the same offset from an anchor meet here
            same = [e for e, b, m, k in suffixes for r in range(b - m, b - m + k) if a - s == b - r and all(text[starts[s + j]] == text[starts[r + j]] for j in range(length))]
            assert (s in got) == (min(same) < d), (s, d)


def test_removed_spans_are_maximal_repeats(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, "a " + passage), (2, "b c " + passage + " d"), (3, passage + " e " + passage)]
    cut = substring.deduplicate(spark.createDataFrame(rows, SCHEMA))
    assert {r.doc_id: [tuple(s) for s in r.removed_spans] for r in cut.collect()} == {1: [], 2: [(2, 30)], 3: [(0, 30), (31, 30)]}
