"""Near-duplicate join on word shingles: a MinHash LSH forest with exact verification.

Each tree of the forest is a prefix trie over signatures of its own hash
functions.  The tries are one table of ``(tree, path, document)`` rows sorted by
tree and path, where a path is the document's whole signature in that tree, so a
trie's node is a run of rows with a common prefix.

Matching begins with whole signatures and goes up all trees at once: prefixes are
shortened, the runs of documents that have newly come together
are verified, and pairs that met further down are left alone.  Two texts of
Jaccard similarity s share a prefix of d values in one of t trees with probability
1 - (1 - s^d)^t.  The similarities of the links verified so far tell how low
similarities go in this table; prefixes are shortened, at once as far as
needed, until a link ``margin`` below the lowest one seen (not below the threshold)
is met with the target recall.  Where
everything is far above the threshold long prefixes do; a link near it shortens
them to the depth that serves the threshold itself, and no further.

Documents with the same words form a class and the least id stands for it.  A
trie node of any size is cut into blocks, and pairs of blocks are verified by
array operations; no pair is ever a row.  A pair that shares several nodes of a
level counts in the first tree only.  What leaves a pair of blocks is the number of
links of each member, their least similarity and a spanning forest of the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.components import components
from nearfield.llm.storage import materialize
from nearfield.llm.textops import U64, give_back, mix, odd_constants, shingle_sets, slices, span_hashes, word_spans

SHINGLE, THRESHOLD = 5, 0.8


def matched_depth(threshold: float, trees: int, full: int, recall: float) -> int:
    """Longest prefix, from ``full`` down, that meets pairs at the threshold with probability ``recall``."""
    depth = full
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _signatures(sets: list[np.ndarray], trees: int, depth: int) -> np.ndarray:
    """Paths of each set through all trees: ``trees * depth`` MinHash values of 32 bits; sets must not be empty."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.zeros((len(sets), trees * depth), ">u4")
    for i, factor in enumerate(odd_constants(trees * depth, 101)):
        h = flat * factor
        h ^= h >> U64(32)
        h *= factor
        out[:, i] = np.minimum.reduceat(h, at) >> U64(32)
    return out


def _sign(trees: int, depth: int, shingle: int) -> Callable:
    """Of each document: id, hash of the text, two hashes of its words, bytes, and its signature (null without words)."""
    schema = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bytes", pa.int64()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in slices(batch.column(2)):
                starts, ends, bounds = word_spans(buf, off)
                words = span_hashes(buf, starts, ends)
                whole = [_sequence_hash(words, bounds, seed).view(np.int64) for seed in (1, 2)]
                sets = shingle_sets(buf, off, shingle)
                some = np.flatnonzero(np.diff(bounds))
                sigs: list[bytes | None] = [None] * (b - a)
                if len(some):
                    for i, row in zip(some.tolist(), _signatures([sets[i] for i in some], trees, depth), strict=True):
                        sigs[i] = row.tobytes()
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *map(pa.array, whole), pa.array(np.diff(off)), pa.array(sigs, pa.binary())], schema=schema)
            give_back()

    return run


def _sequence_hash(words: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each document's sequence of words."""
    n = np.diff(bounds)
    place = np.arange(len(words), dtype=np.int64) - np.repeat(bounds[:-1], n)
    upto = np.zeros(len(words) + 1, U64)
    np.cumsum(mix(words + mix(place.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(seed))), out=upto[1:])
    return mix(upto[bounds[1:]] - upto[bounds[:-1]] + n.astype(U64) + U64(seed))


def _similarity(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of each pair; counts shared shingles by matrix products.  With ``left is right`` the diagonal is not of use."""
    a, b = np.concatenate(left), np.concatenate(right)
    row_a = np.repeat(np.arange(len(left)), [len(x) for x in left])
    row_b = np.repeat(np.arange(len(right)), [len(x) for x in right])
    both = np.intersect1d(a, b)
    if left is right:  # a shingle of one set alone joins no pair
        values, counts = np.unique(a, return_counts=True)
        both = values[counts > 1]
    shared = np.zeros((len(left), len(right)))
    place_a, place_b = np.searchsorted(both, a), np.searchsorted(both, b)
    for place, values in ((place_a, a), (place_b, b)):
        np.minimum(place, max(len(both) - 1, 0), out=place)
        if len(both):
            place[both[place] != values] = -1
        else:
            place[:] = -1
    order_a, order_b = np.argsort(place_a, kind="stable"), np.argsort(place_b, kind="stable")
    place_a, row_a = place_a[order_a], row_a[order_a]
    place_b, row_b = place_b[order_b], row_b[order_b]
    width = 4096
    for start in range(0, len(both), width):
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        for m, place, row in ((x, place_a, row_a), (y, place_b, row_b)):
            lo, hi = np.searchsorted(place, [start, start + width])
            m[row[lo:hi], place[lo:hi] - start] = 1
        shared += x @ y.T
    size_a, size_b = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    union = size_a[:, None] + size_b[None, :] - shared
    return shared / union


def _spanning(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Indices of links (a[i], b[i]) that form a spanning forest."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(i)
    return kept


def _prefixes(sigs: np.ndarray, depth: int) -> np.ndarray:
    """A key of each document's prefix of ``depth`` values in each tree; ``sigs`` has a row of (tree, value) a document."""
    key = np.zeros(sigs.shape[:2], U64)
    for d in range(depth):
        key = mix(key * U64(0x9E3779B97F4A7C15) + sigs[:, :, d].astype(U64) + U64(1))
    return key


def _verify(shingle: int, threshold: float, trees: int, full: int, level: int, before: int | None) -> Callable:
    """One pair of blocks: for each member its links to other classes, their documents, their least similarity, and edges of a spanning forest."""
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("linked_rows", pa.int64()), ("least", pa.float64()), ("edge", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        tree, one, two = (table.column(c)[0].as_py() for c in ("tree", "one", "two"))
        table = table.take(pa.array(np.argsort(np.array(table.column("id")), kind="stable")))
        side = np.array(table.column("side"))
        both = one == two  # with a block left empty, side 0 is there alone too
        left = np.flatnonzero(side == 0)
        right = left if both else np.flatnonzero(side == 1)
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), ">u4").reshape(-1, trees, full)
        new = np.ones((len(left), len(right)), bool)
        here = _prefixes(sigs, level)
        for t in range(tree):  # met in an earlier tree
            new &= here[left, t][:, None] != here[right, t][None, :]
        if before is not None:
            below = _prefixes(sigs, before)
            for t in range(trees):  # met by a longer prefix
                new &= below[left, t][:, None] != below[right, t][None, :]
        if both:
            np.fill_diagonal(new, False)
        rows, columns = new.any(1), new.any(0)
        if not rows.any():
            return schema.empty_table()
        left, right, new = left[rows], right[columns], new[np.ix_(rows, columns)]
        wanted = np.union1d(left, right)
        texts = table.column("text").combine_chunks().take(pa.array(wanted))
        sets = dict(zip(wanted.tolist(), (s for _, _, buf, off in slices(texts) for s in shingle_sets(buf, off, shingle)), strict=True))
        of_left = [sets[i] for i in left.tolist()]
        similar = _similarity(of_left, of_left if both else [sets[i] for i in right.tolist()])
        link = new & (similar >= threshold - 1e-9)
        x, y = np.nonzero(np.triu(link) if both else link)
        value = similar[x, y]
        x, y = left[x], right[y]
        ids, weight = np.array(table.column("id")), np.array(table.column("copies"))
        n = len(ids)
        links = np.bincount(x, minlength=n) + np.bincount(y, minlength=n)
        linked = np.bincount(x, weight[y], n) + np.bincount(y, weight[x], n)
        least = np.ones(n)
        np.minimum.at(least, x, value)
        np.minimum.at(least, y, value)
        kept = _spanning(x, y)
        del similar, link, new, sets, of_left
        give_back()
        some = np.flatnonzero(links)
        none = np.zeros(len(kept), np.int64)
        return pa.table(
            [
                pa.array(np.concatenate([ids[some], ids[x[kept]]])),
                pa.array(np.concatenate([links[some], none])),
                pa.array(np.concatenate([linked[some].astype(np.int64), none])),
                pa.array(np.concatenate([least[some], np.ones(len(kept))])),
                pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[y[kept]], pa.int64())]),
            ],
            schema=schema,
        )

    return run


def _one_row_an_id(raw: DataFrame) -> DataFrame:
    """Of rows with one id that of the least hash of words; looks for repeated ids before it moves signatures."""
    repeated = raw.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    if repeated.isEmpty():
        return raw
    picked = raw.join(repeated, "id").groupBy("id").agg(F.min(F.struct("h1", "h2", "mark", "bytes", "sig")).alias("row")).select("id", "row.*")
    return raw.join(repeated, "id", "left_anti").unionByName(picked)


def _level(tries: DataFrame, texts: DataFrame, level: int, before: int | None, block: int, block_bytes: int, verify: Callable) -> DataFrame:
    """Links between documents that share ``level`` values in a tree and nowhere the ``before`` that were matched last."""
    at = tries.withColumn("prefix", F.expr(f"substring(path, 1, {4 * level})"))
    child = F.xxhash64(F.expr(f"substring(path, {4 * level + 1}, {4 * ((before or level) - level)})"))
    who = [F.bit_xor(F.xxhash64("id", F.lit(i))) for i in (0, 1)]
    nodes = at.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("node_bytes"), who[0].alias("who"), who[1].alias("also"), F.min(child).alias("low"), F.max(child).alias("high")).where("n > 1")
    if before is not None:  # a node with one child brings nobody together
        nodes = nodes.where("low <> high")
    # nodes with the same members in several trees are looked at once
    nodes = nodes.groupBy("n", "node_bytes", "who", "also").agg(F.min(F.struct("tree", "prefix")).alias("at")).select("n", "node_bytes", "at.tree", "at.prefix")
    cut = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("node_bytes") / block_bytes)).cast("int")
    members = at.join(nodes, ["tree", "prefix"]).select("tree", "prefix", "id", cut.alias("blocks"))
    members = members.withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    members = members.select("tree", "prefix", "id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    members = members.select("tree", "prefix", "id", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    filled = members.join(texts, "id").select("tree", "prefix", "one", "two", "side", "id", "copies", "sig", "text")
    return materialize(filled.groupBy("tree", "prefix", "one", "two").applyInArrow(verify, "id long, links long, linked_rows long, least double, edge long"), "forest-links")


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, trees: int = 14, full_depth: int = 6, recall: float = 0.999, margin: float = 0.05, block: int = 512, block_bytes: int = 8 << 20) -> DataFrame:
    """``(doc_id, copy_of, class_id, n_links, n_copies)`` of every distinct id.

    copy_of: the least id with the same words; class_id: the least id of all
    documents connected by links or copies; n_links: documents of other words whose
    shingle sets have Jaccard similarity ``threshold`` or more; n_copies: documents
    with the same words, itself included.

    Words are runs of characters other than U+0020 and U+0009..U+000D; a shingle is
    ``shingle`` of them in a row, and a shorter text is one shingle.  Documents
    without words (null, empty or blank) are linked with nothing and each is its
    own class.  Rows with a null id are left out.  Of several rows with one id the
    one with the least hash of its words counts.  Other columns are ignored.  An empty table gives no rows.
    """
    floor = matched_depth(threshold, trees, full_depth, recall)
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text")).where("id is not null")
    raw = materialize(base.mapInArrow(_sign(trees, full_depth, shingle), "id long, mark long, h1 long, h2 long, bytes long, sig binary"), "forest-signed")
    signed = _one_row_an_id(raw)
    classes = signed.where("sig is not null").groupBy("h1", "h2").agg(F.min(F.struct("id", "mark", "bytes", "sig")).alias("row"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.select("h1", "h2", "row.*", "copies"), "forest-classes")
    # who is alone at the least depth that any table needs meets nobody; the rest is sorted into tries
    paths = classes.select("id", "bytes", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "sig")
    paths = paths.select("tree", F.expr(f"substring(sig, tree * {4 * full_depth} + 1, {4 * full_depth})").alias("path"), "id", "bytes")
    paths = paths.withColumn("node", F.xxhash64("tree", F.expr(f"substring(path, 1, {4 * floor})")))
    crowded = paths.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    tries = paths.join(crowded, "node").select("tree", "path", "id", "bytes")
    tries = materialize(tries.repartitionByRange("tree", "path", "id").sortWithinPartitions("tree", "path"), "forest-tries")
    wanted = tries.select("id").distinct().join(classes, "id").select("id", F.col("mark").alias("own"), "copies", "sig")
    texts = base.join(wanted, "id").where("mark = own").dropDuplicates(["id"]).select("id", "copies", "sig", "text")
    texts = materialize(texts, "forest-texts")  # once for all levels
    levels: list[DataFrame] = []
    lowest = 1.0
    level, before = max(full_depth, floor), None
    while True:
        levels.append(_level(tries, texts, level, before, block, block_bytes, _verify(shingle, threshold, trees, full_depth, level, before)))
        seen = levels[-1].where("edge is null").agg(F.min("least")).first()[0]
        lowest = lowest if seen is None else min(lowest, seen)
        expected = max(threshold, lowest - margin) if lowest < 1 else threshold
        needed = matched_depth(expected, trees, level, recall)
        if needed == level:
            break
        level, before = needed, level
    found = levels[0]
    for more in levels[1:]:
        found = found.unionByName(more)
    links = found.where("edge is null").groupBy("id").agg(F.sum("linked_rows").alias("n_links"))
    grouped = components(found.where("edge is not null").select(F.col("id").alias("a"), F.col("edge").alias("b")))
    known = classes.join(links, "id", "left").join(grouped, classes["id"] == grouped["node"], "left")
    known = known.select("h1", "h2", F.col("id").alias("copy_of"), F.coalesce("component", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("copies").alias("n_copies"))
    worded = signed.where("sig is not null").select("id", "h1", "h2").join(known, ["h1", "h2"]).select("id", "copy_of", "class_id", "n_links", "n_copies")
    empty = signed.where("sig is null").select("id", F.col("id").alias("copy_of"), F.col("id").alias("class_id"), F.lit(0).alias("n_links"), F.lit(1).alias("n_copies"))
    return worded.unionByName(empty).withColumnRenamed("id", "doc_id")
