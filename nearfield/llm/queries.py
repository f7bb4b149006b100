"""Queries over the shared tables, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import mixing, ngram_join, packing, quality, substring, telephony, toxicity, url_lists, voronoi, warc
from nearfield.llm.storage import fresh_dir
from nearfield.llm.subwords import crc_of


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.deduplicate(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS words FROM (SELECT doc_id, w, unnest(range(len(w) - 12)) AS i FROM w)
), hits AS (
    SELECT doc_id, i FROM windows JOIN (SELECT words, min(doc_id) AS first FROM windows GROUP BY words) USING (words) WHERE doc_id > first
), gone AS (
    SELECT doc_id, list(DISTINCT place) AS places FROM (SELECT doc_id, i + unnest(range(13)) AS place FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(CASE WHEN places IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(places, i - 1)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""

# Classes of equal words, then all pairs of them that share a shingle.
OP2_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), classes AS (
    SELECT w, min(doc_id) AS copy_of, count(*) AS n_copies FROM w WHERE len(w) > 0 GROUP BY w
), sets AS (
    SELECT copy_of, n_copies, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS s FROM classes
), shingles AS (
    SELECT copy_of, n_copies, len(s) AS size, unnest(s) AS shingle FROM sets
), pairs AS (
    SELECT a.copy_of AS a, b.copy_of AS b, any_value(b.n_copies) AS copies, count(*) AS shared, any_value(a.size) + any_value(b.size) AS sizes
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.copy_of <> b.copy_of GROUP BY ALL
), links AS (
    SELECT a, b, copies FROM pairs WHERE 10 * shared >= 8 * (sizes - shared)
), reach AS (
    SELECT copy_of AS a, copy_of AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), found AS (
    SELECT copy_of, class_id, coalesce(n_links, 0) AS n_links FROM (SELECT a AS copy_of, min(b) AS class_id FROM reach GROUP BY a)
    LEFT JOIN (SELECT a AS copy_of, sum(copies) AS n_links FROM links GROUP BY a) USING (copy_of)
)
SELECT doc_id, coalesce(c.copy_of, doc_id) AS copy_of, coalesce(class_id, doc_id) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(n_copies, 1) AS n_copies
FROM w LEFT JOIN classes c ON c.w = w.w LEFT JOIN found f ON f.copy_of = c.copy_of
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_of(F.col("doc_id")) % 3 == 1, F.lit(False))
    model = quality.fit(docs, read(spark, sf_dir, "labels"), learn=~held_out)
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP6_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_of(F.col("doc_id")) % 5 == 0, F.lit(False))
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), learn=~held_out)
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = telephony.store_texts(read(spark, sf_dir, "documents"))
    return stored.drop("rate")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder)


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list about the hosts of ``pages``, by fixed rules; moments are numbers of days."""
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("h")).where("h is not null").distinct().withColumn("n", F.length("h"))
    return hosts.select("h", F.inline(F.expr("""
        array(
            named_struct('kind', 'host', 'pattern', h, 'list_name', 'spam', 'at', n * 37 % 200, 'action', 'add', 'when', n % 3 = 0),
            named_struct('kind', 'host', 'pattern', h, 'list_name', 'spam', 'at', n * 37 % 200 + 60, 'action', 'remove', 'when', n % 3 = 0),
            named_struct('kind', 'host', 'pattern', h, 'list_name', 'spam', 'at', n * 37 % 200 + 100, 'action', 'add', 'when', n % 6 = 0),
            named_struct('kind', 'domain', 'pattern', substring(h, locate('.', h) + 1), 'list_name', 'malware', 'at', 100 + n, 'action', 'add', 'when', n % 4 = 1),
            named_struct('kind', 'domain', 'pattern', substring(h, locate('.', h) + 1), 'list_name', 'malware', 'at', 200 + n, 'action', 'remove', 'when', n % 4 = 1),
            named_struct('kind', 'prefix', 'pattern', concat(h, '/de/'), 'list_name', 'adult', 'at', n * 13 % 300, 'action', 'add', 'when', true)
        )"""))).where("when").drop("h", "when")


def op10_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    captures = pages.withColumn("day", (F.col("page_id") * 7919 % 365).cast("int"))
    judged = url_lists.judge(captures, list_entries(pages), id_col="page_id", url_col="url", at_col="day")
    return judged.select(F.col("id").alias("page_id"), F.col("fetched_at").alias("day"), "n_matches", "matched_key", "matched_list", F.col("listed_since").cast("int").alias("listed_since"), "blocked")


OP10_SQL = """
WITH captures AS (
    SELECT page_id, CAST(page_id * 7919 % 365 AS INTEGER) AS day,
        rtrim(lower(CASE WHEN starts_with(net, '[') THEN split_part(net, ']', 1) || ']' ELSE split_part(net, ':', 1) END), '.') AS h,
        split_part(split_part(substr(rest, length(authority) + 1), '?', 1), '#', 1) AS p
    FROM (SELECT *, list_extract(string_split(authority, '@'), -1) AS net
        FROM (SELECT page_id, substr(url, strpos(url, '://') + 3) AS rest,
                split_part(split_part(split_part(substr(url, strpos(url, '://') + 3), '/', 1), '?', 1), '#', 1) AS authority
            FROM pages WHERE strpos(url, '://') > 1)
        UNION ALL BY NAME SELECT page_id FROM pages WHERE url IS NULL OR strpos(url, '://') <= 1)
), hosts AS (
    SELECT DISTINCT h, length(h) AS n, substr(h, strpos(h, '.') + 1) AS up FROM captures WHERE h <> ''
), log AS (
    SELECT 'host' AS kind, h AS pattern, 'spam' AS list_name, n * 37 % 200 AS moment, 1 AS turn FROM hosts WHERE n % 3 = 0
    UNION SELECT 'host', h, 'spam', n * 37 % 200 + 60, 0 FROM hosts WHERE n % 3 = 0
    UNION SELECT 'host', h, 'spam', n * 37 % 200 + 100, 1 FROM hosts WHERE n % 6 = 0
    UNION SELECT 'domain', up, 'malware', 100 + n, 1 FROM hosts WHERE n % 4 = 1
    UNION SELECT 'domain', up, 'malware', 200 + n, 0 FROM hosts WHERE n % 4 = 1
    UNION SELECT 'prefix', h || '/de/', 'adult', n * 13 % 300, 1 FROM hosts
), moments AS (
    SELECT kind, pattern, list_name, moment, max(turn) AS turn FROM log GROUP BY ALL
), latest AS (
    SELECT c.page_id, m.kind, m.pattern, m.list_name, arg_max(m.turn, m.moment) AS turn
    FROM captures c JOIN moments m ON m.moment <= c.day AND (
        (m.kind = 'host' AND c.h = m.pattern)
        OR (m.kind = 'domain' AND (c.h = m.pattern OR ends_with(c.h, '.' || m.pattern)))
        OR (m.kind = 'prefix' AND starts_with(c.h || c.p, m.pattern)))
    GROUP BY ALL
), active AS (
    SELECT l.page_id, left(l.kind, 1) || ':' || l.pattern AS matched_key, l.list_name,
        (SELECT max(a.moment) FROM moments a JOIN captures c ON c.page_id = l.page_id
         WHERE a.kind = l.kind AND a.pattern = l.pattern AND a.list_name = l.list_name AND a.turn = 1 AND a.moment <= c.day
           AND coalesce((SELECT b.turn FROM moments b WHERE b.kind = a.kind AND b.pattern = a.pattern AND b.list_name = a.list_name AND b.moment < a.moment ORDER BY b.moment DESC LIMIT 1), 0) = 0) AS since
    FROM latest l WHERE l.turn = 1
), best AS (
    SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY -length(matched_key), matched_key, list_name) AS r,
        count(*) OVER (PARTITION BY page_id) AS n FROM active
)
SELECT c.page_id, c.day, coalesce(b.n, 0) AS n_matches, b.matched_key, b.list_name AS matched_list,
    CAST(b.since AS INTEGER) AS listed_since, b.page_id IS NOT NULL AS blocked
FROM captures c LEFT JOIN best b ON b.page_id = c.page_id AND b.r = 1
"""


OP9_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body FROM pages
), q AS (
    SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS n, sha1(body) AS d, max(page_id) OVER (PARTITION BY body) AS top FROM p
)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
    CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM q
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_packing": op1_packing, "op2_ngram_join": op2_ngram_join, "op3_substring": op3_substring, "op4_mixing": op4_mixing, "op5_quality": op5_quality, "op6_voronoi": op6_voronoi, "op7_toxicity": op7_toxicity, "op8_telephony": op8_telephony, "op9_warc": op9_warc, "op10_url_lists": op10_url_lists}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": OP2_SQL, "op3_substring": OP3_SQL, "op6_voronoi": OP6_SQL, "op9_warc": OP9_SQL, "op10_url_lists": OP10_SQL}
