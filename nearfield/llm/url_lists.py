"""URL filters against dated lists.

A list is a log of dated entries that add or remove a pattern: a whole host, a
domain with all below it, or a host with a path prefix.  Entries become validity
intervals, and every capture is judged by the entries in force when it was
fetched.

Intervals of one pattern are folded into one row with a sorted array of changes,
so a capture meets at most one row for each of its keys (hosts above it and path
prefixes) and an as-of look-up in that array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.storage import materialize

ADD, REMOVE = "add", "remove"


_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or final dot, an IPv6 address in its brackets; null if the text isn't an absolute URL with a host."""
    host = F.lower(F.regexp_extract(url, _AUTHORITY + r"(\[[^\]/?#@]+\]|[^/?#:@\[\]]+)", 1))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path with its leading slash, without query and fragment."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def keys_of(url: Column) -> Column:
    """All keys that a listed pattern could have to cover ``url``: ``h:`` its host, ``d:`` the host and each domain above, ``p:`` each path prefix at a slash and the whole path."""
    host, path = host_of(url), path_of(url)
    labels = F.when(host.startswith("["), F.array(host)).otherwise(F.split(host, r"\."))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("p:"), host, F.array_join(F.slice(parts, 1, i), "/"), F.when(i < F.size(parts), F.lit("/")).otherwise(F.lit(""))))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(F.array(F.concat(F.lit("h:"), host)), domains, prefixes)))


def pattern_key(kind: Column, pattern: Column) -> Column:
    """Key of a listed pattern; kinds are ``host``, ``domain`` and ``prefix`` (host and path).

    Hosts are lower-cased, a final dot and a domain's leading one dropped; a
    prefix without a slash is a whole host.
    """
    clean = lambda host: F.regexp_replace(F.lower(host), r"\.+$", "")
    prefix = F.concat(F.lit("p:"), clean(F.regexp_extract(pattern, "^[^/]*", 0)), F.when(pattern.contains("/"), F.regexp_extract(pattern, "(?s)/.*", 0)).otherwise(F.lit("/")))
    return F.when(kind == "host", F.concat(F.lit("h:"), clean(pattern))).when(kind == "domain", F.concat(F.lit("d:"), F.regexp_replace(clean(pattern), r"^\.", ""))).when(kind == "prefix", prefix)


def intervals(entries: DataFrame) -> DataFrame:
    """``(key, list_name, valid_from, valid_to)`` of ``entries(kind, pattern, list_name, at, action)``.

    A pattern is in force from an ``add`` until the next ``remove`` (null: still).
    Entries of one moment count as one, and ``add`` wins; repeated entries change
    nothing.  Entries with a null or unknown kind, pattern, moment or action take
    no part; a null list is a list of its own.
    """
    log = entries.select(pattern_key(F.col("kind"), F.col("pattern")).alias("key"), "list_name", "at", (F.col("action") == ADD).cast("int").alias("on"))
    log = log.where(F.col("key").isNotNull() & F.col("at").isNotNull() & entries["action"].isin(ADD, REMOVE))
    log = log.groupBy("key", "list_name", "at").agg(F.max("on").alias("on"))
    own = Window.partitionBy("key", "list_name").orderBy("at")
    changes = log.withColumn("before", F.coalesce(F.lag("on").over(own), F.lit(0))).where(F.col("on") != F.col("before"))
    return changes.withColumn("valid_to", F.lead("at").over(own)).where(F.col("on") == 1).select("key", "list_name", F.col("at").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, *, id_col: str, url_col: str, at_col: str, most_broadcast: int = 32 << 20) -> DataFrame:
    """``(id, url, fetched_at, n_matches, matched_key, matched_list, listed_since, blocked)`` for every row of ``captures``.

    An entry is in force from its moment on, up to but not at its end.  n_matches
    counts the (pattern, list) pairs in force that cover the URL; the match shown
    is the one with the longest key, then the least key and list.  A null or
    malformed URL or a null moment matches nothing.  Repeated rows stay repeated.
    Other columns are ignored, whatever their names; empty tables work.

    Lists whose folded intervals, counted first, are within ``most_broadcast`` bytes go to
    all tasks, so that only keys that are listed are shuffled; longer ones meet
    the keys of the distinct captures in a join.  All intervals of one pattern are in one row.
    """
    spans = intervals(entries).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("valid_from", "valid_to", "list_name"))).alias("spans"))
    spans = materialize(spans, "url-spans")
    weight = spans.agg(F.sum(F.octet_length("key") + 64 + F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + 64 + F.coalesce(F.octet_length(x["list_name"]), F.lit(0))))).first()[0] or 0
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(at_col).alias("fetched_at"))
    known = F.coalesce(host_of(F.col("url")).isNotNull() & F.col("fetched_at").isNotNull(), F.lit(False))
    urls = rows.where(known).select("url", "fetched_at")
    small = weight <= most_broadcast
    keyed = (urls if small else urls.distinct()).select("url", "fetched_at", F.explode(keys_of(F.col("url"))).alias("key"))
    met = keyed.join(F.broadcast(spans) if small else spans, "key")
    met = met.withColumn("spans", F.filter("spans", lambda s: (s["valid_from"] <= F.col("fetched_at")) & (s["valid_to"].isNull() | (F.col("fetched_at") < s["valid_to"])))).where(F.size("spans") > 0)
    first = F.array_min(F.transform("spans", lambda s: F.struct(s["list_name"].alias("list_name"), s["valid_from"].alias("valid_from"))))
    met = met.withColumn("first", first).select("url", "fetched_at", "key", F.size("spans").alias("n"), F.col("first.list_name").alias("list_name"), F.col("first.valid_from").alias("valid_from")).distinct()
    best = F.struct((-F.length("key")).alias("short"), "key", "list_name", "valid_from")
    verdict = met.groupBy("url", "fetched_at").agg(F.sum("n").alias("n_matches"), F.min(best).alias("best"))
    verdict = verdict.select("url", "fetched_at", "n_matches", F.col("best.key").alias("matched_key"), F.col("best.list_name").alias("matched_list"), F.col("best.valid_from").alias("listed_since"))
    out = rows.where(known).join(verdict, ["url", "fetched_at"], "left")
    columns = ["id", *verdict.columns]
    nothing = [F.lit(None).cast(verdict.schema[c].dataType).alias(c) for c in verdict.columns[2:]]
    out = out.select(*columns).unionByName(rows.where(~known).select("id", "url", "fetched_at", *nothing))
    return out.select("id", "url", "fetched_at", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), "matched_key", "matched_list", "listed_since", F.col("n_matches").isNotNull().alias("blocked"))
