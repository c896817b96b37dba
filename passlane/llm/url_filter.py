"""URL filters as a temporal list join.

A list is a log of dated entries: ``(entry_id, kind, key, action, at)``, action ``add`` or
``remove``, ``at`` in seconds. The entries of one (kind, key) become validity intervals: from
an ``add`` up to the key's next entry. A capture ``(page_id, url, fetched_at)`` is held against
the intervals of all keys its URL has, as of its fetch time; entries made later do not count.

Kinds: ``url`` (host, path and query), ``prefix`` (host and path up to any slash), ``host``,
``domain`` (host or any parent of two labels or more).

Intervals are dealt over time buckets, so that a key that holds a third of all captures meets
its intervals in many tasks, and a capture only the few of its own bucket.

Defined results: a null or hostless URL matches nothing and is allowed, as is a capture with no
fetch time; entries of one key and second apply in the order of entry_id; entries with a null
field are void; repeated captures are answered each; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)"
DAY = 86_400


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def _rest(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def _key(kind: str, key: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"))


def keys(url: Column) -> Column:
    """All (kind, key) under which a list may name the URL; null without a host."""
    h, rest = host(url), _rest(url)
    steps = F.split(F.regexp_extract(rest, r"^([^?]*)", 1), "/", -1)
    labels = F.split(h, r"\.", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: _key(
        "prefix", F.concat(h, F.array_join(F.slice(steps, F.lit(1), i), "/"), F.lit("/"))))
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: _key(
        "domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    return F.when(h != "", F.array_distinct(F.concat(
        F.array(_key("url", F.concat(h, rest)), _key("host", h)), prefixes, parents)))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity of each key: kind, key, valid_from, valid_to (exclusive; null: still valid)."""
    history = Window.partitionBy("kind", "key").orderBy("at", "entry_id")
    whole = entries.select("entry_id", "kind", "key", "action", "at").dropna().distinct()
    return (whole.withColumn("valid_to", F.lead("at").over(history))
            .where((F.col("action") == "add") & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("at"))))
            .select("kind", "key", F.col("at").alias("valid_from"), "valid_to"))


def filter_captures(captures: DataFrame, entries: DataFrame, bucket_days: int = 60) -> DataFrame:
    """One row per capture: page_id, url, fetched_at, n_active, blocked, rule, since.

    ``rule`` is the most specific active key (url, then the longest prefix, host, domain),
    ``since`` the start of its interval.
    """
    captures = captures.select("page_id", "url", "fetched_at")
    size = bucket_days * DAY
    bucket = lambda t: F.floor(t / size).cast("long")
    wanted = (captures.distinct().withColumn("k", F.explode(keys(F.col("url"))))
              .where(F.col("fetched_at").isNotNull())
              .select("page_id", "url", "fetched_at", F.col("k.kind").alias("kind"), F.col("k.key").alias("key"),
                      bucket(F.col("fetched_at")).alias("bucket")))
    span = captures.agg(F.min("fetched_at"), F.max("fetched_at")).first()
    first, last = span if span[0] is not None else (0, 0)
    valid = intervals(entries).where((F.col("valid_from") <= last) & (
        F.col("valid_to").isNull() | (F.col("valid_to") > first)))
    dealt = valid.withColumn("v_bucket", F.explode(F.sequence(
        bucket(F.greatest("valid_from", F.lit(first))),
        bucket(F.least(F.coalesce(F.col("valid_to") - 1, F.lit(last)), F.lit(last))))))
    dealt = dealt.select(F.col("kind").alias("v_kind"), F.col("key").alias("v_key"), "v_bucket", "valid_from", "valid_to")
    rank = F.when(F.col("kind") == "url", 0).when(F.col("kind") == "prefix", 1).when(F.col("kind") == "host", 2).otherwise(3)
    active = (wanted.join(dealt, (F.col("kind") == F.col("v_kind")) & (F.col("key") == F.col("v_key"))
                          & (F.col("bucket") == F.col("v_bucket")) & (F.col("fetched_at") >= F.col("valid_from"))
                          & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))))
              .groupBy("page_id", "url", "fetched_at").agg(
                  F.count("*").alias("n"), F.min(F.struct(
                      rank.alias("rank"), (-F.length("key")).alias("short"), F.concat_ws(":", "kind", "key").alias("rule"),
                      "valid_from")).alias("best"))
              .select(F.col("page_id").alias("a_id"), F.col("url").alias("a_url"), F.col("fetched_at").alias("a_at"), "n", "best"))
    return (captures.join(active, F.col("page_id").eqNullSafe(F.col("a_id")) & F.col("url").eqNullSafe(F.col("a_url"))
                          & F.col("fetched_at").eqNullSafe(F.col("a_at")), "left")
            .select("page_id", "url", "fetched_at", F.coalesce("n", F.lit(0)).cast("long").alias("n_active"),
                    F.col("n").isNotNull().alias("blocked"), F.col("best.rule").alias("rule"),
                    F.col("best.valid_from").alias("since")))


# -- stand-in inputs of the registered query

def stand_in_captures(pages: DataFrame) -> DataFrame:
    """Pages with a made-up fetch time."""
    at = F.lit(1_577_836_800) + F.pmod(F.col("page_id") * 37, F.lit(1461)) * DAY + F.pmod(F.col("page_id"), F.lit(DAY))
    return pages.select("page_id", "url", at.cast("long").alias("fetched_at"))


def stand_in_entries(pages: DataFrame) -> DataFrame:
    """A made-up list log: some pages' URLs, directories, hosts and parent domains, added and removed."""
    h = host(F.col("url"))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("url", "prefix", "host", "domain")]),
                        (F.pmod(F.floor(F.col("page_id") / 6), F.lit(4)) + 1).cast("int"))
    rest = _rest(F.col("url"))
    key = (F.when(kind == "url", F.concat(h, rest))
           .when(kind == "prefix", F.concat(h, F.regexp_extract(rest, r"^(/(?:[^/?]*/)?)", 1)))
           .when(kind == "host", h).otherwise(F.regexp_replace(h, r"^[^.]*\.", "")))
    at = F.lit(1_577_836_800) + F.pmod(F.col("page_id") * 53, F.lit(1461)) * DAY
    return pages.where((F.pmod(F.col("page_id"), F.lit(6)) == 0) & (h != "")).select(
        F.col("page_id").alias("entry_id"), kind.alias("kind"), key.alias("key"),
        F.when(F.pmod(F.floor(F.col("page_id") / 24), F.lit(3)) == 1, "remove").otherwise("add").alias("action"),
        at.cast("long").alias("at"))


#: The registered query in DuckDB SQL.
ORACLE = r"""
WITH p AS (
  SELECT page_id, url, 1577836800 + (page_id * 37 % 1461) * 86400 + page_id % 86400 AS fetched_at,
         lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)', 1)) AS h,
         regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)', 2) AS r0
  FROM pages),
q AS (SELECT *, CASE WHEN starts_with(r0, '/') THEN r0 ELSE '/' || r0 END AS rest FROM p),
l AS (
  SELECT page_id AS entry_id, h, rest, ['url', 'prefix', 'host', 'domain'][(page_id // 6) % 4 + 1] AS kind,
         CASE WHEN (page_id // 24) % 3 = 1 THEN 'remove' ELSE 'add' END AS action,
         1577836800 + (page_id * 53 % 1461) * 86400 AS made
  FROM q WHERE page_id % 6 = 0 AND h <> ''),
e AS (
  SELECT entry_id, kind, action, made, CASE kind WHEN 'url' THEN h || rest
         WHEN 'prefix' THEN h || regexp_extract(rest, '^(/(?:[^/?]*/)?)', 1)
         WHEN 'host' THEN h ELSE regexp_replace(h, '^[^.]*\.', '') END AS key FROM l),
v AS (SELECT kind, key, action, made AS valid_from,
             lead(made) OVER (PARTITION BY kind, key ORDER BY made, entry_id) AS valid_to FROM e),
i AS (SELECT * FROM v WHERE action = 'add' AND (valid_to IS NULL OR valid_to > valid_from)),
s AS (SELECT *, string_split(regexp_extract(rest, '^([^?]*)', 1), '/') AS steps, string_split(h, '.') AS labels FROM q WHERE h <> ''),
k AS (
  SELECT DISTINCT page_id, url, fetched_at, kind, key FROM (
    SELECT page_id, url, fetched_at, 'url' AS kind, h || rest AS key FROM s
    UNION ALL SELECT page_id, url, fetched_at, 'host', h FROM s
    UNION ALL SELECT page_id, url, fetched_at, 'prefix', h || array_to_string(steps[1:n], '/') || '/'
      FROM (SELECT *, unnest(range(1, len(steps))) AS n FROM s)
    UNION ALL SELECT page_id, url, fetched_at, 'domain', array_to_string(labels[n:], '.')
      FROM (SELECT *, unnest(range(1, greatest(len(labels), 2))) AS n FROM s))),
a AS (
  SELECT page_id, url, fetched_at, kind || ':' || k.key AS rule, valid_from,
         count(*) OVER (PARTITION BY page_id, url, fetched_at) AS n, row_number() OVER (PARTITION BY page_id, url, fetched_at ORDER BY CASE kind WHEN 'url' THEN 0 WHEN 'prefix' THEN 1
           WHEN 'host' THEN 2 ELSE 3 END, -length(k.key), kind || ':' || k.key, valid_from) AS best
  FROM k JOIN i USING (kind, key) WHERE fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to))
SELECT q.page_id, q.url, q.fetched_at, coalesce(a.n, 0) AS n_active, a.n IS NOT NULL AS blocked, a.rule, a.valid_from AS since
FROM q LEFT JOIN a ON q.page_id = a.page_id AND q.url = a.url AND q.fetched_at = a.fetched_at AND a.best = 1
"""
