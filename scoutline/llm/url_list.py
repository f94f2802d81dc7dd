"""URL filters: temporal list join.

A list is a log of dated entries that add a key to it or take it off. The entries of a key become
disjoint validity intervals, and every capture of a URL is held against those intervals of the
URL's keys (its host, the parents of the host, and the host with the first part of the path) that hold at the time of the fetch.

Intervals of a key are disjoint, so only the last one that began by the time of a fetch can hold then: intervals and
captures of a key are put in one order of time, and each capture takes the interval before it. No unit of time, number of
intervals or length of them matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutline.llm.shared import Scratch, small

#: Captures of a key that are put in order together; keys of more are split by capture, and their intervals repeated.
HOT = 100_000
#: Rows with a key or a URL that are broadcast, at most.
STRINGS = 100_000


ADDRESS = r"^[0-9]+(\.[0-9]+){3}$"


def keys(url: Column) -> Column:
    """Keys of a URL: the host, its parents of two labels or more (an address has none), and the host with the first path segment."""
    m = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?(?:/([^/?#]*))?"
    host, first = F.lower(F.regexp_extract(url, m, 1)), F.regexp_extract(url, m, 2)
    labels = F.split(host, r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.when(host.rlike(ADDRESS), 1).otherwise(F.greatest(F.lit(1), F.size(labels) - 1))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(parents, F.when(first != "", F.array(F.concat_ws("/", host, first))).otherwise(F.array().cast("array<string>")))))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, since, until) during which a key is listed, from entries (key, at, listed boolean).

    until is exclusive, and null while the entry stands. Of entries of a key at one time those
    that delist win. Entries without key, time or listed are ignored.
    """
    log = entries.where("key is not null and at is not null and listed is not null").groupBy("key", F.col("at").cast("long").alias("since")).agg(F.min("listed").alias("listed"))
    w = Window.partitionBy("key").orderBy("since")
    return log.withColumn("until", F.lead("since").over(w)).where("listed").select("key", "since", "until")


def listed_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (id, url, at) with blocked, matched_key (the first by code point, null if none) and n_active, one row per input row.

    A capture without url or time is not blocked. Repeated rows stay; other columns of either
    table are ignored; either table may be empty.
    """
    captures = captures.select("id", F.col("url").cast("string").alias("url"), F.col("at").cast("long").alias("at"))
    asked = captures.where("url is not null and at is not null").select("url", "at").distinct()
    with Scratch(captures.sparkSession) as scratch:
        valid = scratch.save(intervals(entries))
        listed = scratch.save(valid.select("key").distinct())
        probes = scratch.save(asked.select("url", "at", F.explode(keys(F.col("url"))).alias("key")).join(small(listed, STRINGS), "key", "left_semi"))
        # One row of HOT captures at most.
        hot = small(scratch.save(probes.groupBy("key").agg(F.ceil(F.count("*") / HOT).alias("parts")).where("parts > 1")), STRINGS)
        n = F.coalesce("parts", F.lit(1))
        put = probes.join(hot, "key", "left").select("key", F.pmod(F.xxhash64("url", "at"), n).alias("part"), "at", F.lit(1).alias("kind"), "url", F.lit(None).cast("struct<since: long, until: long>").alias("held"))
        held = valid.join(hot, "key", "left").select("key", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("part"), F.col("since").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.struct("since", "until").alias("held"))
        order = Window.partitionBy("key", "part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
        last = put.unionByName(held).withColumn("last", F.last("held", ignorenulls=True).over(order)).where("kind = 1 and last is not null and (last.until is null or at < last.until)")
        active = scratch.save(last.groupBy("url", "at").agg(F.min("key").alias("matched_key"), F.count("*").alias("n_active")))
        met = captures.join(active, ["url", "at"], "left").select("id", "url", "at", F.col("matched_key").isNotNull().alias("blocked"), "matched_key", F.coalesce("n_active", F.lit(0)).alias("n_active"))
        return scratch.keep(met)


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 6), 16, 10).cast("long")


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of pages at a stated day of a year: page_id * 37 mod 366."""
    return pages.select(F.col("page_id").alias("id"), "url", (F.col("page_id") * 37 % 366).alias("at"))


def page_list(pages: DataFrame) -> DataFrame:
    """A list over the hosts and first path segments of pages, dated by a stated rule on the md5 of the key: hosts whose number
    divides by 3 come on the list at day number mod 200, go 30 + number mod 90 days later and come back at day 300; host and
    segment keys whose number divides by 5 come on it at day number mod 300."""
    key = pages.where("url is not null").select(F.explode(keys(F.col("url"))).alias("key")).distinct().withColumn("x", _number(F.col("key")))
    host = key.where("not contains(key, '/') and x % 3 = 0")
    path = key.where("contains(key, '/') and x % 5 = 0")
    return (
        host.select("key", (F.col("x") % 200).alias("at"), F.lit(True).alias("listed"))
        .unionByName(host.select("key", (F.col("x") % 200 + 30 + F.col("x") % 90).alias("at"), F.lit(False).alias("listed")))
        .unionByName(host.select("key", F.lit(300).cast("long").alias("at"), F.lit(True).alias("listed")))
        .unionByName(path.select("key", (F.col("x") % 300).alias("at"), F.lit(True).alias("listed")))
    )


URL_SQL = r"""
WITH u AS (SELECT page_id, url, page_id * 37 % 366 AS fetch_day, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) h,
                  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*(?::[0-9]*)?/([^/?#]*)', 1) s FROM pages),
l AS (SELECT *, string_split(h, '.') p FROM u WHERE h <> ''),
k AS (SELECT DISTINCT url, fetch_day, array_to_string(p[i:], '.') AS key FROM (SELECT *, unnest(range(1, CASE WHEN regexp_matches(h, '^[0-9]+(\.[0-9]+){3}$') THEN 2 ELSE greatest(2, len(p)) END)) i FROM l)
      UNION SELECT DISTINCT url, fetch_day, h || '/' || s FROM l WHERE s <> ''),
x AS (SELECT key, ('0x' || substr(md5(key), 1, 6))::BIGINT x FROM (SELECT DISTINCT key FROM k)),
e AS (SELECT key, x % 200 AS since, true AS listed FROM x WHERE NOT contains(key, '/') AND x % 3 = 0
      UNION ALL SELECT key, x % 200 + 30 + x % 90, false FROM x WHERE NOT contains(key, '/') AND x % 3 = 0
      UNION ALL SELECT key, 300, true FROM x WHERE NOT contains(key, '/') AND x % 3 = 0
      UNION ALL SELECT key, x % 300, true FROM x WHERE contains(key, '/') AND x % 5 = 0),
g AS (SELECT key, since, bool_and(listed) listed FROM e GROUP BY key, since),
v AS (SELECT key, since, listed, lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM g),
a AS (SELECT url, fetch_day, min(key) matched_key, count(*) n_active FROM k JOIN v USING (key) WHERE listed AND since <= fetch_day AND (until IS NULL OR fetch_day < until) GROUP BY url, fetch_day)
SELECT page_id, u.url, u.fetch_day, matched_key IS NOT NULL AS blocked, matched_key, coalesce(n_active, 0)::BIGINT AS n_active
FROM u LEFT JOIN a ON u.url = a.url AND u.fetch_day = a.fetch_day
"""
