"""URL filters whose lists change over time, with DataFrame functions only.

Dated list entries (add or remove a domain) become validity intervals by a window over each
(list, domain). Every distinct host meets the intervals of its domain suffixes once; the captures
join their host's intervals and keep those that hold at the time of the fetch. Lists and hosts
are far fewer than captures, and no capture is multiplied: a host with a third of all captures
costs a skewed join side that Spark splits (or none, if the host table is small by its measured
size and is broadcast).

Defined cases: a null or unreadable URL has no host and is allowed; a null capture time meets no
interval; on one day a removal comes after an addition; repeated entries count once; an entry
with a null field is ignored; hosts compare in lower case without user, port and final dot; repeated
captures each get their row; a very long URL is read whole; an empty table gives an empty result;
columns named host, lists or allowed give way to the operator's own, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read

FOUND = ("host", "lists", "allowed")
_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    host = F.regexp_replace(F.regexp_extract(F.lower(url), _HOST, 1), r"\.$", "")
    return F.when(host != "", host)


def validity(entries: DataFrame) -> DataFrame:
    """(list, domain, from_day, to_day) of entries (list, domain, day, action); to_day is exclusive, null for open."""
    entries = entries.select("list", F.lower("domain").alias("domain"), "day", "action").where("list is not null and domain is not null and day is not null and action in ('add', 'remove')")
    daily = entries.groupBy("list", "domain", "day").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list", "domain").orderBy("day")
    runs = daily.withColumn("before", F.lag("action").over(w)).where("not action <=> before")
    return runs.withColumn("to_day", F.lead("day").over(w)).where("action = 'add'").select("list", "domain", F.col("day").alias("from_day"), "to_day")


def evaluate(captures: DataFrame, intervals: DataFrame, url: str = "url", day: str = "captured_on") -> DataFrame:
    """captures with host, lists (sorted, those active for the host at the time) and allowed."""
    kept = [c for c in captures.columns if c not in FOUND]
    # the caller's columns go by number meanwhile, so that no name of theirs meets one of these
    captures = captures.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(kept)], host_of(F.col(url)).alias("host"), F.col(day).alias("day"))
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = captures.select("host").where("host is not null").distinct().select("host", F.explode(suffix).alias("domain"))
    known = hosts.join(intervals, "domain").groupBy("host").agg(F.collect_set(F.struct("list", "from_day", "to_day")).alias("known"))
    joined = captures.join(known.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host"), "left").drop("_host")
    now = F.filter("known", lambda k: (k["from_day"] <= F.col("day")) & (k["to_day"].isNull() | (F.col("day") < k["to_day"])))
    lists = F.array_sort(F.array_distinct(F.transform(now, lambda k: k["list"])))
    joined = joined.select(*[f"in_{i}" for i in range(len(kept))], "host", F.coalesce(lists, F.array().cast("array<string>")).alias("active"))
    return joined.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(kept)], "host", F.col("active").alias("lists"), (F.size("active") == 0).alias("allowed"))


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long")


def derived_captures(pages: DataFrame) -> DataFrame:
    """The tables hold no fetch times: a day of 2024 for each page_id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.pmod(F.col("page_id") * 37, F.lit(366))).cast("int")).alias("captured_on"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """Entries of three lists for two thirds of the hosts of pages: added, and for some removed and added again."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct().withColumn("n", _number(F.col("host"))).where("n % 3 > 0")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    n = F.col("n")
    steps = F.array(
        F.struct(F.lit("add").alias("action"), day(n % 200).alias("day")),
        F.struct(F.when(n % 2 == 0, "remove").otherwise("add").alias("action"), day(n % 200 + 20 + n % 50).alias("day")),
        F.struct(F.lit("add").alias("action"), day(n % 200 + 80 + n % 70).alias("day")),
    )
    domain = F.when(n % 5 == 0, F.regexp_replace("host", r"^[^.]*\.", "")).otherwise(F.col("host"))
    return hosts.select(F.concat(F.lit("list"), (n % 7 % 3).cast("string")).alias("list"), domain.alias("domain"), F.explode(steps).alias("s")).select("list", "domain", "s.day", "s.action")


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    found = evaluate(derived_captures(pages), validity(derived_entries(pages)))
    return found.select("page_id", "host", F.col("captured_on").cast("string").alias("captured_on"), F.array_join("lists", ",").alias("lists"), F.size("lists").cast("long").alias("n_active"), "allowed")


OP6_SQL = rf"""
WITH p AS (SELECT page_id, DATE '2024-01-01' + ((page_id * 37) % 366)::INTEGER AS day,
                  nullif(regexp_replace(regexp_extract(lower(url), '{_HOST}', 1), '\.$', ''), '') AS host FROM pages),
h AS (SELECT host, ('0x' || substr(md5(host), 1, 6))::BIGINT AS n FROM (SELECT DISTINCT host FROM p WHERE host IS NOT NULL)),
hh AS (SELECT *, 'list' || (n % 7 % 3)::VARCHAR AS list, CASE WHEN n % 5 = 0 THEN regexp_replace(host, '^[^.]*\.', '') ELSE host END AS domain FROM h WHERE n % 3 > 0),
e AS (SELECT list, domain, DATE '2024-01-01' + (n % 200)::INTEGER AS day, 'add' AS action FROM hh
      UNION ALL SELECT list, domain, DATE '2024-01-01' + (n % 200 + 20 + n % 50)::INTEGER, CASE WHEN n % 2 = 0 THEN 'remove' ELSE 'add' END FROM hh
      UNION ALL SELECT list, domain, DATE '2024-01-01' + (n % 200 + 80 + n % 70)::INTEGER, 'add' FROM hh),
d AS (SELECT list, domain, day, max(action) AS action FROM e GROUP BY ALL),
latest AS (SELECT p.page_id, d.list, d.action, row_number() OVER (PARTITION BY p.page_id, d.list, d.domain ORDER BY d.day DESC) AS r
         FROM p JOIN d ON d.day <= p.day AND (p.host = d.domain OR ends_with(p.host, '.' || d.domain))),
act AS (SELECT page_id, string_agg(list, ',' ORDER BY list) AS lists, count(*) AS n
        FROM (SELECT DISTINCT page_id, list FROM latest WHERE r = 1 AND action = 'add') GROUP BY 1)
SELECT page_id, host, day::VARCHAR AS captured_on, coalesce(lists, '') AS lists, coalesce(n, 0)::BIGINT AS n_active, coalesce(n, 0) = 0 AS allowed
FROM p LEFT JOIN act USING (page_id)
"""
