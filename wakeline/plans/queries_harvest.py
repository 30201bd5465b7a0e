"""The harvest over VP: bodies are missing for some turns, cuts are enforced or in shadow.

A turn's body shows the fetches of the last REACH turns; a cut is enforced where the event's id is
even. Bodies seen again and complaints follow from the id too, as VP has no texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import harvest
from .views import view

QUERIES, SQL = {}, {}
REACH, CHUNK = 5, 512


def turns(spark, d) -> DataFrame:
    e = F.col("event_id")
    return view(spark, d, "vp").select(
        F.col("session").cast("string").alias("session"), F.col("turn").cast("long").alias("id"), "ts_epoch", "path", "evicted", "fetched", "tokens", e.cast("string").alias("target"), (e % 2 == 0).alias("applied"),
        (e % 11 != 0).alias("has_body"), F.concat("path", F.lit("-"), (e % 3).cast("string")).alias("body_sha"), F.when(e % 13 == 0, "No, look again").otherwise("go on").alias("user_text"),
    )


def fetches(t: DataFrame) -> DataFrame:
    near = t.where("fetched").withColumn("at", F.explode(F.sequence(F.col("id"), F.col("id") + REACH)))
    return near.groupBy("session", F.col("at").alias("id"), "path").agg(F.count("*").alias("n"), F.max_by("tokens", near["id"]).alias("tokens"))


def harvested(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """turns, observations of files, labels."""
    t = turns(spark, d)
    cuts = t.where("evicted").select("session", "id", F.lit(0).alias("pos"), "path", F.lit(None).cast("string").alias("pointer"), "target", "tokens", "applied")
    files = harvest.file_observations(t, fetches(t), cuts, chunk=CHUNK)
    return t, files, harvest.harvest_labels(files, harvest.turn_observations(t))


_T = f"""t AS (SELECT session::VARCHAR AS session, turn AS id, ts_epoch, path, evicted, fetched, tokens, event_id::VARCHAR AS target, event_id % 2 = 0 AS applied, event_id % 11 <> 0 AS has_body,
  path || '-' || (event_id % 3)::VARCHAR AS body_sha, event_id % 13 = 0 AS complaint FROM vp),
f AS (SELECT t.session, t.id + i AS id, t.path, count(*) AS n, arg_max(t.tokens, t.id) AS tokens FROM t, range(0, {REACH + 1}) AS r(i) WHERE fetched GROUP BY ALL),
b AS (SELECT session, id, ts_epoch, row_number() OVER (PARTITION BY session ORDER BY id) AS nb FROM t WHERE has_body),
fb AS (SELECT f.*, nb, ts_epoch FROM f JOIN b USING (session, id)),
g AS (SELECT a.*, coalesce(p.n, 0) AS before FROM fb a LEFT JOIN fb p ON p.session = a.session AND p.path = a.path AND p.nb = a.nb - 1 WHERE a.n > coalesce(p.n, 0)),
bl AS (SELECT g.session, g.id AS at_id, g.path, g.before, g.tokens AS cost, arg_max(e, e.id) AS e FROM g JOIN t e ON e.session = g.session AND e.path = g.path AND e.evicted AND e.has_body AND e.id < g.id AND g.id - e.id <= 20 AND g.ts_epoch - e.ts_epoch <= 1800 GROUP BY ALL),
rr AS (SELECT session, lag(id) OVER w AS request_id, id AS at_id, ts_epoch - lag(ts_epoch) OVER w AS gap FROM t WHERE has_body WINDOW w AS (PARTITION BY session, body_sha ORDER BY id)),
co AS (SELECT session, lag(id) OVER w AS request_id, id AS at_id, has_body AND lag(has_body) OVER w AND complaint AS hit FROM t WINDOW w AS (PARTITION BY session ORDER BY id)),
o AS (SELECT session, e.id AS request_id, 'targets' AS scope, e.target AS key, 'keep' AS verdict, CASE WHEN e.applied THEN 'implicit:re-read' ELSE 'implicit:would-be-live' END AS source, path, CASE WHEN e.applied THEN cost ELSE 0 END AS regret_tok, e.tokens AS evicted_tok, at_id, 0 AS class FROM bl
  UNION ALL SELECT session, request_id, 'slots', 'turn', 'bad', 'implicit:re-run', NULL, NULL, NULL, at_id, 1 FROM rr WHERE request_id IS NOT NULL AND gap <= 1800
  UNION ALL SELECT session, request_id, 'slots', 'turn', 'bad', 'implicit:correction', NULL, NULL, NULL, at_id, 2 FROM co WHERE hit),
la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, request_id, scope, key ORDER BY class > 0, at_id, class, path) AS r FROM o) WHERE r = 1)"""

SQL["l6_harvest_labels"] = f"WITH {_T} SELECT session, request_id, scope, key, verdict, source, path, regret_tok, evicted_tok, at_id FROM la"
SQL["a14_harvest_summary"] = f"""WITH {_T} SELECT count(*) AS requests_scanned, count(*) FILTER (has_body) AS bodies_available, count(*) FILTER (NOT has_body) AS skipped_no_body, count(*) FILTER (evicted AND has_body) AS evicted_reads_seen,
  (SELECT count(*) FROM bl) AS wrong_drops, (SELECT count(*) FROM bl WHERE e.applied) AS enforced, (SELECT count(*) FROM bl WHERE NOT e.applied) AS shadow, (SELECT coalesce(sum(cost), 0)::BIGINT FROM bl WHERE e.applied) AS refetch_tok_paid,
  (SELECT count(*) FROM (SELECT DISTINCT session, request_id FROM la)) AS labels_written, round((SELECT count(*) FROM bl) * 1000.0::DOUBLE / count(*), 1) AS per_1k FROM t"""
SQL["a14_harvest_by_source"] = f"WITH {_T} SELECT source, count(*) AS labels, coalesce(sum(regret_tok), 0)::BIGINT AS regret_tok FROM la GROUP BY 1"


def l6_harvest_labels(spark, d):
    return harvested(spark, d)[2].drop("evidence")


def a14_harvest_summary(spark, d):
    return harvest.harvest_summary(*harvested(spark, d))


def a14_harvest_by_source(spark, d):
    return harvest.harvest_by_source(harvested(spark, d)[2])


QUERIES |= {f.__name__: f for f in (l6_harvest_labels, a14_harvest_summary, a14_harvest_by_source)}
