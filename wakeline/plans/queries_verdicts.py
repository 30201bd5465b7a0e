"""Verdicts of people (VL) and of traffic, by slot.

VL has one store; what traffic said is derived from the request's number, so that every case of the
merge occurs: files fetched again, complaints, both, a request that only traffic knows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import budget, verdicts
from .queries_budget import BUDGET, _SC, scored
from .views import view

QUERIES, SQL = {}, {}
_HUMAN = "hu AS (SELECT request_id, CASE request_id % 2 WHEN 0 THEN 'compact' ELSE 'tool_gate' END AS slot, verdict FROM vl)"
_TRAFFIC = f"""{_HUMAN}, im AS (SELECT request_id, 'targets' AS scope, CASE WHEN request_id % 9 = 0 THEN 'uncertain' ELSE 'keep' END AS verdict, CASE WHEN request_id % 6 = 0 THEN 'implicit:would-be-live' ELSE 'implicit:re-read' END AS source FROM vl WHERE request_id % 3 = 0
  UNION ALL SELECT request_id, 'slots', 'bad', 'implicit:correction' FROM vl WHERE request_id % 4 = 0
  UNION ALL SELECT request_id + 10000000, 'slots', 'bad', 'implicit:re-run' FROM vl WHERE request_id % 10 = 1)"""
_VIEW = f"""{_TRAFFIC}, k AS (SELECT request_id, string_agg(DISTINCT kind, '+' ORDER BY kind) AS kinds, bool_or(scope = 'targets' AND verdict = 'keep') AS flips, bool_or(scope = 'slots') AS turn FROM (SELECT *, string_split(source, ':')[-1] AS kind FROM im) GROUP BY 1),
ids AS (SELECT request_id FROM hu UNION SELECT request_id FROM im),
j AS (SELECT request_id, slot, hu.verdict AS own, kinds, coalesce(flips, false) AND slot = 'compact' AS fl, CASE WHEN kinds IS NULL THEN NULL WHEN slot = 'compact' THEN CASE WHEN flips THEN 'keep' ELSE 'exclude' END WHEN turn THEN 'exclude' END AS implicit_label
  FROM (SELECT request_id, unnest(['tool_gate', 'compact', 'context', 'effort']) AS slot FROM ids) LEFT JOIN hu USING (request_id, slot) LEFT JOIN k USING (request_id)),
lv AS (SELECT request_id, slot, CASE WHEN implicit_label IS NULL OR own = 'good' THEN own WHEN own = 'bad' THEN 'mixed' ELSE implicit_label END AS verdict,
  CASE WHEN implicit_label IS NULL THEN CASE WHEN own IN ('good', 'bad') THEN 'human' END WHEN own = 'good' THEN CASE WHEN fl THEN 'human+implicit' ELSE 'human' END WHEN own = 'bad' THEN 'mixed' ELSE 'implicit:' || kinds END AS label_source, implicit_label FROM j)"""
_COVER = f"""{_VIEW}, rq AS (SELECT request_id FROM vl UNION ALL SELECT -1 - request_id FROM vl WHERE request_id % 50 = 0),
cv AS (SELECT request_id, request_id IN (SELECT request_id FROM hu) AS people, request_id IN (SELECT request_id FROM im) AS traffic, verdict, implicit_label FROM rq LEFT JOIN (SELECT * FROM lv WHERE slot = 'compact') USING (request_id))"""


def stores(spark, d):
    v = view(spark, d, "vl")
    r = F.col("request_id")
    human = v.select("request_id", F.when(r % 2 == 0, "compact").otherwise("tool_gate").alias("slot"), "verdict")
    row = lambda where, key, scope, verdict, source: v.where(where).select(key.alias("request_id"), F.lit(scope).alias("scope"), verdict.alias("verdict"), source.alias("source"))
    files = row(r % 3 == 0, r, "targets", F.when(r % 9 == 0, "uncertain").otherwise("keep"), F.when(r % 6 == 0, "implicit:would-be-live").otherwise("implicit:re-read"))
    turns = row(r % 4 == 0, r, "slots", F.lit("bad"), F.lit("implicit:correction"))
    other = row(r % 10 == 1, r + 10_000_000, "slots", F.lit("bad"), F.lit("implicit:re-run"))
    requests = v.select("request_id").unionByName(v.where(r % 50 == 0).select((-1 - r).alias("request_id")))
    return human, files.unionByName(turns).unionByName(other), requests


SQL["l1_label_view"] = f"WITH {_VIEW} SELECT * FROM lv"
SQL["a15_implicit_coverage"] = f"WITH {_COVER} SELECT count(*) AS requests_in_window, count(*) FILTER (traffic) AS covered_by_harvest, count(*) FILTER (people) AS covered_by_human, count(*) FILTER (people AND NOT traffic) AS human_only, count(*) FILTER (traffic AND NOT people) AS harvest_only, count(*) FILTER (traffic AND verdict = 'mixed') AS disagreements, round(count(*) FILTER (traffic)::DOUBLE / count(*), 4) AS coverage FROM cv"
SQL["a15_implicit_verdicts"] = f"WITH {_COVER} SELECT coalesce(implicit_label, 'none') AS verdict, count(*) AS n FROM cv WHERE traffic GROUP BY 1"
SQL["a13_audit_by_slot"] = f"""WITH RECURSIVE {_SC}, o AS (SELECT request_id, idx, tokens, tail, n - i AS step FROM sc),
 f AS (SELECT request_id, 0::BIGINT AS step, 0::BIGINT AS spent, NULL::BIGINT AS tokens, NULL::BOOLEAN AS keep FROM (SELECT DISTINCT request_id FROM o)
 UNION ALL SELECT o.request_id, o.step, f.spent + CASE WHEN o.tail OR f.spent + o.tokens <= {BUDGET} THEN o.tokens ELSE 0 END, o.tokens, o.tail OR f.spent + o.tokens <= {BUDGET} FROM f JOIN o ON o.request_id = f.request_id AND o.step = f.step + 1),
 de AS (SELECT request_id, 'compact' AS slot, count(*) FILTER (NOT keep) AS n_drop, sum(CASE WHEN NOT keep THEN tokens ELSE 0 END) AS saved_tok FROM f WHERE keep IS NOT NULL GROUP BY 1
   UNION ALL SELECT request_id, 'tool_gate', request_id % 4, request_id % 4 * 30 FROM (SELECT DISTINCT request_id FROM o) WHERE request_id % 3 = 0),
 s AS (SELECT slot, count(*) AS decisions, sum(n_drop)::BIGINT AS would_drop, sum(saved_tok)::BIGINT AS savings_est_tok FROM de GROUP BY 1), q AS (SELECT count(DISTINCT request_id) AS requests_scanned FROM de)
 SELECT slot, coalesce(decisions, 0) AS decisions, coalesce(would_drop, 0) AS would_drop, coalesce(savings_est_tok, 0) AS savings_est_tok, requests_scanned, round(coalesce(would_drop, 0)::DOUBLE / requests_scanned, 4) AS drops_per_request, round(coalesce(savings_est_tok, 0)::DOUBLE / requests_scanned, 4) AS tok_per_request
 FROM (SELECT unnest(['tool_gate', 'compact', 'context', 'effort']) AS slot) LEFT JOIN s USING (slot), q"""


def l1_label_view(spark, d):
    human, implicit, _ = stores(spark, d)
    return verdicts.label_view(human, implicit)


def a15_implicit_coverage(spark, d):
    human, implicit, requests = stores(spark, d)
    return verdicts.implicit_coverage(requests, human, implicit)


def a15_implicit_verdicts(spark, d):
    human, implicit, requests = stores(spark, d)
    return verdicts.implicit_verdicts(requests, human, implicit)


def a13_audit_by_slot(spark, d):
    rows = scored(spark, d)
    kept = budget.recency_compaction(rows, F.lit(BUDGET)).join(rows.select("request_id", "idx", "tokens"), ["request_id", "idx"])
    compact = kept.groupBy("request_id").agg(F.count_if(~F.col("keep")).alias("n_drop"), F.sum(F.when(~F.col("keep"), F.col("tokens")).otherwise(0)).alias("saved_tok")).withColumn("slot", F.lit("compact"))
    r = F.col("request_id")
    gate = rows.select("request_id").distinct().where(r % 3 == 0).select("request_id", (r % 4).alias("n_drop"), (r % 4 * 30).alias("saved_tok"), F.lit("tool_gate").alias("slot"))
    return verdicts.slot_audit(compact.unionByName(gate))


QUERIES |= {f.__name__: f for f in (l1_label_view, a15_implicit_coverage, a15_implicit_verdicts, a13_audit_by_slot)}
