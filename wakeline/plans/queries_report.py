"""Queries over VR, VM, VL and VA: features, cost, report and evaluation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import cost, text
from ..operators import evaluate, report
from ..sources import logs
from ..streaming import jobs
from .views import view

P = cost.price_sql()
C = f"(in_tok * price_in + cr_tok * price_cached + cw_tok * price_in + out_tok * price_out) / 1e6"
PR = f"pr AS (SELECT *, {C} AS cost_usd FROM (SELECT *, {P} FROM vr))"
CLIENT = "CASE " + " ".join(f"WHEN contains(lower(agent), '{n}') THEN '{c}'" for n, c in text.CLIENTS) + " ELSE substr(split_part(lower(agent), '/', 1), 1, 32) END"
TOK = lambda c: f"CASE WHEN coalesce(length({c}), 0) = 0 THEN 0 ELSE greatest(1, floor(length({c}) / 3.6 + 0.5)) END::BIGINT"
MARKER, OPENING = r"\bthat\b", r"^(that|the|to)\b"

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("s1_day_range", "SELECT id, day, in_tok FROM vr WHERE day BETWEEN '2024-01-05' AND '2024-01-20'")
def s1(spark, d):
    return report.in_days(view(spark, d, "vr"), "2024-01-05", "2024-01-20").select("id", "day", "in_tok")


@query("s2_to_request_rows", f"WITH {PR} SELECT id, strftime(make_timestamp(floor(ts_epoch * 1000000)::BIGINT), '%Y-%m-%d') AS day, in_tok, cw_tok, cr_tok, out_tok, round(cost_usd, 9) AS cost_usd FROM pr")
def s2(spark, d):
    raw = view(spark, d, "vr").withColumn("cw_tok", F.when(F.col("cw_tok") > 0, F.col("cw_tok")))
    return logs.to_request_rows(raw).select("id", "day", "in_tok", "cw_tok", "cr_tok", "out_tok", F.round("cost_usd", 9).alias("cost_usd"))


@query("s3_with_schema", "SELECT id, model, status, NULL::DOUBLE AS engine_ms FROM vr")
def s3(spark, d):
    return logs.with_schema(view(spark, d, "vr").select("id", "model", F.col("status").cast("int"))).select("id", "model", "status", "engine_ms")


@query("s5_body_sha", "SELECT doc_id, substr(sha256(text), 1, 12) AS body_sha FROM documents")
def s5(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.body_sha(F.col("text")).alias("body_sha"))


@query("p1_approx_tokens", f"SELECT doc_id, {TOK('text')} AS tokens FROM documents")
def p1(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.approx_tokens(F.col("text")).alias("tokens"))


@query("p2_dialect", """SELECT page_id, CASE WHEN contains(url, '/messages') THEN 'anthropic' WHEN contains(url, 'generateContent') OR contains(url, 'streamGenerateContent') THEN 'gemini'
 WHEN contains(url, '/responses') THEN 'responses' WHEN contains(url, '/chat/completions') OR contains(url, '/completions') THEN 'openai' END AS dialect
 FROM (SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '/v1/messages' WHEN 1 THEN '/m:generateContent' WHEN 2 THEN '/responses' WHEN 3 THEN '/v1/chat/completions' ELSE '' END AS url FROM pages)""")
def p2(spark, d):
    n = F.col("page_id") % 5
    end = F.when(n == 0, "/v1/messages").when(n == 1, "/m:generateContent").when(n == 2, "/responses").when(n == 3, "/v1/chat/completions").otherwise("")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", text.dialect(F.concat("url", end)).alias("dialect"))


@query("p3_client_name", f"SELECT id, {CLIENT} AS client FROM vr")
def p3(spark, d):
    return view(spark, d, "vr").select("id", text.client_name(F.col("agent")).alias("client"))


STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
TERMS = lambda c: f"""list_filter(list_transform(flatten(list_transform(regexp_extract_all({c}, '[A-Za-z0-9_.$/-]{{3,}}'), lambda x: string_split_regex(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[._/$\\- ]+'))), lambda x: lower(x)), lambda x: length(x) >= 3 AND x NOT IN ({STOP}))"""


@query("p6_lexical_tokens", f"""WITH t AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {TERMS('text')} AS w FROM documents)),
 f AS (SELECT doc_id, w, min(i) AS i FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM f)
 SELECT d.doc_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS terms FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND r <= 60 GROUP BY 1""")
def p6(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.array_join(text.lexical_tokens(F.col("text"), 60), " ").alias("terms"))


@query("p7_extract_paths", r"""SELECT event_id, array_to_string(list_transform(regexp_extract_all('see ' || path || ' and ' || upper(path) || 'x or lib/a.json', '([A-Za-z0-9_./-]+\.(?:py|json))(?:[^A-Za-z0-9_]|$)', 1), lambda x: lower(x)), ',') AS paths FROM vp""")
def p7(spark, d):
    line = F.concat(F.lit("see "), F.col("path"), F.lit(" and "), F.upper("path"), F.lit("x or lib/a.json"))
    return view(spark, d, "vp").select("event_id", F.array_join(text.extract_paths(line), ",").alias("paths"))


@query("p9_same_path", "SELECT event_id, (path = 'm' || (event_id % 10) || '.py' OR ends_with(path, '/m' || (event_id % 10) || '.py')) AS same FROM vp")
def p9(spark, d):
    other = F.concat(F.lit("M"), (F.col("event_id") % 10).cast("string"), F.lit(".py"))
    return view(spark, d, "vp").select("event_id", text.same_path(F.col("path"), other).alias("same"))


@query("p10_markers", r"SELECT doc_id, regexp_matches(text, '(?i)\bthat\b') AS that, regexp_matches(text, '(?m)^The ') AS line, regexp_matches(text, '(?i)licen[cs]e|\bidiot\b') AS word FROM documents")
def p10(spark, d):
    m = lambda p: F.regexp_like("text", F.lit(p))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", m(r"(?i)\bthat\b").alias("that"), m(r"(?m)^The ").alias("line"), m(r"(?i)licen[cs]e|\bidiot\b").alias("word"))


@query("p16_price", f"SELECT id, model, {P} FROM vr")
def p16(spark, d):
    return cost.with_price(view(spark, d, "vr")).select("id", "model", *cost.PRICE_NAMES)


@query("p17_cost", f"WITH {PR} SELECT id, round(cost_usd, 9) AS cost_usd FROM pr")
def p17(spark, d):
    return report.priced(view(spark, d, "vr")).select("id", F.round("cost_usd", 9).alias("cost_usd"))


@query("p20_version_of", "WITH l AS (SELECT id, model || CASE WHEN id % 3 = 0 THEN '+heuristic' ELSE '' END AS label FROM vr) SELECT id, CASE WHEN list_contains(string_split(label, '+'), 'heuristic') THEN 'heuristic' WHEN label = 'gpt-4o' THEN 'v2' WHEN label = 'o3-pro' THEN 'v3' ELSE label END AS version FROM l")
def p20(spark, d):
    manifest = spark.createDataFrame([("gpt-4o", "v2"), ("o3-pro", "v3")], "label string, version string")
    rows = view(spark, d, "vr").select("id", F.concat("model", F.when(F.col("id") % 3 == 0, "+heuristic").otherwise("")).alias("label"))
    return evaluate.version_of(rows, manifest).select("id", "version")


@query("p21_usage", "SELECT id, CASE WHEN starts_with(model, 'claude') THEN in_tok ELSE greatest(0, in_tok - cr_tok) END AS input_uncached, CASE WHEN starts_with(model, 'claude') THEN cw_tok ELSE 0 END AS cache_write, cr_tok AS cache_read, out_tok AS output, 0::BIGINT AS reasoning FROM vr")
def p21(spark, d):
    provider = F.when(F.startswith("model", F.lit("claude")), "anthropic").otherwise("openai")
    u = cost.usage(provider, F.col("in_tok"), F.col("cr_tok"), F.col("out_tok"), F.lit(None), F.col("cw_tok"))
    return view(spark, d, "vr").select("id", u.alias("u")).select("id", "u.*")


# responses of four dialects written from the requests' numbers, one in five without usage
@query("p21_response_usage", """WITH r AS (SELECT *, id % 4 AS v FROM vr WHERE id % 5 > 0) SELECT id, CASE WHEN v = 1 THEN in_tok ELSE greatest(0, in_tok - cr_tok) END AS input_uncached, CASE WHEN v = 1 THEN cw_tok ELSE 0 END AS cache_write, cr_tok AS cache_read, out_tok AS output, CASE WHEN v = 1 THEN 0 ELSE k END::BIGINT AS reasoning FROM r
 UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL FROM vr WHERE id % 5 = 0""")
def p21r(spark, d):
    one = lambda **kw: F.struct(*(c.alias(k) for k, c in kw.items()))
    col, part = F.col, F.col("id") % 4
    openai = one(model=col("model"), usage=one(prompt_tokens=col("in_tok"), completion_tokens=col("out_tok"), prompt_tokens_details=one(cached_tokens=col("cr_tok")), completion_tokens_details=one(reasoning_tokens=col("k"))))
    anthropic = one(model=col("model"), usage=one(input_tokens=col("in_tok"), output_tokens=col("out_tok"), cache_read_input_tokens=col("cr_tok"), cache_creation_input_tokens=col("cw_tok")))
    gemini = one(modelVersion=col("model"), usageMetadata=one(promptTokenCount=col("in_tok"), candidatesTokenCount=col("out_tok"), cachedContentTokenCount=col("cr_tok"), thoughtsTokenCount=col("k")))
    responses = one(type=F.lit("response.completed"), response=one(model=col("model"), usage=one(input_tokens=col("in_tok"), output_tokens=col("out_tok"), input_tokens_details=one(cached_tokens=col("cr_tok")), output_tokens_details=one(reasoning_tokens=col("k")))))
    dialect = F.when(part == 0, "openai").when(part == 1, "anthropic").when(part == 2, "gemini").otherwise("responses")
    body = F.when(col("id") % 5 == 0, "{}").when(part == 0, F.to_json(openai)).when(part == 1, F.to_json(anthropic)).when(part == 2, F.to_json(gemini)).otherwise(F.to_json(responses))
    rows = view(spark, d, "vr").select("id", cost.response_usage(dialect, body).alias("u"))
    return rows.select("id", "u.*")


@query("p22_merge_usage", "SELECT request_id, seq, coalesce(nullif(output % 3, 0), input, 0) AS output, coalesce(nullif(input % 2, 0), output, 0) AS input FROM vs")
def p22(spark, d):
    rows = view(spark, d, "vs").select("request_id", "seq", F.struct((F.col("output") % 3).alias("output"), (F.col("input") % 2).alias("input")).alias("a"), F.struct(F.col("input").alias("output"), F.col("output").alias("input")).alias("b"))
    return rows.select("request_id", "seq", cost.merge_usage("a", "b", ("output", "input")).alias("u")).select("request_id", "seq", "u.*")


# columns that VR lacks: reasoning and estimated tokens, characters of schemas and of the system text, whether a request was edited
def full(spark, d):
    k, more = F.col("k").cast("long"), {}
    more |= {"reasoning_tok": k, "est_in_tok": F.floor(F.col("value") * 120).cast("long"), "tool_spec_chars": 100 + k * 7, "sys_chars": 50 + k, "enforced": F.col("event_type") == "click"}
    return view(spark, d, "vr").withColumns(more)


_FULL = f"{PR}, fu AS (SELECT *, k::BIGINT AS reasoning_tok, floor(value * 120)::BIGINT AS est_in_tok, 100 + k * 7 AS tool_spec_chars, 50 + k AS sys_chars, event_type = 'click' AS enforced FROM pr)"


@query("a1_totals", f"WITH {_FULL} SELECT count(*) AS n, sum(in_tok)::BIGINT AS in_tok, sum(cw_tok)::BIGINT AS cw_tok, sum(cr_tok)::BIGINT AS cr_tok, sum(out_tok)::BIGINT AS out_tok, sum(latency_ms)::BIGINT AS latency_ms, sum(ttfb_ms)::BIGINT AS ttfb_ms, sum(reasoning_tok)::BIGINT AS reasoning_tok, sum(est_in_tok)::BIGINT AS est_in_tok, sum(tool_spec_chars)::BIGINT AS tool_spec_chars, sum(sys_chars)::BIGINT AS sys_chars, round(sum(cost_usd), 4) AS cost_usd, count(*) FILTER (status >= 400) AS errors FROM fu")
def a1(spark, d):
    return report.totals(full(spark, d))


@query("a2_by_model", f"WITH {PR}, m AS (SELECT model, count(*) AS n, sum(in_tok + cw_tok)::BIGINT AS fresh_in, sum(cr_tok)::BIGINT AS cached, sum(out_tok)::BIGINT AS out, round(sum(cost_usd), 4) AS cost, floor(sum(ttfb_ms) / count(*))::BIGINT AS mean_ttfb FROM pr GROUP BY 1) SELECT *, round(cached::DOUBLE / (fresh_in + cached), 4) AS hit_rate FROM m")
def a2(spark, d):
    return report.by_model(view(spark, d, "vr"))


@query("a3_by_client", f"WITH {PR} SELECT {CLIENT} AS client, count(*) AS n, round(sum(cost_usd), 4) AS cost FROM pr GROUP BY 1")
def a3(spark, d):
    return report.by_client(view(spark, d, "vr"))


@query("a4_by_day", f"WITH {PR} SELECT day, count(*) AS n, round(sum(cost_usd), 4) AS cost, sum(in_tok + cw_tok + cr_tok)::BIGINT AS in_tok, sum(out_tok)::BIGINT AS out_tok FROM pr GROUP BY 1")
def a4(spark, d):
    return report.by_day(view(spark, d, "vr"))


@query("a5_category_chars", "WITH k AS (SELECT unnest(['system', 'user', 'assistant', 'tool_result', 'assistant_tool_call']) AS kind), s AS (SELECT kind, sum(coalesce(length(text), 0)) AS c FROM vm GROUP BY 1), j AS (SELECT kind, coalesce(c, 0)::BIGINT AS chars FROM k FULL JOIN s USING (kind)) SELECT kind, chars, round(chars::DOUBLE / (SELECT sum(chars) FROM j), 4) AS share FROM j")
def a5(spark, d):
    return report.category_chars(view(spark, d, "vm"))


@query("a6_hit_rate", "SELECT id, round(cr_tok::DOUBLE / nullif(in_tok + cw_tok + cr_tok, 0), 4) AS hit_rate FROM vr")
def a6(spark, d):
    return view(spark, d, "vr").select("id", report.hit_rate(F.col("cr_tok"), F.col("in_tok"), F.col("cw_tok")).alias("hit_rate"))


@query("a7_decision_latency", "WITH t AS (SELECT latency_ms AS v FROM vr ORDER BY id DESC LIMIT 500), s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r, count(*) OVER () AS n FROM t) SELECT max(n) AS n, max(v) FILTER (r = least(n - 1, floor(n * 0.5))) AS p50, max(v) FILTER (r = least(n - 1, floor(n * 0.95))) AS p95, max(v) AS max, round(avg(v), 4) AS avg FROM s")
def a7(spark, d):
    return report.decision_latency(view(spark, d, "vr"))


@query("a8_slot_approval", "WITH s AS (SELECT slot, count(*) FILTER (verdict = 'good') AS good, count(*) FILTER (verdict = 'bad') AS bad, count(*) FILTER (verdict = 'uncertain') AS uncertain FROM vl GROUP BY 1) SELECT *, round(good::DOUBLE / nullif(good + bad, 0), 4) AS approval FROM s")
def a8(spark, d):
    return report.slot_approval(view(spark, d, "vl"))


_DECISIONS = "dec AS (SELECT session AS request_id, CASE WHEN id % 2 = 0 THEN 'compact' ELSE 'tool_gate' END AS slot, CASE WHEN k % 5 = 0 THEN NULL ELSE 'v' || (id % 3) END AS version, out_tok AS saved, latency_ms AS decision_ms, CASE id % 3 WHEN 0 THEN 'heuristic' WHEN 1 THEN 'model' END AS backend FROM vr)"


def decisions(spark, d):
    return view(spark, d, "vr").select(F.col("session").alias("request_id"), F.when(F.col("id") % 2 == 0, "compact").otherwise("tool_gate").alias("slot"), F.when(F.col("k") % 5 != 0, F.concat(F.lit("v"), (F.col("id") % 3).cast("string"))).alias("version"), F.col("out_tok").alias("saved"), F.col("latency_ms").alias("decision_ms"), F.when(F.col("id") % 3 == 0, "heuristic").when(F.col("id") % 3 == 1, "model").alias("backend"))


@query("a9_version_rollup", f"""WITH {_DECISIONS}, n AS (SELECT *, coalesce(version, 'unrecorded') AS v FROM dec),
 sl AS (SELECT v, string_agg(slot || '=' || c, ',' ORDER BY slot || '=' || c) AS slots FROM (SELECT v, slot, count(*) AS c FROM n GROUP BY ALL) GROUP BY 1),
 bk AS (SELECT v, string_agg(b || '=' || c, ',' ORDER BY b || '=' || c) AS backends FROM (SELECT v, coalesce(backend, '?') AS b, count(*) AS c FROM n GROUP BY ALL) GROUP BY 1),
 r AS (SELECT v, decision_ms, row_number() OVER (PARTITION BY v ORDER BY decision_ms) - 1 AS r, count(*) OVER (PARTITION BY v) AS n FROM n),
 p AS (SELECT v, max(decision_ms) FILTER (r = least(n - 1, floor(n * 0.5))) AS p50 FROM r GROUP BY 1),
 s AS (SELECT v, count(*) AS decisions, count(DISTINCT request_id) AS requests, sum(saved)::BIGINT AS saved FROM n GROUP BY 1),
 h AS (SELECT v, count(*) FILTER (verdict = 'good') AS good, count(*) FILTER (verdict = 'bad') AS bad, count(*) FILTER (verdict = 'uncertain') AS uncertain FROM n JOIN vl USING (request_id, slot) GROUP BY 1)
 SELECT v AS version, decisions, requests, saved, slots, backends, p50, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, coalesce(uncertain, 0) AS uncertain, round(good::DOUBLE / nullif(good + bad, 0), 4) AS approval
 FROM s JOIN sl USING (v) JOIN bk USING (v) JOIN p USING (v) LEFT JOIN h USING (v)""")
def a9(spark, d):
    return report.version_rollup(decisions(spark, d), view(spark, d, "vl"))


@query("a10_cache_headroom", f"WITH m AS (SELECT model, sum(in_tok + cw_tok)::BIGINT AS fresh, sum(cr_tok)::BIGINT AS cached, CASE WHEN contains(model, 'claude') THEN 0.85::DOUBLE WHEN contains(model, 'gpt') OR contains(model, 'gemini') THEN 0.6::DOUBLE END AS target FROM vr GROUP BY 1), r AS (SELECT *, cached::DOUBLE / (fresh + cached) AS rate FROM m WHERE target IS NOT NULL), q AS (SELECT *, floor(fresh * (target - rate))::BIGINT AS reclaim_tok FROM r WHERE rate < target) SELECT model, fresh, cached, round(rate, 4) AS hit_rate, target, reclaim_tok, round(reclaim_tok * (price_in - price_cached) / 1e6, 4) AS usd FROM (SELECT *, {P} FROM q)")
def a10(spark, d):
    return report.cache_headroom(view(spark, d, "vr"))


@query("a11_slot_headroom", f"""WITH {_FULL}, t AS (SELECT greatest(1, count(*)) AS n, greatest(1, sum(est_in_tok)) AS est, floor(sum(tool_spec_chars) / 3.6::DOUBLE)::BIGINT AS tools FROM fu),
 c AS (SELECT floor(coalesce(sum(length(text)) FILTER (kind = 'tool_result'), 0) / 3.6::DOUBLE)::BIGINT AS results FROM vm),
 s AS (SELECT 'tool_gate' AS slot, tools AS tok, n, est FROM t UNION ALL SELECT 'compact', results, n, est FROM t, c)
 SELECT slot, tok AS est_tok_total, floor(tok::DOUBLE / n)::BIGINT AS est_tok_per_req, round(tok::DOUBLE / est, 3) AS share_of_input FROM s""")
def a11(spark, d):
    return report.slot_headroom(report.totals(full(spark, d)), report.category_chars(view(spark, d, "vm")))


# a request offers up to four tools, by its number, with schemas of as many characters as their names say
def offered(spark, d):
    r = F.col("request_id")
    rows = view(spark, d, "vm").select("request_id").distinct().select("request_id", F.explode(F.sequence(F.lit(0), r % 4)).alias("pos")).where("pos > 0")
    return rows.select("request_id", "pos", F.when(F.col("pos") != 2, F.concat(F.lit("tool_"), F.col("pos").cast("string"))).alias("name"), (F.col("pos") * 37 + r % 10).alias("chars"))


_OFFERED = "tl AS (SELECT request_id, pos, CASE WHEN pos <> 2 THEN 'tool_' || pos END AS name, pos * 37 + request_id % 10 AS chars FROM (SELECT DISTINCT request_id FROM vm) r, range(1, 4) AS p(pos) WHERE pos <= request_id % 4)"


@query("a12_request_features", f"""WITH {_OFFERED}, k AS (SELECT request_id, kind, count(*) AS c, sum(coalesce(length(text), 0))::BIGINT AS chars FROM vm GROUP BY ALL),
 s AS (SELECT request_id, sum(c)::BIGINT AS msg_count, sum(CASE WHEN kind = 'user' THEN c ELSE 0 END)::BIGINT AS user_turns, sum(CASE WHEN chars = 0 THEN 0 ELSE greatest(1, floor(chars / 3.6 + 0.5)) END)::BIGINT AS est, string_agg(kind || ':' || chars, ',' ORDER BY kind) AS cat_chars, sum(CASE WHEN kind = 'system' THEN chars ELSE 0 END)::BIGINT AS sys_chars FROM k GROUP BY 1),
 t AS (SELECT request_id, right(string_agg(coalesce(text, ''), chr(10) ORDER BY idx), 300) AS tail, array_to_string(list_transform(flatten(list(regexp_extract_all(coalesce(text, ''), '([A-Za-z0-9_./-]+\\.(?:{text.EXTENSIONS}))(?:[^A-Za-z0-9_]|$)', 1) ORDER BY idx)), lambda x: lower(x)), ',') AS paths FROM vm GROUP BY 1),
 g AS (SELECT request_id, string_agg(kind || ':' || a, ';' ORDER BY kind) AS ages FROM (SELECT request_id, kind, string_agg(age, ',' ORDER BY idx) AS a FROM (SELECT request_id, kind, idx, round_even(row_number() OVER (PARTITION BY request_id ORDER BY idx)::DOUBLE / count(*) OVER (PARTITION BY request_id), 3)::VARCHAR AS age FROM vm) GROUP BY ALL) GROUP BY 1),
 o AS (SELECT request_id, sum(chars)::BIGINT AS chars, string_agg(name, ',' ORDER BY pos) AS names, count(name) AS c FROM tl GROUP BY 1)
 SELECT request_id, msg_count, user_turns, cat_chars, sys_chars, tail, coalesce(chars, 0) AS tool_spec_chars, coalesce(names, '') AS tool_names, coalesce(c, 0) AS tool_count, est + CASE WHEN coalesce(chars, 0) = 0 THEN 0 ELSE greatest(1, floor(chars / 3.6 + 0.5))::BIGINT END AS est_in_tok, ages, paths
 FROM s JOIN t USING (request_id) JOIN g USING (request_id) LEFT JOIN o USING (request_id)""")
def a12(spark, d):
    f = report.request_features(view(spark, d, "vm"), 300, offered(spark, d), ages=True)
    pairs = lambda column, value, sep: F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat_ws(":", e["key"], value(e["value"]))), sep)
    shown = {"cat_chars": pairs("cat_chars", lambda v: v.cast("string"), ","), "tool_names": F.array_join("tool_names", ","), "paths": F.array_join("paths", ",")}
    return f.withColumns(shown).withColumn("ages", pairs("hist_age_rank", lambda v: F.array_join(v.cast("array<string>"), ","), ";")).drop("hist_age_rank")


@query("a16_set_scores", "SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality <> 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic <> 0) AS fn, round(count(*) FILTER (quality = 1 AND toxic = 0)::DOUBLE / count(*) FILTER (toxic = 0), 4) AS precision, round(count(*) FILTER (quality = 1 AND toxic = 0)::DOUBLE / count(*) FILTER (quality = 1), 4) AS recall, round(2 * count(*) FILTER (quality = 1 AND toxic = 0)::DOUBLE / (count(*) FILTER (quality = 1) + count(*) FILTER (toxic = 0)), 4) AS f1 FROM vl")
def a16(spark, d):
    v = view(spark, d, "vl")
    return evaluate.set_scores(v.where("quality = 1"), v.where("toxic = 0"), ["request_id"])


@query("a18_corpus_ceiling", "WITH c AS (SELECT request_id // 20 AS case_id, count(*) FILTER (toxic = 0 AND quality <> 1) AS keeps, count(*) FILTER (quality = 1 AND toxic <> 0) AS cuts FROM vl GROUP BY 1) SELECT count(*) AS cases, count(*) FILTER (keeps = 0 AND cuts = 0) AS equal, sum(keeps)::BIGINT AS false_keeps, sum(cuts)::BIGINT AS false_cuts FROM c")
def a18(spark, d):
    return evaluate.corpus_ceiling(view(spark, d, "vl").select(F.expr("request_id div 20").alias("case_id"), F.col("request_id").alias("item"), (F.col("quality") == 1).alias("gold"), (F.col("toxic") == 0).alias("baseline")))


@query("a19_survival", f"WITH i AS (SELECT request_id AS task, {TOK('text')} AS t, idx % 2 = 0 AS needed, kind <> 'tool_result' AS kept FROM vm) SELECT task, round(coalesce(sum(CASE WHEN needed AND kept THEN t ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN needed THEN t ELSE 0 END), 0), 1.0), 4) AS recall, round(coalesce(sum(CASE WHEN needed AND kept THEN t ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN kept THEN t ELSE 0 END), 0), 1.0), 4) AS precision, count(*) FILTER (needed AND NOT kept) = 0 AS passed FROM i GROUP BY 1")
def a19(spark, d):
    return evaluate.survival(view(spark, d, "vm").select(F.col("request_id").alias("task"), text.approx_tokens(F.col("text")).alias("tokens"), (F.col("idx") % 2 == 0).alias("needed"), (F.col("kind") != "tool_result").alias("kept")))


@query("a20_arm_summary", "WITH s AS (SELECT count(*) AS n, round(avg(observe), 2) AS mean_base, round(avg(enforce), 2) AS mean_other, round(avg((observe - enforce)::DOUBLE / observe), 6) AS mean_of_ratios, round((sum(observe) - sum(enforce))::DOUBLE / sum(observe), 6) AS ratio_of_sums, round(avg(pa), 4) AS pass_rate, round(avg(pa - pb), 4) AS pass_delta, coalesce(stddev_samp(pa - pb) / sqrt(count(*)) * 1.96, 0.0) AS half, quantile_cont(observe, 0.5) AS p50_base, quantile_cont(enforce, 0.5) AS p50_other FROM (SELECT *, pass::INTEGER AS pa, (task % 3 > 0)::INTEGER AS pb FROM va)) SELECT * EXCLUDE (half), round(pass_delta - half, 4) AS delta_low, round(pass_delta + half, 4) AS delta_high, CASE WHEN n = 0 THEN 'no pairs' WHEN ratio_of_sums < 0.02 THEN 'cut too small' ELSE '' END AS reasons, n > 0 AND ratio_of_sums >= 0.02 AS passed FROM s")
def a20(spark, d):
    return evaluate.arm_summary(view(spark, d, "va").withColumn("pass_base", F.col("task") % 3 > 0).withColumn("pass_other", F.col("pass")))


@query("a21_cut_by_family", "SELECT family, count(*) AS n, round(avg(observe), 2) AS mean_base, round(avg(enforce), 2) AS mean_other, round((sum(observe) - sum(enforce))::DOUBLE / sum(observe), 6) AS cut FROM va GROUP BY 1")
def a21(spark, d):
    return evaluate.cut_by_family(view(spark, d, "va"))


@query("a22_cut_by_quartile", "WITH r AS (SELECT *, row_number() OVER (ORDER BY observe, task) - 1 AS r, count(*) OVER () AS n FROM va) SELECT ((r >= n // 4)::INTEGER + (r >= n * 2 // 4)::INTEGER + (r >= n * 3 // 4)::INTEGER) AS quarter, count(*) AS tasks, min(observe) AS low, max(observe) AS high, round((sum(observe) - sum(enforce))::DOUBLE / sum(observe), 6) AS cut FROM r GROUP BY 1")
def a22(spark, d):
    return evaluate.cut_by_quartile(view(spark, d, "va"))


@query("a23_composition", f"WITH p AS (SELECT request_id, kind AS part, {TOK('text')} AS t FROM vm) SELECT part, round(sum(t)::DOUBLE / (SELECT count(DISTINCT request_id) FROM p) * (1000.0 / ((SELECT sum(t) FROM p)::DOUBLE / (SELECT count(DISTINCT request_id) FROM p))), 4) AS mean_tokens FROM p GROUP BY 1")
def a23(spark, d):
    return evaluate.composition(view(spark, d, "vm").select(F.col("request_id").alias("task"), F.col("kind").alias("part"), text.approx_tokens(F.col("text")).alias("tokens")), 1000.0)


@query("a27_latency_curve", "WITH s AS (SELECT latency_ms AS v, row_number() OVER (ORDER BY latency_ms) - 1 AS r, count(*) OVER () AS n FROM vr) SELECT max(n) AS n, max(v) FILTER (r = n // 2) AS p50, max(v) FILTER (r = floor(n * 0.95) - 1) AS p95, max(v) AS max, round(avg(v), 4) AS avg, max(v) FILTER (r = floor(n * 0.95) - 1) <= 350 AS fits FROM s")
def a27(spark, d):
    return report.latency_curve(view(spark, d, "vr"), 350)


@query("a28_savings_snapshot", f"""WITH {_FULL}, t AS (SELECT count(*) AS n, sum(in_tok + cw_tok)::BIGINT AS in_tok, sum(cost_usd) AS cost, sum(est_in_tok)::BIGINT AS est FROM fu),
 r AS (SELECT sum(k)::BIGINT AS saved, bool_or(enforced) AS e FROM (SELECT * FROM fu ORDER BY id DESC LIMIT 2000))
 SELECT n, in_tok, round(cost, 4) AS cost_usd, saved AS saved_tok, round(100 * (saved::DOUBLE / est), 4) AS saved_pct, est AS denom_tok, round(greatest(0, cost - cost * (saved::DOUBLE / est)), 4) AS after_usd, CASE WHEN e THEN 'delivered' ELSE 'potential' END AS mode FROM t, r""")
def a28(spark, d):
    return report.savings_snapshot(full(spark, d), F.col("k"), F.col("enforced"))


_W = " + ".join(f"(u > {sum(0.36787944117144233 / math.factorial(j) for j in range(k + 1))!r}::DOUBLE)::INTEGER" for k in range(7))


@query("a30_bootstrap", f"""WITH g AS (SELECT task, observe, b, md5('11|' || task || '|' || b) AS h FROM va, range(25) r(b)),
 u AS (SELECT b, i, observe, (('0x' || substr(h, 8 * i::INTEGER + 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0 AS u FROM g, range(4) s(i)),
 m AS (SELECT b, i, round(sum(w * observe)::DOUBLE / sum(w), 6) AS m FROM (SELECT *, {_W} AS w FROM u) GROUP BY ALL),
 r AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS r FROM m) SELECT 100 AS draws, max(m) FILTER (r = 2) AS low, max(m) FILTER (r = 97) AS high FROM r""")
def a30(spark, d):
    return evaluate.bootstrap_interval(view(spark, d, "va"), "task", "observe", 100)


@query("w1_newest", "SELECT id, model FROM vr ORDER BY id DESC LIMIT 50")
def w1(spark, d):
    return report.newest(view(spark, d, "vr"), 50).select("id", "model")


@query("w2_percentiles_by_model", "WITH s AS (SELECT model, latency_ms AS v, row_number() OVER (PARTITION BY model ORDER BY latency_ms) - 1 AS r, count(*) OVER (PARTITION BY model) AS n FROM vr) SELECT model, max(n) AS n, max(v) FILTER (r = least(n - 1, floor(n * 0.5))) AS p50, max(v) FILTER (r = least(n - 1, floor(n * 0.95))) AS p95, max(v) AS max, round(avg(v), 4) AS avg FROM s GROUP BY 1")
def w2(spark, d):
    return report.exact_percentiles(view(spark, d, "vr"), "latency_ms", {"p50": report.at_share(0.5), "p95": report.at_share(0.95)}, ["model"])


@query("w11_age_ranks", "SELECT request_id, idx, round(row_number() OVER (PARTITION BY request_id ORDER BY idx)::DOUBLE / count(*) OVER (PARTITION BY request_id), 6) AS age_rank FROM vm")
def w11(spark, d):
    return report.age_ranks(view(spark, d, "vm")).select("request_id", "idx", "age_rank")


@query("w16_prefix_reuse", """WITH l AS (SELECT request_id, idx, coalesce(text, '') AS a, coalesce(lag(text) OVER (PARTITION BY request_id ORDER BY idx), '') AS b FROM vm)
 SELECT request_id, idx, (coalesce(list_position(list_transform(range(1, least(length(a), length(b)) + 1), lambda i: a[i] <> b[i]), true), least(length(a), length(b)) + 1) - 1)::BIGINT AS reused FROM l""")
def w16(spark, d):
    return jobs.prefix_reuse(view(spark, d, "vm"))


@query("j13_paired_arms", "SELECT task, observe, enforce, compiled FROM va")
def j13(spark, d):
    long = view(spark, d, "va").select("task", F.inline(F.array(*(F.struct(F.lit(a).alias("arm"), F.col(a).alias("value")) for a in ("observe", "enforce", "compiled")))))
    return evaluate.paired_arms(long, ["observe", "enforce", "compiled"])


@query("j12_w12_backend_ranking", "WITH e AS (SELECT model AS label, round(avg((status = 200)::INTEGER), 3) AS precision, max(latency_ms)::DOUBLE AS latency_ms FROM vr GROUP BY 1) SELECT label, precision, latency_ms, row_number() OVER (ORDER BY precision DESC, latency_ms, label) AS rank FROM e WHERE latency_ms <= 1e9")
def j12(spark, d):
    e = view(spark, d, "vr").groupBy(F.col("model").alias("label")).agg(F.round(F.avg((F.col("status") == 200).cast("int")), 3).alias("precision"), F.max("latency_ms").cast("double").alias("latency_ms"))
    return evaluate.rank_backends(e, None, 1e9)


@query("t1_live_by_day", SQL["a4_by_day"])
def t1(spark, d):
    return jobs.live_by_day(view(spark, d, "vr"))


@query("t2_frame_usage", "SELECT request_id, coalesce(arg_min(input, seq) FILTER (type = 'message_start'), 0) AS input, coalesce(arg_max(output, seq) FILTER (type = 'message_delta' AND output <> 0), 0) AS output FROM vs GROUP BY 1")
def t2(spark, d):
    return jobs.frame_usage(view(spark, d, "vs"))


@query("t5_reassembled", "WITH w AS (SELECT request_id, string_agg(type || ':' || output || repeat(chr(10), 1 + (seq % 2)::INTEGER), '' ORDER BY seq) AS a FROM vs GROUP BY 1), f AS (SELECT request_id, list_filter(string_split(a, chr(10) || chr(10)), lambda x: trim(x, chr(10) || ' ') <> '') AS l FROM w) SELECT request_id, generate_subscripts(l, 1) - 1 AS seq, unnest(l) AS frame FROM f")
def t5(spark, d):
    chunks = view(spark, d, "vs").select("request_id", "seq", F.concat("type", F.lit(":"), F.col("output").cast("string"), F.expr("repeat('\n', cast(1 + seq % 2 as int))")).alias("payload"))
    return jobs.reassembled(chunks)


@query("t6_late_rows", "SELECT id, coalesce(max(ts_epoch) OVER (PARTITION BY session ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - ts_epoch > 3600, false) AS late FROM vr")
def t6(spark, d):
    return jobs.on_time(view(spark, d, "vr"), 3600).select("id", "late")
