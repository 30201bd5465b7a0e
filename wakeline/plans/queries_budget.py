"""Queries over VM, VF, VQ, VL and VP: budgets, the file index, labels and data sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import budget, dataset, evaluate, index, labels
from ..sources import logs
from .queries_report import MARKER, OPENING, TERMS, TOK
from .views import view

QUERIES, SQL = {}, {}
BUDGET = 800


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# ---- messages under a budget ------------------------------------------------------------------

_SC = rf"""n0 AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS n, row_number() OVER (PARTITION BY request_id ORDER BY idx) - 1 AS i, {TOK('text')} AS tokens FROM vm),
sc AS (SELECT *, i >= n - 4 AS tail, CASE WHEN i >= n - 4 THEN 1.0 ELSE round(greatest(0.0, least(1.0, 0.5 + (CASE WHEN kind IN ('user', 'system') THEN 0.6::DOUBLE ELSE 0 END
 + CASE WHEN regexp_matches(text, '(?i){MARKER}') THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(text, '(?i){OPENING}') THEN 0.3::DOUBLE ELSE 0 END
 - CASE WHEN kind = 'tool_result' THEN 0.25::DOUBLE ELSE 0 END + 0.35::DOUBLE * (i::DOUBLE / greatest(1, n - 1))) / 2)), 3) END AS score FROM n0)"""


def scored(spark, d):
    return budget.message_scores(view(spark, d, "vm"), error=f"(?i){MARKER}", diff=f"(?i){OPENING}", anchor="(?i)no such anchor")


@query("p11_w5_message_scores", f"WITH {_SC} SELECT request_id, idx, tokens, tail, score::DOUBLE AS score FROM sc")
def p11(spark, d):
    return scored(spark, d).select("request_id", "idx", "tokens", "tail", "score")


@query("k1_recency_compaction", f"""WITH RECURSIVE {_SC}, o AS (SELECT request_id, idx, tokens, tail, n - i AS step FROM sc),
 f AS (SELECT request_id, 0::BIGINT AS step, 0::BIGINT AS spent, NULL::BIGINT AS idx, NULL::BOOLEAN AS keep FROM (SELECT DISTINCT request_id FROM o)
 UNION ALL SELECT o.request_id, o.step, f.spent + CASE WHEN o.tail OR f.spent + o.tokens <= {BUDGET} THEN o.tokens ELSE 0 END, o.idx, o.tail OR f.spent + o.tokens <= {BUDGET} FROM f JOIN o ON o.request_id = f.request_id AND o.step = f.step + 1)
 SELECT request_id, idx, keep FROM f WHERE idx IS NOT NULL""")
def k1(spark, d):
    return budget.recency_compaction(scored(spark, d), F.lit(BUDGET))


@query("a13_slot_audit", f"""WITH RECURSIVE {_SC}, o AS (SELECT request_id, idx, tokens, tail, n - i AS step FROM sc),
 f AS (SELECT request_id, 0::BIGINT AS step, 0::BIGINT AS spent, NULL::BIGINT AS tokens, NULL::BOOLEAN AS keep FROM (SELECT DISTINCT request_id FROM o)
 UNION ALL SELECT o.request_id, o.step, f.spent + CASE WHEN o.tail OR f.spent + o.tokens <= {BUDGET} THEN o.tokens ELSE 0 END, o.tokens, o.tail OR f.spent + o.tokens <= {BUDGET} FROM f JOIN o ON o.request_id = f.request_id AND o.step = f.step + 1)
 SELECT count(*) AS decisions, count(*) FILTER (NOT keep) AS would_drop, sum(CASE WHEN NOT keep THEN tokens ELSE 0 END)::BIGINT AS saved_tok, round(sum(CASE WHEN NOT keep THEN tokens ELSE 0 END)::DOUBLE / sum(tokens), 4) AS saved_share FROM f WHERE keep IS NOT NULL""")
def a13(spark, d):
    rows = scored(spark, d)
    j = budget.recency_compaction(rows, F.lit(BUDGET)).join(rows.select("request_id", "idx", "tokens"), ["request_id", "idx"])
    cut = F.sum(F.when(~F.col("keep"), F.col("tokens")).otherwise(0))
    return j.agg(F.count("*").alias("decisions"), F.count_if(~F.col("keep")).alias("would_drop"), cut.alias("saved_tok"), F.round(cut.cast("double") / F.sum("tokens"), 4).alias("saved_share"))


def pool(spark, d):
    rows = scored(spark, d)
    return rows.select("request_id", F.lit("message").alias("kind"), F.lpad(F.col("idx").cast("string"), 4, "0").alias("id"), "idx", "tokens", F.col("score").alias("value"), (F.col("i") >= F.col("n") - 1).alias("protected"))


_POOL = f"pool AS (SELECT request_id, lpad(idx::VARCHAR, 4, '0') AS id, idx, tokens, score AS value, i >= n - 1 AS protected, CASE WHEN tokens <= 0 THEN 'infinity'::DOUBLE ELSE score / tokens END AS ratio FROM sc)"
_PLAN = f"""{_SC}, {_POOL}, pt AS (SELECT request_id, sum(CASE WHEN protected THEN tokens ELSE 0 END)::BIGINT AS p, sum(tokens)::BIGINT AS before FROM pool GROUP BY 1),
 o AS (SELECT pool.*, row_number() OVER (PARTITION BY request_id ORDER BY ratio DESC, value DESC, id) AS step FROM pool WHERE NOT protected),
 f AS (SELECT request_id, 0::BIGINT AS step, {BUDGET} - p AS rest, NULL::VARCHAR AS id, NULL::BIGINT AS tokens, NULL::DOUBLE AS ratio, NULL::BOOLEAN AS keep FROM pt WHERE p <= {BUDGET}
 UNION ALL SELECT o.request_id, o.step, f.rest - CASE WHEN o.tokens <= f.rest THEN o.tokens ELSE 0 END, o.id, o.tokens, o.ratio, o.tokens <= f.rest FROM f JOIN o ON o.request_id = f.request_id AND o.step = f.step + 1),
 g AS (SELECT request_id, min(ratio) FILTER (keep) AS floor, min(rest) AS rest FROM f GROUP BY 1)"""


def plan(spark, d):
    return budget.joint_plan(pool(spark, d), F.lit(BUDGET))


@query("k2_joint_plan", f"WITH RECURSIVE {_PLAN} SELECT p.request_id, p.id, CASE WHEN pt.p > {BUDGET} THEN CASE WHEN p.protected THEN true END ELSE p.protected OR coalesce(f.keep, false) END AS keep FROM pool p JOIN pt USING (request_id) LEFT JOIN f ON f.request_id = p.request_id AND f.id = p.id")
def k2(spark, d):
    return plan(spark, d).select("request_id", "id", "keep")


@query("a31_budget_totals", f"WITH RECURSIVE {_PLAN}, k AS (SELECT request_id, sum(CASE WHEN keep THEN tokens ELSE 0 END)::BIGINT AS t, count(*) FILTER (NOT keep) AS dr FROM f GROUP BY 1) SELECT pt.request_id, {BUDGET}::BIGINT AS budget, p > {BUDGET} AS over_budget, p AS protected_tokens, before AS tokens_before, CASE WHEN p > {BUDGET} THEN p ELSE p + coalesce(t, 0) END AS tokens_after, coalesce(dr, 0) AS n_dropped FROM pt LEFT JOIN k USING (request_id)")
def a31(spark, d):
    return budget.budget_totals(plan(spark, d))


@query("k5_drop_reasons", f"WITH RECURSIVE {_PLAN} SELECT f.request_id, f.id, CASE WHEN floor IS NULL THEN 'none' WHEN ratio >= floor THEN 'does not fit' ELSE 'below floor' END AS why FROM f JOIN g USING (request_id) WHERE NOT keep")
def k5(spark, d):
    why = F.when(F.col("reason") == "nothing was competitive", "none").when(F.contains("reason", F.lit("does not fit")), "does not fit").otherwise("below floor")
    return budget.drop_reasons(plan(spark, d)).select("request_id", "id", why.alias("why"))


@query("k6_slot_records", f"WITH RECURSIVE {_PLAN}, a AS (SELECT p.request_id, p.tokens, CASE WHEN pt.p > {BUDGET} THEN CASE WHEN p.protected THEN true END ELSE p.protected OR coalesce(f.keep, false) END AS keep FROM pool p JOIN pt USING (request_id) LEFT JOIN f ON f.request_id = p.request_id AND f.id = p.id) SELECT request_id, 'message' AS kind, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS dropped, sum(CASE WHEN NOT keep THEN tokens ELSE 0 END)::BIGINT AS saved_tok FROM a GROUP BY 1")
def k6(spark, d):
    return budget.slot_records(plan(spark, d))


@query("k8_apply_plan", f"""WITH RECURSIVE {_SC}, o AS (SELECT request_id, idx, tokens, tail, n - i AS step FROM sc),
 f AS (SELECT request_id, 0::BIGINT AS step, 0::BIGINT AS spent, NULL::BIGINT AS idx, NULL::BOOLEAN AS keep FROM (SELECT DISTINCT request_id FROM o)
 UNION ALL SELECT o.request_id, o.step, f.spent + CASE WHEN o.tail OR f.spent + o.tokens <= {BUDGET} THEN o.tokens ELSE 0 END, o.idx, o.tail OR f.spent + o.tokens <= {BUDGET} FROM f JOIN o ON o.request_id = f.request_id AND o.step = f.step + 1),
 kept AS (SELECT vm.request_id, vm.idx, vm.kind FROM vm JOIN f ON f.request_id = vm.request_id AND f.idx = vm.idx AND f.keep)
 SELECT request_id, idx, kind FROM kept UNION ALL SELECT request_id, max(idx) + 1, 'note' FROM kept WHERE request_id IN (SELECT request_id FROM f WHERE NOT keep) GROUP BY 1""")
def k8(spark, d):
    drop = budget.recency_compaction(scored(spark, d), F.lit(BUDGET)).where("not keep")
    return budget.apply_plan(view(spark, d, "vm"), drop, "some earlier turns were left out").select("request_id", "idx", "kind")


@query("k4_default_budget", f"WITH s AS (SELECT request_id, sum({TOK('text')})::BIGINT AS est, count(*) AS n FROM vm GROUP BY 1) SELECT request_id, greatest(300, floor(est * 0.45::DOUBLE))::BIGINT AS budget, est > 800 AND n > 5 AS gate FROM s")
def k4(spark, d):
    s = view(spark, d, "vm").groupBy("request_id").agg(F.sum(text.approx_tokens(F.col("text"))).alias("est"), F.count("*").alias("n"))
    return s.select("request_id", F.greatest(F.lit(300), F.floor(F.col("est") * budget.TARGET_FRACTION)).cast("long").alias("budget"), budget.compact_gate(F.col("est"), F.col("n"), 800, 5).alias("gate"))


@query("w8_book_evidence", f"""WITH RECURSIVE {_SC}, {_POOL}, ev AS (SELECT *, (length(id) * 7 + idx * 3 + request_id) % 5 AS evidence, floor({BUDGET} * 0.6)::BIGINT AS cap, sum(CASE WHEN protected THEN tokens ELSE 0 END) OVER (PARTITION BY request_id)::BIGINT AS p FROM pool),
 b AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY evidence DESC, idx) AS r FROM ev WHERE evidence > 0),
 f AS (SELECT DISTINCT request_id, 0::BIGINT AS r, p AS used, NULL::VARCHAR AS id, false AS take FROM ev
 UNION ALL SELECT b.request_id, b.r, f.used + CASE WHEN NOT b.protected AND f.used + b.tokens <= b.cap THEN b.tokens ELSE 0 END, b.id, NOT b.protected AND f.used + b.tokens <= b.cap FROM f JOIN b ON b.request_id = f.request_id AND b.r = f.r + 1 AND b.r <= 3)
 SELECT ev.request_id, ev.id, ev.protected OR coalesce(f.take, false) AS protected FROM ev LEFT JOIN f ON f.request_id = ev.request_id AND f.id = ev.id""")
def w8(spark, d):
    rows = pool(spark, d).withColumn("evidence", (F.length("id") * 7 + F.col("idx") * 3 + F.col("request_id")) % 5)
    return budget.book_evidence(rows, F.lit(BUDGET)).select("request_id", "id", "protected")


@query("w6_last_user", "WITH l AS (SELECT request_id, coalesce(arg_max(text, idx) FILTER (kind = 'user'), arg_max(text, idx)) AS t FROM vm GROUP BY 1) SELECT request_id, md5(t) AS last_user FROM l")
def w6(spark, d):
    return view(spark, d, "vm").groupBy("request_id").agg(F.md5(F.coalesce(F.max_by("text", F.when(F.col("kind") == "user", F.col("idx"))), F.max_by("text", "idx"))).alias("last_user"))


HEAVY_WORD, SLIGHT = r"(?i) (?:the|that|der|und|les|que)[ .,]", r"(?i)^(?:in|that|der|le) "


@query("p14_effort", f"""WITH s AS (SELECT request_id, sum(CASE WHEN kind = 'user' THEN 1 ELSE 0 END) AS u, sum({TOK('text')})::BIGINT * 60 AS est, count(*) FILTER (length(text) > 150) AS n_paths, sum(CASE WHEN kind <> 'user' THEN length(text) ELSE 0 END) * 40 AS tool, coalesce(arg_max(text, idx) FILTER (kind = 'user'), '') AS t FROM vm GROUP BY 1),
 h AS (SELECT *, len(regexp_extract_all(t, '{HEAVY_WORD}')) AS heavy, regexp_matches(t, '{SLIGHT}') AND n_paths < 3 AS trivial FROM s),
 e AS (SELECT *, CASE WHEN heavy >= 2 THEN 2 ELSE 0 END + CASE WHEN n_paths >= 3 THEN 1 ELSE 0 END + CASE WHEN est > 24000 THEN 1 ELSE 0 END + CASE WHEN tool > 40000 THEN 1 ELSE 0 END - CASE WHEN trivial THEN 3 ELSE 0 END - CASE WHEN u <= 1 AND heavy = 0 THEN 1 ELSE 0 END AS sc FROM h)
 SELECT request_id, heavy, sc AS effort_score, CASE WHEN sc <= -1 THEN 'low' WHEN sc >= 2 THEN 'high' ELSE 'medium' END AS tier, sc <= -1 AND n_paths < 3 AND est < 16000 AS small_model_ok FROM e""")
def p14(spark, d):
    user, size = F.col("kind") == "user", F.length("text")
    s = view(spark, d, "vm").groupBy("request_id").agg(
        F.count_if(user).alias("user_turns"), (F.sum(text.approx_tokens(F.col("text"))) * 60).alias("est_in_tok"), F.count_if(size > 150).alias("n_paths"),
        (F.sum(F.when(user, 0).otherwise(size)) * 40).alias("tool_chars"), F.max_by("text", F.when(user, F.col("idx"))).alias("last_user_text"),
    )
    return budget.effort(s, HEAVY_WORD, SLIGHT).select("request_id", "heavy", "effort_score", "tier", "small_model_ok")


# ---- tools, files and search ------------------------------------------------------------------

_TOOLS = f"""qt AS (SELECT item_id, list_distinct({TERMS('text')})[1:60] AS q0, {TERMS('text')} AS q FROM vq),
 tl AS (SELECT doc_id, item_id, CASE WHEN doc_id % 9 = 0 THEN 'read_' ELSE 'tool_' END || doc_id AS name, list_distinct(list_transform(regexp_extract_all(src, '[A-Za-z]{{3,}}'), lambda x: lower(x))) AS terms, floor(length(src) / 3.6)::BIGINT AS tokens, q FROM vf JOIN qt ON doc_id % (SELECT max(item_id) + 1 FROM vq) = item_id),
 tg AS (SELECT item_id, doc_id, name, tokens, len(list_intersect(list_distinct(q), terms)) AS hits, contains(name, 'read') AS core, len(list_intersect(list_distinct(q), terms)) / greatest(1.0::DOUBLE, least(len(terms), 12)) AS s FROM tl)"""


def with_item(files, items):
    """Every document with one of the items in turn: item ids run from 0 to the largest."""
    most = items.agg((F.max("item_id") + 1).alias("_n"))
    return files.join(F.broadcast(most)).withColumn("item_id", F.col("doc_id") % F.col("_n")).drop("_n")


def tools(spark, d):
    q = view(spark, d, "vq").select("item_id", text.lexical_tokens(F.col("text"), 120).alias("query_terms"))
    f = with_item(view(spark, d, "vf"), view(spark, d, "vq")).select("doc_id", "item_id", F.concat(F.when(F.col("doc_id") % 9 == 0, "read_").otherwise("tool_"), F.col("doc_id").cast("string")).alias("name"), F.transform(F.regexp_extract_all("src", F.lit("[A-Za-z]{3,}"), F.lit(0)), F.lower).alias("terms"), F.floor(F.length("src") / 3.6).alias("tokens"))
    return f.join(q, "item_id").withColumnRenamed("item_id", "request_id").withColumn("pos", F.col("doc_id"))


@query("p12_tool_scores", f"WITH {_TOOLS} SELECT item_id, doc_id, core, round(s, 3) AS score, core OR s > 0.4 AS keep FROM tg")
def p12(spark, d):
    return budget.tool_scores(tools(spark, d), 0.4).select(F.col("request_id").alias("item_id"), "doc_id", "core", "score", "keep")


@query("p13_core_floor", f"WITH {_TOOLS}, k AS (SELECT *, core OR s > 0.4 AS keep FROM tg), r AS (SELECT *, sum(keep::INTEGER) OVER (PARTITION BY item_id) AS n, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 3) DESC, doc_id) AS r FROM k) SELECT item_id, doc_id, keep OR (n < 6 AND r <= 6) AS keep FROM r")
def p13(spark, d):
    return budget.core_floor(budget.tool_scores(tools(spark, d), 0.4)).select(F.col("request_id").alias("item_id"), "doc_id", "keep")


@query("p18_k10_option_scores", """WITH o AS (SELECT DISTINCT item_id, vq.text AS state, source || '_' || lang || '_' || ['the', 'read', 'thand', 'edit_ting'][(doc_id % 4 + 1)::INTEGER] AS option FROM vq JOIN documents ON doc_id % (SELECT max(item_id) + 1 FROM vq) = item_id),
 t AS (SELECT *, list_distinct(list_concat(list_transform(regexp_extract_all(replace(lower(option), '_', ' '), '[A-Za-z]{3,}'), lambda x: lower(x)), list_filter(string_split_regex(lower(option), '[^a-z0-9]+'), lambda x: length(x) >= 3))) AS terms, list_distinct(list_transform(regexp_extract_all(state, '[A-Za-z]{3,}'), lambda x: lower(x))) AS q FROM o),
 p AS (SELECT item_id, option, 0.05 + 0.9 * tanh(len(list_intersect(q, terms)) / greatest(1, least(len(terms), 12)) * 1.8::DOUBLE) AS p, contains(option, 'read') OR contains(option, 'edit') AS core FROM t)
 SELECT item_id, option, round(CASE WHEN core THEN greatest(p, 0.92) ELSE p END, 4) AS p, p >= 0.5 OR core AS keep FROM p""")
def p18(spark, d):
    f = with_item(spark.read.parquet(f"{d}/documents.parquet"), view(spark, d, "vq")).select("item_id", F.concat_ws("_", "source", "lang", F.get(F.array(*map(F.lit, ["the", "read", "thand", "edit_ting"])), (F.col("doc_id") % 4).cast("int"))).alias("option"))
    o = view(spark, d, "vq").select("item_id", F.col("text").alias("state")).join(f, "item_id").distinct().withColumn("slot", F.lit("tool_gate")).withColumn("keep", F.lit(False))
    return budget.score_options(o).select("item_id", "option", "p", "keep")


@query("g1_title_symbols", r"""WITH l AS (SELECT path, list_filter(string_split(src, chr(10)), lambda x: trim(x) <> '')[1:2] AS l, regexp_extract_all(src, '(?m)^#{1,6}[ \t]+([^\n]+)', 1) AS h FROM vf)
 SELECT DISTINCT path, unnest(list_transform(regexp_extract_all(array_to_string(CASE WHEN len(h) > 0 THEN h ELSE l END, ' '), '[A-Za-z0-9]{3,}'), lambda x: lower(x))) AS term FROM l""")
def g1(spark, d):
    return index.heading_symbols(view(spark, d, "vf"))


_HINTS = "hn AS (SELECT path, unnest(list_sort(list_distinct(list_append(list_transform(regexp_extract_all(src, '[A-Za-z]{4,}'), lambda x: lower(x)), split_part(path, '/', 3))))[1:400]) AS term FROM vf)"


@query("g4_hint_terms", f"WITH {_HINTS} SELECT path, term FROM hn")
def g4(spark, d):
    return index.hint_terms(view(spark, d, "vf"))


def edges(spark, d):
    f = view(spark, d, "vf")
    p = f.select(F.col("doc_id").alias("parent"), F.col("path").alias("dst"))
    return f.where("doc_id > 0").join(p, "parent").select(F.col("path").alias("src"), "dst")


_EDGES = "ed AS (SELECT a.path AS src, b.path AS dst FROM vf a JOIN vf b ON b.doc_id = a.parent WHERE a.doc_id > 0)"


@query("g5_degrees", f"WITH {_EDGES}, o AS (SELECT src AS path, count(*) AS n_out FROM ed GROUP BY 1), i AS (SELECT dst AS path, count(*) AS n_in FROM ed GROUP BY 1) SELECT path, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM o FULL JOIN i USING (path)")
def g5(spark, d):
    return index.degrees(edges(spark, d))


_SEARCH = f"""{_EDGES}, {_HINTS},
 sy AS (SELECT DISTINCT path, unnest(list_transform(regexp_extract_all(array_to_string(list_filter(string_split(src, chr(10)), lambda x: trim(x) <> '')[1:2], ' '), '[A-Za-z0-9]{{3,}}'), lambda x: lower(x))) AS term FROM vf),
 qa AS (SELECT item_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM (SELECT item_id, {TERMS('text')} AS w FROM vq)),
 qf AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY min(i)) AS r FROM qa GROUP BY item_id, term),
 q AS (SELECT item_id, term FROM qf WHERE r <= 80),
 h AS (SELECT item_id, path, term, 3.0 AS w FROM q JOIN sy USING (term) UNION ALL SELECT item_id, path, term, 2.0 FROM q JOIN vf ON contains(path, term) UNION ALL SELECT item_id, path, term, 0.6 FROM q JOIN hn USING (term)),
 ts AS (SELECT item_id, path, sum(w) AS score FROM (SELECT item_id, path, term, max(w) AS w FROM h GROUP BY ALL) GROUP BY ALL),
 ms AS (SELECT item_id, path, 8.0 AS score FROM vq JOIN vf ON contains(path, mention)),
 gs AS (SELECT item_id, src AS path, 2.0 AS score FROM ms JOIN ed ON ms.path = dst UNION ALL SELECT item_id, dst, 1.2 FROM ms JOIN ed ON ms.path = src),
 al AS (SELECT item_id, path, round(sum(score)::DOUBLE, 2) AS score FROM (SELECT * FROM ts UNION ALL SELECT * FROM ms UNION ALL SELECT * FROM gs) GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, path) AS rank FROM al WHERE score > 0)"""


def searched(spark, d, k=12):
    f = view(spark, d, "vf")
    return index.search(view(spark, d, "vq"), f.select("path"), index.heading_symbols(f), index.hint_terms(f), edges(spark, d), k)


@query("g6_j5_j6_j7_w7_search", f"WITH {_SEARCH} SELECT item_id, path, score, rank FROM rk WHERE rank <= 12")
def g6(spark, d):
    return searched(spark, d)


@query("p15_file_decisions", f"WITH {_SEARCH} SELECT item_id, path, score >= 20 AS keep, round(least(1.0, score / 60.0), 3) AS shown FROM rk WHERE rank <= 12")
def p15(spark, d):
    s = searched(spark, d).withColumn("score", F.col("score") / 10).withColumn("query_terms", F.array(F.lit("md")))
    return budget.file_decisions(s, 2.0).select("item_id", "path", "keep", "shown")


@query("w13_keep_rules", f"WITH {_SEARCH}, c AS (SELECT item_id, path, score, score >= max(score) OVER (PARTITION BY item_id) / 2 AS half, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, path) <= 1 + item_id % 4 AS top FROM rk WHERE rank <= 12) SELECT item_id, path, half, top FROM c")
def w13(spark, d):
    s = searched(spark, d).select(F.col("item_id").alias("case_id"), F.col("path").alias("option"), "score", (1 + F.col("item_id") % 4).alias("k"))
    half = evaluate.keep_rule(s, "half").withColumnRenamed("keep", "half")
    return evaluate.keep_rule(half, "top").select(F.col("case_id").alias("item_id"), F.col("option").alias("path"), "half", F.col("keep").alias("top"))


@query("j8_k3_evidence", f"WITH {_SEARCH}, r AS (SELECT item_id AS request_id, path, score / max(score) OVER (PARTITION BY item_id) AS rel FROM rk WHERE rank <= 12) SELECT vm.request_id, vm.idx, round(max(rel), 6) AS evidence FROM vm JOIN r ON r.request_id = vm.request_id AND (path = named_path OR ends_with(path, '/' || named_path)) GROUP BY ALL")
def j8(spark, d):
    m = view(spark, d, "vm").select("request_id", "idx", F.col("named_path").alias("named"))
    return index.couple_evidence(m, searched(spark, d).withColumnRenamed("item_id", "request_id"))


# messages of a conversation, tools and ranked files of the item of the same number, under one budget
_POOL3 = f"""{_SC}, {_TOOLS}, {_SEARCH}, rf AS (SELECT item_id AS request_id, path, least(1.0, score / 6.0)::DOUBLE AS v FROM rk WHERE rank <= 10),
 ev AS (SELECT request_id, idx, max(v) AS e FROM (SELECT vm.request_id, idx, v FROM vm JOIN rf ON rf.request_id = vm.request_id AND (path = named_path OR ends_with(path, '/' || named_path))
  UNION ALL SELECT request_id, idx, 0.9::DOUBLE FROM vm JOIN vq ON item_id = request_id AND mention = named_path) GROUP BY ALL),
 p0 AS (SELECT request_id, 'message' AS kind, lpad(idx::VARCHAR, 6, '0') AS id, idx::BIGINT AS idx, tokens, score + 0.5::DOUBLE * coalesce(e, 0) AS value, tail AS protected, CASE WHEN e >= 0.8 THEN e ELSE 0 END AS evidence FROM sc LEFT JOIN ev USING (request_id, idx) WHERE kind <> 'system'
  UNION ALL SELECT item_id, 'tool', name, NULL, greatest(1, tokens), round(s, 3), core, 0 FROM tg
  UNION ALL SELECT request_id, 'file', path, NULL, {TOK("'- ' || path")}, v * CASE WHEN tl THEN 0.25 ELSE 1 END, nm AND NOT tl, 0 FROM
   (SELECT *, EXISTS (SELECT 1 FROM vq WHERE item_id = rf.request_id AND (path = mention OR ends_with(path, '/' || mention))) AS nm, EXISTS (SELECT 1 FROM sc WHERE sc.request_id = rf.request_id AND sc.tail AND kind <> 'system' AND (path = named_path OR ends_with(path, '/' || named_path))) AS tl FROM rf)),
 bc AS (SELECT *, floor(4000 * 0.6::DOUBLE)::BIGINT AS cap, sum(CASE WHEN protected THEN tokens ELSE 0 END) OVER (PARTITION BY request_id)::BIGINT AS p FROM p0),
 bb AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY evidence DESC, idx) AS r FROM bc WHERE evidence > 0),
 bf AS (SELECT DISTINCT request_id, 0::BIGINT AS r, p AS used, NULL::VARCHAR AS id, false AS take FROM bc
  UNION ALL SELECT b.request_id, b.r, f.used + CASE WHEN NOT b.protected AND f.used + b.tokens <= b.cap THEN b.tokens ELSE 0 END, b.id, NOT b.protected AND f.used + b.tokens <= b.cap FROM bf f JOIN bb b ON b.request_id = f.request_id AND b.r = f.r + 1 AND b.r <= 3),
 pool AS (SELECT bc.request_id, kind, bc.id, tokens, value, protected OR coalesce(bf.take, false) AS protected, CASE WHEN tokens <= 0 THEN 'infinity'::DOUBLE ELSE value / tokens END AS ratio FROM bc LEFT JOIN bf ON bf.request_id = bc.request_id AND bf.id = bc.id AND kind = 'message'),
 pt AS (SELECT request_id, sum(CASE WHEN protected THEN tokens ELSE 0 END)::BIGINT AS p FROM pool GROUP BY 1),
 o AS (SELECT pool.*, row_number() OVER (PARTITION BY request_id ORDER BY ratio DESC, value DESC, kind, id) AS step FROM pool WHERE NOT protected),
 f AS (SELECT request_id, 0::BIGINT AS step, 4000 - p AS rest, NULL::VARCHAR AS kind, NULL::VARCHAR AS id, NULL::BOOLEAN AS keep FROM pt WHERE p <= 4000
  UNION ALL SELECT o.request_id, o.step, f.rest - CASE WHEN o.tokens <= f.rest THEN o.tokens ELSE 0 END, o.kind, o.id, o.tokens <= f.rest FROM f JOIN o ON o.request_id = f.request_id AND o.step = f.step + 1),
 pl AS (SELECT pool.request_id, pool.kind, pool.id, tokens, round(value, 6) AS value, protected, CASE WHEN pt.p > 4000 THEN CASE WHEN protected THEN true END ELSE protected OR coalesce(f.keep, false) END AS keep FROM pool JOIN pt USING (request_id) LEFT JOIN f ON f.request_id = pool.request_id AND f.kind = pool.kind AND f.id = pool.id)"""


def pool3(spark, d):
    m = scored(spark, d)
    named = m.select("request_id", "idx", F.col("named_path").alias("path"))
    ranked = searched(spark, d, 10).withColumnRenamed("item_id", "request_id")
    task = view(spark, d, "vq").select(F.col("item_id").alias("request_id"), F.col("mention").alias("path"))
    return budget.book_evidence(budget.candidate_pool(m, named, budget.tool_scores(tools(spark, d), 0.4), ranked, task), F.lit(4000))


@query("k3_candidate_pool", f"WITH RECURSIVE {_POOL3} SELECT request_id, kind, id, tokens, value, protected FROM pl")
def k3(spark, d):
    return pool3(spark, d).select("request_id", "kind", "id", "tokens", F.round("value", 6).alias("value"), "protected")


@query("k2_k3_plan_of_three_kinds", f"WITH RECURSIVE {_POOL3} SELECT request_id, kind, id, keep FROM pl")
def k23(spark, d):
    return budget.joint_plan(pool3(spark, d), F.lit(4000)).select("request_id", "kind", "id", "keep")


@query("k8_apply_tool_plan", f"WITH RECURSIVE {_POOL3} SELECT item_id, name FROM tg LEFT JOIN pl ON pl.request_id = item_id AND pl.kind = 'tool' AND id = name WHERE keep IS DISTINCT FROM false")
def k8t(spark, d):
    drop = budget.joint_plan(pool3(spark, d), F.lit(4000)).where("kind = 'tool' and not keep").select("request_id", F.col("id").alias("name"))
    return budget.apply_tool_plan(tools(spark, d).select("request_id", "name"), drop).select(F.col("request_id").alias("item_id"), "name")


@query("p8_paths_named", "SELECT request_id, idx, CASE WHEN (request_id * 7) % 4 = 0 THEN named_path ELSE '' END AS paths FROM vm")
def p8(spark, d):
    line = F.concat(F.lit("open "), F.col("named_path"), F.lit(" and other.py"))
    needle = F.when((F.col("request_id") * 7) % 4 == 0, F.array("named_path")).otherwise(F.array(F.lit("nothing.md")))
    return view(spark, d, "vm").select("request_id", "idx", F.array_join(text.paths_named(line, needle), ",").alias("paths"))


@query("s15_source_files", "SELECT path, length(src) AS length FROM vf WHERE NOT contains(path, 'src3/') AND length(src) <= 4194304 ORDER BY path LIMIT 20000")
def s15(spark, d):
    f = view(spark, d, "vf").withColumn("length", F.length("src"))
    return logs.source_files(f, skip=["src3"]).select("path", "length")


# ---- labels and data sets ---------------------------------------------------------------------

_IMPL = "im AS (SELECT request_id, CASE WHEN request_id % 3 = 0 THEN 'keep' ELSE 'bad' END AS implicit FROM (SELECT request_id FROM vl WHERE request_id % 2 = 0 UNION SELECT request_id + 1 FROM vl WHERE request_id % 5 = 0))"


def implicit(spark, d):
    v = view(spark, d, "vl")
    ids = v.where("request_id % 2 = 0").select("request_id").unionByName(v.where("request_id % 5 = 0").select((F.col("request_id") + 1).alias("request_id"))).distinct()
    return ids.withColumn("implicit", F.when(F.col("request_id") % 3 == 0, "keep").otherwise("bad")).withColumn("slot", F.lit("compact"))


@query("s6_upsert_labels", "WITH a AS (SELECT request_id, 'compact' AS slot, verdict, 0 AS g FROM vl UNION ALL SELECT request_id, unnest(['tool_gate', 'compact', 'context', 'effort']), 'good', 1 FROM vl WHERE request_id % 7 = 0) SELECT request_id, slot, arg_max(verdict, g) AS verdict FROM a GROUP BY ALL")
def s6(spark, d):
    v = view(spark, d, "vl").select("request_id", "slot", "verdict", F.lit(1).alias("seq"))
    new = v.where("request_id % 7 = 0").select("request_id", F.lit("all").alias("slot"), F.lit("good").alias("verdict"), F.lit(2).alias("seq"))
    return labels.upsert_labels(v, new).select("request_id", "slot", "verdict")


@query("s7_merge_implicit", "WITH n AS (SELECT request_id, CASE WHEN request_id % 10 = 0 THEN 'keep' ELSE verdict END AS verdict FROM vl WHERE request_id % 5 = 0 UNION ALL SELECT 1000000 + request_id, 'bad' FROM vl WHERE request_id % 5 = 0) SELECT request_id, coalesce(n.verdict, o.verdict) AS verdict, n.verdict IS NOT NULL AND n.verdict IS DISTINCT FROM o.verdict AS changed FROM vl o FULL JOIN n USING (request_id)")
def s7(spark, d):
    o = view(spark, d, "vl").select("request_id", "verdict")
    n = o.where("request_id % 5 = 0")
    n = n.withColumn("verdict", F.when(F.col("request_id") % 10 == 0, "keep").otherwise(F.col("verdict"))).unionByName(n.select((F.col("request_id") + 1000000).alias("request_id"), F.lit("bad").alias("verdict")))
    return labels.merge_implicit(o, n)


@query("j3_l1_merge_verdicts", f"WITH {_IMPL} SELECT request_id, verdict, implicit, CASE WHEN verdict = 'good' THEN 'good' WHEN verdict = 'bad' AND implicit IS NOT NULL THEN 'mixed' WHEN verdict = 'bad' THEN 'bad' WHEN implicit = 'keep' THEN 'keep' WHEN implicit IS NOT NULL THEN 'exclude' ELSE verdict END AS merged FROM vl FULL JOIN im USING (request_id)")
def l1(spark, d):
    return labels.merge_verdicts(view(spark, d, "vl"), implicit(spark, d)).select("request_id", "verdict", "implicit", "merged")


@query("j15_a15_coverage", f"WITH {_IMPL}, j AS (SELECT verdict, implicit FROM vl FULL JOIN im USING (request_id)) SELECT count(*) FILTER (verdict IS NOT NULL) AS human, count(*) FILTER (implicit IS NOT NULL) AS harvest, count(*) FILTER (verdict IS NOT NULL AND implicit IS NOT NULL) AS both, count(*) FILTER (verdict = 'good' AND implicit = 'bad') AS disagree, count(*) AS n, round(count(*) FILTER (implicit IS NOT NULL)::DOUBLE / count(*), 4) AS coverage FROM j")
def j15(spark, d):
    return labels.coverage(view(spark, d, "vl"), implicit(spark, d))


@query("w3_reruns", "WITH l AS (SELECT id, ts_epoch, lag(id) OVER w AS request_id, lag(ts_epoch) OVER w AS t FROM vr WINDOW w AS (PARTITION BY body_sha ORDER BY id)) SELECT request_id, id AS again_id FROM l WHERE request_id IS NOT NULL AND ts_epoch - t <= 1800")
def w3(spark, d):
    return labels.reruns(view(spark, d, "vr"))




@query("t3_rerun_alert", SQL["w3_reruns"])
def t3(spark, d):
    return labels.reruns(view(spark, d, "vr"))


@query("w4_corrections", f"WITH l AS (SELECT request_id AS session, idx, text, lag(idx) OVER w AS turn, lag(idx % 3 <> 0) OVER w AS b FROM vm WINDOW w AS (PARTITION BY request_id ORDER BY idx)) SELECT session, turn FROM l WHERE regexp_matches(text, '(?i){OPENING}') AND b")
def w4(spark, d):
    turns = view(spark, d, "vm").select(F.col("request_id").alias("session"), F.col("idx").alias("turn"), "text", (F.col("idx") % 3 != 0).alias("has_body"))
    return labels.corrections(turns, f"(?i){OPENING}")


_GROW = """wf AS (SELECT *, sum(fetched::INTEGER) OVER (PARTITION BY session, path ORDER BY turn RANGE BETWEEN 50 PRECEDING AND CURRENT ROW) AS n FROM vp),
 gr AS (SELECT a.*, coalesce(b.n, 0) AS before FROM wf a LEFT JOIN wf b ON b.session = a.session AND b.path = a.path AND b.turn = a.turn - 1 WHERE a.n > coalesce(b.n, 0)),
 bl AS (SELECT g.session, g.turn, g.path, max(e.turn) AS e_turn, arg_max(e.tokens, e.turn) AS evicted_tok, any_value(g.tokens) AS regret_tok FROM gr g JOIN vp e ON e.session = g.session AND e.evicted AND e.path = g.path AND e.turn < g.turn AND g.turn - e.turn <= 20 AND g.ts_epoch - e.ts_epoch <= 1800 GROUP BY ALL)"""


def grown(spark, d):
    f = labels.windowed_fetches(view(spark, d, "vp")).withColumn("turn_no", F.col("turn"))
    return labels.growth(f)


def blame(spark, d):
    return labels.blamed(grown(spark, d), view(spark, d, "vp").where("evicted"))


@query("j9_growth", f"WITH {_GROW} SELECT session, turn, path, n::BIGINT AS n, before::BIGINT AS before FROM gr")
def j9(spark, d):
    return grown(spark, d).select("session", "turn", "path", "n", "before")


@query("j10_blamed", f"WITH {_GROW} SELECT session, turn, path, e_turn, evicted_tok, regret_tok FROM bl")
def j10(spark, d):
    return blame(spark, d)


@query("t4_reread_alert", SQL["j10_blamed"])
def t4(spark, d):
    return blame(spark, d)


@query("a14_l6_regret_summary", f"WITH {_GROW} SELECT count(*) AS growth_events, count(DISTINCT session) AS sessions, (SELECT count(*) FROM bl) AS regretted, (SELECT sum(regret_tok)::BIGINT FROM bl) AS regret_tok, (SELECT sum(evicted_tok)::BIGINT FROM bl) AS evicted_tok, round(1000.0::DOUBLE * (SELECT count(*) FROM bl) / count(*), 4) AS per_1k FROM gr")
def a14(spark, d):
    return labels.regret_summary(grown(spark, d), blame(spark, d))


@query("w10_first_observation", "WITH o AS (SELECT session AS request_id, path AS key, CASE WHEN fetched THEN 're-read' ELSE 'correction' END AS source, turn AS seq FROM vp) SELECT request_id, key, source, seq FROM (SELECT *, row_number() OVER (PARTITION BY request_id, key ORDER BY source = 're-read' DESC, seq) AS r FROM o) WHERE r = 1")
def w10(spark, d):
    o = view(spark, d, "vp").select(F.col("session").alias("request_id"), F.col("path").alias("key"), F.when(F.col("fetched"), "re-read").otherwise("correction").alias("source"), F.col("turn").alias("seq"))
    return labels.first_observation(o)


@query("j1_with_bodies", "SELECT id, body_sha IN (SELECT body_sha FROM vr WHERE k > 90) AS has_body FROM vr")
def j1(spark, d):
    v = view(spark, d, "vr")
    return labels.with_bodies(v, v.where("k > 90")).select("id", "has_body")


@query("j4_attribution", "WITH c AS (SELECT session, path, turn AS p FROM vp WHERE NOT fetched), r AS (SELECT session, path, turn FROM vp WHERE fetched) SELECT r.session, r.path, r.turn, coalesce(max(p), -1) AS call_pos FROM r LEFT JOIN c ON c.session = r.session AND c.path = r.path AND c.p < r.turn GROUP BY ALL")
def j4(spark, d):
    v = view(spark, d, "vp").select(F.col("session").alias("request_id"), F.col("path").alias("call_id"), F.col("turn").alias("pos"), "fetched")
    calls = v.where("not fetched").select("request_id", "call_id", "pos", F.col("pos").cast("string").alias("tool"), F.lit(None).cast("string").alias("path"))
    out = labels.attribute_results(calls, v.where("fetched").drop("fetched"))
    return out.select(F.col("request_id").alias("session"), F.col("call_id").alias("path"), F.col("pos").alias("turn"), F.coalesce(F.col("tool").cast("long"), F.lit(-1)).alias("call_pos"))


@query("l2_fetch_counts", "SELECT session AS request_id, path, count(*) AS fetches, arg_max(tokens, turn) AS tokens FROM vp WHERE NOT evicted GROUP BY ALL")
def l2(spark, d):
    v = view(spark, d, "vp").select(F.col("session").alias("request_id"), "path", F.col("path").alias("call_path"), F.when(F.col("evicted"), "Grep").otherwise("Read").alias("tool"), "tokens", F.col("turn").alias("pos"))
    return labels.fetch_counts(v).select("request_id", "path", "fetches", "tokens")


_CAND = f"{_SC}, cd AS (SELECT sc.request_id, (sc.request_id % 20)::VARCHAR AS body_sha, kind AS target, idx AS c_pos, score >= 0.7 AS keep, CASE request_id % 6 WHEN 0 THEN 'good' WHEN 1 THEN 'bad' WHEN 2 THEN 'keep' WHEN 3 THEN 'exclude' END AS merged FROM sc)"
_EX = f"{_CAND}, ex AS (SELECT *, CASE WHEN keep OR coalesce(merged = 'keep', false) THEN 'keep' ELSE 'drop' END AS answer, CASE WHEN merged = 'good' THEN 'human' WHEN merged = 'keep' THEN 'traffic' ELSE 'heuristic' END AS label_source FROM (SELECT *, row_number() OVER (PARTITION BY body_sha, target ORDER BY request_id, c_pos) AS r FROM cd WHERE merged IS NULL OR merged NOT IN ('bad', 'mixed', 'exclude')) WHERE r = 1)"


def examples(spark, d):
    n = F.col("request_id") % 6
    merged = F.when(n == 0, "good").when(n == 1, "bad").when(n == 2, "keep").when(n == 3, "exclude")
    c = scored(spark, d).select("request_id", (F.col("request_id") % 20).cast("string").alias("body_sha"), F.lit("compact").alias("slot"), F.col("kind").alias("target"), (F.col("score") >= 0.7).alias("keep"), merged.alias("merged"), F.lit(0).alias("d_pos"), F.col("idx").alias("c_pos"))
    return dataset.training_examples(c)


@query("l7_w9_examples", f"WITH {_EX} SELECT request_id, body_sha, target, answer, label_source FROM ex")
def l7(spark, d):
    return examples(spark, d).select("request_id", "body_sha", "target", "answer", "label_source")


_SPLIT = f"{_EX}, ky AS (SELECT body_sha, row_number() OVER (ORDER BY ('0x' || substr(md5('7|' || body_sha), 1, 8))::BIGINT, body_sha) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT body_sha FROM ex)), sp AS (SELECT ex.* EXCLUDE (r), CASE WHEN ky.r <= floor(n * 0.8::DOUBLE + 0.5) THEN 'train' ELSE 'val' END AS part FROM ex JOIN ky USING (body_sha))"


def split(spark, d):
    return dataset.split_train_val(examples(spark, d), "body_sha", 0.2)


@query("l9_s10_split", f"WITH {_SPLIT} SELECT body_sha, target, part FROM sp")
def l9(spark, d):
    return split(spark, d).select("body_sha", "target", "part")


@query("a29_split_statistics", f"WITH {_SPLIT} SELECT part, count(*) AS n, count(*) FILTER (label_source <> 'heuristic') AS supervised, count(*) FILTER (label_source = 'traffic') AS from_traffic, count(*) FILTER (label_source = 'traffic' AND answer = 'keep') AS traffic_keeps, count(*) FILTER (label_source = 'heuristic') AS heuristic FROM sp GROUP BY 1")
def a29(spark, d):
    return dataset.split_statistics(split(spark, d))


@query("a24_answers_by_slot", f"WITH {_EX} SELECT 'compact' AS slot, count(*) FILTER (answer = 'keep') AS keep, count(*) FILTER (answer = 'drop') AS drop, count(*) AS total FROM ex")
def a24(spark, d):
    return dataset.answers_by_slot(examples(spark, d))


@query("a25_readiness", f"WITH {_EX}, s AS (SELECT target AS slot, count(*) FILTER (answer = 'keep') AS keep, count(*) FILTER (answer = 'drop') AS drop, count(*) AS total FROM ex GROUP BY 1) SELECT slot, concat_ws(';', CASE WHEN total < 10 THEN 'too few rows' END, CASE WHEN keep = 0 OR drop = 0 THEN 'one answer only' WHEN least(keep, drop) < 3 THEN 'too few of one answer' END) AS reasons, total >= 10 AND least(keep, drop) >= 3 AS ready FROM s")
def a25(spark, d):
    a = dataset.answers_by_slot(examples(spark, d).withColumn("slot", F.col("target")))
    return dataset.readiness(a, "old", "new", 30.0, 10, 3).select("slot", F.array_join("reasons", ";").alias("reasons"), "ready")


@query("a26_fingerprint", f"WITH {_SPLIT}, h AS (SELECT sha256(part || '|' || body_sha || '|' || target || '|' || answer) AS h FROM sp), b5 AS (SELECT substr(h, 1, 5) AS b, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS c FROM h GROUP BY 1), b3 AS (SELECT substr(b, 1, 3) AS b1, sha256(string_agg(d, '' ORDER BY b)) AS d, sum(c) AS c FROM b5 GROUP BY 1), b AS (SELECT substr(b1, 1, 1) AS b, sha256(string_agg(d, '' ORDER BY b1)) AS d, sum(c) AS c FROM b3 GROUP BY 1) SELECT sha256(string_agg(d, '' ORDER BY b)) AS fingerprint, sum(c)::BIGINT AS n FROM b")
def a26(spark, d):
    return dataset.fingerprint(split(spark, d), ["part", "body_sha", "target", "answer"])


@query("l8_state_text", "SELECT request_id, idx, md5(CASE WHEN kind = 'user' THEN right(text, 512) WHEN contains(text, ' ') THEN array_to_string(string_split(text, ' ')[1:8], ', ') ELSE kind || ' turn' END) AS state FROM vm")
def l8(spark, d):
    words = F.split("text", " ")
    named = F.when(F.size(words) > 1, words).otherwise(F.array().cast("array<string>"))
    return view(spark, d, "vm").select("request_id", "idx", F.md5(dataset.state_text(F.when(F.col("kind") == "user", F.col("text")), named, F.col("kind"))).alias("state"))


@query("s12_render_prompt", "SELECT request_id, idx, md5('state: ' || trim(text) || chr(10) || 'option: ' || kind) AS prompt FROM vm")
def s12(spark, d):
    return view(spark, d, "vm").select("request_id", "idx", F.md5(dataset.render_prompt(F.col("text"), F.array("kind"))).alias("prompt"))


@query("s11_validate_split", r"""WITH r AS (SELECT request_id, idx, length(text) < 60 AS a, len(regexp_extract_all(text, '\b[A-Z][a-z]{9,}')) = 0 AS b, length(text) % 3 = 2 AS c FROM vm)
 SELECT request_id, idx, concat_ws(';', CASE WHEN a THEN 'missing state' END, CASE WHEN b THEN 'no options' END, CASE WHEN c THEN 'unknown answer' END) AS reasons FROM r WHERE a OR b OR c""")
def s11(spark, d):
    size = F.length("text")
    answer = F.when(size % 3 == 0, "keep").when(size % 3 == 1, "drop").otherwise(F.substring("text", 1, 9))
    rows = view(spark, d, "vm").select("request_id", "idx", F.when(size >= 60, F.col("text")).alias("state"), F.col("role").alias("question"), F.col("kind").alias("slot"), F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]{9,}"), F.lit(0)).alias("options"), answer.alias("answer"))
    return dataset.validate_split(rows).select("request_id", "idx", F.array_join("reasons", ";").alias("reasons"))


@query("s9_j2_export", "WITH dd AS (SELECT id AS request_id, CASE WHEN id % 2 = 0 THEN 'compact' ELSE 'tool_gate' END AS slot FROM vr) SELECT slot, CASE WHEN verdict IS NULL THEN 'none' ELSE 'human' END AS label_source, count(*) AS n FROM dd LEFT JOIN vl USING (request_id, slot) GROUP BY ALL")
def s9(spark, d):
    dec = view(spark, d, "vr").select(F.col("id").alias("request_id"), F.when(F.col("id") % 2 == 0, "compact").otherwise("tool_gate").alias("slot"), F.array("model").alias("candidates"))
    return logs.export_counts(logs.export_rows(dec, view(spark, d, "vl"), None, True))


@query("l4_evictions", f"WITH {_SC} SELECT request_id, idx, request_id % 2 = 0 AS applied FROM sc WHERE CASE WHEN request_id % 3 = 0 THEN idx IN (0, 2) ELSE score < 0.7 END")
def l4(spark, d):
    rows = scored(spark, d)
    cand = F.collect_list(F.struct(F.col("idx").cast("int").alias("index"), (F.col("score") >= 0.7).alias("keep")))
    proof = F.when(F.col("request_id") % 3 == 0, F.collect_list(F.when(F.col("idx").isin(0, 2), F.col("idx").cast("int"))))
    dec = rows.groupBy("request_id").agg(cand.alias("candidates"), proof.alias("proof_dropped")).withColumn("slot", F.lit("compact")).withColumn("applied", F.col("request_id") % 2 == 0).withColumn("proof_applied", F.col("applied"))
    return labels.evictions(dec)


@query("j11_drop_pointers", "SELECT p.request_id, p.idx, CASE WHEN m.kind = p.kind THEN md5(m.text) END AS recorded FROM (SELECT request_id, idx, CASE WHEN idx % 2 = 0 THEN kind ELSE 'tool_result' END AS kind FROM vm) p LEFT JOIN vm m USING (request_id, idx)")
def j11(spark, d):
    m = view(spark, d, "vm")
    p = m.select("request_id", "idx", F.when(F.col("idx") % 2 == 0, F.col("kind")).otherwise("tool_result").alias("kind"))
    return budget.drop_texts(p, m).select("request_id", "idx", F.md5("recorded").alias("recorded"))


@query("k7_owned_cuts", "WITH dr AS (SELECT request_id, role AS kind, idx AS pos, 'x:' || upper(kind) AS target, lower(kind) AS key FROM vm), ow AS (SELECT DISTINCT request_id, role AS kind, lower(kind) AS key FROM vm WHERE request_id % 3 = 0 AND kind = 'user'), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, kind, key ORDER BY pos) AS r FROM dr) WHERE r = 1) SELECT request_id, kind, key, pos FROM f WHERE (request_id, kind, key) IN (SELECT request_id, kind, key FROM ow) OR request_id NOT IN (SELECT request_id FROM ow)")
def k7(spark, d):
    m = view(spark, d, "vm")
    drops = m.select("request_id", F.col("role").alias("kind"), F.col("idx").alias("pos"), F.concat(F.lit("x:"), F.upper("kind")).alias("target"))
    own = m.where("request_id % 3 = 0 and kind = 'user'").select("request_id", F.col("role").alias("kind"), F.concat(F.lit("y:"), F.col("kind")).alias("target"))
    return budget.owned_cuts(drops, own).select("request_id", "kind", "key", "pos")


@query("a17_agreement", f"WITH {_SC} SELECT count(*) AS n, round(avg(((score >= 0.7) = (idx % 2 = 0))::INTEGER), 4) AS agreement FROM sc")
def a17(spark, d):
    rows = scored(spark, d)
    a = rows.select("request_id", "idx", (F.col("score") >= 0.7).alias("keep"))
    return evaluate.agreement(a, rows.select("request_id", "idx", (F.col("idx") % 2 == 0).alias("keep")), ["request_id", "idx"])


@query("u2_keep_set_operations", "SELECT 'both' AS part, count(*) AS n FROM (SELECT request_id FROM vl WHERE quality = 1 INTERSECT SELECT request_id FROM vl WHERE toxic = 0) UNION ALL SELECT 'first only', count(*) FROM (SELECT request_id FROM vl WHERE quality = 1 EXCEPT SELECT request_id FROM vl WHERE toxic = 0)")
def u2(spark, d):
    v = view(spark, d, "vl")
    a, b = v.where("quality = 1").select("request_id"), v.where("toxic = 0").select("request_id")
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return count(a.intersect(b), "both").unionByName(count(a.exceptAll(b), "first only"))


@query("u1_candidate_union", f"WITH {_SC} SELECT 'message' AS kind, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM sc UNION ALL SELECT 'file', count(*), sum({TOK('src')})::BIGINT FROM vf")
def u1(spark, d):
    m = scored(spark, d).select(F.lit("message").alias("kind"), "tokens")
    f = view(spark, d, "vf").select(F.lit("file").alias("kind"), text.approx_tokens(F.col("src")).alias("tokens"))
    return m.unionByName(f).groupBy("kind").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


# a third of the requests has a joint proof, a third candidates, some only numbers, the rest nothing
@query("k9_kept_cut_counts", f"""WITH {_SC}, c AS (SELECT request_id, count(*) FILTER (score >= 0.7) AS k, count(*) FILTER (score < 0.7) AS n, count(*) FILTER (score < 0.7 AND kind = 'user') AS u, count(*) FILTER (score >= 0.7 AND kind = 'user') AS ku FROM sc GROUP BY 1)
 SELECT request_id, CASE request_id % 4 WHEN 0 THEN CASE WHEN u > 0 AND n > u THEN ku ELSE k END WHEN 1 THEN k WHEN 2 THEN 7 END AS kept, CASE request_id % 4 WHEN 0 THEN CASE WHEN u > 0 AND n > u OR n = 0 THEN u ELSE n END WHEN 1 THEN u WHEN 2 THEN n END AS cut FROM c""")
def k9(spark, d):
    part, keep = F.col("request_id") % 4, F.col("score") >= 0.7
    kinds = lambda cond: F.collect_list(F.when(cond, F.col("kind")))
    rows = scored(spark, d).groupBy("request_id").agg(kinds(keep).alias("k"), kinds(~keep).alias("n"), kinds(~keep & (F.col("kind") == "user")).alias("drops"), F.collect_list(F.struct(keep.alias("keep"))).alias("c"))
    rows = rows.select("request_id", F.when(part == 0, F.col("k")).alias("proof_kept"), F.when(part == 0, F.col("n")).alias("proof_dropped"), F.when(part == 1, F.col("c")).alias("candidates"), F.when(part == 2, 7).alias("kept"), F.when(part == 2, F.size("n")).alias("dropped_count"), "drops")
    return budget.head_counts(rows).select("request_id", F.col("n_kept").alias("kept"), F.col("n_cut").alias("cut"))
