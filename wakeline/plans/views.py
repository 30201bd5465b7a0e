"""The driver's tables seen as request traffic, in Spark SQL and, for oracles, in DuckDB SQL.

Both engines get the same text but for a few function names (see DIALECTS).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIALECTS = {
    "spark": {
        "K": "CAST(get_json_object(props, '$.k') AS INT)",
        "DAY": "date_format(ts, 'yyyy-MM-dd')",
        "EPOCH": "CAST(unix_millis(CAST(ts AS TIMESTAMP)) AS DOUBLE) / 1000",
        "L": "BIGINT",
        "DIV2": "(doc_id DIV 2)",
        "DIV15": "(user_id DIV 15)",
        "DIV50": "(user_id DIV 50)",
    },
    "duckdb": {
        "K": "CAST(json_extract_string(props, '$.k') AS INTEGER)",
        "DAY": "strftime(ts, '%Y-%m-%d')",
        "EPOCH": "CAST(epoch_ms(ts) AS DOUBLE) / 1000",
        "L": "BIGINT",
        "DIV2": "(doc_id // 2)",
        "DIV15": "(user_id // 15)",
        "DIV50": "(user_id // 50)",
    },
}
MODELS = ["claude-opus-4-1", "claude-3-5-sonnet", "gpt-4o-mini", "gpt-4o", "gpt-5-mini", "gemini-2.5-pro", "o3-pro", "local-model"]
AGENTS = ["claude-cli/1.0", "codex_cli/0.2", "OpenAI/Python 1.2", "Mozilla/5.0", "cursor/0.9"]


def _pick(number: str, names: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {number} = {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


_VR = f"""
SELECT event_id AS id, ts, {{EPOCH}} AS ts_epoch, {{DAY}} AS day, user_id AS session,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
  {_pick('event_id % 8', MODELS)} AS model, {_pick('user_id % 5', AGENTS)} AS agent,
  CAST(floor(value * 100) AS BIGINT) AS in_tok, CAST(k * 100 AS BIGINT) AS cr_tok,
  CAST(CASE WHEN event_type = 'signup' THEN k ELSE 0 END AS BIGINT) AS cw_tok, CAST(floor(value) AS BIGINT) AS out_tok,
  CAST(floor(value * 3) AS BIGINT) AS latency_ms, CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS ttfb_ms,
  concat(CAST({{DIV15}} AS STRING), '-', CAST(k % 10 AS STRING)) AS body_sha, k, event_type, value
FROM (SELECT *, {{K}} AS k FROM events)"""
_VM = """
SELECT conv_id AS request_id, turn AS idx, role, text,
  CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN 'tool_result' ELSE role END AS kind,
  concat('doc_', CAST(conv_id % 40 AS STRING), '.md') AS named_path
FROM conversations"""
_VF = """
SELECT doc_id, lower(concat(source, '/', lang, '/doc_', CAST(doc_id AS STRING), '.md')) AS path, text AS src, {DIV2} AS parent FROM documents"""
_VQ = """
SELECT item_id, text, concat('doc_', CAST(item_id AS STRING), '.md') AS mention FROM benchmark"""
_VL = """
SELECT doc_id AS request_id, 'compact' AS slot, CASE WHEN toxic = 1 THEN 'uncertain' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS verdict, quality, toxic FROM labels"""
_VA = """
SELECT o_orderkey AS task, o_orderpriority AS family, o_orderstatus = 'F' AS pass,
  CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18, 6)))) AS BIGINT) AS observe, CAST(round(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 6)))) AS BIGINT) AS enforce,
  CAST(round(sum(CAST(l_extendedprice * (1 - l_discount) * (1 - l_tax) AS DECIMAL(18, 6)))) AS BIGINT) AS compiled
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3"""
_VS = """
SELECT user_id * 31 + day(ts) AS request_id, row_number() OVER (PARTITION BY user_id * 31 + day(ts) ORDER BY ts, event_id) AS seq, ts,
  CASE WHEN event_type = 'signup' THEN 'message_start' WHEN event_type IN ('click', 'view') THEN 'message_delta' ELSE 'other' END AS type,
  CAST(floor(value * 100) AS BIGINT) AS input, CAST(floor(value) AS BIGINT) AS output
FROM events"""
_VP = """
SELECT {DIV50} AS session, row_number() OVER (PARTITION BY {DIV50} ORDER BY ts, event_id) AS turn, event_id, {EPOCH} AS ts_epoch,
  concat('src/m', CAST(k % 10 AS STRING), '.py') AS path, event_type = 'error' AS evicted, event_type = 'view' AS fetched, CAST(floor(value) AS BIGINT) AS tokens
FROM (SELECT *, {K} AS k FROM events)"""

VIEWS = {"vr": (_VR, ["events"]), "vm": (_VM, ["conversations"]), "vf": (_VF, ["documents"]), "vq": (_VQ, ["benchmark"]), "vl": (_VL, ["labels"]), "va": (_VA, ["orders", "lineitem"]), "vs": (_VS, ["events"]), "vp": (_VP, ["events"])}


def _fill(text: str, engine: str) -> str:
    for key, value in DIALECTS[engine].items():
        text = text.replace("{" + key + "}", value)
    return text


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, tables = VIEWS[name]
    text = _fill(sql, "spark")
    for t in tables:
        text = text.replace(f" {t}", " {" + t + "}") if t not in ("lineitem",) else text.replace("JOIN lineitem", "JOIN {lineitem}")
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def oracle(sql: str) -> str:
    """sql for DuckDB with the views it names in front."""
    import re

    named = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    views = ", ".join(f"{v} AS ({_fill(VIEWS[v][0], 'duckdb').strip()})" for v in named)
    sql = sql.strip()
    if not views:
        return sql
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {sql.removeprefix('WITH RECURSIVE ')}"
    return f"WITH {views}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {views} {sql}"
