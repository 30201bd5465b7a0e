"""Raw shapes written from the views' rows and read back: bodies, data files, sources, histories, spellings.

What a reader must find follows from the numbers that the shape was written from, so each SQL says
it without reading the shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dataset, index, labels, needles, paths
from ..sources import bodies
from .views import view

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _json(**fields):
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


# ---- bodies of four dialects (P4, P5, P19) ------------------------------------------------------


def requests(spark, d) -> DataFrame:
    """request_id and body: conversations as messages with text, messages with blocks, contents with parts, or instructions with input."""
    m = view(spark, d, "vm").select("request_id", F.col("idx").cast("int").alias("idx"), "role", F.coalesce("text", F.lit("")).alias("text"))
    r, i = F.col("request_id") % 4, F.col("idx") % 5
    block = F.when(i == 1, F.array(F.struct(F.lit("tool_result").alias("type"), F.lit(None).cast("string").alias("text"), F.col("text").alias("content"))))
    block = block.otherwise(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("content"))))
    turn = F.struct("idx", F.struct("role", F.col("text").alias("content")).alias("plain"), F.struct("role", block.alias("content")).alias("blocks"), F.struct(F.when(F.col("role") == "assistant", "model").otherwise(F.col("role")).alias("role"), F.array(F.struct("text")).alias("parts")).alias("parts"))
    of = lambda name: F.transform(F.array_sort(F.collect_list(turn)), lambda x: x[name])
    whole = m.groupBy("request_id").agg(of("plain").alias("plain"), of("blocks").alias("blocks"), of("parts").alias("parts"))
    tool = lambda n: F.struct(F.concat(F.lit(f"tool_{n}_"), F.col("request_id").cast("string")).alias("name"), F.lit("does").alias("description"))
    wrapped = F.array(*(F.struct(F.lit("function").alias("type"), tool(n).alias("function")) for n in (1, 2)))
    body = (
        F.when(r == 0, _json(messages=F.col("plain"), tools=wrapped))
        .when(r == 1, _json(system=F.lit("be brief"), messages=F.col("blocks"), tools=F.array(tool(1), tool(2))))
        .when(r == 2, _json(systemInstruction=F.struct(F.array(F.struct(F.lit("be kind").alias("text"))).alias("parts")), contents=F.col("parts"), tools=F.array(F.struct(F.array(tool(1), tool(2)).alias("functionDeclarations")))))
        .otherwise(_json(instructions=F.lit("be good"), input=F.col("plain"), tools=F.array(F.struct(F.lit("function").alias("type"), tool(1)["name"].alias("name")))))
    )
    return whole.select("request_id", body.alias("body"))


@query("p4_messages", """WITH m AS (SELECT request_id, request_id % 4 AS r, row_number() OVER (PARTITION BY request_id ORDER BY idx) - 1 AS i, idx % 5 AS n, role, coalesce(text, '') AS text FROM vm)
SELECT request_id, i + CASE WHEN r = 0 THEN 0 ELSE 1 END AS idx, CASE WHEN r = 2 AND role = 'assistant' THEN 'model' ELSE role END AS role, md5(text) AS text, CASE WHEN r = 1 AND n = 1 THEN 'tool_result' ELSE role END AS kind FROM m WHERE r < 3
UNION ALL SELECT DISTINCT request_id, 0, 'system', md5(CASE r WHEN 1 THEN 'be brief' ELSE 'be kind' END), 'system' FROM m WHERE r IN (1, 2)""")
def p4(spark, d):
    return bodies.messages(requests(spark, d)).select("request_id", "idx", "role", F.md5("text").alias("text"), "kind")


@query("p5_tools", """WITH t AS (SELECT DISTINCT request_id, request_id % 4 AS r FROM vm)
SELECT request_id, n - 1 AS pos, 'tool_' || n || '_' || request_id AS name, CASE WHEN r < 3 THEN 'does' END AS description, CASE WHEN r < 3 THEN length('{"name":"tool_1_","description":"does"}') ELSE length('{"type":"function","name":"tool_1_"}') END + length(request_id::VARCHAR) AS chars
FROM t, range(1, 3) AS k(n) WHERE r < 3 OR n = 1""")
def p5(spark, d):
    return bodies.tools(requests(spark, d))


@query("p19_first_text", r"""WITH m AS (SELECT request_id * 1000 + idx AS id, idx % 6 AS n, regexp_replace(trim(coalesce(text, ''), E' \t\n\r\f\v'), '[ \t\n\r\f\v]+', ' ', 'g') AS t FROM vm)
SELECT id, md5(CASE n WHEN 0 THEN t WHEN 1 THEN t WHEN 2 THEN CASE WHEN t = '' THEN 'later' ELSE t END WHEN 3 THEN 'given' WHEN 4 THEN t ELSE '' END) AS text FROM m""")
def p19(spark, d):
    n, t = F.col("idx") % 6, F.coalesce("text", F.lit(""))
    leaf = F.struct(t.alias("text"))
    nest = lambda x, k: F.struct(x.alias(k))
    value = (
        F.when(n == 0, _json(content=t, zeta=F.lit("no")))
        .when(n == 1, _json(content=F.array(F.struct(F.lit("no").alias("kind"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("x").alias("kind"), t.alias("text")))))
        .when(n == 2, _json(input=F.lit("later"), arguments=nest(leaf, "description")))
        .when(n == 3, _json(description=t, content=F.lit(" "), text=F.lit("given")))
        .when(n == 4, _json(input=nest(nest(leaf, "input"), "input")))  # a text at depth four
        .otherwise(_json(input=nest(nest(nest(leaf, "input"), "input"), "input")))
    )
    rows = view(spark, d, "vm").select((F.col("request_id") * 1000 + F.col("idx")).alias("id"), value.alias("value"))
    return text.first_texts(rows).select("id", F.md5("text").alias("text"))


# ---- data files and sources (G2, G3) ------------------------------------------------------------


def data_files(spark, d) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("none")).alias("source"))
    n, own, none = F.col("doc_id") % 5, F.col("doc_id").cast("string"), F.lit(None).cast("string")
    meta = F.struct(F.lit("x").alias("lang"), F.array(*(F.struct(name.alias("name"), F.lit(1).alias("n"), other.alias("other")) for name, other in ((F.col("source"), none), (none, F.lit("y"))))).alias("tags"))
    whole = _json(meta=meta, body=F.col("text"), numbers=F.array(F.lit(1), F.lit(2)))
    yaml = F.concat(F.lit("# no: key\ntop_"), own, F.lit(":\n  source: "), F.col("source"), F.lit("\n  deep:\n\tin: 1\n    'quoted key': \"a: b\"\n  true:\n  - item: 3\n  after: http://x/y\nlast: http://a:1\nnot http://a\n"))
    table = F.concat(F.lit('id,"last, name","n ""x""",Size (mm),2bad,"Col_'), own, F.lit('"\n1,2,3,4,5,6\n'))
    src = F.when(n == 0, whole).when(n == 1, F.concat(whole, F.lit(" and more"))).when(n == 2, yaml).when(n == 3, table).otherwise(F.regexp_replace(table, ",", "\t"))
    name = F.when(n < 2, "json").when(n == 2, "yaml").when(n == 3, "csv").otherwise("tsv")
    return docs.select(F.concat(F.lit("data/f"), own, F.lit("."), name).alias("path"), src.alias("src"))


@query("g2_key_paths", """WITH f AS (SELECT doc_id, doc_id % 5 AS n FROM documents)
SELECT 'data/f' || doc_id || '.json' AS path, unnest(['meta', 'meta.lang', 'meta.tags', 'meta.tags[].name', 'meta.tags[].n', 'body', 'numbers']) AS term FROM f WHERE n = 0
UNION ALL SELECT 'data/f' || doc_id || '.yaml', unnest(['top_' || doc_id, 'top_' || doc_id || '.source', 'top_' || doc_id || '.deep', 'top_' || doc_id || '.in', 'top_' || doc_id || '.quoted key', 'top_' || doc_id || '.after', 'last']) FROM f WHERE n = 2""")
def g2(spark, d):
    files = data_files(spark, d)
    broken = files.where(F.endswith("path", F.lit(".json")) & F.endswith("src", F.lit(" and more")))
    return bodies.key_paths(files.join(broken.select("path"), "path", "left_anti"))


@query("g2_csv_columns", """WITH f AS (SELECT doc_id, doc_id % 5 AS n FROM documents)
SELECT 'data/f' || doc_id || '.csv' AS path, unnest([0, 1, 2]) AS pos, unnest(['id', 'size (mm)', 'col_' || doc_id]) AS term FROM f WHERE n = 3
UNION ALL SELECT 'data/f' || doc_id || '.tsv', unnest([0, 1, 2]), unnest(['id', 'size (mm)', 'col_' || doc_id]) FROM f WHERE n = 4""")
def g2c(spark, d):
    return bodies.csv_columns(data_files(spark, d))


@query("g3_code_symbols", """WITH f AS (SELECT doc_id, doc_id % 3 AS n FROM documents)
SELECT 'src/f' || doc_id || '.py' AS path, unnest(['C' || doc_id, 'run', 'f_' || doc_id, 'g', 'LIMIT', 'os.path', '..pkg.m' || (doc_id // 2)]) AS term, unnest(['symbol', 'symbol', 'symbol', 'symbol', 'symbol', 'import', 'import']) AS kind FROM f WHERE n = 0
UNION ALL SELECT 'src/f' || doc_id || '.ts', unnest(['go_' || doc_id, 'Box', './m' || (doc_id // 2)]), unnest(['symbol', 'symbol', 'import']) FROM f WHERE n = 1""")
def g3(spark, d):
    own = F.col("doc_id").cast("string")
    parent = F.expr("doc_id div 2").cast("string")
    # the text is a comment, line after line, so that nothing in it counts
    note = F.concat(F.lit("# "), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x1f\x7f\x{85}\x{2028}\x{2029}]", " "), F.lit("\n"))
    py = F.concat(note, F.lit("import os.path\nclass C"), own, F.lit(":\n    def run(self):\n        def inner(): pass\n    class Inner: pass\nasync def f_"), own, F.lit("():\n    from ..pkg.m"), parent, F.lit(" import x\n    def g(): pass\nLIMIT = 1\nif LIMIT:\n    hidden = 2\n    def none(): pass\n"))
    ts = F.concat(F.lit("import {a} from './m"), parent, F.lit("'\nexport function go_"), own, F.lit("() {}\nclass Box {}\n"))
    n = F.col("doc_id") % 3
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("src/f"), own, F.when(n == 0, ".py").when(n == 1, ".ts").otherwise(".md")).alias("path"), F.when(n == 0, py).when(n == 1, ts).otherwise("# none").alias("src"))
    return bodies.code_symbols(docs)


# ---- imports, spellings, evicted files (J14, L3, L5) --------------------------------------------


@query("j14_resolve_imports", """WITH f AS (SELECT doc_id, 'pkg' || (doc_id % 50) || '/mod' || doc_id AS stem, CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '/__init__.py' WHEN 2 THEN '.ts' ELSE '/index.js' END AS e FROM documents),
s AS (SELECT doc_id, stem || e AS src, CASE WHEN doc_id % 7 = 0 THEN 'numpy' ELSE 'pkg' || (doc_id // 2 % 50) || '/mod' || (doc_id // 2) END AS target FROM f)
SELECT DISTINCT s.src, coalesce(f.stem || f.e, 'ext:' || CASE WHEN s.doc_id % 7 = 0 THEN 'numpy' WHEN s.doc_id % 2 = 0 THEN replace(target, '/', '.') ELSE './' || target END) AS dst FROM s LEFT JOIN f ON f.stem = s.target""")
def j14(spark, d):
    i = F.col("doc_id")
    stem = lambda n: F.concat(F.lit("pkg"), (n % 50).cast("string"), F.lit("/mod"), n.cast("string"))
    end = F.when(i % 4 == 0, ".py").when(i % 4 == 1, "/__init__.py").when(i % 4 == 2, ".ts").otherwise("/index.js")
    target = stem(F.expr("doc_id div 2"))
    spec = F.when(i % 7 == 0, "numpy").when(i % 2 == 0, F.regexp_replace(target, "/", ".")).otherwise(F.concat(F.lit("./"), target))
    rows = spark.read.parquet(f"{d}/documents.parquet").select(F.concat(stem(i), end).alias("src"), spec.alias("spec"))
    return index.resolve_imports(rows, rows.select(F.col("src").alias("path")))


@query("l3_fold_spellings", """WITH e AS (SELECT session AS request_id, turn, tokens, path AS file, CASE event_id % 3 WHEN 0 THEN substr(path, 5) WHEN 1 THEN path ELSE '/repo/' || path END AS spelled FROM vp WHERE NOT evicted)
SELECT request_id, arg_max(spelled, length(spelled)) AS path, count(*) AS fetches, arg_max(tokens, turn) AS tokens FROM e GROUP BY request_id, file""")
def l3(spark, d):
    i = F.col("event_id") % 3
    spelled = F.when(i == 0, F.substring("path", 5, 1000)).when(i == 1, F.upper("path")).otherwise(F.concat(F.lit("/repo/"), "path"))
    v = view(spark, d, "vp").select(F.col("session").alias("request_id"), spelled.alias("path"), spelled.alias("call_path"), F.when(F.col("evicted"), "Grep").otherwise("Read").alias("tool"), "tokens", F.col("turn").cast("long").alias("pos"))
    return paths.fold_spellings(labels.fetch_counts(v))


@query("l5_evicted_files", """WITH s AS (SELECT request_id, idx, named_path, idx % 5 = 0 AS search, length(text) AS tokens FROM vm), e AS (SELECT request_id, idx AS place FROM vm WHERE idx % 4 = 1)
SELECT request_id, lower(named_path) AS path, min(place) AS idx, max(tokens) AS tokens FROM e JOIN s USING (request_id) WHERE s.idx BETWEEN place - 2 AND place AND NOT search GROUP BY ALL""")
def l5(spark, d):
    m = view(spark, d, "vm").withColumn("idx", F.col("idx").cast("int"))
    seen = m.select("request_id", "idx", F.upper("named_path").alias("path"), (F.col("idx") % 5 == 0).alias("is_search"), F.length("text").alias("tokens"))
    return labels.evicted_files(m.where("idx % 4 = 1").select("request_id", "idx"), seen)


@query("p8_many_needles", """WITH m AS (SELECT request_id * 1000 + idx AS id, lower(named_path) AS a, 'lib/x_' || (idx % 30) || '.json' AS b FROM vm),
n AS (SELECT 'doc_' || item_id AS needle FROM benchmark UNION SELECT 'x_' || item_id || '.' FROM benchmark WHERE item_id < 12), p AS (SELECT id, a AS path FROM m UNION SELECT id, b FROM m)
SELECT id, path FROM p SEMI JOIN n ON contains(path, needle)""")
def p8(spark, d):
    line = F.concat(F.lit("see "), F.upper("named_path"), F.lit(" ("), "named_path", F.lit("), lib/x_"), (F.col("idx") % 30).cast("string"), F.lit(".json"))
    rows = view(spark, d, "vm").select((F.col("request_id") * 1000 + F.col("idx")).alias("id"), line.alias("text"))
    items = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id")
    wanted = items.select(F.concat(F.lit("Doc_"), F.col("item_id").cast("string")).alias("needle"))
    wanted = wanted.unionByName(items.where("item_id < 12").select(F.concat(F.lit("x_"), F.col("item_id").cast("string"), F.lit(".")).alias("needle")))
    return needles.paths_naming(rows, wanted)


# ---- histories (W14, W15) -----------------------------------------------------------------------


def history(spark, d) -> DataFrame:
    return view(spark, d, "vr").select("id", F.col("id").alias("at"), F.when(F.col("k") % 3 == 0, "skipped").otherwise("ran").alias("status"), F.when(F.col("status") == 500, 1).otherwise(0).alias("exit"), F.concat("model", F.lit("-v"), (F.col("id") % 977).cast("string"), F.when(F.col("k") % 4 == 0, "x").otherwise("")).alias("version"))


@query("w14_latest_completed", "SELECT max(id) AS id FROM vr WHERE k % 3 <> 0 AND status <> 500")
def w14(spark, d):
    return dataset.latest_completed(history(spark, d)).select("id")


@query("w15_next_version", "SELECT max(id % 977)::INT + 1 AS next FROM vr WHERE k % 4 <> 0")
def w15(spark, d):
    return dataset.next_version(history(spark, d))
