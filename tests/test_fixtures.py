"""Hand-computed answers on small inputs."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tests.comparing import SMALL
from wakeline.functions import cost, text
from wakeline.operators import budget, dataset, evaluate, index, labels, paths, report
from wakeline.plans import queries_budget
from wakeline.sources import bodies, logs
from wakeline.streaming import jobs


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("t", "n"), [(None, 0), ("", 0), ("a", 1), ("x" * 18, 5), ("é" * 36, 10)])
def test_approx_tokens(spark, t, n):
    assert spark.createDataFrame([(t,)], "t string").select(text.approx_tokens(F.col("t"))).first()[0] == n


@pytest.mark.parametrize(("m", "p"), [("gpt-4o-mini", 1.10), ("gpt-4o", 2.50), ("Claude-3-5-Sonnet", 3.0), ("claude-opus-4", 15.0), ("gpt-5-pro", 15.0), (None, 3.0), ("other", 3.0)])
def test_price_order(spark, m, p):
    df = spark.createDataFrame([(m,)], "model string")
    assert cost.with_price(df).first()["price_in"] == p


def test_cost_bills_writes_as_input_and_no_reasoning(spark):
    df = spark.createDataFrame([("gpt-5", 1000, 500, 2000, 100, 999)], "model string, in_tok long, cw_tok long, cr_tok long, out_tok long, reasoning_tok long")
    assert report.priced(df).first()["cost_usd"] == pytest.approx((1500 * 1.25 + 2000 * 0.125 + 100 * 10) / 1e6)


def test_lexical_tokens(spark):
    assert one(spark, text.lexical_tokens(F.lit("Read the parseJSON file src/app_utils.py and src again, ab"), 9)) == ["read", "parse", "json", "src", "app", "utils", "again"]


def test_paths(spark):
    assert one(spark, text.extract_paths(F.lit("See A/b.JS? and a/b.json, x.tsx y.tsz a.pyx"))) == ["a/b.json", "x.tsx"]
    assert one(spark, text.same_path(F.lit("App/x/retry.py"), F.lit("x/Retry.py")))
    assert not one(spark, text.same_path(F.lit("app/xretry.py"), F.lit("retry.py")))
    assert not one(spark, text.same_path(F.lit(""), F.lit("")))
    assert one(spark, text.paths_named(F.lit("cat src/m1.py lib/m2.py"), F.array(F.lit("m2.py")))) == ["lib/m2.py"]


def test_markers_keep_the_literal_diff_rule(spark):
    assert one(spark, F.regexp_like(F.lit("a\n-S x"), F.lit(text.DIFF)))
    assert not one(spark, F.regexp_like(F.lit("a\n-x"), F.lit(text.DIFF)))
    assert one(spark, F.regexp_like(F.lit("It FAILED"), F.lit(text.ERROR)))


def test_index_percentile_rank(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v long")
    got = report.index_percentiles(df, "v", {"p50": report.at_share(0.5), "p95": report.at_share(0.95), "low": report.at_share_less_one(0.95)}).first()
    assert (got["p50"], got["p95"], got["low"], got["n"]) == (3, 4, 3, 4)
    single = report.index_percentiles(df.where("v = 2"), "v", {"p": report.at_share_less_one(0.95)}).first()
    assert single["p"] == 2


def messages(spark, sizes, request=1):
    rows = [(request, i, "user", "x" * n, "user") for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "request_id long, idx long, role string, text string, kind string")


def test_recency_compaction_charges_the_tail_and_goes_on_after_a_miss(spark):
    m = budget.message_scores(messages(spark, [36, 360, 36, 36, 36, 36, 36]))
    got = {r["idx"]: r["keep"] for r in budget.recency_compaction(m, F.lit(65)).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True, 4: True, 5: True, 6: True}


def pool(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "request_id long, kind string, id string, tokens long, value double, protected boolean")


def test_joint_plan(spark):
    rows = [("m", "p", 10, 0.1, True), ("m", "big", 100, 9.0, False), ("m", "a", 10, 0.5, False), ("t", "b", 10, 0.5, False), ("m", "zero", 0, 0.0, False)]
    got = {r["id"]: r for r in budget.joint_plan(pool(spark, rows), F.lit(30)).collect()}
    assert {k: v["keep"] for k, v in got.items()} == {"p": True, "big": False, "a": True, "b": True, "zero": True}
    assert got["a"]["floor"] == pytest.approx(0.05)
    reason = budget.drop_reasons(budget.joint_plan(pool(spark, rows), F.lit(30))).first()["reason"]
    assert reason == "value/token 0.090000 beat the kept floor 0.050000 but does not fit the 0 tok left after the kept set"


def test_joint_plan_over_budget_decides_nothing(spark):
    rows = [("m", "p", 50, 0.1, True), ("m", "a", 1, 0.5, False)]
    plan = budget.joint_plan(pool(spark, rows), F.lit(30))
    assert {r["id"]: r["keep"] for r in plan.collect()} == {"p": True, "a": None}
    total = budget.budget_totals(plan).first()
    assert (total["over_budget"], total["tokens_after"], total["n_dropped"]) == (True, 50, 0)


def test_evidence_is_booked_within_its_share(spark):
    rows = [(1, "0", 0, 10, 1.0, False, 0.9), (1, "1", 1, 30, 1.0, False, 0.8), (1, "2", 2, 8, 1.0, True, 0.95), (1, "3", 3, 1, 1.0, False, 0.7)]
    df = spark.createDataFrame(rows, "request_id long, id string, idx long, tokens long, value double, protected boolean, evidence double")
    got = {r["id"]: r["protected"] for r in budget.book_evidence(df, F.lit(40)).collect()}
    assert got == {"0": True, "1": False, "2": True, "3": False}


def test_core_floor_and_scores(spark):
    rows = [(1, i, f"t{i}", ["word"] if i == 3 else ["none"], ["word"]) for i in range(8)]
    t = budget.core_floor(budget.tool_scores(spark.createDataFrame(rows, "request_id long, pos int, name string, terms array<string>, query_terms array<string>")))
    assert [r["pos"] for r in t.where("keep").orderBy("pos").collect()] == [0, 1, 2, 3, 4, 5]


def test_pluggable_scorer_keeps_the_old_answer_without_a_new_one(spark):
    import pandas as pd

    rows = [("s", "a", "compact", True), ("s", "b", "compact", False), ("s", "c", "compact", False)]
    df = spark.createDataFrame(rows, "state string, option string, slot string, keep boolean")
    got = budget.score_options(df, lambda b: pd.Series([{"a": 0.1, "c": 0.45}.get(o) for o in b.option], dtype="float64"))
    assert {r["option"]: r["keep"] for r in got.collect()} == {"a": False, "b": False, "c": True}


def test_search_tiers_and_boosts(spark):
    files = spark.createDataFrame([("a/parser.md", "# Lexer notes\nwords here"), ("b/other.md", "title\nparser inside"), ("c/z.md", "nothing")], "path string, src string")
    queries = spark.createDataFrame([(1, "parser lexer", "z.md")], "item_id long, text string, mention string")
    edges = spark.createDataFrame([("b/other.md", "c/z.md")], "src string, dst string")
    got = {r["path"]: r["score"] for r in index.search(queries, files.select("path"), index.heading_symbols(files), index.hint_terms(files), edges).collect()}
    assert got == {"a/parser.md": 5.0, "b/other.md": 5.0, "c/z.md": 8.0}


def test_a_plan_reads_the_searched_files_once(spark):
    files = spark.createDataFrame([("a/parser.md", "# Lexer notes"), ("b/other.md", "parser inside"), ("c/z.md", "none")], "path string, src string")
    queries = spark.createDataFrame([(1, "parser lexer", "z.md"), (1, "parser lexer", "z.md")], "item_id long, text string, mention string")
    looked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counting(text):
        looked.add(1)
        return text

    seen = files.select("path", counting.asNondeterministic()("src").alias("src"))
    edges = spark.createDataFrame([], "src string, dst string")
    ranked = index.search(queries, files.select("path"), index.heading_symbols(seen), index.hint_terms(files), edges).select(F.col("item_id").alias("request_id"), "path", "score")
    messages = spark.createDataFrame([(1, 0, "user", 5, 0.5, True)], "request_id long, idx int, kind string, tokens long, score double, tail boolean")
    named = spark.createDataFrame([(1, 0, "z.md")], "request_id long, idx int, path string")
    tools = spark.createDataFrame([(1, "read", 3, 0.5, True, True)], "request_id long, name string, tokens long, score double, core boolean, keep boolean")
    pool = budget.candidate_pool(messages, named, tools, ranked, named.select("request_id", "path"))
    plan = budget.joint_plan(pool, F.lit(50)).collect()
    assert {(r["kind"], r["id"], round(r["value"], 4)) for r in plan} == {("message", "000000", 1.0), ("tool", "read", 0.5), ("file", "a/parser.md", 0.8333), ("file", "b/other.md", 0.5), ("file", "c/z.md", 0.25)}
    assert looked.value == files.count()


def test_arms_are_paired_without_a_pivot(spark):
    rows = [(1, "a", None), (1, "a", 5), (1, "b", 6), (2, "a", 7), (3, "a", 1), (3, "b", 2), (3, "c", 9)]
    paired = evaluate.paired_arms(spark.createDataFrame(rows, "task long, arm string, value long").coalesce(1), ["a", "b"])
    assert sorted(map(tuple, paired.collect())) == [(1, 5, 6), (3, 1, 2)]
    assert "pivot" not in paired._jdf.queryExecution().optimizedPlan().toString().lower()


def test_hint_terms_are_the_first_in_order_and_never_null(spark):
    files = spark.createDataFrame([("a/zoo.md", "Delta alpha ALPHA beta"), (None, "gamma beta")], "path string, src string")
    got = sorted(tuple(r) for r in index.hint_terms(files, most=2).where("path is not null").collect())
    assert got == [("a/zoo.md", "alpha"), ("a/zoo.md", "beta")]
    assert sorted(r["term"] for r in index.hint_terms(files).where("path is null").collect()) == ["beta", "gamma"]


def test_a_tool_plan_searches_once(spark, monkeypatch):
    looked, search = spark.sparkContext.accumulator(0), queries_budget.searched

    @F.udf("string")
    def counting(text):
        looked.add(1)
        return text

    monkeypatch.setattr(queries_budget, "searched", lambda spark, d, k=12: search(spark, d, k).withColumn("path", counting.asNondeterministic()("path")))
    assert queries_budget.k8t(spark, SMALL).count() > 0
    assert looked.value == search(spark, SMALL, 10).count()


def test_imports(spark):
    files = spark.createDataFrame([("app/util.py",), ("web/index.js",)], "path string")
    specs = spark.createDataFrame([("app/main.py", "app.util"), ("app/main.py", "os"), ("x.js", "./web")], "src string, spec string")
    assert {tuple(r) for r in index.resolve_imports(specs, files).collect()} == {("app/main.py", "app/util.py"), ("app/main.py", "ext:os"), ("x.js", "web/index.js")}


def test_reruns_and_corrections(spark):
    r = spark.createDataFrame([(1, "a", 0.0), (2, "a", 1800.0), (3, "a", 3601.0), (4, "b", 0.0)], "id long, body_sha string, ts_epoch double")
    assert [tuple(x) for x in labels.reruns(r).collect()] == [(1, 2)]
    t = spark.createDataFrame([(1, 1, "do it", True), (1, 2, "No, that is wrong", True), (1, 3, "still broken", False), (1, 4, "try again", True)], "session long, turn long, text string, has_body boolean")
    assert sorted(x["turn"] for x in labels.corrections(t).collect()) == [1, 2]


def test_growth_and_nearest_eviction(spark):
    f = spark.createDataFrame([(1, 1, 1, "a/x.py", 1, 0.0, 5), (1, 2, 2, "a/x.py", 1, 10.0, 5), (1, 9, 3, "a/x.py", 2, 90.0, 7)], "session long, turn long, turn_no long, path string, n long, ts_epoch double, tokens long")
    grown = labels.growth(f)
    assert sorted(r["turn"] for r in grown.collect()) == [1, 9]
    e = spark.createDataFrame([(1, 3, "x.py", 20.0, 40), (1, 5, "X.py", 30.0, 50), (1, 8, "yx.py", 80.0, 60)], "session long, turn long, path string, ts_epoch double, tokens long")
    assert [(r["turn"], r["e_turn"], r["evicted_tok"]) for r in labels.blamed(grown, e).collect()] == [(9, 5, 50)]


def test_spellings_fold(spark):
    rows = [(1, "x.py", 1, 5, 1), (1, "app/x.py", 2, 6, 2), (1, "other/y.py", 1, 7, 3)]
    got = paths.fold_spellings(spark.createDataFrame(rows, "request_id long, path string, fetches long, tokens long, first_pos long"))
    assert {(r["path"], r["fetches"], r["tokens"]) for r in got.collect()} == {("app/x.py", 3, 6), ("other/y.py", 1, 7)}


def test_evicted_files_skip_search_only(spark):
    e = spark.createDataFrame([(1, 5), (1, 20)], "request_id long, idx long")
    seen = spark.createDataFrame([(1, 3, "A.py", False, 10), (1, 19, "b.py", True, 10), (1, 2, "c.py", False, 10)], "request_id long, idx long, path string, is_search boolean, tokens long")
    assert [(r["path"], r["idx"]) for r in labels.evicted_files(e, seen).collect()] == [("a.py", 5)]


def test_split_has_no_key_in_both_parts_and_the_exact_size(spark):
    df = spark.range(1000).select((F.col("id") % 101).alias("k"), "id").repartition(7)
    got = dataset.split_train_val(df, "k", 0.2)
    parts = {r["k"]: r["part"] for r in got.select("k", "part").distinct().collect()}
    assert len(parts) == 101 and sum(p == "train" for p in parts.values()) == 81
    again = {r["k"]: r["part"] for r in dataset.split_train_val(df.coalesce(1), "k", 0.2).select("k", "part").distinct().collect()}
    assert parts == again


def test_versions(spark):
    h = spark.createDataFrame([("v1", "ran", 0, 1), ("v12", "refused", 1, 2), ("v3", "ran", 0, 3)], "version string, status string, exit int, at int")
    assert dataset.next_version(h).first()[0] == 13
    assert dataset.latest_completed(h).first()["version"] == "v3"


def test_backend_ranking(spark):
    e = spark.createDataFrame([("m1", 0.9, 100.0), ("heuristic", 0.9, 0.0), ("m2", 0.95, 900.0), ("m3", 0.9, None), ("m4", None, 1.0)], "label string, precision double, latency_ms double")
    assert [r["label"] for r in evaluate.rank_backends(e, None, 350).orderBy("rank").collect()] == ["heuristic", "m1", "m3"]


def test_set_scores_of_empty_sides(spark):
    none = spark.createDataFrame([], "k int")
    got = evaluate.set_scores(none, none, ["k"]).first()
    assert (got["precision"], got["recall"], got["f1"]) == (1.0, 1.0, 1.0)


def test_bodies(spark, tmp_path):
    good = {"system": "be brief", "tools": [{"name": "read", "description": "d"}], "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": [{"type": "tool_use", "name": "read", "input": {"path": "a.py"}}]}, {"role": "user", "content": [{"type": "tool_result", "content": "text"}]}]}
    (tmp_path / "anthropic_0123456789ab.json.gz").write_bytes(gzip.compress(json.dumps(good).encode()))
    (tmp_path / "openai_aaaaaaaaaaaa.json").write_text("{broken")
    rows = logs.read_bodies(spark, str(tmp_path))
    assert {(r["dialect"], r["body_sha"], r["ok"]) for r in rows.collect()} == {("anthropic", "0123456789ab", True), ("openai", "aaaaaaaaaaaa", False)}
    own = rows.where("ok").withColumn("request_id", F.lit(1))
    assert [(r["idx"], r["kind"]) for r in bodies.messages(own).orderBy("idx").collect()] == [(0, "system"), (1, "user"), (2, "assistant_tool_call"), (3, "tool_result")]
    assert [r["name"] for r in bodies.tools(own).collect()] == ["read"]


def test_other_dialects(spark):
    gem = {"systemInstruction": {"parts": [{"text": "sys"}]}, "contents": [{"role": "user", "parts": [{"text": "hello"}]}, {"role": "model", "parts": [{"functionCall": {"name": "f"}}]}], "tools": [{"functionDeclarations": [{"name": "f"}, {"name": "g"}]}]}
    chat = {"messages": [{"role": "system", "content": "s"}, {"role": "tool", "content": "r"}], "tools": [{"type": "function", "function": {"name": "h"}}]}
    resp = {"instructions": "i", "input": [{"role": "user"}]}
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate((gem, chat, resp))], "request_id long, body string")
    kinds = {}
    for r in bodies.messages(df).orderBy("request_id", "idx").collect():
        kinds.setdefault(r["request_id"], []).append(r["kind"])
    assert kinds == {0: ["system", "user", "assistant_tool_call"], 1: ["system", "tool_result"]}
    assert sorted(r["name"] for r in bodies.tools(df).collect()) == ["f", "g", "h"]


def test_keys_and_symbols(spark):
    files = spark.createDataFrame([("a.json", '{"One": {"two": 1}}'), ("b.csv", "x,Y\n1,2"), ("c.yaml", "key: v\nlist:\n  - name: http://x")], "path string, src string")
    got = {(r["path"], r["term"]) for r in bodies.json_keys(files).collect()}
    assert got == {("a.json", "one"), ("a.json", "two"), ("b.csv", "x"), ("b.csv", "y"), ("c.yaml", "key"), ("c.yaml", "list"), ("c.yaml", "name")}
    nested = [("a.json", '{"x": {"y": [{"z": 1, "w": 2}, {"q": 3}]}, "v": 2}'), ("b.json", '{"broken": 1, "x": '), ("c.yaml", "top:\n  # no: key\n  in: 1\n  deep:\n    - item: 2\n    low: 3\nnext: 4\nurl http://x\n"), ("d.txt", '{"k": 1}'), ("e.json", None)]
    paths = {}
    for r in bodies.key_paths(spark.createDataFrame(nested, "path string, src string")).collect():
        paths.setdefault(r["path"], []).append(r["term"])
    assert paths == {"a.json": ["x", "x.y", "x.y[].z", "x.y[].w", "v"], "b.json": ["broken", "x"], "c.yaml": ["top", "top.in", "top.deep", "top.deep.low", "next"]}
    quoted = spark.createDataFrame([("q.py", '"""def no(): pass"""\nimport a.b, c\ndef f():\n    from .d import e\nX = 1\n'), ("bad.py", "def (")], "path string, src string")
    assert {(r["term"], r["kind"]) for r in bodies.code_symbols(quoted).collect()} == {("f", "symbol"), ("X", "symbol"), ("a.b", "import"), ("c", "import"), (".d", "import")}
    code = spark.createDataFrame([("m.py", "import os\nclass A:\n    def run(self): pass"), ("n.ts", "import x from './lib'\nexport function go() {}")], "path string, src string")
    assert {(r["term"], r["kind"]) for r in bodies.code_symbols(code).collect()} == {("os", "import"), ("A", "symbol"), ("run", "symbol"), ("./lib", "import"), ("go", "symbol")}


def test_files_and_logs(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name in ("src/A.PY", "src/b.bin", "node_modules/c.js"):
        (tmp_path / name).write_text("x")
    assert [r["path"].rsplit("/", 1)[1] for r in logs.read_repo(spark, str(tmp_path)).collect()] == ["A.PY"]
    (tmp_path / "tasks.jsonl").write_text('{"id": "1", "task": "t", "context": [{"path": "a", "stale": true}]}\n\n{"id": "2"}\n')
    assert logs.read_tasks(spark, str(tmp_path / "tasks.jsonl")).count() == 2
    (tmp_path / "e.json").write_text(json.dumps({"baseline": {"precision": 0.5}, "adapters": [{"label": "a", "precision": 0.7, "latency": {"p50": 12}}, {"label": "b", "precision": 0.6, "latency": 3}, {"label": "c", "latency": 3}]}))
    assert {(r["label"], r["latency_ms"]) for r in logs.load_evidence(spark, str(tmp_path / "e.json")).collect()} == {("heuristic", 0.0), ("a", 12.0), ("b", 3.0)}
    m = spark.createDataFrame([([("v1", "x"), (None, "y"), ("v1", "z")], "v9")], "versions array<struct<label: string, version: string>>, active string")
    versions, warnings = logs.manifest_rows(m)
    assert [(r["label"], r["version"], r["active"]) for r in versions.collect()] == [("v1", "x", False)] and warnings.count() == 1


def test_streams_match_their_batch_twins(spark, tmp_path):
    from tests.comparing import SMALL
    from wakeline.plans.views import view

    vr = view(spark, SMALL, "vr").where("status < 600").select("*")
    src = str(tmp_path / "vr")
    vr.repartition(1).sortWithinPartitions("id").write.parquet(src)
    stream = spark.readStream.schema(vr.schema).parquet(src)
    q = jobs.live_by_day(stream).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("live").collect())) == sorted(map(tuple, report.by_day(vr).select("day", "n", "cost", "in_tok", "out_tok").collect()))


def test_frames_cut_anywhere(spark):
    df = spark.createDataFrame([(1, 0, "a: 1\n"), (1, 1, "\nb"), (1, 2, ": 2\r\n\r\n"), (1, 3, "rest")], "request_id long, seq long, payload string")
    assert [r["frame"] for r in jobs.reassembled(df).orderBy("seq").collect()] == ["a: 1", "b: 2", "rest"]


def test_stateful_streams(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    from tests.comparing import SMALL
    from wakeline.plans.views import view

    for name, job, twin, cols in (("vs", jobs.stream_frame_usage, jobs.frame_usage, ["request_id", "input", "output"]), ("vr", jobs.stream_reruns, labels.reruns, ["request_id", "again_id"])):
        rows = view(spark, SMALL, name)
        src = str(tmp_path / name)
        rows.repartition(1).write.parquet(src)
        q = job(spark.readStream.schema(rows.schema).parquet(src)).writeStream.format("memory").queryName(f"s_{name}").outputMode("update" if name == "vs" else "append").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert sorted(map(tuple, spark.table(f"s_{name}").select(*cols).collect())) == sorted(map(tuple, twin(rows).select(*cols).collect()))


@pytest.fixture
def few_partitions(spark):
    """State stores in two partitions: each has a Python worker of its own in every batch."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def in_batches(spark, rows, order, path, parts=2):
    """rows as a stream of parts in order, one file each."""
    import time

    n = rows.count()
    ranked = sorted(rows.collect(), key=lambda r: r[order])
    for i in range(parts):
        spark.createDataFrame(ranked[i * n // parts : (i + 1) * n // parts], rows.schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def finished(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    return stream.sparkSession.table(name)


def test_rereads_as_they_arrive(spark, tmp_path, few_partitions):
    pytest.importorskip("google.protobuf")
    from tests.comparing import SMALL
    from wakeline.plans.views import view

    vp = labels.windowed_fetches(view(spark, SMALL, "vp")).withColumn("n", F.col("n").cast("long"))
    want = labels.blamed(labels.growth(vp.withColumn("turn_no", F.col("turn"))), vp.where("evicted"), 8, 40_000.0)
    got = finished(jobs.stream_rereads(in_batches(spark, vp, "turn", str(tmp_path / "vp")), 8, 40_000.0), "rereads")
    names = ["session", "turn", "path", "e_turn", "evicted_tok", "regret_tok"]
    rows = sorted(map(tuple, got.select(*names).collect()))
    assert rows == sorted(map(tuple, want.select(*names).collect())) and rows


def test_frames_as_they_arrive(spark, tmp_path, few_partitions):
    pytest.importorskip("google.protobuf")
    chunks = [(1, 0, "a: 1\n", False), (1, 1, "\nb", False), (2, 2, "x\r", False), (1, 3, ": 2\r\n\r", False), (2, 4, "\n\r\ny\n\n\n", False), (1, 5, "\nrest", True), (2, 6, "\nz\n\n", True)]
    df = spark.createDataFrame(chunks, "request_id long, seq long, payload string, done boolean").withColumn("ts_epoch", F.col("seq") + 1000.0).coalesce(1)
    got = finished(jobs.stream_reassembled(in_batches(spark, df, "seq", str(tmp_path / "c"))), "frames")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.reassembled(df).collect()))


def test_late_rows_go_to_a_side_table(spark, tmp_path, few_partitions):
    pytest.importorskip("google.protobuf")
    rows = [(s, i, float(t)) for i, (s, t) in enumerate([(1, 100), (1, 50), (2, 10), (1, 200), (1, 139), (2, 5), (1, 141), (2, 300), (2, 1)])]
    df = spark.createDataFrame(rows, "session long, id long, ts_epoch double")
    stream = jobs.stream_on_time(in_batches(spark, df, "id", str(tmp_path / "r")), 60.0)
    counts = []
    jobs.write_by_lateness(stream, str(tmp_path / "out"), str(tmp_path / "check"), lambda n, c: counts.append(c)).awaitTermination(240)
    out = spark.read.parquet(str(tmp_path / "out"))
    late = {r["id"] for r in out.where("place = 'late'").collect()}
    assert late == {r["id"] for r in jobs.on_time(df, 60.0).where("late").collect()} == {4, 8}
    assert {r["id"] for r in out.where("place = 'on_time'").collect()} == set(range(9)) - late
    assert sum(c["late"] for c in counts) == 2 and sum(c["on_time"] for c in counts) == 7


def test_results_hold_under_any_partitioning(spark):
    from tests.comparing import SMALL, spark_rows
    from wakeline.plans.views import view

    va, vm = view(spark, SMALL, "va"), view(spark, SMALL, "vm")
    for f, rows in (
        (evaluate.cut_by_quartile, va),
        (lambda r: evaluate.bootstrap_interval(r, "task", "observe", 40), va),
        (lambda r: dataset.fingerprint(r, ["task", "observe"]), va),
        (lambda r: dataset.split_train_val(r, "task"), va),
        (lambda r: report.request_features(r, 100).drop("cat_chars"), vm),
        (lambda r: budget.recency_compaction(budget.message_scores(r), F.lit(500)), vm),
    ):
        assert spark_rows(f(rows.repartition(1))) == spark_rows(f(rows.repartition(7)))


@pytest.mark.parametrize(("tail", "want"), [(3, "def"), (4, "\ndef"), (5, "\n\ndef"), (6, "c\n\ndef"), (8, "abc\n\ndef")])
def test_the_tail_of_a_request_counts_the_line_breaks(spark, tail, want):
    rows = [(1, 0, "user", "abc"), (1, 1, "assistant", None), (1, 2, "user", "def")]
    messages = spark.createDataFrame(rows, "request_id long, idx int, kind string, text string")
    assert report.request_features(messages, tail).first()["tail"] == want


def test_no_window_over_all_rows(spark):
    """Windows without a key see summaries only: the rows below them come from an aggregate."""
    from tests.comparing import SMALL
    from wakeline.plans.views import view

    va = view(spark, SMALL, "va")
    for df in (evaluate.cut_by_quartile(va), dataset.split_train_val(va, "task"), report.index_percentiles(view(spark, SMALL, "vr"), "latency_ms", {"p": report.at_share(0.5)})):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        for i, line in enumerate(plan):
            if "Window [" in line and "windowspecdefinition(" in line and ("windowspecdefinition(_b" in line or "windowspecdefinition(0" in line or "windowspecdefinition(spec" in line):
                assert any("Aggregate" in x for x in plan[i + 1 : i + 6]), "\n".join(plan[i : i + 6])
