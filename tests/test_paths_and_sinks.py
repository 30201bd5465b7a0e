"""Spellings of paths in bulk, many needles, and sinks that a replay doesn't change."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tests.comparing import SMALL
from wakeline.functions import text
from wakeline.operators import index, labels, needles, paths
from wakeline.plans.views import view
from wakeline.sources import logs


def spells(a, b):
    a, b = a.lower(), b.lower()
    return bool(a and b) and (a == b or a.endswith("/" + b) or b.endswith("/" + a))


def test_meeting_under_endings(spark):
    r = random.Random(6)
    own = ["".join(r.choice(["a/", "b/", "/", "X.py", "x.py", "y.py", "c"]) for _ in range(r.randint(0, 4))) for _ in range(120)]
    left = spark.createDataFrame([(k % 3, k, p) for k, p in enumerate(own)], "g int, i int, path string")
    right = spark.createDataFrame([(k % 3, k, p) for k, p in enumerate(own[::-1])], "g int, j int, other string")
    got = sorted((x.g, x.i, x.j) for x in paths.meet(left, right, ["g"], "path", "other").collect())
    assert got == sorted((k % 3, k, j) for k, p in enumerate(own) for j, q in enumerate(own[::-1]) if k % 3 == j % 3 and spells(p, q))
    same = left.select("i", "path").crossJoin(right.select("j", "other")).where(text.same_path(F.col("path"), F.col("other")))
    assert same.count() == sum(spells(p, q) for p in own for q in own)


def slow_fold(rows):
    """One request: counts by path in order of first appearance, as a loop over what is known."""
    files = []
    for _, path, n, tokens, _, at in sorted(rows, key=lambda x: (x[4], x[1])):
        hit = next((f for f in files if spells(f[0], path)), None)
        if hit is None:
            files.append([path, n, tokens, at])
            continue
        hit[1] += n
        if at > hit[3]:
            hit[2:] = [tokens, at]
        if path.count("/") > hit[0].count("/"):
            files.remove(hit)
            files.append([path, *hit[1:]])
    return sorted((f[0], f[1], f[2]) for f in files)


def test_spellings_against_a_slow_fold(spark):
    r = random.Random(8)
    rows = []
    for request in range(40):
        names = {"/".join(r.choice("abc") for _ in range(r.randint(0, 3))) + r.choice(["/", ""]) + r.choice(["x.py", "y.py"]) for _ in range(12)}
        rows += [(request, p, r.randint(1, 3), r.randint(1, 99), r.randint(0, 50), r.randint(51, 90)) for p in names]
    got = {}
    for x in paths.fold_spellings(spark.createDataFrame(rows, "request_id long, path string, fetches long, tokens long, first_pos long, last_pos long")).collect():
        got.setdefault(x.request_id, []).append((x.path, x.fetches, x.tokens))
    assert {k: sorted(v) for k, v in got.items()} == {q: slow_fold([x for x in rows if x[0] == q]) for q in range(40)}


def test_very_many_files_of_one_base_name(spark):
    """100,000 files called __init__.py in one request and one session: as many steps, not their square."""
    n = 100_000
    files = spark.range(n).select(F.lit(1).alias("request_id"), F.concat(F.lit("pkg/m"), F.col("id").cast("string"), F.lit("/__init__.py")).alias("path"), F.lit(1).alias("fetches"), F.lit(2).alias("tokens"), F.col("id").alias("first_pos"))
    began = time.perf_counter()
    assert paths.fold_spellings(files).count() == n
    cut = files.select(F.lit(1).alias("session"), F.lit(3).alias("turn"), "path", F.lit(10.0).alias("ts_epoch"), "tokens")
    grown = cut.withColumn("turn", F.lit(5)).withColumn("path", F.concat(F.lit("/repo/"), "path"))
    assert labels.blamed(grown, cut).count() == n
    named = files.select("request_id", F.col("first_pos").alias("idx"), F.col("path").alias("named"))
    ranked = files.select("request_id", "path", F.lit(2.0).alias("score"))
    assert index.couple_evidence(named, ranked).count() == n
    assert time.perf_counter() - began < 90


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_very_many_needles(spark, bound):
    n = 100_000 if bound else 2_000
    wanted = spark.range(n).select(F.concat(F.lit("Mod_"), F.col("id").cast("string"), F.lit(".")).alias("needle")).unionByName(spark.createDataFrame([("",), ("zz",)], "needle string"))
    rows = [(k, f"see src/mod_{k * 7}.py, LIB/MOD_{k}.py and src/mod_{k * 7}.py or x/zzz.md, not mod_1") for k in range(60)]
    got = sorted((x.id, x.path) for x in needles.paths_naming(spark.createDataFrame(rows, "id long, text string"), wanted, bound=bound * 8).collect())
    assert got == sorted((k, p) for k, _ in rows for p in {f"src/mod_{k * 7}.py", f"lib/mod_{k}.py", "x/zzz.md"})
    few = F.array(*(F.lit(x) for x in ("mod_7.", "zz")))
    one = spark.createDataFrame(rows, "id long, text string")
    assert sorted((x.id, p) for x in one.select("id", text.paths_named(F.lower("text"), few).alias("p")).collect() for p in x.p) == sorted((x.id, x.path) for x in needles.paths_naming(one, spark.createDataFrame([("mod_7.",), ("zz",)], "needle string")).collect())


def test_first_text_inside(spark):
    rows = ['"  a \\n b "', '{"text": " "}', '{"description": "d", "content": ["", {"no": 1}, {"input": "in"}]}', "[]", "7", "plain  words", None, '{"input": {"input": {"input": {"input": "deep"}}}}', '{"input": {"input": {"input": {"input": {"input": "deeper"}}}}}', '[[["x"]]]']
    got = {x.id: x.text for x in text.first_texts(spark.createDataFrame(list(enumerate(rows)), "id long, value string")).collect()}
    assert got == dict(enumerate(["a b", "", "in", "", "", "plain words", "", "deep", "", "x"]))


# ---- sinks --------------------------------------------------------------------------------------


def test_a_batch_written_again_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "2026-01-01"), (2, "2026-01-01"), (3, "2026-01-02")], "id long, day string")
    assert logs.append_requests(rows, out, 0) == {"rows": 3, "first_day": "2026-01-01", "last_day": "2026-01-02"}
    logs.append_requests(rows.where("id = 2").withColumn("id", F.lit(9)), out, 1)
    logs.append_requests(rows, out, 0)
    assert sorted((r.id, r.batch) for r in spark.read.parquet(out).collect()) == [(1, 0), (2, 0), (3, 0), (9, 1)]


def test_a_replayed_stream_changes_nothing(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    vr = logs.to_request_rows(view(spark, SMALL, "vr").limit(200))
    vr.repartition(1).write.parquet(src)
    counts = {}
    for k in range(2):  # the second run has lost its checkpoint and starts again
        stream = spark.readStream.schema(vr.schema).parquet(src)
        logs.stream_requests(stream, out, str(tmp_path / f"kept{k}"), lambda n, c: counts.setdefault(n, c)).awaitTermination(120)
    assert spark.read.parquet(out).count() == 200 and counts[0]["rows"] == 200


def test_export_and_split_come_back(spark, tmp_path):
    split = spark.createDataFrame([("k1", "train", "keep", None), ("k2", "val", "drop", "x")], "body_sha string, part string, answer string, note string")
    logs.write_split(split, str(tmp_path / "split"))
    assert sorted((r.body_sha, r.part, r.answer) for r in spark.read.json(str(tmp_path / "split")).collect()) == [("k1", "train", "keep"), ("k2", "val", "drop")]
    assert spark.read.json(str(tmp_path / "split/part=val")).count() == 1
    rows = logs.export_rows(spark.createDataFrame([(1, "compact", [1]), (2, "effort", [2])], "request_id long, slot string, candidates array<int>"), spark.createDataFrame([(1, "compact", "good")], "request_id long, slot string, verdict string"), slim=True)
    logs.write_export(rows, str(tmp_path / "export"))
    back = spark.read.json(str(tmp_path / "export"))
    assert "candidates" not in back.columns and sorted((r.request_id, r.verdict, r.label_source) for r in back.collect()) == [(1, "good", "human"), (2, None, "none")]


def test_labels_of_a_store(spark):
    store = spark.createDataFrame([(1, {"compact": "good", "effort": "bad"}), (2, {})], "request_id long, verdicts map<string, string>")
    assert sorted(map(tuple, logs.read_labels(store).collect())) == [(1, "compact", "good"), (1, "effort", "bad")]
