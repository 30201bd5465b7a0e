"""Streams that are stopped for longer than their windows, replay old rows, or never finish a frame."""

import time

import pytest
from pyspark.sql import functions as F

from tests.comparing import SMALL
from wakeline.operators import labels
from wakeline.plans.views import view
from wakeline.streaming import jobs

pytest.importorskip("google.protobuf")


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def stopped_and_started(spark, tmp_path, parts, job, name, pause=0.0, mode="append"):
    """All rows that a stream gives which is stopped after each part of its rows, for pause seconds."""
    src, out, kept = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "kept"))
    for k, part in enumerate(parts):
        if k:
            time.sleep(pause)
        part.coalesce(1).write.mode("append").parquet(src)
        stream = job(spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(src))

        def write(batch, number):
            batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", kept).trigger(availableNow=True).start().awaitTermination(240)
    return spark.read.parquet(out)


def halves(df, order, n=2):
    rows = sorted(df.collect(), key=lambda r: r[order])
    return [df.sparkSession.createDataFrame(rows[k * len(rows) // n : (k + 1) * len(rows) // n], df.schema) for k in range(n)]


def same(got, want, names):
    a, b = (sorted(map(tuple, x.select(*names).collect())) for x in (got, want))
    assert a == b and a


def test_reruns_across_a_pause(spark, tmp_path):
    """The pause is longer than the window, the rows' own times are not apart."""
    rows = [(k, f"b{k % 3}", 1000 + k * 0.1) for k in range(20)]
    df = spark.createDataFrame(rows, "id long, body_sha string, ts_epoch double")
    got = stopped_and_started(spark, tmp_path, halves(df, "id"), lambda s: jobs.stream_reruns(s, window_s=0.5, late_s=60.0), "reruns", pause=1.0)
    same(got, labels.reruns(df, 0.5), ["request_id", "again_id"])


def test_rereads_across_a_pause(spark, tmp_path):
    rows = [("a.py", k, k * 0.05, k // 2 + 1, 7 + k, k % 4 == 0) for k in range(1, 25)]
    df = spark.createDataFrame([(1, t, s, p, n, c, e) for p, t, s, n, c, e in rows], "session long, turn long, ts_epoch double, path string, n long, tokens long, evicted boolean")
    want = labels.blamed(labels.growth(df.withColumn("turn_no", F.col("turn"))), df.where("evicted"), 3, 0.5)
    got = stopped_and_started(spark, tmp_path, halves(df, "turn"), lambda s: jobs.stream_rereads(s, 3, 0.5, late_s=60.0), "rereads", pause=1.0)
    same(got, want, ["session", "turn", "path", "e_turn", "evicted_tok", "regret_tok"])


def test_usage_across_a_pause(spark, tmp_path):
    vs = view(spark, SMALL, "vs").where("request_id < 3000")
    got = stopped_and_started(spark, tmp_path, halves(vs, "ts"), lambda s: jobs.stream_frame_usage(s, quiet_s=40 * 86400.0, late_s=40 * 86400.0), "usage", pause=0.5, mode="update")
    last = got.groupBy("request_id").agg(F.max_by("input", "batch").alias("input"), F.max_by("output", "batch").alias("output"))
    same(last, jobs.frame_usage(vs), ["request_id", "input", "output"])


def test_a_frame_that_never_ends_is_flushed(spark, tmp_path):
    """Response 1 is never done; later rows of response 2 move the stream's time past it."""
    rows = [(1, 0, 10.0, "a: 1\n\nb: 2\n\nhalf", False), (2, 1, 11.0, "x\n\n", False), (2, 2, 100.0, "y\n\n", False), (2, 3, 101.0, "z", True)]
    df = spark.createDataFrame(rows, "request_id long, seq long, ts_epoch double, payload string, done boolean")
    got = stopped_and_started(spark, tmp_path, halves(df, "seq", 4), lambda s: jobs.stream_reassembled(s, quiet_s=200.0, late_s=1.0), "open")
    assert sorted((r.request_id, r.seq, r.frame) for r in got.collect()) == [(1, 0, "a: 1"), (1, 1, "b: 2"), (2, 0, "x"), (2, 1, "y"), (2, 2, "z")]
    got = stopped_and_started(spark, tmp_path, halves(df, "seq", 4), lambda s: jobs.stream_reassembled(s, quiet_s=95.0 - 10, late_s=1.0), "ended")
    same(got, jobs.reassembled(df), ["request_id", "seq", "frame"])


def test_late_rows_are_known_after_a_pause(spark, tmp_path):
    rows = [(1, 1, 1000.0), (1, 2, 10.0), (2, 3, 5.0), (1, 4, 990.0), (1, 5, 2.0), (2, 6, 3.0)]
    df = spark.createDataFrame(rows, "session long, id long, ts_epoch double")
    got = stopped_and_started(spark, tmp_path, halves(df, "id", 3), lambda s: jobs.stream_on_time(s, 60.0), "late", pause=0.5)
    same(got, jobs.on_time(df, 60.0), ["session", "id", "late"])
