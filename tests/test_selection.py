"""Exact ranks of skewed and of all-different values, and budgets over pools of any size."""

import random
import time

import pytest
from pyspark.sql import functions as F

from wakeline.operators import budget, evaluate, report, select


@pytest.mark.parametrize("few", [4096, 3])
def test_ranks_of_many_groups(spark, few):
    r = random.Random(few)
    rows = [(g, v) for g, n in (("a", 1), ("b", 700), (None, 40), ("c", 0)) for v in (r.choice([r.randint(-9, 9), r.random() * 1e9, None]) for _ in range(n))]
    rows = [(g, None if v is None else float(v)) for g, v in rows] + [("d", 5.0)] * 500
    df = spark.createDataFrame(rows, "g string, v double")
    ranks = {"first": F.lit(0), "mid": F.floor(F.col("n") / 2), "last": F.col("n") - 1, "none": F.col("n")}
    got = {x.g: (x.n, x.first, x.mid, x.last, x.none) for x in select.values_at(df, "v", ranks, ["g"], few).collect()}
    want = {}
    for g in {x for x, v in rows if v is not None}:
        own = sorted(v for x, v in rows if x == g and v is not None)
        want[g] = (len(own), own[0], own[len(own) // 2], own[-1], None)
    assert got == want


@pytest.mark.parametrize("kind", ["all different", "one outlier", "all equal"])
def test_a_bracket_holds_a_thousandth(spark, kind):
    n = 200_000
    v = {"all different": F.col("id") * 7, "one outlier": F.when(F.col("id") == 5, F.lit(10**12)).otherwise(F.col("id") % 5000), "all equal": F.lit(3)}[kind]
    df = spark.range(n).select(v.alias("v"))
    values = sorted(x.v for x in df.collect())
    ranks = {"low": F.lit(17), "mid": F.floor(F.col("n") * 0.5), "top": F.col("n") - 1}
    got = select.values_at(df, "v", ranks).first()
    assert (got.n, got.low, got.mid, got.top) == (n, values[17], values[n // 2], values[-1])
    # what the last bracket leaves to put in order
    rows = df.select(F.col("v").alias("_v"))
    sketched = rows.agg(F.count("*").alias("here"), select._sketch().alias("q"))
    asked = sketched.select("q", "here", F.lit("mid").alias("name"), F.lit(n // 2).cast("long").alias("rank"), F.lit(0).cast("long").alias("before"))
    brackets = select._bracketed(asked, ["name"])
    assert select._counted(rows, brackets, ["name"], True).where("not below").count() <= n / 1000


def test_no_values(spark):
    none = spark.createDataFrame([], "g string, v long")
    assert select.values_at(none, "v", {"a": F.lit(0)}, ["g"]).count() == 0
    assert tuple(select.values_at(none, "v", {"a": F.lit(0)}).first()) == (0, None)
    assert report.latency_curve(none, 5.0, "v").first().p50 is None


def test_quarters_of_tied_values(spark):
    r = random.Random(4)
    rows = [(k, r.choice([1, 1, 1, 2, 10**12]), 1) for k in r.sample(range(10_000), 403)]
    df = spark.createDataFrame(rows, "task long, observe long, enforce long")
    got = {x.quarter: (x.tasks, x.low, x.high) for x in evaluate.cut_by_quartile(df).collect()}
    ranked = sorted((v, k) for k, v, _ in rows)
    want = {}
    for q in range(4):
        own = [v for i, (v, _) in enumerate(ranked) if sum(i >= 403 * j // 4 for j in (1, 2, 3)) == q]
        want[q] = (len(own), own[0], own[-1])
    assert got == want
    assert evaluate.cut_by_quartile(df.limit(0)).count() == 0


def pool(r, request, n):
    return [(request, r.choice(["message", "tool", "file"]), str(k), r.choice([0, 1, 3, 40, 900]), r.choice([0.0, 0.5, 1.0, r.random()]), r.random() < 0.05, r.choice([0.0, 0.8, 0.9, 0.9]), k) for k in range(n)]


POOL = "request_id long, kind string, id string, tokens long, value double, protected boolean, evidence double, idx long"


def slow_plan(items, most):
    """One request's answers, item after item."""
    held = sum(x[3] for x in items if x[5])
    if held > most:
        return {x[1:3]: (True if x[5] else None, True, None, None, most - held) for x in items}
    left, keep, floor, last = most - held, {}, None, None
    ratio = lambda x: float("inf") if x[3] <= 0 else x[4] / x[3]
    for x in sorted((x for x in items if not x[5]), key=lambda x: (-ratio(x), -x[4], x[1], x[2])):
        keep[x[1:3]] = x[3] <= left
        if x[3] <= left:
            left -= x[3]
            if floor is None or ratio(x) < floor:
                floor, last = ratio(x), x[2]
    return {x[1:3]: (x[5] or keep[x[1:3]], False, floor, last, left) for x in items}


def test_plans_against_a_slow_one(spark):
    r = random.Random(9)
    rows = [x for request, n in ((1, 300), (2, 1), (3, 40), (4, 80)) for x in pool(r, request, n)] + [(5, "tool", "t", 10_000, 1.0, True, 0.0, 0), (5, "file", "f", 1, 1.0, False, 0.0, 1)]
    plan = budget.joint_plan(spark.createDataFrame(rows, POOL), F.lit(2000)).collect()
    got = {x.request_id: {} for x in plan}
    for x in plan:
        got[x.request_id][x.kind, x.id] = (x.keep, x.over_budget, x.floor, x.last_kept, x.left)
    assert got == {q: slow_plan([x for x in rows if x[0] == q], 2000) for q in got} and len(plan) == len(rows)


def test_evidence_against_a_slow_one(spark):
    r = random.Random(10)
    rows = [x for request in range(30) for x in pool(r, request, 25)]
    got = {(x.request_id, x.id): x.protected for x in budget.book_evidence(spark.createDataFrame(rows, POOL), F.lit(3000)).collect()}
    want = {}
    for q in range(30):
        own = [x for x in rows if x[0] == q]
        used, more = sum(x[3] for x in own if x[5]), set()
        for x in sorted((x for x in own if x[6] > 0), key=lambda x: (-x[6], x[7]))[:3]:
            if not x[5] and used + x[3] <= 1800:
                used += x[3]
                more.add(x[2])
        want |= {(q, x[2]): x[5] or x[2] in more for x in own}
    assert got == want


def test_one_request_of_a_million_items(spark):
    """Twice the items take about twice the time, and no array of them is made."""
    took = []
    for n in (250_000, 1_000_000):
        items = spark.range(n).select(F.lit(1).alias("request_id"), F.lit("message").alias("kind"), F.col("id").cast("string").alias("id"), (F.col("id") % 97 + 1).alias("tokens"), (F.col("id") % 13 / 13.0).alias("value"), (F.col("id") < 3).alias("protected"))
        began = time.perf_counter()
        s = budget.joint_plan(items, F.lit(n * 10)).agg(F.count_if("keep").alias("kept"), F.sum(F.when(F.col("keep"), F.col("tokens"))).alias("used")).first()
        took.append(time.perf_counter() - began)
        assert n * 10 - 97 <= s.used <= n * 10 and 0 < s.kept < n
    assert took[1] < 8 * took[0] + 5
