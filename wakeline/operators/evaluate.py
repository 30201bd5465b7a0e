"""Comparing alternatives: sets, arms, intervals, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .report import index_percentiles
from .select import values_at


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(1.0))


def set_scores(gold: DataFrame, predicted: DataFrame, keys: list[str], case: str | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of predicted against gold, over all or by case; an empty side scores 1."""
    g = gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    p = predicted.select(*keys).distinct().withColumn("_p", F.lit(1))
    j = g.join(p, keys, "full")
    group = [case] if case else []
    c = j.groupBy(*group).agg(F.count_if(F.col("_g").isNotNull() & F.col("_p").isNotNull()).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    c = c.withColumn("precision", F.round(_share(F.col("tp"), F.col("tp") + F.col("fp")), 4)).withColumn("recall", F.round(_share(F.col("tp"), F.col("tp") + F.col("fn")), 4))
    return c.withColumn("f1", F.round(_share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 4))


def agreement(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Share of options on which two keep columns agree."""
    j = a.select(*keys, F.col("keep").alias("x")).join(b.select(*keys, F.col("keep").alias("y")), keys)
    return j.agg(F.count("*").alias("n"), F.round(F.avg((F.col("x") == F.col("y")).cast("int")), 4).alias("agreement"))


def corpus_ceiling(cases: DataFrame) -> DataFrame:
    """cases (case_id, item, gold, baseline: whether the item is in either set): equal ones, false keeps and false cuts."""
    sides = cases.groupBy("case_id", "item").agg(F.bool_or("gold").alias("g"), F.bool_or("baseline").alias("b"))
    rows = sides.groupBy("case_id").agg(F.count_if(F.col("b") & ~F.col("g")).alias("keeps"), F.count_if(F.col("g") & ~F.col("b")).alias("cuts"))
    return rows.agg(F.count("*").alias("cases"), F.count_if((F.col("keeps") == 0) & (F.col("cuts") == 0)).alias("equal"), F.sum("keeps").alias("false_keeps"), F.sum("cuts").alias("false_cuts"))


def survival(items: DataFrame) -> DataFrame:
    """items (task, tokens, needed, kept): recall and precision by tokens, and whether all that is needed is there."""
    needed, both, kept = (F.sum(F.when(c, F.col("tokens")).otherwise(0)) for c in (F.col("needed"), F.col("needed") & F.col("kept"), F.col("kept")))
    return items.groupBy("task").agg(F.round(_share(both, needed), 4).alias("recall"), F.round(_share(both, kept), 4).alias("precision"), (F.count_if(F.col("needed") & ~F.col("kept")) == 0).alias("passed"))


def paired_arms(rows: DataFrame, arms: list[str]) -> DataFrame:
    """rows (task, arm, value) as one row for each task that has all arms."""
    # a number for each arm, so that a task's rows become one where they are read; a pivot keeps a row for each arm until they are sorted
    wide = rows.groupBy("task").agg(*(F.first(F.when(F.col("arm") == arm, F.col("value")), ignorenulls=True).alias(arm) for arm in arms))
    return wide.dropna(subset=arms)


def arm_summary(arms: DataFrame, base: str = "observe", other: str = "enforce", min_cut: float = 0.02) -> DataFrame:
    """Means and medians, the mean of ratios and the ratio of sums of the cut, the pass rates, and a verdict with reasons.

    With pass_base and pass_other (else pass stands for both) their difference has a 95 % interval (normal approximation for paired tasks).
    """
    own = {"pass_base", "pass_other"} <= set(arms.columns)
    arms = arms.select(base, other, *(["pass_base", "pass_other"] if own else ["pass"])).persist()  # read once for the sums and once for each pass of the medians
    before, after = (F.col(c if own else "pass").cast("int") for c in ("pass_base", "pass_other"))
    ratio = F.try_divide((F.col(base) - F.col(other)).cast("double"), F.col(base))
    out = arms.agg(F.count("*").alias("n"), F.round(F.avg(base), 2).alias("mean_base"), F.round(F.avg(other), 2).alias("mean_other"), F.round(F.avg(ratio), 6).alias("mean_of_ratios"), F.round(F.try_divide((F.sum(base) - F.sum(other)).cast("double"), F.sum(base)), 6).alias("ratio_of_sums"), F.round(F.avg(after), 4).alias("pass_rate"), F.round(F.avg(after - before), 4).alias("pass_delta"), F.coalesce(F.stddev_samp(after - before) / F.sqrt(F.count("*")) * 1.96, F.lit(0.0)).alias("_half"))
    out = out.withColumn("delta_low", F.round(F.col("pass_delta") - F.col("_half"), 4)).withColumn("delta_high", F.round(F.col("pass_delta") + F.col("_half"), 4)).drop("_half")
    both = arms.select(F.explode(F.array(*(F.struct(F.lit(name).alias("arm"), F.col(c).alias("value")) for name, c in (("base", base), ("other", other))))).alias("x")).select("x.*")
    middle = values_at(both, "value", {"low": F.floor((F.col("n") - 1) / 2), "high": F.ceil((F.col("n") - 1) / 2)}, ["arm"])
    medians = middle.groupBy().agg(*(F.max(F.when(F.col("arm") == arm, (F.col("low") + F.col("high")) / 2)).alias(f"p50_{arm}") for arm in ("base", "other")))
    out = out.join(F.broadcast(medians))  # one row each
    reasons = F.array_join(F.array_compact(F.array(F.when(F.col("n") == 0, "no pairs"), F.when(F.col("ratio_of_sums") < min_cut, "cut too small"))), "; ")
    return out.withColumn("reasons", reasons).withColumn("passed", F.col("reasons") == "")


def cut_by_family(arms: DataFrame, base: str = "observe", other: str = "enforce") -> DataFrame:
    return arms.groupBy("family").agg(F.count("*").alias("n"), F.round(F.avg(base), 2).alias("mean_base"), F.round(F.avg(other), 2).alias("mean_other"), F.round(F.try_divide((F.sum(base) - F.sum(other)).cast("double"), F.sum(base)), 6).alias("cut"))


def cut_by_quartile(arms: DataFrame, base: str = "observe", other: str = "enforce", key: str = "task") -> DataFrame:
    """Quarters of the tasks by size: ranks in [i n / 4, (i + 1) n / 4) by integer division.

    A quarter begins at a value and, among the rows of that value, at a key (a number): both are
    selected at their exact ranks, so no rows are ranked.
    """
    rows = arms.select(F.col(key).alias("key"), F.col(base).alias("base"), F.col(other).alias("other")).where("base is not null").persist()
    places = (1, 2, 3)
    ends = values_at(rows, "base", {f"v{i}": F.floor(F.col("n") * i / 4) for i in places}).first()
    quarter = F.lit(0)
    if ends["n"]:
        below = rows.agg(*(F.count_if(F.col("base") < ends[f"v{i}"]).alias(f"b{i}") for i in places)).first()
        tied = F.explode(F.array_compact(F.array(*(F.when(F.col("base") == ends[f"v{i}"], i) for i in places))))
        rest = {f"k{i}": F.lit(ends["n"] * i // 4 - below[f"b{i}"]) for i in places}
        keys = {r["place"]: r for r in values_at(rows.select("key", tied.alias("place")), "key", rest, ["place"]).collect()}  # three rows
        for i in places:
            quarter = quarter + ((F.col("base") > ends[f"v{i}"]) | (F.col("base") == ends[f"v{i}"]) & (F.col("key") >= keys[i][f"k{i}"])).cast("int")
    cut = F.round(F.try_divide((F.sum("base") - F.sum("other")).cast("double"), F.sum("base")), 6)
    return rows.groupBy(quarter.alias("quarter")).agg(F.count("*").alias("tasks"), F.min("base").alias("low"), F.max("base").alias("high"), cut.alias("cut"))


def composition(parts: DataFrame, total: float | None = None) -> DataFrame:
    """parts (task, part, tokens): mean tokens by part over all tasks, scaled so that the parts sum to the mean total (or to total)."""
    sums = parts.groupBy("part").agg(F.sum("tokens").alias("s"))
    n = parts.agg(F.count_distinct("task").alias("n"), F.sum("tokens").alias("t"))
    mean = F.try_divide(F.col("s").cast("double"), F.col("n"))
    scale = F.lit(1.0) if total is None else F.try_divide(F.lit(float(total)), F.try_divide(F.col("t").cast("double"), F.col("n")))
    return sums.join(F.broadcast(n)).select("part", F.round(mean * scale, 4).alias("mean_tokens"))


def bootstrap_interval(rows: DataFrame, key: str, value: str, draws: int = 200, seed: int = 11) -> DataFrame:
    """The 95 % interval of the mean: in each draw a row counts as often as Poisson(1) says for its hash.

    One md5 of seed, key and block serves the four draws of a block; rows meet their blocks in the
    map task, where sums by block are combined. draws is a multiple of four.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col("block").cast("string")))

    def weight(i: int) -> Column:
        u = (F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") + 0.5) / F.lit(4294967296.0)
        w, p, total = F.lit(0), 0.36787944117144233, 0.0
        for k in range(7):
            total += p
            w = w + (u > total).cast("int")
            p /= k + 1
        return w

    each = rows.select(key, value, F.explode(F.sequence(F.lit(0), F.lit(draws // 4 - 1))).alias("block")).withColumn("digest", digest)
    each = each.select("block", value, *(weight(i).alias(f"w{i}") for i in range(4)))
    sums = each.groupBy("block").agg(*(F.try_divide(F.sum(F.col(f"w{i}") * F.col(value)).cast("double"), F.sum(f"w{i}")).alias(f"m{i}") for i in range(4)))
    means = sums.select(F.explode(F.array(*(F.round(f"m{i}", 6) for i in range(4)))).alias("m"))
    out = index_percentiles(means, "m", {"low": F.floor(F.col("n") * 0.025), "high": F.floor(F.col("n") * 0.975)})
    return out.select(F.col("n").alias("draws"), "low", "high")


def keep_rule(scores: DataFrame, rule: str = "top") -> DataFrame:
    """scores (case_id, option, score, k) with keep: top k, score of at least 0.5, or at least half of the best."""
    w = Window.partitionBy("case_id")
    if rule == "top":
        return scores.withColumn("keep", F.row_number().over(w.orderBy(F.desc("score"), "option")) <= F.col("k"))
    if rule == "threshold":
        return scores.withColumn("keep", F.col("score") >= 0.5)
    return scores.withColumn("keep", F.col("score") >= F.max("score").over(w) / 2)


def rank_backends(evidence: DataFrame, candidates: DataFrame | None = None, max_latency_ms: float | None = None) -> DataFrame:
    """Measured backends within the latency budget (unknown latency passes), best precision first; on ties the heuristic, then the faster, then the name."""
    rows = evidence if candidates is None else evidence.join(candidates.select("label"), "label")
    rows = rows.where("precision is not null")
    if max_latency_ms is not None:
        rows = rows.where(F.col("latency_ms").isNull() | (F.col("latency_ms") <= max_latency_ms))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("precision"), F.when(F.col("label") == "heuristic", 0).otherwise(1), F.asc_nulls_last("latency_ms"), "label")
    return rows.withColumn("rank", F.row_number().over(order))


def version_of(labels: DataFrame, manifest: DataFrame) -> DataFrame:
    """labels (label) with version: heuristic if the label has it as a part, a registered label's version, else the label."""
    m = manifest.select(F.col("label").alias("_l"), F.col("version").alias("_v"))
    j = labels.join(m, F.col("label") == F.col("_l"), "left")
    return j.withColumn("version", F.when(F.array_contains(F.split("label", r"\+"), "heuristic"), "heuristic").otherwise(F.coalesce("_v", "label"))).drop("_l", "_v")
