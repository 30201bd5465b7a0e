"""What people and later traffic say about a request's slots, merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import SLOTS


def traffic_verdicts(implicit: DataFrame) -> DataFrame:
    """One row for each request: kinds of its sources, whether a file's cut was contradicted, whether the turn was complained about.

    implicit: request_id, scope (targets or slots), verdict, source; rows without a source say nothing.
    """
    kind = F.nullif(F.element_at(F.split(F.coalesce("source", F.lit("")), ":"), -1), F.lit(""))
    rows = implicit.withColumn("kind", kind)
    out = rows.groupBy("request_id").agg(
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.bool_or((F.col("scope") == "targets") & F.coalesce(F.col("verdict") == "keep", F.lit(False))).alias("flips"),
        F.bool_or(F.col("scope") == "slots").alias("turn"),
    )
    return out.where(F.size("kinds") > 0)


def label_view(human: DataFrame, implicit: DataFrame, slots: list[str] = SLOTS) -> DataFrame:
    """(request_id, slot, verdict, label_source, implicit_label) of every request that either store knows, for each of the slots.

    A person's good stands, with traffic that agrees or not; a bad that traffic speaks against is
    mixed; otherwise traffic decides: keep where a cut file was fetched again, which concerns
    compact only, exclude where only the turn was complained about.
    """
    said = traffic_verdicts(implicit)
    requests = human.select("request_id").unionByName(implicit.select("request_id")).distinct()
    rows = requests.withColumn("slot", F.explode(F.array(*map(F.lit, slots))))
    rows = rows.join(human.select("request_id", "slot", F.col("verdict").alias("own")), ["request_id", "slot"], "left").join(said, "request_id", "left")
    flips = F.coalesce(F.col("flips"), F.lit(False)) & (F.col("slot") == "compact")
    spoken = F.when(F.col("kinds").isNull(), None).when(F.col("slot") == "compact", F.when(flips, "keep").otherwise("exclude")).when(F.col("turn"), "exclude")
    rows = rows.withColumn("implicit_label", spoken)
    none = F.col("implicit_label").isNull()
    verdict = F.when(none | (F.col("own") == "good"), F.col("own")).when(F.col("own") == "bad", "mixed").otherwise(F.col("implicit_label"))
    source = (
        F.when(none, F.when(F.col("own").isin("good", "bad"), "human"))
        .when(F.col("own") == "good", F.when(flips, "human+implicit").otherwise("human"))
        .when(F.col("own") == "bad", "mixed")
        .otherwise(F.concat(F.lit("implicit:"), F.array_join("kinds", "+")))
    )
    return rows.select("request_id", "slot", verdict.alias("verdict"), source.alias("label_source"), "implicit_label")


def implicit_coverage(requests: DataFrame, human: DataFrame, implicit: DataFrame) -> DataFrame:
    """One row: how many of the requests the harvest and people speak about, alone and together, and how often they disagree on compact."""
    rows = _covered(requests, human, implicit)
    both = rows.agg(F.count("*").alias("requests_in_window"), F.count_if("by_harvest").alias("covered_by_harvest"), F.count_if("by_human").alias("covered_by_human"), F.count_if(F.col("by_human") & ~F.col("by_harvest")).alias("human_only"), F.count_if(F.col("by_harvest") & ~F.col("by_human")).alias("harvest_only"), F.count_if(F.col("by_harvest") & (F.col("verdict") == "mixed")).alias("disagreements"))
    return both.withColumn("coverage", F.round(F.try_divide(F.col("covered_by_harvest").cast("double"), F.col("requests_in_window")), 4))


def implicit_verdicts(requests: DataFrame, human: DataFrame, implicit: DataFrame) -> DataFrame:
    """(verdict, n): what traffic says about compact for the requests the harvest covers; none where it has no say."""
    return _covered(requests, human, implicit).where("by_harvest").groupBy(F.coalesce("implicit_label", F.lit("none")).alias("verdict")).agg(F.count("*").alias("n"))


def _covered(requests: DataFrame, human: DataFrame, implicit: DataFrame) -> DataFrame:
    merged = label_view(human, implicit, ["compact"]).drop("slot")
    people = human.where("verdict is not null").select("request_id").distinct().withColumn("by_human", F.lit(True))
    traffic = implicit.select("request_id").distinct().withColumn("by_harvest", F.lit(True))
    rows = requests.select("request_id").join(merged, "request_id", "left").join(people, "request_id", "left").join(traffic, "request_id", "left")
    return rows.na.fill(False, ["by_human", "by_harvest"])


def slot_audit(decisions: DataFrame, slots: list[str] = SLOTS) -> DataFrame:
    """For each slot, also one without decisions: decisions, drops and tokens saved, in all and for a request that was scanned.

    decisions: request_id, slot, n_drop, saved_tok; a request without decisions has one row whose slot is null.
    """
    scanned = decisions.agg(F.count_distinct("request_id").alias("requests_scanned"))
    sums = decisions.where("slot is not null").groupBy("slot").agg(F.count("*").alias("decisions"), F.coalesce(F.sum("n_drop"), F.lit(0)).alias("would_drop"), F.coalesce(F.sum("saved_tok"), F.lit(0)).alias("savings_est_tok"))
    known = decisions.sparkSession.createDataFrame([(s,) for s in slots], "slot string")
    rows = known.join(sums, "slot", "left").na.fill(0, ["decisions", "would_drop", "savings_est_tok"]).join(F.broadcast(scanned))  # one row
    return rows.withColumn("drops_per_request", F.round(F.try_divide(F.col("would_drop").cast("double"), F.col("requests_scanned")), 4)).withColumn("tok_per_request", F.round(F.try_divide(F.col("savings_est_tok").cast("double"), F.col("requests_scanned")), 4))
