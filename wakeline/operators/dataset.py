"""Training sets from labelled decisions: examples, de-duplication, split, fingerprint, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_ROWS, MIN_PER_ANSWER, MIN_DAYS = 40, 8, 7


def order_key(seed: int, *columns: str) -> Column:
    """A number between 0 and 2**32 that orders rows for a seed."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns))), 1, 8), 16, 10).cast("long")


def training_examples(candidates: DataFrame) -> DataFrame:
    """candidates (request_id, body_sha, slot, target, keep, merged, d_pos, c_pos) as answers keep and drop.

    Decisions judged bad, mixed or to exclude teach nothing; a verdict keep from traffic turns a
    cut into keep. Then the first row of each (body, slot, target) stays.
    """
    rows = candidates.where(~F.coalesce("merged", F.lit("")).isin("bad", "mixed", "exclude"))
    flip = F.coalesce(F.col("merged") == "keep", F.lit(False)) & ~F.col("keep")
    rows = rows.withColumn("answer", F.when(F.col("keep") | flip, "keep").otherwise("drop")).withColumn("label_source", F.when(F.col("merged") == "good", "human").when(F.coalesce(F.col("merged") == "keep", F.lit(False)), "traffic").otherwise("heuristic"))
    w = Window.partitionBy("body_sha", "slot", "target").orderBy("request_id", "d_pos", "c_pos")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def state_text(query: Column, tools: Column, api: Column) -> Column:
    """The last 512 characters of the recorded query, else the first tool names, else the kind of turn."""
    tail = F.substring(query, -512, 512)
    return F.when(F.coalesce(query, F.lit("")) != "", F.when(F.length(query) > 512, tail).otherwise(query)).when(F.size(tools) > 0, F.array_join(F.slice(tools, 1, 8), ", ")).otherwise(F.concat(api, F.lit(" turn")))


def render_prompt(state: Column, options: Column) -> Column:
    return F.concat(F.lit("state: "), F.trim(state), F.lit("\noption: "), F.coalesce(F.get(options, F.lit(0)), F.lit("")))


def split_train_val(examples: DataFrame, key: str, val_share: float = 0.2, seed: int = 7) -> DataFrame:
    """examples with part train or val: whole keys in a seeded order, cut at round(n * (1 - val_share)) keys.

    The cut is found from key counts by 65,536 ranges of the order; only the range that holds it is sorted.
    """
    keys = examples.select(key).distinct().withColumn("_o", order_key(seed, key)).withColumn("_b", F.shiftright("_o", 16))
    counts = keys.groupBy("_b").agg(F.count("*").alias("c"))
    over = Window.partitionBy(F.lit(0)).orderBy("_b")
    marked = counts.withColumn("upto", F.sum("c").over(over)).withColumn("cut", F.floor(F.sum("c").over(Window.partitionBy(F.lit(0))) * (1 - val_share) + 0.5))
    edge = marked.where("upto > cut").agg(F.min(F.struct("_b", (F.col("cut") - F.col("upto") + F.col("c")).alias("take"))).alias("e")).select(F.col("e._b").alias("eb"), F.col("e.take").alias("take"))
    placed = keys.join(F.broadcast(edge))
    inside = placed.where("_b = eb").withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy("_o", key)))
    part = placed.where("eb is null or _b != eb").select(key, F.when(F.col("eb").isNull() | (F.col("_b") < F.col("eb")), "train").otherwise("val").alias("part"))
    part = part.unionByName(inside.select(key, F.when(F.col("_n") <= F.col("take"), "train").otherwise("val").alias("part")))
    return examples.join(part, key)


def split_statistics(split: DataFrame) -> DataFrame:
    return split.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("label_source") != "heuristic").alias("supervised"), F.count_if(F.col("label_source") == "traffic").alias("from_traffic"), F.count_if((F.col("label_source") == "traffic") & (F.col("answer") == "keep")).alias("traffic_keeps"), F.count_if(F.col("label_source") == "heuristic").alias("heuristic"))


def answers_by_slot(examples: DataFrame) -> DataFrame:
    return examples.groupBy("slot").agg(F.count_if(F.col("answer") == "keep").alias("keep"), F.count_if(F.col("answer") == "drop").alias("drop"), F.count("*").alias("total"))


def fingerprint(split: DataFrame, columns: list[str], seed: int = 7) -> DataFrame:
    """A hash of all rows, whatever their order: digests of ranges of their hashes, five hexadecimal digits, then three, then one, then all.

    Each digest but the first is of 256 others at most; the first of a millionth of the rows.
    """
    row = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    ranges = split.select(row.alias("h")).groupBy(F.substring("h", 1, 5).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"), F.count("*").alias("c"))
    for digits in (3, 1):
        inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "")
        ranges = ranges.groupBy(F.substring("b", 1, digits).alias("_b")).agg(F.sha2(inner, 256).alias("d"), F.sum("c").alias("c")).withColumnRenamed("_b", "b")
    return ranges.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ""), 256).alias("fingerprint"), F.sum("c").alias("n"))


def readiness(answers: DataFrame, last_fingerprint: str | None, now_fingerprint: str, days_since: float | None, min_rows: int = MIN_ROWS, min_each: int = MIN_PER_ANSWER, min_days: int = MIN_DAYS) -> DataFrame:
    """Whether there is enough new signal in each slot, with reasons against."""
    reasons = F.array_compact(F.array(
        F.when(F.col("total") < min_rows, "too few rows"),
        F.when((F.col("keep") == 0) | (F.col("drop") == 0), "one answer only").when(F.least("keep", "drop") < min_each, "too few of one answer"),
        F.when(F.lit(last_fingerprint == now_fingerprint), "nothing new"),
        F.when(F.lit(days_since is not None and days_since < min_days), "trained lately"),
    ))
    return answers.withColumn("reasons", reasons).withColumn("ready", F.size("reasons") == 0)


def validate_split(rows: DataFrame) -> DataFrame:
    """The rows that break the contract, with reasons: required keys, at least one option, a known answer."""
    need = ["state", "question", "slot", "options", "answer"]
    reasons = F.array_compact(F.array(*(F.when(F.col(c).isNull(), f"missing {c}") for c in need), F.when(F.col("options").isNotNull() & (F.size("options") == 0), "no options"), F.when(F.col("answer").isNotNull() & ~F.col("answer").isin("keep", "drop"), "unknown answer")))
    return rows.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def latest_completed(history: DataFrame) -> DataFrame:
    return history.where("status = 'ran' and exit = 0").orderBy(F.desc("at")).limit(1)


def next_version(history: DataFrame) -> DataFrame:
    """One above the highest numeric suffix of all attempts."""
    n = F.regexp_extract("version", r"([0-9]+)$", 1)
    return history.agg((F.coalesce(F.max(F.when(n != "", n.cast("int"))), F.lit(0)) + 1).alias("next"))
