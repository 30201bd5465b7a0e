"""Where tokens, money and time go: the sections of the traffic report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cost import cost_usd, with_price
from ..functions.text import client_name, extract_paths
from .select import values_at

CATEGORIES = ["system", "user", "assistant", "tool_result", "assistant_tool_call"]
# Names of cacheable model families and the share of input that a warm cache serves.
CACHE_TARGETS = [("claude", 0.85), ("gpt", 0.60), ("gemini", 0.60)]


def priced(requests: DataFrame) -> DataFrame:
    return with_price(requests).withColumn("cost_usd", cost_usd())


def in_days(requests: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Both ends inclusive; compares day as text, so a table partitioned by day is pruned."""
    if since is not None:
        requests = requests.where(F.col("day") >= since)
    if until is not None:
        requests = requests.where(F.col("day") <= until)
    return requests


SUMS = ("in_tok", "cw_tok", "cr_tok", "out_tok", "latency_ms", "ttfb_ms", "reasoning_tok", "est_in_tok", "tool_spec_chars", "sys_chars")


def totals(requests: DataFrame) -> DataFrame:
    """Sums over all requests; columns that an older log lacks sum to 0."""
    known = {c: F.col(c) if c in requests.columns else F.lit(0) for c in SUMS}
    sums = [F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(c) for c, v in known.items()]
    return priced(requests).agg(F.count("*").alias("n"), *sums, F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("cost_usd"), F.count_if(F.col("status") >= 400).alias("errors"))


def hit_rate(read: Column, *other: Column) -> Column:
    """Share of input that came from the cache, null without input."""
    total = read
    for c in other:
        total = total + c
    return F.round(F.try_divide(read.cast("double"), total), 4)


def by_model(requests: DataFrame) -> DataFrame:
    fresh = F.sum(F.col("in_tok") + F.col("cw_tok"))
    out = priced(requests).groupBy("model").agg(F.count("*").alias("n"), fresh.alias("fresh_in"), F.sum("cr_tok").alias("cached"), F.sum("out_tok").alias("out"), F.round(F.sum("cost_usd"), 4).alias("cost"), F.floor(F.coalesce(F.sum("ttfb_ms"), F.lit(0)) / F.count("*")).cast("long").alias("mean_ttfb"))
    return out.withColumn("hit_rate", hit_rate(F.col("cached"), F.col("fresh_in")))


def by_client(requests: DataFrame) -> DataFrame:
    return priced(requests).groupBy(client_name(F.col("agent")).alias("client")).agg(F.count("*").alias("n"), F.round(F.sum("cost_usd"), 4).alias("cost"))


def by_day(requests: DataFrame) -> DataFrame:
    return priced(requests).groupBy("day").agg(F.count("*").alias("n"), F.round(F.sum("cost_usd"), 4).alias("cost"), F.sum(F.col("in_tok") + F.col("cw_tok") + F.col("cr_tok")).alias("in_tok"), F.sum("out_tok").alias("out_tok"))


def category_chars(messages: DataFrame, categories: list[str] = CATEGORIES) -> DataFrame:
    """Characters by kind of message and their share; known kinds without any show as 0."""
    known = messages.sparkSession.createDataFrame([(c,) for c in categories], "kind string")
    sums = messages.groupBy("kind").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    full = known.join(sums, "kind", "full").select("kind", F.coalesce("chars", F.lit(0)).cast("long").alias("chars"))
    total = full.agg(F.sum("chars").alias("total"))
    return full.join(F.broadcast(total)).select("kind", "chars", F.round(F.try_divide(F.col("chars").cast("double"), F.col("total")), 4).alias("share"))


def newest(requests: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The n newest rows; Spark keeps n a partition and merges, it doesn't sort the table."""
    return requests.orderBy(F.col(order).desc()).limit(n)


def index_percentiles(df: DataFrame, value: str, quantiles: dict[str, Column], group: list[str] | None = None) -> DataFrame:
    """Values at ranks, without interpolation: each of quantiles maps a name to a 0-based rank given n.

    For values with few different ones, or few rows: a window sees a row for each distinct value.
    """
    group = group or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    ranked = counts.withColumn("_upto", F.sum("_c").over(over.orderBy(value))).withColumn("n", F.sum("_c").over(over))
    picks = [F.min(F.when(F.col("_upto") > rank, F.col(value))).alias(name) for name, rank in quantiles.items()]
    total = F.sum(F.col(value) * F.col("_c"))
    return ranked.groupBy(*group).agg(F.max("n").alias("n"), *picks, F.max(value).alias("max"), F.round(total / F.max("n"), 4).alias("avg"))


def exact_percentiles(df: DataFrame, value: str, quantiles: dict[str, Column], group: list[str] | None = None) -> DataFrame:
    """What index_percentiles gives, for any number of different values."""
    group = group or []
    rows = df.where(F.col(value).isNotNull())
    found = values_at(rows, value, quantiles, group)
    rest = rows.groupBy(*(F.col(g).alias(f"_{g}") for g in group)).agg(F.max(value).alias("max"), F.round(F.sum(value) / F.count("*"), 4).alias("avg"))
    if not group:
        return found.join(F.broadcast(rest), how="left")  # one row each
    return found.join(rest, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]).drop(*(f"_{g}" for g in group))


def at_share(q: float) -> Column:
    return F.least(F.col("n") - 1, F.floor(F.col("n") * q))


def at_share_less_one(q: float) -> Column:
    """The other rank rule of latency curves: one below, wrapping to the last."""
    rank = F.floor(F.col("n") * q) - 1
    return F.when(rank < 0, F.col("n") - 1).otherwise(rank)


def decision_latency(requests: DataFrame, value: str = "latency_ms", newest_n: int = 500) -> DataFrame:
    rows = newest(requests.where(F.col(value).isNotNull()), newest_n)
    return index_percentiles(rows, value, {"p50": at_share(0.5), "p95": at_share(0.95)})


def latency_curve(requests: DataFrame, budget_ms: float, value: str = "latency_ms") -> DataFrame:
    out = exact_percentiles(requests, value, {"p50": F.floor(F.col("n") / 2), "p95": at_share_less_one(0.95)})
    return out.withColumn("fits", F.col("p95") <= budget_ms)


def slot_approval(labels: DataFrame) -> DataFrame:
    """Human verdicts by slot; the share of good ones leaves uncertain ones out."""
    out = labels.groupBy("slot").agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("good", "bad", "uncertain")))
    return out.withColumn("approval", F.round(F.try_divide(F.col("good").cast("double"), F.col("good") + F.col("bad")), 4))


def version_rollup(decisions: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Decisions by model version (unrecorded if none): rows of request_id, slot, version, saved, decision_ms, and backend if there is one.

    With labels (request_id, slot, verdict) each decision counts with its request's verdict on its
    slot, and approval is the share of good ones among good and bad.
    """
    named = decisions.withColumn("version", F.coalesce("version", F.lit("unrecorded")))
    named = named.withColumns({c: F.coalesce(F.col(c), F.lit("?")) if c in named.columns else F.lit("?") for c in ("slot", "backend")})

    def counted(column: str) -> DataFrame:
        pairs = named.groupBy("version", column).agg(F.count("*").alias("c")).groupBy("version")
        return pairs.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", column, F.col("c").cast("string")))), ",").alias(f"{column}s"))

    sums = named.groupBy("version").agg(F.count("*").alias("decisions"), F.count_distinct("request_id").alias("requests"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"))
    p50 = exact_percentiles(named, "decision_ms", {"p50": at_share(0.5)}, ["version"]).select("version", "p50")
    out = sums.join(counted("slot"), "version").join(counted("backend"), "version").join(p50, "version", "left")
    if labels is None:
        return out
    said = named.join(labels.select("request_id", "slot", "verdict"), ["request_id", "slot"])
    votes = said.groupBy("version").agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("good", "bad", "uncertain")))
    out = out.join(votes, "version", "left").na.fill(0, ["good", "bad", "uncertain"])
    return out.withColumn("approval", F.round(F.try_divide(F.col("good").cast("double"), F.col("good") + F.col("bad")), 4))


def cache_headroom(requests: DataFrame, targets: list = CACHE_TARGETS) -> DataFrame:
    """Fresh input that a warm cache could have served, by model, and what it would save."""
    target = F.lit(None).cast("double")
    for name, share in reversed(targets):
        target = F.when(F.lower("model").contains(name), share).otherwise(target)
    sums = requests.groupBy("model").agg(F.sum(F.col("in_tok") + F.col("cw_tok")).alias("fresh"), F.sum("cr_tok").alias("cached"))
    rate = F.try_divide(F.col("cached").cast("double"), F.col("fresh") + F.col("cached"))
    rows = with_price(sums.withColumn("target", target).where("target is not null")).withColumn("rate", rate).where(F.col("rate") < F.col("target"))
    reclaim = F.floor(F.col("fresh") * (F.col("target") - F.col("rate"))).cast("long")
    return rows.withColumn("reclaim_tok", reclaim).select("model", "fresh", "cached", F.round("rate", 4).alias("hit_rate"), "target", "reclaim_tok", F.round(F.col("reclaim_tok") * (F.col("price_in") - F.col("price_cached")) / 1e6, 4).alias("usd"))


CHARS_A_TOKEN = 3.6


def slot_headroom(sums: DataFrame, chars: DataFrame) -> DataFrame:
    """A row for each slot that rides along: tool schemas and tool results, in tokens of all requests and of one, and as a share of the estimated input.

    sums: one row of totals; chars: (kind, chars) of category_chars. Characters are added up first
    and become tokens once.
    """
    results = chars.agg(F.coalesce(F.sum(F.when(F.col("kind") == "tool_result", F.col("chars"))), F.lit(0)).alias("result_chars"))
    both = sums.join(F.broadcast(results))  # one row each
    tokens = lambda c: F.floor(F.col(c) / F.lit(CHARS_A_TOKEN)).cast("long")
    slots = F.array(F.struct(F.lit("tool_gate").alias("slot"), tokens("tool_spec_chars").alias("tok")), F.struct(F.lit("compact").alias("slot"), tokens("result_chars").alias("tok")))
    rows = both.select(F.greatest(F.lit(1), "n").alias("n"), F.greatest(F.lit(1), "est_in_tok").alias("est"), F.inline(slots))
    return rows.select("slot", F.col("tok").alias("est_tok_total"), F.floor(F.col("tok") / F.col("n")).cast("long").alias("est_tok_per_req"), F.round(F.col("tok").cast("double") / F.col("est"), 3).alias("share_of_input"))


def request_features(messages: DataFrame, tail_chars: int = 4000, tools: DataFrame | None = None, ages: bool = False) -> DataFrame:
    """The shape of each request: counts, characters by kind, an estimate rounded by kind, its last characters.

    With tools (request_id, name, chars) also their number, names in order of pos and characters,
    which join the estimate. With ages, each kind's places from the start relative to the request's
    length (three digits), and the paths the messages name.
    """
    kinds = messages.groupBy("request_id", "kind").agg(F.count("*").alias("c"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    est = _tokens_of("chars")
    chars = F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "chars"))))
    of_system = F.sum(F.when(F.col("kind") == "system", F.col("chars")).otherwise(0))
    shape = kinds.groupBy("request_id").agg(F.sum("c").alias("msg_count"), F.sum(F.when(F.col("kind") == "user", F.col("c")).otherwise(0)).alias("user_turns"), F.sum(est).alias("est_in_tok"), chars.alias("cat_chars"), of_system.alias("sys_chars"))
    # only the last messages, up to the one that reaches the tail's length; a message whose followers leave one character gives the line break before them
    after = F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1).over(Window.partitionBy("request_id").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1))
    last = messages.select("request_id", "idx", "text", F.coalesce(after, F.lit(0)).alias("_after")).where(F.col("_after") <= tail_chars)
    joined = last.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("all_text"))
    out = shape.join(joined, "request_id").withColumn("tail", F.expr(f"right(all_text, {tail_chars})")).drop("all_text")
    if tools is not None:
        own = tools.groupBy("request_id").agg(F.sum("chars").alias("tool_spec_chars"), F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("pos", "name")))), lambda x: x["name"]).alias("tool_names"))
        out = out.join(own, "request_id", "left").withColumn("tool_spec_chars", F.coalesce("tool_spec_chars", F.lit(0))).withColumn("tool_names", F.coalesce("tool_names", F.array().cast("array<string>")))
        out = out.withColumn("tool_count", F.size("tool_names")).withColumn("est_in_tok", F.col("est_in_tok") + _tokens_of("tool_spec_chars"))
    if ages:
        places = age_ranks(messages, 3).groupBy("request_id", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "age_rank"))), lambda x: x["age_rank"]).alias("ages"))
        by_kind = places.groupBy("request_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "ages")))).alias("hist_age_rank"))
        found = messages.select("request_id", "idx", extract_paths(F.col("text")).alias("p")).where(F.size("p") > 0)
        paths = found.groupBy("request_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", "p"))), lambda x: x["p"])).alias("paths"))
        out = out.join(by_kind, "request_id").join(paths, "request_id", "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))
    return out


def _tokens_of(chars: str) -> Column:
    return F.when(F.col(chars) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.col(chars) / CHARS_A_TOKEN + 0.5))).cast("long")


def age_ranks(messages: DataFrame, digits: int = 6) -> DataFrame:
    """Each message's place from the start, relative to its request's length; halves go to the even digit."""
    w = Window.partitionBy("request_id")
    return messages.withColumn("age_rank", F.bround(F.row_number().over(w.orderBy("idx")) / F.count("*").over(w), digits))


def savings_snapshot(requests: DataFrame, saved: Column, enforced: Column | None = None, newest_n: int = 2000, mode: str = "auto") -> DataFrame:
    """What the newest requests' decisions saved, against the input and cost of all requests.

    The share is of the whole estimated input, or of fresh and cached input where there is no
    estimate; the cost after savings falls by that share. The mode auto is delivered if any of the
    newest was enforced.
    """
    known = lambda c: F.col(c) if c in requests.columns else F.lit(0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    whole = priced(requests).agg(F.count("*").alias("n"), total(F.col("in_tok") + F.col("cw_tok")).alias("in_tok"), total(F.col("cr_tok")).alias("_cr"), total(known("est_in_tok")).alias("_est"), total(F.col("cost_usd")).alias("_cost"))
    recent = newest(requests, newest_n).agg(total(saved).cast("long").alias("saved_tok"), F.coalesce(F.bool_or(F.lit(False) if enforced is None else enforced), F.lit(False)).alias("_any"))
    both = whole.join(F.broadcast(recent))  # one row each
    denom = F.when(F.col("_est") > 0, F.col("_est")).otherwise(F.col("in_tok") + F.col("_cr")).cast("long")
    share = F.coalesce(F.try_divide(F.col("saved_tok").cast("double"), denom), F.lit(0.0))
    shown = F.when(F.col("_any"), "delivered").otherwise("potential") if mode == "auto" else F.lit(mode)
    return both.select("n", "in_tok", F.round("_cost", 4).alias("cost_usd"), "saved_tok", F.round(100 * share, 4).alias("saved_pct"), denom.alias("denom_tok"), F.round(F.greatest(F.lit(0.0), F.col("_cost") - F.col("_cost") * share), 4).alias("after_usd"), shown.alias("mode"))
