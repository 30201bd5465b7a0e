"""Labels from people and from later traffic: stores, harvest, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .paths import meet

WINDOW_TURNS, WINDOW_S = 20, 1800.0
SLOTS = ["tool_gate", "compact", "context", "effort"]
# How a complaint begins, and tools whose results list paths without fetching them.
CORRECTION = r"(?i)^\s*(?:no[,.]?\s|wait[, ]|actually[,.]|that(?:'s| is) (?:wrong|not right|incorrect)|you (?:didn't|did not|missed|ignored)|wrong (?:file|function|answer|fix)|i (?:already|asked|said)|look again|try again|didn'?t work|still (?:broken|failing)|read the file|check the file)"
SEARCH_TOOLS = ["grep", "glob", "ls", "search", "file_search", "codebase", "websearch", "web_search", "webfetch", "web_fetch", "find"]


def upsert_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """The last verdict of each (request_id, slot); slot 'all' stands for every slot. Both have seq, their order."""
    rows = old.withColumn("_g", F.lit(0)).unionByName(new.withColumn("_g", F.lit(1)))
    slots = F.when(F.col("slot") == "all", F.array(*map(F.lit, SLOTS))).otherwise(F.array("slot"))
    rows = rows.withColumn("slot", F.explode(slots))
    w = Window.partitionBy("request_id", "slot").orderBy(F.desc("_g"), F.desc("seq"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_g")


def merge_implicit(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries by request_id: a new one replaces the old, the rest stay; changed tells which differ."""
    rest = [c for c in old.columns if c != "request_id"]
    o = old.select("request_id", F.struct(*rest).alias("o"))
    n = new.select("request_id", F.struct(*rest).alias("n"))
    both = o.join(n, "request_id", "full")
    return both.select("request_id", F.coalesce("n", "o").alias("e"), (F.col("n").isNotNull() & ~F.col("n").eqNullSafe(F.col("o"))).alias("changed")).select("request_id", "e.*", "changed")


def with_bodies(requests: DataFrame, bodies: DataFrame) -> DataFrame:
    """requests with has_body; a request without a stored body is kept and can be counted."""
    known = bodies.select(F.col("body_sha").alias("_sha")).distinct()
    return requests.join(known, F.col("body_sha") == F.col("_sha"), "left").withColumn("has_body", F.col("_sha").isNotNull()).drop("_sha")


def attribute_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Each result (request_id, call_id, pos) with its latest earlier call (request_id, call_id, pos, tool, path)."""
    c = calls.select("request_id", "call_id", "pos", F.struct("tool", F.col("path").alias("call_path")).alias("_call"))
    both = results.withColumn("_result", F.lit(True)).unionByName(c, allowMissingColumns=True)
    w = Window.partitionBy("request_id", "call_id").orderBy("pos", F.col("_result").isNull())  # a call is seen after its own place
    seen = both.withColumn("_call", F.last("_call", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_result")
    return seen.select("request_id", "call_id", "pos", *[x for x in results.columns if x not in ("request_id", "call_id", "pos")], "_call.tool", "_call.call_path")


def fetch_counts(attributed: DataFrame, search_tools: list[str] = SEARCH_TOOLS) -> DataFrame:
    """(request_id, path, fetches, tokens) of results that fetched a file; search tools don't. Path of the result, else of its call."""
    tool = F.lower(F.coalesce("tool", F.lit("")))
    searched = F.exists(F.array(*map(F.lit, search_tools)), lambda s: F.contains(tool, s))
    rows = attributed.where(~searched).withColumn("path", F.lower(F.coalesce("path", "call_path"))).where("path is not null")
    return rows.groupBy("request_id", "path").agg(F.count("*").alias("fetches"), F.max_by("tokens", "pos").alias("tokens"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def reruns(requests: DataFrame, window_s: float = WINDOW_S, session: str | None = None) -> DataFrame:
    """The earlier request of each pair with one body seen again within the window of its previous sighting."""
    keys = ["body_sha"] + ([session] if session else [])
    w = Window.partitionBy(*keys).orderBy("id")
    rows = requests.select("id", "ts_epoch", F.lag("id").over(w).alias("request_id"), F.lag("ts_epoch").over(w).alias("_t"))
    return rows.where((F.col("request_id").isNotNull()) & (F.col("ts_epoch") - F.col("_t") <= window_s)).select("request_id", F.col("id").alias("again_id"))


def corrections(turns: DataFrame, pattern: str = CORRECTION) -> DataFrame:
    """The turn before each one that opens with a complaint; turns: session, turn, text, has_body."""
    w = Window.partitionBy("session").orderBy("turn")
    rows = turns.withColumn("_turn", F.lag("turn").over(w)).withColumn("_body", F.lag("has_body").over(w))
    return rows.where(F.regexp_like("text", F.lit(pattern)) & F.col("_body")).select("session", F.col("_turn").alias("turn"))


def evictions(decisions: DataFrame) -> DataFrame:
    """(request_id, idx, applied) cut by a decision: the proof's messages where there is a proof, else compact candidates not kept."""
    has = F.size(F.coalesce("proof_dropped", F.array().cast("array<int>"))) > 0
    proof = decisions.where(has).select("request_id", F.explode("proof_dropped").alias("idx"), F.col("proof_applied").alias("applied"))
    plain = decisions.where(~has & (F.col("slot") == "compact")).select("request_id", F.explode("candidates").alias("c"), "applied").where("not c.keep").select("request_id", F.col("c.index").alias("idx"), "applied")
    return proof.unionByName(plain).distinct()


def evicted_files(evicted: DataFrame, seen: DataFrame, reach: int = 2) -> DataFrame:
    """(request_id, path, tokens) of evicted messages: paths in them or in calls up to reach messages before; search-only messages blame nothing.

    seen: request_id, idx, path, is_search, tokens.
    """
    e = evicted.select("request_id", F.explode(F.sequence(F.col("idx") - reach, F.col("idx"))).alias("idx"), F.col("idx").alias("at"))
    hit = e.join(seen, ["request_id", "idx"]).where("not is_search")
    return hit.groupBy("request_id", F.lower("path").alias("path")).agg(F.min("at").alias("idx"), F.max("tokens").alias("tokens"))


def growth(fetches: DataFrame) -> DataFrame:
    """Turns whose count of fetches of a path exceeds that of the session's previous turn with a body (absent: 0).

    fetches: session, turn, turn_no (over turns with a body), path, n.
    """
    before = fetches.select("session", "path", (F.col("turn_no") + 1).alias("turn_no"), F.col("n").alias("before"))
    return fetches.join(before, ["session", "path", "turn_no"], "left").withColumn("before", F.coalesce("before", F.lit(0))).where("n > before")


def windowed_fetches(events: DataFrame, reach: int = 50) -> DataFrame:
    """(session, turn, path, n): fetches of a path within the last reach turns, at turns that concern the path."""
    w = Window.partitionBy("session", "path").orderBy("turn").rangeBetween(-reach, 0)
    return events.withColumn("n", F.sum(F.col("fetched").cast("int")).over(w))


def blamed(grown: DataFrame, evicted: DataFrame, turns: int = WINDOW_TURNS, seconds: float = WINDOW_S) -> DataFrame:
    """Each growth event with the nearest earlier eviction of the same file within the turns and seconds.

    They meet under session, stretch of turns and the endings of their paths: an eviction reaches
    into its own stretch and the next. Spellings may differ in length.
    """
    stretch = F.floor(F.col("turn") / turns)
    e = evicted.select("session", F.col("turn").alias("e_turn"), F.col("ts_epoch").alias("e_ts"), F.col("path").alias("e_path"), F.col("tokens").alias("evicted_tok"), F.explode(F.array(stretch, stretch + 1)).alias("_t"))
    j = meet(grown.withColumn("_t", stretch), e, ["session", "_t"], "path", "e_path")
    j = j.where((F.col("e_turn") < F.col("turn")) & (F.col("turn") - F.col("e_turn") <= turns) & (F.col("ts_epoch") - F.col("e_ts") <= seconds))
    return j.groupBy("session", "turn", "path").agg(F.max("e_turn").alias("e_turn"), F.max_by("evicted_tok", "e_turn").alias("evicted_tok"), F.first("tokens").alias("regret_tok"))


def first_observation(observed: DataFrame) -> DataFrame:
    """One label for each (request_id, key): re-reads before others, then the first. observed has source and seq."""
    rank = F.when(F.col("source") == "re-read", 0).otherwise(1)
    w = Window.partitionBy("request_id", "key").orderBy(rank, "seq")
    return observed.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def merge_verdicts(human: DataFrame, implicit: DataFrame) -> DataFrame:
    """(request_id, slot, verdict, implicit, merged): a bad verdict that traffic contradicts is mixed, without one traffic decides."""
    j = human.select("request_id", "slot", "verdict").join(implicit.select("request_id", "slot", "implicit"), ["request_id", "slot"], "full")
    merged = F.when(F.col("verdict") == "good", "good").when((F.col("verdict") == "bad") & F.col("implicit").isNotNull(), "mixed").when(F.col("verdict") == "bad", "bad").when(F.col("implicit") == "keep", "keep").when(F.col("implicit").isNotNull(), "exclude").otherwise(F.col("verdict"))
    return j.withColumn("merged", merged)


def coverage(human: DataFrame, implicit: DataFrame) -> DataFrame:
    """Requests with a human label, an implicit one, both, and where they disagree."""
    j = human.select("request_id", "verdict").join(implicit.select("request_id", "implicit"), "request_id", "full")
    both = F.col("verdict").isNotNull() & F.col("implicit").isNotNull()
    out = j.agg(F.count_if(F.col("verdict").isNotNull()).alias("human"), F.count_if(F.col("implicit").isNotNull()).alias("harvest"), F.count_if(both).alias("both"), F.count_if(both & (F.col("verdict") == "good") & (F.col("implicit") == "bad")).alias("disagree"), F.count("*").alias("n"))
    return out.withColumn("coverage", F.round(F.try_divide(F.col("harvest").cast("double"), F.col("n")), 4))


def regret_summary(grown: DataFrame, blame: DataFrame) -> DataFrame:
    """How many growth events were seen, how many an eviction caused, and the tokens paid again."""
    b = blame.agg(F.count("*").alias("regretted"), F.coalesce(F.sum("regret_tok"), F.lit(0)).alias("regret_tok"), F.coalesce(F.sum("evicted_tok"), F.lit(0)).alias("evicted_tok"))
    g = grown.agg(F.count("*").alias("growth_events"), F.count_distinct("session").alias("sessions"))
    return g.join(F.broadcast(b)).withColumn("per_1k", F.round(F.try_divide(1000.0 * F.col("regretted"), F.col("growth_events")), 4))
