"""Choosing messages, tools and files under a token budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..lineage import settled
from .paths import meet

TAIL, TARGET_FRACTION, MIN_BUDGET = 4, 0.45, 1500
EVIDENCE_BEST, EVIDENCE_SHARE, CORE_FLOOR = 3, 0.6, 6
EVIDENCE_MIN, EVIDENCE_NAMED, IN_TAIL = 0.8, 0.9, 0.25
# Tools that are always kept, by whole name and by part.
CORE_TOOLS = ["read", "read_file", "write", "write_file", "edit", "multiedit", "str_replace", "glob", "grep", "grep_search", "bash", "shell", "execute", "local_shell", "file_search", "search", "codebase", "todo", "task", "agent", "websearch", "web_search", "fetch", "webfetch"]
CORE_PARTS = ["read", "edit", "bash", "grep"]


def default_budget(est_in_tok: Column) -> Column:
    return F.greatest(F.lit(MIN_BUDGET), F.floor(est_in_tok * TARGET_FRACTION)).cast("long")


def compact_gate(est_in_tok: Column, n_messages: Column, min_tok: int = 4000, min_messages: int = 8) -> Column:
    return (est_in_tok > min_tok) & (n_messages > min_messages)


def message_scores(messages: DataFrame, tail: int = TAIL, error: str = T.ERROR, anchor: str = T.ANCHOR, diff: str = T.DIFF) -> DataFrame:
    """messages with n, tokens, tail, score and why; the last messages of a request score 1."""
    w = Window.partitionBy("request_id")
    rows = messages.withColumn("n", F.count("*").over(w)).withColumn("i", F.row_number().over(w.orderBy("idx")) - 1).withColumn("tokens", T.approx_tokens(F.col("text")))
    text = F.coalesce(F.col("text"), F.lit(""))
    marks = {"error": F.regexp_like(text, F.lit(error)), "diff": F.regexp_like(text, F.lit(diff)), "anchor": F.regexp_like(text, F.lit(anchor))}
    lead = F.col("kind").isin("user", "system")
    rows = rows.withColumn("tail", F.col("i") >= F.col("n") - tail)
    plus = lambda cond, x: F.when(cond, x).otherwise(0.0)
    score = plus(lead, 0.6) + plus(marks["error"], 0.45) + plus(marks["diff"], 0.3) + plus(marks["anchor"], 0.25) - plus(F.col("kind") == "tool_result", 0.25) + F.lit(0.35) * (F.col("i") / F.greatest(F.lit(1), F.col("n") - 1))
    why = F.array_compact(F.array(F.when(lead, F.concat(F.lit("role:"), F.col("kind"))), *(F.when(c, k) for k, c in marks.items()), F.when(F.col("kind") == "tool_result", "tool_result")))
    shown = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + score / 2)), 3)
    return rows.withColumn("score", F.when(F.col("tail"), 1.0).otherwise(shown)).withColumn("why", F.when(F.col("tail"), F.array(F.lit("tail"), F.concat(F.lit("role:"), F.col("kind")))).otherwise(why))


def greedy(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """rows with a boolean column name: whether a row is taken when those of its key come in this order.

    rows has _tokens, _budget (one for all rows of a key) and _always. A row is taken if its tokens
    fit what the taken ones have left of the budget, or always; a miss doesn't end the scan. The
    fold keeps one number, so a key may have any number of rows.
    """
    places = [F.col(key).asc(), *order]
    sorted_rows = rows.repartition(key).sortWithinPartitions(*places)
    names = [*rows.columns, name]
    at = [names.index(c) for c in (key, "_tokens", "_budget", "_always")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, begun = None, 0, False
        for batch in batches:
            keys, tokens, budgets, always = (batch.column(i).to_pylist() for i in at)
            taken = []
            for k, t, most, whatever in zip(keys, tokens, budgets, always, strict=True):
                if not begun or k != now:
                    now, left, begun = k, most, True
                take = whatever or t <= left
                if take:
                    left -= t
                taken.append(take)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(taken, pa.bool_())], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return sorted_rows.mapInArrow(fold, f"{fields}, `{name}` boolean")


def recency_compaction(scored: DataFrame, budget: Column) -> DataFrame:
    """request_id, idx and keep: the tail always, else newest first while the budget lasts; a miss doesn't end the scan."""
    rows = scored.select("request_id", F.col("idx").cast("long").alias("idx"), "i", F.col("tokens").cast("long").alias("_tokens"), budget.cast("long").alias("_budget"), F.col("tail").alias("_always"))
    return greedy(rows, "request_id", [F.col("i").desc()], "keep").select("request_id", "idx", "keep")


def candidate_pool(messages: DataFrame, named: DataFrame, tools: DataFrame, ranked: DataFrame, task_paths: DataFrame) -> DataFrame:
    """Messages, tools and files as one pool (request_id, kind, id, idx, tokens, value, protected, evidence).

    messages: scored ones (request_id, idx, kind, tokens, score, tail), of which system messages
    are no candidates; named: (request_id, idx, path) they name; tools: scored ones (request_id,
    name, tokens, score, core, keep); ranked: files (request_id, path, score); task_paths:
    (request_id, path) that the task names. A message gains half of its best evidence: the rank
    of a file it names, or EVIDENCE_NAMED for a path of the task. Core tools are protected, and
    files that the task names, unless the tail names them already, which makes a file worth a
    quarter. Paths meet under request and their endings.
    """
    # a search's few best files for each request, asked four times; in a plan of this size Spark doesn't find them again if they are only persisted
    files = settled(ranked.select("request_id", "path", F.least(F.lit(1.0), F.col("score") / 6.0).alias("value")))
    task = task_paths.select("request_id", "path").distinct()
    seen = named.select("request_id", "idx", "path").distinct()

    def met(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        return meet(left, right.select("request_id", F.col("path").alias("_p"), *more), ["request_id"], "path", "_p")

    by_rank = met(seen, files, "value").select("request_id", "idx", "value")
    by_task = met(seen, task).select("request_id", "idx", F.lit(EVIDENCE_NAMED).alias("value"))
    best = by_rank.unionByName(by_task).groupBy("request_id", "idx").agg(F.max("value").alias("_e"))
    own = messages.where("kind != 'system'").join(best, ["request_id", "idx"], "left").withColumn("_e", F.coalesce("_e", F.lit(0.0)))
    number = F.lpad(F.col("idx").cast("string"), 6, "0")
    pool = own.select("request_id", F.lit("message").alias("kind"), number.alias("id"), F.col("idx").cast("long"), F.col("tokens").cast("long"), (F.col("score") + 0.5 * F.col("_e")).alias("value"), F.col("tail").alias("protected"), F.when(F.col("_e") >= EVIDENCE_MIN, F.col("_e")).otherwise(0.0).alias("evidence"))
    none = [F.lit(None).cast("long").alias("idx"), F.lit(0.0).alias("evidence")]
    pool = pool.unionByName(tools.select("request_id", F.lit("tool").alias("kind"), F.lower("name").alias("id"), F.greatest(F.lit(1), F.col("tokens")).cast("long").alias("tokens"), F.col("score").alias("value"), (F.col("keep") & F.col("core")).alias("protected"), *none))
    tail = seen.join(messages.where("tail and kind != 'system'").select("request_id", "idx"), ["request_id", "idx"])
    flag = lambda right, name: met(files, right).select("request_id", "path").distinct().withColumn(name, F.lit(True))
    both = files.join(flag(task, "_named"), ["request_id", "path"], "left").join(flag(tail, "_in"), ["request_id", "path"], "left")
    inside = F.coalesce("_in", F.lit(False))
    pool = pool.unionByName(both.select("request_id", F.lit("file").alias("kind"), F.col("path").alias("id"), T.approx_tokens(F.concat(F.lit("- "), "path")).alias("tokens"), (F.col("value") * F.when(inside, IN_TAIL).otherwise(1.0)).alias("value"), (F.coalesce("_named", F.lit(False)) & ~inside).alias("protected"), *none))
    return settled(pool)  # short rows, whose tools cost a scan of all texts; a booking asks for them three times


def joint_plan(pool: DataFrame, budget: Column) -> DataFrame:
    """pool (request_id, kind, id, tokens, value, protected) with keep, over_budget, floor, last_kept and left.

    Protected items first; if they alone exceed the budget nothing is decided (keep is null).
    The rest in order of value per token, each taken if it fits.
    """
    ratio = F.when(F.col("tokens") <= 0, F.lit(float("inf"))).otherwise(F.col("value") / F.col("tokens"))
    items = pool.withColumn("id", F.col("id").cast("string")).withColumn("ratio", ratio)
    rows = items.withColumns({"_tokens": F.col("tokens").cast("long"), "_budget": budget.cast("long"), "_always": F.col("protected")})
    order = [F.col("protected").desc(), F.col("ratio").desc(), F.col("value").desc(), F.col("kind").asc(), F.col("id").asc()]
    taken = settled(greedy(rows, "request_id", order, "keep"))  # both for the sums and for the items
    won = F.col("keep") & ~F.col("protected")
    last = F.struct("ratio", (-F.col("value")).alias("value"), "kind", "id")
    spent = lambda which: F.coalesce(F.sum(F.when(which, F.col("tokens"))), F.lit(0)).cast("long")
    summary = taken.groupBy("request_id").agg(F.max("_budget").alias("budget"), spent(F.col("protected")).alias("protected_tokens"), F.min(F.when(won, F.col("ratio"))).alias("floor"), F.min_by("id", F.when(won, last)).alias("last_kept"), spent(won).alias("_won"))
    summary = summary.withColumn("left", F.col("budget") - F.col("protected_tokens") - F.col("_won")).withColumn("over_budget", F.col("protected_tokens") > F.col("budget")).drop("_won")
    out = taken.drop("_tokens", "_budget", "_always").join(summary, "request_id")
    return out.withColumn("keep", F.when(F.col("over_budget"), F.when(F.col("protected"), True)).otherwise(F.col("keep")))


def drop_reasons(plan: DataFrame) -> DataFrame:
    """The dropped items of a plan with why they lost."""
    text = F.when(F.col("floor").isNull(), "nothing was competitive").when(F.col("ratio") >= F.col("floor"), F.format_string("value/token %.6f beat the kept floor %.6f but does not fit the %d tok left after the kept set", "ratio", "floor", "left")).otherwise(F.format_string("value/token %.6f < kept floor %.6f (floor set by %s)", "ratio", "floor", "last_kept"))
    return plan.where("not over_budget and not keep").withColumn("reason", text)


def budget_totals(plan: DataFrame) -> DataFrame:
    after = F.when(F.first("over_budget"), F.first("protected_tokens")).otherwise(F.sum(F.when(F.col("keep"), F.col("tokens")).otherwise(0)))
    return plan.groupBy("request_id").agg(F.first("budget").alias("budget"), F.first("over_budget").alias("over_budget"), F.first("protected_tokens").alias("protected_tokens"), F.sum("tokens").alias("tokens_before"), after.cast("long").alias("tokens_after"), F.count_if(~F.coalesce("keep", F.lit(True))).alias("n_dropped"))


def slot_records(plan: DataFrame) -> DataFrame:
    """One record for each request and kind of item, with the tokens it saves."""
    return plan.groupBy("request_id", "kind").agg(F.count_if("keep").alias("kept"), F.count_if(~F.coalesce("keep", F.lit(True))).alias("dropped"), F.sum(F.when(~F.coalesce("keep", F.lit(True)), F.col("tokens")).otherwise(0)).alias("saved_tok"))


def book_evidence(pool: DataFrame, budget: Column, best: int = EVIDENCE_BEST, share: float = EVIDENCE_SHARE) -> DataFrame:
    """pool (with evidence) whose best few messages by evidence become protected while the protected part stays within a share of the budget.

    The best are taken before those that are protected already are passed over. Spark keeps the best
    few of each task before it brings a request's together.
    """
    w = Window.partitionBy("request_id").orderBy(F.desc("evidence"), "idx")
    rows = pool.withColumn("_cap", F.floor(budget * share))
    held = rows.groupBy("request_id").agg(F.sum(F.when(F.col("protected"), F.col("tokens")).otherwise(0)).alias("_p"))
    first = rows.where("evidence > 0").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= best).join(held, "request_id")
    few = first.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("_r", "id", "tokens", "protected"))).alias("m"), F.max("_cap").alias("_cap"), F.max("_p").alias("_p"))
    start = F.struct(F.col("_p").cast("long").alias("used"), F.array().cast("array<string>").alias("ids"))

    def step(acc: Column, m: Column) -> Column:
        take = ~m["protected"] & (acc["used"] + m["tokens"] <= F.col("_cap"))
        return F.struct((acc["used"] + F.when(take, m["tokens"]).otherwise(0)).cast("long").alias("used"), F.when(take, F.concat(acc["ids"], F.array(m["id"].cast("string")))).otherwise(acc["ids"]).alias("ids"))

    booked = few.select("request_id", F.aggregate("m", start, step)["ids"].alias("_ids"))
    out = rows.drop("_cap").join(booked, "request_id", "left")
    return out.withColumn("protected", F.col("protected") | F.coalesce(F.array_contains("_ids", F.col("id").cast("string")), F.lit(False))).drop("_ids")


def apply_plan(messages: DataFrame, dropped: DataFrame, note: str | None = None) -> DataFrame:
    """The messages that stay, and a note after the last turn of each request that lost any."""
    kept = messages.join(dropped.select("request_id", "idx"), ["request_id", "idx"], "left_anti")
    if note is None:
        return kept
    last = kept.join(dropped.select("request_id").distinct(), "request_id", "left_semi").groupBy("request_id").agg((F.max("idx") + 1).alias("idx"))
    return kept.unionByName(last.select("request_id", "idx", F.lit("user").alias("role"), F.lit(note).alias("text"), F.lit("note").alias("kind")), allowMissingColumns=True)


def apply_tool_plan(tools: DataFrame, dropped: DataFrame) -> DataFrame:
    """The tools that stay; a tool is named without regard to case."""
    return tools.withColumn("_n", F.lower("name")).join(dropped.select("request_id", F.lower("name").alias("_n")).distinct(), ["request_id", "_n"], "left_anti").drop("_n")


def head_counts(decisions: DataFrame) -> DataFrame:
    """decisions with kept and cut, whatever shape their record has; both null where nothing was edited.

    decisions: proof_kept and proof_dropped (arrays of kinds, of a joint proof), kept (a number),
    candidates (array<struct<keep>>), dropped_count, and drops (the kinds of the drops to show). A
    proof that also dropped other kinds than those shown counts only these; without a
    proof the kept number counts, else the candidates to keep, and the dropped count, else the drops.
    """
    zero = F.array().cast("array<string>")
    dropped, shown = F.coalesce("proof_dropped", zero), F.coalesce("drops", zero)
    other = (F.size(shown) > 0) & (F.size(F.array_except(dropped, shown)) > 0)
    proof_kept = F.when(other, F.size(F.filter("proof_kept", lambda k: F.array_contains(shown, k)))).otherwise(F.size("proof_kept"))
    proof_cut = F.when(other | (F.size(dropped) == 0), F.size(shown)).otherwise(F.size(dropped))
    edited = F.col("kept").isNotNull() | (F.coalesce(F.size("candidates"), F.lit(0)) > 0)
    kept = F.coalesce(F.col("kept"), F.size(F.filter("candidates", lambda c: c["keep"])))
    joint = F.col("proof_kept").isNotNull()
    n_kept = F.when(joint, proof_kept).when(edited, kept).cast("long")
    n_cut = F.when(joint, proof_cut).when(edited, F.coalesce(F.col("dropped_count"), F.size(shown))).cast("long")
    return decisions.withColumns({"n_kept": n_kept, "n_cut": n_cut})


def drop_texts(pointers: DataFrame, messages: DataFrame) -> DataFrame:
    """pointers (request_id, idx, kind) with recorded: the text at the place, if its kind agrees."""
    own = messages.select("request_id", "idx", F.col("kind").alias("_k"), F.col("text").alias("_t"))
    return pointers.join(own, ["request_id", "idx"], "left").withColumn("recorded", F.when(F.col("_k") == F.col("kind"), F.col("_t"))).drop("_k", "_t")


def effort(features: DataFrame, heavy: str = T.HEAVY, trivial: str = T.TRIVIAL) -> DataFrame:
    """Reasoning tier of each request; features: last_user_text, n_paths, est_in_tok, tool_chars, user_turns."""
    text = F.coalesce("last_user_text", F.lit(""))
    heavy = F.size(F.regexp_extract_all(text, F.lit(heavy), F.lit(0)))
    many = F.col("n_paths") >= 3
    trivial = F.regexp_like(text, F.lit(trivial)) & ~many
    rules = [("complexity-terms", F.col("heavy") >= 2, 2), ("multi-file", many, 1), ("long-input", F.col("est_in_tok") > 24000, 1), ("tool-heavy", F.col("tool_chars") > 40000, 1), ("trivial-request", trivial, -3), ("first-turn-simple", (F.coalesce("user_turns", F.lit(0)) <= 1) & (F.col("heavy") == 0), -1)]
    score = F.lit(0)
    for _, cond, points in rules:
        score = score + F.when(cond, points).otherwise(0)
    out = features.withColumn("heavy", heavy).withColumn("effort_score", score).withColumn("reasons", F.array_compact(F.array(*(F.when(c, k) for k, c, _ in rules))))
    tier = F.when(F.col("effort_score") <= -1, "low").when(F.col("effort_score") >= 2, "high").otherwise("medium")
    return out.withColumn("tier", tier).withColumn("small_model_ok", (F.col("tier") == "low") & ~many & (F.col("est_in_tok") < 16000))


def is_core(name: Column) -> Column:
    out = name.isin(CORE_TOOLS)
    for part in CORE_PARTS:
        out = out | name.contains(part)
    return out


def tool_scores(tools: DataFrame, threshold: float = 0.0) -> DataFrame:
    """tools (request_id, pos, name, terms, query_terms) with score, core, keep and why."""
    terms = F.array_distinct("terms")
    hits = F.array_intersect("query_terms", terms)
    core = is_core(F.lower("name"))
    raw = F.size(hits) / F.greatest(F.lit(1.0), F.least(F.size(terms), F.lit(12)))
    out = tools.withColumn("raw", F.size(hits).cast("double")).withColumn("_s", raw).withColumn("score", F.round("_s", 3)).withColumn("core", core)
    why = F.concat(F.when(F.col("core"), F.array(F.lit("core"))).otherwise(F.array().cast("array<string>")), F.slice(F.array_sort(hits), 1, 4))
    return out.withColumn("keep", F.col("core") | (F.col("_s") > threshold)).withColumn("why", why).drop("_s")


def core_floor(scored: DataFrame, floor: int = CORE_FLOOR) -> DataFrame:
    """If a request keeps fewer tools than the floor, its best ones by score are kept too; pos is unique within a request."""
    kept = scored.groupBy("request_id").agg(F.count_if("keep").alias("_kept")).where(F.col("_kept") < floor).select("request_id")
    w = Window.partitionBy("request_id").orderBy(F.desc("score"), "pos")
    # Spark keeps the best few of each task before it brings a request's together
    best = scored.join(kept, "request_id", "left_semi").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= floor)
    best = best.select(F.col("request_id").alias("_q"), F.col("pos").alias("_p"))
    rows = scored.join(best, (F.col("request_id") == F.col("_q")) & (F.col("pos") == F.col("_p")), "left")
    forced = F.col("_p").isNotNull()
    return rows.withColumn("why", F.when(forced, F.concat("why", F.array(F.lit("floor")))).otherwise(F.col("why"))).withColumn("keep", F.col("keep") | forced).drop("_q", "_p")


def option_probability(state: Column, option: Column) -> Column:
    """Lexical relevance of an option to a state."""
    name = F.lower(F.coalesce(option, F.lit("?")))
    words = lambda c: F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]{3,}"), F.lit(0)), F.lower)
    terms = F.array_distinct(F.concat(words(F.translate(name, "_/", "  ")), F.filter(F.split(name, "[^a-z0-9]+"), lambda t: F.length(t) >= 3)))
    overlap = F.size(F.array_intersect(F.array_distinct(words(F.coalesce(state, F.lit("")))), terms))
    p = 0.05 + 0.9 * F.tanh(overlap / F.greatest(F.lit(1), F.least(F.size(terms), F.lit(12))) * 1.8)
    p = F.when(is_core(name), F.greatest(p, F.lit(0.92))).otherwise(p)
    return F.when(F.size(terms) == 0, 0.5).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)), 4))


def score_options(options: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series] | None = None, tool_cut: float = 0.5, message_cut: float = 0.45) -> DataFrame:
    """options (state, option, slot, keep, ...) with p and keep.

    scorer maps a batch of (state, option) to probabilities, null for no answer; without one the
    lexical score answers. No answer leaves the earlier keep as it is. Each distinct pair is
    scored once.
    """
    pairs = options.select("state", "option").distinct()
    if scorer is None:
        answers = pairs.withColumn("p", option_probability(F.col("state"), F.col("option")))
    else:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(p=scorer(batch))

        answers = pairs.mapInPandas(run, "state string, option string, p double")
    a = answers.withColumnsRenamed({"state": "_state", "option": "_option"})
    joined = options.join(a, F.col("state").eqNullSafe(F.col("_state")) & F.col("option").eqNullSafe(F.col("_option")), "left").drop("_state", "_option")
    yes = F.when(F.col("slot") == "tool_gate", (F.col("p") >= tool_cut) | is_core(F.lower("option"))).otherwise(F.col("p") >= message_cut)
    return joined.withColumn("keep", F.coalesce(yes, F.col("keep")))


def file_decisions(hits: DataFrame, min_score: float = 0.8) -> DataFrame:
    """hits (query_terms, path, score) with keep, shown score and term overlap."""
    parts = F.array_distinct(F.split(F.translate(F.lower("path"), "/", " "), " +"))
    return hits.withColumn("keep", F.col("score") >= min_score).withColumn("shown", F.round(F.least(F.lit(1.0), F.col("score") / 6.0), 3)).withColumn("overlap", F.round(F.size(F.array_intersect("query_terms", parts)) / F.greatest(F.lit(1), F.size("query_terms")), 2))


def owned_cuts(drops: DataFrame, own: DataFrame) -> DataFrame:
    """drops (request_id, kind, target, pos) once for each kind and last part of the target, kept if the slot itself cut it (all if it cut none)."""
    key = F.lower(F.substring_index("target", ":", -1))
    w = Window.partitionBy("request_id", "kind", "key").orderBy("pos")
    once = drops.withColumn("key", key).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    cut = own.select("request_id", "kind", F.lower(F.substring_index("target", ":", -1)).alias("key")).distinct()
    hit = once.join(cut, ["request_id", "kind", "key"], "left_semi")
    none = once.join(cut.select("request_id").distinct(), "request_id", "left_anti")
    return hit.unionByName(none)
