"""Column functions over message text: token estimates, terms, paths, markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that carry no meaning in a request.
STOP_WORDS = ["the", "and", "for", "with", "you", "are", "was", "that", "this", "from", "have", "has", "not", "but", "can", "will", "should", "would", "into", "please", "just", "like", "about", "there", "their", "them", "they", "code", "file", "files", "make", "sure", "using", "use"]
# File name extensions of paths.
EXTENSIONS = "py|js|jsx|ts|tsx|mjs|cjs|go|rs|java|rb|php|c|h|cpp|cs|swift|kt|sql|json|jsonl|csv|tsv|ya?ml|toml|md|html|css|sh|vue|svelte"
# User agents in order of precedence, and the names they stand for.
CLIENTS = [("claude", "claude-code"), ("codex", "codex"), ("gemini", "gemini-cli"), ("cline", "cline"), ("opencode", "opencode"), ("cursor", "cursor"), ("aider", "aider"), ("antigravity", "antigravity"), ("openai", "openai-sdk")]
# What marks an error, a requirement, a diff, a heavy and a trivial request.
ERROR = r"(?i)Traceback \(most recent call last\)|\bERROR\b|\berror:\b|FAILED|AssertionError|panic:|exception|exit code [1-9]|\bfailed to\b"
ANCHOR = r"(?i)\bmust\b|\brequirement|\bacceptance|\bconstraint\b|\bdo not\b|\bnever\b|\bplan\b|\broot cause\b|\bspec\b"
DIFF = r"(?m)^(?:--- |\+\+\+ |@@ |\+\S|-S)"
HEAVY = r"(?i)\brefactor\b|\bmigrat[A-Za-z0-9_]+\b|\barchitect[A-Za-z0-9_]+\b|\bconcurrency\b|\brace\b|\bdeadlock\b|\bcache\b|\bauth[A-Za-z0-9_]*\b|\bschema\b|\btest coverage\b|\bperf[A-Za-z0-9_]*\b|\bdebug\b|\btrace\b|\bstack trace\b"
TRIVIAL = r"(?i)^\s*(fix (the )?typo|rename|add (a )?comment|reformat|format|bump|update (the )?(readme|version|date)|say|what is|list|print)"


def approx_tokens(text: Column) -> Column:
    """0 for an empty text, else one token for 3.6 characters, rounded, at least 1."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 3.6 + 0.5))).cast("long")


def body_sha(body: Column) -> Column:
    return F.substring(F.sha2(body, 256), 1, 12)


def dialect(path: Column) -> Column:
    has = path.contains
    return F.when(has("/messages"), "anthropic").when(has("generateContent") | has("streamGenerateContent"), "gemini").when(has("/responses"), "responses").when(has("/chat/completions") | has("/completions"), "openai")


def client_name(user_agent: Column) -> Column:
    agent = F.lower(F.coalesce(user_agent, F.lit("")))
    out = F.when(F.lit(False), "")
    for needle, name in CLIENTS:
        out = out.when(agent.contains(needle), name)
    head = F.substring(F.substring_index(agent, "/", 1), 1, 32)
    return out.otherwise(F.when(head == "", "unknown").otherwise(head))


def lexical_tokens(text: Column, limit: int = 200, stop: list[str] | None = None) -> Column:
    """Distinct lower-case terms of identifiers in order of first appearance."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9_.$/-]{3,}"), F.lit(0))
    cut = F.transform(runs, lambda x: F.split(F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2"), r"[._/$\- ]+"))
    terms = F.transform(F.flatten(cut), F.lower)
    stop = STOP_WORDS if stop is None else stop
    kept = F.filter(terms, lambda t: (F.length(t) >= 3) & ~t.isin(stop) if stop else F.length(t) >= 3)
    return F.slice(F.array_distinct(kept), 1, limit)


def extract_paths(text: Column) -> Column:
    """Path-shaped runs with a whole known extension, in lower case, repeats kept."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[A-Za-z0-9_./-]+\.(?:{EXTENSIONS})(?![A-Za-z0-9_])"), F.lit(0))
    return F.transform(found, F.lower)


def paths_named(text: Column, needles: Column) -> Column:
    """The distinct paths of a text that hold one of the needles; texts without any needle are not scanned for paths."""
    hit = F.exists(needles, lambda n: (n != "") & F.contains(text, n))
    named = F.filter(F.array_distinct(extract_paths(text)), lambda p: F.exists(needles, lambda n: (n != "") & F.contains(p, n)))
    return F.when(hit, named).otherwise(F.array().cast("array<string>"))


def base_name(path: Column) -> Column:
    return F.substring_index(F.lower(path), "/", -1)


def same_path(a: Column, b: Column) -> Column:
    """Equality up to a shorter spelling of either path, cut at a slash."""
    a, b = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    return (a != "") & (b != "") & ((a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a)))


READABLE = ["text", "content", "description", "arguments", "input"]
DEPTH = 4


def first_texts(values: DataFrame, key: str = "id", depth: int = DEPTH) -> DataFrame:
    """(key, text) of values (key, value: JSON text): the first readable text inside, white space collapsed, '' if there is none.

    Objects are read under READABLE, in that order, lists in theirs, down to a depth; each level is
    one explode of the variants that are no text yet, and the first is the least place.
    """
    node = F.coalesce(F.try_parse_json("value"), F.to_variant_object(F.array("value")))  # what is no JSON is a text
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, READABLE)), F.col("k")) - 1, F.lit(-1))
    level = values.select(F.col(key), node.alias("v"), F.array().cast("array<int>").alias("place"))
    found = None
    for d in range(depth + 1):
        kind = F.schema_of_variant("v")
        text = F.trim(F.regexp_replace(F.variant_get("v", "$", "string"), r"\s+", " "))
        own = level.where(kind == "STRING").select(key, "place", text.alias("text")).where("text != ''")
        found = own if found is None else found.unionByName(own)
        if d < depth:
            inner = level.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
            inner = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("p", "k", "inner"))
            inner = inner.withColumn("rank", F.when(F.col("k").isNull(), F.col("p")).otherwise(rank)).where("rank >= 0")
            level = inner.select(key, F.col("inner").alias("v"), F.array_append("place", F.col("rank").cast("int")).alias("place"))
    first = found.groupBy(key).agg(F.min_by("text", "place").alias("text"))
    return values.select(key).join(first, key, "left").withColumn("text", F.coalesce("text", F.lit("")))
