"""A relevance index over files: terms, edges, and ranked search as an inverted-index join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_name, lexical_tokens
from .paths import meet

SYMBOL, PATH, HINT, MENTION, IMPORTS, IMPORTED = 3.0, 2.0, 0.6, 8.0, 2.0, 1.2
MAX_HINTS = 400
FEW_TERMS = 200_000  # distinct query terms that are broadcast, some ten bytes each
ENDINGS = ["", ".py", "/__init__.py", ".js", ".ts", ".tsx", "/index.js", "/index.ts"]


def heading_symbols(files: DataFrame) -> DataFrame:
    """(path, term) from markdown headings and SQL objects; files without any give their first two lines."""
    src = F.coalesce("src", F.lit(""))
    heads = F.regexp_extract_all(src, F.lit(r"(?m)^#{1,6}[ \t]+([^\n]+)"), F.lit(1))
    ddl = F.regexp_extract_all(src, F.lit(r"(?i)\bcreate[ \t]+(?:or[ \t]+replace[ \t]+)?(?:table|view|function|index)[ \t]+(?:if[ \t]+not[ \t]+exists[ \t]+)?([A-Za-z0-9_.]+)"), F.lit(1))
    titles = F.concat(heads, ddl)
    titles = F.when(F.size(titles) > 0, titles).otherwise(F.slice(F.filter(F.split(src, "\n"), lambda x: F.trim(x) != ""), 1, 2))
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.array_join(titles, " "), F.lit("[A-Za-z0-9]{3,}"), F.lit(0)), F.lower))
    return files.select("path", F.explode(words).alias("term"))


def hint_terms(files: DataFrame, symbols: DataFrame | None = None, most: int = MAX_HINTS) -> DataFrame:
    """(path, term): distinct words of four letters and more, of text, base name and symbols; the first ones in order."""
    word = F.transform(F.regexp_extract_all(F.coalesce("src", F.lit("")), F.lit("[A-Za-z]{4,}"), F.lit(0)), F.lower)
    rows = files.withColumn("_w", F.concat(F.array_distinct(word), F.array_compact(F.array(base_name(F.col("path"))))))
    if symbols is not None:
        own = symbols.groupBy("path").agg(F.collect_set("term").alias("_s"))
        rows = rows.join(own, "path", "left").withColumn("_w", F.concat("_w", F.coalesce("_s", F.array().cast("array<string>"))))
    return rows.select("path", F.explode(F.slice(F.sort_array(F.array_distinct("_w")), 1, most)).alias("term"))


def degrees(edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("n_in"))
    return out.join(into, "path", "full").select("path", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def _trigrams(text: Column) -> Column:
    return F.when(F.length(text) >= 3, F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))


def contained_in(needles: DataFrame, paths: DataFrame, needle: str) -> DataFrame:
    """needles joined with the paths that contain them: meets under the needle's rarest three characters, then compares.

    A path that contains the needle has all of its threes; one that no path has ends the search.
    """
    right = paths.select("path", F.explode(F.array_distinct(_trigrams(F.col("path")))).alias("_g"))
    rate = right.groupBy("_g").agg(F.count("*").alias("_c"))
    own = needles.select(needle).where(F.length(needle) >= 3).distinct()
    own = own.select(needle, F.explode(F.array_distinct(_trigrams(F.col(needle)))).alias("_g")).join(rate, "_g", "left")
    rarest = own.groupBy(needle).agg(F.min(F.struct(F.coalesce("_c", F.lit(0)).alias("c"), "_g")).alias("_m")).where("_m.c > 0")
    left = needles.join(rarest.select(needle, F.col("_m._g").alias("_g")), needle)
    return left.join(right, "_g").where(F.contains(F.col("path"), F.col(needle))).drop("_g")


def term_tiers(known: DataFrame, symbols: DataFrame, hints: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, term, w): the tiers of symbol, path and hint that the known terms have in a file, in one row for each tier."""
    # what no query asks for is left where the files are read, while the asked terms are few
    asked = (lambda rows: rows.join(F.broadcast(known), "term", "left_semi")) if known.count() <= FEW_TERMS else (lambda rows: rows.join(known, "term", "left_semi"))
    tiers = asked(symbols).select("path", "term", F.lit(SYMBOL).alias("w"))
    tiers = tiers.unionByName(contained_in(known, paths, "term").select("path", "term", F.lit(PATH).alias("w")))
    return tiers.unionByName(asked(hints).select("path", "term", F.lit(HINT).alias("w")))


def best_files(queries: DataFrame, tiers: DataFrame, more: DataFrame) -> DataFrame:
    """(item_id, path, score): each term of a query (item_id, terms) earns the best tier it has in a file, and more (item_id, path, score) is added.

    The rows meet by file, before they meet the queries: what files and queries have in common, the
    larger by far, is added up where the file is. What is more of a pair comes as a term that only its query has.
    """
    own = F.concat(F.lit(" "), F.coalesce(F.col("item_id").cast("string"), F.lit("")))  # a term has no space
    terms = queries.select("item_id", F.explode("terms").alias("term")).unionByName(queries.select("item_id", own.alias("term"))).distinct()
    rows = tiers.unionByName(more.groupBy("item_id", "path").agg(F.sum("score").alias("w")).select("path", own.alias("term"), "w"))
    best = rows.repartition("path").groupBy("path", "term").agg(F.max("w").alias("w"))
    wanted = F.broadcast(terms) if terms.count() <= FEW_TERMS else terms
    return best.join(wanted, "term").groupBy("item_id", "path").agg(F.round(F.sum("w"), 2).alias("score"))


def mention_scores(mentions: DataFrame, paths: DataFrame) -> DataFrame:
    return contained_in(mentions, paths, "mention").groupBy("item_id", "path").agg((F.count("*") * MENTION).alias("score"))


def graph_scores(mentioned: DataFrame, edges: DataFrame) -> DataFrame:
    """One hop from mentioned files: importers of one gain more than what it imports."""
    importers = mentioned.join(edges, mentioned["path"] == edges["dst"]).select("item_id", F.col("src").alias("path"), F.lit(IMPORTS).alias("score"))
    imported = mentioned.join(edges, mentioned["path"] == edges["src"]).select("item_id", F.col("dst").alias("path"), F.lit(IMPORTED).alias("score"))
    return importers.unionByName(imported).groupBy("item_id", "path").agg(F.sum("score").alias("score"))


def search(queries: DataFrame, paths: DataFrame, symbols: DataFrame, hints: DataFrame, edges: DataFrame, k: int = 12) -> DataFrame:
    """The k best files of each query (item_id, text, mention), by score and then path."""
    terms = queries.select("item_id", lexical_tokens(F.col("text"), 80).alias("terms")).persist()  # few next to the files, and asked several times
    mentioned = mention_scores(queries.select("item_id", "mention"), paths).persist()  # both as scores and as where the graph starts
    tiers = term_tiers(terms.select(F.explode("terms").alias("term")).distinct(), symbols, hints, paths)
    total = best_files(terms, tiers, mentioned.unionByName(graph_scores(mentioned.select("item_id", "path"), edges))).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "path"))
    return total.withColumn("rank", rank).where(F.col("rank") <= k)


def resolve_imports(specs: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst) of import specs (src, spec): the first existing candidate path, else an external node."""
    spec = F.col("spec")
    slashed = F.regexp_replace(F.regexp_replace(spec, r"^\./", ""), r"\.(?!/)", "/")
    stems = F.array(spec, slashed)
    candidates = F.flatten(F.transform(F.array(*map(F.lit, ENDINGS)), lambda end: F.transform(stems, lambda s: F.concat(s, end))))
    rows = specs.select("src", "spec", F.posexplode(candidates).alias("pos", "path")).join(files.select("path"), "path", "left_semi")
    found = rows.groupBy("src", "spec").agg(F.min_by("path", "pos").alias("dst"))
    return specs.join(found, ["src", "spec"], "left").select("src", F.coalesce("dst", F.concat(F.lit("ext:"), spec)).alias("dst")).distinct()


def couple_evidence(messages: DataFrame, ranked: DataFrame) -> DataFrame:
    """(request_id, idx, evidence): the best score, relative to the request's best, of a ranked file that the message names.

    messages: request_id, idx, named (a path); ranked: request_id, path, score. Either may be the
    shorter spelling.
    """
    best = ranked.groupBy("request_id").agg(F.max("score").alias("_best"))
    top = ranked.join(best, "request_id").select("request_id", "path", (F.col("score") / F.col("_best")).alias("rel"))
    return meet(messages, top, ["request_id"], "named", "path").groupBy("request_id", "idx").agg(F.round(F.max("rel"), 6).alias("evidence"))
