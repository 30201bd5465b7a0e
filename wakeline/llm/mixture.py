"""Mixing sources to target weights by hierarchical budgets.

A token budget goes down the tree domain, language, source by the nodes' weights. A node that
can't use its share (its tokens times ``max_epochs``) passes the shortage to its siblings first;
what they can't use either shows at their parent as lower capacity, and goes to the parent's
siblings. Each leaf then takes its documents in whole epochs and the token-prefix of one more
epoch in a seeded order.

Allocation works on the table of leaves. The prefix of a leaf is found in two steps: token sums
by 65,536 ranges of the seeded hash (map-side combined), then sums by key within the one range
that holds the cut. Rows meet the leaves' targets by broadcast while those are at most
``BROADCAST_ROWS``, else in a join salted over ``SALT`` parts. So a leaf with a third of all rows
is no hot group, nor is a doc_id with as many: rows of one leaf, doc_id and number of tokens are
counted as one, and only where the cut goes through such a group are its rows numbered.

Defined cases: a null text has no tokens and costs nothing; null domains, languages and sources
are leaves named ''; rows with equal doc_id follow each other, the smaller first, and of equal
ones any; the share of a node is rounded down; a budget over the capacity takes all epochs of
everything; very long texts are counted whole and cost their tokens; an empty table
gives an empty result; columns named domain, n_tokens or copies give way to the operator's own,
all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read, settled

LEVELS = ["domain", "lang", "source"]
SEED, SHARE, MAX_EPOCHS = 17, 0.6, 2
BROADCAST_ROWS, SALT = 100_000, 16  # rows of about 100 bytes
NODES_A_TASK = 50_000
FOUND = ("domain", "n_tokens", "copies")
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The tables hold no domains: four groups of sources."""
    return F.concat(F.lit("d"), F.pmod(F.conv(F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 4), 16, 10).cast("long"), F.lit(4)).cast("string"))


def allocate(leaves: DataFrame, budget: int, levels: list[str] = LEVELS, max_epochs: int = MAX_EPOCHS, weights: DataFrame | None = None) -> DataFrame:
    """leaves (levels, tokens) with target, the tokens each may take. weights: level, name and a positive weight; 1 if not given."""
    tasks = 1 + leaves.count() // NODES_A_TASK
    nodes = leaves.groupBy(*levels).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * max_epochs).alias("_cap")).withColumn("_target", F.lit(budget).cast("long"))
    nodes = settled(nodes.coalesce(tasks))
    for depth, level in enumerate(levels):
        path, up = levels[: depth + 1], levels[:depth]
        parts = nodes.groupBy(*path).agg(F.sum("_cap").alias("cap"), F.first("_target").alias("target"))
        if weights is not None:
            own = weights.where(F.col("level") == level).select(F.col("name").alias(level), F.col("weight").cast("double").alias("weight"))
            parts = parts.join(own, level, "left").fillna({"weight": 1.0})
        else:
            parts = parts.withColumn("weight", F.lit(1.0))
        group = Window.partitionBy(*up) if up else Window.partitionBy(F.lit(0))
        order = group.orderBy(F.col("cap") / F.col("weight"), level)
        parts = parts.withColumn("rest", F.col("target") - F.sum("cap").over(order) + F.col("cap")).withColumn("left", F.sum("weight").over(group) - F.sum("weight").over(order) + F.col("weight"))
        full = F.col("cap") / F.col("weight") <= F.col("rest") / F.col("left")
        by_ratio = F.min_by(F.struct("rest", "left"), F.struct(F.col("cap") / F.col("weight"), F.col(level)))
        parts = parts.withColumn("full", full).withColumn("_one", F.lit(0))
        openers = parts.where("not full").groupBy(*up, "_one").agg(by_ratio.alias("o"))
        parts = parts.join(openers, [*up, "_one"], "left")
        share = F.floor(F.col("o.rest").cast("double") * F.col("weight") / F.col("o.left")).cast("long")
        parts = parts.select(*path, F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", share)).alias("_next"))
        nodes = settled(nodes.join(parts, path).withColumn("_target", F.col("_next")).drop("_next").coalesce(tasks))
    return nodes.select(*levels, "tokens", F.col("_target").alias("target"))


def _meet(rows: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined with few on columns that may be hot."""
    if few.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), on, how)
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_key", "_n"), F.lit(SALT)))
    few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return rows.join(few, [*on, "_salt"], how).drop("_salt")


def _keyed(rows: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """rows with their leaf's target and the place of each in the seeded order of the leaf's last epoch."""
    rows = rows.withColumn("_key", F.col("_id").cast("string"))
    rows = _meet(rows, targets, _LEAF)
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_epochs").cast("string"), F.coalesce("_key", F.lit(""))))
    return rows.withColumn("_key", key).withColumn("_range", F.substring("_key", 1, 4))


_LEAF = ["_d", "_l", "_s"]


def mix(documents: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain: Column | None = None, weights: DataFrame | None = None) -> DataFrame:
    """documents with domain, n_tokens and copies (0 and more): how often each enters the mixture of share times all tokens."""
    leaf = _LEAF
    kept = [c for c in documents.columns if c not in FOUND]
    own = {"_id": F.col("doc_id"), "_d": F.coalesce(domain if domain is not None else domain_of(F.col("source")), F.lit("")), "_l": F.coalesce("lang", F.lit("")), "_s": F.coalesce("source", F.lit("")), "_n": word_count(F.col("text"))}
    # the caller's columns go by number meanwhile, so that no name of theirs meets one of these
    rows = documents.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(kept)], *[c.alias(name) for name, c in own.items()])
    narrow = settled(rows.select(*own))
    leaves = settled(narrow.groupBy(*leaf).agg(F.sum("_n").alias("tokens")))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    targets = allocate(leaves.toDF(*LEVELS, "tokens"), int(total * share), LEVELS, max_epochs, weights).toDF(*leaf, "tokens", "target")
    epochs = F.when(F.col("tokens") > 0, F.expr("target div tokens")).otherwise(F.lit(1).cast("long"))
    targets = settled(targets.withColumn("_epochs", epochs).select(*leaf, "_epochs", (F.col("target") - F.col("_epochs") * F.col("tokens")).alias("_rest")))
    sums = _keyed(narrow, targets, seed).groupBy(*leaf, "_range", "_rest").agg(F.sum("_n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*leaf).orderBy("_range"))
    cut = sums.withColumn("upto", upto).where("upto > _rest").groupBy(*leaf).agg(F.min(F.struct("_range", (F.col("upto") - F.col("n")).alias("before"))).alias("c"))
    targets = settled(targets.join(cut, leaf, "left").select(*leaf, "_epochs", "_rest", F.col("c._range").alias("_cut"), F.col("c.before").alias("_before")))
    groups = _keyed(narrow, targets, seed).where("_range = _cut").groupBy(*leaf, "_key", "_n", "_rest", "_before").agg(F.count("*").alias("_c"))
    upto = F.col("_before") + F.sum(F.col("_n") * F.col("_c")).over(Window.partitionBy(*leaf).orderBy("_key", "_n"))
    room = F.col("_rest") - (F.col("_upto") - F.col("_n") * F.col("_c"))
    some = F.when((F.col("_n") > 0) & (room > 0), F.expr("floor(_room / _n)").cast("long")).otherwise(0)
    fits = groups.withColumn("_upto", upto).withColumn("_room", room).withColumn("_fits", F.when(F.col("_upto") <= F.col("_rest"), F.col("_c")).otherwise(some))
    fits = settled(fits.select(*leaf, "_key", "_n", "_fits", "_c"))
    placed = _meet(_keyed(rows, targets, seed), fits, [*leaf, "_key", "_n"], "left")
    inside = F.col("_cut").isNull() | (F.col("_range") < F.col("_cut")) | F.coalesce(F.col("_fits") == F.col("_c"), F.lit(False))
    through = F.coalesce((F.col("_fits") > 0) & (F.col("_fits") < F.col("_c")), F.lit(False))
    both = placed.where(~through).withColumn("_in", inside)
    if not fits.where(through).isEmpty():
        nth = F.row_number().over(Window.partitionBy(*leaf, "_key", "_n").orderBy("_key"))
        both = both.unionByName(placed.where(through).withColumn("_in", nth <= F.col("_fits")))
    # a leaf without tokens has one whole epoch of its (empty) documents
    copies = F.least(F.lit(max_epochs), F.col("_epochs") + F.when(F.col("_rest") > 0, F.col("_in").cast("long")).otherwise(F.lit(0))).cast("long")
    both = both.withColumn("_copies", copies)
    return both.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(kept)], F.col("_d").alias("domain"), F.col("_n").alias("n_tokens"), F.col("_copies").alias("copies"))


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(documents).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def _level(up: str, level: str, before: str) -> str:
    over = f"PARTITION BY {up}" if up else ""
    keys = f"{up}, {level}" if up else level
    return f"""
p_{level} AS (SELECT {keys}, sum(cap)::BIGINT AS cap, any_value(target) AS target FROM {before} GROUP BY ALL),
r_{level} AS (SELECT *, target - sum(cap) OVER ({over} ORDER BY cap, {level}) + cap AS rest,
                     count(*) OVER ({over}) - row_number() OVER ({over} ORDER BY cap, {level}) + 1 AS k FROM p_{level}),
f_{level} AS (SELECT *, cap::DOUBLE <= rest::DOUBLE / k AS sat FROM r_{level}),
o_{level} AS (SELECT {keys}, cap, sat, first_value(CASE WHEN NOT sat THEN rest END) OVER ({over} ORDER BY sat, cap, {level}) AS orest,
                     first_value(CASE WHEN NOT sat THEN k END) OVER ({over} ORDER BY sat, cap, {level}) AS ok FROM f_{level}),
n_{level} AS MATERIALIZED (SELECT b.domain, b.lang, b.source, b.tokens, b.cap,
                     CASE WHEN o.sat THEN o.cap ELSE least(o.cap, floor(orest::DOUBLE / ok)::BIGINT) END AS target
              FROM {before} b JOIN o_{level} o USING ({keys}))"""


OP8_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, lang, source, coalesce(lang, '') AS l, coalesce(source, '') AS s,
    'd' || (('0x' || substr(md5(coalesce(source, '')), 1, 4))::BIGINT % 4)::VARCHAR AS domain,
    len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, l AS lang, s AS source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
base AS MATERIALIZED (SELECT *, tokens * {MAX_EPOCHS} AS cap, floor((sum(tokens) OVER ())::DOUBLE * {SHARE})::BIGINT AS target FROM leaf),
{_level('', 'domain', 'base')},
{_level('domain', 'lang', 'n_domain')},
{_level('domain, lang', 'source', 'n_lang')},
t AS (SELECT *, CASE WHEN tokens > 0 THEN target // tokens ELSE 1 END AS epochs FROM n_source),
k AS (SELECT d.*, epochs, target - epochs * tokens AS rest, md5('{SEED}|' || epochs::VARCHAR || '|' || doc_id::VARCHAR) AS key
      FROM d JOIN t ON d.domain = t.domain AND d.l = t.lang AND d.s = t.source),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, l, s ORDER BY key, n_tokens ROWS UNBOUNDED PRECEDING) <= rest AS fits FROM k)
SELECT doc_id, domain, lang, source, n_tokens,
       least({MAX_EPOCHS}, epochs + CASE WHEN rest > 0 AND fits THEN 1 ELSE 0 END)::BIGINT AS copies FROM c
"""
