"""What each filter of a chain removes, in every order of the chain.

A document's failures are a mask of one bit a filter. What a chain does to a document depends on
its mask alone, so documents are counted by part and mask first (at most 32 cells a part, partial
sums before the shuffle). Each cell is then folded over the array of all 120 orders: ``transform``
walks the orders and ``aggregate`` the steps of one, which gives 600 structs weighted by the cell's
counts; the cells of a part are merged by elementwise sums, and the part's 600 structs are rows.

Filters: A under 200 words, B under half of the words distinct, C over 2 % capitals, D a character
of ``#$%&*|``, E a text that some smaller doc_id has too, table-wide. E needs the smallest doc_id of
each text that occurs twice or more, by 128 bits of its SHA-256: partial minima, then an equi join
whose hot texts Spark splits, as their other side is one row.

Defined cases: a null text is empty; a null source is the part ''; a null doc_id has no smaller one
and no labels, so it never fails E; rows that share the smallest doc_id of their text all pass E;
each repeated row counts; a doc_id with several labels is good (toxic) if one of them says so; null
labels say nothing; a table without rows gives no rows; columns other than doc_id, text, source
(labels: doc_id, quality, toxic) are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 2
WORD, CAPITAL, SIGN = r"[^\x20\x09-\x0D]+", "[A-Z]", "[#$%&*|]"
SPREAD = 1024  # parts that rows without a doc_id are dealt to
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(documents: DataFrame) -> DataFrame:
    """doc_id, part and fails (bit k for the k-th filter) of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("same", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    first = rows.groupBy(F.col("same").alias("same_too")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("same_too", "first_id")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    own = rows.withColumn("words", words).select(
        "doc_id", "part", "same",
        (F.size("words") < MIN_WORDS).alias("a"),
        (100 * F.size(F.array_distinct("words")) < MIN_DISTINCT_PERCENT * F.size("words")).alias("b"),
        (100 * F.regexp_count("text", F.lit(CAPITAL)) > MAX_CAPITAL_PERCENT * F.char_length("text")).alias("c"),
        F.col("text").rlike(SIGN).alias("d"),
    )
    e = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    bits = [F.col(x) for x in "abcd"] + [e]
    fails = sum((bit.cast("int") * (1 << k) for k, bit in enumerate(bits)), F.lit(0))
    return own.join(first, F.col("same") == F.col("same_too"), "left").select("doc_id", "part", fails.alias("fails"))


def cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails, n, good and toxic: the documents of each part and mask, and the labelled among them."""
    said = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c) for c in ("quality", "toxic")]
    known = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("string").alias("labelled")).agg(*said)
    # a key that no label has deals rows without a doc_id to many tasks instead of one
    none = F.concat(F.lit("none "), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("string"))
    rows = failed.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), none)).join(known, F.col("key") == F.col("labelled"), "left")
    return rows.groupBy("part", "fails").agg(F.count("*").alias("n"), F.count_if("quality").alias("good"), F.count_if("toxic").alias("toxic"))


def _step(cell: Column, seen: Column, bit: Column) -> Column:
    """The figures of one step for one cell: seen holds the bits of the filters before, bit the step's own."""
    fails = cell["fails"]
    here, before = fails.bitwiseAND(bit) != 0, fails.bitwiseAND(seen) != 0
    when = lambda condition, count: F.when(condition, cell[count]).otherwise(F.lit(0).cast("long"))
    values = (when(~here & ~before, "n"), when(here & ~before, "n"), when(here & before, "n"), when(fails == bit, "n"), when(here & ~before, "good"), when(here & ~before, "toxic"))
    return F.struct(bit.alias("bit"), *(v.alias(k) for k, v in zip(FIGURES, values, strict=True)))


_STEP = "struct<bit:int," + ",".join(f"{k}:bigint" for k in FIGURES) + ">"


def _weighted(cell: Column, orders: Column) -> Column:
    """The structs of all steps of all orders, one order after another."""

    def one(order: Column) -> Column:
        start = F.struct(F.lit(0).alias("seen"), F.array().cast(f"array<{_STEP}>").alias("steps"))
        more = lambda fold, bit: F.struct(fold["seen"].bitwiseOR(bit).alias("seen"), F.array_append(fold["steps"], _step(cell, fold["seen"], bit)).cast(f"array<{_STEP}>").alias("steps"))
        return F.aggregate(order, start, more, lambda fold: fold["steps"])

    return F.flatten(F.transform(orders, one))


def _summed(a: Column, b: Column) -> Column:
    return F.struct(b["bit"].alias("bit"), *((a[k] + b[k]).alias(k) for k in FIGURES))


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from rows of part, fails, n, good and toxic.

    A part's cells are gathered in one row: at most 2 ** len(filters) structs.
    """
    n = len(filters)
    names = ["".join(p) for p in permutations(filters)]
    orders = F.from_json(F.lit(str([[1 << filters.index(f) for f in name] for name in names])), "array<array<int>>")
    zero = F.struct(F.lit(0).alias("bit"), *(F.lit(0).cast("long").alias(k) for k in FIGURES))
    zeros = F.array_repeat(zero, n * len(names)).cast(f"array<{_STEP}>")
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells")).withColumn("orders", orders)
    merged = parts.select("part", F.aggregate("cells", zeros, lambda all_, cell: F.zip_with(all_, _weighted(cell, F.col("orders")), _summed).cast(f"array<{_STEP}>")).alias("steps"))
    own = lambda bit: F.aggregate("steps", F.lit(0).cast("long"), lambda total, step: total + F.when(step["bit"] == bit, step["removed"]).otherwise(0))
    shares = merged.withColumn("shapley", F.create_map(*(x for k in range(n) for x in (F.lit(1 << k), own(1 << k)))))
    rows = shares.select("part", "shapley", F.posexplode("steps").alias("place", "step"))
    order = F.element_at(F.array(*map(F.lit, names)), (F.floor(F.col("place") / n) + 1).cast("int"))
    return rows.select("part", order.alias("filter_order"), (F.col("place") % n + 1).alias("step"), *(F.col(f"step.{k}") for k in FIGURES), F.col("shapley")[F.col("step.bit")].alias("shapley"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(cells(failures(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels")))


OP12_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS x FROM d),
f AS (SELECT doc_id, part, len(x) < {MIN_WORDS} AS a, 100 * len(list_distinct(x)) < {MIN_DISTINCT_PERCENT} * len(x) AS b,
             100 * (length(t) - length(regexp_replace(t, '{CAPITAL}', '', 'g'))) > {MAX_CAPITAL_PERCENT} * length(t) AS c,
             regexp_matches(t, '{SIGN}') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS fails, count(*) AS n,
             count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
v AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT v1.k || v2.k || v3.k || v4.k || v5.k AS filter_order FROM v v1, v v2, v v3, v v4, v v5
      WHERE len(list_distinct([v1.k, v2.k, v3.k, v4.k, v5.k])) = 5),
s AS (SELECT filter_order, i::INT AS step, 1 << (ascii(filter_order[i]) - 65) AS bit,
             coalesce(list_sum([1 << (ascii(filter_order[j]) - 65) for j in range(1, i)]), 0)::INT AS seen
      FROM (SELECT filter_order, unnest(range(1, 6)) AS i FROM o)),
r AS (SELECT part, filter_order, step, bit,
             coalesce(sum(n) FILTER (fails & (seen | bit) = 0), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (fails & bit <> 0 AND fails & seen = 0), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (fails & bit <> 0 AND fails & seen <> 0), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (fails = bit), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (fails & bit <> 0 AND fails & seen = 0), 0)::BIGINT AS good_lost,
             coalesce(sum(toxic) FILTER (fails & bit <> 0 AND fails & seen = 0), 0)::BIGINT AS toxic_lost
      FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
