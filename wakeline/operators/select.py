"""Values at exact ranks, of many groups at once, without a window over a group's values.

A quantile sketch of each group brackets every wanted rank, and one more pass counts the values
below each bracket and the equal ones inside. Where more than ``FEW`` different values are inside,
the bracket's own values are sketched and counted again. Only the different values of the last
brackets are put in order: below a thousandth of a large group, less with every round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEW = 4096
GRID, SKETCH = 4000, 10_000  # shares that a sketch is asked for, and its accuracy; a bracket is three steps of the grid
ROUNDS = 8
SMALL = 50_000  # brackets that are broadcast


def values_at(df: DataFrame, value: str, ranks: dict[str, Column], group: list[str] | None = None, few: int = FEW) -> DataFrame:
    """The group columns, n, and for each name the value at its 0-based rank, which is a column of n; nulls are left out.

    A rank outside 0 to n - 1 gives null; without groups there is one row, whatever n. Groups are matched null-safely. value is numeric or a time.
    """
    group = group or []
    keys = [f"_g{i}" for i in range(len(group))]
    by = [*keys, "name"]
    rows = df.where(F.col(value).isNotNull()).select(*(F.col(g).alias(k) for g, k in zip(group, keys, strict=True)), F.col(value).alias("_v"))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()))).alias("w")
    sketched = rows.groupBy(*keys).agg(F.count("*").alias("n"), _sketch().alias("q")).persist()
    asked = sketched.select(*keys, "n", "q", wanted).select(*keys, "q", "w.*", F.col("n").alias("here")).where("rank >= 0 and rank < here")
    brackets = _bracketed(asked.withColumn("before", F.lit(0).cast("long")), by)
    for left in reversed(range(ROUNDS)):
        brackets = brackets.persist()
        seen = _counted(rows, brackets, by, brackets.count() <= SMALL).persist()
        sums = seen.groupBy(*by).agg(F.sum(F.when(F.col("below"), F.col("c")).otherwise(0)).alias("before"), F.sum(F.when(F.col("below"), 0).otherwise(F.col("c"))).alias("here"), F.count_if(~F.col("below")).alias("different"))
        state = _joined(brackets, sums, by)
        missed = (F.col("rank") < F.col("before")) | (F.col("rank") >= F.col("before") + F.col("here"))
        worst = state.agg(F.max("different"), F.count_if(missed)).first()
        if not left or not worst[1] and (worst[0] or 0) <= few:
            break
        # a bracket that the sketch had wrong opens again, the others are sketched inside
        tighter = state.select(*by, "rank", "before", "here", F.when(~missed, F.col("lo")).alias("lo"), F.when(~missed, F.col("hi")).alias("hi"))
        inside = _met(rows, tighter, by, False).where(_in()).groupBy(*by).agg(_sketch().alias("q"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("rank").alias("rank"), F.max("before").alias("before"), F.max("here").alias("here"))
        brackets = _bracketed(inside, by)
    upto = seen.where("not below").withColumn("upto", F.sum("c").over(Window.partitionBy(*by).orderBy("_v")))
    rest = F.col("rank") - F.col("before")
    found = _joined(upto, state.select(*by, "rank", "before"), by).where((F.col("upto") > rest) & (F.col("upto") - F.col("c") <= rest))
    picks = [F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks]
    picked = found.groupBy(*keys).agg(*picks)
    out = _joined(sketched.select(*keys, "n"), picked, keys, "left") if keys else sketched.select("n").join(F.broadcast(picked), how="left")  # one row each
    return out.select(*(F.col(k).alias(g) for k, g in zip(keys, group, strict=True)), "n", *ranks)


def _sketch() -> Column:
    shares = F.split(F.lit(",".join(str(i / GRID) for i in range(1, GRID))), ",").cast("array<double>")  # one literal
    return F.percentile_approx("_v", shares, SKETCH)


def _bracketed(asked: DataFrame, by: list[str]) -> DataFrame:
    """by, rank, lo and hi: the grid's values around the rank, a step apart from it at least; older bounds where the grid ends."""
    place = F.floor((F.col("rank") - F.col("before")) / F.col("here") * GRID).cast("int")
    old = [F.col(c) if c in asked.columns else F.lit(None) for c in ("lo", "hi")]
    lo = F.when((place >= 2) & (place <= GRID), F.get("q", place - 2)).otherwise(old[0])
    hi = F.when((place >= 0) & (place < GRID - 2), F.get("q", place + 1)).otherwise(old[1])
    return asked.select(*by, "rank", lo.alias("lo"), hi.alias("hi"))


def _joined(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    b = b.select(*(F.col(k).alias(f"{k}_") for k in by), *(c for c in b.columns if c not in by))
    return a.join(b, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in by], how).drop(*(f"{k}_" for k in by))


def _met(rows: DataFrame, brackets: DataFrame, by: list[str], small: bool) -> DataFrame:
    """Each row with the brackets of its group, one for each name."""
    keys = by[:-1]
    if not keys:  # one bracket for each wanted rank
        kind = rows.schema["_v"].dataType
        few = [F.struct(F.lit(b["name"]).alias("name"), F.lit(b["rank"]).cast("long").alias("rank"), F.lit(b["lo"]).cast(kind).alias("lo"), F.lit(b["hi"]).cast(kind).alias("hi"), *(F.lit(b[c]).cast("long").alias(c) for c in ("before", "here") if c in brackets.columns)) for b in brackets.collect()]
        return rows.select("_v", F.explode(F.array(*few)).alias("b")).select("_v", "b.*") if few else rows.join(brackets.limit(0))
    return _joined(rows, F.broadcast(brackets) if small else brackets, keys)


def _in() -> Column:
    return (F.col("lo").isNull() | (F.col("_v") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("_v") <= F.col("hi")))


def _counted(rows: DataFrame, brackets: DataFrame, by: list[str], small: bool) -> DataFrame:
    """by, _v, below and c: how many rows have each value of a bracket, and how many lie below it (in one row without a value)."""
    below = F.coalesce(F.col("_v") < F.col("lo"), F.lit(False))
    met = _met(rows, brackets, by, small).where(below | _in())
    return met.groupBy(*by, below.alias("below"), F.when(~below, F.col("_v")).alias("_v")).agg(F.count("*").alias("c"))
