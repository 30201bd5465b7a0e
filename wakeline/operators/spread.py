"""Numbers and neighbours within a key in which no window holds a whole key.

Rows of a key are dealt to stretches of an integer order column. Windows run within a stretch, and
what a stretch needs of the ones before it comes from one row for each stretch, so a key with a
third of all rows is worked on by as many tasks as it has stretches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 65_536  # values of the order column in a stretch, so rows of it where the values are unique


def _with_stretch(rows: DataFrame, keys: list[str], order: str, width: int, summary) -> DataFrame:
    """rows with _stretch and what summary gives of each stretch, joined null-safely on the keys."""
    stretch = F.floor(F.col(order) / width)
    sums = summary(rows.withColumn("_stretch", stretch).groupBy(*keys, "_stretch"))
    named = sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_stretch"])), *(c for c in sums.columns if c not in (*keys, "_stretch")))
    rows = rows.withColumn("_stretch", stretch)
    match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, "_stretch"])]
    return rows.join(named, match, "left").drop(*(f"_k{i}" for i in range(len(keys) + 1)))


def numbered(rows: DataFrame, keys: list[str], order: str, name: str, width: int = WIDTH) -> DataFrame:
    """rows with their number within the key, from 0, by the order column, which is unique within a key."""
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    rows = _with_stretch(rows, keys, order, width, lambda g: g.agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    own = F.row_number().over(Window.partitionBy(*keys, "_stretch").orderBy(order)) - 1
    return rows.withColumn(name, own + F.col("_before")).drop("_before", "_stretch")


def previous(rows: DataFrame, keys: list[str], order: str, columns: list[str], name: str, width: int = WIDTH) -> DataFrame:
    """rows with a struct of the columns of the row before each within its key, null for the first."""
    before = Window.partitionBy(*keys).orderBy("_stretch")
    rows = _with_stretch(rows, keys, order, width, lambda g: g.agg(F.max_by(F.struct(*columns), order).alias("_last")).withColumn("_last", F.lag("_last").over(before)))
    own = F.lag(F.struct(*columns)).over(Window.partitionBy(*keys, "_stretch").orderBy(order))
    return rows.withColumn(name, F.coalesce(own, "_last")).drop("_last", "_stretch")
