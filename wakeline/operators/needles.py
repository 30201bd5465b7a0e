"""Texts searched for very many strings at once."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_paths
from .index import contained_in

NEEDLE_BYTES = 32 << 20  # of distinct needles that one automaton holds
_automata: dict[str, object] = {}


def paths_naming(texts: DataFrame, needles: DataFrame, key: str = "id", bound: int = NEEDLE_BYTES) -> DataFrame:
    """(key, path) for the distinct paths of each text (key, text) that hold one of the needles (needle), as ``paths_named`` has it for a few.

    Needles of up to bound bytes go to every task as one Aho-Corasick automaton, which reads the
    paths of a batch in one pass. More of them meet the paths in joins on their rarest three
    characters; those below three characters, of which there are few, are an automaton still.
    """
    known = needles.select(F.lower("needle").alias("needle")).where("needle != ''").distinct()
    paths = texts.select(key, F.explode(F.array_distinct(extract_paths(F.col("text")))).alias("path"))
    if (known.agg(F.sum(F.octet_length("needle"))).first()[0] or 0) <= bound:
        return paths.where(holds_any(F.col("path"), [r["needle"] for r in known.collect()]))
    short = [r["needle"] for r in known.where(F.length("needle") < 3).collect()]
    met = contained_in(known.where(F.length("needle") >= 3), paths.select("path").distinct(), "needle").select("path").distinct()
    return paths.join(met, "path", "left_semi").select(key, "path").unionByName(paths.where(holds_any(F.col("path"), short))).distinct()


def holds_any(column: Column, needles: list[str]) -> Column:
    """Whether a string holds one of the needles."""
    shared, number = _session().sparkContext.broadcast(needles), uuid.uuid4().hex

    def search(strings: pa.Array) -> pa.Array:
        found = np.zeros(len(strings), bool)
        words = _automaton(number, shared.value) if shared.value else None
        if words is not None and len(strings):
            own = [s or "" for s in strings.to_pylist()]
            ends = np.cumsum([len(s) + 1 for s in own])
            hits = np.fromiter((end for end, _ in words.iter("\n".join(own))), np.int64)  # no path holds a line feed
            found[np.searchsorted(ends, hits, "right")] = True
        return pa.array(found)

    return F.arrow_udf(search, "boolean")(column)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def _automaton(number: str, needles: list[str]):
    """One automaton a worker, of the last set of needles."""
    import ahocorasick

    if number not in _automata:
        words = ahocorasick.Automaton()
        for n in needles:
            if "\n" not in n:
                words.add_word(n, len(n))
        words.make_automaton()
        _automata.clear()
        _automata[number] = words if len(words) else None
    return _automata[number]
