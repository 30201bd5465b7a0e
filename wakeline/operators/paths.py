"""Paths that are spellings of one file: equal, or one is the end of the other, cut at a slash."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def endings(path: Column) -> Column:
    """The path in lower case and what follows each of its slashes, longest first; nothing of an empty one."""
    parts = F.split(F.lower(path), "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return F.filter(every, lambda s: s != "")


def meet(left: DataFrame, right: DataFrame, on: list[str], left_path: str, right_path: str) -> DataFrame:
    """Rows of both sides that agree in the columns on (once in the result) and spell one file.

    One equi join: the right path is one of the left's endings (side 0), or the left path one of
    the right's longer ones (side 1). Files that only share a base name never meet, however many
    there are, and each side is read once.
    """
    kept = [c for c in right.columns if c not in on]
    r = right.select(*(F.col(c).alias(f"_on{i}") for i, c in enumerate(on)), *kept)

    def placed(rows: DataFrame, path: str, whole: int, name: str) -> DataFrame:
        own = F.lower(path)
        ends = F.transform(F.filter(endings(F.col(path)), lambda e: e != own) if whole == 0 else endings(F.col(path)), lambda e: F.struct(F.lit(1 - whole).alias("side"), e.alias("end")))
        return rows.withColumn(name, F.explode(F.concat(ends, F.array(F.struct(F.lit(whole).alias("side"), own.alias("end")))))).where(F.col(f"{name}.end") != "")

    long, far = placed(left, left_path, 1, "_end"), placed(r, right_path, 0, "_far")
    agree = [long[c].eqNullSafe(far[f"_on{i}"]) for i, c in enumerate(on)]
    met = long.join(far, [*agree, F.col("_end.side") == F.col("_far.side"), F.col("_end.end") == F.col("_far.end")])
    return met.drop("_end", "_far", *(f"_on{i}" for i in range(len(on))))


FOLDED = "path string, fetches long, tokens long"


def fold_spellings(counts: DataFrame) -> DataFrame:
    """Paths of one request that are spellings of one file become the most specific of them.

    counts: request_id, path, fetches, tokens, first_pos, and last_pos if known. In order of first
    appearance a path joins the first file that it spells, and gives it its name if it has more
    parts; the file's tokens are those of its last fetch. The fold finds a file by any of its
    endings, so a request with very many files of one base name costs one step for each.
    """
    last = F.col("last_pos") if "last_pos" in counts.columns else F.col("first_pos")
    rows = counts.select("request_id", F.col("first_pos").cast("long"), F.lower("path").alias("path"), F.col("fetches").cast("long"), F.col("tokens").cast("long"), last.cast("long").alias("last_pos"))
    rows = rows.where("path is not null and path != ''")
    of_id = rows.schema["request_id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, files = None, _Files()
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            out: list[tuple] = []
            for request, _, path, n, tokens, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if request != key:
                    out += files.rows(key)
                    key, files = request, _Files()
                files.add(path, n, tokens, at)
            if out:
                yield _batch(out, kind)
        if kind is not None and (out := files.rows(key)):
            yield _batch(out, kind)

    return rows.repartition("request_id").sortWithinPartitions("request_id", "first_pos", "path").mapInArrow(fold, f"request_id {of_id}, {FOLDED}")


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.string(), pa.int64(), pa.int64()), strict=True)], ["request_id", "path", "fetches", "tokens"])


class _Files:
    """Files of one request in order: the first that a path spells is found by its own endings, or by a file's."""

    def __init__(self):
        self.files: dict[int, list] = {}  # number: path, fetches, tokens, last place
        self.named: dict[str, int] = {}
        self.ending: dict[str, list[int]] = {}
        self.next = 0

    @staticmethod
    def _ends(path: str) -> list[str]:
        parts = path.split("/")
        return [e for e in ("/".join(parts[i:]) for i in range(len(parts))) if e]

    def add(self, path: str, n: int, tokens: int | None, at: int) -> None:
        ends = self._ends(path)
        found = [self.named[e] for e in ends if e in self.named]
        found += [min(self.ending[path])] if self.ending.get(path) else []
        if not found:
            self._put(path, [path, n, tokens, at])
            return
        number = min(found)
        file = self.files[number]
        file[1] += n
        if at > file[3]:
            file[2:] = [tokens, at]
        if path.count("/") > file[0].count("/"):  # it goes to the end of the order under its new name
            old = file[0]
            del self.files[number], self.named[old]
            for e in self._ends(old):
                self.ending[e].remove(number)
            self._put(path, [path, *file[1:]])

    def _put(self, path: str, file: list) -> None:
        number, self.next = self.next, self.next + 1
        self.files[number], self.named[path] = file, number
        for e in self._ends(path):
            self.ending.setdefault(e, []).append(number)

    def rows(self, key) -> list[tuple]:
        return [(key, f[0], f[1], f[2]) for f in self.files.values()]
