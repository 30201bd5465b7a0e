"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Every benchmark item gives windows of ``n`` consecutive words (an item of fewer words, but not
none, is one window). Tasks hash them; the distinct ones come to the driver as one Arrow table of
plain buffers and are broadcast. Tasks roll over each document's words, look
every window up, verify each hit byte by byte and merge the hits into spans. The broadcast is
bounded: a benchmark of more than ``max_windows`` windows (about 150 bytes each) is scanned in several sets of at most
about that size, one after another, and the spans of all scans are merged, so the result does not depend on the bound.

Defined cases: null or empty texts have no words (never hit, no item); repeated documents each
get their row, and rows of one doc_id and different texts are told apart; an item that is repeated
counts once by its id; items without an id hit words as others do, count as one item together
and add no name to the list; an empty benchmark or table gives no hits or rows; a very long text
is scanned whole, in memory in proportion to it; other columns are ignored, and kept by
remove_contamination, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buffers as B
from .tables import read, set_apart, settled
from .workers import release

WINDOW = 10
MAX_WINDOWS = 500_000
SCAN = "doc_id long, row_key long, n_words long, spans array<long>, items array<string>"


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """The distinct windows of a benchmark: words, hash, lens (of the words, 32 bits each), body (the words' bytes) and items."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in B.slices(batch.column(1)):
                words = B.Words(B.LOWER[data], offsets, B.ALNUM)
                body, at = words.compact()
                hashes, sizes = B.hash_runs(body, at), np.diff(at).astype("<i4")
                for k in range(1, n + 1):
                    found = B.window_hashes(hashes, k)
                    last = words.first[1:] - k
                    rows = np.flatnonzero((words.counts == k) | ((k == n) & (words.counts > n)))
                    first = B.ragged(words.first[rows], last[rows] - words.first[rows] + 1)
                    if not len(first):
                        continue
                    item = batch.column(0).slice(lo, hi - lo).take(pa.array(words.row[first]))
                    lens, bodies = ([x.tobytes() for x in parts] for parts in ((sizes[i : i + k] for i in first), (body[at[i] : at[i + k]] for i in first)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), k, np.int32)), pa.array(found[first].view(np.int64)), pa.array(lens, pa.binary()), pa.array(bodies, pa.binary()), item], ["words", "hash", "lens", "body", "item"])

    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    found = items.mapInArrow(windows, "words int, hash long, lens binary, body binary, item string").distinct()
    return found.groupBy("words", "hash", "lens", "body").agg(F.collect_list(F.struct("item")).alias("items"))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column and the offsets of its rows."""
    (_, _, data, offsets), = B.slices(column.combine_chunks(), 1 << 40)
    return data.copy(), offsets


class WindowSet:
    """Windows by number of words: sorted hashes with the words' bytes, lengths and items of each."""

    def __init__(self, windows: pa.Table):
        self.by_length = {}
        for k in sorted(set(windows.column("words").to_pylist())):
            own = windows.filter(pc.equal(windows.column("words"), k))
            own = own.take(pa.array(np.argsort(own.column("hash").to_numpy().view(np.uint64), kind="stable"))).combine_chunks()
            body, at = _flat(own.column("body"))
            lens, _ = _flat(own.column("lens"))
            self.by_length[k] = (own.column("hash").to_numpy().view(np.uint64), body, at[:-1], lens.view("<i4").reshape(-1, k).astype(np.int64), own.column("items"))

    def hits(self, words: B.Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
        """(words of a window, index of first words, index of windows, items by window), verified."""
        body, at = words.compact()
        hashes = B.hash_runs(body, at)
        for k, (known, known_body, known_at, known_lens, items) in self.by_length.items():
            found = B.window_hashes(hashes, k)
            if not len(found):
                continue
            place = np.searchsorted(known, found)
            place[place == len(known)] = 0
            first = np.flatnonzero((known[place] == found) & (words.row[: len(found)] == words.row[k - 1 :]))
            which = place[first]
            # equal hashes are rare but possible: try each window of that hash
            while len(first):
                lens = at[first + k] - at[first]
                same = (np.stack([at[first + j + 1] - at[first + j] for j in range(k)], 1) == known_lens[which]).all(1)
                ok = np.flatnonzero(same)
                size = lens[ok]
                equal = body[B.ragged(at[first[ok]], size)] == known_body[B.ragged(known_at[which[ok]], size)]
                good = np.ones(len(ok), bool)
                if len(ok):
                    good = np.logical_and.reduceat(equal, np.concatenate([[0], np.cumsum(size)[:-1]]))
                yield k, first[ok[good]], which[ok[good]], items
                again = (which + 1 < len(known)) & (known[np.minimum(which + 1, len(known) - 1)] == known[which])
                first, which = first[again], which[again] + 1


def _scan(documents: DataFrame, windows) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known: WindowSet = windows.value
        for batch in batches:
            for lo, hi, data, offsets in B.slices(batch.column(2)):
                words = B.Words(B.LOWER[data], offsets, B.ALNUM)
                depth = np.zeros(len(words.start) + 1, np.int64)
                pairs = []
                for k, first, which, items in known.hits(words):
                    np.add.at(depth, first, 1)
                    np.add.at(depth, first + k, -1)
                    seen = np.unique(np.stack([words.row[first], which], 1), axis=0)
                    named = items.take(pa.array(seen[:, 1])).to_pylist()
                    pairs += [(r, [x["item"] for x in own]) for r, own in zip(seen[:, 0].tolist(), named, strict=True)]
                hit = np.cumsum(depth)[:-1] > 0
                rows = hi - lo
                by_row: dict[int, set] = {}
                for r, items in pairs:
                    by_row.setdefault(r, set()).update(items)
                spans: list[list[int]] = [[] for _ in range(rows)]
                if hit.any():
                    begins = hit & ~(np.concatenate([[False], hit[:-1]]) & (words.row == np.concatenate([[-1], words.row[:-1]])))
                    ends = hit & ~(np.concatenate([hit[1:], [False]]) & (words.row == np.concatenate([words.row[1:], [-1]])))
                    for a, b in zip(np.flatnonzero(begins).tolist(), np.flatnonzero(ends).tolist(), strict=True):
                        r = words.row[a]
                        spans[r] += [a - int(words.first[r]), b + 1 - int(words.first[r])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, rows), batch.column(1).slice(lo, rows), pa.array(words.counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(by_row.get(r, ()), key=lambda x: (x is None, x)) for r in range(rows)], pa.list_(pa.string()))],
                    ["doc_id", "row_key", "n_words", "spans", "items"],
                )

    return documents.mapInArrow(scan, SCAN)


def _merged(spans: np.ndarray) -> list[int]:
    out: list[int] = []
    for a, b in sorted(zip(spans[0::2], spans[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def find_contamination(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, row_key, n_words, spans (word positions from, to, ...) and items (sorted ids as strings) of each document.

    row_key tells repeated doc_ids apart only where several scans are needed; it is null else.
    """
    spark = documents.sparkSession
    windows = settled(benchmark_windows(benchmark, n))
    n_sets = max(1, -(-windows.count() // max_windows))
    docs = documents.select(F.col("doc_id").cast("long"), (F.xxhash64(F.col("text").cast("string")) if n_sets > 1 else F.lit(None)).cast("long").alias("row_key"), F.col("text").cast("string"))
    if n_sets == 1:
        return _scan(docs, spark.sparkContext.broadcast(WindowSet(windows.toArrow())))
    scans = []
    for i in range(n_sets):
        known = spark.sparkContext.broadcast(WindowSet(windows.where(F.pmod(F.xxhash64("body", "lens"), F.lit(n_sets)) == i).toArrow()))
        found = _scan(docs, known)
        scans.append(settled(found if i == 0 else found.where(F.size("items") > 0)))
        known.destroy()
    return _merge_scans(scans)


def _merge_scans(scans: list[DataFrame]) -> DataFrame:
    """Spans and items of one document from several scans, as one row for each repeated row."""
    tagged = scans[0].withColumn("part", F.lit(0))
    for i, s in enumerate(scans[1:], 1):
        tagged = tagged.unionByName(s.withColumn("part", F.lit(i)))
    grouped = tagged.groupBy("doc_id", "row_key").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.count_if(F.col("part") == 0).alias("copies"))
    merge = F.udf(_merged, "array<long>")
    return grouped.select("doc_id", "row_key", "n_words", merge("spans").alias("spans"), "items", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def remove_contamination(documents: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """documents without contaminated rows (``documents``), or with the hit words cut out (``spans``).

    With one window set the scan runs inside the same pass as the cut, so text is not shuffled.
    With more, the merged spans of hit rows meet the texts under doc_id and row_key.
    """
    spark = documents.sparkSession
    windows = settled(benchmark_windows(benchmark, n))
    columns, at = documents.columns, documents.columns.index("text")
    if windows.count() > max_windows:
        found = find_contamination(documents, benchmark, n, max_windows).where(F.size("items") > 0).dropDuplicates(["doc_id", "row_key"])
        hit = found.select(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_row"), F.col("spans").alias("_spans"))
        numbered, own, names = set_apart(documents)
        same = own["doc_id"].cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64(own["text"].cast("string")) == F.col("_row"))
        if mode == "documents":
            return numbered.join(hit, same, "left_anti").select(*names)
        rows = numbered.join(hit, same, "left").select(*own.values(), "_spans")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, data, offsets in B.slices(batch.column(at)):
                    words = B.Words(B.LOWER[data], offsets, B.ALNUM)
                    depth = np.zeros(len(words.start) + 1, np.int64)
                    own = batch.slice(lo, hi - lo)
                    for first, spans in zip(words.first, own.column(len(columns)).to_pylist(), strict=False):
                        np.add.at(depth, first + np.array(spans[::2] if spans else [], np.int64), 1)
                        np.add.at(depth, first + np.array(spans[1::2] if spans else [], np.int64), -1)
                    texts = own.select(range(len(columns))).rename_columns(columns)
                    yield _without(texts, at, data, offsets, words, np.cumsum(depth)[:-1] > 0)

        return rows.mapInArrow(cut, documents.schema)
    known = spark.sparkContext.broadcast(WindowSet(windows.toArrow()))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for lo, hi, data, offsets in B.slices(batch.column(at)):
                words = B.Words(B.LOWER[data], offsets, B.ALNUM)
                depth = np.zeros(len(words.start) + 1, np.int64)
                for k, first, _, _ in known.value.hits(words):
                    np.add.at(depth, first, 1)
                    np.add.at(depth, first + k, -1)
                hit = np.cumsum(depth)[:-1] > 0
                own = batch.slice(lo, hi - lo)
                if mode == "documents":
                    yield own.filter(pa.array(B.row_sums(hit, words.first) == 0))
                else:
                    yield _without(own, at, data, offsets, words, hit)

    return documents.mapInArrow(clean, documents.schema)


def _without(own: pa.RecordBatch, at: int, data: np.ndarray, offsets: np.ndarray, words: B.Words, hit: np.ndarray) -> pa.RecordBatch:
    """own with the hit words cut out of its texts, which are in data."""
    bad = B.row_sums(hit, words.first) > 0
    if not bad.any():
        return own
    keep = np.ones(len(data), bool)
    keep[B.ragged(words.start[hit], (words.end - words.start)[hit])] = False
    text = [None if t is None else data[a:b][keep[a:b]].tobytes().decode() if x else t for t, a, b, x in zip(own.column(at).to_pylist(), offsets[:-1], offsets[1:], bad, strict=True)]
    return own.set_column(at, "text", pa.array(text, own.schema.field(at).type))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    signed = F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    n_hit = F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP1_SQL = f"""
WITH dw AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_PATTERN}') AS w FROM documents),
bw AS MATERIALIZED (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_PATTERN}') AS w FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
grams AS MATERIALIZED (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
hits AS MATERIALIZED (SELECT DISTINCT g.doc_id, g.i, g.k, item_id FROM grams g JOIN win USING (k, gram)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
