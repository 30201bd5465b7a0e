"""Quality rules by host: a host whose documents often fail the base rules is dropped whole.

Each text is measured once. Failures are summed by host (map-side first, so a host with a third
of all rows is no hot key), the rates are shrunk with a beta prior fitted to all hosts by
moments, and each host's verdict is joined back to its documents. The verdict table has a row a
host; Spark picks a broadcast by its measured size, else a join whose skewed side it splits.

Defined cases: null and empty texts have no words and fail; a null host is a host of its own
only for counting and never condemns its documents; repeated rows count each; a rate on the limit
is kept; a very long text is measured whole, in memory in proportion to it; an empty table
gives an empty result; columns other than doc_id, text and the host are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buffers as B
from .tables import read, settled

MIN_WORDS, MAX_REPEAT_PERCENT, MAX_HOST_RATE = 50, 50, 0.5
_SYMBOL = B.byte_class(b"#*$%&|<>")
_BASE = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _surplus(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each (row, hash) occurs again, and whether it occurred before."""
    with np.errstate(over="ignore"):
        keys = B.mixed(hashes ^ B.mixed(row.astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[:-1][same]] = again[order[1:][same]] = True
    before[order[1:][same]] = True
    return again, before


def measure(documents: DataFrame, host: str = "source") -> DataFrame:
    """The base figures of every whole text."""

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in B.slices(batch.column(2)):
                words = B.Words(data, offsets, B.NOT_SPACE)
                hashes = words.hashes()
                heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                chars = B.row_sums(heads[words.end] - heads[words.start], words.first)
                symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
                # lines: cut after every newline and at every row
                cuts = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets]))
                line_row = np.searchsorted(offsets, cuts[:-1], "right") - 1
                stop = cuts[1:] - (data[cuts[1:] - 1] == 10) if len(cuts) > 1 else cuts[1:]
                has_word = np.searchsorted(words.start, cuts[1:]) > np.searchsorted(words.start, cuts[:-1])
                bare = data != 10
                line_hash = B.hash_runs(data[bare], np.concatenate([[0], np.cumsum(stop - cuts[:-1])]))
                _, dup = _surplus(line_row[has_word], line_hash[has_word])
                dup_lines = np.bincount(line_row[has_word][dup], minlength=hi - lo)
                trios = B.window_hashes(hashes, 3)
                inside = np.flatnonzero(words.row[: len(trios)] == words.row[2:]) if len(trios) else np.zeros(0, np.int64)
                again, _ = _surplus(words.row[inside], trios[inside])
                covered = np.zeros(len(words.start), bool)
                for j in range(3):
                    covered[inside[again] + j] = True
                cols = [words.counts, chars, symbols[offsets[1:]] - symbols[offsets[:-1]], dup_lines, B.row_sums(covered, words.first)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *(pa.array(c, pa.int64()) for c in cols)], [x.split()[0] for x in _BASE.split(", ")])

    return documents.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.col("text").cast("string")).mapInArrow(figures, _BASE)


def host_verdicts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, n, failed, shrunk rate and host_kept, from rows of host and base_failed.

    With mean rate m and variance v over hosts, the beta prior has the strength m(1-m)/v - 1,
    held between 2 and 10,000.
    """
    by_host = measured.groupBy("host").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failed"))
    rate = F.col("failed") / F.col("n")
    m, v = by_host.where("host is not null").agg(F.avg(rate), F.var_pop(rate)).first()
    m = 0.0 if m is None else m
    strength = min(1e4, max(2.0, m * (1 - m) / v - 1)) if v else 1e4
    shrunk = (F.col("failed") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
    return by_host.withColumn("rate", shrunk).withColumn("host_kept", F.col("host").isNull() | (F.col("rate") <= max_rate))


def with_verdicts(documents: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    measured = settled(measure(documents, host).withColumn("base_failed", failed))
    verdicts = host_verdicts(measured, max_rate).select(F.col("host").alias("_host"), "rate", "host_kept")
    joined = measured.join(verdicts, F.col("host") == F.col("_host"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).drop("_host")


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_verdicts(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WORD = r"[^\x20\x09-\x0D]+"
OP3_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '{_WORD}') GROUP BY 1),
g AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS gram
                   FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
twice AS (SELECT doc_id, gram FROM g GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM g JOIN twice USING (doc_id, gram)) GROUP BY 1),
m AS MATERIALIZED (
  SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b WHERE source IS NOT NULL GROUP BY 1),
p AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM h),
s AS (SELECT m, CASE WHEN v > 0 THEN least(1e4, greatest(2.0, m * (1 - m) / v - 1)) ELSE 1e4 END AS k FROM p),
verdict AS (SELECT source, (f + m * k) / (n + k) <= {MAX_HOST_RATE} AS ok FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, true) AS kept
FROM b LEFT JOIN verdict USING (source)
"""
