"""Fill-in-the-middle: texts cut at two unit ends and put together in another order.

A unit is white space with the word after it, or the white space that ends a text. Units are found
with no loop over them: a batch's UTF-8 is laid out in 64-bit words (each text from a word of its
own, filled up with spaces), arithmetic on whole words marks the bytes that end a unit, a population
count of each word and their running sum tell the word that holds the k-th end, and clearing the
lowest marks inside that word leaves the byte. Only two byte places a row leave Python; cutting,
putting together and hashing are Spark's own functions. No shuffle: rows are independent.

Defined cases: a null text is empty; an empty text, or one that holds a sentinel, is plain, as no
reader could tell its sentinels from the added ones; a null doc_id draws as the empty string; a text
of white space alone is one unit; repeated rows get equal results; an empty table gives an empty
result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buffers as B
from .tables import read

SEED, RATE_PERCENT, SPM_PERCENT = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
U = np.uint64
_EACH = 0x0101010101010101  # one in each byte
_HIGH = U(0x80 * _EACH)
_LOW = U(0x7F * _EACH)


def white_space(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte of the 64-bit words that is a space or from 9 to 13."""
    low, off = words & _LOW, words ^ U(0x20 * _EACH)
    space = ~(((off & _LOW) + _LOW) | off)
    control = (low + U((0x80 - 9) * _EACH)) & ~(low + U((0x80 - 14) * _EACH)) & ~words
    return (space | control) & _HIGH


class Units:
    """Marks of unit ends over rows of bytes, and a search for the k-th of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        size = np.diff(offsets)
        self.first = np.concatenate([[0], np.cumsum(size // 8 + 1)])  # at least one space ends each row's last word
        laid = np.full(8 * int(self.first[-1]), 0x20, np.uint8)
        laid[np.arange(len(data)) + np.repeat(8 * self.first[:-1] - offsets[:-1], size)] = data
        space = white_space(laid.view("<u8"))
        after = (space >> U(8)) | (np.append(space[1:], _HIGH) << U(56))
        self.ends = ~space & after & _HIGH
        last = 8 * self.first[:-1] + size - 1  # white space that ends a text is a unit
        last = last[size > 0]
        last = last[(space[last >> 3] >> (8 * (last & 7) + 7).astype(U)) & U(1) == 1]
        self.ends[last >> 3] |= U(0x80) << (8 * (last & 7)).astype(U)
        self.until = np.concatenate([[0], np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)])
        self.n = self.until[self.first[1:]] - self.until[self.first[:-1]]

    def end(self, k: np.ndarray) -> np.ndarray:
        """The byte place in each row after its first k units."""
        wanted = self.until[self.first[:-1]] + k
        word = np.maximum(np.searchsorted(self.until, wanted, "left") - 1, 0)
        left, marks = wanted - self.until[word], self.ends[word].copy()
        for _ in range(7):  # a word holds at most eight marks: drop those below the wanted one
            again = left > 1
            marks[again] &= marks[again] - U(1)
            left = left - again
        with np.errstate(over="ignore"):
            byte = np.bitwise_count((marks & (~marks + U(1))) - U(1)).astype(np.int64) >> 3
        return np.where(k == 0, 0, 8 * (word - self.first[:-1]) + byte + 1)


def middles(text: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
    """n units of each text, and the bytes where the middle starts and stops: after one % (n + 1) and other % (n + 1) units, the smaller first."""
    draws = [np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in (one, other)]
    found: list[list[np.ndarray]] = [[], [], []]
    for lo, hi, data, offsets in B.slices(text):
        units = Units(data, offsets)
        a, b = (x[lo:hi] % (units.n + 1) for x in draws)
        for column, values in zip(found, (units.n, units.end(np.minimum(a, b)), units.end(np.maximum(a, b))), strict=True):
            column.append(values)
    kinds = (pa.int64(), pa.int32(), pa.int32())
    return pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)).cast(k) for x, k in zip(found, kinds, strict=True)], ["n", "start", "stop"])


def draw(k: int, seed: int = SEED) -> Column:
    """The k-th 8-digit group of the hex SHA-256 of seed and doc_id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(documents: DataFrame, seed: int = SEED, rate: int = RATE_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of each row, and its text."""
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    middle_of = F.arrow_udf(middles, "n: long, start: int, stop: int")
    cut = rows.withColumn("cut", middle_of("text", draw(1, seed), draw(2, seed)))
    held = F.col("text") == ""
    for s in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.col("text").contains(s)
    form = F.when(held | (draw(3, seed) % 100 >= rate), "plain").when(draw(4, seed) % 100 < spm, "spm").otherwise("psm")
    data, start, stop = F.col("text").cast("binary"), F.col("cut.start"), F.col("cut.stop")
    pieces = {
        "prefix": F.substring(data, F.lit(1), start),
        "middle": F.substring(data, start + 1, stop - start),
        "suffix": F.substring(data, stop + 1, F.octet_length("text") - stop),
    }
    cut = cut.select("doc_id", "text", F.col("cut.n").alias("n"), form.alias("form"), *(v.cast("string").alias(k) for k, v in pieces.items()))
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
        .otherwise(F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
    )
    chars = [F.when(F.col("form") != "plain", F.char_length(c).cast("long")).alias(f"{c}_chars") for c in ("prefix", "middle")]
    return cut.select("doc_id", "n", "form", *chars, output.alias("output"), "text")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda *places: F.concat(*(F.get(parts, F.lit(i)) for i in places))
    return F.when(form == "plain", output).when(form == "psm", at(1, 3, 2)).otherwise(at(2, 3, 1))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


_DRAWS = ", ".join(f"(SELECT sum((instr('0123456789abcdef', x[{8 * k} + j]) - 1) * (16::BIGINT ** (8 - j))::BIGINT)::BIGINT FROM (SELECT unnest(range(1, 9)) AS j)) AS h{k + 1}" for k in range(4))
OP13_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '{UNIT}') AS u, {_DRAWS} FROM d),
f AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {RATE_PERCENT} THEN 'plain'
                  WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1 : a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 :], '') AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(p || m || s) AS restored_sha256 FROM p
"""
