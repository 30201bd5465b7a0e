"""Token ids as Re-Pair compressed shards.

Documents are dealt by ranges of doc_id and sorted in each, tokenized, and cut into blocks of
about ``BLOCK_IDS`` ids that end with a document. In each block frequent pairs of ids are
replaced by new symbols, round after round (each round replaces the most frequent pairs found by
an exact count, left to right without overlap). No rule spans two documents, so every document is
a run of symbols and can be decoded alone from the block's rules and expansion lengths.

A block is a row of a Parquet table: part and block (which order the blocks), the doc_ids, and a
binary payload of little-endian arrays:

    magic "WRP1", number of documents, rules and symbols (uint32 each)
    left and right symbol of each rule (uint16; symbols from FIRST_RULE on are rules)
    length of each rule's expansion (uint32)
    first symbol of each document and the end (uint32)
    the symbols (uint16)

Spark's committer writes the table, so a lost executor leaves no partial block.

Defined cases: null and empty texts are documents of only the end id; ties of doc_id are ordered
by a hash of the text; a null doc_id sorts first; an empty table writes no block; a very long text
is encoded whole and may make a block longer than ``BLOCK_IDS``; columns other than doc_id and text
are ignored. Symbols have 16 bits, so a block has room for 16,128 rules; Re-Pair ends there, or
after ``ROUNDS`` rounds, and is lossless wherever it ends.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import buffers as B
from .tables import read, shared_dir
from .tokens import WORD_BPE, encoder

END_ID, FIRST_RULE = 1, 49408
BLOCK_IDS = 1 << 20
ROUNDS, RULES_A_ROUND, LEAST = 4, 4000, 4


def compress(ids: np.ndarray, rounds: int = ROUNDS, per_round: int = RULES_A_ROUND, least: int = LEAST, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules[n, 2]) of uint16 ids; no rule begins with the end id."""
    seq, rules = ids.astype(np.uint16), np.zeros((0, 2), np.uint16)
    room = 65536 - FIRST_RULE
    for _ in range(rounds):
        if len(seq) < 2 or room <= 0:
            break
        code = seq[:-1].astype(np.uint32) << 16 | seq[1:]
        order = np.sort(code)
        cuts = np.flatnonzero(order[1:] != order[:-1]) + 1
        count = np.diff(cuts, prepend=0, append=len(order))
        pairs = order[np.concatenate([[0], cuts])]
        good = np.flatnonzero(count >= least)
        good = good[(pairs[good] >> 16 != end_id) & (pairs[good] & 0xFFFF != end_id)]
        good = good[np.argsort(-count[good], kind="stable")][: min(per_round, room)]
        if not len(good):
            break
        chosen = pairs[good][::-1]
        # a small table finds chosen pairs; of two in one slot the more frequent stays, the other waits for the next round
        slot = np.full(1 << 18, -1, np.int32)
        slot[chosen * np.uint32(2654435761) >> 14] = np.arange(len(chosen), dtype=np.int32)
        place = slot[code * np.uint32(2654435761) >> 14]
        at = np.flatnonzero(place >= 0)
        place = place[at]
        hit = chosen[place] == code[at]
        at, place = at[hit], place[hit]
        # of pairs that overlap in a row, the first, third, ... are taken
        head = np.concatenate([[True], np.diff(at) != 1]) if len(at) else np.zeros(0, bool)
        nth = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
        at, place = at[nth % 2 == 0], place[nth % 2 == 0]
        seen = np.bincount(place, minlength=len(chosen)) > 0
        used, number = np.flatnonzero(seen), np.cumsum(seen) - 1
        seq[at] = FIRST_RULE + len(rules) + number[place]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        rules = np.concatenate([rules, np.stack([chosen[used] >> 16, chosen[used] & 0xFFFF], 1).astype(np.uint16)])
        room -= len(used)
    return seq, rules


def expansions(rules: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, start, length) of the expansion of each symbol: terminals stand for themselves."""
    start = np.arange(FIRST_RULE + len(rules), dtype=np.int64)
    size = np.zeros(FIRST_RULE + len(rules), np.int64)
    size[:FIRST_RULE] = 1
    flat, sides = np.arange(FIRST_RULE, dtype=np.uint16), rules.astype(np.int64).reshape(-1, 2)
    while True:  # a round for each level of rules
        ready = np.flatnonzero((size[FIRST_RULE:] == 0) & (size[sides] > 0).all(1))
        if not len(ready):
            return flat, start, size
        both = sides[ready].ravel()
        own = size[both].reshape(-1, 2).sum(1)
        start[FIRST_RULE + ready] = len(flat) + np.cumsum(own) - own
        flat = np.concatenate([flat, flat[B.ragged(start[both], size[both])]])
        size[FIRST_RULE + ready] = own


def pack(ids: np.ndarray, lens: np.ndarray) -> bytes:
    """The payload of documents of lens ids each, every one with its end id."""
    seq, rules = compress(ids)
    _, _, size = expansions(rules)
    first = np.concatenate([[0], np.searchsorted(np.cumsum(size[seq]), np.cumsum(lens)) + 1]).astype("<u4")
    return b"WRP1" + struct.pack("<3I", len(lens), len(rules), len(seq)) + rules.astype("<u2").tobytes() + size[FIRST_RULE:].astype("<u4").tobytes() + first.tobytes() + seq.astype("<u2").tobytes()


class Block:
    def __init__(self, payload: bytes):
        if payload[:4] != b"WRP1":
            raise ValueError("not a block of token ids")
        docs, rules, symbols = struct.unpack_from("<3I", payload, 4)
        at = 16
        self.rules = np.frombuffer(payload, "<u2", 2 * rules, at).reshape(-1, 2)
        self.lengths = np.frombuffer(payload, "<u4", rules, at + 4 * rules)
        self.first = np.frombuffer(payload, "<u4", docs + 1, at + 8 * rules)
        self.symbols = np.frombuffer(payload, "<u2", symbols, at + 8 * rules + 4 * (docs + 1))
        self.flat, self.start, self.size = expansions(self.rules)

    def ids(self, doc: int) -> np.ndarray:
        """The ids of one document; reads nothing of the others."""
        own = self.symbols[self.first[doc] : self.first[doc + 1]]
        return self.flat[B.ragged(self.start[own], self.size[own])]

    def all_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents, and their numbers."""
        size = self.size[self.symbols]
        return self.flat[B.ragged(self.start[self.symbols], size)], B.row_sums(size, self.first.astype(np.int64))


def write_shards(documents: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Writes doc_id and text of documents as a table of blocks in ascending doc_id order."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(WORD_BPE)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, docs, ids, lens, n, block = encoder(tokenizer), [], [], [], 0, 0

        def full() -> pa.RecordBatch:
            payload = pack(np.concatenate(ids), np.concatenate(lens))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([n], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([payload], pa.binary())], ["part", "block", "n_ids", "doc_ids", "payload"])

        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else 0
            for lo, hi, data, offsets in B.slices(batch.column(1)):
                own, size = words.encode(data, offsets)
                ids.append(np.insert(own, np.cumsum(size), END_ID))
                lens.append(size + 1)
                docs += batch.column(0).slice(lo, hi - lo).to_pylist()
                n += len(ids[-1])
                if n >= BLOCK_IDS:
                    yield full()
                    docs, ids, lens, n, block = [], [], [], 0, block + 1
        if n:
            yield full()

    dealt = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(F.col("doc_id").asc(), F.xxhash64("text"))
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc(), F.xxhash64("text")).withColumn("part", F.spark_partition_id())
    dealt.mapInArrow(blocks, "part int, block int, n_ids long, doc_ids array<long>, payload binary").write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document, decoded from the blocks."""
    table = spark.read.parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, lens = Block(batch.column(3)[r].as_py()).all_ids()
                raw = ids.astype("<u4")
                at = np.concatenate([[0], np.cumsum(lens)])
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                same = lambda i: pa.array([batch.column(i)[r].as_py()] * len(lens), pa.int32())
                yield pa.RecordBatch.from_arrays([same(0), same(1), pa.array(batch.column(2)[r].as_py(), pa.int64()), pa.array(at[:-1]), pa.array(lens), pa.array(crc, pa.int64())], ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = table.select("part", "block", "doc_ids", "payload").mapInArrow(decode, "part int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    # sums by part, then by block inside its part: neither window holds more than parts, or blocks of one part
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("part_start", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    starts = table.select("part", "block", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")).alias("block_start")).join(parts, "part")
    return rows.join(starts, ["part", "block"]).select("doc_id", (F.col("part_start") + F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op5_grammar_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    write_shards(read(spark, sf_dir, "documents"), path)
    return read_shards(spark, path)
