"""Token counts that follow edits.

Each document keeps a segment tree over its text: leaves are stretches of about ``LEAF`` bytes cut
where a word begins after white space (there the tokenizer never joins), inner nodes are sums of
two nodes below. An edit re-encodes only the leaves it touches, and one more on a side where it
meets that leaf's edge, as the joined word could reach over; then the sums above are updated. The
count of an edited text is the root, equal to a count of the whole new text.

A row carries text and tree, so edits need no join and rows are independent: no key is hot.

Defined cases: a null text is empty and its tree is one leaf of 0; an edit's place and length are
clipped to the text and moved to character starts; a row without edits stays as it is; several
edits of a row apply in order, each to the text as the one before left it; repeated rows are each
counted; an empty table gives an empty result; columns other than doc_id, text and edits are
ignored. A stretch without white space is one leaf whatever its length, and an edit in it encodes
all of it again; an edit that changes the number of leaves builds the inner sums anew (one
addition a leaf), so its cost beyond the leaves it touches is linear in the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buffers as B
from .tables import read
from .tokens import WORD_BPE, WordEncoder, encoder

LEAF = 512
_SPACE = frozenset(b" \t\n\v\f\r")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_BPE)


def leaves(words: WordEncoder, data: np.ndarray, offsets: np.ndarray, leaf: int = LEAF) -> tuple[list[list[int]], list[list[int]]]:
    """For each row the end of each leaf in bytes, and its tokens. White space belongs to the leaf after it."""
    _, size, units = words.encode_units(data, offsets)
    begins = np.ones(len(units.start), bool)  # words after white space or at a row's start may begin a leaf
    begins[1:] = units.start[1:] != units.end[:-1]
    begins[units.first[:-1][np.diff(units.first) > 0]] = True
    inside = (units.start - offsets[np.searchsorted(offsets, units.start, "right") - 1]) // leaf
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(units.first))
    head = np.flatnonzero(begins)
    if len(head):
        new = np.ones(len(head), bool)
        new[1:] = (inside[head][1:] != inside[head][:-1]) | (row[head][1:] != row[head][:-1])
        head = head[new]
        sums = np.add.reduceat(size, head)
        rows = row[head]
        last = np.ones(len(head), bool)
        last[:-1] = rows[1:] != rows[:-1]
        end = np.where(last, offsets[rows + 1], units.end[np.concatenate([head[1:], [1]]) - 1]) - offsets[rows]
        first = np.searchsorted(rows, np.arange(len(offsets)))
    else:
        sums = end = np.zeros(0, np.int64)
        first = np.zeros(len(offsets), np.int64)
    ends, counts = [], []
    for r in range(len(offsets) - 1):
        a, b = first[r], first[r + 1]
        ends.append(end[a:b].tolist() or [int(offsets[r + 1] - offsets[r])])
        counts.append(sums[a:b].tolist() or [0])
    return ends, counts


def levels(counts: list[int]) -> list[list[int]]:
    """The sums of a segment tree, from the leaves to the root."""
    out = [list(counts)]
    while len(out[-1]) > 1:
        low = out[-1]
        out.append([low[i] + (low[i + 1] if i + 1 < len(low) else 0) for i in range(0, len(low), 2)])
    return out


def updated(tree: list[list[int]], at: int, counts: list[int]) -> list[list[int]]:
    """The tree with some leaves from at replaced by as many; only sums above them are added again."""
    tree[0][at : at + len(counts)] = counts
    lo, hi = at, at + len(counts) - 1
    for k in range(1, len(tree)):
        lo, hi = lo // 2, hi // 2
        low = tree[k - 1]
        for i in range(lo, hi + 1):
            tree[k][i] = low[2 * i] + (low[2 * i + 1] if 2 * i + 1 < len(low) else 0)
    return tree


def apply_edit(words: WordEncoder, text: bytes, ends: list[int], tree: list[list[int]], at: int, delete: int, insert: bytes, leaf: int = LEAF) -> tuple[bytes, list[int], list[list[int]], int]:
    """(text, leaf ends, tree, bytes encoded again) after one edit at a byte place."""
    at = min(max(at, 0), len(text))
    while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
        at -= 1
    stop = min(at + max(delete, 0), len(text))
    while stop < len(text) and text[stop] & 0xC0 == 0x80:
        stop += 1
    places = np.array(ends)
    first = int(np.searchsorted(places, at, "right"))
    last = int(np.searchsorted(places, stop, "left"))
    first, last = min(first, len(ends) - 1), min(max(last, first), len(ends) - 1)
    begin = ends[first - 1] if first else 0
    if first and at <= begin + 1:  # the edit meets the leaf's white space: its word may join the one before
        first -= 1
        begin = ends[first - 1] if first else 0
    if last + 1 < len(ends) and stop >= ends[last]:
        last += 1
    end = ends[last]
    region = text[begin:at] + insert + text[stop:end]
    new_ends, new_counts = leaves(words, np.frombuffer(region, np.uint8), np.array([0, len(region)]), leaf)
    shift = len(insert) - (stop - at)
    fresh = [begin + e for e in new_ends[0]]
    tail = [e + shift for e in ends[last + 1 :]]
    if len(fresh) == last + 1 - first:
        tree = updated(tree, first, new_counts[0])
    else:
        tree = levels(tree[0][:first] + new_counts[0] + tree[0][last + 1 :])
    return text[:at] + insert + text[stop:], ends[:first] + fresh + tail, tree, len(region)


TREE = "leaf_ends array<int>, tree array<array<int>>"


def build_trees(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """documents with leaf_ends and tree, whose last level is the number of tokens."""
    path = tokenizer or tokenizer_path()
    at = documents.columns.index("text")
    rest = [c for c in documents.columns if c not in ("leaf_ends", "tree")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            for lo, hi, data, offsets in B.slices(batch.column(at)):
                ends, counts = leaves(words, data, offsets)
                trees = [levels(c) for c in counts]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(ends, pa.list_(pa.int32())), pa.array(trees, pa.list_(pa.list_(pa.int32())))], [*rest, "leaf_ends", "tree"])

    documents = documents.select(*rest)
    return documents.mapInArrow(build, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema) + ", " + TREE)


def apply_edits(trees: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """trees (with edits array<struct<at, remove, insert>>, places in bytes) after its edits, and n_bytes_encoded."""
    path = tokenizer or tokenizer_path()
    names = [c for c in trees.columns if c != "n_bytes_encoded"]
    trees = trees.select(*names)
    place = {c: names.index(c) for c in ("text", "leaf_ends", "tree", "edits")}

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                cols = {c: part.column(i).to_pylist() for c, i in place.items()}
                again = []
                for r, edits in enumerate(cols["edits"]):
                    n = 0
                    if edits:
                        text, ends, tree = (cols["text"][r] or "").encode(), cols["leaf_ends"][r], cols["tree"][r]
                        for e in edits:
                            text, ends, tree, k = apply_edit(words, text, ends, tree, e["at"], e["remove"], (e["insert"] or "").encode())
                            n += k
                        cols["text"][r], cols["leaf_ends"][r], cols["tree"][r] = text.decode(), ends, tree
                    again.append(n)
                out = list(part.columns)
                for c in ("text", "leaf_ends", "tree"):
                    out[place[c]] = pa.array(cols[c], part.schema.field(place[c]).type)
                yield pa.RecordBatch.from_arrays([*out, pa.array(again, pa.int64())], [*names, "n_bytes_encoded"])

    return trees.mapInArrow(edit, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trees.schema) + ", n_bytes_encoded long")


def derived_edits(documents: DataFrame) -> DataFrame:
    """The tables hold no edits: each text gets two, at places that follow from its doc_id."""
    n = F.octet_length(F.coalesce("text", F.lit("")))
    mark = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    one = F.struct(F.pmod(mark, n + 1).cast("int").alias("at"), (mark % 40).cast("int").alias("remove"), F.concat(F.lit(" revised "), F.col("doc_id").cast("string")).alias("insert"))
    two = F.struct(F.pmod(mark * 7 + 3, n + 1).cast("int").alias("at"), (mark % 3).cast("int").alias("remove"), F.lit("x").alias("insert"))
    return documents.withColumn("edits", F.array(one, two))


def root(tree: str):
    return F.get(F.get(F.col(tree), F.size(tree) - 1), F.lit(0)).cast("long")


def op7_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = derived_edits(read(spark, sf_dir, "documents").select("doc_id", "text"))
    trees = build_trees(documents).withColumn("n_before", root("tree")).withColumn("n_leaves", F.size("leaf_ends").cast("long"))
    return apply_edits(trees).select("doc_id", "n_before", root("tree").alias("n_tokens"), "n_leaves", "n_bytes_encoded", F.octet_length("text").cast("long").alias("n_bytes"))
