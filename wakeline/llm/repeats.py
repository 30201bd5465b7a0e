"""Removal of long repeated byte strings with run-compressed Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes over it also starts anywhere else. Repeats of
``PASSAGE`` to LENGTH bytes, passages of some fifty words, are too short to be cut: ``n_passage``
counts the bytes under any string of PASSAGE bytes that also starts anywhere else.

1. Every window of PASSAGE bytes has an anchor: the leftmost of its smallest K-byte strings by
   hash. Equal windows have equal anchors at equal offsets. The consecutive windows of one
   anchor form a segment, so a text is cut where its content says, alike in every copy. The body
   of a segment are its windows, each grown to LENGTH bytes or to the text's end. Equal neighbours
   (a run of one letter or phrase, but for its last LENGTH bytes) are one row with their number.
2. Anchors that occur once over all texts (one map-side combined count) have no repeated window.
   Copies of one segment collapse into one entry with its multiplicity, as in a run: all of a
   segment with two copies is repeated, however many more there are.
3. Different segments of one anchor are indexed together: a run-length compressed BWT is built
   over the block, with suffix positions sampled only at the run ends. The longest match of a
   position with its neighbour in suffix order shrinks by one with each step to the right inside
   a run, so the matches at the run ends give all of them: streaming over the sampled ends marks
   exactly the positions whose matching statistic reaches PASSAGE or LENGTH. Only suffixes at a
   segment's own windows are in the index, so no place of a text is there twice.
4. An anchor with over ``block`` different segments is not held by one task: its windows of both
   lengths are counted by hash over all tasks instead, which marks the same bytes.
5. The marked spans go back to all copies, and are cut from the texts.

Requests for bytes and the marked spans meet the texts in joins on doc_id and a hash of the text.
Before each, a sketch of the wanted keys (a bit for each of ``sketches.BITS`` hash values, whatever the size
of the corpus) lets the tasks that read the texts pass on only what may be wanted: texts without a
repeated string aren't shuffled. A full sketch passes everything and changes no result.

Anchors are told apart by 64-bit hashes of their strings, segments by 128 bits (their own and
their anchor's); matches inside an index are compared byte by byte, the windows of a counted anchor by 64-bit hashes.

Defined cases: null texts are empty (0 bytes, hash of nothing); texts under LENGTH bytes
keep all, and those under PASSAGE bytes hold no window; repeated rows are copies of each
other and lose everything from LENGTH bytes on; rows of one doc_id and different texts are
different documents; matches never cross documents; a null doc_id is
an id like any other; a very long text is scanned whole, in memory in proportion to it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buffers as B
from .sketches import in_sketch, sketch
from .tables import read, settled
from .workers import release

LENGTH, K, PASSAGE = 400, 64, 256
BLOCK = 20_000  # different segments of one anchor in one index
INDEX_BYTES = 3 << 20
_BASE = B.U(0x9FB21C651E98DF25 | 1)
_INVERSE = B.U(pow(int(_BASE), -1, 1 << 64))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(B.BYTE_HASH[data] * _steps(_BASE, len(data)), out=out[1:])
    return out


_step: dict[int, np.ndarray] = {}


def _steps(base: np.uint64, n: int) -> np.ndarray:
    known = _step.get(int(base))
    if known is None or len(known) < n:
        p = np.full(max(n, 1 << 18), base, np.uint64)
        p[0] = 1
        known = np.multiply.accumulate(p)
        if n <= 1 << 23:
            _step[int(base)] = known
    return known[:n]


def substring_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    back = _steps(_INVERSE, len(prefix))
    return B.mixed((prefix[end] - prefix[start]) * back[start] + (end - start).astype(np.uint64))


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """For each i the place of the leftmost smallest of values[i:i + w]; values have 32 bits."""
    n = len(values)
    whole = -(-n // w) * w
    keyed = np.full(whole, np.iinfo(np.uint64).max, np.uint64)
    keyed[:n] = values << B.U(32) | np.arange(n, dtype=np.uint64)
    blocks = keyed.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    return (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & B.U(0xFFFFFFFF)).astype(np.int64)


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K, passage: int = PASSAGE) -> tuple[np.ndarray, ...]:
    """(row, start in row, windows, bytes of the body, equal neighbours, anchor hash, segment hash) of every segment."""
    lens = np.maximum(np.diff(offsets) - passage + 1, 0)
    if not lens.any():
        return (np.zeros(0, np.int64),) * 7
    prefix = prefix_hash(data)
    at = np.arange(len(data) - k + 1)
    grams = B.mixed((prefix[k:] - prefix[:-k]) * _steps(_INVERSE, len(prefix))[: len(at)])
    anchor = sliding_argmin(grams >> B.U(32), passage - k + 1)
    start = B.ragged(offsets[:-1], lens)
    row = np.repeat(np.arange(len(lens)), lens)
    own = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.concatenate([head, [len(start)]]))
    begin, row, own = start[head], row[head], own[head]
    end = np.minimum(begin + size - 1 + length, offsets[row + 1])
    with np.errstate(over="ignore"):
        body = substring_hash(prefix, begin, end) ^ B.mixed((own - begin).astype(np.uint64) << B.U(32) | size.astype(np.uint64))
    body, grams = B.mixed(body).view(np.int64), grams[own].view(np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (body[1:] != body[:-1]) | (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    equal = np.diff(np.concatenate([head, [len(row)]]))
    return row[head], (begin - offsets[row])[head], size[head], (end - begin)[head], equal, grams[head], body[head]


def _matches(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many bytes from a and b on are equal by their hashes; at least low are, at most high are looked at."""
    while (low < high).any():
        mid = (low + high + 1) // 2
        ok = substring_hash(prefix, a, a + mid) == substring_hash(prefix, b, b + mid)
        low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
    return low


def suffix_order(symbols: np.ndarray, left: np.ndarray, prefix: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The suffixes at ``at`` (ascending) by group and then in order; left: symbols before the next separator.

    Suffixes with the same first 7 symbols are parted by their match with the first of them: those
    below it by rising length of the match, those above by falling length, then by the symbol after it;
    what is still equal is parted again. Separators are 0 and differ by their place.
    """
    key, wide = np.zeros(len(at), np.uint64), np.concatenate([symbols, np.zeros(7, symbols.dtype)])
    for j in range(7):
        key = key << B.U(9) | np.where(left[at] >= j, wide[at + j], 0).astype(np.uint64)
    order = np.lexsort((key, group[at]))
    out, key = at[order], key[order]
    own = group[out]
    new = np.ones(len(out), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    todo = np.arange(len(out))
    while True:
        cell = np.cumsum(new) - 1
        more = np.bincount(cell)[cell] > 1 if len(cell) else new
        todo, new = todo[more], new[more]
        if not len(todo):
            return out
        x, cell = out[todo], np.cumsum(new) - 1
        first = x[np.flatnonzero(new)][cell]
        size = _matches(prefix, x, first, np.zeros(len(x), np.int64), np.minimum(left[x], left[first]))
        mine, other = symbols[x + size].astype(np.int64), symbols[first + size].astype(np.int64)
        side = np.sign(mine - other)  # 0: equal up to the separator
        rank = np.where(side < 0, size, np.where(side > 0, (1 << 28) - 1 - size, 0))
        key = cell << 40 | (side + 1) << 38 | rank << 10 | np.where(side == 0, 0, mine)
        by = np.argsort(key, kind="stable")
        out[todo], key, side = x[by], key[by], side[by]
        new = np.ones(len(todo), bool)
        new[1:] = (key[1:] != key[:-1]) | (side[1:] == 0)


def _compared(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """size, cut where the strings at a and b differ (only if hashes met by chance)."""
    size = size.copy()
    for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(size) >> 18)) + 1):
        if not len(part):
            continue
        differ = symbols[B.ragged(a[part], size[part])] != symbols[B.ragged(b[part], size[part])]
        if differ.any():
            first = np.cumsum(size[part]) - size[part]
            place = np.flatnonzero(differ)
            own, one = np.unique(np.searchsorted(first, place, "right") - 1, return_index=True)
            size[part[own]] = place[one] - first[own]
    return size


def repeated_spans(bodies: list[bytes], length: int = LENGTH, groups: np.ndarray | None = None, least: int | None = None, windows: np.ndarray | None = None) -> tuple[list[list[int]], list[list[int]]]:
    """For each body the spans [from, to, ...] of strings of length bytes that start elsewhere in its group too, and those of least bytes.

    With windows, the strings are those that start in the first so many bytes of each body: bodies of
    one text overlap beyond these.
    """
    least = length if least is None else least
    lens = np.array([len(b) for b in bodies], np.int64)
    ends = np.cumsum(lens + 1) - 1
    n = int(ends[-1]) + 1
    symbols = np.zeros(n, np.uint16)
    inside = np.ones(n, bool)
    inside[ends] = False
    data = np.frombuffer(b"".join(bodies), np.uint8)
    symbols[inside] = data.astype(np.uint16) + 1
    left = np.repeat(ends, lens + 1) - np.arange(n)
    body = np.repeat(np.arange(len(bodies)), lens + 1)
    own = (np.zeros(len(bodies), np.int64) if groups is None else groups)[body]
    prefix = prefix_hash(np.where(inside, symbols - 1, 0).astype(np.uint8))
    at = inside if windows is None else inside & (lens[body] - left < windows[body])
    order = suffix_order(symbols, left, prefix, np.flatnonzero(at), own)
    before = symbols[order - 1]  # the transform; the symbol before the first is the last separator
    edge = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] == 0))  # run ends: these suffixes are sampled
    edge = edge[own[order[edge]] == own[order[edge + 1]]]
    a, b = order[edge], order[edge + 1]
    long = (left[a] >= least) & (left[b] >= least)
    a, b = a[long], b[long]
    same = substring_hash(prefix, a, a + least) == substring_hash(prefix, b, b + least)
    a, b = a[same], b[same]
    low = _matches(prefix, a, b, np.full(len(a), least), np.minimum(left[a], left[b]))  # the length of each sampled match
    low = _compared(symbols, a, b, low)
    base = np.concatenate([[0], ends[:-1] + 1])

    def covered(size: int) -> list[list[int]]:
        """Spans under matches of size at least."""
        depth, long = np.zeros(n + 1, np.int64), low >= size
        for x in (a[long], b[long]):
            np.add.at(depth, x, 1)
            np.add.at(depth, x + low[long], -1)
        flips = np.diff(np.concatenate([[False], (np.cumsum(depth[:-1]) > 0) & inside, [False]]).astype(np.int8))
        begin, stop = np.flatnonzero(flips == 1), np.flatnonzero(flips == -1)
        out: list[list[int]] = [[] for _ in bodies]
        own = np.searchsorted(ends, begin)
        for s, x, y in zip(own.tolist(), (begin - base[own]).tolist(), (stop - base[own]).tolist(), strict=True):
            out[s] += [x, y]
        return out

    return covered(length), covered(least) if least < length else [[] for _ in bodies]


def _rows(documents: DataFrame) -> DataFrame:
    """doc_id, a hash that tells rows of one doc_id apart, and the whole text as bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("text"))


def _scan(documents: DataFrame, length: int, k: int, passage: int, wanted: np.ndarray | None = None) -> DataFrame:
    """The segments of all rows; with wanted (a sketch of anchors) those that may be in it."""
    shared = documents.sparkSession.sparkContext.broadcast(wanted)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for lo, hi, data, offsets in B.slices(batch.column(2)):
                found = segments(data, offsets, length, k, passage)
                if shared.value is not None:
                    may = in_sketch(shared.value, found[5])
                    found = [x[may] for x in found]
                own = batch.slice(lo, hi - lo).select([0, 1]).take(pa.array(found[0]))
                places, hashes = (pa.array(x, pa.int32()) for x in found[1:5]), (pa.array(x) for x in found[5:])
                yield pa.RecordBatch.from_arrays([*own.columns, *places, *hashes], ["doc_id", "mark", "start", "windows", "bytes", "equal", "anchor", "segment"])

    return _rows(documents).mapInArrow(scan, "doc_id long, mark long, start int, windows int, bytes int, equal int, anchor long, segment long")


def _row_sketch(rows: DataFrame) -> Broadcast:
    return rows.sparkSession.sparkContext.broadcast(sketch(F.xxhash64("doc_id", "mark"), rows))


def _rows_in(documents: DataFrame, known: Broadcast, inside: bool = True) -> DataFrame:
    """The rows that may be in a sketch of doc_id and mark, or those that are not: with their texts cut by no span."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            own = batch.filter(pa.array(in_sketch(known.value, batch.column(3).to_numpy()) == inside))
            if inside:
                yield own.select(["doc_id", "mark", "text"])
            else:
                yield from _remaining(own.column(0), own.column(2))

    rows = _rows(documents).withColumn("key", F.xxhash64("doc_id", "mark"))
    return rows.mapInArrow(keep, "doc_id long, mark long, text binary" if inside else KEPT)


def _by_row(rows: DataFrame, more: DataFrame, how: str) -> DataFrame:
    """rows with more's columns, joined on doc_id (null included) and mark; more holds a row for each at most."""
    more = more.withColumnsRenamed({"doc_id": "_doc", "mark": "_mark"})
    return rows.join(more, rows["doc_id"].eqNullSafe(more["_doc"]) & (rows["mark"] == more["_mark"]), how).drop("_doc", "_mark")


def _bodies(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """anchor, segment, copies, windows and the bytes of each wanted segment, from one row that has it."""
    rows = _rows_in(documents, _row_sketch(wanted))
    parts = wanted.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "bytes", "anchor", "segment", "copies", "windows")).alias("parts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                text, parts = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                body = [text[p["start"] : p["start"] + p["bytes"]] for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in parts], pa.int64()) for c in ("anchor", "segment", "copies", "windows")] + [pa.array(body, pa.binary())], ["anchor", "segment", "copies", "windows", "body"])

    found = _by_row(rows, parts, "inner").select("text", "parts").mapInArrow(cut, "anchor long, segment long, copies long, windows long, body binary")
    found = settled(found)
    return found if found.count() == wanted.count() else settled(found.dropDuplicates(["anchor", "segment"]))  # repeated rows of one doc_id and text


def _indexed(bodies: DataFrame, length: int, passage: int) -> DataFrame:
    """anchor, segment, repeated spans and passages; all segments of an anchor meet in one index."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(t: pa.Table) -> pa.RecordBatch:
            _, group = np.unique(t.column("anchor").to_numpy(), return_inverse=True)
            found = repeated_spans(t.column("body").to_pylist(), length, group.astype(np.int32), passage, t.column("windows").to_numpy())
            return pa.RecordBatch.from_arrays([t.column("anchor").combine_chunks(), t.column("segment").combine_chunks(), *(pa.array(x, pa.list_(pa.int32())) for x in found)], ["anchor", "segment", "spans", "passages"])

        held, size = [], 0
        for batch in batches:
            anchors = batch.column(0).to_numpy()
            for a, b in _groups(anchors):
                if held and size >= INDEX_BYTES and anchors[a] != held[-1].column(0)[-1].as_py():
                    yield spans(pa.Table.from_batches(held).combine_chunks())
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += held[-1].column(4).nbytes
        if held:
            yield spans(pa.Table.from_batches(held).combine_chunks())

    return bodies.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(index, "anchor long, segment long, spans array<int>, passages array<int>")


def _groups(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _counted(bodies: DataFrame, length: int, passage: int) -> DataFrame:
    """The same for anchors with very many segments, by counting windows of both lengths over all tasks."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                data = np.frombuffer(batch.column(4)[r].as_buffer(), np.uint8)
                prefix = prefix_hash(data)
                for size in {length, passage}:
                    at = np.arange(min(batch.column(3)[r].as_py(), len(data) - size + 1))
                    hashes = substring_hash(prefix, at, at + size)
                    same = [pa.array(np.full(len(at), x)) for x in (batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), size)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(at, pa.int32()), pa.array(hashes.view(np.int64))], ["anchor", "segment", "size", "at", "window"])

    rows = bodies.mapInArrow(windows, "anchor long, segment long, size long, at int, window long")
    twice = rows.groupBy("anchor", "size", "window").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    spans = lambda size: F.flatten(F.collect_list(F.when(F.col("size") == size, F.array(F.col("at"), F.col("at") + size))))
    return rows.join(twice, ["anchor", "size", "window"]).groupBy("anchor", "segment").agg(spans(length).alias("spans"), spans(passage).alias("passages"))


def repeated(documents: DataFrame, length: int = LENGTH, k: int = K, block: int = BLOCK, passage: int = PASSAGE) -> DataFrame:
    """doc_id, mark, repeated byte spans and passages [from, to, ...], unmerged, of the rows that have any."""
    counts = _scan(documents, length, k, passage).groupBy("anchor").agg(F.sum("equal").alias("n"), F.min("segment").alias("x"), F.max("segment").alias("y")).where("n > 1")
    again = settled(counts.select("anchor", (F.col("x") != F.col("y")).alias("various")))
    seen = settled(_scan(documents, length, k, passage, sketch(F.col("anchor"), again)).join(again, "anchor"))
    none = F.array().cast("array<int>")
    whole = F.array(F.col("start"), F.col("start") + F.col("windows") * (F.col("equal") - 1) + F.col("bytes"))
    long, short = F.when(F.col("bytes") >= length, whole).otherwise(none), F.when(F.col("bytes") < length, whole).otherwise(none)
    plain = seen.where("not various").select("doc_id", "mark", long.alias("spans"), short.alias("passages"))
    various = seen.where("various")
    one = various.groupBy("anchor", "segment").agg(F.sum("equal").alias("copies"), F.min(F.struct("doc_id", "mark", "start", "windows", "bytes")).alias("r"))
    bodies = _bodies(documents, settled(one.select("anchor", "segment", "copies", "r.*")))
    large = settled(bodies.groupBy("anchor").count().where(F.col("count") > block).select("anchor"))
    found = _indexed(bodies.join(large, "anchor", "left_anti"), length, passage)
    if not large.isEmpty():
        found = found.unionByName(_counted(bodies.join(large, "anchor"), length, passage))
    found = found.join(bodies.select("anchor", "segment", "copies"), ["anchor", "segment"], "full")
    found = settled(found.where("copies > 1 or size(spans) > 0 or size(passages) > 0"))
    shifted = lambda c: F.coalesce(F.transform(c, lambda x: x + F.col("start")), none)
    marked = lambda all_, c: F.when(F.col("copies") > 1, all_).otherwise(shifted(c)).alias(c)
    spread = various.join(found, ["anchor", "segment"]).select("doc_id", "mark", marked(long, "spans"), marked(short, "passages"))
    # a set: repeated rows of one doc_id and text have the same spans
    return plain.unionByName(spread).groupBy("doc_id", "mark").agg(*(F.flatten(F.collect_set(c)).alias(c) for c in ("spans", "passages")))


def merged_spans(spans: np.ndarray) -> np.ndarray:
    """Maximal spans [[from, to], ...] of unmerged ones; spans that touch become one."""
    pair = spans.reshape(-1, 2)
    pair = pair[np.lexsort((pair[:, 1], pair[:, 0]))]
    reach = np.maximum.accumulate(pair[:, 1])
    new = np.ones(len(pair), bool)
    new[1:] = pair[1:, 0] > reach[:-1]
    head = np.flatnonzero(new)
    return np.stack([pair[head, 0], reach[np.concatenate([head[1:] - 1, [len(pair) - 1]])]], 1)


KEPT = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, n_passage long"


def _remaining(doc_id: pa.Array, text: pa.Array, spans: pa.Array | None = None, passages: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of KEPT from whole texts, their spans and passages (none if null)."""

    def of(column: pa.Array | None, row: int) -> np.ndarray:
        own = column[row] if column is not None else None
        return own.values.to_numpy().astype(np.int64) if own is not None and own.is_valid and len(own) else np.zeros(0, np.int64)

    for lo, hi, data, offsets in B.slices(text):
        kept, removed, n_spans, n_passage = [], [], [], []
        for r in range(hi - lo):
            own = data[offsets[r] : offsets[r + 1]]
            cut = of(spans, lo + r)
            every = np.concatenate([cut, of(passages, lo + r)])
            n_passage.append(int(np.diff(merged_spans(every)).sum()) if len(every) else 0)
            if len(cut):
                pair = merged_spans(cut)
                keep = np.ones(len(own), bool)
                keep[B.ragged(pair[:, 0], pair[:, 1] - pair[:, 0])] = False
                own = own[keep]
                n_spans.append(len(pair))
            else:
                n_spans.append(0)
            kept.append(own.tobytes())
            removed.append(int(offsets[r + 1] - offsets[r]) - len(own))
        columns = [doc_id.slice(lo, hi - lo), pa.array(kept, pa.binary()), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(n_passage, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "n_passage"])


def cut_repeats(documents: DataFrame, length: int = LENGTH, k: int = K, block: int = BLOCK, passage: int = PASSAGE) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans and n_passage (bytes in repeats of PASSAGE bytes) of each row."""
    spans = settled(repeated(documents, length, k, block, min(passage, length)))
    known = _row_sketch(spans)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _remaining(*batch.columns)

    marked = _by_row(_rows_in(documents, known), spans, "left").select("doc_id", "text", "spans", "passages").mapInArrow(cut, KEPT)
    return marked.unionByName(_rows_in(documents, known, inside=False))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "n_passage", F.sha2("kept", 256).alias("kept_sha256"))
