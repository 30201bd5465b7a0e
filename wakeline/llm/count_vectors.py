"""N-gram Jaccard join with an R-tree over count vectors.

A document's set is its distinct shingles of ``SHINGLE`` words, A-Z in lower case. Two sets link when 9 times their
intersection is at least 4 times the sum of their sizes (a similarity of 0.8).

1. Each document gets the size and a 128-bit hash of its set; equal sets become one class, so
   copies cost one row. A class has the counts of its shingles over ``GROUPS`` hash groups: a
   point whose coordinate minima, summed over two points, bound their overlap from above.
2. Linked sets share one of their first size - ceil(0.8 size) + 1 shingles in any one order of all
   shingles. Classes meet under these keys. The order is by hash, but shingles that many texts of a
   draw have come last, by how many: a line of every hundredth text is a key of few classes, not of
   all that have it.
3. Every class is first compared with the smallest class under each of its keys. This joins
   large groups of near copies in linear work, wherever their rows are.
4. Under keys that still hold several components (a key of over ``block`` classes split in blocks
   that meet pairwise), the points are packed into an R-tree, whose
   self-join descends only into node pairs that the bound and the sizes allow and that are not
   wholly of one component. Surviving pairs are verified exactly and the components joined: step
   by step the most promising partner of each class, until few are new, in the end all pairs that
   still lie apart. A group of near copies so never gives all its pairs.

Texts reach a shuffle only for classes that have a candidate, and only if their ids are too many
for a broadcast of checked size.

Defined cases: null texts and texts without words have an empty set and stay alone; an empty table gives an empty result;
a very long text is hashed whole, its point has more groups; columns other than doc_id and text are ignored, and kept by one_of_each; a text of
fewer than five words has one shingle; repeated rows are one class and each keep their row; ties
go to the smallest doc_id; a null doc_id is never the name of a component that has another.
As several texts may share a doc_id or have none, texts are found again by doc_id and a hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buffers as B
from .components import components
from .sketches import in_sketch, sketch
from .tables import read, set_apart, settled
from .workers import release

SHINGLE, GROUPS, LEAF, BLOCK = 5, 256, 32, 8_000
STAR = 4_000  # classes of a key that one task brings together to find its leader
PAIRS = 16_000  # of points compared at once: 4 MB for each of their copies
LED = 1024  # pairs of one id that meet in one task
BROADCAST_ROWS = 250_000  # of a few numbers: about 30 MB
MAX_STEPS = 12
DRAWN, SEEN = 64, 4  # one of so many texts is drawn; a shingle in so many of them is frequent
FREQUENT = 250_000  # shingles that are told apart as frequent: 3 MB
CLASSES_A_TASK = 20_000  # of the small tables of pairs and links


def distinct_shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row in ascending order, and the first of each row (and the end)."""
    words = B.Words(B.LOWER[data], offsets, B.NOT_SPACE)
    hashes = words.hashes()
    full = B.window_hashes(hashes, k)
    inside = np.flatnonzero(words.row[: len(full)] == words.row[k - 1 :]) if len(full) else np.zeros(0, np.int64)
    row, value = [words.row[inside]], [full[inside]]
    for n in range(1, k):
        rows = np.flatnonzero(words.counts == n)
        if len(rows):
            row.append(rows)
            value.append(B.window_hashes(hashes, n)[words.first[rows]])
    row, value = np.concatenate(row), np.concatenate(value)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(len(offsets)))


def set_marks(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each row's set, a 128-bit hash of it."""
    with np.errstate(over="ignore"):
        return tuple(B.row_sums(B.mixed(value ^ B.U(c)).view(np.int64), first) for c in (0x243F6A8885A308D3, 0x13198A2E03707344))


def groups_of(n: int) -> int:
    """Groups for a set of n: 256, and for longer sets a power of two of at least a sixteenth of n."""
    return GROUPS if n <= 16 * GROUPS else 1 << (-(-n // 16) - 1).bit_length()


def points(value: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Counts of each row's shingles by hash group, as bytes; what is over 255 is left to slack()."""
    spread = B.mixed(value)
    n = np.diff(first)
    group = (spread % B.U(GROUPS)).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    base = np.bincount(row * GROUPS + group, minlength=len(n) * GROUPS).reshape(-1, GROUPS).clip(max=255).astype(np.uint8)
    out = [r.tobytes() for r in base]
    for r in np.flatnonzero(n > 16 * GROUPS):
        size = groups_of(int(n[r]))
        own = (spread[first[r] : first[r + 1]] % B.U(size)).astype(np.int64)
        out[r] = np.bincount(own, minlength=size).clip(max=255).astype(np.uint8).tobytes()
    return out


def folded(point: np.ndarray, size: int) -> np.ndarray:
    """A point over fewer groups."""
    return point if len(point) == size else point.reshape(-1, size).sum(0, dtype=np.int64)


def overlaps(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of the pairs a[i], b[j], as many at a time as PAIRS points have bytes."""
    out = np.empty(len(i), np.int64)
    step = max(1, PAIRS * GROUPS // max(1, a.shape[1] * a.itemsize))
    for k in range(0, len(i), step):
        out[k : k + step] = np.minimum(a[i[k : k + step]], b[j[k : k + step]]).sum(1, dtype=np.uint32)
    return out


class Points:
    """A column of points; base has all of them over GROUPS groups, own those with more."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
        base, self.own = [], {}
        for chunk in chunks:
            for lo, hi, data, offsets in B.slices(chunk):
                lens = np.diff(offsets)
                part = np.empty((hi - lo, GROUPS), np.uint8)
                plain = lens == GROUPS
                part[plain] = data[B.ragged(offsets[:-1][plain], lens[plain])].reshape(-1, GROUPS)
                at = sum(map(len, base))
                for r in np.flatnonzero(~plain).tolist():
                    point = data[offsets[r] : offsets[r + 1]].copy()
                    self.own[at + r] = point
                    part[r] = folded(point, GROUPS).clip(max=255)
                base.append(part)
        self.base = np.concatenate(base) if base else np.zeros((0, GROUPS), np.uint8)
        self.size = np.full(len(self.base), GROUPS)
        self.size[list(self.own)] = [len(x) for x in self.own.values()]
        self.long = self.size > GROUPS
        self._over: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def over(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All points of at least size groups over so many, their sums, and the place of each point in them."""
        if size not in self._over:
            has = np.flatnonzero(self.size >= size)
            place = np.zeros(len(self.base), np.int64)
            place[has] = np.arange(len(has))
            rows = np.empty((len(has), size), np.uint16)
            for k, r in enumerate(has.tolist()):
                rows[k] = folded(self.own[r], size).clip(max=65_535)
            self._over[size] = rows, rows.sum(1, dtype=np.int64), place
        return self._over[size]


def finer(points: Points, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, other: Points | None = None) -> np.ndarray:
    """Of pairs of points (j in other, if given), those that the bound over all their groups allows; matters for long sets only.

    sizes has the sets of points, then those of other.
    """
    second, shift = (points, 0) if other is None else (other, len(points.base))
    ok = np.ones(len(i), bool)
    both = np.flatnonzero(points.long[i] & second.long[j])
    groups = np.minimum(points.size[i[both]], second.size[j[both]])
    for size in np.unique(groups).tolist():
        (x, shown, at), (y, seen, to) = points.over(size), second.over(size)
        k = both[groups == size]
        n, m, a, b = sizes[i[k]], sizes[shift + j[k]], at[i[k]], to[j[k]]
        hidden = np.minimum(n - shown[a], m - seen[b])
        ok[k] = 9 * (overlaps(x, y, a, b) + hidden) >= 4 * (n + m)
    return ok


def slack(vectors: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Shingles that the bytes of a point don't show."""
    return sizes - vectors.sum(1, dtype=np.int64)


def prefix_size(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n - -(-4 * n // 5) + 1, 0)


class Order:
    """An order of all shingles: frequent ones last, by level, the others and those of one level by hash."""

    def __init__(self, frequent: np.ndarray, level: np.ndarray):
        order = np.argsort(frequent)
        self.frequent, self.level = frequent[order], level[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._slot(frequent)] = True

    @staticmethod
    def _slot(value: np.ndarray) -> np.ndarray:
        return (value >> B.U(44)).astype(np.int64)

    def first(self, value: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The first size shingles of each row; those of a row are distinct and ascend."""
        at = np.flatnonzero(self.maybe[self._slot(value)])
        place = np.minimum(np.searchsorted(self.frequent, value[at]), max(len(self.frequent) - 1, 0))
        known = self.frequent[place] == value[at] if len(at) else np.zeros(0, bool)
        at, level = at[known], self.level[place[known]]
        if not len(at):
            return value[B.ragged(first[:-1], size)]
        plain = np.ones(len(value), bool)
        plain[at] = False
        row = np.searchsorted(first, at, "right") - 1
        late = np.bincount(row, minlength=len(size))
        taken = np.minimum(size, np.diff(first) - late)
        begin, rest = np.cumsum(size) - size, size - taken
        out = np.empty(size.sum(), np.uint64)
        own = np.cumsum(np.diff(first) - late) - (np.diff(first) - late)
        out[B.ragged(begin, taken)] = value[plain][B.ragged(own, taken)]
        order = np.lexsort((value[at], level, row))
        out[B.ragged(begin + taken, rest)] = value[at][order][B.ragged(np.cumsum(late) - late, rest)]
        return out


def order_of(documents: DataFrame) -> Order:
    """The order of shingles, from how many of the drawn texts have them; only the way depends on the draw, not the result."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for _, _, data, offsets in B.slices(batch.column(0)):
                value, n = np.unique(distinct_shingles(data, offsets)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["key", "n"])

    text = F.col("text").cast("string")
    drawn = documents.select(text.alias("text"), F.xxhash64(text).alias("key")).where(F.pmod("key", F.lit(DRAWN)) == 0).dropDuplicates(["key"])
    seen = drawn.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN)
    got = seen.orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    return Order(got.column("key").to_numpy().view(np.uint64), np.log2(got.column("n").to_numpy()).astype(np.int8))


def row_key() -> Column:
    """With doc_id, the identity of a text."""
    return F.xxhash64(F.col("text").cast("string"))


def signatures(documents: DataFrame, order: Order) -> DataFrame:
    """doc_id, n, lo and hi (the hash of the set), row_key, the prefix keys and the point."""
    schema = "doc_id long, n long, lo long, hi long, row_key long, keys array<long>, point binary"
    shared = documents.sparkSession.sparkContext.broadcast(order)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for lo, hi, data, offsets in B.slices(batch.column(1)):
                value, first = distinct_shingles(data, offsets)
                n = np.diff(first)
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(n), *(pa.array(x) for x in set_marks(value, first))]
                size = prefix_size(n)
                keys = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(shared.value.first(value, first, size).view(np.int64)))
                cols += [batch.column(2).slice(lo, hi - lo), keys, pa.array(points(value, first), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in schema.split(", ")])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key().alias("row_key")).mapInArrow(sign, schema)


class RTree:
    """A packed tree over points; each level has the coordinate maxima, sizes and components of its nodes."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, component: np.ndarray, leaf: int = LEAF):
        weight = (B.mixed(np.arange(vectors.shape[1], dtype=np.uint64)) % B.U(1000)).astype(np.float32)
        spread = np.concatenate([vectors[k : k + PAIRS] @ weight for k in range(0, len(vectors), PAIRS)])
        self.order = np.lexsort((spread, sizes))
        hidden = slack(vectors, sizes)[self.order]
        level = (vectors[self.order], sizes[self.order], sizes[self.order], component[self.order], hidden)
        self.levels, self.leaf = [level], leaf
        while len(level[1]) > leaf:
            cut = np.arange(0, len(level[1]), leaf)
            one, other = np.minimum.reduceat(level[3], cut), np.maximum.reduceat(level[3], cut)
            level = (np.maximum.reduceat(level[0], cut), np.minimum.reduceat(level[1], cut), np.maximum.reduceat(level[2], cut), np.where(one == other, one, -1), np.maximum.reduceat(level[4], cut))
            self.levels.append(level)

    def pairs(self, step: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points (by their place in the input) that may link and lie in different components."""
        n = len(self.levels[-1][1])
        i, j = np.triu_indices(n)
        stack = [(len(self.levels) - 1, i, j)]
        while stack:
            at, i, j = stack.pop()
            if len(i) > step:
                stack += [(at, i[k : k + step], j[k : k + step]) for k in range(0, len(i), step)]
                continue
            vectors, low, high, component, hidden = self.levels[at]
            ok = (5 * high[j] >= 4 * low[i]) & (5 * high[i] >= 4 * low[j]) & ((component[i] != component[j]) | (component[i] < 0))
            i, j = i[ok], j[ok]
            ok = 9 * (overlaps(vectors, vectors, i, j) + np.minimum(hidden[i], hidden[j])) >= 4 * (low[i] + low[j])
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            if at == 0:
                ok = i != j
                yield self.order[i[ok]], self.order[j[ok]]
                continue
            below = len(self.levels[at - 1][1])
            for k in range(0, len(i), max(1, step // self.leaf**2)):
                a, b = (x[k : k + max(1, step // self.leaf**2)] * self.leaf for x in (i, j))
                grid = np.arange(self.leaf)
                left = (a[:, None, None] + grid[None, :, None] + 0 * grid[None, None, :]).ravel()
                right = (b[:, None, None] + grid[None, None, :] + 0 * grid[None, :, None]).ravel()
                ok = (left < below) & (right < below) & (left <= right)
                stack.append((at - 1, left[ok], right[ok]))


def shared_keys(postings: DataFrame) -> DataFrame:
    """(key, id, leader) of keys with two ids or more; leader is the key's smallest id. Streams through sorted partitions."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, leader, alone = None, 0, False
        for batch in batches:
            key, own = (c.to_numpy() for c in batch.columns)
            if not len(key):
                continue
            start = np.ones(len(key), bool)
            start[1:] = key[1:] != key[:-1]
            start[0] = last_key is None or key[0] != last_key
            begin = np.maximum.accumulate(np.where(start, np.arange(len(key)), -1))
            lead = np.where(begin < 0, leader, own[begin])
            more = ~start
            firsts = np.flatnonzero(start[:-1] & more[1:])  # leaders whose second id is in this batch
            k, o, m = [key[more], key[firsts]], [own[more], own[firsts]], [lead[more], own[firsts]]
            if alone and more[0]:
                k.append(key[:1]), o.append(np.array([leader])), m.append(np.array([leader]))
            last_key, alone = key[-1], bool(start[-1]) or (alone and len(key) == 0)
            leader = lead[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (k, o, m)], ["key", "id", "leader"])

    return postings.repartition("key").sortWithinPartitions("key", "id").mapInArrow(groups, "key long, id long, leader long")


def by_key(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key")


def tree_pairs(rows: DataFrame, best: bool) -> DataFrame:
    """(a, b, score) of ids that share a key, lie in different components and pass the bound.

    rows (key, id, component, n, point) hold each key in one partition, its rows together. score
    is the bound in thousandths of the sizes' sum. With best only the best partner of each row
    leaves a task, so a group gives no more rows than it has.
    """

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks(key, component, n, stored: Points) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            vectors = stored.base
            hidden = slack(vectors, n)
            cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), [len(key)]])
            size = np.diff(cuts)

            def passed(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                bound = overlaps(vectors, vectors, left, right) + np.minimum(hidden[left], hidden[right])
                ok = 9 * bound >= 4 * (n[left] + n[right])
                left, right, bound = left[ok], right[ok], bound[ok]
                ok = finer(stored, n, left, right)
                left, right, bound = left[ok], right[ok], bound[ok]
                return left, right, 1000 * bound // (n[left] + n[right])

            few = np.flatnonzero((size > 1) & (size <= LEAF))  # such a key is a single leaf
            for part in np.split(few, np.flatnonzero(np.diff(np.cumsum(size[few] ** 2) // PAIRS)) + 1):
                left = np.repeat(B.ragged(cuts[part], size[part]), np.repeat(size[part], size[part]))
                right = B.ragged(np.repeat(cuts[part], size[part]), np.repeat(size[part], size[part]))
                ok = (left < right) & (component[left] != component[right]) & (5 * n[left] >= 4 * n[right]) & (5 * n[right] >= 4 * n[left])
                yield passed(left[ok], right[ok])
            for g in np.flatnonzero(size > LEAF):
                at = slice(cuts[g], cuts[g + 1])
                for a, b in RTree(vectors[at], n[at], component[at]).pairs():
                    yield passed(cuts[g] + a, cuts[g] + b)

        def joined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            key, own, component, n = (t.column(i).to_numpy() for i in range(4))
            stored = Points(t.column(4))
            del t
            held.clear()
            top, partner = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
            for left, right, score in chunks(key, component, n, stored):
                if not best:
                    yield batch_of(own[left], own[right], score)
                    continue
                for x, y in ((left, right), (right, left)):
                    order = np.lexsort((own[y], score, x))
                    last = order[np.append(x[order][1:] != x[order][:-1], True)] if len(order) else order
                    better = last[score[last] > top[x[last]]]
                    top[x[better]], partner[x[better]] = score[better], y[better]
            if best:
                has = np.flatnonzero(top >= 0)
                yield batch_of(own[has], own[partner[has]], top[has])

        def batch_of(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
            first, second = (a, b) if best else (np.minimum(a, b), np.maximum(a, b))
            return pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), pa.array(score)], ["a", "b", "score"])

        held: list[pa.RecordBatch] = []
        for batch in batches:  # cut where a key ends, so that each is whole
            key = batch.column(0).to_numpy()
            change = np.flatnonzero(key[1:] != key[:-1])
            if len(key) == 0:
                continue
            if held and key[0] != held[-1].column(0)[-1].as_py():
                whole, held = held, []
                yield from joined(whole)
            if len(change):
                end = int(change[-1]) + 1
                whole, held = [*held, batch.slice(0, end)], [batch.slice(end)]
                yield from joined(whole)
            else:
                held.append(batch)
        if held:
            yield from joined(held)

    pairs = rows.select("key", "id", "component", "n", "point").mapInArrow(groups, "a long, b long, score long")
    if not best:
        return pairs.select("a", "b").distinct()
    one = pairs.groupBy("a").agg(F.max(F.struct("score", "b")).alias("m"))
    return one.select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b")).distinct()


def small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def possible(rows: DataFrame, key: Column, wanted: np.ndarray) -> DataFrame:
    """The rows whose key may be in a sketch."""
    shared, columns = rows.sparkSession.sparkContext.broadcast(wanted), rows.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(in_sketch(shared.value, batch.column(len(columns)).to_numpy())))
            yield own.select(columns)

    return rows.withColumn("_hash", key).mapInArrow(keep, rows.schema)


def beside(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """pairs (a, b) with own's columns of a. The pairs of an id that leads many are dealt to several tasks, each with its own copy."""
    lead = settled(pairs.groupBy("a").agg(F.ceil(F.count("*") / LED).cast("int").alias("parts")).where("parts > 1"))
    if lead.isEmpty():
        return pairs.join(own, "a")
    few = small(lead)
    dealt = pairs.join(few, "a", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    copies = own.join(few, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copies, ["a", "part"]).drop("part")


def verified(pairs: DataFrame, classes: DataFrame, documents: DataFrame, tasks: int) -> DataFrame:
    """The pairs (a, b) of class ids whose sets truly link."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct().coalesce(tasks)
    ids = settled(ids.join(classes.select("id", "doc_id", "lo", "row_key"), "id").coalesce(tasks))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in B.slices(batch.column(2)):
                value, first = distinct_shingles(data, offsets)
                own = batch.slice(lo, hi - lo)
                same = set_marks(value, first)[0] == own.column(1).to_numpy()
                body = pa.array([value[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([own.column(0), body], ["id", "shingles"]).filter(pa.array(same))

    wanted = ids.withColumnRenamed("doc_id", "_doc")
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key().alias("_key"))
    if ids.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    else:
        texts = possible(texts, F.xxhash64("doc_id", "_key"), sketch(F.xxhash64("_doc", "row_key"), wanted))
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("row_key"))).select("id", "lo", "text")
    own = settled(texts.mapInArrow(sets, "id long, shingles binary"))
    if own.count() > ids.count():  # repeated rows of one doc_id and text: one of each
        own = settled(own.dropDuplicates(["id"]))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))  # never empty
                place = np.minimum(np.searchsorted(x, y), len(x) - 1)
                keep.append(9 * int((x[place] == y).sum()) >= 4 * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = beside(pairs, own.select(F.col("id").alias("a"), F.col("shingles").alias("x"))).join(own.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct().coalesce(tasks)


def _bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose points and sizes allow a link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            x, y, i = Points(batch.column(4)), Points(batch.column(5)), np.arange(len(n))
            ok = (5 * n >= 4 * m) & (5 * m >= 4 * n) & (9 * (overlaps(x.base, y.base, i, i) + np.minimum(slack(x.base, n), slack(y.base, m))) >= 4 * (n + m))
            ok[ok] = finer(x, np.concatenate([n, m]), i[ok], i[ok], y)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    own = classes.select("id", "n", "point")
    both = beside(pairs, own.toDF("a", "n", "x")).join(own.toDF("b", "m", "y"), "b")
    return both.select("a", "b", "n", "m", "x", "y").mapInArrow(check, "a long, b long")


def keyed(classes: DataFrame, most: int) -> DataFrame:
    """(key, id, leader) for the prefix keys that classes share; leader is the smallest id of a key.

    The postings of a key of about over ``most`` classes are not brought together: their leaders are map-side
    combined minima, sent back to where the postings are. Which keys are that large is estimated
    on a sixty-fourth of the classes; only the way depends on it, not the result.
    """
    drawn = classes.where(F.pmod("lo", F.lit(64)) == 0).select(F.explode("keys").alias("key")).groupBy("key").count()
    large = settled(drawn.where(F.col("count") * 64 > most).select("key"))
    postings = classes.select(F.explode("keys").alias("key"), "id")
    if large.isEmpty():
        return shared_keys(postings)
    few = small(large)
    hot = postings.join(few, "key")
    lead = small(settled(hot.groupBy("key").agg(F.min("id").alias("leader"))))
    return shared_keys(postings.join(few, "key", "left_anti")).unionByName(hot.join(lead, "key").select("key", "id", "leader"))


def in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """rows (key, c, ...), with c the classes of the key: a key of over block classes becomes keys of pairs of blocks."""
    parts = F.ceil(F.col("c") / block).cast("int")
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    pair = F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other"))
    return rows.withColumn("key", F.when(F.col("c") > block, pair).otherwise(F.col("key"))).drop("_own", "_other", "c")


def class_components(signed: DataFrame, documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """n, lo, hi, doc_id and row_key (of the class's first row), id and component of each class of equal sets.

    signed has the signatures of documents, with keys and points.
    """
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("m")
    classes = signed.where("n > 0").groupBy("n", "lo", "hi").agg(least, F.first("keys").alias("keys"), F.first("point").alias("point"))
    classes = settled(classes.select("n", "lo", "hi", "m.doc_id", "m.row_key", "keys", "point").withColumn("id", F.monotonically_increasing_id()))
    shared = settled(keyed(classes, min(block, STAR)))
    stars = shared.where("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    stars = settled(stars)
    tasks = 1 + classes.count() // CLASSES_A_TASK
    links = settled(verified(settled(_bounded(stars, classes).coalesce(tasks)), classes, documents, tasks))
    found = components(links)
    named = shared.select("key", "id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sums = [F.sum(F.xxhash64("id", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 2)]
    open_keys = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("c"), *sums).where("x != y")
    open_keys = open_keys.groupBy("c", "s1", "s2").agg(F.min("key").alias("key")).select("key", "c")  # of keys with the same ids, one
    rows = named.join(open_keys, "key").select("key", "c", "id").join(classes.select("id", "n", "point"), "id")
    rows = settled(by_key(in_blocks(rows, block)))

    def placed(found: DataFrame) -> DataFrame:
        """rows with their components; each key stays in its partition if the table of components is small."""
        known = found.withColumnRenamed("id", "_id")
        if known.count() <= BROADCAST_ROWS:
            now = rows.join(F.broadcast(known), F.col("id") == F.col("_id"), "left")
        else:
            now = by_key(rows.join(known, F.col("id") == F.col("_id"), "left"))
        return now.withColumn("component", F.coalesce("component", "id"))

    for last in [*[False] * MAX_STEPS, True]:
        # the most promising partner of each class first: what it joins needs no more checks inside
        pairs = settled(tree_pairs(placed(found), best=not last).coalesce(tasks))
        more = settled(verified(pairs, classes, documents, tasks))
        tried, new = pairs.count(), more.count()
        if new:
            links = settled(links.unionByName(more))
            found = components(links)
        if not last and tried and 10 * new < tried:  # few partners are new: now all pairs that still lie apart
            more = verified(settled(tree_pairs(placed(found), best=False).coalesce(tasks)), classes, documents, tasks)
            found = components(links.unionByName(more))
            break
        if not tried:
            break
    return classes.select("n", "lo", "hi", "doc_id", "row_key", "id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def jaccard_components(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each row."""
    signed = settled(signatures(documents, order_of(documents)))
    own = class_components(signed, documents, block)
    least = own.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    member = own.join(least, "component").select("n", "lo", "hi", "component_id")
    out = signed.select("doc_id", "n", "lo", "hi").join(member, ["n", "lo", "hi"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row of each component, of its smallest doc_id, and all rows with an empty set.

    Rows are told apart by doc_id and row_key, so neither a shared nor a missing doc_id costs one.
    The caller's columns stay as they are, whatever their names.
    """
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("m")
    signed = signatures(documents, order_of(documents))
    first = settled(class_components(signed, documents, block).groupBy("component").agg(least).select(F.col("m.doc_id").alias("_id"), F.col("m.row_key").alias("_row"), F.lit(True).alias("_first")))
    numbered, own, names = set_apart(documents)
    text, doc_id = own["text"].cast("string"), own["doc_id"].cast("long")
    blank = ~F.regexp_like(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]"))
    rows = numbered.withColumn("_key", F.xxhash64(text)).join(small(first), doc_id.eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_row")), "left")
    full = rows.where(F.col("_first") & ~blank)
    if full.count() > first.count():  # repeated rows of one doc_id and text
        full = full.withColumn("_doc", doc_id).dropDuplicates(["_doc", "_key"]).drop("_doc")
        return full.unionByName(rows.where(blank)).select(*names)
    return rows.where(F.col("_first") | blank).select(*names)


def op4_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))
