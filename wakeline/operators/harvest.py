"""Labels that later traffic gives to earlier cuts: one ordered pass over each session.

Turns come in the order of their id. A turn's growth (a file fetched more often than in the turn
with a body before it) is blamed on the nearest earlier turn that cut the same file, within a number
of turns and seconds; a body seen again, or a turn that opens with a complaint, speaks against the
earlier turn as a whole. Each is an observation; labels are the first observation of each request
and key, those of files before those of turns.

The pass is a fold over rows sorted by turn in Spark's partitions. It carries the cuts of the last
turns, their applied flags and the fetch counts of the last turn with a body, whatever the length
of the session. Long sessions are folded in chunks of turns: a chunk begins with the window's turns
before it, and with the counts of the last body before those, so no session is one task.

Defined cases: a turn without a body is counted, keeps its place in the window and leaves the
counts as they were; a null time is 0; ids are unique within a session; a cut whose file was cut
already in that turn (in any spelling) is the same cut; a cut without target and pointer labels the
slot; tables without rows give none.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .labels import CORRECTION, WINDOW_S, WINDOW_TURNS
from .spread import numbered, previous

CHUNK = 2048  # turns
RE_READ, WOULD_BE, RERUN, COMPLAINT, CUT = "implicit:re-read", "implicit:would-be-live", "implicit:re-run", "implicit:correction", "cut"
_FOLDED = "session string, request_id long, at_id long, source string, target string, pointer string, path string, before long, regret_tok long, evicted_tok long, n long"


def dropped(decisions: DataFrame) -> DataFrame:
    """(request_id, pos, index, pointer, target, tokens, applied) of each message that a turn's decisions cut.

    decisions: request_id, pos, slot, applied, candidates array<struct<target, keep, tokens, index>>,
    proof struct<applied, dropped array<struct<kind, id, pointer, tokens, index>>>. The first proof of
    a request is all there is to it; without one, compact candidates that were not kept count, as
    applied if any decision of the request was.
    """
    whole = decisions.groupBy("request_id").agg(
        F.min_by("proof", F.when(F.col("proof").isNotNull(), F.col("pos"))).alias("proof"),
        F.coalesce(F.bool_or("applied"), F.lit(False)).alias("any_applied"),
    )
    of_proof = whole.where("proof is not null").select("request_id", F.col("proof.applied").alias("applied"), F.posexplode("proof.dropped").alias("pos", "x")).where("x.kind = 'message'")
    of_proof = of_proof.select("request_id", F.col("pos").cast("long"), F.col("x.index").alias("index"), F.coalesce(F.nullif(F.col("x.pointer"), F.lit("")), F.concat(F.lit("message:"), "x.id")).alias("pointer"), F.col("x.id").alias("target"), F.coalesce("x.tokens", F.lit(0)).cast("long").alias("tokens"), F.coalesce("applied", F.lit(False)).alias("applied"))
    compact = decisions.where("slot = 'compact'").select("request_id", F.col("pos").alias("d_pos"), F.posexplode("candidates").alias("c_pos", "x")).where("not coalesce(x.keep, false)")
    compact = compact.join(whole.where("proof is null").select(F.col("request_id").alias("_r"), "any_applied"), F.col("request_id") == F.col("_r"))
    compact = compact.select("request_id", (F.col("d_pos") * 1_000_000 + F.col("c_pos")).cast("long").alias("pos"), F.col("x.index").alias("index"), F.concat(F.lit("message:"), "x.target").alias("pointer"), F.col("x.target").alias("target"), F.coalesce("x.tokens", F.lit(0)).cast("long").alias("tokens"), F.col("any_applied").alias("applied"))
    return of_proof.unionByName(compact)


def cut_reads(cuts: DataFrame, seen: DataFrame, reach: int = 2) -> DataFrame:
    """cuts with the path each was the content of: paths of its message or of calls up to reach messages before.

    seen: request_id, idx, path, is_search. Results of searches are the content of nothing.
    """
    near = cuts.withColumn("idx", F.explode(F.sequence(F.col("index") - reach, F.col("index"))))
    found = near.join(seen.where("not is_search").select(F.col("request_id").alias("_r"), F.col("idx").alias("_i"), F.lower("path").alias("path")), (F.col("request_id") == F.col("_r")) & (F.col("idx") == F.col("_i")))
    return found.groupBy("request_id", "pos", "index", "pointer", "target", "tokens", "applied", "path").agg(F.max("idx").alias("idx"))


def _base(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _same(a: str, b: str) -> bool:
    return a == b or a.endswith("/" + b) or b.endswith("/" + a)


class _Pass:
    """One chunk of one session, turn after turn."""

    def __init__(self, turns: int, seconds: float):
        self.window: deque = deque(maxlen=turns)
        self.seconds, self.counts, self.out = seconds, {}, []
        self.turn: dict | None = None

    def begin(self, row: dict) -> None:
        self.end()
        self.turn, self.cuts, self.now = row, {}, {}

    def cut(self, row: dict) -> None:
        """Under its file's base name, unless this turn cut that file before."""
        path = row["path"].lower()
        mine = self.cuts.setdefault(_base(path), [])
        if not any(_same(p, path) for p, _ in mine):
            mine.append((path, row))

    def fetched(self, row: dict) -> None:
        self.now[row["path"]] = (row["n"], row["tokens"] or 0)

    def end(self) -> None:
        t = self.turn
        if t is None:
            return
        if t["has_body"]:
            if not t["context"]:
                n = sum(map(len, self.cuts.values()))
                if n:
                    self.out.append((t["session"], t["id"], t["id"], CUT, None, None, None, None, None, None, n))
                for path, (n, cost) in sorted(self.now.items()):
                    if n > self.counts.get(path, 0):
                        self._blame(t, path, cost)
            self.counts = {p: n for p, (n, _) in self.now.items()}
        if t["context"] != 2:
            self.window.append((t["id"], t["ts_epoch"], self.cuts if t["has_body"] else None))
        self.turn = None

    def _blame(self, t: dict, path: str, cost: int) -> None:
        lower = path.lower()
        for turn_id, at, cuts in reversed(self.window):
            if cuts is None:
                continue
            if t["ts_epoch"] - at > self.seconds:
                return
            for p, c in cuts.get(_base(lower), ()):
                if _same(p, lower):
                    source, paid = (RE_READ, cost) if c["applied"] else (WOULD_BE, 0)
                    self.out.append((t["session"], turn_id, t["id"], source, c["target"], c["pointer"], path, self.counts.get(path, 0), paid, c["tokens"] or 0, 1))
                    return


def _chunks(turns: DataFrame, window: int, chunk: int) -> DataFrame:
    """turns with chunk and context: 0 in their own chunk, 1 where the next one looks back on them, 2 where it only needs their counts."""
    own = F.floor(F.col("turn_no") / chunk)
    late = F.col("turn_no") % chunk >= chunk - window
    back = F.ceil(F.lit(window) / chunk).cast("int")  # chunks that a window reaches over
    if window <= chunk:
        places = F.when(late, F.array(own, own + 1)).otherwise(F.array(own))
    else:
        places = F.sequence(own, own + back)
    rows = turns.withColumn("chunk", F.explode(places)).withColumn("context", (F.col("chunk") != own).cast("int"))
    rows = rows.where((F.col("context") == 0) | (F.col("turn_no") >= F.col("chunk") * chunk - window))
    # the last body of earlier chunks, where it is not among the turns looked back on
    last = turns.groupBy("session", own.alias("chunk")).agg(F.max(F.when(F.col("has_body"), F.col("turn_no"))).alias("own_last"))
    earlier = Window.partitionBy("session").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = last.select(F.col("session").alias("_s"), F.col("chunk").alias("_c"), F.max("own_last").over(earlier).alias("_t")).where(f"_t < _c * {chunk} - {window}")
    more = turns.join(base, F.col("session").eqNullSafe(F.col("_s")) & (F.col("turn_no") == F.col("_t"))).withColumn("chunk", F.col("_c")).withColumn("context", F.lit(2)).drop("_s", "_c", "_t")
    return rows.unionByName(more)


def file_observations(turns: DataFrame, fetches: DataFrame, cuts: DataFrame, window: int = WINDOW_TURNS, seconds: float = WINDOW_S, chunk: int = CHUNK) -> DataFrame:
    """What the pass finds: a row for each growth that a cut is blamed for, and one (source 'cut', n) for each turn with cuts.

    turns: session, id, ts_epoch, has_body. fetches: session, id, path, n, tokens, the files and
    counts that a turn's body shows. cuts: session, id, pos, path, pointer, target, tokens, applied.
    """
    window = max(1, window)
    plain = turns.select(F.col("session").cast("string"), "id", F.coalesce("ts_epoch", F.lit(0.0)).cast("double").alias("ts_epoch"), F.coalesce("has_body", F.lit(False)).alias("has_body"))
    placed = _chunks(numbered(plain, ["session"], "id", "turn_no"), window, chunk)
    place = placed.select("session", "id", "turn_no", "chunk", "context", "has_body")

    def joined(rows: DataFrame, kind: int) -> DataFrame:
        r = rows.select(F.col("session").cast("string").alias("_s"), F.col("id").alias("_id"), *(c for c in rows.columns if c not in ("session", "id")))
        r = r.where("path is not null")
        return place.where("has_body").join(r, F.col("session").eqNullSafe(F.col("_s")) & (F.col("id") == F.col("_id"))).drop("_s", "_id").withColumn("kind", F.lit(kind))

    cut = joined(cuts.select("session", "id", "pos", "path", "pointer", F.col("target").cast("string").alias("target"), F.col("tokens").cast("long"), "applied"), 1).where("context < 2")
    fetch = joined(fetches.select("session", "id", "path", F.col("n").cast("long").alias("n"), F.col("tokens").cast("long")), 2)
    rows = placed.withColumn("kind", F.lit(0)).unionByName(cut, allowMissingColumns=True).unionByName(fetch, allowMissingColumns=True)
    columns = ["session", "chunk", "turn_no", "kind", "id", "ts_epoch", "has_body", "context", "pos", "path", "pointer", "target", "tokens", "applied", "n"]
    rows = rows.select(*columns).repartition("session", "chunk").sortWithinPartitions("session", "chunk", "turn_no", "kind", "pos", "path")
    names = [x.split()[0] for x in _FOLDED.split(", ")]
    kinds = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in _FOLDED.split(", ")])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at = None, _Pass(window, seconds)

        def made() -> pa.RecordBatch:
            out, at.out = at.out, []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for row in batch.to_pylist():
                if (row["session"], row["chunk"]) != key:
                    at.end()
                    key, found = (row["session"], row["chunk"]), at.out
                    at = _Pass(window, seconds)
                    at.out = found
                (at.begin, at.cut, at.fetched)[row["kind"]](row)
            if at.out:
                yield made()
        at.end()
        if at.out:
            yield made()

    return rows.mapInArrow(fold, _FOLDED)


def turn_observations(turns: DataFrame, seconds: float = WINDOW_S, pattern: str = CORRECTION) -> DataFrame:
    """Bodies seen again and complaints, in the columns of ``file_observations``; turns also have body_sha and user_text."""
    rows = turns.select(F.col("session").cast("string"), "id", F.coalesce("ts_epoch", F.lit(0.0)).alias("ts_epoch"), F.coalesce("has_body", F.lit(False)).alias("has_body"), "body_sha", "user_text")
    again = previous(rows.where("has_body and body_sha is not null"), ["session", "body_sha"], "id", ["id", "ts_epoch"], "earlier")
    again = again.where(F.col("earlier").isNotNull() & (F.col("ts_epoch") - F.col("earlier.ts_epoch") <= seconds)).withColumn("source", F.lit(RERUN))
    told = previous(rows, ["session"], "id", ["id", "has_body"], "earlier")
    told = told.where(F.col("has_body") & F.col("earlier.has_body") & F.regexp_like(F.coalesce("user_text", F.lit("")), F.lit(pattern))).withColumn("source", F.lit(COMPLAINT))
    pick = lambda df: df.select("session", F.col("earlier.id").alias("request_id"), F.col("id").alias("at_id"), "source")
    return pick(again).unionByName(pick(told))


def harvest_labels(files: DataFrame, turns: DataFrame) -> DataFrame:
    """(session, request_id, scope, key, verdict, source, path, regret_tok, evicted_tok, at_id, evidence): the first observation of each key."""
    key = F.coalesce(F.nullif(F.col("target"), F.lit("")), F.nullif(F.col("pointer"), F.lit("")))
    reads = files.where(F.col("source") != CUT).withColumn("key", F.coalesce(key, F.lit("compact"))).withColumn("scope", F.when(key.isNotNull(), "targets").otherwise("slots"))
    reads = reads.withColumn("verdict", F.lit("keep")).withColumn("class", F.lit(0))
    whole = turns.withColumn("key", F.lit("turn")).withColumn("scope", F.lit("slots")).withColumn("verdict", F.lit("bad")).withColumn("class", F.when(F.col("source") == RERUN, 1).otherwise(2))
    rows = reads.unionByName(whole, allowMissingColumns=True)
    said = _evidence().alias("evidence")
    order = F.struct((F.col("class") > 0).alias("later"), "at_id", "class", "path")
    entry = F.struct("verdict", "source", "path", "regret_tok", "evicted_tok", "at_id", said)
    return rows.groupBy("session", "request_id", "scope", "key").agg(F.min_by(entry, order).alias("e")).select("session", "request_id", "scope", "key", "e.*")


def _evidence() -> Column:
    return (
        F.when(F.col("source").isin(RE_READ, WOULD_BE), F.format_string("%s fetched again at %d, %d times before", "path", "at_id", "before"))
        .when(F.col("source") == RERUN, F.format_string("same body at %d", "at_id"))
        .otherwise(F.format_string("complaint at %d", "at_id"))
    )


def harvest_summary(turns: DataFrame, files: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: requests and bodies seen, cut reads, wrong cuts enforced and in shadow, tokens paid again."""
    seen = turns.agg(F.count("*").alias("requests_scanned"), F.count_if(F.coalesce("has_body", F.lit(False))).alias("bodies_available"))
    total = lambda source, column: F.coalesce(F.sum(F.when(F.col("source") == source, F.col(column))), F.lit(0))
    found = files.agg(total(CUT, "n").alias("evicted_reads_seen"), total(RE_READ, "n").alias("enforced"), total(WOULD_BE, "n").alias("shadow"), total(RE_READ, "regret_tok").alias("refetch_tok_paid"))
    labelled = labels.select("session", "request_id").distinct().agg(F.count("*").alias("labels_written"))
    both = seen.join(F.broadcast(found)).join(F.broadcast(labelled))  # one row each
    regret = F.col("enforced") + F.col("shadow")
    per_1k = F.round(F.try_divide(regret * F.lit(1000.0), F.col("requests_scanned")), 1)
    return both.withColumn("skipped_no_body", F.col("requests_scanned") - F.col("bodies_available")).withColumn("wrong_drops", regret).withColumn("per_1k", per_1k)


def harvest_by_source(labels: DataFrame) -> DataFrame:
    return labels.groupBy("source").agg(F.count("*").alias("labels"), F.coalesce(F.sum("regret_tok"), F.lit(0)).alias("regret_tok"))
