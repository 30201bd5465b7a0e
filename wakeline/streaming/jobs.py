"""Stream jobs; each has a batch twin with the same answer.

All time is event time: a watermark follows the newest row, and a timer of each key ends its state
once the watermark has passed what can still matter to it. A stream that was stopped, for however
long, or that replays old rows gives what it would have given live. Rows more than ``LATE_S`` behind
the newest are dropped by Spark, which counts them in the query's progress. Only the job that marks
late rows must see all of them: it keeps one number a session for good instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.labels import WINDOW_S, WINDOW_TURNS
from ..operators.report import priced

QUIET_S, LATE_S = 3600.0, 600.0


class _Timed(StatefulProcessor):
    """State that ends when the watermark passes the newest time of its key by span_s."""

    def __init__(self, span_s: float):
        self.span_s = span_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.begin(handle)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def extend(self, newest: float) -> None:
        """The key's one timer, span_s after its newest time (seconds) or where it was, whichever is later."""
        until, set_ = math.ceil((newest + self.span_s) * 1000), list(self.handle.listTimers())
        if not set_ or max(set_) < until:
            for t in set_:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(until)

    def states(self) -> list:
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in self.states():
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def timed(rows: DataFrame, seconds: str, late_s: float) -> DataFrame:
    """rows with their event time as column at, under a watermark that follows late_s behind."""
    return rows.withColumn("at", F.timestamp_millis((F.col(seconds) * 1000).cast("long"))).withWatermark("at", f"{int(late_s * 1000)} milliseconds")


def live_by_day(requests: DataFrame, late: str = "1 day") -> DataFrame:
    """Requests, cost and tokens of each day, as rows arrive; batch twin by_day."""
    rows = priced(requests).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    sums = rows.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"), F.sum("cost_usd").alias("cost"), F.sum(F.col("in_tok") + F.col("cw_tok") + F.col("cr_tok")).alias("in_tok"), F.sum("out_tok").alias("out_tok"))
    return sums.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", F.round("cost", 4).alias("cost"), "in_tok", "out_tok")


def frame_usage(frames: DataFrame) -> DataFrame:
    """Usage of each response from its ordered frames (batch): input of the first start frame, the last output that isn't 0."""
    start = F.min_by("input", F.when(F.col("type") == "message_start", F.col("seq")))
    last = F.max_by("output", F.when((F.col("type") == "message_delta") & (F.col("output") != 0), F.col("seq")))
    return frames.groupBy("request_id").agg(F.coalesce(start, F.lit(0)).alias("input"), F.coalesce(last, F.lit(0)).alias("output"))


class _Usage(_Timed):
    """Keeps the first start frame and the last delta seen so far; emits the usage after each batch."""

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("usage", "start_seq long, input long, delta_seq long, output long")

    def states(self) -> list:
        return [self.state]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, given, last, out = self.state.get() if self.state.exists() else (-1, 0, -1, 0)
        newest = float("-inf")
        for batch in rows:
            for r in batch.itertuples():
                newest = max(newest, r.ts_epoch)
                if r.type == "message_start" and (first < 0 or r.seq < first):
                    first, given = int(r.seq), int(r.input)
                elif r.type == "message_delta" and r.output and r.seq > last:
                    last, out = int(r.seq), int(r.output)
        self.state.update((first, given, last, out))
        self.extend(newest)
        yield pd.DataFrame({"request_id": [key[0]], "input": [given], "output": [out]})


def stream_frame_usage(frames: DataFrame, quiet_s: float = QUIET_S, late_s: float = LATE_S) -> DataFrame:
    """Usage so far of each response; batch twin frame_usage. Frames of a response lie within quiet_s of each other."""
    rows = timed(frames.withColumn("ts_epoch", F.unix_millis(F.col("ts").cast("timestamp")) / 1000.0), "ts_epoch", late_s)
    rows = rows.select("request_id", "seq", "type", "input", "output", "ts_epoch", "at")
    return rows.groupBy("request_id").transformWithStateInPandas(_Usage(quiet_s), outputStructType="request_id long, input long, output long", outputMode="Update", timeMode="EventTime")


class _Reruns(_Timed):
    """Remembers the last sighting of a body until the window after it has passed."""

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "id long, ts double")

    def states(self) -> list:
        return [self.last]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values("id")
        seen = self.last.get() if self.last.exists() else None
        out = []
        for r in own.itertuples():
            if seen is not None and r.ts_epoch - seen[1] <= self.span_s:
                out.append((int(seen[0]), int(r.id)))
            seen = (int(r.id), float(r.ts_epoch))
        self.last.update(seen)
        self.extend(float(own.ts_epoch.max()))
        yield pd.DataFrame(out, columns=["request_id", "again_id"]).astype("int64")


def stream_reruns(requests: DataFrame, window_s: float = WINDOW_S, late_s: float = LATE_S) -> DataFrame:
    """Re-run alerts; batch twin labels.reruns. Rows of one body must arrive in order of id."""
    rows = timed(requests.select("body_sha", "id", "ts_epoch"), "ts_epoch", late_s)
    return rows.groupBy("body_sha").transformWithStateInPandas(_Reruns(window_s), outputStructType="request_id long, again_id long", outputMode="Append", timeMode="EventTime")


class _Rereads(_Timed):
    """Remembers the counts of the last turn, and the evictions of the last turns and seconds.

    Once no eviction is young enough to be blamed, the counts tell nothing either.
    """

    def __init__(self, turns: int, window_s: float):
        super().__init__(window_s)
        self.turns = turns

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getListState("counts", "turn long, path string, n long")
        self.cut = handle.getListState("cut", "turn long, ts double, path string, tokens long")

    def states(self) -> list:
        return [self.counts, self.cut]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts = [tuple(x) for x in self.counts.get()] if self.counts.exists() else []
        cut = [tuple(x) for x in self.cut.get()] if self.cut.exists() else []
        out = []
        own = pd.concat(list(rows)).sort_values("turn", kind="stable")
        for r in own.itertuples():
            counts = [c for c in counts if c[0] >= r.turn - 1]
            cut = [e for e in cut if r.turn - e[0] <= self.turns and r.ts_epoch - e[1] <= self.span_s]
            before = max((c[2] for c in counts if c[0] == r.turn - 1 and c[1] == r.path), default=0)
            cause = max((e for e in cut if e[0] < r.turn and _spelled_alike(e[2], r.path)), default=None)
            if r.n > before and cause is not None:
                out.append((int(key[0]), int(r.turn), r.path, int(cause[0]), int(cause[3]), int(r.tokens)))
            counts.append((int(r.turn), r.path, int(r.n)))
            if r.evicted:
                cut.append((int(r.turn), float(r.ts_epoch), r.path, int(r.tokens)))
        self.counts.put(counts)
        self.cut.put(cut) if cut else self.cut.clear()
        self.extend(float(own.ts_epoch.max()))
        yield pd.DataFrame(out, columns=["session", "turn", "path", "e_turn", "evicted_tok", "regret_tok"]).astype({c: "int64" for c in ("session", "turn", "e_turn", "evicted_tok", "regret_tok")})


def _spelled_alike(a: str, b: str) -> bool:
    a, b = a.lower(), b.lower()
    return bool(a and b) and (a == b or a.endswith("/" + b) or b.endswith("/" + a))


def stream_rereads(turns: DataFrame, reach: int = WINDOW_TURNS, window_s: float = WINDOW_S, late_s: float = LATE_S) -> DataFrame:
    """Growth of a path's fetches with the eviction that caused it; batch twins labels.growth and labels.blamed.

    turns: session, turn, ts_epoch, path, n (fetches so far), tokens, evicted. A session's rows must arrive in order of turn.
    """
    rows = timed(turns.select("session", "turn", "ts_epoch", "path", "n", "tokens", "evicted"), "ts_epoch", late_s)
    return rows.groupBy("session").transformWithStateInPandas(_Rereads(reach, window_s), outputStructType="session long, turn long, path string, e_turn long, evicted_tok long, regret_tok long", outputMode="Append", timeMode="EventTime")


class _Frames(_Timed):
    """Keeps what follows the last blank line, and the number of frames so far; a timer brings out what never ended."""

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "rest string, frames long")

    def states(self) -> list:
        return [self.rest]

    def _frames(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["request_id", "seq", "frame"]).astype({"request_id": "int64", "seq": "int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rest, number = self.rest.get() if self.rest.exists() else ("", 0)
        out, done = [], False
        own = pd.concat(list(rows)).sort_values("seq")
        for r in own.itertuples():
            rest, done = rest + (r.payload or ""), bool(r.done)
            whole = rest.removesuffix("\r") if not done else rest  # its line feed may come with the next chunk
            *frames, after = whole.replace("\r\n", "\n").split("\n\n")
            rest = after + rest[len(whole) :]
            for frame in [*frames, rest] if done else frames:
                if frame.strip(" "):
                    out.append((int(key[0]), number, frame))
                    number += 1
        self.rest.clear() if done else self.rest.update((rest, number))
        self.extend(float(own.ts_epoch.max()))
        yield self._frames(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rest, number = self.rest.get() if self.rest.exists() else ("", 0)
        self.rest.clear()
        yield self._frames([(int(key[0]), number, rest)] if rest.strip(" ") else [])


def stream_reassembled(chunks: DataFrame, quiet_s: float = QUIET_S, late_s: float = LATE_S) -> DataFrame:
    """Frames of a response as their blank lines arrive, the remainder with the chunk marked done; batch twin reassembled.

    chunks: request_id, seq, ts_epoch, payload, done. A response's chunks must arrive in order of seq,
    within quiet_s of each other; a response without a chunk marked done gives its remainder once
    the stream's time is quiet_s past its last chunk.
    """
    rows = timed(chunks.select("request_id", "seq", "ts_epoch", "payload", F.coalesce("done", F.lit(False)).alias("done")), "ts_epoch", late_s)
    return rows.groupBy("request_id").transformWithStateInPandas(_Frames(quiet_s), outputStructType="request_id long, seq long, frame string", outputMode="Append", timeMode="EventTime")


class _Lateness(StatefulProcessor):
    """Keeps the newest time of a session, for good: whatever ended it would call later rows on time, and a watermark would drop them."""

    def __init__(self, late_s: float):
        self.late_s = late_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "ts double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values("id")
        start = self.newest.get()[0] if self.newest.exists() else float("-inf")
        before = own.ts_epoch.cummax().shift(fill_value=float("-inf")).clip(lower=start)
        self.newest.update((max(start, float(own.ts_epoch.max())),))
        yield pd.DataFrame({"session": own.session, "id": own.id, "ts_epoch": own.ts_epoch, "late": before - own.ts_epoch > self.late_s})

    def close(self) -> None:
        pass


def stream_on_time(requests: DataFrame, late_s: float) -> DataFrame:
    """(session, id, ts_epoch, late) as requests arrive in order of id; batch twin on_time."""
    rows = requests.select(F.col("session").cast("long"), F.col("id").cast("long"), F.col("ts_epoch").cast("double"))
    return rows.groupBy("session").transformWithStateInPandas(_Lateness(late_s), outputStructType="session long, id long, ts_epoch double, late boolean", outputMode="Append", timeMode="None")


def write_by_lateness(flagged: DataFrame, path: str, checkpoint: str, counted=None):
    """Starts a query that writes rows to path/place=on_time, late ones to the side table path/place=late, each batch in a folder of its own that a retry replaces.

    counted gets each batch's number and how many of its rows were on time and late, counted while they are written.
    """

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        rows = batch.observe(seen, F.count_if(~F.col("late")).alias("on_time"), F.count_if("late").alias("late"))
        placed = rows.withColumns({"place": F.when(F.col("late"), "late").otherwise("on_time"), "batch": F.lit(number)}).drop("late")
        placed.write.partitionBy("place", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
        if counted is not None:
            counted(number, seen.get)

    return flagged.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def reassembled(chunks: DataFrame) -> DataFrame:
    """(request_id, seq, frame) of byte chunks (request_id, seq, payload) cut anywhere: frames end with a blank line, the rest is the last one."""
    whole = chunks.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "payload"))), lambda x: x["payload"]), "").alias("all"))
    frames = F.filter(F.split(F.regexp_replace("all", "\r\n", "\n"), "\n\n"), lambda x: F.trim(x) != "")
    return whole.select("request_id", F.posexplode(frames).alias("seq", "frame"))


def on_time(requests: DataFrame, late_s: float) -> DataFrame:
    """requests (batch, in arrival order id) with late: more than late_s behind the newest time seen before; twin of the watermark's side table."""
    seen = F.max("ts_epoch").over(Window.partitionBy("session").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    return requests.withColumn("late", F.coalesce(seen - F.col("ts_epoch") > late_s, F.lit(False)))


def prefix_reuse(messages: DataFrame) -> DataFrame:
    """(request_id, idx, reused): leading characters of a message shared with the one before it in the request."""
    w = Window.partitionBy("request_id").orderBy("idx")
    rows = messages.withColumn("_before", F.lag("text").over(w)).select("request_id", "idx", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("_before", F.lit("")).alias("_before"))

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for batch in batches:
            yield pd.DataFrame({"request_id": batch.request_id, "idx": batch.idx, "reused": [len(os.path.commonprefix([a, b])) for a, b in zip(batch.text, batch["_before"], strict=True)]})

    return rows.mapInPandas(shared, StructType().add("request_id", "long").add("idx", "long").add("reused", "long"))
