"""Note events as batches and streams: debounce, suppression, cooldown, rate limits, bounded buffers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteforge.sources.staging import staged


def debounce(events: DataFrame, gap: str, key: str = "note_id", watermark: str | None = None) -> DataFrame:
    """key, began, ended, n: events of a key closer than gap are one; batch or, with a watermark, a stream."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    s = events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("ended"))
    return s.select(key, F.col("w.start").alias("began"), "ended", "n")


def suppress(events: DataFrame, writes: DataFrame, seconds: int = 5, key: str = "note_id") -> DataFrame:
    """Events of a key that don't follow one of our own writes within the window (writes: key, written_at)."""
    e, w = events.alias("e"), writes.alias("w")
    inside = (F.col(f"e.{key}") == F.col(f"w.{key}")) & (F.col("e.ts") >= F.col("w.written_at")) & (F.col("e.ts") < F.col("w.written_at") + F.expr(f"interval {seconds} seconds"))
    return e.join(w, inside, "left_anti")


def after_failure(events: DataFrame, seconds: int = 600, key: str = "note_id") -> DataFrame:
    """events with blocked: the key failed less than the cooldown ago."""
    before = F.max(F.when(F.col("failed"), F.col("ts"))).over(Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("_f", before).withColumn("blocked", F.coalesce(F.col("ts") < F.col("_f") + F.expr(f"interval {seconds} seconds"), F.lit(False))).drop("_f")


class RateLimit:
    """State per key of a fixed window that begins with the first failure: for batches in order and for streams."""

    def __init__(self, most: int = 5, seconds: float = 60.0):
        self.most, self.seconds = most, seconds
        self.began: dict = {}

    def refuse(self, key, at: float, failed: bool) -> bool:
        began, n = self.began.get(key, (at, 0))
        if at - began >= self.seconds:
            began, n = at, 0
        refused = n >= self.most
        if failed and not refused:
            n += 1
        if n:
            self.began[key] = (began, n)
        return refused


def rate_limited(events: DataFrame, most: int = 5, seconds: float = 60.0, key: str = "note_id") -> DataFrame:
    """event_id, refused. Rows of a key are streamed through one state in order of time; keys are spread over tasks."""
    rows = events.select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "failed")
    rows = rows.repartition(key).sortWithinPartitions(key, "at", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, now = RateLimit(most, seconds), None
        for b in batches:
            out = []
            for k, at, failed in zip(b[key], b["at"], b["failed"], strict=True):
                if k != now:
                    state.began.clear()
                    now = k
                out.append(state.refuse(k, at / 1e6, bool(failed)))
            yield pd.DataFrame({"event_id": b["event_id"], "refused": out})

    return rows.mapInPandas(run, "event_id long, refused boolean")


def bounded_buffer(keys: list, most: int = 1000) -> tuple[list, list]:
    """Waiting keys in order and those dropped: a new key beyond the bound drops the first; a waiting key keeps its place."""
    waiting: dict = {}
    dropped = []
    for k in keys:
        if k not in waiting and len(waiting) >= most:
            dropped.append(first := next(iter(waiting)))
            del waiting[first]
        waiting[k] = True
    return list(waiting), dropped


def _ranges(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df dealt over ranges of the order, each with its number as _part; staged, as it is read more than once."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return staged(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), name)


def _before(parts: DataFrame, carried: dict[str, Column]) -> DataFrame:
    """_part and what the ranges before it leave: aggregates over a row per range."""
    line = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(parts.select("_part", *(c.over(line).alias(n) for n, c in carried.items())))


def flushes(events: DataFrame, gap: str, key: str = "note_id") -> DataFrame:
    """flush_at and key of every note that a flush takes: the second debounce, with one timer for all keys.

    Debounced notes whose timers fire closer than gap go in one flush, a gap after the last. The timers are cut into ranges
    of time; a range learns the last timer and the number of flushes of those before it from a row per range, so neither the
    timers nor a flush that takes most notes lie in one task. A null time fires nothing.
    """
    span = F.expr(f"interval {gap}")
    fired = debounce(events.where("ts IS NOT NULL"), gap, key).select(key, (F.col("ended") + span).alias("ts"))
    fired = _ranges(fired, [F.col("ts"), F.xxhash64(key)], "fired")
    line = Window.partitionBy("_part").orderBy("ts")
    rows = fired.withColumn("_last", F.lag("ts").over(line))
    ends = _before(fired.groupBy("_part").agg(F.max("ts").alias("_max")), {"_upto": F.max("_max")})
    begins = rows.join(ends, "_part").withColumn("_last", F.coalesce("_last", "_upto"))
    begins = begins.withColumn("_new", (F.col("_last").isNull() | (F.col("ts") >= F.col("_last") + span)).cast("long"))
    begins = staged(begins.select(key, "ts", "_part", "_new"), "flush-begins")
    numbers = _before(begins.groupBy("_part").agg(F.sum("_new").alias("_sum")), {"_earlier": F.sum("_sum")})
    upto = F.sum("_new").over(line.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = begins.withColumn("_upto", upto).join(numbers, "_part").select(key, "ts", (F.col("_upto") + F.coalesce("_earlier", F.lit(0))).alias("_flush"))
    each = staged(numbered.groupBy("_flush", key).agg(F.max("ts").alias("ts")), "flush-notes")
    last = each.groupBy("_flush").agg((F.max("ts") + span).alias("flush_at"))
    return each.join(staged(last, "flush-ends"), "_flush").select("flush_at", key)


def flush_batches(events: DataFrame, gap: str, key: str = "note_id") -> DataFrame:
    """flush_at, notes (sorted), n of flushes(), for flushes whose notes fit a row (the buffer holds a bounded number)."""
    return flushes(events, gap, key).groupBy("flush_at").agg(F.array_sort(F.collect_set(key)).alias("notes"), F.count(F.lit(1)).alias("n"))


def gate(requests: DataFrame, locks: DataFrame) -> DataFrame:
    """requests(request_id, ts) with deferred and run_at: what comes while locked (locks: began, ended) waits for the unlock.

    Requests and locks are merged in order of time; each request sees the last lock before it, across ranges by a row per
    range, so no lock is sent to every task and the work grows with requests and locks together. A lock without an end holds
    what comes for good (run_at null). Locks don't overlap; one without a beginning is none; a request without a time isn't held.
    """
    lock = F.struct("began", "ended")
    own = F.struct(*requests.columns)
    moments = requests.select("ts", F.lit(1).alias("_kind"), F.xxhash64("request_id").alias("_deal"), own.alias("_own"))
    of_lock = locks.where("began IS NOT NULL").select(F.col("began").alias("ts"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_deal"), lock.alias("_lock"))
    rows = _ranges(moments.unionByName(of_lock, allowMissingColumns=True), [F.col(c) for c in ("ts", "_kind", "_deal")], "gate")
    line = Window.partitionBy("_part").orderBy("ts", "_kind", "_deal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = rows.where("_kind = 0").groupBy("_part").agg(F.max_by("_lock", "ts").alias("_end"))
    every = rows.select("_part").distinct().join(last, "_part", "left")
    seen = rows.withColumn("_seen", F.last("_lock", ignorenulls=True).over(line)).where("_kind = 1")
    seen = seen.join(_before(every, {"_earlier": F.last("_end", ignorenulls=True)}), "_part").withColumn("_seen", F.coalesce("_seen", "_earlier"))
    ended = F.col("_seen.ended")
    held = F.coalesce(F.col("_seen").isNotNull() & F.col("ts").isNotNull() & (ended.isNull() | (F.col("ts") < ended)), F.lit(False))
    return seen.select("_own.*", held.alias("deferred"), F.when(held, ended).otherwise(F.col("ts")).alias("run_at"))


def on_unlock(gated: DataFrame, locks: DataFrame) -> DataFrame:
    """run_at, kind, request_id, ts of what an unlock sets off: the deferred requests (`deferred`), and one scan of all (`catch-up`).

    To be run in order of run_at, kind descending, ts and request_id; no order is made here, as one unlock may free most requests.
    """
    waiting = gated.where("deferred AND run_at IS NOT NULL").select("run_at", F.lit("deferred").alias("kind"), "request_id", "ts")
    scans = locks.where("began IS NOT NULL AND ended IS NOT NULL").select(F.col("ended").alias("run_at"), F.lit("catch-up").alias("kind")).distinct()
    return waiting.unionByName(scans, allowMissingColumns=True)


class Coalesce:
    """One run at a time: of requests that come while it is busy only the latest waits, and runs when it ends."""

    def __init__(self, busy: float):
        self.busy, self.until, self.waiting = busy, None, None

    def offer(self, request, at: float) -> list[tuple[object, float, str]]:
        """(request, time, `run` or `dropped`) that this request brings about."""
        out = []
        while self.until is not None and at >= self.until:
            if self.waiting is None:
                self.until = None
                break
            out.append((self.waiting, self.until, "run"))
            self.waiting, self.until = None, self.until + self.busy
        if self.until is None:
            self.until = at + self.busy
            return [*out, (request, at, "run")]
        if self.waiting is not None:
            out.append((self.waiting, at, "dropped"))
        self.waiting = request
        return out

    def end(self) -> list[tuple[object, float, str]]:
        return [] if self.waiting is None else [(self.waiting, self.until, "run")]


def coalesced(requests: DataFrame, busy: float, key: str = "pipeline") -> DataFrame:
    """key, request_id, at, outcome (`run` or `dropped`) of requests(key, request_id, ts), where each run takes `busy` seconds."""
    rows = requests.select(key, "request_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    rows = rows.repartition(key).sortWithinPartitions(key, "at", "request_id")
    schema = f"{key} {requests.schema[key].dataType.simpleString()}, request_id {requests.schema['request_id'].dataType.simpleString()}, at double, outcome string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, now = None, None
        for b in batches:
            out = []
            for k, r, at in zip(b[key], b["request_id"], b["at"], strict=True):
                if state is None or k != now:
                    out += [(now, *x) for x in (state.end() if state else [])]
                    state, now = Coalesce(busy), k
                out += [(k, *x) for x in state.offer(r, at)]
            yield pd.DataFrame(out, columns=[key, "request_id", "at", "outcome"])
        if state and (left := state.end()):
            yield pd.DataFrame([(now, *x) for x in left], columns=[key, "request_id", "at", "outcome"])

    return rows.mapInPandas(run, schema)


def _timed(events: DataFrame, watermark: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def _in_order(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(by, kind="stable")


def rate_limited_stream(events: DataFrame, most: int = 5, seconds: float = 60.0, key: str = "note_id", watermark: str = "10 minutes") -> DataFrame:
    """event_id, refused as a stream: the window's begin and count are the key's state, and go when a window has passed."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        limit = RateLimit(most, seconds)
        if state.exists:
            limit.began[0] = state.get
        rows = _in_order(batches, ["ts", "event_id"])
        refused = [limit.refuse(0, t.timestamp(), bool(f)) for t, f in zip(rows["ts"], rows["failed"], strict=True)]
        if 0 in limit.began:
            state.update((float(limit.began[0][0]), int(limit.began[0][1])))
            state.setTimeoutTimestamp(max(int((limit.began[0][0] + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows["event_id"], "refused": refused})

    return _timed(events, watermark).groupBy(key).applyInPandasWithState(run, "event_id long, refused boolean", "began double, n long", "append", "EventTimeTimeout")


def buffered_stream(events: DataFrame, most: int = 1000, queue: str = "queue", key: str = "note_id") -> DataFrame:
    """queue, key, outcome as a stream: what a queue's bounded buffer takes in (`waiting`) and drops (`dropped`) for it; the buffer is the state."""
    kind, queues = (events.schema[c].dataType.simpleString() for c in (key, queue))

    def run(q: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        waiting = dict.fromkeys(state.get[0]) if state.exists else {}
        out = []
        for k in _in_order(batches, ["ts", "event_id"])[key].tolist():
            if k not in waiting:
                if len(waiting) >= most:
                    out.append((q[0], first := next(iter(waiting)), "dropped"))
                    del waiting[first]
                out.append((q[0], k, "waiting"))
            waiting[k] = None
        state.update((list(waiting),))
        yield pd.DataFrame(out, columns=[queue, key, "outcome"])

    return events.groupBy(queue).applyInPandasWithState(run, f"{queue} {queues}, {key} {kind}, outcome string", f"waiting array<{kind}>", "append", "NoTimeout")


def coalesced_stream(requests: DataFrame, busy: float, key: str = "pipeline", watermark: str = "10 minutes") -> DataFrame:
    """coalesced() as a stream; a waiting request runs when event time passes the end of the run before it."""
    rid, kind = (requests.schema[c].dataType.simpleString() for c in ("request_id", key))

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        c = Coalesce(busy)
        if state.exists:
            c.until, waiting, some = state.get
            c.waiting = waiting if some else None
        out = []
        if state.hasTimedOut:
            out = c.end()
            c.until, c.waiting = (c.until + busy, None) if out else (None, None)
        else:
            rows = _in_order(batches, ["ts", "request_id"])
            for r, t in zip(rows["request_id"].tolist(), rows["ts"], strict=True):
                out += c.offer(r, t.timestamp())
        if c.until is None:
            state.remove()
        else:
            state.update((float(c.until), c.waiting if c.waiting is not None else 0, c.waiting is not None))
            state.setTimeoutTimestamp(max(int(c.until * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(k[0], *x) for x in out], columns=[key, "request_id", "at", "outcome"])

    return _timed(requests, watermark).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, request_id {rid}, at double, outcome string", f"until double, waiting {rid}, some boolean", "append", "EventTimeTimeout")


def suppressed_stream(events: DataFrame, writes: DataFrame, seconds: int = 5, key: str = "note_id", watermark: str = "10 minutes") -> DataFrame:
    """Events of a stream that don't follow one of our own writes within the window: an interval join with what was written, by watermarks."""
    e = events.withWatermark("ts", watermark).alias("e")
    w = writes.withColumnRenamed(key, "_key").withWatermark("written_at", watermark).alias("w")
    inside = F.expr(f"e.{key} = w._key AND w.written_at <= e.ts AND w.written_at > e.ts - interval {seconds} seconds")
    both = e.join(w, inside, "leftOuter")
    return both.where("_key IS NULL").select("e.*")
