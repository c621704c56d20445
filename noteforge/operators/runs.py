"""Runs: queue order, history, roll-ups, schedules; chats: histories, prompts, context blocks."""

from __future__ import annotations

import heapq
import itertools
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteforge.functions.text import cron_matches, cut_error

#: Trigger -> priority (fixed values).
PRIORITY = {"manual": 4, "cli": 3, "event": 2, "schedule": 1}


def queue_order(runs: DataFrame) -> DataFrame:
    """runs with place: priority first, then time of entry. Meant for one queue's open runs, which one process works off."""
    return runs.withColumn("place", F.row_number().over(Window.partitionBy("queue").orderBy(F.desc("priority"), "enqueued_at", "id")).cast("long"))


def history(runs: DataFrame, pipeline: str | None = None, status: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the run log, latest first; filters only where given."""
    if pipeline is not None:
        runs = runs.where(F.col("pipeline") == pipeline)
    if status is not None:
        runs = runs.where(F.col("status") == status)
    return runs.orderBy(F.desc("started_at"), F.desc("id")).offset(offset).limit(limit)


def last_run(runs: DataFrame) -> DataFrame:
    """The run that began last."""
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(1)


def run_by_id(runs: DataFrame, run_id: object) -> DataFrame:
    return runs.where(F.col("id") == run_id)


def rollup(phases: DataFrame, counts: list[str]) -> DataFrame:
    """batch_id, the sums of counts, phases and errors (joined by `; `, in order) of phases(batch_id, place, errors, ...)."""
    errors = F.array_sort(F.collect_list(F.when(F.coalesce("errors", F.lit("")) != "", F.struct("place", "errors"))))
    g = phases.groupBy("batch_id").agg(*(F.sum(c).alias(c) for c in counts), F.count(F.lit(1)).alias("phases"), errors.alias("_e"))
    return g.withColumn("errors", F.array_join(F.transform("_e", lambda e: e["errors"]), "; ")).drop("_e")


def run_rows(events: DataFrame) -> DataFrame:
    """The run log's last row of each id: events(id, pipeline, batch_id, at, status, processed, errors), the first of which is `running`.

    started_at is that of the first row, finished_at that of a row that isn't `running`; errors are cut to 1,000 signs.
    """
    last = F.max_by(F.struct("status", "processed", "errors"), F.struct("at", (F.col("status") != "running").cast("int")))
    g = events.groupBy("id").agg(F.min_by("pipeline", "at").alias("pipeline"), F.min_by("batch_id", "at").alias("batch_id"), F.min("at").alias("started_at"), F.max(F.when(F.col("status") != "running", F.col("at"))).alias("finished_at"), last.alias("l"))
    return g.select("id", "pipeline", "batch_id", "started_at", "finished_at", "l.status", "l.processed", cut_error(F.col("l.errors")).alias("errors"))


#: A run's counts.
COUNTS = ("processed", "chunks", "entities", "relations", "skipped")


@dataclass
class Run:
    id: str
    pipeline: str
    scope: dict
    trigger: str = "manual"
    batch_id: str | None = None
    status: str = "queued"
    counts: dict = field(default_factory=lambda: dict.fromkeys(COUNTS, 0))
    errors: list[str] = field(default_factory=list)
    started_at: float | None = None
    finished_at: float | None = None


class Runner:
    """Works off runs one at a time on the driver, by priority and then by entry.

    pipelines: name -> function of (scope, progress, cancelled) that gives counts and errors; the work itself is Spark's. While
    locked() nothing starts; release() goes on. Listeners get (run, processed, total, id). Rows for the run log come from log().
    """

    def __init__(self, pipelines: dict[str, Callable], locked: Callable[[], bool] = lambda: False, clock: Callable[[], float] | None = None):
        import time

        self.pipelines, self.locked, self.clock = pipelines, locked, clock or time.time
        self.queue: list = []
        self.entry = itertools.count()
        self.runs: dict[str, Run] = {}
        self.current: Run | None = None
        self.listeners: list[Callable] = []
        self.progress: tuple[int, int] = (0, 0)

    def enqueue(self, pipeline: str, scope: dict, trigger: str = "manual", batch_id: str | None = None) -> str:
        if pipeline not in self.pipelines:
            raise ValueError(f"unknown pipeline {pipeline!r}")
        run = Run(uuid.uuid4().hex, pipeline, scope, trigger, batch_id)
        self.runs[run.id] = run
        heapq.heappush(self.queue, (-PRIORITY.get(trigger, 0), next(self.entry), run.id))
        return run.id

    def snapshot(self) -> list[str]:
        """Waiting runs, the next one first."""
        return [i for _, _, i in sorted(self.queue) if self.runs[i].status == "queued"]

    def cancel(self, run_id: str) -> bool:
        run = self.runs.get(run_id)
        if run is None or run.status not in ("queued", "running"):
            return False
        if run.status == "queued":
            run.finished_at = self.clock()
        run.status = "cancelled"
        return True

    def clear(self) -> None:
        for i in self.snapshot():
            self.cancel(i)
        self.queue.clear()

    def work(self, most: int | None = None) -> int:
        """Work off waiting runs (at most `most`) until none is left or a lock comes; their number."""
        done = 0
        while self.queue and not self.locked() and (most is None or done < most):
            run = self.runs[heapq.heappop(self.queue)[2]]
            if run.status != "queued":
                continue
            run.status, run.started_at, self.current = "running", self.clock(), run

            def tell(processed: int, total: int, what: object = None, run: Run = run) -> None:
                self.progress = (processed, total)
                for listener in self.listeners:
                    listener(run, processed, total, what)

            try:
                counts, errors = self.pipelines[run.pipeline](run.scope, tell, lambda run=run: run.status == "cancelled")
                run.counts |= {k: v for k, v in counts.items() if k in COUNTS}
                run.errors = list(errors)
                if run.status != "cancelled":
                    run.status = "failed" if errors and not run.counts["processed"] else "success"
            except Exception as e:
                run.status, run.errors = "failed", [*run.errors, str(e)[:1000]]
            finally:
                run.finished_at, self.current, self.progress = self.clock(), None, (0, 0)
            done += 1
        return done

    def log(self, spark) -> DataFrame:
        """id, pipeline, batch_id, scope (JSON with the batch), trigger, status, counts, errors, started_at, finished_at of every run."""
        rows = [(r.id, r.pipeline, r.batch_id, json.dumps({**r.scope, "batchId": r.batch_id}), r.trigger, r.status, *(int(r.counts[c]) for c in COUNTS), "; ".join(r.errors)[:1000], r.started_at, r.finished_at) for r in self.runs.values()]
        return spark.createDataFrame(rows, "id string, pipeline string, batch_id string, scope string, trigger string, status string, " + ", ".join(f"{c} long" for c in COUNTS) + ", errors string, started_at double, finished_at double")


def run_batch(runner: Runner, scope: dict, pipeline: str = "both", trigger: str = "manual", batch_id: str | None = None) -> dict:
    """The summed counts and all errors of a batch: `both` runs structural, then semantic under one batch id.

    If a lock came in between or the first was cancelled, its result stands alone and the second isn't begun.
    """
    batch_id = batch_id or f"batch_{uuid.uuid4().hex[:8]}"
    total: dict = {**dict.fromkeys(COUNTS, 0), "errors": [], "batch_id": batch_id, "runs": []}
    for name in ("structural", "semantic") if pipeline == "both" else (pipeline,):
        if runner.locked() and total["runs"]:
            break
        run = runner.runs[runner.enqueue(name, scope, trigger, batch_id)]
        runner.work()
        total["runs"].append(run.id)
        for c in COUNTS:
            total[c] += run.counts[c]
        total["errors"] += run.errors
        if run.status == "cancelled":
            break
    return total


def last_state(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """The last row of each key: an append-only log as current states."""
    rest = [c for c in rows.columns if c != key and c not in by]
    return rows.groupBy(key).agg(F.max(F.struct(*by, *rest)).alias("_m")).select(key, "_m.*")


def run_status(errors: Column, processed: Column, aborted: Column | None = None) -> Column:
    s = F.when((errors > 0) & (processed == 0), "failed").otherwise("success")
    return s if aborted is None else F.when(aborted, "cancelled").otherwise(s)


def cron_ticks(spark, start: str, end: str, cron: str) -> DataFrame:
    """Minutes of [start, end] at which the schedule is due."""
    ticks = spark.range(1).select(F.explode(F.sequence(F.to_timestamp_ntz(F.lit(start)), F.to_timestamp_ntz(F.lit(end)), F.expr("interval 1 minute"))).alias("tick"))
    return ticks.where(cron_matches(F.col("tick"), cron))


def trim_history(messages: DataFrame, budget: int, base: int | str = 0) -> DataFrame:
    """The newest messages of each conversation that fit the budget beside base (a number or a column), each at ceil(length / 4) + 2 tokens."""
    cost = F.ceil(F.length("content") / 4) + 2
    upto = F.sum(cost).over(Window.partitionBy("conversation_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0))
    return messages.withColumn("cost", upto.cast("long")).where(F.col("cost") + (F.col(base) if isinstance(base, str) else base) <= budget)


def regenerate(messages: DataFrame) -> DataFrame:
    """Messages up to each conversation's last user message; conversations without one stay whole."""
    last = F.max(F.when(F.col("role") == "user", F.col("seq"))).over(Window.partitionBy("conversation_id"))
    return messages.withColumn("_last", last).where("_last IS NULL OR seq <= _last").drop("_last")


def context_block(hits: DataFrame) -> DataFrame:
    """query_id, block: `[n] title` and content of each hit (place, title, content), parted by blank lines."""
    line = F.concat(F.lit("["), F.col("place"), F.lit("] "), F.col("title"), F.lit("\n"), F.col("content"))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda s: s["line"]), "\n\n").alias("block"))
