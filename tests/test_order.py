"""Rules over one global order, cut into ranges of time, against plain loops."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from noteforge.streaming import events as ev

BEGAN = datetime(2024, 1, 1)


def at(s):
    return None if s is None else BEGAN + timedelta(seconds=s)


def test_gate_sees_the_last_lock_across_ranges(spark):
    r = random.Random(1)
    times = [r.randrange(2000) for _ in range(400)] + [700] * 200 + [None]
    rows = [(i, at(t), "mine") for i, t in enumerate(times)]
    locks = [(at(100), at(150)), (at(650), at(760)), (at(760), at(761)), (at(900), at(900)), (None, at(5000)), (at(1900), None)]
    req = spark.createDataFrame(rows, "request_id long, ts timestamp_ntz, began string")
    held = spark.createDataFrame(locks, "began timestamp_ntz, ended timestamp_ntz")

    def plain(t, locks):
        if t is not None:
            for b, e in locks:
                if b is not None and b <= t and (e is None or t < e):
                    return True, e
        return False, t

    for some in (locks, locks[:1], []):
        got = ev.gate(req, held.where(F.col("began").isin([b for b, _ in some if b]) | F.lit(len(some) == len(locks))))
        assert got.columns == ["request_id", "ts", "began", "deferred", "run_at"]
        assert {x.request_id: (x.deferred, x.run_at) for x in got.collect()} == {i: plain(t, some) for i, t, _ in rows}
    out = ev.on_unlock(ev.gate(req, held), held).collect()
    waiting = {(e, i) for i, t, _ in rows for d, e in [plain(t, locks)] if d and e}
    assert {(x.run_at, x.request_id) for x in out if x.kind == "deferred"} == waiting
    assert sorted(x.run_at for x in out if x.kind == "catch-up") == sorted(e for b, e in locks if b and e)
    assert ev.gate(req.limit(0), held).count() == 0


def test_flushes_over_one_timer_for_all_keys(spark):
    r = random.Random(2)
    rows = [(f"n{r.randrange(12)}", at(r.randrange(600)) if i % 3 else at(r.choice([50, 300]))) for i in range(150)] + [("n1", None)]
    df = spark.createDataFrame(rows, "note_id string, ts timestamp_ntz")

    def plain(gap):
        fired = []
        for key in {k for k, _ in rows}:
            own = sorted(t for k, t in rows if k == key and t)
            fired += [(t + gap, key) for t, after in zip(own, [*own[1:], None]) if after is None or after - t >= gap]
        out, batch = set(), []
        for t, key in [*sorted(fired), (None, None)]:
            if batch and (t is None or t - batch[-1][0] >= gap):
                out.add((batch[-1][0] + gap, tuple(sorted({k for _, k in batch}))))
                batch = []
            batch.append((t, key))
        return out

    for ms in (3500, 7500, 1_000_500):
        got = {(x.flush_at, tuple(x.notes)) for x in ev.flush_batches(df, f"{ms} milliseconds").collect()}
        assert got == plain(timedelta(milliseconds=ms))
    assert ev.flushes(df.limit(0), "3 seconds").count() == 0
