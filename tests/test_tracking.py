"""Tracked jobs over several micro-batches against one pass over their events."""

import datetime
import random

from lodestone.streaming import tracking


def plain(rows, timeout_ms, mark):
    out = {}
    for user in {r[0] for r in rows}:
        own = sorted((at, i, e) for u, i, e, at in rows if u == user)
        status, made, gone, seen = tracking.moved("queued", 0, own[0][0], [(at, e) for at, _, e in own], timeout_ms)
        if status in tracking.GONE and seen + timeout_ms <= mark:
            status, made, gone = tracking.GONE[status], made + 1, True
        out[user] = (status, made, gone, seen)
    return out


def test_timers_over_micro_batches(spark, tmp_path):
    rng, start = random.Random(1), datetime.datetime(2024, 1, 1)
    rows, at = [], 0
    for i in range(600):
        at += rng.randrange(1, 400)
        rows.append((rng.randrange(12), i, rng.choice(["click", "view", "purchase", "error", "signup", "click"]), at * 1000))
    for k in range(4):  # in order of time, so nothing is late
        part = [(u, i, e, start + datetime.timedelta(milliseconds=t)) for u, i, e, t in rows[150 * k : 150 * k + 150]]
        spark.createDataFrame(part, "user_id long, event_id long, event_type string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema("user_id long, event_id long, event_type string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    got = {r.user_id: (r.status, r.transitions, r.reconciled, r.seen_ms) for r in tracking.tracked_jobs(stream, 1500, "60 seconds").collect()}
    zero = int(start.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    shifted = [(u, i, e, t + zero) for u, i, e, t in rows]
    want = plain(shifted, 1_500_000, max(r[3] for r in shifted) - 60_000)
    final = {u: s for u, s in want.items() if s[0] not in tracking.GONE}
    assert {u: s[:3] for u, s in got.items()} == {u: s[:3] for u, s in want.items()} and final and any(s[2] for s in want.values())


def test_moved_gives_up_silent_jobs():
    go = lambda *events: tracking.moved("queued", 0, 0, list(events), 100)[:3]
    assert go((0, "click"), (50, "view"), (149, "click")) == ("running", 3, False)
    assert go((0, "click"), (100, "view")) == ("failed", 2, True)
    assert go((0, "click"), (1, "error"), (200, "purchase")) == ("cancelled", 3, True)
    assert go((0, "click"), (1, "purchase"), (999, "click")) == ("completed", 2, False)
