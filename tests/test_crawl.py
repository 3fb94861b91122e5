"""Paged discovery and the task queue: stops, repeats, order, timers."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from gneiss.shared import scratch
from gneiss.sources.pages import PageReader, write_pages
from gneiss.streaming import jobs, queue


def posts(spark, n=53):
    return spark.createDataFrame([(3 * i, i % 5, None if i % 9 == 0 else f"2024-01-{1 + i % 28:02}") for i in range(n)], "id long, topic long, created string")


def test_stops_lose_and_repeat_nothing(spark):
    df = posts(spark)
    folder, seen = None, []
    for _ in range(6):
        found, folder, done = queue.discover(df, "id", "created", None, 10, 1, runs=1, folder=folder)
        seen.append(sorted(r["id"] for r in found.collect()))
    assert done and [len(s) for s in seen] == [10, 20, 30, 40, 50, 53]
    assert seen[0] == list(range(129, 159, 3)) and seen[-1] == list(range(0, 159, 3))
    again, _, done = queue.discover(df, "id", "created", None, 10, 1, folder=folder)
    assert done and again.count() == 53


def test_cutoff_filters_and_never_stops(spark):
    found, _, done = queue.discover(posts(spark), "id", "created", "2024-01-20", 7, 3)
    assert done and {r["id"] for r in found.collect()} == {3 * i for i in range(53) if i % 9 == 0 or 1 + i % 28 >= 20}


def test_a_page_that_does_not_go_on_below_fails_the_run_and_moves_nothing(spark):
    folder = scratch(spark, "broken")
    write_pages(posts(spark), "id", folder, 10)
    pages = spark.read.json(f"{folder}/manifest")
    bad = pages.withColumn("most", F.when(F.col("page") == 2, 999).otherwise(F.col("most"))).collect()
    spark.createDataFrame(bad, pages.schema).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    with pytest.raises(Exception, match="does not go on below"):
        queue.discover(posts(spark), "id", "created", None, 10, 2, folder=folder)
    reader = PageReader(posts(spark).schema, {"path": folder, "id": "id", "state": f"{folder}/cursor/page"})
    assert reader.planned() == 0


def test_rules_of_a_task():
    s = queue.applied(None, 0, "discovered", 5)
    assert s == {"status": "pending", "priority": 5, "next_us": 0, "attempts": 0}
    assert queue.applied(s, 1, "discovered", 9)["priority"] == 5 and queue.applied(s, 1, "discovered", 2)["priority"] == 2
    failed = queue.applied(s, 10, "failed", 0)
    assert failed["status"] == "retry" and failed["next_us"] == 10 + queue.PAUSE * 10**6
    assert queue.applied(failed, 20, "discovered", 0) == failed  # a pause is not cut short, its priority stays
    after = queue.applied(failed, failed["next_us"], "discovered", 0)
    assert after["status"] == "pending" and after["priority"] == 0
    for _ in range(9):
        failed = queue.applied(failed, 10, "failed", 0)
    assert failed["next_us"] == 10 + queue.PAUSE * queue.LONGEST * 10**6 and failed["attempts"] == 10
    done = queue.applied(failed, 30, "ok", 0)
    assert done["status"] == "done" and done["attempts"] == 0
    assert queue.applied(done, 40, "discovered", 7) == {"status": "pending", "priority": 7, "next_us": 40, "attempts": 0}


def test_timers_end_pauses_and_state_survives_a_stop(spark):
    r = random.Random(2)
    rows = sorted((r.randrange(40 * 3600), i, r.randrange(6), r.choice(("discovered", "failed", "ok")), r.randrange(9)) for i in range(300))
    events = spark.createDataFrame([(k, s * 10**6, i, kind, p) for s, i, k, kind, p in rows], "topic long, at_us long, event_id long, kind string, priority int").select("topic", F.timestamp_micros("at_us").alias("at"), "at_us", "event_id", "kind", "priority")
    folder = scratch(spark, "queue")
    for lo, hi in ((0, 20), (20, 41)):
        events.filter(f"at_us >= {lo} * 3600000000L AND at_us < {hi} * 3600000000L").repartition(1).write.mode("append").parquet(f"{folder}/events")
        changes = queue.queue_changes(jobs.folder(spark, f"{folder}/events", "*.parquet", events.schema, 1), "1 minute", folder)
    states = {}
    for s, i, k, kind, p in rows:
        states[k] = queue.applied(states.get(k), s * 10**6, kind, p)
    last = max(s for s, *_ in rows) * 10**6
    for s in states.values():
        if s["status"] == "retry" and s["next_us"] <= last:
            s["status"] = "pending"
    got = {x["topic"]: {c: x[c] for c in ("status", "priority", "next_us", "attempts")} for x in queue.tasks_at(changes).collect()}
    assert got == states
    assert changes.filter("cause = 'due'").count() > 0 and changes.filter("cause <> 'due'").count() == len(rows)


class Handle:
    """What a lane's processor sees of its state: one list, and timers in milliseconds."""

    def __init__(self):
        self.rows, self.timers, self.puts = [], set(), 0

    def getListState(self, *_):
        return self

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows, self.puts = rows, self.puts + 1

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


def test_a_lane_is_one_call_one_state_and_one_timer():
    handle, lane = Handle(), queue.TaskQueue()
    lane.init(handle)

    def fed(*rows):
        return pd.concat(lane.handleInputRows((3,), iter([pd.DataFrame(rows, columns=["topic", "at_us", "event_id", "kind", "priority"])]), None))

    hour = queue.PAUSE * 1000
    out = fed((7, 500, 2, "failed", 1), (8, 100, 1, "discovered", 4), (9, 2_000_000, 3, "failed", 5))
    assert out["topic"].tolist() == [8, 7, 9] and handle.puts == 1 and handle.timers == {hour + 1}  # 7's pause ends within that millisecond
    fed((7, 3_000_000, 4, "ok", 1))
    assert handle.timers == {hour + 2000}
    clock = lambda ms: (TimerValues(0, ms), ExpiredTimerInfo(ms))
    assert not list(lane.handleExpiredTimer((3,), *clock(hour + 1999)))
    handle.timers.clear()  # Spark removes a timer that went off
    fed((7, 4_000_500, 5, "failed", 1))
    (due,) = lane.handleExpiredTimer((3,), *clock(hour + 2500))
    assert due[["topic", "status", "cause"]].values.tolist() == [[9, "pending", "due"]] and handle.timers == {hour + 4001}
    (due,) = lane.handleExpiredTimer((3,), *clock(hour + 4001))
    assert due["topic"].tolist() == [7] and dict((t, s) for t, s, *_ in handle.rows) == {7: "pending", 8: "pending", 9: "pending"}


def test_state_is_kept_by_lanes_not_by_topics(spark):
    wide = 2**53 + 1  # not a floating-point number
    topics = [None, 0, *range(wide, wide + 2500)]
    rows = [(t, s * 10**6, 3 * i + s, ("discovered", "failed", "ok")[(i + s) % 3], i % 9) for i, t in enumerate(topics) for s in range(2)]
    events = spark.createDataFrame(rows, "topic long, at_us long, event_id long, kind string, priority int").select("topic", F.timestamp_micros("at_us").alias("at"), "at_us", "event_id", "kind", "priority")
    folder = scratch(spark, "queue")
    events.write.parquet(f"{folder}/events")
    changes = queue.queue_changes(jobs.folder(spark, f"{folder}/events", "*.parquet", events.schema), "1 minute", folder)
    states = {}
    for t, at, _, kind, p in rows:
        states[t] = queue.applied(states.get(t), at, kind, p)
    assert {x["topic"]: {c: x[c] for c in ("status", "priority", "next_us", "attempts")} for x in queue.tasks_at(changes).collect()} == states
    kept = spark.read.format("statestore").option("path", f"{folder}/state").option("stateVarName", "tasks").load()
    assert kept.select("key").distinct().count() <= queue.LANES + 1 and kept.select("list_element.topic").count() == len(topics)
