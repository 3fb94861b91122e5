"""Paged discovery and the task queue, as streams that stop and go on."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.plans.registry import Tables, query
from gneiss.shared import scratch, spread
from gneiss.streaming import jobs, queue

SINCE = "2024-01-15 00:00:00"
ALL_FILES = 2**31 - 1


def _posts(t: Tables):
    """Events as posts: some are imported with an earlier time, some have none."""
    at = F.when(F.col("event_id") % 77 == 0, F.lit(None)).when(F.col("event_id") % 50 == 0, F.col("ts") - F.expr("INTERVAL 20 DAYS")).otherwise(F.col("ts"))
    return t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("topic"), at.alias("created"))


@query("str_2b_backfill", f"""SELECT event_id AS id, user_id AS topic FROM (SELECT *, CASE WHEN event_id % 77 = 0 THEN NULL WHEN event_id % 50 = 0 THEN ts - INTERVAL 20 DAYS ELSE ts END AS created FROM events)
 WHERE created IS NULL OR created >= TIMESTAMP '{SINCE}'""")
def _(t):
    """All posts since a day, through pages of a listing by falling ids, three runs of some pages each and then the rest:
    every run takes up where the one before it stopped."""
    posts = _posts(t)
    size = max(posts.count() // 12, 1)
    _, folder, _ = queue.discover(posts, "id", "created", SINCE, size, 2, runs=2)
    found, _, _ = queue.discover(posts, "id", "created", SINCE, size, 6, folder=folder)
    return found.select("id", "topic")


STR_3 = f"""WITH RECURSIVE e AS (SELECT user_id AS topic, epoch_us(ts) AS t_us, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'ok' ELSE 'discovered' END AS kind, event_id % 10 AS p, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS i FROM events),
 s AS (SELECT DISTINCT topic, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS status, CAST(0 AS BIGINT) AS priority, CAST(0 AS BIGINT) AS next_us, CAST(0 AS BIGINT) AS attempts FROM e UNION ALL
  SELECT topic, i, CASE kind WHEN 'failed' THEN 'retry' WHEN 'ok' THEN 'done' ELSE CASE WHEN was = 'retry' THEN 'retry' ELSE 'pending' END END,
   CASE WHEN was IS NULL THEN p WHEN kind <> 'discovered' OR was = 'retry' THEN priority WHEN was = 'pending' THEN least(priority, p) ELSE p END,
   CASE WHEN kind = 'failed' THEN t_us + {queue.PAUSE * 1000000} * least(CAST(pow(2, attempts) AS BIGINT), {queue.LONGEST}) WHEN kind = 'ok' OR was IS NULL OR was = 'done' THEN t_us ELSE next_us END,
   CASE kind WHEN 'failed' THEN attempts + 1 WHEN 'ok' THEN 0 ELSE attempts END
  FROM (SELECT e.topic, e.i, e.kind, e.t_us, e.p, CASE WHEN s.status = 'retry' AND s.next_us <= e.t_us THEN 'pending' ELSE s.status END AS was, s.priority, s.next_us, s.attempts FROM s JOIN e ON e.topic = s.topic AND e.i = s.i + 1))
 SELECT topic, CASE WHEN status = 'retry' AND next_us <= (SELECT max(t_us) FROM e) THEN 'pending' ELSE status END AS status, priority, next_us, attempts FROM s QUALIFY i = max(i) OVER (PARTITION BY topic)"""


@query("str_3b_task_queue", STR_3)
def _(t):
    """The tasks of all events: found, failed and done; the events come in four slices of time, each of them a batch of
    files that all tasks write, and the stream is stopped and started again after every slice."""
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "ok").otherwise("discovered")
    at = F.col("ts").cast("timestamp")
    events = t.events.select(F.col("user_id").alias("topic"), at.alias("at"), F.unix_micros(at).alias("at_us"), "event_id", kind.alias("kind"), (F.col("event_id") % 10).cast("int").alias("priority"))
    ends = events.agg(F.min("at_us").alias("a"), F.max("at_us").alias("b")).first()
    folder, cuts = scratch(t.spark, "queue"), [ends["a"] + (ends["b"] - ends["a"]) * i // 4 for i in range(1, 4)]
    part = sum((F.col("at_us") > c).cast("int") for c in cuts)
    for i in range(4):
        spread(events.filter(part == i)).write.mode("append").parquet(f"{folder}/events")
        # All files of a slice are one batch: in a batch of some of them the newest event would make others late.
        stream = jobs.folder(t.spark, f"{folder}/events", "*.parquet", events.schema, ALL_FILES)
        changes = queue.queue_changes(stream, "1 minute", folder)
    return queue.tasks_at(changes)
