"""Discovery over paged listings, and a durable task queue as a keyed state machine with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from gneiss.shared import scratch, ship
from gneiss.sources.pages import PostPages, write_pages

#: First pause after a failure, and how many times as long the longest is, in seconds.
PAUSE, LONGEST = 3600, 24
#: Lanes that topics are dealt to by their hash. A call of Python, its state and its timer cost some thousand times what an
#: event does, and are paid for a lane, not for a topic. It must stay as it is for a state that is gone on with.
LANES = 1024
_FIELDS = ("status", "priority", "next_us", "attempts")
_STATE = "topic long, status string, priority int, next_us long, attempts int"
_CHANGE = "topic long, at_us long, event_id long, status string, priority int, next_us long, attempts int, cause string"
_COLUMNS = ["topic", "at_us", "event_id", "status", "priority", "next_us", "attempts", "cause"]


def discover(posts: DataFrame, id_: str, created: str, since: str | None, page: int, pages: int, runs: int | None = None, folder: str | None = None) -> tuple[DataFrame, str, bool]:
    """Posts found by a backfill through a listing of descending ids, the folder that holds its state, and whether the
    listing is read to its end. Each run reads `pages` pages and remembers where it was; given the folder, a later call
    goes on there. Posts created before `since` are left out but never end the scan, as older posts may have newer ids;
    posts without a time are kept. A page that does not go on below the one before it fails the run, offset unchanged."""
    spark = posts.sparkSession
    ship(spark)
    spark.dataSource.register(PostPages)
    if folder is None:
        folder = scratch(spark, "discovery")
        write_pages(posts, id_, folder, page)
    last = spark.read.json(f"{folder}/manifest").count()
    done = 0
    while True:
        stream = spark.readStream.format("gneiss_pages").schema(posts.schema).options(path=folder, id=id_, pages=pages, state=f"{folder}/cursor/page").load()
        wanted = stream if since is None else stream.filter(F.col(created).isNull() | (F.col(created) >= F.lit(since).cast(dict(posts.dtypes)[created])))
        query = wanted.writeStream.format("parquet").option("path", f"{folder}/found").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        done += 1
        at = _cursor(spark, folder)
        if at >= last or done == runs:
            break
    return spark.read.schema(posts.schema).parquet(f"{folder}/found"), folder, at >= last


def _cursor(spark: SparkSession, folder: str) -> int:
    """The page after the last one whose batch was committed."""
    committed = spark.read.text(f"{folder}/state/commits").select(F.input_file_name().alias("f")).distinct()
    batch = committed.select(F.max(F.regexp_extract("f", r"/(\d+)$", 1).cast("int"))).first()[0]
    return spark.read.text(f"{folder}/state/offsets/{batch}").filter(F.col("value").startswith('{"page"')).select(F.get_json_object("value", "$.page").cast("int")).first()[0]


def applied(state: dict | None, at_us: int, kind: str, priority: int) -> dict:
    """The state of a task after an event. A task whose pause is over is pending again before anything else.

    discovered: a new task is pending; of a pending one the better priority counts; a pause is never cut short; a done
    one is pending again. failed: a pause twice as long as the last. ok: done.
    """
    s = dict(state) if state else None
    if s and s["status"] == "retry" and s["next_us"] <= at_us:
        s["status"] = "pending"
    if kind == "discovered":
        if s is None:
            return {"status": "pending", "priority": priority, "next_us": at_us, "attempts": 0}
        if s["status"] == "pending":
            s["priority"] = min(s["priority"], priority)
        elif s["status"] == "done":
            s.update(status="pending", priority=priority, next_us=at_us)
        return s
    s = s or {"status": "pending", "priority": priority, "next_us": at_us, "attempts": 0}
    if kind == "failed":
        n = s["attempts"] + 1
        s.update(status="retry", attempts=n, next_us=at_us + PAUSE * min(1 << min(n - 1, 30), LONGEST) * 1_000_000)
    else:
        s.update(status="done", attempts=0, next_us=at_us)
    return s


def _changes(lane: int, out: list[tuple]) -> pd.DataFrame:
    """Rows of changes; the topic of the lane below zero is null."""
    rows = pd.DataFrame(out, columns=_COLUMNS)
    return rows if lane >= 0 else rows.assign(topic=None)


def _timer(tasks: dict) -> int | None:
    """The first millisecond at which a pause of these tasks is over."""
    return min((-(-s["next_us"] // 1000) for s in tasks.values() if s["status"] == "retry"), default=None)


class TaskQueue(StatefulProcessor):
    """Keyed by lane: rows (topic, at, at_us, event_id, kind, priority) change the states of its topics. A lane has one
    timer, for the pause that is over first; when it goes off, all pauses end that are over by then. Each change goes out
    with its cause."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tasks = handle.getListState("tasks", _STATE)

    def _now(self) -> dict:
        return {topic: dict(zip(_FIELDS, s)) for topic, *s in self.tasks.get()}

    def _kept(self, tasks: dict) -> None:
        self.tasks.put([(topic, *s.values()) for topic, s in tasks.items()])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at_us", "event_id"])
        tasks, out = self._now(), []
        was = _timer(tasks)
        for topic, at, event, kind, priority in zip(*(events[c].tolist() for c in ("topic", "at_us", "event_id", "kind", "priority"))):
            tasks[topic] = state = applied(tasks.get(topic), at, kind, priority)
            out.append((topic, at, event, *state.values(), kind))
        self._kept(tasks)
        now = _timer(tasks)
        if was is not None and was != now:
            self.handle.deleteTimer(was)
        if now is not None and was != now:
            self.handle.registerTimer(now)
        yield _changes(key[0], out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        tasks, over = self._now(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        due = {topic: s for topic, s in tasks.items() if s["status"] == "retry" and s["next_us"] <= over}
        if due:
            for s in due.values():
                s["status"] = "pending"
            self._kept(tasks)
            if (now := _timer(tasks)) is not None:
                self.handle.registerTimer(now)
            yield _changes(key[0], [(topic, s["next_us"], -1, *s.values(), "due") for topic, s in due.items()])

    def close(self) -> None:
        pass


def queue_changes(events: DataFrame, late: str, folder: str, name: str = "changes") -> DataFrame:
    """All changes of the tasks of a stream of events(topic, at, at_us, event_id, kind, priority), appended to a table.

    Runs over what is there; the state and the offsets are kept in the folder, so a later run over a grown source goes
    on from there, and a batch that is repeated after a failure writes the same part files again. Events must not be
    later than `late` behind the newest; those of a topic are applied in order within a batch. Python holds a lane's tasks
    and its events of a batch.
    """
    spark = events.sparkSession
    ship(spark)
    # Rows hold no texts: more of them at once take little memory.
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.execution.arrow.maxRecordsPerBatch": "10000"}
    before = {option: spark.conf.get(option, None) for option in wanted}
    for option, value in wanted.items():
        spark.conf.set(option, value)
    try:
        lane = F.when(F.isnull("topic"), -1).otherwise(F.pmod(F.hash("topic"), F.lit(LANES)))
        # A null among whole numbers would make floating-point ones of them in Python.
        lanes = events.withWatermark("at", late).withColumn("lane", lane).fillna(0, ["topic"])
        changes = lanes.groupBy("lane").transformWithStateInPandas(statefulProcessor=TaskQueue(), outputStructType=StructType.fromDDL(_CHANGE), outputMode="Append", timeMode="EventTime")
        changes.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for option, value in before.items():
            spark.conf.unset(option) if value is None else spark.conf.set(option, value)
    return spark.read.schema(_CHANGE).parquet(f"{folder}/{name}")


def tasks_at(changes: DataFrame, at_us: int | None = None) -> DataFrame:
    """(topic, status, priority, next_us, attempts) of every task as of a time (the last change's by default): its last
    change, with pauses that are over by then ended."""
    last = changes.groupBy("topic").agg(F.max_by(F.struct("status", "priority", "next_us", "attempts"), F.struct("at_us", "event_id")).alias("s"))
    horizon = F.lit(at_us) if at_us is not None else F.lit(changes.filter("cause <> 'due'").agg(F.max("at_us")).first()[0])
    due = (F.col("s.status") == "retry") & (F.col("s.next_us") <= horizon)
    return last.select("topic", F.when(due, "pending").otherwise(F.col("s.status")).alias("status"), "s.priority", "s.next_us", "s.attempts")
