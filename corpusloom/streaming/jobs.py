"""Structured Streaming jobs, each with a batch twin in operators."""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def start(rows: DataFrame, checkpoint: str, mode: str = "append", every: str | None = None, **sink) -> StreamingQuery:
    """Write a stream to a memory table (name=) or call a function per batch (each=); all there is now, or at an interval."""
    w = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=every) if every else w.trigger(availableNow=True)
    return w.foreachBatch(sink["each"]).start() if "each" in sink else w.format("memory").queryName(sink["name"]).start()


def counted(rows: DataFrame, name: str, **measures) -> DataFrame:
    """rows with named counters (aggregates) that each batch reports in its progress, as ``query.lastProgress.observedMetrics``."""
    return rows.observe(name, *(c.alias(k) for k, c in measures.items()))


class Totals(StreamingQueryListener):
    """Adds up the counters of ``counted`` over every batch of a query, as the progress of each batch is told, and not from the query's
    recent progress, of which Spark keeps a hundred batches."""

    def __init__(self, name: str):
        self.name, self.sums, self.batches, self.ended = name, Counter(), set(), threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        got = event.progress.observedMetrics.get(self.name)
        key = (event.progress.runId, event.progress.batchId)
        if got is not None and key not in self.batches:
            self.batches.add(key)
            self.sums.update({k: v or 0 for k, v in got.asDict().items()})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.set()


def totals(rows: DataFrame, name: str, checkpoint: str, each: Callable[[DataFrame, int], None]) -> Totals:
    """Run a stream with counters over all there is now, and return their totals when its last batch was told."""
    spark, heard = rows.sparkSession, Totals(name)
    spark.streams.addListener(heard)
    try:
        start(rows, checkpoint, each=each).awaitTermination()
        heard.ended.wait(60)
    finally:
        spark.streams.removeListener(heard)
    return heard


def first_of_content(rows: DataFrame, at: str, column: str, delay: str = "10 minutes") -> DataFrame:
    """Rows whose content has not been seen within the watermark."""
    return rows.withColumn("_hash", F.sha2(F.col(column).cast("binary"), 256)).withWatermark(at, delay).dropDuplicatesWithinWatermark(["_hash"]).drop("_hash")


def windowed_health(audit: DataFrame, window: str = "5 minutes", slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Rows, mean latency, and shares of errors and cache hits by sliding window over audit rows (ts timestamp)."""
    share = lambda c: F.avg(c.cast("int"))
    w = audit.withWatermark("ts", delay).groupBy(F.window("ts", window, slide).alias("w"))
    return w.agg(F.count("*").alias("n"), F.avg("latency_ms").alias("mean_ms"), share(F.col("crag_decision") == "INCORRECT").alias("error_share"), share(F.col("served_by") == "cache").alias("cache_share")).select("w.start", "w.end", "n", "mean_ms", "error_share", "cache_share")


def running_sessions(messages: DataFrame) -> DataFrame:
    """Counts and flags of each session so far; for update mode."""
    low = F.coalesce(F.col("confidence") < 0.75, F.lit(False)) | F.coalesce(F.col("crag_decision") == "INCORRECT", F.lit(False))
    return messages.groupBy("session_id").agg(F.count("*").alias("message_count"), F.max(low.cast("int")).alias("low"), F.sum(F.when(F.col("feedback") == "up", 1).when(F.col("feedback") == "down", -1).otherwise(0)).alias("score"))


def inactivity_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", "s.start", "s.end", "n")


def admitted(times: list[int], seconds: int, limit: int, history: list[int]) -> tuple[list[bool], list[int]]:
    """Which attempts (sorted, microseconds) a limiter lets in that counts only those it let in within the last seconds."""
    out = []
    for t in times:
        history = [h for h in history if h > t - seconds * 1_000_000]
        ok = len(history) < limit
        if ok:
            history.append(t)
        out.append(ok)
    return out, history


#: Seconds that event times of keyed state are moved on: Spark's first watermark is 1970, and it drops rows that are not later than that.
MOVED_S = 100 * 365 * 86_400


def _expire_at(handle: StatefulProcessorHandle, at_ms: int) -> None:
    """One event-time timer for a key, at the given time before it is moved on."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(at_ms + MOVED_S * 1000)


class Limiter(StatefulProcessor):
    """Keeps the times of a client's admitted attempts, until the last of them no longer counts."""

    def __init__(self, seconds: int, limit: int):
        self.seconds, self.limit = seconds, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.times = handle, handle.getListState("times", "t bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(list(rows)).sort_values("at_us")
        ok, kept = admitted(got["at_us"].tolist(), self.seconds, self.limit, [r[0] for r in self.times.get()])
        self.times.put([(t,) for t in kept])
        if kept:
            _expire_at(self.handle, kept[-1] // 1000 + self.seconds * 1000 + 1)
        yield pd.DataFrame({"user_id": key[0], "at_us": got["at_us"], "admitted": ok})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.times.clear()
        yield pd.DataFrame({"user_id": [], "at_us": [], "admitted": []}).astype({"user_id": "int64", "at_us": "int64", "admitted": "bool"})

    def close(self) -> None:
        pass


_ADMITTED = "user_id long, at_us long, admitted boolean"


def limited(attempts: DataFrame, seconds: int = 60, limit: int = 20, delay: str = "10 minutes") -> DataFrame:
    """Streaming rate limiter over attempts (user_id, at_us). A client's state goes when the watermark has passed the time for which its
    last admitted attempt counts."""
    timed = attempts.select("user_id", "at_us", F.timestamp_micros(F.col("at_us") + MOVED_S * 1_000_000).alias("at")).withWatermark("at", delay)
    return timed.groupBy("user_id").transformWithStateInPandas(Limiter(seconds, limit), _ADMITTED, "Append", "EventTime")


class Repeats(StatefulProcessor):
    """Keeps when a question was last asked, for as long as a repeat would count."""

    def __init__(self, ttl_s: int):
        self.ttl_s = ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "t bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(list(rows)).sort_values(["asked_s", "message_id"])
        before = self.last.get()[0] if self.last.exists() else None
        since = (got["asked_s"] - got["asked_s"].shift(1, fill_value=-(1 << 40) if before is None else before)).astype("int64")
        last = int(got["asked_s"].iloc[-1]) if before is None else max(int(got["asked_s"].iloc[-1]), before)
        self.last.update((last,))
        _expire_at(self.handle, (last + self.ttl_s) * 1000 + 1)
        hit = since.between(0, self.ttl_s)
        yield pd.DataFrame({"message_id": got["message_id"][hit], "since_s": since[hit]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        yield pd.DataFrame({"message_id": [], "since_s": []}).astype("int64")

    def close(self) -> None:
        pass


def repeated(asked: DataFrame, ttl_s: int = 3600, delay: str = "10 minutes") -> DataFrame:
    """message_id and since_s of questions (message_id, key, asked_s) that were asked within ttl_s seconds before."""
    timed = asked.select("message_id", "key", "asked_s", F.timestamp_seconds(F.col("asked_s") + MOVED_S).alias("at")).withWatermark("at", delay)
    return timed.groupBy("key").transformWithStateInPandas(Repeats(ttl_s), "message_id long, since_s long", "Append", "EventTime")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that processors of keyed state need, for streams that are started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def limited_batch(attempts: DataFrame, seconds: int = 60, limit: int = 20) -> DataFrame:
    """The same over a table: a client's attempts in order; the limiter is a fold that no window expresses. Attempts are sorted by
    client and time in the partition and read batch by batch, so a task holds the admitted times of one client alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, history = None, []
        for rows in batches:
            parts = []
            for key, mine in rows.groupby("user_id", sort=False, dropna=False):
                if key != user:
                    user, history = key, []
                ok, history = admitted(mine["at_us"].tolist(), seconds, limit, history)
                parts.append(mine.assign(admitted=ok))
            if parts:
                yield pd.concat(parts)

    return attempts.select("user_id", "at_us").repartition("user_id").sortWithinPartitions("user_id", "at_us").mapInPandas(run, _ADMITTED)
