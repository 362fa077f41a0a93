"""Operators for streams. Unless said otherwise a function takes a batch as well and then gives the same rows.

Late data: events behind the watermark are dropped from windows, from the memory of repeats and from the operators with
state of their own. These keep it in maps of a state store that writes only what changes, and forget it by timers on event
time; without a watermark they forget nothing. ``write_updates`` starts them with that store.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..session import scratch

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def map_store(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside the block keep state in the store that operators with maps need."""
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        yield
    finally:
        spark.conf.set(STORE[0], before)


def _watermarked(rows: DataFrame, ts: str, late: str | None) -> tuple[DataFrame, str]:
    """The rows and the mode of time that goes with them."""
    return (rows.withWatermark(ts, late), "EventTime") if late else (rows, "None")


def _in_time(rows: Iterator[pd.DataFrame], timers: TimerValues) -> Iterator[pd.DataFrame]:
    """Rows that are not behind the watermark by which state is forgotten; Spark drops late rows by the trigger's before."""
    mark = timers.getCurrentWatermarkInMs()
    return (pdf[pdf["at"] >= mark] if mark > 0 else pdf for pdf in rows)


def _wake(handle: StatefulProcessorHandle, at: int) -> None:
    """One timer for the key, once the watermark is behind ``at`` milliseconds."""
    for known in list(handle.listTimers()):
        handle.deleteTimer(known)
    handle.registerTimer(at + 1)

#: Events of a run that are remembered.
TAIL = 25


def progress_tail(events: DataFrame, n: int = TAIL) -> DataFrame:
    """(run_id, seq, phase, message) -> each run's last ``n`` events since its last ``complete`` event (which starts anew)."""
    by = Window.partitionBy("run_id")
    rows = events.withColumn("_done", F.max(F.when(F.col("phase") == "complete", F.col("seq"))).over(by))
    rows = rows.where(F.col("_done").isNull() | (F.col("seq") > F.col("_done"))).drop("_done")
    return rows.withColumn("_nth", F.row_number().over(by.orderBy(F.col("seq").desc()))).where(F.col("_nth") <= n).drop("_nth")


class _Tail(StatefulProcessor):
    """State: the number of the last ``complete`` event, which outlives the events, and the events behind it."""

    def __init__(self, n: int, forgets: bool):
        self.n, self.forgets = n, forgets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "seq long")
        self.tail = handle.getMapState("tail", "seq long", "phase string, message string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = {int(k[0]): (v[0], v[1]) for k, v in self.tail.iterator()}
        done, newest, kept = self.done.get()[0] if self.done.exists() else None, 0, dict(before)
        for pdf in _in_time(rows, timerValues) if self.forgets else rows:
            kept |= {int(s): (p, m) for s, p, m in zip(pdf["seq"], pdf["phase"], pdf["message"], strict=True)}
            newest = max([newest, *pdf["at"].tolist()]) if self.forgets else 0
        ended = max((s for s, (phase, _) in kept.items() if phase == "complete"), default=None)
        if ended is not None and (done is None or ended > done):
            done = ended
            self.done.update((done,))
        last = sorted(s for s in kept if done is None or s > done)[-self.n :]
        for s in before.keys() - set(last):
            self.tail.removeKey((s,))
        for s in last:
            if before.get(s) != kept[s]:
                self.tail.updateValue((s,), kept[s])
        if self.forgets:
            _wake(self.handle, max([newest, *self.handle.listTimers()]))
        yield pd.DataFrame({"run_id": [key[0]], "tail": [json.dumps([[s, *kept[s]] for s in last])]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.done.clear()
        self.tail.clear()
        return iter(())

    def close(self) -> None:
        pass


def progress_tail_stream(events: DataFrame, n: int = TAIL, late: str | None = None) -> DataFrame:
    """The same for a stream: after each trigger the tail of every run that had events, as (run_id, tail JSON).

    An event that comes after a later ``complete`` stays out, however much later it comes. With ``late`` events need a column
    ``ts``: a run is forgotten once the watermark is behind its last event, and events behind the watermark are dropped.
    """
    rows, time = _watermarked(events, "ts", late)
    if late:
        rows = rows.withColumn("at", F.unix_millis("ts"))
    return rows.groupBy("run_id").transformWithStateInPandas(_Tail(n, bool(late)), "run_id string, tail string", "Update", time)


def rate_limit_windows(events: DataFrame, limit: int, late: str = "10 minutes") -> DataFrame:
    """Requests by credential and minute, with whether they exceed the limit."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "user_id").agg(F.count(F.lit(1)).alias("requests"))
    return counts.select(F.col("window.start").alias("minute"), "user_id", "requests", (F.col("requests") > limit).alias("limited"))


def usage_stream_daily(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Calls by user and day: total, ok and failed."""
    sums = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))
    return sums.select("user_id", F.col("window.start").alias("day"), "total", "ok", "failed")


def quota_stream(events: DataFrame, hours: int = 5, slide: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Billable units by user in sliding windows."""
    sums = events.where("billable").withWatermark("ts", late).groupBy(F.window("ts", f"{hours} hours", slide), "user_id").agg(F.sum("units").alias("units"))
    return sums.select("user_id", F.col("window.end").alias("until"), "units")


def idempotent_events(events: DataFrame, key: str, within: str = "1 day") -> DataFrame:
    """Each key once (within the watermark, for a stream); events without a key all stay."""
    named, bare = events.where(F.col(key).isNotNull()), events.where(F.col(key).isNull())
    if events.isStreaming:
        return named.withWatermark("ts", within).dropDuplicatesWithinWatermark([key]).unionByName(bare.withWatermark("ts", within))
    first = Window.partitionBy(key).orderBy("ts", "event_id")
    return named.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").unionByName(bare)


def _changes(before: dict[str, int], now: dict[str, int]) -> dict[str, tuple]:
    """product -> (previous rank, current rank, direction)."""
    found = {}
    for product in [*now, *(p for p in before if p not in now)]:
        old, new = before.get(product), now.get(product)
        if old is None or new is None:
            way = "new" if old is None else "missing"
        else:
            way = "up" if old > new else "down" if old < new else "same"
        found[product] = (old, new, way)
    return found


class _Snapshots(StatefulProcessor):
    """State: the ranks of each snapshot of a listing, in an entry of its own."""

    def __init__(self, forgets: bool):
        self.forgets = forgets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ranks = handle.getMapState("ranks", "at long, snapshot_id string", "products array<string>, ranks array<long>")

    def _forget(self, known: list[tuple[int, str]], watermark: int) -> None:
        """What lies behind the watermark can't change any more; only its last snapshot is still compared to."""
        for order in [k for k in known if k[0] < watermark][:-1]:
            self.ranks.removeKey(order)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new: dict[tuple[int, str], dict[str, int]] = {}
        for pdf in _in_time(rows, timerValues) if self.forgets else rows:
            for at, snapshot, product, rank in zip(pdf["at"], pdf["snapshot_id"], pdf["product_key"], pdf["rank"], strict=True):
                new.setdefault((int(at), snapshot), {})[product] = int(rank)
        old_order = sorted((int(at), snapshot) for at, snapshot in self.ranks.keys())
        order = sorted({*old_order, *new})
        read: dict[tuple[int, str] | None, dict[str, int]] = {None: {}}

        def before(k: tuple[int, str] | None) -> dict[str, int]:
            if k not in read:
                read[k] = dict(zip(*self.ranks.getValue(k), strict=True))
            return read[k]

        def after(k: tuple[int, str] | None) -> dict[str, int]:
            return before(k) | new[k] if k in new and k in old_order else new[k] if k in new else before(k)

        above = dict(zip(order, [None, *order], strict=False))
        above_old = dict(zip(old_order, [None, *old_order], strict=False))
        found = []
        for k in order:
            if k in new or above[k] in new:  # no other snapshot's changes can be other than before
                now = _changes(after(above[k]), after(k))
                was = _changes(before(above_old[k]), before(k)) if k in above_old else {}
                found += [(key[0], k[1], p, *c) for p, c in now.items() if was.get(p) != c]
                found += [(key[0], k[1], p, None, None, None) for p in was if p not in now]
        for k in new:
            ranks = after(k)
            self.ranks.updateValue(k, (list(ranks), list(ranks.values())))
        if self.forgets:
            self._forget(order, timerValues.getCurrentWatermarkInMs())
            if order:
                _wake(self.handle, order[-1][0])
        columns = ["listing_key", "snapshot_id", "product_key", "previous_rank", "current_rank", "direction"]
        yield pd.DataFrame(found, columns=columns).astype({"previous_rank": "Int64", "current_rank": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._forget(sorted((int(at), snapshot) for at, snapshot in self.ranks.keys()), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


#: How late a snapshot may come.
LATE = "400 days"


def rank_diff_stream(items: DataFrame, late: str | None = LATE) -> DataFrame:
    """A stream of ranked items -> changes of each snapshot against the one before it in its listing, as updates.

    Columns: listing_key, snapshot_id, checked_at, rank, product_key. A snapshot may come in any number of triggers and
    in any order: each trigger gives the rows that are new or other than before, keyed by listing, snapshot and
    product; the last one counts (``latest``). A row with a null direction takes an earlier one back. Rows that are more than
    ``late`` behind the newest are dropped, and of the snapshots behind that a listing remembers only the last; None drops
    and forgets nothing. A trigger reads and writes only the snapshots that change and their neighbours.
    """
    rows, time = _watermarked(items, "checked_at", late)
    rows = rows.withColumn("at", F.unix_millis("checked_at"))
    schema = "listing_key string, snapshot_id string, product_key string, previous_rank long, current_rank long, direction string"
    return rows.groupBy("listing_key").transformWithStateInPandas(_Snapshots(bool(late)), schema, "Update", time)


def write_updates(updates: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append each trigger's updated rows to a Parquet sink, in a folder of its number, so that a repeated trigger replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    with map_store(updates.sparkSession):
        return updates.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(updates: DataFrame, *keys: str) -> DataFrame:
    """What ``write_updates`` wrote -> the last row of each key."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(*keys, "row.*")


def page_extract_stream(pages: DataFrame, extract: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Apply a batch operator to each arrival of pages and append the rows to a Parquet sink, then stop.

    Each batch writes to a folder of its own number, so a repeated batch replaces itself. What a batch stores on its way
    is removed with it.
    """

    def write(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            extract(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
