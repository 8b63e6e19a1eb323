"""Streams whose rows change when nothing arrives: sources that fall silent, and marks of what a person has seen.

State lives in the RocksDB store, one small value for each key, and a timer of a key fires in the
first micro-batch after its time, with or without new rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewatch.session import fresh_path

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATUS = "source string, status string, at long, count long, tried_at long, error string, changed_at long"
MARKS = "person string, number long, seen long, unseen boolean, notice boolean"


class SourceClock(StatefulProcessor):
    """Last success and last try of a source; timers turn it stale and then unavailable."""

    def __init__(self, stale_seconds: int, expire_seconds: int) -> None:
        self.stale, self.expire = stale_seconds * 1000, expire_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.good = handle.getValueState("good", "at long, events long")
        self.tried = handle.getValueState("tried", "at long, ok boolean, error string")
        self.told = handle.getValueState("told", "status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        good = self.good.get() if self.good.exists() else None
        tried = self.tried.get() if self.tried.exists() else None
        for part in rows:
            for row in part.itertuples():
                at, ok = int(row.at), bool(row.ok)
                if tried is None or at >= tried[0]:
                    tried = (at, ok, None if ok or pd.isna(row.error) else str(row.error))
                if ok and (good is None or at >= good[0]):
                    good = (at, 0 if pd.isna(row.events) else int(row.events))
        self.tried.update(tried)
        if good is not None:
            self.good.update(good)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            for wait in (self.stale, self.expire):
                due = good[0] * 1000 + wait + 1
                if due > timerValues.getCurrentProcessingTimeInMs():
                    self.handle.registerTimer(due)
        yield self._row(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = self.told.get()[0] if self.told.exists() else None
        row = self._row(key, timerValues)
        if row["status"].iloc[0] != before:
            yield row

    def _row(self, key, timerValues) -> pd.DataFrame:
        now = timerValues.getCurrentProcessingTimeInMs()
        good = self.good.get() if self.good.exists() else None
        tried_at, ok, error = self.tried.get()
        age = None if good is None else now - good[0] * 1000
        status = "unavailable" if age is None or age > self.expire else "ok" if ok and age <= self.stale else "stale"
        self.told.update((status,))
        served = status != "unavailable"
        return pd.DataFrame({"source": [key[0]], "status": [status], "at": pd.array([good[0] if served else None], "Int64"),
                             "count": [good[1] if served else 0], "tried_at": [tried_at], "error": [error], "changed_at": [now // 1000]})

    def close(self) -> None:
        pass


class SeenMark(StatefulProcessor):
    """The highest task number of a person and the one up to which the person has looked."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "top long, seen long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.mark.exists()
        top, seen = self.mark.get() if known else (0, 0)
        before = top
        for part in rows:
            tasks = part[part["kind"] == "task"]["number"].dropna().astype("int64")
            looks = part[part["kind"] == "seen"]["number"]
            top = max(top, *tasks) if len(tasks) else top
            fresh = sorted({n for n in tasks.tolist() if known and n > before})
            if fresh:
                yield pd.DataFrame({"person": key[0], "number": fresh, "seen": seen, "unseen": True, "notice": True})
            if len(looks):
                seen = max(seen, *[before if pd.isna(n) else int(n) for n in looks])
        self.mark.update((top, seen))
        yield pd.DataFrame({"person": [key[0]], "number": [top], "seen": [seen], "unseen": [top > seen], "notice": [False]})

    def close(self) -> None:
        pass


def source_clock(attempts: DataFrame, stale_seconds: int = 600, expire_seconds: int = 2 * 86400) -> DataFrame:
    """Changes of each source's status: out of its tries ``(source, at, ok, events, error)``, and out of silence.

    ``at`` is in seconds. A source is ok after a good try, stale when a later try failed or none came
    for ``stale_seconds``, and unavailable, with nothing to serve, when its copy is older than ``expire_seconds``.
    """
    return attempts.groupBy("source").transformWithStateInPandas(
        SourceClock(stale_seconds, expire_seconds), STATUS, "Update", "ProcessingTime")


def seen_marks(actions: DataFrame) -> DataFrame:
    """Whether a person has unseen tasks, and a notice for each new one, out of ``(person, kind, number)``.

    A ``task`` carries its number; ``seen`` the number up to which the person has looked, or null for
    all that were there before. What a person has at first is known and brings no notice.
    """
    return actions.groupBy("person").transformWithStateInPandas(SeenMark(), MARKS, "Update", "None")


def start(changes: DataFrame, home: str | None = None, every: str | None = None) -> tuple[StreamingQuery, str]:
    """Start writing changes below ``home``; with ``every`` it goes on, without it ends with what has landed.

    Each micro-batch is a table that a repeat overwrites, so the changes can be read as one Parquet folder ``out``.
    """
    spark = changes.sparkSession
    home = home or fresh_path(spark, "changes")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # a query keeps what holds when it starts
    try:
        writer = (changes.writeStream.outputMode("update").option("checkpointLocation", f"{home}/state")
                  .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{home}/out/batch={n}")))
        writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
        return writer.start(), home
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
