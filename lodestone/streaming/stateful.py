"""Streams with state per key: file stages, rate limits, embedding batches.

Each takes a streaming (or, but for ``file_states``, only a streaming) frame
and returns one to be written by ``writeStream``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators import ingest


def file_states(events: DataFrame) -> DataFrame:
    """The newest stage of each file (file_id, stage, ts), kept as the engine's own aggregate; for update or complete mode."""
    return ingest.file_states(events)


def rate_limits(requests: DataFrame, seconds: int = 60, most: int = 10) -> DataFrame:
    """requests (event_id, user_id, ts) as they come, with recent and allowed. Denied ones count.

    A user's state holds the times of the window alone; of these no more than
    ``most`` matter for the decision, but all are counted.
    """

    def decide(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(batches).sort_values(["ts", "event_id"])
        recent = []
        for t in rows["ts"].astype("datetime64[us]").astype("int64").tolist():
            times = [x for x in times if x > t - seconds * 1_000_000]
            recent.append(len(times))
            times.append(t)
        state.update((times,))
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": rows["user_id"], "ts": rows["ts"], "recent": recent, "allowed": [n < most for n in recent]})

    return requests.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).groupBy("user_id").applyInPandasWithState(
        decide, "event_id long, user_id long, ts timestamp, recent long, allowed boolean", "times array<long>", "append", GroupStateTimeout.NoTimeout
    )


def embed_batches(files: DataFrame, chunks: int = 100, most_files: int = 5) -> DataFrame:
    """files (job_id, file_id, n_chunks) with the number of the batch each goes into, as they come.

    A batch closes once it has ``chunks`` chunks or ``most_files`` files. State is three numbers a job.
    """

    def number(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, held, count = state.get if state.exists else (0, 0, 0)
        for rows in batches:
            numbers = []
            for n in rows["n_chunks"].tolist():
                numbers.append(batch)
                held, count = held + n, count + 1
                if held >= chunks or count >= most_files:
                    batch, held, count = batch + 1, 0, 0
            yield rows.assign(batch=numbers)[["job_id", "file_id", "n_chunks", "batch"]]
        state.update((batch, held, count))

    return files.select("job_id", "file_id", "n_chunks").groupBy("job_id").applyInPandasWithState(
        number, "job_id string, file_id string, n_chunks long, batch long", "batch long, held long, count long", "append", GroupStateTimeout.NoTimeout
    )


class _Idle(StatefulProcessor):
    """A job's open batch, closed when it is full or when nothing has come for a while."""

    def __init__(self, chunks: int, most_files: int, idle_ms: int):
        self.chunks, self.most_files, self.idle_ms = chunks, most_files, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.number = handle.getValueState("number", "batch long")
        self.open = handle.getListState("open", "file_id string, n_chunks long")

    def _closed(self, key, held: list[tuple], batch: int, reason: str) -> pd.DataFrame:
        return pd.DataFrame({"job_id": key[0], "file_id": [f for f, _ in held], "n_chunks": [n for _, n in held], "batch": batch, "reason": reason})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = self.number.get()[0] if self.number.exists() else 0
        held = [tuple(x) for x in self.open.get()]
        for part in rows:
            for file_id, n in zip(part["file_id"].tolist(), part["n_chunks"].tolist(), strict=True):
                held.append((file_id, n))
                if sum(n for _, n in held) >= self.chunks or len(held) >= self.most_files:
                    yield self._closed(key, held, batch, "full")
                    held, batch = [], batch + 1
        self._keep(held, batch)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if held:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        batch = self.number.get()[0] if self.number.exists() else 0
        held = [tuple(x) for x in self.open.get()]
        if held:
            self._keep([], batch + 1)
            yield self._closed(key, held, batch, "idle")

    def _keep(self, held: list[tuple], batch: int) -> None:
        self.number.update((batch,))
        self.open.clear()
        if held:
            self.open.put(held)

    def close(self) -> None:
        pass


def idle_batches(files: DataFrame, chunks: int = 100, most_files: int = 5, idle_ms: int = 2000) -> DataFrame:
    """files (job_id, file_id, n_chunks), a stream, as the batches in which they are embedded: with batch and reason.

    A batch closes once it has ``chunks`` chunks or ``most_files`` files (full), or
    when ``idle_ms`` have passed without a file of its job (idle), by a timer of
    processing time; its files come out then. State is a job's open batch, at
    most ``most_files`` - 1 files, and its number, in RocksDB: set
    spark.sql.streaming.stateStore.providerClass for it.
    """
    out = "job_id string, file_id string, n_chunks long, batch long, reason string"
    rows = files.select(F.col("job_id").cast("string"), F.col("file_id").cast("string"), F.coalesce(F.col("n_chunks").cast("long"), F.lit(0).cast("long")).alias("n_chunks"))
    return rows.groupBy("job_id").transformWithStateInPandas(_Idle(chunks, most_files, idle_ms), out, "Append", "ProcessingTime")
