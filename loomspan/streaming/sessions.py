"""Session streams: idempotent ingest, active sessions, session windows, stateful episodes, completion batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from loomspan.operators.events import append_once, event_class
from loomspan.operators.relational import upsert
from loomspan.plans.lineage import cut


def deduplicated(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (session, idempotency key) once within the watermark's delay."""
    return stream.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["session_id", "idempotency_key"])


def admitted(stream: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of active sessions, and the others, by a stream-static join. sessions: session_id, status."""
    both = stream.join(sessions.select("session_id", "status"), "session_id", "left")
    active = F.coalesce(F.col("status") == "active", F.lit(False))
    return both.where(active).drop("status"), both.where(~active).drop("status")


def session_windows(stream: DataFrame, gap: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """Counts of each session's runs of events without a gap."""
    events = stream.withWatermark("created_at", delay)
    grouped = events.groupBy("session_id", F.session_window("created_at", gap).alias("w")).agg(F.count("*").alias("events"))
    return grouped.select("session_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "events")


_OUT = "session_id string, event_id string, created_at timestamp, episode_type string, episode long"
_STATE = "episode long, size int, kind string, last timestamp"


def streaming_episodes(stream: DataFrame, gap_seconds: int = 900, cap: int = 8, delay: str = "1 hour", idle_seconds: int = 30 * 86400) -> DataFrame:
    """The episodes of a session's events as they come: class changes, gaps and the cap start new ones.

    State is one row a session: the open episode's number, size, class and last
    time. Events of a batch are taken in the order of time and ordinal; events
    behind the watermark (``delay``) are dropped, as their place is settled. A
    session without events for ``idle_seconds`` beyond the watermark loses its state;
    should it go on after that, its episodes count from 1 again.
    """
    typed = stream.withWatermark("created_at", delay).withColumn("episode_type", event_class()).select("session_id", "event_id", "ordinal", "created_at", "episode_type")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        episode, size, kind, last = state.get if state.exists else (0, 0, None, None)
        last = pd.Timestamp(last) if last is not None else None
        rows = pd.concat(list(frames)).sort_values(["created_at", "ordinal"], kind="stable")
        numbers = []
        for row in rows.itertuples():
            gap = int((row.created_at - last).total_seconds()) if last is not None else 0
            if kind is None or row.episode_type != kind or gap > gap_seconds or size >= cap:
                episode, size = episode + 1, 0
            size, kind, last = size + 1, row.episode_type, row.created_at
            numbers.append(episode)
        state.update((episode, size, kind, last.to_pydatetime()))
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + 1000 * idle_seconds)
        yield rows.assign(episode=numbers)[["session_id", "event_id", "created_at", "episode_type", "episode"]]

    return typed.groupBy("session_id").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


class _Session(StatefulProcessor):
    """State of a session: the keys of its events, its open episode, its counts of turn contexts and prompts."""

    def __init__(self, columns: list[str], gap_seconds: int, cap: int, idle_seconds: int):
        self.names, self.at = (*columns, "episode", "turn", "duplicate"), {c: n for n, c in enumerate(columns)}
        # A gap is counted in whole seconds, a time in microseconds.
        self.gap, self.cap, self.idle = gap_seconds * 1_000_000 + 999_999, cap, idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "episode long, size int, kind string, last long, contexts long, prompts long")
        self.seen = handle.getMapState("seen", "name string, value string", "ordinal long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        # Timers of a batch fire after its rows, so one that is due is heeded here.
        timers = list(self.handle.listTimers())
        if timers and max(timers) <= timerValues.getCurrentWatermarkInMs():
            self.open.clear()
            self.seen.clear()
        episode, size, kind, last, contexts, prompts = self.open.get() if self.open.exists() else (0, 0, None, None, 0, 0)
        out, row = [], Row(*self.names)
        for *own, at in sorted(rows, key=lambda r: (r[-1] is not None, r[-1] or 0, r[self.at["ordinal"]] or 0)):
            type_, what = own[self.at["event_type"]], own[self.at["episode_type"]]
            held = [(name, own[self.at[name]]) for name in ("idempotency_key", "event_id") if own[self.at[name]] is not None]
            if any(self.seen.containsKey(k) for k in held):
                out.append(row(*own, None, None, True))
                continue
            for k in held:
                self.seen.updateValue(k, (own[self.at["ordinal"]],))
            at = last if at is None else at
            if episode == 0 or what != kind or (at is not None and last is not None and at - last > self.gap) or size >= self.cap:
                episode, size = episode + 1, 0
            size, kind, last = size + 1, what, at
            contexts, prompts = contexts + (type_ == "turn_context"), prompts + (type_ == "prompt")
            out.append(row(*own, episode, contexts or prompts, False))
        self.open.update((episode, size, kind, last, contexts, prompts))
        for old in timers:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max((last or 0) // 1000, timerValues.getCurrentWatermarkInMs()) + self.idle)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.open.clear()
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def streaming_sessions(stream: DataFrame, gap_seconds: int = 900, cap: int = 8, delay: str = "1 hour", idle_seconds: int = 30 * 86400) -> DataFrame:
    """A session's events as they come, with ``duplicate``, ``episode_type``, ``episode`` and ``turn``, from state with timers.

    A row is a duplicate if its session has an event with its idempotency key or
    its event id that was no duplicate itself, as an insert that does nothing on
    conflict would have it; null keys are never equal. Duplicates have no episode
    and no turn. Episodes are those of ``episodes_of``, turns those of
    ``turn_ids`` but for what only the end of a session tells: until its first
    turn context, prompts are counted. An event without a time has that of the
    one before it.

    A batch reads the state of its own sessions alone: a row of figures, and the
    keys that it asks for, so its cost does not follow the history. Events behind
    the watermark (``delay``) are dropped. A session without events for
    ``idle_seconds`` beyond the watermark loses its state; should it go on, its
    keys are new and its numbers count from 1 again. Columns of the input with
    the names of these are replaced. The session needs RocksDB as state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    own = ("episode_type", "episode", "turn", "duplicate", "_micros")
    typed = stream.withWatermark("created_at", delay).withColumn("episode_type", event_class()).drop(*own[1:])
    added = [StructField("episode", LongType()), StructField("turn", LongType()), StructField("duplicate", BooleanType())]
    schema = StructType([*typed.schema.fields, *added])
    rows = typed.select("*", F.unix_micros("created_at").alias("_micros"))
    return rows.groupBy("session_id").transformWithState(_Session(typed.columns, gap_seconds, cap, idle_seconds), schema, "append", "eventTime")


#: Folders by hash of the session, so that a batch is held against its sessions' history only.
BUCKETS = 64


def ingest_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends the events which are not stored yet; a repeated batch changes nothing.

    Rows land in a folder of their batch and bucket, which a retry overwrites.
    Earlier batches alone are searched for duplicates, and of those only the
    buckets of the batch's sessions: at most BUCKETS numbers reach the driver.
    So its cost follows the history; where that is long, ``ingest`` keeps the
    keys as state.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = cut(batch.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int")))
        stored = keyed.limit(0)
        if number > 0:
            asked = [r["bucket"] for r in keyed.select("bucket").distinct().collect()]
            schema = StructType([*batch.schema.fields, StructField("batch", LongType()), StructField("bucket", IntegerType())])
            done = spark.read.option("basePath", path).schema(schema).parquet(path)
            stored = done.where((F.col("batch") < number) & F.col("bucket").isin(*asked)).drop("batch")
        fresh = append_once(stored, keyed, order="ordinal").where("not duplicate").drop("duplicate")
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")

    return run


def ingest(stream: DataFrame, path: str, checkpoint: str, **limits) -> DataStreamWriter:
    """A writer of the events that ``streaming_sessions`` finds to be new, with their episodes and turns, as Parquet, each exactly once."""
    fresh = streaming_sessions(stream, **limits).where("not duplicate").drop("duplicate")
    return fresh.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def complete_batch(derive: Callable[[DataFrame], DataFrame], load: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for session ends: load the sessions' events, derive memories, save them."""

    def run(ends: DataFrame, number: int) -> None:
        del number
        if not ends.isEmpty():
            save(derive(load(ends.select("session_id").distinct())))

    return run


def merge_sessions(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Session rows after starts and ends: the latest of each session."""
    return upsert(stored, changes, ["session_id"], ["changed_at"])
