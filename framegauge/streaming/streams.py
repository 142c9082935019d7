"""Streams: validated messages, change suppression, append-once ingest, late cut-off, rolling statistics, thinning and
escalation.

Keyed state is one small record for a key: the last value, the last kept times, or a run. Rows of a key may come in any
order within a micro-batch, so they are sorted there: a key's rows of one micro-batch must fit into a task's memory, which
stream_of's files_a_batch bounds. Rolling statistics, whose keys are few and large, take a micro-batch as a table instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.ledger import append_once, placed, rolling_stats, with_key
from ..sources.shared import cut, folder


def stream_of(spark: SparkSession, path: str, files_a_batch: int = 64) -> DataFrame:
    """A stream over a Parquet table; as a pattern, since a stream's plain path must be a folder and not one file."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there now into a Parquet folder and read that."""
    spark, out = stream.sparkSession, folder(stream.sparkSession, name)
    stream.writeStream.format("parquet").option("checkpointLocation", folder(spark, "progress")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_batches(stream: DataFrame, each: Callable[[DataFrame, int], None]) -> None:
    stream.writeStream.foreachBatch(each).option("checkpointLocation", folder(stream.sparkSession, "progress")).trigger(availableNow=True).start().awaitTermination()


def valid_messages(stream: DataFrame, types: list[str], below: int) -> DataFrame:
    rows = stream.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return rows.filter(F.col("event_type").isin(*types) & (F.col("k") < below))


def late_cut(stream: DataFrame, at: str, window: str, most_ms: float = 500.0, keep_ms: float = 250.0) -> DataFrame:
    """stream(at: ms since its catch-up window began, window: that window's length in ms) without what is too late.

    In a window of over most_ms only the last keep_ms count; shorter ones count whole.
    """
    return stream.filter((F.col(window) <= most_ms) | (F.col(at) >= F.col(window) - keep_ms))


def changed_only(stream: DataFrame) -> DataFrame:
    """stream(user_id, ts, event_id, event_type, high): rows whose type or level differs from the key's row before."""

    def emit(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        kept = []
        for r in rows.itertuples(index=False):
            now = (str(r.event_type), bool(r.high))
            if now != last:
                kept.append((r.event_id, key[0], *now))
            last = now
        state.update(last)
        yield pd.DataFrame(kept, columns=["event_id", "user_id", "event_type", "high"])

    return stream.groupBy("user_id").applyInPandasWithState(emit, "event_id long, user_id long, event_type string, high boolean", "event_type string, high boolean", "append", GroupStateTimeout.NoTimeout)


def rolling(stream: DataFrame, out: str, progress: str, size: int = 120) -> None:
    """stream(event_type, ts, event_id, value): nearest-rank p50, p95 and maximum of the key's last `size` values, appended
    to out by micro-batch (event_id, p50, p95, top), as record_batches does.

    A micro-batch is a table: the segmented scan deals a key's rows over tasks, however many they are. State is the last
    size - 1 rows of each key, a folder beside each batch, which the next batch reads as its lead.
    """
    state = f"{progress}-state"
    spark, kind = stream.sparkSession, "_late int, ts timestamp, event_id long, event_type string, value double"

    def each(batch: DataFrame, number: int) -> None:
        now = batch.select(F.lit(1).alias("_late"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), "event_type", F.col("value").cast("double").alias("value"))
        # batch numbers have no gaps: a batch that runs again reads and overwrites the same folders
        if number:
            now = spark.read.schema(kind).parquet(f"{state}/{number - 1}").unionByName(now)
        now = cut(now, "batch")
        stats = rolling_stats(now, "event_type", ["_late", "ts", "event_id"], "value", size)
        stats.filter("_late = 1").select("event_id", "p50", "p95", "top").write.mode("overwrite").parquet(f"{out}/batch={number}")
        numbered = placed(now, "event_type", ["_late", "ts", "event_id"])
        most = numbered.groupBy("event_type").agg(F.max("place").alias("_most"))
        last = with_key(numbered, most, "event_type").filter(F.col("place") > F.col("_most") - (size - 1))
        last.select(F.lit(0).alias("_late"), "ts", "event_id", "event_type", "value").coalesce(1).write.mode("overwrite").parquet(f"{state}/{number}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


class _Thinning(StatefulProcessor):
    """State of a session: whether it is on, and the last kept time of each clip, forgotten when it is turned off."""

    def __init__(self, gap: float):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.on = handle.getValueState("on", "on boolean")
        self.last = handle.getMapState("last", "clip string", "at double")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        on = self.on.get()[0] if self.on.exists() else True
        # kept in memory for this batch; written back once a clip
        last: dict[str, float] = {k[0]: v[0] for k, v in self.last.iterator()} if self.last.exists() else {}
        for r in sorted(rows, key=lambda r: (r.at, r.event_id)):
            if r.enabled is not None:
                on = r.enabled
                if not on:
                    last.clear()
            elif on and (r.clip not in last or r.at - last[r.clip] >= self.gap):
                last[r.clip] = r.at
                yield Row(session=key[0], clip=r.clip, event_id=r.event_id)
        self.on.update((on,))
        self.last.clear()
        for clip, at in last.items():
            self.last.updateValue((clip,), (at,))

    def close(self) -> None:
        pass


def thinned(stream: DataFrame, gap: float) -> DataFrame:
    """stream(session, clip, at, event_id, enabled): events at least gap after the last kept one of their session's clip.

    Rows with enabled are controls: a session that is turned off drops its events and forgets what it kept; null is an
    event. State is a record for each session and clip.
    """
    keyed_state(stream.sparkSession)
    return stream.groupBy("session").transformWithState(_Thinning(gap), "session long, clip string, event_id long", "Append", "None")


class _Escalation(StatefulProcessor):
    """State of a key: its last code and how often in a row it came."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "code string, streak long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        code, streak = self.run.get() if self.run.exists() else (None, 0)
        for r in sorted(rows, key=lambda r: (r.at, r.event_id)):
            streak = 0 if r.code is None else streak + 1 if r.code == code else 1
            code = r.code
            yield Row(key=key[0], event_id=r.event_id, outcome=r.outcome, streak=streak, escalate=streak >= self.most)
        self.run.update((code, streak))

    def close(self) -> None:
        pass


def escalated(stream: DataFrame, most: int = 3) -> DataFrame:
    """stream(key, at, event_id, outcome, code): each row with the length of its key's run of one code up to it, and
    whether that is `most` or more; a null code ends a run. The run is state: the ledger is never read again."""
    keyed_state(stream.sparkSession)
    return stream.groupBy("key").transformWithState(_Escalation(most), "key long, event_id long, outcome string, streak long, escalate boolean", "Append", "None")


def keyed_state(spark: SparkSession) -> None:
    """Typed state needs the RocksDB store; a session that names another one keeps it."""
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def record_batches(stream: DataFrame, out: str, progress: str) -> None:
    """Append a stream to the ledger at out, a folder for each micro-batch that is overwritten if the batch runs again:
    with the same progress folder a run goes on where the last one stopped, and no row counts twice."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def ingest_once(stream: DataFrame, key: str) -> DataFrame:
    """Append each key once to a ledger table; keys are unbounded, so they are looked up in the table and not in state."""
    spark, out = stream.sparkSession, folder(stream.sparkSession, "ledger")
    schema = stream.schema

    def each(batch: DataFrame, _: int) -> None:
        there = spark.read.schema(schema).parquet(out)
        append_once(there, batch, key).write.mode("append").parquet(out)

    spark.createDataFrame([], schema).write.parquet(out)
    drain_batches(stream, each)
    return spark.read.schema(schema).parquet(out)
