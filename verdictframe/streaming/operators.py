"""Structured Streaming forms of the metrics, the lifecycle and the ingest steps.

The aggregations are plain DataFrame functions: the same call works on a batch table,
which is how the stream results are checked.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import TimerValues

from ..operators.lifecycle import IN_PROGRESS, STATES, TRANSITIONS
from ..session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's checkpoint directory."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def windowed_cells(rows: DataFrame, ts: str, width: str, delay: str | None, by: list[str], slide: str | None = None,
                   grp: str = "grp", label: str = "label", pred: str = "y_hat") -> DataFrame:
    """Confusion cells per event-time window; every group metric follows from them.

    ``delay`` sets the watermark of a stream; None keeps the one it has, as after :func:`once`.
    """
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    marked = rows.withWatermark(ts, delay) if rows.isStreaming and delay else rows
    return marked.groupBy(win.alias("w"), *by, F.col(grp).alias("grp"), F.col(label).alias("label"), F.col(pred).alias("y_hat")).agg(
        F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "grp", "label", "y_hat", "n")


class DroppedRows(StreamingQueryListener):
    """Rows that a query's watermark has dropped so far, per micro-batch.

    Only operators that meet raw rows count them: an aggregation meets partial groups, so put :func:`once` before it.
    """

    def __init__(self) -> None:
        self.by_batch: dict[tuple[str, int], int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        states = [x for x in event.progress.stateOperators if x.operatorName in ("dedupeWithinWatermark", "transformWithStateInPandasExec", "transformWithStateInPySparkExec")]
        # a batch may report more than once
        self.by_batch[str(event.progress.runId), event.progress.batchId] = sum(x.numRowsDroppedByWatermark for x in states)

    def onQueryTerminated(self, event: Any) -> None:
        self.ended.add(str(event.runId))

    def total(self, run_id: str, patience_s: float = 30.0) -> int:
        """Dropped rows of an ended query; its last reports arrive a little after its end."""
        until = time.monotonic() + patience_s
        while run_id not in self.ended:
            if time.monotonic() > until:
                raise TimeoutError("the query's reports have not arrived")
            time.sleep(0.05)
        return sum(n for (run, _), n in self.by_batch.items() if run == run_id)


def once(rows: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Rows within the watermark, each key once: late rows and redeliveries go, and the late ones are counted by the query.

    A row is late when its time is not after the watermark with which the micro-batch before its own ran: the newest time
    of the batches before that one, less ``delay``.
    """
    if not rows.isStreaming:
        return rows.dropDuplicates(keys)
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, key: list[str], ts: str, gap: str, delay: str) -> DataFrame:
    """Gap-based sessions per key with event count and span."""
    marked = events.withWatermark(ts, delay) if events.isStreaming else events
    return marked.groupBy(*key, F.session_window(ts, gap).alias("w")).agg(
        F.count("*").alias("n_events"), F.max(ts).alias("last_event")).select(
        *key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events", "last_event")


def live_progress(events: DataFrame, key: list[str]) -> DataFrame:
    """Running event count per evaluation (update mode)."""
    return events.groupBy(*key).agg(F.count("*").alias("done"))


def distinct_content(files: DataFrame, content: str, ts: str, delay: str) -> DataFrame:
    """One row per content hash; on a stream within the watermark delay."""
    hashed = files.withColumn("sha256", F.sha2(F.col(content), 256))
    if files.isStreaming:
        return hashed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["sha256"])
    return hashed.dropDuplicates(["sha256"])


_LIFE_SCHEMA = "evaluation_id bigint, id bigint, event_type string, accepted boolean, state string, late boolean"
_LIFE_ROW = Row("evaluation_id", "id", "event_type", "accepted", "state", "late")


def transition_maps(transitions: dict[str, tuple[str, tuple[str, ...]]], states: tuple[str, ...]) -> tuple[dict[str, int], np.ndarray]:
    """Row number of each event and one map per row, from state number to state number; the last row changes nothing."""
    maps = np.tile(np.arange(len(states)), (len(transitions) + 1, 1))
    for k, (target, sources) in enumerate(transitions.values()):
        maps[k, [states.index(s) for s in sources]] = states.index(target)
    return {event: k for k, event in enumerate(transitions)}, maps


def prefix_states(rows: np.ndarray, maps: np.ndarray, start: int) -> np.ndarray:
    """State before the first event and after each one; maps are composed by doubling, without a loop over events."""
    chain = maps[rows]
    span = 1
    while span < len(chain):
        chain[span:] = np.take_along_axis(chain[span:], chain[:-span].copy(), axis=1)
        span *= 2
    return np.concatenate([[start], chain[:, start]])


class LifecycleProcessor(StatefulProcessor):
    """Status of one evaluation: the state name, the largest id seen and the number of late ids are kept as a value state.

    The events of a micro-batch are applied in order of id. An id that is not larger than one of an earlier batch is late:
    it is reported, counted and not applied. With ``idle_ms`` every batch sets a timer; when it ends and the evaluation is
    in progress, one row 'stuck' is sent, and the state stays.
    """

    def __init__(self, idle_ms: int, transitions: dict[str, tuple[str, tuple[str, ...]]], states: tuple[str, ...], in_progress: tuple[str, ...]) -> None:
        self.idle_ms, self.states, self.in_progress = idle_ms, states, in_progress
        self.rows, maps = transition_maps(transitions, states)
        self.maps = maps.tolist()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("status", "state string, last_id bigint, late bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        current, last, late_before = self.value.get() if self.value.exists() else (self.states[0], -1, 0)
        batch = sorted(rows, key=lambda r: r["id"])  # one evaluation's events of one micro-batch
        at, late, out = self.states.index(current), 0, []
        for row in batch:
            if row["id"] <= last:
                late += 1
                out.append(_LIFE_ROW(key[0], row["id"], row["event_type"], False, current, True))
                continue
            to = self.maps[self.rows.get(row["event_type"], -1)][at]
            out.append(_LIFE_ROW(key[0], row["id"], row["event_type"], to != at, self.states[to], False))
            at = to
        self.value.update((self.states[at], max(last, batch[-1]["id"]), late_before + late))
        if self.idle_ms:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield from out

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: Any) -> Iterator[Row]:
        current, last, _ = self.value.get()
        if current in self.in_progress:
            yield _LIFE_ROW(key[0], last, "stuck", False, current, False)

    def close(self) -> None:
        pass


def lifecycle_stream(events: DataFrame, idle_ms: int = 0, transitions: dict[str, tuple[str, tuple[str, ...]]] = TRANSITIONS,
                     states: tuple[str, ...] = STATES, in_progress: tuple[str, ...] = IN_PROGRESS) -> DataFrame:
    """Accepted or rejected per event with the state kept per evaluation; see :class:`LifecycleProcessor`.

    ``events`` holds evaluation_id, id and event_type. The state needs the RocksDB store, which is set for the session.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    processor = LifecycleProcessor(idle_ms, transitions, states, in_progress)
    return events.select("evaluation_id", "id", "event_type").groupBy("evaluation_id").transformWithState(
        processor, _LIFE_SCHEMA, "append", "ProcessingTime" if idle_ms else "None")


def read_events(spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """File stream over the parquet files called ``name`` in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def run_to_table(stream: DataFrame, mode: str, name: str, dropped: DroppedRows | None = None) -> DataFrame:
    """Drain a stream (available-now) into parquet and read it back; ``dropped`` adds its late rows as column late_rows.

    Append results go to the exactly-once file sink.  For update mode every micro-batch is
    written under its own epoch folder, so a replayed epoch overwrites itself.
    """
    spark = stream.sparkSession
    out, chk = scratch(spark, f"{name}-out"), scratch(spark, f"{name}-chk")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", chk).trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", out).start()
    else:
        q = writer.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")).start()
    q.awaitTermination()
    late = [F.lit(dropped.total(str(q.runId))).cast("bigint").alias("late_rows")] if dropped else []
    schema = stream.schema if mode == "append" else T.StructType([*stream.schema.fields, T.StructField("epoch", T.LongType())])
    return spark.read.schema(schema).parquet(out).select("*", *late)


def run_into(stream: DataFrame, sink: Callable[[DataFrame, int], None], name: str) -> None:
    """Drain a stream (available-now) into a foreachBatch sink."""
    writer = stream.writeStream.option("checkpointLocation", scratch(stream.sparkSession, f"{name}-chk")).trigger(availableNow=True)
    writer.foreachBatch(sink).start().awaitTermination()


def upsert_registry(registry_path: str, build: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that appends only content the registry does not hold yet."""
    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        # a replayed epoch does not know its own rows, as it is about to write them again
        held = spark.read.schema("sha256 string").parquet(registry_path)
        known = held.where(~F.col("_metadata.file_path").contains(f"/epoch={epoch}/")).select("sha256")
        build(batch, known).write.mode("overwrite").parquet(f"{registry_path}/epoch={epoch}")

    return sink
