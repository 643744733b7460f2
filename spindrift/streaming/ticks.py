"""Streams. The time ticks drive snapshots of positions; the event windows are an extra that works on the events table.

`interpolated_ticks` keeps its snapshots in keyed state. The catalogue is dealt into blocks; the element sets of a block, the two
snapshots that its positions are mixed from and the next one are state, put there once from the catalogue. A tick is a few
numbers sent to each block, so a micro-batch shuffles ticks times blocks rows, however large the catalogue. A timer makes the next
snapshot between ticks. After a restart the state comes from the checkpoint, and results go on as if there had been none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import sgp4
from ..functions.orbit import SCENE_UNIT_KM
from ..operators.motion import ELEMENTS, positions
from ..operators.view import SimClock, Window


def tick_positions(spark: SparkSession, catalog: DataFrame, start_ms: float, warp: float, sink: Callable[[DataFrame, int], None], interval: str = "1 second", ticks_per_second: int = 1) -> StreamingQuery:
    """Each micro-batch gives the positions of the catalogue at the simulated time of its last tick to `sink`."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", ticks_per_second).load()

    def run(batch: DataFrame, number: int) -> None:
        last = batch.agg(F.max("value")).first()[0]  # one row
        if last is not None:
            sink(positions(catalog, start_ms + last * 1000 * warp), number)

    return ticks.writeStream.foreachBatch(run).trigger(processingTime=interval).start()


#: Columns of a tick: its number, the simulated time, the warp, the number of changes of the clock so far, and whether it stands.
TICK = "tick long, ms double, warp double, clock_epoch int, paused boolean"
#: Satellites of a block: a block's state is read and written as one value.
BLOCK = 2_000
#: Positions of a block that are made and given at once: the ticks of a micro-batch go together up to that many.
POINTS = 250_000
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Memory outside the heap of all stores of an executor together, unless the session says otherwise; each has its own else.
_BOUNDS = {"spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200"}


class Snapshots(StatefulProcessor):
    """One block of satellites: its elements, its window and the snapshots at the window's ends. Arrays are state as their bytes."""

    def __init__(self, prefetch_ms: int):
        self.prefetch_ms = prefetch_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        sgp4.keep_heap()
        self.handle = handle
        self.elements = handle.getValueState("elements", "ids binary, fields binary")
        self.window = handle.getValueState("window", "t_a double, t_b double, clock_epoch int, prefetched double, last_tick bigint")
        self.snapshots = handle.getMapState("snapshots", "ms double", "points binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        rows = initialState.sort_values("id")
        # A block may come in several parts.
        ids, fields = self._elements() if self.elements.exists() else (np.empty(0, np.int64), np.empty((0, 1 + len(ELEMENTS))))
        ids = np.concatenate([ids, rows["id"].to_numpy(np.int64)])
        self.elements.update((ids.tobytes(), np.concatenate([fields, rows[["epoch_ms", *ELEMENTS]].to_numpy(np.float64)]).tobytes()))

    def _elements(self) -> tuple[np.ndarray, np.ndarray]:
        ids, fields = (np.frombuffer(x, t) for x, t in zip(self.elements.get(), (np.int64, np.float64)))
        return ids, fields.reshape(len(ids), -1)

    def _made(self, table: np.ndarray, times: list[float]) -> dict[float, np.ndarray]:
        """Points (3 x satellites) at each of some times: from the state, or propagated together."""
        found = {ms: np.frombuffer(self.snapshots.getValue((ms,))[0], np.float64).reshape(3, -1) for ms in times if self.snapshots.containsKey((ms,))}
        if new := [ms for ms in times if ms not in found]:
            el = dict(zip(["epoch_ms", *ELEMENTS], np.ascontiguousarray(table.T)))
            r, _ = sgp4.Model(el).at((np.array(new) - table[:, :1]) / sgp4.MINUTE_MS, velocity=False)
            found |= {ms: np.stack([r[0, :, k], r[2, :, k], -r[1, :, k]]) / SCENE_UNIT_KM for k, ms in enumerate(new)}
        return found

    def _keep(self, ms: float, points: np.ndarray) -> None:
        if not self.snapshots.containsKey((ms,)):
            self.snapshots.updateValue((ms,), (points.tobytes(),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.elements.exists():
            return
        ids, table = self._elements()
        window, last = None, None
        if self.window.exists():
            t_a, t_b, epoch, prefetched, last = self.window.get()
            window = Window(t_a, t_b, epoch, prefetched)
        before, due = window, []
        for tick in pd.concat(list(rows)).sort_values("tick").itertuples():
            if last is not None and tick.tick <= last:
                continue
            last = int(tick.tick)
            clock = SimClock(tick.ms, 0.0, warp=tick.warp, paused=bool(tick.paused), epoch=int(tick.clock_epoch))
            window = Window.opened(tick.ms, clock) if window is None else window.advanced(tick.ms, clock)
            due.append((last, tick.ms, window))
        at_once, points = max(1, POINTS // len(ids)), {}
        for k in range(0, len(due), at_once):
            some = due[k : k + at_once]
            points = self._made(table, list(dict.fromkeys(ms for _, _, w in some for ms in (w.t_a, w.t_b))))
            yield self._mixed(ids, some, points)
        if window is None:
            return
        self.window.update((window.t_a, window.t_b, window.clock_epoch, window.prefetched, last))
        if window == before:
            return
        # Of the snapshots that were made for this micro-batch, those of the last window are needed again.
        for ms in (window.t_a, window.t_b):
            self._keep(ms, points[ms])
        for (ms,) in list(self.snapshots.keys()):
            if ms not in (window.t_a, window.t_b, window.prefetched):
                self.snapshots.removeKey((ms,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if window.prefetched is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.prefetch_ms)

    @staticmethod
    def _mixed(ids: np.ndarray, due: list[tuple[int, float, Window]], points: dict[float, np.ndarray]) -> pd.DataFrame:
        """The rows of some ticks."""
        xyz = np.empty((3, len(due), len(ids)))
        for k, (_, ms, w) in enumerate(due):
            a, b = points[w.t_a], points[w.t_b]
            # Where only the later snapshot fails, the earlier one stands.
            xyz[:, k] = a + (np.where(np.isnan(b), a, b) - a) * min(1.0, max(0.0, (ms - w.t_a) / (w.t_b - w.t_a)))
        numbers, times = (np.repeat(np.array([d[i] for d in due], t), len(ids)) for i, t in ((0, np.int64), (1, np.float64)))
        return pd.DataFrame({"id": np.tile(ids, len(due)), "tick": numbers, "ms": times, "x": xyz[0].ravel(), "y": xyz[1].ravel(), "z": xyz[2].ravel()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The next snapshot, before it is needed."""
        if self.window.exists() and (ahead := self.window.get()[3]) is not None:
            self._keep(ahead, self._made(self._elements()[1], [ahead])[ahead])
        return iter(())

    def close(self) -> None:
        pass


def interpolated_ticks(ticks: DataFrame, catalog: DataFrame, blocks: int, prefetch_ms: int = 100) -> DataFrame:
    """id, tick, ms, x, y, z (scene units; null where the model fails) of each satellite at each tick of the stream.

    ticks: a stream of TICK rows, numbered in their order; a tick that comes after one with a higher number is left out.
    catalog: id, epoch_ms and the elements; it is read when the stream first starts, then it is state. blocks: by how many keys
    satellites are dealt; `blocks_for` counts them.
    """
    spark = ticks.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    for k, v in _BOUNDS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    fields = [F.col(c).cast("double").alias(c) for c in ("epoch_ms", *ELEMENTS)]
    held = catalog.filter("id is not null").select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.col("id").cast("long").alias("id"), *fields)
    sent = ticks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = sent.groupBy("block").transformWithStateInPandas(Snapshots(prefetch_ms), "id long, tick long, ms double, x double, y double, z double", outputMode="Append", timeMode="ProcessingTime", initialState=held.groupBy("block"))
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in "xyz"})


def blocks_for(catalog: DataFrame, satellites: int = BLOCK) -> int:
    return max(1, -(-catalog.count() // satellites))


def replay(spark: SparkSession, ticks: DataFrame, catalog: DataFrame, folder: str, blocks: int | None = None) -> DataFrame:
    """What the stream gives for a table of ticks, by way of `folder`: every call takes in the ticks, goes on from the state that
    the calls before have left there, and returns all results so far. Ticks go in as one micro-batch."""
    ticks.select([F.col(x.split()[0]).cast(x.split()[1]) for x in TICK.split(", ")]).coalesce(1).write.mode("append").parquet(f"{folder}/ticks")
    stream = spark.readStream.schema(TICK).parquet(f"{folder}/ticks")
    found = interpolated_ticks(stream, catalog, blocks or blocks_for(catalog))
    # Timers keep a stream awake for ever; a replay ends with its ticks.
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(idle)
    spark.conf.set(idle, "false")
    try:
        query = found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/found")
    finally:
        spark.conf.set(idle, before)
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/found")


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extra: count and sum by type in event-time windows; a stream drops what comes later than `late`."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
