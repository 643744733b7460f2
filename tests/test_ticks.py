"""The ticks of a micro-batch go together: what only lies between them isn't put into the state, and groups of any size give the same."""

import numpy as np
import pandas as pd

from spindrift.operators.motion import ELEMENTS
from spindrift.streaming import ticks

DAY = 86_400_000.0
#: Days apart, so each but every second tick opens a window of its own.
TICKS = pd.DataFrame([(2 * d + k, d * DAY + 30_000 * k, 60.0, 0, False) for d in range(5) for k in (0, 1)], columns=[x.split()[0] for x in ticks.TICK.split(", ")])
CATALOGUE = pd.DataFrame([(i, 0.0, m, e, 50.0, 10.0 * i, 20.0, 30.0, 1e-5) for i, (m, e) in enumerate([(15.5, 0.001), (2.006, 0.7), (40.0, 0.0), (1.0027, 0.0002)])], columns=["id", "epoch_ms", *ELEMENTS])


class Value:
    value = None
    exists = lambda self: self.value is not None
    get = lambda self: self.value
    update = lambda self, v: setattr(self, "value", v)


class Map(dict):
    made: list
    containsKey, getValue, removeKey = dict.__contains__, dict.__getitem__, dict.pop
    updateValue = lambda self, k, v: (self.made.append(k[0]), self.__setitem__(k, v))


class Handle:
    listTimers = lambda self: []
    registerTimer = lambda self, at: None
    getCurrentProcessingTimeInMs = lambda self: 0


def block():
    found = ticks.Snapshots(100)
    found.handle, found.elements, found.window, found.snapshots = Handle(), Value(), Value(), Map()
    found.snapshots.made = []
    found.handleInitialState(0, CATALOGUE[:3], None)
    found.handleInitialState(0, CATALOGUE[3:], None)
    return found


def test_a_micro_batch_keeps_the_snapshots_of_its_last_window():
    whole = block()
    frames = list(whole.handleInputRows(0, iter([TICKS]), Handle()))
    assert whole.snapshots.made == [4 * DAY, 4 * DAY + 60_000] and len(frames) == 1 and len(frames[0]) == 10 * len(CATALOGUE)
    # A micro-batch for each tick gives the same rows, by way of the state.
    each = block()
    alone = pd.concat([f for k in range(10) for f in each.handleInputRows(0, iter([TICKS[k : k + 1]]), Handle())])
    assert len(each.snapshots.made) == 10 and each.window.value == whole.window.value and each.snapshots == whole.snapshots
    assert np.array_equal(alone.to_numpy(), frames[0].to_numpy(), equal_nan=True) and frames[0]["x"].isna().sum() == 10


def test_groups_of_ticks_of_any_size_give_the_same(monkeypatch):
    whole = list(block().handleInputRows(0, iter([TICKS]), Handle()))[0]
    for points, frames in ((1, 10), (12, 4), (20, 2)):
        monkeypatch.setattr(ticks, "POINTS", points)
        found = list(block().handleInputRows(0, iter([TICKS]), Handle()))
        assert len(found) == frames and np.array_equal(pd.concat(found).to_numpy(), whole.to_numpy(), equal_nan=True)


def test_stores_share_their_memory_unless_the_session_says_otherwise(spark):
    key = "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB"
    catalogue, stream = spark.createDataFrame(CATALOGUE.astype({"epoch_ms": "int64"})), spark.readStream.format("rate").load().selectExpr("value as tick", "0D as ms", "1D as warp", "0 as clock_epoch", "false as paused")
    before = {k: spark.conf.get(k, None) for k in ticks._BOUNDS}
    try:
        spark.conf.set(key, "300")
        ticks.interpolated_ticks(stream, catalogue, 2)
        assert spark.conf.get(key) == "300" and spark.conf.get("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage") == "true"
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
