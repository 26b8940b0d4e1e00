"""A funnel with state of its own: each first step with the first second step of the same key that follows in time."""

from __future__ import annotations

import datetime as dt
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Steps as they lie in state and in memory; rows that are taken in, or decided, at once.
_STEP = np.dtype([("key", "<i8"), ("at", "<i8"), ("id", "<i8")])
_NONE = np.empty(0, _STEP)
AT_ONCE = 500_000
#: States that keys share.
BUCKETS = 256


class Funnel(StatefulProcessor):
    """Steps of a bucket of keys wait in slots of time; a slot of first steps is decided once no second step on time can
    change it.

    Rows may come in any order, over any number of batches, and timers are what gives results: a bucket's timer is due
    with its earliest slot, and decides all slots that are due by then. A slot's steps are one value of packed numbers for
    many keys, so a step costs no call of its own. A slot of second steps goes when every first step that it could follow
    is decided, so state holds two windows' worth of steps and what is on its way. Memory holds some hundred thousand steps,
    or the slots of one window where these are more.
    """

    def __init__(self, window: int, slot: int, at_once: int = AT_ONCE):
        self.window, self.slot, self.at_once = window, slot, at_once  # microseconds, and rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        slot = T.StructType([T.StructField("slot", T.LongType())])
        steps = T.StructType([T.StructField("first", T.BinaryType()), T.StructField("second", T.BinaryType())])
        self.handle, self.steps = handle, handle.getMapState("steps", slot, steps)

    def _due(self, slot: int) -> int:
        """The millisecond after which no step on time is within a window of this slot's steps."""
        return -(-((slot + 1) * self.slot + self.window) // 1000) + 1

    def _read(self, slot: int) -> tuple[np.ndarray, np.ndarray]:
        found = self.steps.getValue((slot,))
        return (_NONE, _NONE) if found is None else tuple(np.frombuffer(bytes(b), _STEP) for b in found)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for some in rows:
            held.append(some)
            n += len(some)
            if n >= self.at_once:
                self._take_in(held)
                held, n = [], 0
        if held:
            self._take_in(held)
        return iter([])

    def _take_in(self, held: list[pd.DataFrame]) -> None:
        new = pd.concat(held, ignore_index=True)
        steps = np.empty(len(new), _STEP)
        for c in _STEP.names:
            steps[c] = new[c]
        slots, first = steps["at"] // self.slot, new["step"].to_numpy() == 1
        order = np.lexsort((~first, slots))
        steps, slots, first = steps[order], slots[order], first[order]
        starts = np.flatnonzero(np.diff(slots, prepend=slots[0] - 1))
        for a, b in zip(starts, [*starts[1:], len(slots)], strict=True):
            slot, cut = int(slots[a]), a + int(first[a:b].sum())
            before = self._read(slot)
            self.steps.updateValue((slot,), (before[0].tobytes() + steps[a:cut].tobytes(), before[1].tobytes() + steps[cut:b].tobytes()))
        self.handle.registerTimer(self._due(int(slots[0])))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = max(timerValues.getCurrentWatermarkInMs() - 1, expiredTimerInfo.getExpiryTimeInMs())
        slots = sorted(k[0] for k in self.steps.keys())
        due = [s for s in slots if self._due(s) <= until]
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # slots are read once, those within a window's reach ahead
        while due:
            run, n = [], 0
            while due and n < self.at_once:
                run.append(slot := due.pop(0))
                held[slot] = held.get(slot) or self._read(slot)
                n += sum(map(len, held[slot]))
            for slot in slots[bisect_right(slots, run[-1]) : bisect_right(slots, run[-1] + 1 + self.window // self.slot)]:
                held[slot] = held.get(slot) or self._read(slot)
            first = np.concatenate([held[s][0] for s in run])
            if len(first):
                yield self._decided(first, np.concatenate([second for _, second in held.values()]))
            for slot in run:
                self.steps.removeKey((slot,))
                del held[slot]
        if waiting := [s for s in slots if self._due(s) > until]:
            self.handle.registerTimer(self._due(waiting[0]))

    def _decided(self, first: np.ndarray, second: np.ndarray) -> pd.DataFrame:
        """First steps, each with the earliest second step of its key within a window, of those at one time the least id."""
        steps, later = np.concatenate([first, second]), np.repeat([False, True], [len(first), len(second)])
        order = np.lexsort((steps["id"], later, steps["at"], steps["key"]))
        steps, later = steps[order], later[order]
        ahead = np.minimum.accumulate(np.where(later, np.arange(len(steps)), len(steps))[::-1])[::-1]  # the next second step
        own = steps[~later]
        after = steps[np.minimum(ahead[~later], len(steps) - 1)]
        none = (ahead[~later] == len(steps)) | (after["key"] != own["key"]) | (after["at"] - own["at"] > self.window)
        seconds = {f"second_{c}": pd.arrays.IntegerArray(after[c].copy(), none.copy()) for c in ("id", "at")}
        return pd.DataFrame({"key": own["key"], "first_id": own["id"], "first_at": own["at"], **seconds})

    def close(self) -> None:
        pass


def funnel(events: DataFrame, key: str, at: str, id: str, first: str, second: str, window: dt.timedelta, delay: str, slots: int = 16, buckets: int = BUCKETS) -> DataFrame:
    """(key, first_id, first_at, second_id, second_at): each row of the stream for which `first` holds, with the earliest
    row of the same key for which `second` holds, from its own time to `window` later, or nulls.

    `first` and `second` are SQL conditions; a row is a first step if both hold. A first step comes once, when the
    watermark (the latest `at` less `delay`) has passed the end of its window and, as steps are decided in slots of a
    `slots`th of it, of its slot. Rows behind the watermark are late and count in nothing. Of second steps at one time the
    one with the smallest id counts. Rows with a null key, time or id are no steps; repeated rows are steps of their own.

    Keys share `buckets` states, by a hash: as many tasks can work at once. A checkpoint goes on with `slots` and `buckets`
    as it began, and with this form of state.
    """
    micros = F.unix_micros(at)
    step = F.when(F.expr(first), 1).when(F.expr(second), 2)
    steps = events.withWatermark(at, delay).select(F.col(key).cast("long").alias("key"), F.col(at).alias("event_time"), micros.alias("at"), F.col(id).cast("long").alias("id"), step.alias("step")).dropna()
    width = window // dt.timedelta(microseconds=1)
    processor = Funnel(width, max(1, width // slots))
    schema = "key long, first_id long, first_at long, second_id long, second_at long"
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    found = steps.select(bucket, "*").groupBy("bucket").transformWithStateInPandas(processor, schema, "append", "eventTime")
    return found.select(F.col("key").alias(key), "first_id", F.timestamp_micros("first_at").alias("first_at"), "second_id", F.timestamp_micros("second_at").alias("second_at"))
