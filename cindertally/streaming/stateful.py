"""Streaming forms (extensions): last-kept dedup with state, and results of new keys only."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..sources import results


def last_kept_stream(stream: DataFrame, by: str, order: Sequence[str], value: str, key: str, threshold: float) -> DataFrame:
    """by, key of the rows that differ from the last kept row of their group by the threshold.

    The state is one number a group. Rows of one trigger are put in order; later triggers come after.
    """

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(list(order), kind="stable")
        kept = []
        for k, v in zip(rows[key], rows[value], strict=True):
            if last is None or abs(v - last) >= threshold:
                last = float(v)
                kept.append(k)
        state.update((last,))
        yield pd.DataFrame({by: [group[0]] * len(kept), key: kept})

    kind = dict(stream.dtypes)
    return stream.groupBy(by).applyInPandasWithState(step, f"{by} {kind[by]}, {key} {kind[key]}", "last double", "append", GroupStateTimeout.NoTimeout)


class LastKept(StatefulProcessor):
    """Holds rows back until the watermark has passed them, then folds them in order of event time.

    State of a group: the last kept value, the rows held back, and one timer at the earliest of them.
    """

    def __init__(self, by: str, kinds: dict[str, str], key: str, threshold: float):
        self.by, self.kinds, self.key, self.threshold = by, kinds, key, threshold
        self.columns = list(kinds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "value double")
        self.held = handle.getListState("held", ", ".join(f"{c} {t}" for c, t in self.kinds.items()))

    def hold(self, rows: list[tuple]) -> None:
        """Puts rows back and sets the timer to the earliest."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if rows:
            self.held.put(rows)
            self.handle.registerTimer(min(r[0] for r in rows) // 1000 + 1)
        else:
            self.held.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(r) for frame in rows for r in frame[self.columns].astype(object).itertuples(index=False)]
        self.hold([*(tuple(r) for r in self.held.get()), *new])
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(r) for r in self.held.get()), key=lambda r: r[:-1])
        due = [r for r in rows if r[0] // 1000 < upto]
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        for r in due:
            if last is None or abs(r[-1] - last) >= self.threshold:
                last = float(r[-1])
                kept.append(r[self.columns.index(self.key)])
        if last is not None:
            self.last.update((last,))
        self.hold(rows[len(due) :])
        yield pd.DataFrame({self.by: [key[0]] * len(kept), self.key: kept})

    def close(self) -> None:
        pass


def last_kept_in_time(stream: DataFrame, by: str, at: str, order: Sequence[str], value: str, key: str, threshold: float, delay: str) -> DataFrame:
    """by, key of the rows that differ from the last kept row of their group, in order of event time `at` (then `order`).

    Rows may come late by `delay`: none is decided before the watermark has passed it, so that the triggers
    they come in don't matter. Rows later than that are dropped. Values are not null. Needs the RocksDB state store.
    """
    kind = dict(stream.dtypes)
    more = [c for c in dict.fromkeys([*order, key]) if c not in (by, at)]
    rows = stream.withWatermark(at, delay).select(by, at, F.unix_micros(at).alias("at_micros"), *more, F.col(value).cast("double").alias("number"))
    kinds = {"at_micros": "long"} | {c: kind[c] for c in more} | {"number": "double"}
    return rows.groupBy(by).transformWithStateInPandas(LastKept(by, kinds, key, threshold), f"{by} {kind[by]}, {key} {kind[key]}", "append", "eventTime")


def append_new(path: str, keys: Sequence[str], compute: Callable[[DataFrame], DataFrame], schema: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: computes and commits the results of keys that the store at path lacks.

    A batch that is run again adds nothing.
    """

    def run(batch: DataFrame, _: int) -> None:
        results.read_through(batch.dropDuplicates(list(keys)), path, keys, compute, schema)

    return run
