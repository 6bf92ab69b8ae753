"""Keyed state over rows in event-time order, with timers that fire without a row.

Rows wait in the state until the watermark has passed their time, and are then taken in order, so that results do not
depend on how rows are spread over files and batches. A processor may also ask for a deadline: it is kept
by an event-time timer and met at its own time, before any later row.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

#: Timers and list or map states need this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Ordered(StatefulProcessor):
    """``take`` is given each row once, by rising (``ts_ms``, ``order``); ``due`` is called at deadlines.

    ``columns``: names of the rows' columns that are kept, with ``ts_ms`` (milliseconds) and what ``order`` names among
    them. What ``take`` and ``due`` return are output rows without the key. ``load`` and ``save`` move the
    processor's own states; ``deadline`` names the next time (milliseconds) to be called at, or None.
    """

    columns: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    key: str = ""
    output: StructType

    def init(self, handle) -> None:
        self.handle = handle
        #: What came in one call is one value: its columns as lists.
        self.waiting = handle.getListState("waiting", "rows binary")
        self.alarm = handle.getValueState("alarm", "at long")

    def load(self) -> None: ...

    def save(self) -> None: ...

    def take(self, row: dict) -> list[tuple]:
        raise NotImplementedError

    def due(self, at: int) -> list[tuple]:
        return []

    def deadline(self) -> int | None:
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        found: list[list] = [[] for _ in self.columns]
        for part in rows:
            for c, values in zip(self.columns, found, strict=True):
                values += [None if lost else v.tolist() if hasattr(v, "tolist") else v for v, lost in zip(part[c].tolist(), part[c].isna(), strict=True)]
        if found[0]:
            self.waiting.appendValue((pickle.dumps(found, 5),))
            self._wake(min(found[self.columns.index("ts_ms")]))
        return iter(())

    def _wake(self, at: int | None) -> None:
        """One timer for each key: the earliest time at which there is something to do."""
        set_to = self.alarm.get()[0] if self.alarm.exists() else None
        if at is not None and (set_to is None or at < set_to):
            if set_to is not None:
                self.handle.deleteTimer(set_to)
            self.handle.registerTimer(int(at))
            self.alarm.update((int(at),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs()
        self.alarm.clear()
        rows = [r for kept in self.waiting.get() for r in zip(*pickle.loads(kept[0]), strict=True)]
        at, places = self.columns.index("ts_ms"), [self.columns.index(c) for c in ("ts_ms", *self.order)]
        ready = sorted((r for r in rows if r[at] <= now), key=lambda r: tuple(r[i] for i in places))
        rest = [r for r in rows if r[at] > now]
        self.load()
        out = self.replay([dict(zip(self.columns, r, strict=True)) for r in ready], now)
        self.save()
        self.waiting.put([(pickle.dumps([list(c) for c in zip(*rest, strict=True)], 5),)]) if rest else self.waiting.clear()
        times = [r[at] for r in rest] + [d for d in [self.deadline()] if d is not None]
        self._wake(min(times, default=None))
        if out:
            yield pd.DataFrame([self.named(key, o) for o in out], columns=self.output.fieldNames())

    def named(self, key: tuple, out: tuple) -> tuple:
        """An output row."""
        return (*key, *out)

    def replay(self, ready: list[dict], now: int) -> list[tuple]:
        """What the ``ready`` rows and the deadlines up to ``now`` give."""
        out = []
        for r in ready:
            out += self._meet(r["ts_ms"] - 1)
            out += self.take(r)
        return out + self._meet(now)

    def _meet(self, until: int) -> list[tuple]:
        out, at = [], self.deadline()
        while at is not None and at <= until:
            out += self.due(at)
            at = self.deadline()
        return out

    def close(self) -> None: ...


def run_ordered(rows: DataFrame, processor: Ordered, late: str) -> DataFrame:
    """``processor`` over a stream with the columns of ``processor`` and ``ts``; rows later than ``late`` are dropped."""
    rows.sparkSession.conf.set(*STORE)
    named = rows.select(processor.key, "ts", *[c for c in processor.columns if c not in ("ts", processor.key)]).withWatermark("ts", late)
    return named.groupBy(processor.key).transformWithStateInPandas(processor, processor.output, "Append", "EventTime")
