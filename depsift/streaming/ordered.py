"""Rows of a key in order of event time, however they arrive: the state that ticket and threat streams are built on."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def micros(at: datetime) -> int:
    """Microseconds since 1970 of a time as Spark hands it to Python, which is naive local time or has a zone."""
    return (at.astimezone(timezone.utc) - EPOCH) // timedelta(microseconds=1)


class InOrder(StatefulProcessor):
    """Holds a key's rows until the watermark has passed their time, then applies them in order of time.

    A row (at, ...) that is no later behind than the watermark's delay is applied at its place, whatever batch brings it; rows
    behind the watermark are dropped, as by any watermark. State is what `apply` keeps of a key and the rows inside the delay. A key that
    `forget` lets go keeps nothing at all.

    Subclasses name the row's fields after `at` (`fields`), the schema of what they keep (`kept`), and give:
    apply(key, kept or None, at, rows of that time) -> (kept or None, output rows), and
    deadline(kept) -> time in microseconds at which the key is to be let go unless a row comes, or None, and
    forget(key, kept) -> output rows.
    """

    fields: list[str] = []
    held_schema = ""
    kept = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.held_schema)
        self.state = handle.getValueState("kept", self.kept)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        new = [(micros(r["at"]), *(r[f] for f in self.fields)) for r in rows]
        new = [r for r in new if r[0] >= mark]
        yield from self._advance(key, mark, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000, [])

    def close(self) -> None:
        pass

    def _advance(self, key, mark: int, new: list[tuple]) -> Iterator[Row]:
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        had = len(held)
        held += new
        ready = sorted({r[0] for r in held if r[0] < mark})
        state = tuple(self.state.get()) if self.state.exists() else None
        before = state
        for at in ready:
            state, out = self._let_go(key, state, at - 1)
            yield from out
            state, out = self.apply(key, state, at, [r[1:] for r in held if r[0] == at])
            yield from out
        state, out = self._let_go(key, state, mark - 1)
        yield from out
        rest = [r for r in held if r[0] >= mark]
        if rest and (new or ready):
            self.held.put(rest)
        elif had and not rest:
            self.held.clear()
        if state is None:
            if before is not None:
                self.state.clear()
        elif state != before:
            self.state.update(state)
        times = [min(r[0] for r in rest)] if rest else []
        limit = None if state is None else self.deadline(state)
        wanted = {t // 1000 + 1 for t in [*times, *([] if limit is None else [limit])]}
        for t in list(self.handle.listTimers()):
            if t not in wanted:
                self.handle.deleteTimer(t)
        for t in wanted:
            self.handle.registerTimer(t)

    def _let_go(self, key, state, until: int):
        """What is left of the state when no row up to `until` is missing."""
        limit = None if state is None else self.deadline(state)
        if limit is None or limit > until:
            return state, []
        return None, self.forget(key, state)

    def apply(self, key, state, at: int, rows: list[tuple]):
        raise NotImplementedError

    def deadline(self, state) -> int | None:
        return None

    def forget(self, key, state) -> list[Row]:
        return []


def in_order(rows: DataFrame, key: str, processor: InOrder, out: str, late: str) -> DataFrame:
    """A stream of rows (key, at, fields) through a processor; its state lives in RocksDB, so it may outgrow memory."""
    spark: SparkSession = rows.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)
    return rows.withWatermark("at", late).groupBy(key).transformWithState(processor, out, "append", "EventTime")


def timestamp(at: int) -> datetime:
    """The naive local time that Spark takes for a timestamp."""
    return (EPOCH + timedelta(microseconds=at)).astimezone().replace(tzinfo=None)
