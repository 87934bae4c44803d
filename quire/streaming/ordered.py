"""Stateful processors that see a key's rows in order of event time, however they arrive.

Rows wait in the state until the watermark has passed them; then all of them that it has passed are handed on in
order. So a result depends neither on the order of arrival nor on the cut into batches, and
agrees with a batch job; rows later than the watermark's delay are dropped. Times are microseconds since 1970,
in a column `at`.

Keys are dealt into GROUPS groups by a hash, and Spark's state is kept by group: a call of the state store, which costs
far more than a row, serves all keys of a group. One timer a group is kept, for the earliest time that matters. A task
holds what waits in one group and the states of its keys; when a group's timer fires, these are written anew.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SECOND = 1_000_000
GROUPS = 1024


def with_time(rows: DataFrame, at: str, *columns: str | Column) -> DataFrame:
    """The columns, the event time as `time`, and as `at` in microseconds. Timestamps without zone are taken as UTC."""
    stamp = F.col(at).cast("timestamp")
    return rows.select(*columns, stamp.alias("time"), F.unix_micros(stamp).alias("at"))


def dealt(rows: DataFrame, *keys: str) -> GroupedData:
    """rows by the group of their key. Keys go along as text, so that whole numbers stay exact beside nulls."""
    group = F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).cast("int")
    return rows.withColumns({"_group": group} | {k: F.col(k).cast("string") for k in keys}).groupBy("_group")


def names(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(", ")]


def values(pdf: pd.DataFrame, columns: list[str]) -> list[list]:
    return [(pdf[c].astype(object).where(pdf[c].notna(), None) if pdf[c].hasnans else pdf[c]).tolist() for c in columns]


class InOrder(StatefulProcessor):
    """Subclasses give KEY, WAITING (the columns that wait, `at` first and a tie-breaker second) and STATE (what is kept of a key), all in
    DDL; OUT, the columns of a result; `passed` and `wakes`."""

    KEY: str
    WAITING: str
    STATE: str
    OUT: list[str]
    NULLABLE: dict[str, str] = {}  # whole numbers that may be null, by pandas type

    def passed(self, key: tuple, state: tuple | None, rows: list[tuple], upto: int) -> tuple[tuple | None, list[tuple]]:
        """The key's state (None: nothing is kept) and the results after its rows, which are in order, and the time up to the watermark."""
        raise NotImplementedError

    def wakes(self, state: tuple) -> int | None:
        """When a key needs a look if no row comes."""
        return None

    def frame(self, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=self.OUT).astype(self.NULLABLE)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.key_columns, self.columns = names(self.KEY), names(self.WAITING)
        self.whole = [c.split()[1] == "long" for c in self.KEY.split(", ")]
        self.waiting = handle.getListState("waiting", f"{self.KEY}, {self.WAITING}")
        self.states = handle.getListState("states", f"{self.KEY}, {self.STATE}")
        self.timer = handle.getValueState("timer", "at long")

    def keys(self, pdf: pd.DataFrame) -> list[list]:
        found = values(pdf, self.key_columns)
        return [[v if v is None else int(v) for v in column] if whole else column for column, whole in zip(found, self.whole, strict=True)]

    def wake(self, *times: int | None) -> None:
        at = min((-(-t // 1000) for t in times if t is not None), default=None)
        before = self.timer.get()[0] if self.timer.exists() else None
        if at == before:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def sooner(self, at: int | None) -> None:
        """Wake at a time, or when it was to be anyway if that is before."""
        self.wake(at, self.timer.get()[0] * 1000 if self.timer.exists() else None)

    def begin(self, keys: list[tuple], states: list[tuple]) -> None:
        """Take over states of keys that have none yet."""
        if keys:
            self.states.appendList([k + s for k, s in zip(keys, states, strict=True)])
            self.sooner(min((at for s in states if (at := self.wakes(s)) is not None), default=None))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if len(pdf):
                self.waiting.appendList(list(zip(*self.keys(pdf), *values(pdf, self.columns), strict=True)))
                first = int(pdf["at"].min()) if first is None else min(first, int(pdf["at"].min()))
        self.sooner(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()  # it is over
        upto, n = timerValues.getCurrentWatermarkInMs() * 1000, len(self.key_columns)
        due, later, found = {}, [], []
        for row in self.waiting.get() if self.waiting.exists() else ():
            if row[n] <= upto:
                due.setdefault(row[:n], []).append(row[n:])
            else:
                later.append(row)
        states = {row[:n]: row[n:] for row in self.states.get()} if self.states.exists() else {}
        for of in [*due, *(k for k in states if k not in due)]:
            state = states.get(of)
            if of not in due and ((at := self.wakes(state)) is None or at > upto):
                continue
            state, told = self.passed(of, state, sorted(due.get(of, ()), key=lambda r: r[:2]), upto)
            found += told
            if state is None:
                states.pop(of, None)
            else:
                states[of] = tuple(state)
        for held, rows in ((self.waiting, later), (self.states, [k + s for k, s in states.items()])):
            if rows:
                held.put(rows)
            elif held.exists():
                held.clear()
        self.wake(min((row[n] for row in later), default=None), *map(self.wakes, states.values()))
        if found:
            yield self.frame(found)

    def close(self) -> None:
        pass
