"""The step machine: what events make of one step of a document, on a stream and in batch.

A step is pending, running, succeeded or failed. Its events are taken in order of event time (ties by id):

- `uploaded` makes it pending as if new;
- `step_started` claims a pending step that has attempts left and waits for nothing, for one more attempt;
- `step_succeeded` ends a running one;
- `step_failed` fails a running one for good once its attempts are used up; before that it is pending again, but
  waits for its retry, for longer after each attempt.

Time passes between events: a wait ends (`retry_due`), a step that has been running for too long is given up
(`stuck`: pending, or failed without attempts left), and one that neither runs nor waits is forgotten after
a time to live. An event that meets a state which doesn't admit it changes nothing and is not reported.

The stream takes events in order too (see `ordered`), so it agrees with the batch replay. Times are microseconds since 1970.
"""

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.streaming.ordered import SECOND, InOrder, dealt, values, with_time

COLUMNS = ["document_id", "step", "at", "id", "cause", "status", "attempt", "due"]
SCHEMA = "document_id long, step string, at long, id long, cause string, status string, attempt int, due long"


class Rules(NamedTuple):
    max_attempts: int = 3
    stuck_s: int = 1800
    backoff_s: int = 15  # times two to the power of the attempt
    longest_s: int = 900
    ttl_s: int = 7 * 86400


class Step(NamedTuple):
    status: str = "pending"
    attempt: int = 0
    changed: int | None = None
    due: int | None = None  # when its wait for a retry ends

    def wakes(self, rules: Rules) -> int | None:
        """When it changes, if nothing happens."""
        if self.changed is None:
            return None
        return self.due or self.changed + (rules.stuck_s if self.status == "running" else rules.ttl_s) * SECOND


Change = tuple[int, int | None, str, Step]


def pass_time(step: Step, upto: int, rules: Rules) -> Iterator[Change]:
    """What happens to a step without events, up to a time. Its last change may be to be forgotten: Step()."""
    while (at := step.wakes(rules)) is not None and at <= upto:
        if step.status == "running":
            step = Step("pending" if step.attempt < rules.max_attempts else "failed", step.attempt, at)
            yield at, None, "stuck", step
        elif step.due:
            step = Step(step.status, step.attempt, at)
            yield at, None, "retry_due", step
        else:
            step = Step()
            yield at, None, "forgotten", step


def admit(step: Step, kind: str, at: int, rules: Rules) -> Step | None:
    """The step after an event, or None if it does not admit that."""
    if kind == "uploaded":
        return Step("pending", 0, at)
    if kind == "step_started" and step.status == "pending" and not step.due and step.attempt < rules.max_attempts:
        return Step("running", step.attempt + 1, at)
    if kind == "step_succeeded" and step.status == "running":
        return Step("succeeded", step.attempt, at)
    if kind == "step_failed" and step.status == "running":
        if step.attempt >= rules.max_attempts:
            return Step("failed", step.attempt, at)
        return Step("pending", step.attempt, at, at + min(rules.backoff_s * 2**step.attempt, rules.longest_s) * SECOND)
    return None


def changes(step: Step, events: Iterable[tuple[int, int, str]], rules: Rules) -> Iterator[Change]:
    """Events (at, id, kind) in order, and what time does before each of them."""
    for at, event, kind in events:
        for change in pass_time(step, at, rules):
            step = change[3]
            yield change
        after = admit(step, kind, at, rules)
        if after:
            step = after
            yield at, event, kind, step


def told(key: tuple, found: Iterable[Change]) -> list[tuple]:
    return [(*key, at, event, cause, s.status, s.attempt, s.due) for at, event, cause, s in found if cause != "forgotten"]


def timed(events: DataFrame) -> DataFrame:
    return with_time(events, "created_at", "document_id", "step", "id", F.col("event_type").alias("kind"))


def replay(events: DataFrame, upto: Column, rules: Rules = Rules()) -> DataFrame:
    """All changes up to a time, in batch, and for each step that isn't forgotten then a last row with the cause `state`.

    A step's events are gone through in order by one task, sorted on disk; no more than a batch of them is held.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, step, end = None, Step(), 0

        def last() -> list[tuple]:
            nonlocal step
            found = list(pass_time(step, end, rules))
            step = found[-1][3] if found else step
            return told(key, found) + ([] if step.changed is None else told(key, [(step.changed, None, "state", step)]))

        for pdf in parts:
            out = []
            for document, name, event, kind, at, upto in zip(pdf.document_id, pdf.step, pdf.id, pdf.kind, pdf["at"], pdf.upto, strict=True):
                if key != (document, name):
                    out += last() if key else []
                    key, step, end = (document, name), Step(), upto
                found = list(changes(step, [(at, event, kind)], rules))
                step = found[-1][3] if found else step
                out += told(key, found)
            yield pd.DataFrame(out, columns=COLUMNS).astype({"id": "Int64", "due": "Int64"})
        yield pd.DataFrame(last() if key else [], columns=COLUMNS).astype({"id": "Int64", "due": "Int64"})

    due = timed(events).withColumn("upto", F.unix_micros(upto.cast("timestamp"))).filter(F.col("at") <= F.col("upto"))
    return due.repartition("document_id", "step").sortWithinPartitions("document_id", "step", "at", "id").drop("time").mapInPandas(run, SCHEMA)


class StepMachine(InOrder):
    KEY, WAITING, STATE = "document_id long, step string", "at long, id long, kind string", "status string, attempt int, changed long, due long"
    OUT, NULLABLE = COLUMNS, {"document_id": "Int64", "id": "Int64", "due": "Int64"}

    def __init__(self, rules: Rules):
        self.rules = rules

    def wakes(self, state: tuple) -> int | None:
        return Step(*state).wakes(self.rules)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        rows = initialState.astype({"due": "Int64"})
        self.begin(list(zip(*self.keys(rows), strict=True)), list(zip(*values(rows, ["status", "attempt", "at", "due"]), strict=True)))

    def passed(self, key: tuple, state: tuple | None, rows: list[tuple], upto: int) -> tuple[tuple | None, list[tuple]]:
        step = Step(*state) if state else Step()
        found = list(changes(step, rows, self.rules))
        found += pass_time(found[-1][3] if found else step, upto, self.rules)
        step = found[-1][3] if found else step
        return None if step.changed is None else step, told(key, found)


def step_machine(events: DataFrame, delay: str = "1 hour", rules: Rules = Rules(), initial: DataFrame | None = None) -> DataFrame:
    """Changes of steps on a stream of events (id, document_id, step, event_type, created_at). initial: steps as `replay` leaves
    them (its rows of cause `state`), from which the stream goes on. Needs the RocksDB state store."""
    keyed = dealt(timed(events).withWatermark("time", delay), "document_id", "step")
    before = dealt(initial.filter("cause = 'state'"), "document_id", "step") if initial is not None else None
    return keyed.transformWithStateInPandas(statefulProcessor=StepMachine(rules), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime", initialState=before)
