"""Streams on hand-made sequences: order of arrival, late rows, timers, initial states."""

import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from quire.operators.lineage import shared_folder
from quire.streaming import ingest, steps, streams

T0 = datetime.datetime(2024, 1, 1, 12, 0, 0)
EVENT = "id long, document_id long, step string, event_type string, created_at timestamp_ntz"
RULES = steps.Rules(max_attempts=2, stuck_s=1800, backoff_s=15, longest_s=40, ttl_s=7200)


@pytest.fixture(autouse=True)
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def in_batches(spark, batches, schema):
    """Rows as a stream that reads one file at a time, in order."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    frame = None
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, schema).coalesce(1)
        frame.write.mode("append").parquet(f"{folder}/in/{i}")
    read = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    return read, folder


def ran(spark, batches, run, schema=EVENT):
    read, folder = in_batches(spark, batches, schema)
    return streams.run_to_table(run(read), f"{folder}/out", f"{folder}/state")


def event(i, seconds, kind, document=1, step="ocr"):
    return (i, document, step, kind, T0 + datetime.timedelta(seconds=seconds))


def told(df):
    start = int(T0.replace(tzinfo=datetime.UTC).timestamp()) * steps.SECOND
    found = [(r.document_id, (r["at"] - start) // steps.SECOND, r.id, r.cause, r.status, r.attempt) for r in df.filter("cause <> 'state'").collect()]
    return sorted(found, key=lambda r: (r[0], r[1], r[2] or 0))


#: Moves the watermark (delay 60 s), as an event of another document.
def later(i, seconds):
    return event(i, seconds, "validated", document=99)


def test_retries_wait_and_stuck_steps_are_given_up(spark):
    events = [event(1, 0, "uploaded"), event(2, 10, "step_started"), event(3, 20, "step_failed"), event(4, 49, "step_started"), event(5, 51, "step_started"), event(6, 60, "step_started"), event(7, 2000, "step_succeeded"), later(8, 3000)]
    got = told(ran(spark, [events], lambda s: steps.step_machine(s, "60 seconds", RULES)))
    # 15 s x 2 after the first attempt; the second is the last, so that being stuck ends it.
    assert got == [(1, 0, 1, "uploaded", "pending", 0), (1, 10, 2, "step_started", "running", 1), (1, 20, 3, "step_failed", "pending", 1), (1, 50, None, "retry_due", "pending", 1),
                   (1, 51, 5, "step_started", "running", 2), (1, 1851, None, "stuck", "failed", 2)]
    assert got == told(steps.replay(spark.createDataFrame(events, EVENT), F.expr("timestamp_ntz'2024-01-01 12:49:00'"), RULES))


def test_a_wait_is_bounded_and_ends_without_further_events(spark):
    rules = RULES._replace(max_attempts=9)
    events = [event(1, 0, "step_started"), event(2, 1, "step_failed"), event(3, 31, "step_started"), event(4, 32, "step_failed")]
    got = told(ran(spark, [events, [later(5, 100)], [later(6, 200)]], lambda s: steps.step_machine(s, "60 seconds", rules)))
    assert [(at, cause) for _, at, _, cause, _, _ in got] == [(0, "step_started"), (1, "step_failed"), (31, "retry_due"), (31, "step_started"), (32, "step_failed"), (72, "retry_due")]


def test_order_of_arrival_does_not_matter_but_late_events_are_dropped(spark):
    events = [event(1, 0, "uploaded"), event(2, 10, "step_started"), event(3, 30, "step_succeeded"), event(4, 40, "uploaded"), event(5, 45, "step_started"), event(6, 50, "step_failed")]
    want = told(steps.replay(spark.createDataFrame(events, EVENT), F.expr("timestamp_ntz'2024-01-01 12:04:00'"), RULES))
    assert [r[3] for r in want][-1] == "retry_due" and len(want) == 7
    for seed in range(2):
        mixed = random.Random(seed).sample(events, len(events))
        assert told(ran(spark, [mixed[:2], mixed[2:4], mixed[4:], [later(7, 300)]], lambda s: steps.step_machine(s, "60 seconds", RULES))) == want
    # The third batch works with a watermark of 340 s: in the fourth, the failure at 50 s comes too late.
    got = told(ran(spark, [events[:5], [later(7, 400)], [later(8, 450)], [events[5], later(9, 500)]], lambda s: steps.step_machine(s, "60 seconds", RULES)))
    assert [r[3] for r in got] == ["uploaded", "step_started", "step_succeeded", "uploaded", "step_started"]


def test_forgotten_steps_begin_anew_and_initial_states_go_on(spark):
    events = [event(1, 0, "step_started"), event(2, 5, "step_failed"), event(3, 100, "step_started"), event(4, 110, "step_failed"), event(5, 120, "step_started"), event(6, 7400, "step_started"),
              event(7, 0, "step_started", document=2), event(8, 0, "step_started", document=3), event(9, 4, "step_failed", document=3), event(10, 20, "step_succeeded", document=2, step="embed")]
    every = spark.createDataFrame([*events, later(11, 9000)], EVENT)
    upto, cut = F.expr("timestamp_ntz'2024-01-01 14:29:00'"), F.expr("timestamp_ntz'2024-01-01 12:00:20'")
    want = told(steps.replay(every, upto, RULES))
    # Failed for good at 110; two hours later nothing is known of it, so that a start is a first attempt.
    assert (1, 110, 4, "step_failed", "failed", 2) in want and (1, 7400, 6, "step_started", "running", 1) in want and (1, 120, 5, "step_started", "running", 3) not in want
    before = steps.replay(every, cut, RULES)
    states = {(r.document_id, r.status, r.attempt) for r in before.filter("cause = 'state'").collect()}
    assert states == {(1, "pending", 1), (2, "running", 1), (3, "pending", 1)}
    folder = f"{shared_folder(spark)}/before-{uuid.uuid4().hex}"
    before.write.parquet(folder)
    rest = [e for e in events if e[4] > T0 + datetime.timedelta(seconds=20)]
    got = told(ran(spark, [rest[:2], rest[2:], [later(11, 9000)]], lambda s: steps.step_machine(s, "60 seconds", RULES, spark.read.parquet(folder))))
    assert sorted(got + told(before), key=lambda r: (r[0], r[1], r[2] or 0)) == want


def test_replay_carries_a_step_over_batches(spark):
    """One step with more events than an Arrow batch holds, and an empty table."""
    n = 25_000
    events = spark.range(n).select("id", F.lit(1).cast("long").alias("document_id"), F.lit("ocr").alias("step"), F.element_at(F.array(F.lit("uploaded"), F.lit("step_started"), F.lit("step_succeeded")), (F.col("id") % 3 + 1).cast("int")).alias("event_type"),
                                   (F.expr("timestamp_ntz'2024-01-01 12:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id"))).alias("created_at"))
    found = steps.replay(events, F.expr("timestamp_ntz'2024-02-01 12:00:00'"), RULES._replace(ttl_s=10**9, stuck_s=10**9))
    assert {(r.cause, r["count"]) for r in found.groupBy("cause").count().collect()} == {("uploaded", n // 3 + 1), ("step_started", n // 3), ("step_succeeded", n // 3), ("state", 1)}
    assert steps.replay(events.limit(0), F.current_timestamp(), RULES).count() == 0


UPLOAD = "id long, request_key string, sha256 string, created_at timestamp_ntz"


def upload(i, seconds, key, digest):
    return (i, key, digest, T0 + datetime.timedelta(seconds=seconds))


def answers(uploads, ttl, request_ttl):
    """Uploads in order, by hand."""
    holders, documents, found = {}, {}, {}
    for i, key, digest, at in sorted(uploads, key=lambda u: (u[3], u[0])):
        at = (at - T0).total_seconds()
        if key in holders and at < holders[key][1]:
            found[i] = ("replayed", found[holders[key][0]][1])
            continue
        if key is not None:
            holders[key] = (i, at + request_ttl)
        known = digest in documents and at < documents[digest][1]
        if not known:
            documents[digest] = (i, at + ttl)
        found[i] = ("deduplicated" if known else "created", documents[digest][0])
    return found


def test_ingest_answers_each_upload(spark):
    draw = random.Random(1)
    uploads = [upload(1, 0, "k", "a"), upload(2, 10, None, "a"), upload(3, 20, "k", "b"), upload(4, 99, "k", "a"), upload(5, 100, "k", "b"), upload(6, 150, "m", "b"), upload(7, 199, "m", "c"), upload(8, 399, None, "a"), upload(9, 400, None, "a")]
    want = answers(uploads, 400, 100)
    # The third brings another text under a key that is held: it gets the first one's document.
    assert want[3] == ("replayed", 1) and want[5] == ("created", 5) and want[7] == ("replayed", 5) and want[8] == ("deduplicated", 1) and want[9] == ("created", 9)
    uploads += [upload(20 + i, 500 + draw.randrange(3000), draw.choice([None, "x", "y", "z"]), draw.choice("abc")) for i in range(60)]
    want = answers(uploads, 400, 100)
    end = upload(1000, 9000, None, "end")
    for batches in ([[*uploads, end]], [uploads[i::4] for i in range(4)] + [[end]]):
        delay = "60 seconds" if len(batches) == 1 else "2 hours"  # in four batches, rows of all times are mixed
        got = ran(spark, batches, lambda s: ingest.ingest(s, delay, 400, 100), UPLOAD).filter("id < 1000").collect()
        upto = 9000 - (60 if len(batches) == 1 else 7200)
        assert {r.id: (r.outcome, r.document) for r in got} == {i: a for i, a in want.items() if next(u[3] for u in uploads if u[0] == i) <= T0 + datetime.timedelta(seconds=upto)}
    assert len(got) > 20
