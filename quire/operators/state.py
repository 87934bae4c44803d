"""Transitions of the step table, in batch: (steps, commands) -> new steps.

steps: document_id, step, status, attempt, max_attempts, started_at, finished_at, duration_ms, error_code.
A command whose precondition does not hold leaves its row alone, and is among the rejected ones.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.values import duration_ms
from quire.operators.lineage import cut
from quire.operators.relations import insert_missing, last_per_key
from quire.sources.tables import STEP_ORDER

KEY = ["document_id", "step"]
COLUMNS = [*KEY, "status", "attempt", "max_attempts", "started_at", "finished_at", "duration_ms", "error_code"]


def position(step: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STEP_ORDER]), step).cast("int")


def ensure_steps(steps: DataFrame, documents: DataFrame) -> DataFrame:
    """steps, with the missing ones of the six rows of each document."""
    every = documents.select("document_id").distinct().withColumn("step", F.explode(F.array(*[F.lit(s) for s in STEP_ORDER])))
    fresh = every.select(*KEY, F.lit("pending").alias("status"), F.lit(0).alias("attempt"), F.lit(3).alias("max_attempts"), *[F.lit(None).cast(steps.schema[c].dataType).alias(c) for c in COLUMNS[5:]])
    return insert_missing(steps.select(*COLUMNS), fresh, KEY)


def apply(steps: DataFrame, commands: DataFrame, allowed: Column, changes: dict[str, Column]) -> DataFrame:
    """steps with changes where a command meets an allowed row, and `applied` (null: no command).

    commands have unique keys; their other columns are named cmd_*.
    """
    met = steps.join(commands.withColumn("_met", F.lit(True)), KEY, "left")
    ok = F.coalesce(F.col("_met") & allowed, F.lit(False))
    met = met.withColumn("_ok", ok)
    return met.select(*[F.when(F.col("_ok"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in steps.columns], F.when(F.col("_met"), F.col("_ok")).alias("applied"))


def claim(steps: DataFrame, commands: DataFrame, at: Column) -> DataFrame:
    """pending -> running; of several claimants of a step the smallest wins."""
    one = last_per_key(commands, KEY, [F.col("claimant")]).select(*KEY, F.col("claimant").alias("cmd_claimant"))
    none = F.lit(None)
    return apply(steps, one, F.col("status") == "pending", {
        "status": F.lit("running"), "attempt": F.col("attempt") + 1, "started_at": at, "finished_at": none.cast("timestamp_ntz"), "duration_ms": none.cast("long"), "error_code": none.cast("string")})


def succeed(steps: DataFrame, commands: DataFrame, at: Column) -> DataFrame:
    """running -> succeeded, with the duration given or else the time since the start."""
    given = commands.select(*KEY, F.col("duration_ms").alias("cmd_ms"))
    return apply(steps, given, F.col("status") == "running", {
        "status": F.lit("succeeded"), "finished_at": at, "duration_ms": F.coalesce("cmd_ms", duration_ms(F.col("started_at"), at))})


def fail(steps: DataFrame, commands: DataFrame, at: Column) -> DataFrame:
    given = commands.select(*KEY, F.col("error_code").alias("cmd_error"))
    return apply(steps, given, F.col("status") == "running", {"status": F.lit("failed"), "finished_at": at, "error_code": F.col("cmd_error")})


def reset_from(steps: DataFrame, commands: DataFrame) -> DataFrame:
    """commands: document_id, from_step. That step and all later ones are pending again, as if new."""
    first = commands.groupBy("document_id").agg(F.min(position(F.col("from_step"))).alias("_from"))
    met = steps.join(first, "document_id", "left").withColumn("_hit", F.coalesce(position(F.col("step")) >= F.col("_from"), F.lit(False)))
    clear = {"status": F.lit("pending"), "attempt": F.lit(0), **{c: F.lit(None).cast(steps.schema[c].dataType) for c in COLUMNS[5:]}}
    return met.select(*[F.when(F.col("_hit"), clear[c]).otherwise(F.col(c)).alias(c) if c in clear else F.col(c) for c in COLUMNS])


def sweep_stuck(steps: DataFrame, as_of: Column, minutes: int = 30) -> DataFrame:
    """Steps that run for longer: pending again while attempts remain, else failed."""
    stuck = (F.col("status") == "running") & (F.col("started_at") < as_of - F.expr(f"interval {minutes} minutes"))
    after = F.when(F.col("attempt") < F.col("max_attempts"), "pending").otherwise("failed")
    return steps.withColumn("swept", F.coalesce(stuck, F.lit(False))).withColumn("status", F.when(F.col("swept"), after).otherwise(F.col("status")))


def document_status(steps: DataFrame, flags: DataFrame) -> DataFrame:
    """flags: document_id, quarantined, needs_review. The status that a document's steps amount to."""
    n = len(STEP_ORDER)
    seen = steps.groupBy("document_id").agg(
        F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status").isin("succeeded", "skipped")).alias("done"),
        F.count_if((F.col("step") != "store") & (F.col("status") != "pending")).alias("begun"))
    return seen.join(flags, "document_id", "left").select("document_id", F.when(F.col("quarantined"), "quarantined").when(F.col("failed") > 0, "failed")
        .when(F.col("done") == n, F.when(F.col("needs_review"), "pending_review").otherwise("completed")).when(F.col("begun") == 0, "received").otherwise("processing").alias("status"))


CLAIM = "key string, id long, won boolean, holder long, response string"


def claims_within_ttl(claims: DataFrame, ranges: int | None = None) -> DataFrame:
    """claims: key, at (whole number), id (unique), ttl, response. A claim is won if no earlier won claim of its key holds
    at its time (order: at, id); a lost one gets the response of the claim that holds. Returns key, id,
    won, holder (id of the claim that holds, its own if won) and response. A claim without key is always won.

    Claims are dealt into even ranges of (key, at, id), so a key of many claims is many ranges. What a range of such a
    key does to the time until which the key is held is a step function: for the first claim of the range that is
    at or after that time, the last claim won in the range. It is computed for all ranges side by side; the steps
    of a key's ranges, which are few where claims often expire, are gone through in order; and from
    the states found at their beginnings all ranges are folded side by side. A task holds three numbers
    a claim of its range at most. ranges: how many, if not as many as the session's shuffle settings give.
    """
    order = ["key", "at", "id"]
    keyed = claims.filter("key is not null").select(*order, "ttl", "response")
    placed = cut(keyed.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()))
    # At most one key for each border between ranges.
    split = placed.groupBy("key").agg(F.min("range").alias("a"), F.max("range").alias("b")).filter("a < b").select("key")

    def steps_of(key: str, number: int, at: np.ndarray, ttl: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        n = len(at)
        following = np.maximum(np.searchsorted(at, at + ttl), np.arange(1, n + 1))
        last = np.arange(n)
        for i in range(n - 1, -1, -1):
            if following[i] < n:
                last[i] = last[following[i]]
        upto, first = np.unique(at, return_index=True)
        met = last[first]
        keep = np.append(met[1:] != met[:-1], True)  # neighbouring claims that lead to one claim are one step
        return pd.DataFrame({"key": key, "range": number, "upto": upto[keep], "until": (at + ttl)[met[keep]], "holder": ids[met[keep]]})

    def summaries(parts):
        held: list[tuple[np.ndarray, ...]] = []
        name = None
        for pdf in parts:
            for key, of in pdf.groupby(["key", "range"], sort=False):
                if key != name and held:
                    yield steps_of(*name, *(np.concatenate(c) for c in zip(*held, strict=True)))
                    held = []
                name = key
                held.append((of["at"].to_numpy(), of["ttl"].to_numpy(), of["id"].to_numpy()))
        if held:
            yield steps_of(*name, *(np.concatenate(c) for c in zip(*held, strict=True)))

    def composed(parts):
        key = number = until = holder = None
        for pdf in parts:
            found = []
            for k, r, upto, then, by in zip(pdf.key, pdf["range"], pdf.upto, pdf.until, pdf.holder, strict=True):
                if k != key:
                    key, number, until, holder = k, None, None, None
                if r != number:
                    number, passed = r, False
                    if holder is not None:
                        found.append((key, r, until, holder))
                if not passed and (until is None or upto >= until):
                    until, holder, passed = then, by, True
            yield pd.DataFrame(found, columns=["key", "range", "until", "holder"])

    steps = placed.join(F.broadcast(split), "key", "left_semi").select("key", "range", "at", "ttl", "id").mapInPandas(summaries, "key string, range int, upto long, until long, holder long")
    begun = steps.repartition("key").sortWithinPartitions("key", "range", "upto").mapInPandas(composed, "key string, range int, until long, holder long")
    held = begun.join(placed.select("key", F.col("id").alias("holder"), F.col("response").alias("answer")), ["key", "holder"])

    def fold(parts):
        key = until = holder = answer = None
        for pdf in parts:
            out = []
            for k, at, i, ttl, response, u, h, a in zip(pdf.key, pdf["at"], pdf.id, pdf.ttl, pdf.response, pdf.until, pdf.holder, pdf.answer, strict=True):
                if k != key:
                    key, until, holder, answer = k, *((None, None, None) if pd.isna(h) else (int(u), int(h), a))
                won = holder is None or at >= until
                if won:
                    until, holder, answer = at + ttl, i, response
                out.append((k, i, won, holder, answer))
            yield pd.DataFrame(out, columns=["key", "id", "won", "holder", "response"])

    # Two rows a range at most: for the key that it begins with and for the one that it ends with.
    found = placed.join(F.broadcast(held), ["key", "range"], "left").select(*order, "ttl", "response", "until", "holder", "answer").mapInPandas(fold, CLAIM)
    return found.unionByName(claims.filter("key is null").select("key", "id", F.lit(True).alias("won"), F.col("id").alias("holder"), "response"))
