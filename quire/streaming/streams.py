"""Streams: windowed metrics, health and fan-out. (Ingest and the step machine are in modules of their own.)

Sources are streaming DataFrames with the columns of their batch twins; sinks are the caller's.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.streaming.ordered import InOrder, dealt, with_time


def read(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def timed(events: DataFrame, delay: str, at: str = "created_at") -> DataFrame:
    """With a watermark; timestamps without zone are taken as UTC."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)


def step_metrics(events: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts and duration sums per step and tumbling window."""
    return timed(events, delay).groupBy(F.window("created_at", width).alias("w"), "step").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "step_failed").alias("failed"), F.round(F.sum("value"), 4).alias("total")
    ).select(F.col("w.start").alias("start"), "step", "n", "failed", "total")


def rate_limit(requests: DataFrame, most: int, width: str = "10 minutes", slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Requests per key in sliding windows, and whether they are too many."""
    counts = timed(requests, delay).groupBy(F.window("created_at", width, slide).alias("w"), "key").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "key", "n", (F.col("n") > most).alias("over"))


def last_used(requests: DataFrame, width: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """At most one update per key and minute: the last use within it."""
    return timed(requests, delay).groupBy(F.window("created_at", width).alias("w"), "key").agg(F.max("created_at").alias("last")).select("key", "last")


class FailureCounter(InOrder):
    """Failures in a row of one webhook, in order of time; from `most` on it is disabled, once."""

    KEY, WAITING, STATE = "webhook_id long", "at long, id long, status string", "run long, disabled boolean"
    OUT, NULLABLE = ["webhook_id", "id"], {"webhook_id": "Int64"}

    def __init__(self, most: int):
        self.most = most

    def passed(self, key: tuple, state: tuple | None, rows: list[tuple], upto: int) -> tuple[tuple, list[tuple]]:
        run, disabled = state or (0, False)
        out = []
        for _, delivery, status in rows:
            run = 0 if status == "delivered" else run + 1
            if run >= self.most and not disabled:
                disabled = True
                out.append((*key, delivery))
        return (run, disabled), out


def webhook_health(deliveries: DataFrame, most: int = 20, delay: str = "1 hour") -> DataFrame:
    """deliveries: webhook_id, id, status, created_at. The delivery at which a webhook is disabled. Needs the RocksDB state store; what
    a trigger reads of one group of webhooks is sorted in memory, so triggers are bounded by the source's options."""
    keyed = dealt(with_time(deliveries, "created_at", "webhook_id", "id", "status").withWatermark("time", delay), "webhook_id")
    return keyed.transformWithStateInPandas(statefulProcessor=FailureCounter(most), outputStructType="webhook_id long, id long", outputMode="Append", timeMode="EventTime")


def fan_out(rows: DataFrame, good: str, bad: str, is_bad, checkpoint: str):
    """Rows to one folder, dead letters to another; a batch written again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.filter(~is_bad).write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.filter(is_bad).write.mode("overwrite").parquet(f"{bad}/batch={number}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all that is there, and read what came out."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
