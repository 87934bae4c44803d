"""Blobs of a shared store as data sources: read in byte ranges, written once under their keys.

`spark.read.format("blob_ranges")` gives a row for each range of at most `range_bytes` of each blob below `path`; a
large blob is many ranges and so many tasks, and small ones share a task. `rows.write.format("blobs")` takes rows of
blob_key, part, content and size, in which a blob's parts follow one another in a task. A key that exists is skipped;
a blob whose bytes are not of the declared size is rejected; others appear under their key whole, by a move. Each task leaves a
report of outcomes, which counts once the job is committed; what tasks of a failed job have drafted is removed with it.
A reader hands on some HELD_BYTES at a time, and a writer takes bytes from Arrow batches as they are and reports outcomes as they come,
so a worker holds a batch, and nothing that grows with its task.

Both classes are made within a function, so that workers get them by value and need no package.
"""

import hashlib
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_BYTES, TASK_BYTES, TASK_RANGES = 8 << 20, 64 << 20, 10_000
HELD_BYTES, HELD_RANGES = 4 << 20, 1_000
RANGE = "blob_key string, part int, start long, length long, size long, content binary"
WRITTEN = "blob_key string, part int, content binary, size long"
OUTCOME = "blob_key string, outcome string, size long"


def _sources():
    import json
    import os
    import uuid
    from dataclasses import dataclass

    import pyarrow as pa
    from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

    def store_of(path):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path)

    class RangeReader(DataSourceReader):
        def __init__(self, options):
            self.path = options["path"]
            self.range_bytes, self.task_bytes = int(options.get("range_bytes", RANGE_BYTES)), int(options.get("task_bytes", TASK_BYTES))

        def partitions(self):
            from pyarrow import fs

            store, base = store_of(self.path)
            found, held, held_bytes = [], [], 0
            for info in store.get_file_info(fs.FileSelector(base, recursive=True)):
                key = info.path[len(base) :].lstrip("/")
                if info.type != fs.FileType.File or key.startswith("."):
                    continue
                for part, start in enumerate(range(0, max(info.size, 1), self.range_bytes)):
                    length = min(self.range_bytes, info.size - start)
                    if held and (held_bytes + length > self.task_bytes or len(held) == TASK_RANGES):
                        found.append(InputPartition(held))
                        held, held_bytes = [], 0
                    held.append((key, part, start, length, info.size))
                    held_bytes += length
            return [*found, InputPartition(held)]

        def read(self, partition):
            store, base = store_of(self.path)
            names, kinds = zip(*(c.split() for c in RANGE.split(", ")), strict=True)
            schema = pa.schema(list(zip(names, ({"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[k] for k in kinds), strict=True)))
            held, held_bytes = [], 0
            for key, part, start, length, size in partition.value:
                if held and (held_bytes + length > HELD_BYTES or len(held) == HELD_RANGES):
                    yield pa.record_batch(list(zip(*held, strict=True)), schema=schema)
                    held, held_bytes = [], 0
                with store.open_input_file(f"{base}/{key}") as blob:
                    blob.seek(start)
                    held.append((key, part, start, length, size, blob.read(length)))
                held_bytes += length
            if held:
                yield pa.record_batch(list(zip(*held, strict=True)), schema=schema)

    class BlobRanges(DataSource):
        @classmethod
        def name(cls):
            return "blob_ranges"

        def schema(self):
            return RANGE

        def reader(self, schema):
            return RangeReader(self.options)

    @dataclass
    class Reported(WriterCommitMessage):
        report: str
        written: int

    class BlobWriter(DataSourceArrowWriter):
        def __init__(self, options):
            self.path, self.job = options["path"], options["job"]

        def write(self, batches):
            from pyarrow import fs

            store, base = store_of(self.path)
            drafts = f"{base}/.drafts/{self.job}"
            store.create_dir(drafts)
            report, state, written = f"{drafts}/report-{uuid.uuid4().hex}", {}, 0

            def there(key):
                return store.get_file_info(f"{base}/{key}").type != fs.FileType.NotFound

            def rows():
                for batch in batches:
                    yield from zip(batch.column("blob_key"), batch.column("content"), batch.column("size"), strict=True)
                    del batch  # not held while the next one is read

            def end():
                """Of a blob: the outcome goes to the report. True if it was written."""
                if not state:
                    return False
                if state["out"] is None:
                    outcome = "exists"
                else:
                    state["out"].close()
                    outcome = "written" if state["bytes"] == state["size"] or state["size"] is None else "rejected"
                    if outcome == "written":
                        store.create_dir(os.path.dirname(f"{base}/{state['key']}"))
                        store.move(state["draft"], f"{base}/{state['key']}")
                    else:
                        store.delete_file(state["draft"])
                told.write((json.dumps({"blob_key": state["key"], "outcome": outcome, "size": state["bytes"]}) + "\n").encode())
                state.clear()
                return outcome == "written"

            with store.open_output_stream(report) as told:
                for key, content, size in rows():
                    key = key.as_py()
                    if key != state.get("key"):
                        written += end()
                        draft = f"{drafts}/{uuid.uuid4().hex}"
                        state.update(key=key, size=size.as_py(), bytes=0, draft=draft, out=None if there(key) else store.open_output_stream(draft))
                    if content.is_valid:
                        data = content.as_buffer()
                        state["bytes"] += data.size
                        if state["out"] is not None:
                            state["out"].write(data)
                    content = data = None
                written += end()
            return Reported(report, written)

        def commit(self, messages):
            store, base = store_of(self.path)
            store.create_dir(f"{base}/.reports/{self.job}")
            for m in messages:
                if m is not None:
                    store.move(m.report, f"{base}/.reports/{self.job}/{os.path.basename(m.report)}")
            store.delete_dir(f"{base}/.drafts/{self.job}")

        def abort(self, messages):
            store, base = store_of(self.path)
            store.delete_dir(f"{base}/.drafts/{self.job}")

    class Blobs(DataSource):
        @classmethod
        def name(cls):
            return "blobs"

        def schema(self):
            return WRITTEN

        def writer(self, schema, overwrite):
            return BlobWriter(self.options)

    return BlobRanges, Blobs


def register(spark: SparkSession) -> None:
    for source in _sources():
        spark.dataSource.register(source)


def ranges(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """blob_key, part, start, length, size and content of each range."""
    register(spark)
    return spark.read.format("blob_ranges").option("path", folder).option("range_bytes", range_bytes).option("task_bytes", task_bytes).load()


def without_stored(rows: DataFrame, folder: str) -> DataFrame:
    """rows: blob_key, content and others. Contents whose keys are in the store already become null, so that they need not be shuffled; `put` finds these keys there."""

    @F.pandas_udf("boolean")
    def there(keys: pd.Series) -> pd.Series:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        return pd.Series([i.type != fs.FileType.NotFound for i in store.get_file_info([f"{base}/{k}" for k in keys])], dtype=bool)

    return rows.withColumn("content", F.when(~there("blob_key"), F.col("content")))


def put(rows: DataFrame, folder: str) -> DataFrame:
    """rows: blob_key, content, size (declared, null: unknown), and part if blobs come in several rows. Writes them, and returns the
    outcome of each key: written, exists or rejected."""
    spark, job = rows.sparkSession, uuid.uuid4().hex
    register(spark)
    parts = rows if "part" in rows.columns else rows.withColumn("part", F.lit(0))
    columns = [F.col("blob_key").cast("string"), F.col("part").cast("int"), F.col("content").cast("binary"), F.col("size").cast("long")]
    together = parts.select(*columns).repartition("blob_key").sortWithinPartitions("blob_key", "part")
    together.write.format("blobs").option("path", folder).option("job", job).mode("append").save()
    return spark.read.schema(OUTCOME).json(f"{folder}/.reports/{job}/*")


def digests(of: DataFrame) -> DataFrame:
    """of: ranges. blob_key, ranges, bytes and sha256 of each blob; its ranges are hashed one after the other, and never held together."""

    def run(parts):
        key, n, size, digest = None, 0, 0, None
        for pdf in parts:
            found = []
            for k, content in zip(pdf.blob_key, pdf.content, strict=True):
                if k != key:
                    if digest:
                        found.append((key, n, size, digest.hexdigest()))
                    key, n, size, digest = k, 0, 0, hashlib.sha256()
                digest.update(content)
                n, size = n + 1, size + len(content)
            yield pd.DataFrame(found, columns=["blob_key", "ranges", "bytes", "sha256"])
        yield pd.DataFrame([(key, n, size, digest.hexdigest())] if digest else [], columns=["blob_key", "ranges", "bytes", "sha256"])

    return of.repartition("blob_key").sortWithinPartitions("blob_key", "part").select("blob_key", "content").mapInPandas(run, "blob_key string, ranges long, bytes long, sha256 string")
