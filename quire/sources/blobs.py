"""Content-addressed blobs and archives, as DataFrames of keys and bytes."""

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.lineage import shared_folder

TASK_BLOBS, TASK_BYTES = 10_000, 64 << 20
HELD_BLOBS, HELD_BYTES = 200, 8 << 20

# Fixed values, limits on archives: entries, bytes in all, bytes out per byte in, archives within.
MAX_ENTRIES, MAX_TOTAL, MAX_RATIO, MAX_DEPTH = 500, 1 << 30, 100, 1


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime and length of all blobs below a folder (names that begin with . or _ are left out, as by Spark's file sources; empty ones are not).

    The folders of a level are listed side by side by tasks, which write what they find to the shared folder; the driver learns only
    whether there is a further level.
    """

    def entries(parts):
        from pyarrow import fs

        for pdf in parts:
            for path in pdf.path:
                store, base = fs.FileSystem.from_uri(path)
                infos = [i for i in store.get_file_info(fs.FileSelector(base)) if i.base_name[:1] not in "._"]
                yield pd.DataFrame({"path": pd.Series([f"{path}/{i.base_name}" for i in infos], dtype=object), "folder": [i.type == fs.FileType.Directory for i in infos],
                                    "modificationTime": pd.to_datetime([i.mtime_ns for i in infos], utc=True).floor("ms"), "length": [i.size or 0 for i in infos]})

    found, width = f"{shared_folder(spark)}/listing-{uuid.uuid4().hex}", 4 * spark.sparkContext.defaultParallelism
    folders, levels = spark.createDataFrame([(folder.rstrip("/"),)], "path string"), []
    while not folders.isEmpty():
        levels.append(f"{found}/{len(levels)}")
        folders.repartition(width, "path").mapInPandas(entries, "path string, folder boolean, modificationTime timestamp, length long").write.parquet(levels[-1])
        folders = spark.read.parquet(levels[-1]).filter("folder").select("path")
    return spark.read.parquet(*levels).filter("not folder").drop("folder")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length and content of all blobs below a folder; each task reads some TASK_BYTES or TASK_BLOBS of them."""

    def read(parts):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for pdf in parts:
            pdf, held, first = pdf.astype({"path": object}), [], 0
            for i, path in enumerate(pdf.path):
                with store.open_input_file(fs.FileSystem.from_uri(path)[1]) as blob:
                    held.append(blob.read())
                if i + 1 == len(pdf) or sum(map(len, held)) >= HELD_BYTES or len(held) >= HELD_BLOBS:
                    yield pdf.iloc[first : i + 1].assign(content=held)
                    held, first = [], i + 1

    files = listed(spark, folder)
    size = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    tasks = 1 + max(size.n // TASK_BLOBS, size.bytes // TASK_BYTES)
    return files.repartition(tasks, "path").mapInPandas(read, "path string, modificationTime timestamp, length long, content binary")


def write(rows: DataFrame, folder: str) -> None:
    """rows: blob_key, content. A file for each blob, written by the executors to a shared store.

    A blob appears under its key by a move once it is whole, so a task that is run again does no harm.
    """

    def put(parts):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for row in parts:
            path = f"{base}/{row.blob_key}"
            store.create_dir(path.rpartition("/")[0])
            draft = f"{base}/.drafts/{uuid.uuid4().hex}"
            store.create_dir(f"{base}/.drafts")
            with store.open_output_stream(draft) as out:
                out.write(bytes(row.content))
            store.move(draft, path)

    rows.select("blob_key", "content").foreachPartition(put)


def exists(rows: DataFrame, stored: DataFrame) -> DataFrame:
    return rows.join(stored.select("blob_key").distinct().withColumn("_s", F.lit(True)), "blob_key", "left").withColumn("stored", F.coalesce("_s", F.lit(False))).drop("_s")


def collectable(documents: DataFrame) -> DataFrame:
    """Digests of deleted documents that no live document shares."""
    gone = documents.filter("deleted_at is not null").select("sha256").distinct()
    return gone.join(documents.filter("deleted_at is null").select("sha256"), "sha256", "left_anti")


def manifest(files: DataFrame) -> DataFrame:
    """files: document_id, original_filename, content. One row per distinct content."""
    each = files.select("document_id", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size_bytes"), T.sniff_mime(F.col("content"), F.col("original_filename")).alias("mime"))
    found = each.groupBy("sha256").agg(F.min("document_id").alias("document_id"), F.count("*").alias("copies"), F.max("size_bytes").alias("size_bytes"), F.min_by("mime", "document_id").alias("mime"))
    return found.withColumn("blob_key", T.original_key(F.col("sha256")))


def over_limits(entries: DataFrame, most: int = MAX_ENTRIES, total: int = MAX_TOTAL, ratio: float = MAX_RATIO, depth: int = MAX_DEPTH) -> DataFrame:
    """entries: archive, size, packed (bytes as stored), depth (0 for an entry of the archive itself, 1 for one of an archive in it, ...).
    Per archive: entries, total, ratio (of its worst entry; any bytes out of none are infinitely many), depth and the first limit it breaks as problem."""
    each = F.when(F.col("size") == 0, 0.0).when(F.col("packed") == 0, float("inf")).otherwise(F.col("size") / F.col("packed"))
    found = entries.groupBy("archive").agg(F.count("*").alias("entries"), F.sum("size").cast("long").alias("total"), F.max(each).alias("ratio"), F.max("depth").alias("depth"))
    broken = F.when(F.col("entries") > most, "too_many_entries").when(F.col("total") > total, "too_large").when(F.col("ratio") > ratio, "ratio").when(F.col("depth") > depth, "nested")
    return found.withColumn("problem", broken)


def pack(entries: DataFrame) -> DataFrame:
    """entries: archive, name, content. One ZIP per archive (an archive must fit a task)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in sorted(zip(pdf.name, pdf.content, strict=True)):
                z.writestr(zipfile.ZipInfo(name), content)
        return pd.DataFrame({"archive": [pdf.archive.iloc[0]], "content": [out.getvalue()]})

    return entries.groupBy("archive").applyInPandas(run, "archive string, content binary")


def expand(archives: DataFrame, max_entries: int = MAX_ENTRIES, max_total: int = MAX_TOTAL, max_ratio: int = MAX_RATIO) -> DataFrame:
    """archives: archive, content. Entries as archive, name, content, problem.

    Headers are looked at before anything is unpacked. An archive over a limit, or that cannot be
    read, gives one row with the problem; so do entries that would leave the folder and archives
    within archives, which are not unpacked.
    """

    def entries(archive, content):
        try:
            z = zipfile.ZipFile(io.BytesIO(content))
            infos = [i for i in z.infolist() if not i.is_dir()]
            total = sum(i.file_size for i in infos)
            if len(infos) > max_entries:
                yield archive, None, None, "too_many_entries"
            elif total > max_total:
                yield archive, None, None, "too_large"
            elif total > max_ratio * max(1, len(content)):
                yield archive, None, None, "ratio"
            else:
                for i in infos:
                    plain = i.filename.replace("\\", "/")
                    if plain.startswith("/") or plain[1:2] == ":" or ".." in plain.split("/"):
                        yield archive, i.filename, None, "path"
                    elif plain.lower().endswith(".zip"):
                        yield archive, i.filename, None, "nested"
                    else:
                        yield archive, i.filename, z.read(i), None
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError):
            yield archive, None, None, "unreadable"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in parts:
            for archive, content in zip(pdf.archive, pdf.content, strict=True):
                for entry in entries(archive, content):
                    held.append(entry)
                    size += len(entry[2] or b"")
                    if size >= HELD_BYTES:
                        yield pd.DataFrame(held, columns=names, dtype=object)
                        held, size = [], 0
        yield pd.DataFrame(held, columns=names, dtype=object)

    names = ["archive", "name", "content", "problem"]
    # By archive, so that a task holds one and not a batch of them.
    return archives.select("archive", "content").groupBy("archive").applyInPandas(run, "archive string, name string, content binary, problem string")
