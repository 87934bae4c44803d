"""Blob sources: ranges, checked writes, reruns and failures."""

import hashlib
import os
import uuid

import pytest
from pyspark.sql import functions as F

from quire.operators.lineage import shared_folder
from quire.sources import blob_store

BLOBS = {"a/one": b"1" * 10_000, "a/two": b"", "b/three": bytes(range(256)) * 3, "four": b"x"}


@pytest.fixture
def folder(spark):
    path = f"{shared_folder(spark)}/blobs-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def rows_of(spark, blobs, sizes=None):
    return spark.createDataFrame([(k, bytearray(v), (sizes or {}).get(k, len(v))) for k, v in blobs.items()], "blob_key string, content binary, size long")


def told(df):
    return {r.blob_key: (r.outcome, r.size) for r in df.collect()}


def test_ranges_are_tasks_of_their_own_and_hash_to_the_whole(spark, folder):
    assert told(blob_store.put(rows_of(spark, BLOBS), folder)) == {k: ("written", len(v)) for k, v in BLOBS.items()}
    ranges = blob_store.ranges(spark, folder, range_bytes=1000, task_bytes=2000)
    assert ranges.filter("blob_key = 'a/one'").select(F.spark_partition_id()).distinct().count() >= 5
    got = {(r.blob_key, r.part): bytes(r.content) for r in ranges.collect()}
    for key, content in BLOBS.items():
        assert b"".join(got[key, i] for i in range(max(1, -(-len(content) // 1000)))) == content
    assert {(r.blob_key, r.ranges, r.bytes, r.sha256) for r in blob_store.digests(ranges).collect()} == {(k, max(1, -(-len(v) // 1000)), len(v), hashlib.sha256(v).hexdigest()) for k, v in BLOBS.items()}


def test_writes_skip_what_exists_and_reject_wrong_sizes(spark, folder):
    first = {k: BLOBS[k] for k in ("a/one", "four")}
    assert told(blob_store.put(rows_of(spark, first), folder)) == {"a/one": ("written", 10_000), "four": ("written", 1)}
    before = os.stat(f"{folder}/four").st_mtime_ns
    found = told(blob_store.put(rows_of(spark, BLOBS, {"b/three": 767, "a/two": None}), folder))
    assert found == {"a/one": ("exists", 10_000), "four": ("exists", 1), "b/three": ("rejected", 768), "a/two": ("written", 0)}
    assert os.stat(f"{folder}/four").st_mtime_ns == before and not os.path.exists(f"{folder}/b/three")
    assert {o for o, _ in told(blob_store.put(rows_of(spark, first), folder)).values()} == {"exists"}  # a rerun writes nothing
    assert os.listdir(f"{folder}/.drafts") == []
    assert {r.blob_key for r in blob_store.ranges(spark, folder).collect()} == {"a/one", "a/two", "four"}


def test_parts_make_one_blob_in_order(spark, folder):
    parts = spark.range(50).select(F.concat(F.lit("k"), F.col("id") % 3).alias("blob_key"), F.col("id").cast("int").alias("part"), F.concat(F.col("id").cast("string"), F.lit(",")).cast("binary").alias("content"), F.lit(None).cast("long").alias("size"))
    assert {o for o, _ in told(blob_store.put(parts.orderBy(F.rand(1)), folder)).values()} == {"written"}
    assert open(f"{folder}/k2", "rb").read() == "".join(f"{i}," for i in range(2, 50, 3)).encode()


def test_a_failed_job_leaves_no_drafts_and_no_report(spark, folder):
    bad = rows_of(spark, BLOBS).withColumn("size", F.when(F.col("blob_key") == "four", F.raise_error(F.lit("broken"))).otherwise(F.col("size")))
    with pytest.raises(Exception, match="broken"):
        blob_store.put(bad, folder)
    assert not os.path.isdir(f"{folder}/.reports") and (not os.path.isdir(f"{folder}/.drafts") or os.listdir(f"{folder}/.drafts") == [])
    # What was whole by then stays: it lies under the key of its content.
    assert told(blob_store.put(rows_of(spark, BLOBS), folder)).keys() == BLOBS.keys()


def test_contents_of_stored_blobs_are_not_handed_on(spark, folder):
    blob_store.put(rows_of(spark, {k: BLOBS[k] for k in ("a/one", "four")}), folder)
    left = blob_store.without_stored(rows_of(spark, BLOBS), folder)
    assert {r.blob_key: r.content and bytes(r.content) for r in left.collect()} == {k: None if k in ("a/one", "four") else v for k, v in BLOBS.items()}
    assert told(blob_store.put(left, folder)) == {"a/one": ("exists", 0), "four": ("exists", 0), "b/three": ("written", 768), "a/two": ("written", 0)}
    assert blob_store.ranges(spark, folder).filter("blob_key = 'a/one'").first().size == 10_000
