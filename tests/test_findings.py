"""What a review of a round found: small cases that failed before."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire import plans
from quire.functions import vectors
from quire.functions.vectors import nearest
from quire.operators import search
from tests.compare import assert_same, connect

QUERIES, SQL = plans.load()


@pytest.fixture()
def folder(spark, sf_dir, tmp_path):
    """The small tables with documents that have texts in common with others, and ids far beyond the small tables'."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    for of, like in ((8, 6), (7, 6), (10, 12), (13, 12)):
        docs.loc[docs.doc_id == of, "text"] = docs.loc[docs.doc_id == like, "text"].iloc[0]
    far = docs.iloc[100:140].copy()
    far["doc_id"] = range(43_180, 43_220)
    for name in os.listdir(sf_dir):
        if name != "documents.parquet":
            os.symlink(f"{sf_dir}/{name}", tmp_path / name)
    pd.concat([docs, far]).to_parquet(tmp_path / "documents.parquet", index=False)
    return str(tmp_path)


@pytest.mark.parametrize("name", ["attach_tag_on_dup", "soft_delete"])
def test_query_on_copies_and_late_marks(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert_same(df, connect(folder), SQL[name])
    if name == "attach_tag_on_dup":  # 6 has no tag of its own, though its copy 8 has one
        assert df.filter("document_id = 6 and attached").count() > 0
    else:  # marked at 2024-07-01 00:05, after the day of the purge
        assert df.filter("part = 'documents' and document_id = 43208 and marked").count() == 1


def test_text_rank_gives_all_hits_with_ranks(spark):
    docs = spark.range(300).select(F.col("id").alias("document_id"), F.concat(F.lit("common "), F.repeat(F.lit("word "), (F.col("id") % 7 + 1).cast("int"))).alias("text"))
    queries = spark.createDataFrame([(1, ["common", "word"]), (2, ["word"]), (3, ["absent"]), (4, ["word"])], "query_id long, words array<string>")
    columns = ["query_id", "document_id", "score", "rank"]
    got = sorted(search.text_rank(docs, queries).select(*columns).collect())
    assert got == sorted(search.bm25(docs, queries, 300).select(*columns).collect()) and len(got) == 900
    assert SQL["text_rank"].rstrip().endswith("from lexical_ranked")


def test_blocks_keep_behind_what_cannot_be_near(spark, monkeypatch):
    draw = np.random.default_rng(5)
    x = draw.standard_normal((3_000, 8)).round(1)  # with ties
    x[100:160] = x[7]
    rows = spark.createDataFrame(pd.DataFrame({"document_id": np.arange(len(x)), "embedding": x.tolist()}), "document_id long, embedding array<double>")
    queries = rows.filter("document_id % 100 = 7").withColumnRenamed("document_id", "query_id")
    columns = ["query_id", "rank", "document_id", "score"]
    whole = sorted(nearest(rows, queries, 40).select(*columns).collect())
    monkeypatch.setattr(vectors, "ROWS", 200)
    assert sorted(nearest(rows, queries, 40).select(*columns).collect()) == whole
    monkeypatch.setattr(vectors, "HANDED_ON", 0)
    assert sorted(nearest(rows, queries, 40).select(*columns).collect()) == whole and len(whole) == 1200
    assert sorted(nearest(rows, queries, 4000).select(*columns).collect())[:5] == whole[:5]


ODD = ["Wide spaces.\u00a0\u3000Next one. \u2009\n\u3000\u00a0\n\u202fLast line.\u00a0", "A tab.\x0bNot a new sentence.\x0b\x0b And one. \x0b more", "Lines\r|a|b|\r\n|c|d|\r\nends\n\r", "Other lines\u2028|a|b|\u0085|c|\n\u0085\n\u2029",
       "|h|\n|1|\n\u00a0\n| |\n\n\n\r\n\n", "\u00a0", "x" * 2500 + "\u00a0 " + "\u3000y" * 1500 + " \u00a0", "\u65e5\u672c\u8a9e\u3000" * 700]


@pytest.mark.parametrize("name", ["chunk_pages", "chunker", "chunk_windows", "sentence_split"])
def test_chunks_of_odd_white_space_are_those_of_sql(spark, sf_dir, tmp_path, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().iloc[: 3 * len(ODD)].copy()
    docs["text"] = [*ODD, *("\n\n".join(ODD[i:] + ODD[:i]) for i in range(len(ODD))), *(t.replace(" ", "\x0b ") for t in ODD)]
    docs.to_parquet(tmp_path / "documents.parquet", index=False)
    if name == "chunk_windows":  # its SQL counts characters only, as no text of the tables has wide letters
        docs[~docs.text.str.contains("\u65e5")].to_parquet(tmp_path / "documents.parquet", index=False)
    assert_same(QUERIES[name](spark, str(tmp_path)), connect(str(tmp_path)), SQL[name])


def test_streams_call_the_state_store_by_group_and_not_by_key(spark, tmp_path):
    """Many keys are few groups: Spark keeps a timer and a state for each of these."""
    import datetime

    from quire.streaming import ordered, streams

    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        start = datetime.datetime(2024, 1, 1)
        rows = [(i, i // 3 if i // 3 else None, "failed", start + datetime.timedelta(seconds=i)) for i in range(9_000)] + [(9_000, -1, "delivered", start + datetime.timedelta(days=1))]
        spark.createDataFrame(rows, "id long, webhook_id long, status string, created_at timestamp_ntz").write.parquet(f"{tmp_path}/in")
        read = streams.read(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
        query = streams.webhook_health(read, 3).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        timers = sum(o["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress for o in p["stateOperators"] if "numRegisteredTimers" in o["customMetrics"])
        assert 0 < timers <= 2 * ordered.GROUPS < 3_000
        got = sorted(((r.webhook_id, r.id) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=lambda r: r[1])
        assert got == [(None, 2)] + [(i, 3 * i + 2) for i in range(1, 3_000)]
    finally:
        spark.conf.unset(key)


def test_scanned_blobs_are_listed_by_tasks(spark, tmp_path):
    """The same rows as those of Spark's own source, whose list of files goes through the driver; empty ones, which that leaves out, are there."""
    from quire.sources import blobs

    folder = tmp_path / "store"
    for name, content in {"top": b"1", "a/b/deep": b"23", "a/empty": b"", "a/x y%20,ü": b"4" * 999, ".drafts/d": b"5", "_tmp/e": b"6", "a/.hidden": b"7"}.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(content)
    (folder / "c").mkdir()
    columns = ["modificationTime", "length", "content"]
    found = blobs.scan(spark, str(folder))
    assert [r.path for r in found.filter("length = 0").collect()] == [str(folder / "a/empty")]
    assert sorted(found.filter("length > 0").select(*columns).collect()) == sorted(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(folder)).select(*columns).collect())
    assert {r.path for r in found.collect()} == {str(folder / n) for n in ("top", "a/b/deep", "a/empty", "a/x y%20,ü")}
    assert not any(str(folder) in f for f in found.inputFiles())


def test_archives_are_expanded_one_at_a_time(spark, monkeypatch):
    from quire.sources import blobs

    monkeypatch.setattr(blobs, "HELD_BYTES", 1_000)  # several frames an archive
    files = spark.range(60).select(F.concat(F.lit("a"), F.col("id") % 3).alias("archive"), F.concat(F.lit("f"), "id").alias("name"), F.md5(F.col("id").cast("string")).cast("binary").alias("content"))
    packed = blobs.pack(files).unionByName(spark.createDataFrame([("broken", bytearray(b"PK"))], "archive string, content binary")).coalesce(1)
    found = blobs.expand(packed)
    assert sorted((r.archive, r.name, bytes(r.content)) for r in found.filter("problem is null").collect()) == sorted((r.archive, r.name, bytes(r.content)) for r in files.collect())
    assert [(r.archive, r.name, r.problem) for r in found.filter("problem is not null").collect()] == [("broken", None, "unreadable")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "InPandas" in plan


def test_pairs_of_events_and_webhooks_take_little_room(spark, sf_dir, tmp_path):
    """Pairs lie by blocks when they are written; odd keys match as in SQL."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").toPandas()
    events = pd.concat([events.assign(event_id=events.event_id + i * len(events), user_id=(events.user_id + i).astype("Int64")) for i in range(5)])
    events["event_id"] = events.event_id.astype("Int64")
    events.iloc[5:400:7, events.columns.get_loc("user_id")] = None
    events.iloc[6:400:7, events.columns.get_loc("event_id")] = None
    events.iloc[8:400:7, events.columns.get_loc("event_id")] = 8
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").toPandas()
    suppliers = pd.concat([suppliers.assign(s_suppkey=suppliers.s_suppkey + i * len(suppliers), s_nationkey=((suppliers.s_nationkey + i) % 25).astype("Int64")) for i in range(400)])
    suppliers.iloc[3:100:9, suppliers.columns.get_loc("s_nationkey")] = None
    for name, rows in (("events", events), ("supplier", suppliers)):
        rows.to_parquet(tmp_path / f"{name}.parquet", index=False, coerce_timestamps="us")
    df = QUERIES["subscription_match"](spark, str(tmp_path))
    assert_same(df, connect(str(tmp_path)), SQL["subscription_match"])
    assert df.filter("id is null").count() > 0 and df.filter("id = 8").count() > 20
    df.write.parquet(f"{tmp_path}/out")
    written = sum(os.path.getsize(f"{tmp_path}/out/{f}") for f in os.listdir(f"{tmp_path}/out") if f.endswith(".parquet"))
    assert written < 0.55 * df.count()


def test_blob_workers_hold_a_batch_and_not_their_task(tmp_path):
    import json

    import pyarrow as pa

    from quire.sources import blob_store

    ranges, blobs = blob_store._sources()
    mb, held = 1 << 20, []

    def batches():
        for i in range(12):
            held.append(pa.total_allocated_bytes() - before)
            yield pa.record_batch({"blob_key": pa.array([f"k{i:02}/{j}" for j in range(3)]), "part": pa.array([0] * 3, pa.int32()), "content": pa.array([bytes([i]) * mb] * 3), "size": pa.array([mb, None, mb + 1])})

    before = pa.total_allocated_bytes()
    writer = blobs({"path": str(tmp_path), "job": "j"}).writer(None, False)
    message = writer.write(batches())
    writer.commit([message, None])
    assert max(held) < 4 * mb and message.written == 24
    (report,) = (tmp_path / ".reports/j").iterdir()
    outcomes = {o["blob_key"]: o["outcome"] for o in map(json.loads, report.read_text().splitlines())}
    assert outcomes == {f"k{i:02}/{j}": "rejected" if j == 2 else "written" for i in range(12) for j in range(3)}

    (tmp_path / "empty").mkdir()
    for i in range(20):
        (tmp_path / f"empty/{i}").touch()
    reader = ranges({"path": str(tmp_path)}).reader(None)
    found = {}
    for partition in reader.partitions():
        for batch in reader.read(partition):
            assert batch.column("content").nbytes <= blob_store.HELD_BYTES + mb
            found |= {r["blob_key"]: r["content"] for r in batch.to_pylist()}
    assert found == {f"k{i:02}/{j}": bytes([i]) * mb for i in range(12) for j in range(2)} | {f"empty/{i}": b"" for i in range(20)}


def test_keys_of_uniqueness_rules_are_dealt_evenly_and_held_once(spark):
    """Short keys that are much alike were put into one task, and held by those before the shuffle as well."""
    from quire.operators import rules

    rows = spark.range(8_000).select((F.col("id") % 4_000).alias("id"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("kind"), F.lit(True).alias("current"))
    unique = (rules.Unique("a", ("id",)), rules.Unique("a", ("kind",)), rules.Unique("a", ("id", "kind"), "current"), rules.Unique("b", ("current",)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = rules.duplicates({"a": rows, "b": rows}.__getitem__, unique)
        got = {(r.rule, r.value): r.n for r in found.collect()}
        assert got == {("a(id)", str(i)): 2 for i in range(4_000)} | {("b(current)", "true"): 8_000}
        assert found.select(F.spark_partition_id()).distinct().count() == 16
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "HashAggregate" not in plan[plan.index("Exchange"):]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_events_meet_all_active_webhooks_of_their_kind(spark, sf_dir, tmp_path):
    """Also those whose supplier's nation is not the remainder of the document's id."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").toPandas().iloc[:40].assign(user_id=7)
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").toPandas().assign(s_nationkey=8)
    for name, rows in (("events", events), ("supplier", suppliers)):
        rows.to_parquet(tmp_path / f"{name}.parquet", index=False, coerce_timestamps="us")
    kinds = {"signup": "uploaded", "error": "step_failed", "purchase": "validated"}
    wanted = [(e.event_id, s.s_suppkey) for e in events.itertuples() for s in suppliers.itertuples()
              if e.event_type in kinds and s.s_acctbal > 0 and (s.s_suppkey + len(kinds[e.event_type])) % 2 == 0]
    df = QUERIES["subscription_match"](spark, str(tmp_path))
    assert sorted((r.id, r.webhook_id) for r in df.collect()) == sorted(wanted) and wanted
    assert_same(df, connect(str(tmp_path)), SQL["subscription_match"])


def test_blobs_of_all_sizes_are_written(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    docs = docs[(docs.doc_id > 0) & (docs.doc_id < 60)].copy()
    docs["text"] = [f"{i} " + "ä" * (10_000 if i % 2 else 300_000) if i % 4 else t for i, t in zip(docs.doc_id, docs.text, strict=True)]
    docs.to_parquet(tmp_path / "documents.parquet", index=False)
    df = QUERIES["sink_blobs_dedup"](spark, str(tmp_path))
    assert_same(df, connect(str(tmp_path)), SQL["sink_blobs_dedup"])
    assert df.filter("document_id % 4 != 0").groupBy().pivot("outcome").count().first().asDict() == {"exists": 15, "rejected": 4, "written": 26}


def test_pairs_of_a_block_are_dealt_to_several_tasks(spark, sf_dir):
    """Few blocks were few tasks; webhooks, which are there once for each slice, were sent along by the size of one slice."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = QUERIES["subscription_match"](spark, f"{os.path.dirname(sf_dir)}/sf0.01")  # one block
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 3 and max(sizes) < 0.5 * sum(sizes)
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
