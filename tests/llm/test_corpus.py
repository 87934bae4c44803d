"""Operators over whole corpora: mixing, sharding and the pipeline."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall(text or ""))


def brute_targets(totals):
    names = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + ([None] if None in totals else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, budget = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(totals.values())
    while left and budget > 1e-9:
        level = budget / sum(weight[s] for s in left)
        full = {s for s in left if target[s] + weight[s] * level >= 2 * totals[s]}
        if not full:
            for s in left:
                target[s] += weight[s] * level
            break
        for s in full:
            budget -= 2 * totals[s] - target[s]
            target[s] = 2.0 * totals[s]
        left -= full
    return target


def test_mix_meets_its_targets(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for rows, got in ((docs.collect(), mixing.op2_mixing(spark, "/root/testdata/sf0.01").collect()),):
        totals = Counter()
        for r in rows:
            totals[r.source] += size(r.text)
        target, source = brute_targets(totals), {r.doc_id: r.source for r in rows}
        taken = Counter()
        assert len(got) == len(rows)
        for r in got:
            assert r.source_size == totals[source[r.doc_id]] and abs(r.target - target[source[r.doc_id]]) < 1e-6
            assert 0 <= r.taken <= 2 * r.size
            taken[source[r.doc_id]] += r.taken
        assert all(abs(taken[s] - target[s]) <= 2 * mixing.LEAST_PIECE for s in totals)
        assert sum(taken.values()) == int(1.5 * sum(totals.values()))  # the sort ends at the budget, to the word


def test_the_sort_over_all_sources_is_what_ends_the_mix(spark):
    """A smaller budget than the targets add up to cuts all sources at one virtual time; ties and repeated rows count each."""
    docs = spark.createDataFrame([(i // 2, "ab"[i % 2], 40) for i in range(400)] + [(7, "a", 40), (7, "a", 40), (None, "b", 40)], "doc_id int, source string, size long")
    each = mixing.turns(docs).drop("_range", "_in_range", "_ahead", "_run", "position").withColumn("words", F.lit(None).cast("long"))
    placed = mixing.in_virtual_time(each.withColumn("words", F.least(F.lit(16), F.col("size") - F.col("_from"))), 5000, 256).cache()
    assert placed.agg(F.sum("words")).first()[0] == 5000
    taken, left = placed.filter("words = least(16, size - _from)"), placed.filter("words = 0")
    assert taken.agg(F.max("finish")).first()[0] <= left.agg(F.min("finish")).first()[0]
    spent = {r.source: r.w / r.target for r in placed.groupBy("source").agg(F.sum("words").alias("w"), F.first("target").alias("target")).collect()}
    assert abs(spent["a"] - spent["b"]) < 0.01 and spent["a"] < 0.5


def test_mix_gives_texts_in_order(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    whole = {r.doc_id: r.text for r in docs.collect()}
    words, cut = 0, 0
    for r in mixed.collect():
        assert whole[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        cut += r.text != whole[r.doc_id]
        words += size(r.text)
    total = sum(size(t) for t in whole.values())
    assert 1.5 * total - 50 <= words <= 1.5 * total and cut <= docs.select("source").distinct().count()
    assert sorted(mixed.collect()) == sorted(mixing.mix(docs.repartition(3)).collect())
    odd = mixing.mix(odd_docs)
    assert odd.columns == odd_docs.columns and odd.filter("doc_id in (2, 3, 4)").count() == 0
    assert mixing.mix(no_docs).count() == 0 and mixing.mix(odd_docs.filter("doc_id = 3")).count() == 0


def test_targets_where_limits_bind(spark):
    totals = {"a": 10, "b": 1000, "c": 5, None: 300, "d": 0}
    df = spark.createDataFrame([(s, n) for s, n in totals.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(brute_targets(totals))


def check_shards(docs, got, n_shards):
    assert len(got) == len(docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_are_even_and_keep_copies_together(spark, odd_docs, no_docs):
    folder = "/root/testdata/sf0.01"
    docs, got = spark.read.parquet(f"{folder}/documents.parquet").collect(), sharding.op5_sharding(spark, folder).collect()
    check_shards(docs, got, 16)
    shards = defaultdict(set)
    for r, d in ((r, {d.doc_id: d.text for d in docs}) for r in got):
        shards[hashlib.md5((d[r.doc_id] or "").encode()).digest()].add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 1
    few = sharding.assign(sharding.fingerprinted(odd_docs), 3)
    check_shards(odd_docs.collect(), few.collect(), 3)
    assert sharding.assign(sharding.fingerprinted(no_docs)).count() == 0


def test_a_group_larger_than_a_shard_is_dealt_out(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 250, "same").otherwise(F.concat(F.lit("t"), (F.col("id") / 5).cast("int"))).alias("text"))
    got = sharding.assign(sharding.fingerprinted(docs), 4).collect()
    check_shards(docs.collect(), got, 4)
    small = defaultdict(set)
    for r in got:
        if r.doc_id >= 250:
            small[r.doc_id // 5].add(r.shard)
    assert sum(len(s) > 1 for s in small.values()) <= 3


@pytest.mark.parametrize("shares", [(1 / 3,), (0.55, 0.2), (1.0,)])
def test_groups_larger_than_a_shard_fill_whole_shards(spark, shares):
    """Each keeps nearly the pairs that full shards and one more can keep; small groups gather in the room left."""
    n, ends = 4800, [0]
    for x in shares:
        ends.append(ends[-1] + round(x * 4800))
    text = F.concat(F.lit("t"), (F.col("id") / 3).cast("int").cast("string"))
    for g in range(len(shares)):
        text = F.when(F.col("id").between(ends[g], ends[g + 1] - 1), f"large {g}").otherwise(text)
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))
    got = sharding.assign(sharding.fingerprinted(docs)).collect()
    check_shards(docs.collect(), got, 16)
    for g in range(len(shares)):
        of = ends[g + 1] - ends[g]
        held = Counter(r.shard for r in got if ends[g] <= r.doc_id < ends[g + 1])
        best = (of // 300 * 300**2 + (of % 300) ** 2) / of**2
        assert sum(k * k for k in held.values()) / of**2 >= 0.93 * best
    small = defaultdict(set)
    for r in got:
        if r.doc_id >= ends[-1]:
            small[r.doc_id // 3].add(r.shard)
    assert sum(len(s) > 1 for s in small.values()) <= 0.1 * max(1, len(small))


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "personal data", "mixing", "encoding"]
    clean = corpus_pipeline.drop_toxic(spark, docs, folder).cache()
    left = {r.doc_id for r in clean.select("doc_id").collect()}
    assert clean.columns == docs.columns
    assert sum(t == 0 and d not in left for d, t in labels.items()) <= 0.02 * len(labels)
    assert sum(t == 1 and d in left for d, t in labels.items()) <= 0.4 * sum(labels.values())
    single = corpus_pipeline.drop_near_copies(spark, clean, folder).cache()
    assert single.count() == single.select("text").distinct().count() and single.columns == docs.columns
    safe = corpus_pipeline.redact(spark, single, folder).cache()
    assert safe.count() == single.count() and safe.filter(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+")).count() == 0
    encoded = corpus_pipeline.run(spark, folder)
    mixed = corpus_pipeline.mix(spark, safe, folder)
    assert encoded.count() == mixed.count()
    assert encoded.filter("not parity or not round_trip").count() == 0


def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs, sf_dir):
    for table in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, sf_dir)
            assert out.count() >= 0
            if name != "encoding":
                assert out.columns == table.columns
