"""What a review of a round found in the training-data operators: small cases that failed before."""

import random

from pyspark.sql import functions as F

from quire.llm import minhash, pii


def test_crowded_regions_lose_no_link(spark):
    """Texts that share most of their words, so that they crowd all trees, in pairs that alone are alike enough."""
    draw, texts = random.Random(3), []
    common = [f"common{i}" for i in range(400)]
    for i in range(60):
        own = [f"own{i}x{j}" for j in range(20)]
        for k in range(2):
            texts.append(" ".join(common + own + [f"last{i}x{k}y{j}" for j in range(32)]))
    draw.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    alike = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert len(alike) == 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 85, max_region=4).collect()}
    assert got == {i: min([i, *(j for a, j in alike if a == i)]) for i in range(len(texts))}


def test_trees_learn_from_all_documents(spark, monkeypatch):
    """Candidates are in a few of the documents only; none of these may be left out."""
    monkeypatch.setattr(pii, "MAX_TRAIN_DOCS", 10, raising=False)
    line = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("password: Xy7"), F.md5(F.col("doc_id").cast("string")), F.lit(" and see 2024-01-17 11:45 or "), F.repeat(F.lit("ab-"), 8))).otherwise("plain words")
    scanned = pii.scan(spark.range(600).withColumnRenamed("id", "doc_id").withColumn("text", line))
    assert pii.learn(scanned) is not None
