"""Near duplicates, components and vector searches against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import hamming, minhash, vector_dedup
from quire.llm.shingles import SEGMENT, Shingler
from quire.operators import components

DOCS = "doc_id long, text string"


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(n, linked):
    root = {i: i for i in n}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def near_copies(seed=3):
    draw = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(3000)]
    docs, n = [], 0
    for _ in range(12):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([30, 80, 300]))]
        for _ in range(draw.choice([1, 3, 25])):
            words = list(base)
            for _ in range(draw.randrange(0, max(1, len(words) // 40) + 1)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            docs.append((n, draw.choice([" ", "\n", "\t "]).join(w.upper() if draw.random() < 0.1 else w for w in words)))
            n += 1
    docs += [(n, "a b c"), (n + 1, "A  B c"), (n + 2, "a b"), (n + 3, ""), (n + 4, None), (n + 5, "É b c"), (n + 6, "é b c")]
    return docs


@pytest.mark.parametrize(("percent", "region"), [(85, 2048), (80, 2048), (85, 8)])
def test_near_duplicates_equal_brute_force(spark, percent, region):
    docs = near_copies()
    sets = {i: shingle_set(t) for i, t in docs}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if (sets[a] or sets[b]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = brute_components(sets, linked)
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(docs, DOCS), percent, region).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (i == want[i]) for i, r in got.items())


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    got = minhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {(r.component_id, r.kept) for r in got if r.doc_id is None} == {(None, True)}
    assert {r.component_id for r in got if r.doc_id in (6, 7)} == {6}
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id in (2, 3, 4)} == {2: 0, 3: 0, 4: 0}
    stay = minhash.deduplicate(odd_docs)
    assert stay.columns == odd_docs.columns
    kept = sorted((r.doc_id or -1, (r.text or "")[:9]) for r in stay.collect())
    assert kept == sorted([(1, "one two t"), (1, "another t"), (2, ""), (3, ""), (4, " \t\n"), (-1, "one two t"), (5, kept[[k[0] for k in kept].index(5)][1]), (6, "short wor"), (8, "mail a.b@")])
    assert minhash.near_duplicates(no_docs).count() == 0 and minhash.deduplicate(no_docs).count() == 0


def test_words_of_long_texts_do_not_depend_on_segments():
    s, word = Shingler(), b"x" * (SEGMENT + 7)
    text = b"lead " + word + b" tail " + b"many words " * 60_000
    found = s.words(text)
    assert len(found) == len(text.split())
    assert found[0] == s.words(b"lead")[0] and found[1] == s.words(word)[0] and found[2] == s.words(b"tail")[0]
    assert set(found[3:].tolist()) == set(s.words(b"many words").tolist())


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(("shard", "recall", "blocks"), [(1000, 0.999, 2048), (60, 0.999, 2048), (60, 1.1, 64)])
def test_vector_links_equal_brute_force(spark, monkeypatch, shard, recall, blocks):
    """In one shard a label, in several, and where no round's recall is enough, so that all labels end in blocks."""
    monkeypatch.setattr(vector_dedup, "SHARD", shard)
    monkeypatch.setattr(vector_dedup, "LEAST_RECALL", recall)
    monkeypatch.setattr(vector_dedup, "MAX_SHARD", blocks)
    draw = np.random.default_rng(5)
    rows, n = [], 0
    for group in range(40):
        base = draw.standard_normal(16)
        for _ in range(int(draw.choice([1, 2, 12]))):
            rows.append((n, (base + 0.25 * draw.standard_normal(16)).astype(np.float32).tolist(), group % 3))
            n += 1
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 1), (n + 2, [0.0] * 16, 0), (n + 3, None, 0), (n + 4, [float("nan")] + [1.0] * 15, 0), (n + 5, [None] + [1.0] * 15, 0),
             (n + 6, [2 * x for x in rows[0][1]], 0), (n + 7, rows[0][1], None), (n + 8, [1.0, 0.0], 0), (n + 9, [], 0), (n + 10, [float("inf")] * 16, 0)]
    good = {i: (np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and all(x is not None for x in v) and np.isfinite(v).all() and any(v)}
    linked = [(a, b) for a, b in itertools.combinations(good, 2) if good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0])
              and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= 0.93]
    want = brute_components([r[0] for r in rows], linked)
    count = {r[0]: sum(r[0] in p for p in linked) for r in rows}
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_links for i, r in got.items()} == count
    assert vector_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_a_large_shard_is_counted_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "MAX_SHARD", 16)
    draw = np.random.default_rng(6)
    base = draw.standard_normal(8)
    rows = [(i, (base + 0.02 * draw.standard_normal(8)).astype(np.float32).tolist(), 1) for i in range(60)]
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r.n_links for r in got} == {59} and {r.component_id for r in got} == {0}


@pytest.mark.parametrize("dim", [5, 64, 100])
def test_hamming_search_equals_brute_force(spark, dim):
    draw = np.random.default_rng(dim)
    vectors = draw.standard_normal((160, dim)).astype(np.float32)
    vectors[20:60] = vectors[20]  # many equal codes
    vectors[70:100] = vectors[70] + 0.3 * draw.standard_normal((30, dim))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(200, None), (150, vectors[150].tolist()), (250, [None] * dim), (300, [])]
    bits = vectors > 0
    want = []
    for q in range(0, 160, 50):
        near = sorted((int((bits[q] != bits[i]).sum()), i) for i in range(160) if i != q)[:7]
        want += [(q, rank, i, d) for rank, (d, i) in enumerate(near, 1)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    for block, group in ((1000, 1000), (40, 2)):
        got = sorted(tuple(r) for r in hamming.top_k(df, df.id % 50 == 0, 7, block, group).collect())
        assert got == sorted(want)
    assert hamming.top_k(df.limit(0), df.id % 50 == 0).count() == 0


def test_the_audit_counts_what_is_missed(spark):
    draw = np.random.default_rng(8)
    rows = [(10 * g + i, (b + 0.02 * draw.standard_normal(12)).astype(np.float32).tolist(), g % 2) for g in range(20) for b in [draw.standard_normal(12)] for i in range(3)]
    good = vector_dedup.usable(spark.createDataFrame(rows, VECTORS))
    nodes = good.groupBy(*vector_dedup.KEY).agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    exact = vector_dedup.compare_all(nodes, 0.93)
    assert sorted(vector_dedup.audit(nodes, exact, 0.93)) == [(0, 12, 60, 60), (1, 12, 60, 60)]
    part = exact.withColumn("n", F.when(F.col("node") < 10, 1).otherwise(F.col("n")).cast("long"))
    assert sorted(vector_dedup.audit(nodes, part, 0.93)) == [(0, 12, 60, 57), (1, 12, 60, 60)]
    none = exact.limit(0)
    assert sorted(vector_dedup.audit(nodes, none, 0.93)) == [(0, 12, 60, 0), (1, 12, 60, 0)]


def test_graphs_hold_tight_groups_together():
    """A group whose members lie at different distances from its middle, among spread-out vectors: the search alone meets nearly all of it."""
    draw = np.random.default_rng(9)
    middle = draw.standard_normal(64)
    group = middle + draw.uniform(0.01, 0.2, (230, 1)) * draw.standard_normal((230, 64))
    x = vector_dedup.unit(np.concatenate([group, draw.standard_normal((700, 64))]))
    graph = vector_dedup.build_graph(x)
    got = {(i, int(j)) for i, js in vector_dedup.in_range(x, graph, 0.93) for j in js}
    want = {(i, int(j)) for i, js in vector_dedup.all_in_range(x, 0.93) for j in js}
    assert got <= want and len(want - got - {(j, i) for i, j in got}) <= 0.002 * len(want) and len(want) > 40_000


def test_vector_queries_with_clashing_columns(spark, sf_dir):
    """Columns whose names the operators use inside, and others, change nothing."""
    plain = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    clash = plain.withColumns({c: F.lit(1) for c in ("node", "size", "h1", "h2", "vector", "copies", "shards", "task", "near", "n", "_of", "id", "code", "rank", "block", "query_id", "words", "distance")})
    told = lambda df: sorted(tuple(r) for r in df.collect())
    assert told(vector_dedup.near_duplicates(clash)) == told(vector_dedup.near_duplicates(plain))
    named = clash.drop("id").withColumnRenamed("vec_id", "id")
    assert told(hamming.top_k(named, named.id % 50 == 0)) == told(hamming.top_k(plain.select(F.col("vec_id").alias("id"), "embedding"), F.col("id") % 50 == 0))
