"""The filter audit against a brute force over all orders, document by document."""

import re
from collections import defaultdict
from itertools import permutations
from math import factorial

from pyspark.sql import functions as F

from quire.llm import filter_audit
from tests.compare import assert_same, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failed(text, doc_id, least):
    words = WORD.findall(text)
    found = "A" if len(words) < 200 else ""
    found += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    found += "C" if 100 * sum("A" <= ch <= "Z" for ch in text) > 2 * len(text) else ""
    found += "D" if set(text) & set("#$%&*|") else ""
    return set(found + ("E" if doc_id is not None and least.get(text) is not None and doc_id > least[text] else ""))


def brute(docs, labels):
    docs = [(r.doc_id, r.text or "", r.source or "") for r in docs]
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text] = min(i, least.get(text, i))
    good, toxic = {r.doc_id for r in labels if r.quality == 1} - {None}, {r.doc_id for r in labels if r.toxic == 1} - {None}
    parts = defaultdict(list)
    for i, text, part in docs:
        parts[part].append((i, failed(text, i, least)))
    found = {}
    for part, of in parts.items():
        removed_by = defaultdict(int)
        for order in permutations("ABCDE"):
            alive = of
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in alive if f in x]
                alive = [(i, x) for i, x in alive if f not in x]
                removed_by[f] += len(gone)
                fails = sum(f in x for _, x in of)
                found[part, "".join(order), step] = [len(alive), len(gone), fails - len(gone), sum(x == {f} for _, x in of), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in found.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return found


def told(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in df.collect()}


def test_query_equals_brute_force_and_sql(spark, sf_dir):
    got = filter_audit.op13_filter_audit(spark, sf_dir)
    assert dict(got.dtypes) == {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(COLUMNS, "bigint")
    want = brute(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), spark.read.parquet(f"{sf_dir}/labels.parquet").collect())
    assert told(got) == want and got.count() == 600 * len({p for p, _, _ in want})
    assert_same(got, connect(sf_dir), filter_audit.oracle())


def test_odd_rows_labels_and_columns(spark, odd_docs, no_docs):
    """Nulls anywhere, repeated rows and ids, very long texts, clashing names; labels that repeat or hold nulls."""
    more = spark.createDataFrame([(9, "short words", "en", "a", 1), (5, "short words", "en", None, 1), (None, "short words", "en", "a", 1), (20, "A" * 50, "en", "", 1), (21, "x# " * 300, "en", "z", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd_docs.unionByName(more, allowMissingColumns=True).withColumns({c: F.lit(1) for c in ("part", "failed", "digest", "n", "good", "toxic", "state", "filter", "weight", "least")})
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (6, None, 1), (9, 1, None), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    got = filter_audit.audit(filter_audit.failures(docs, labels), "ABCDE", ("good", "toxic"))
    assert told(got) == brute(docs.collect(), labels.collect())
    assert filter_audit.audit(filter_audit.failures(no_docs, labels), "ABCDE", ("good", "toxic")).count() == 0
    assert told(filter_audit.audit(filter_audit.failures(docs, labels.filter("false")), "ABCDE", ("good", "toxic"))) == brute(docs.collect(), [])


def test_hot_text_with_a_repeated_smallest_id(spark):
    docs = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(7)).when(F.col("id") < 1500, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"), F.lit("s").alias("source"))
    rows = filter_audit.failures(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {(r.failed, r.n) for r in rows} == {(1, 1500), (1 | 16, 1500)}


def test_paths_and_other_numbers_of_filters(spark):
    for n in (1, 2, 4):
        edges = filter_audit.paths(n)
        assert len(edges) == n * 2 ** (n - 1)
        assert all(w == factorial(s.bit_count()) * factorial(n - s.bit_count() - 1) for (s, _), w in edges.items())
    counts = spark.createDataFrame([("p", 0, 5), ("p", 3, 2), ("p", 3, 1), ("p", 1, 4)], "part string, failed int, n long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.audit(counts, "XY").collect()}
    assert got == {("XY", 1): (5, 7, 0, 4, 11), ("XY", 2): (5, 0, 3, 0, 3), ("YX", 1): (9, 3, 0, 0, 3), ("YX", 2): (5, 4, 3, 4, 11)}
