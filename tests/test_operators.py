"""Operators on literal rows."""

import datetime
import io
import random
import zipfile

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import values as V
from quire.functions.vectors import nearest
from quire.operators import chunking, deletion, hooks, ivf, relations, rules, search, state, versions
from quire.sources import blobs
from quire.sources.tables import STEP_ORDER, conform, read


def at():
    return F.expr("timestamp_ntz'2024-01-01 12:00:00'")


STEP_SCHEMA = "document_id long, step string, status string, attempt int, max_attempts int, started_at timestamp_ntz, finished_at timestamp_ntz, duration_ms long, error_code string"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def steps(spark, *given):
    return spark.createDataFrame([(d, s, status, attempt, 3, start, None, None, None) for d, s, status, attempt, start in given], STEP_SCHEMA)


def test_fusion_by_hand(spark):
    schema = "query_id long, document_id long, rank int"
    vector = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], schema)
    text = spark.createDataFrame([(1, 1, 1)], schema)
    fused = search.fuse([vector, text])
    assert rows(fused, "document_id", "score", "rank") == [(1, round(2 / 61, 6), 1), (2, round(1 / 62, 6), 2)]
    assert rows(search.fuse([text, vector]), "document_id", "score") == rows(fused, "document_id", "score")
    assert search.fuse([spark.createDataFrame([], schema)]).count() == 0


def test_fetch_and_clamp():
    assert [search.fetch(k) for k in (1, 10, 30, 500)] == [100, 100, 300, 500]
    assert search.clamp(500) == 50


def test_ensure_steps_twice_gives_six(spark):
    docs = spark.createDataFrame([(1,)], "document_id long")
    once = state.ensure_steps(steps(spark), docs)
    assert state.ensure_steps(once, docs).count() == 6
    assert {r.status for r in once.collect()} == {"pending"}


def test_one_claim_wins_and_the_second_is_rejected(spark):
    s = steps(spark, (1, "ocr", "pending", 0, None))
    cmd = spark.createDataFrame([(1, "ocr", "b"), (1, "ocr", "a"), (9, "ocr", "a")], "document_id long, step string, claimant string")
    after = state.claim(s, cmd, at())
    assert rows(after, "status", "attempt", "applied") == [("running", 1, True)]
    assert rows(state.claim(after.drop("applied"), cmd, at()), "status", "attempt", "applied") == [("running", 1, False)]


def test_success_counts_its_time_and_failure_keeps_its_error(spark):
    start = datetime.datetime(2024, 1, 1, 11, 59, 58, 500000)
    s = steps(spark, (1, "ocr", "running", 1, start), (2, "ocr", "running", 1, start), (3, "ocr", "pending", 0, None))
    done = state.succeed(s, spark.createDataFrame([(1, "ocr", None), (2, "ocr", 7), (3, "ocr", 1)], "document_id long, step string, duration_ms long"), at())
    assert rows(done, "document_id", "status", "applied") == [(1, "succeeded", True), (2, "succeeded", True), (3, "pending", False)]
    assert {r.document_id: r.duration_ms for r in done.collect()} == {1: 1500, 2: 7, 3: None}
    failed = state.fail(s, spark.createDataFrame([(1, "ocr", "bad_pdf")], "document_id long, step string, error_code string"), at())
    assert [r.error_code for r in failed.filter("document_id = 1").collect()] == ["bad_pdf"]


def test_reset_from_ocr_keeps_two_and_is_idempotent(spark):
    s = steps(spark, *[(1, step, "succeeded" if i < 3 else "failed", 2, None) for i, step in enumerate(STEP_ORDER)])
    cmd = spark.createDataFrame([(1, "ocr")], "document_id long, from_step string")
    once = state.reset_from(s, cmd)
    assert sorted(r.status for r in once.collect()) == ["pending"] * 4 + ["succeeded"] * 2
    assert rows(state.reset_from(once, cmd), "step", "status", "attempt") == rows(once, "step", "status", "attempt")


def test_sweep_by_attempts(spark):
    old = datetime.datetime(2024, 1, 1, 11, 0)
    s = steps(spark, (1, "ocr", "running", 1, old), (2, "ocr", "running", 3, old), (3, "ocr", "running", 1, datetime.datetime(2024, 1, 1, 11, 45)))
    assert rows(state.sweep_stuck(s, at()), "document_id", "status") == [(1, "pending"), (2, "failed"), (3, "running")]


CLAIM = "key string, at long, id long, ttl long, response string"


def folded(claims):
    """Claims in order, by hand: id -> (won, holder, response)."""
    held, found = {}, {}
    for key, at, i, ttl, response in sorted(claims, key=lambda c: c[1:3]):
        won = key is None or key not in held or at >= held[key][0]
        if won:
            held[key] = (at + ttl, i, response)
        found[i] = (won, *held[key][1:])
    return found


def answered(df):
    return {r.id: (r.won, r.holder, r.response) for r in df.collect()}


def test_claims_can_be_won_again_after_expiry(spark):
    claims = [("k", 0, 1, 10, "a"), ("k", 5, 2, 10, "b"), ("k", 10, 3, 10, "c"), ("k", 19, 4, 10, None), ("k", 20, 5, 10, None), (None, 20, 6, 10, "n"), (None, 20, 7, 10, "m")]
    got = answered(state.claims_within_ttl(spark.createDataFrame(claims, CLAIM)))
    assert got == {1: (True, 1, "a"), 2: (False, 1, "a"), 3: (True, 3, "c"), 4: (False, 3, "c"), 5: (True, 5, None), 6: (True, 6, "n"), 7: (True, 7, "m")}
    assert state.claims_within_ttl(spark.createDataFrame([], CLAIM)).count() == 0


@pytest.mark.parametrize("ttl", [1, 37, 5_000, 200_000])
def test_a_hot_key_of_claims_is_many_tasks(spark, ttl):
    """10^5 claims of one key, beside small keys, over several ranges; times repeat, and times to live differ."""
    draw = random.Random(ttl)
    claims = [("hot", draw.randrange(150_000), i, draw.choice([ttl, ttl + 3]), str(i)) for i in range(100_000)]
    claims += [(f"k{i % 500}", draw.randrange(100), 100_000 + i, draw.choice([0, 5, 30]), str(i)) for i in range(3_000)]
    got = state.claims_within_ttl(spark.createDataFrame(claims, CLAIM), ranges=7)
    assert got.filter("key = 'hot'").select(F.spark_partition_id()).distinct().count() >= 5
    assert answered(got) == folded(claims)


def test_upsert_keeps_named_columns_and_is_idempotent(spark):
    schema = "k long, text string, created int"
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], schema)
    new = spark.createDataFrame([(2, None, 99), (3, "c", 30)], schema)
    once = relations.upsert(old, new, ["k"], kept=("created",))
    assert rows(once.na.fill("-"), "k", "text", "created") == [(1, "a", 10), (2, "-", 20), (3, "c", 30)]
    assert rows(relations.upsert(once, new, ["k"], kept=("created",)).na.fill("-"), "k", "text", "created") == rows(once.na.fill("-"), "k", "text", "created")


def test_patch_may_set_null(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k long, s string, n int")
    patches = spark.createDataFrame([(1, "s", None), (2, "n", "7")], "k long, column string, value string")
    assert {r.k: (r.s, r.n) for r in relations.patch(base, patches, "k").collect()} == {1: (None, 5), 2: ("b", 7)}


def test_versions(spark):
    v = spark.createDataFrame([(1, 1, "model"), (1, 2, "human"), (2, 1, "model")], "document_id long, version int, source string")
    assert rows(versions.flag_current(v).filter("is_current"), "document_id", "version") == [(1, 2), (2, 1)]
    add = spark.createDataFrame([(1, 5), (1, 6), (7, 1)], "document_id long, asked int")
    assert rows(versions.number_additions(v, add, ["asked"]), "document_id", "asked", "version") == [(1, 5, 3), (1, 6, 4), (7, 1, 1)]


def test_a_bad_correction_rejects_the_submission(spark):
    fields = spark.createDataFrame([(1, "total", "9", 0.3), (1, "date", "x", 0.9), (2, "total", "1", 0.5)], "document_id long, key string, value string, confidence double")
    fixes = spark.createDataFrame([(1, "total", "10", True), (2, "total", "z", False), (2, "date", "y", True)], "document_id long, key string, value string, ok boolean")
    got = {(r.document_id, r.key): (r.value, r.confidence, r.was) for r in versions.corrected(fields, fixes).collect()}
    assert got == {(1, "total"): ("10", 1.0, "9"), (1, "date"): ("x", 0.9, None)}


def test_schema_bump_only_for_relevant_columns(spark):
    schema = "key string, kind string, label string"
    old = spark.createDataFrame([("a", "string", "A"), ("b", "number", "B")], schema)
    new = spark.createDataFrame([("a", "string", "new label"), ("c", "date", "C")], schema)
    assert rows(versions.schema_diff(old, new, ["key"], ["kind"]), "key", "change") == [("b", "remove"), ("c", "add")]


@pytest.mark.parametrize(("text", "day"), [("31/12/2024", "2024-12-31"), ("2024-12-31", "2024-12-31"), ("Dec 31, 2024", "2024-12-31"), ("not a date", None), (None, None)])
def test_dates(spark, text, day):
    got = spark.createDataFrame([(text,)], "v string").select(V.to_date(F.col("v")).cast("string").alias("d")).first().d
    assert got == day


def test_numbers_and_booleans(spark):
    df = spark.createDataFrame([("$1,234.56",), ("n/a",), ("Yes",)], "v string")
    assert [str(r.n) for r in df.select(V.to_number(F.col("v")).alias("n")).collect()] == ["1234.56", "None", "None"]
    assert [r.b for r in df.select(V.to_boolean(F.col("v")).alias("b")).collect()] == [None, None, True]


@pytest.mark.parametrize(("threshold", "document", "weakest", "said"), [(0.8, 0.9, 0.85, "validated:ok"), (0.8, 0.9, 0.3, "pending_review:field_confidence"), (None, 0.99, 0.99, "pending_review:no_threshold")])
def test_review_decision(spark, threshold, document, weakest, said):
    row = spark.createDataFrame([(threshold, document, weakest)], "t double, d double, w double")
    assert row.select(V.decision(F.col("t"), F.lit(False), F.lit(False), F.col("d"), F.col("w")).alias("x")).first().x == said


def test_field_search_needs_all_conditions(spark):
    fields = spark.createDataFrame([(1, "total", "1500"), (1, "status", "open"), (2, "total", "999"), (2, "status", "open"), (3, "total", None)], "document_id long, key string, value string")
    assert rows(search.field_search(fields, [("total", "gte", 1000), ("status", "eq", "open")]), "document_id") == [(1,)]
    assert rows(search.field_search(fields, [("total", "exists", None)]), "document_id") == [(1,), (2,)]
    assert rows(search.field_search(fields, [("status", "in", ["open"]), ("status", "contains", "pe"), ("total", "lte", 1000), ("total", "neq", "1")]), "document_id") == [(2,)]


def test_lexical_search_needs_all_words(spark):
    docs = spark.createDataFrame([(1, "Revenue report for ACME-2024-001"), (2, "tariff schedule"), (3, ""), (4, None)], "document_id long, text string")
    queries = spark.createDataFrame([(1, ["revenue", "report"]), (2, ["acme", "2024", "001"]), (3, ["revenue", "tariff"]), (4, [])], "query_id long, words array<string>")
    assert rows(search.bm25(docs, queries, 10), "query_id", "document_id", "rank") == [(1, 1, 1), (2, 1, 1)]


def test_approximate_search_finds_what_is_near(spark):
    draw = np.random.default_rng(4)
    base = draw.standard_normal((20, 32))
    near = np.concatenate([base + 0.15 * draw.standard_normal(base.shape) for _ in range(5)])
    rows_ = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([near, draw.standard_normal((400, 32))]))] + [(900, None)], "document_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "query_id long, embedding array<double>")
    exact = {(r.query_id, r.document_id) for r in nearest(rows_, asked, 5).collect()}
    found = ivf.approximate(rows_, asked, 5).collect()
    assert len(exact & {(r.query_id, r.document_id) for r in found}) >= 0.9 * len(exact) and found[0].recall >= 0.9
    assert ivf.approximate(rows_.limit(0), asked, 5).count() == 0
    # A query of another size has no index; with more results than lists hold, the exact search fills in.
    odd = rows_.unionByName(spark.createDataFrame([(950, [1.0, 2.0]), (951, [2.0, 1.0]), (952, [0.0, 0.0])], "document_id long, embedding array<double>"))
    assert [r.document_id for r in ivf.approximate(odd, spark.createDataFrame([(1, [1.0, 1.9])], "query_id long, embedding array<double>"), 3).orderBy("rank").collect()] == [950, 951]


def test_inverted_file_prunes_lists_and_splits_large_ones(spark, monkeypatch):
    monkeypatch.setattr(ivf, "CHUNK", 50)
    monkeypatch.setattr(ivf, "ASKED", 7)
    draw = np.random.default_rng(5)
    x = np.concatenate([0.1 * draw.standard_normal((600, 16)) + 3, draw.standard_normal((300, 16))])  # a third of the lists hold most rows
    rows_ = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "document_id long, embedding array<double>")
    asked = rows_.filter("document_id % 20 = 0").withColumnRenamed("document_id", "query_id")
    index = ivf.build(rows_)
    assert len(index.centroids[16]) == 30
    true = nearest(rows_, asked, 5)
    shares = [ivf.recall(ivf.search(index, rows_, asked, 5, probes), true) for probes in (1, 4, 30)]
    assert shares[0] <= shares[1] <= shares[2] and shares[1] > 0.8 and shares[2] > 0.98
    plan = ivf.search(index, rows_, asked.limit(1), 5, 1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [size" in plan or "list#" in plan.split("PartitionFilters")[1][:200]
    probes = ivf.probes_for(index, true, rows_, asked, 0.9)
    assert probes <= 15 and ivf.recall(ivf.search(index, rows_, asked, 5, probes), true) > 0.85


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(T.tokens(F.lit("Ärger, im Büro-2!"))) == ["ärger", "im", "büro", "2"]
    assert value(T.estimate_tokens(F.lit("abcdefgh漢字"))) == 4
    assert value(T.citations(F.lit("see [doc:4 p:2] and [doc:5 p:10]."))) == ["4:2", "5:10"]
    assert value(T.page_key(F.lit(7), F.lit(1234567))) == "pages/7/1234567.png"
    assert [value(T.escapes(F.lit(n))) for n in ("../x", "/x", "a/../b", "C:\\x", "a..b", "a/b")] == [True, True, True, True, False, False]
    assert [value(T.valid_key(F.lit(k))) for k in ("total", "1a", "A", "id", "a" * 64)] == [True, False, False, False, False]


def test_archives(spark):
    def archive(entries):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in entries:
                z.writestr(name, content)
        return bytearray(out.getvalue())

    df = spark.createDataFrame([
        ("ok", archive([("a.txt", b"one"), ("b.txt", b"two")])), ("bad", bytearray(b"nothing")), ("path", archive([("../x", b"1"), ("in.zip", b"2")])),
        ("bomb", archive([("z", b"0" * 1_000_000)])), ("many", archive([(str(i), b"") for i in range(6)]))], "archive string, content binary")
    got = {(r.archive, r.name, r.problem) for r in blobs.expand(df, max_entries=5).collect()}
    assert got == {("ok", "a.txt", None), ("ok", "b.txt", None), ("bad", None, "unreadable"), ("path", "../x", "path"), ("path", "in.zip", "nested"), ("bomb", None, "ratio"), ("many", None, "too_many_entries")}


def chunks_of(spark, pages, target, overlap):
    df = chunking.chunk_pages(spark.createDataFrame([(1, i, t) for i, t in pages], "document_id long, page int, text string"), target, overlap)
    return [(r.page_from, r.page_to, r.text, r.token_count) for r in sorted(df.collect(), key=lambda r: r.chunk_index)]


def test_chunks_overlap_by_sentences(spark):
    chunks = chunks_of(spark, [(1, "One two three. Four five six. Seven eight nine."), (2, "Ten eleven twelve.")], 10, 5)
    assert [(a, b) for a, b, _, _ in chunks] == [(1, 1), (1, 1), (1, 2)]
    assert chunks[0][2].endswith("Four five six.") and chunks[1][2].startswith("Four five six.")


def test_chunks_keep_paragraphs_and_tables_and_cut_the_rest(spark):
    # The second paragraph fits a chunk, so it does not begin in the first one.
    chunks = chunks_of(spark, [(1, "One two three four. Five six.\n\nSeven eight nine. Ten eleven twelve."), (2, None), (3, "")], 10, 0)
    assert [t for _, _, t, _ in chunks] == ["One two three four. Five six.", "Seven eight nine. Ten eleven twelve."]
    table = "| a | b |\n|---|---|\n| 1. x | 2 |\n| 3 | 4 |"
    chunks = chunks_of(spark, [(1, f"Before it.\n{table}\nAfter it.")], 6, 0)
    assert [t for _, _, t, _ in chunks] == ["Before it.", table, "After it."] and chunks[1][3] <= 12
    lines = [f"| row {i} | value |" for i in range(8)]
    assert [t for _, _, t, _ in chunks_of(spark, [(1, "\n".join(lines))], 6, 0)] == lines  # too large a table goes by lines
    long = " ".join(f"w{i:02d}" for i in range(30))
    chunks = chunks_of(spark, [(1, long + "."), (2, "x" * 2500)], 10, 0)
    assert " ".join(t for _, _, t, _ in chunks).replace(" ", "") == (long + "." + "x" * 2500).replace(" ", "")
    assert all(n <= 20 for _, _, t, n in chunks if "x" not in t) and max(n for _, _, _, n in chunks) <= 250  # words of 1000 characters at most
    assert [n for _, _, _, n in chunks_of(spark, [(1, "文" * 12 + " abcd")], 20, 0)] == [14]  # a token a character, and one for four others


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 2), st.integers(1, 30)), max_size=40), st.integers(4, 40), st.integers(0, 20))
def test_packing_covers_all_pieces_in_bounds(given, target, overlap):
    given = sorted(given, key=lambda g: g[:2])
    whole = {}
    for page, paragraph, n in given:
        whole[page, paragraph] = whole.get((page, paragraph), 0) + n
    rows = [(page, paragraph, f"p{i}", n, whole[page, paragraph]) for i, (page, paragraph, n) in enumerate(given)]
    chunks, tokens = list(chunking.pack(rows, target, overlap)), {r[2]: r[3] for r in rows}
    last = -1
    for a, b, text, size in chunks:
        names = [int(p[1:]) for p in text.split(" ")]
        assert names == list(range(names[0], names[-1] + 1)) and names[0] <= last + 1 and names[-1] > last  # in order, each with something new
        assert size == sum(tokens[f"p{i}"] for i in names) and (size <= target or len(names) == 1)
        assert sum(tokens[f"p{i}"] for i in names if i <= last) <= overlap
        assert (a, b) == (rows[names[0]][0], rows[names[-1]][0])
        last = names[-1]
    assert last == len(rows) - 1
    for (page, paragraph), size in whole.items():
        names = {r[2] for r in rows if r[:2] == (page, paragraph)}
        assert size > target or any(names <= set(t.split(" ")) for _, _, t, _ in chunks)  # what fits a chunk is in one as a whole


def test_integrity(spark):
    df = spark.createDataFrame([(1, 0.5, "a"), (1, 1.5, "b"), (3, None, None)], "k long, v double, s string")
    assert rows(relations.duplicate_keys(df, ["k"]), "k", "n") == [(1, 2)]
    assert rows(relations.outside(df, "v", 0, 1), "k") == [(1,)]
    assert rows(relations.not_member(df, "s", ["a"]), "s") == [("b",)]
    assert rows(relations.orphans(df, "k", spark.createDataFrame([(1,)], "id long"), "id"), "k") == [(3,)]


def test_rules_name_each_violation(spark):
    """Nulls never break uniqueness or references; a partial rule looks at its rows only; all tables in one result."""
    tables = {
        "a": spark.createDataFrame([(1, "x", True), (1, "y", True), (2, None, False), (2, None, False), (3, "x", None)], "id int, name string, current boolean"),
        "b": spark.createDataFrame([(1, "p"), (9, "q"), (9, None), (None, "p")], "a_id int, kind string")}.__getitem__
    unique = (rules.Unique("a", ("id",), "current"), rules.Unique("a", ("id", "name")), rules.Unique("b", ("kind",)))
    assert rows(rules.duplicates(tables, unique), "rule", "value", "n") == [("a(id where current)", "1", 2), ("b(kind)", "p", 2)]
    assert rows(rules.dangling(tables, (rules.Refers("b", "a_id", "a", "id"), rules.Refers("a", "name", "b", "kind"))), "rule", "value", "n") == [("a(name)", "x", 2), ("a(name)", "y", 1), ("b(a_id)", "9", 2)]
    assert rows(rules.outside(tables, (rules.Within("a", "id", 2, None), rules.Within("b", "a_id", 0, 5))), "rule", "value", "n") == [("a(id)", "1", 2), ("b(a_id)", "9", 2)]
    assert rows(rules.strangers(tables, (rules.OneOf("b", "kind", ("p",)),)), "rule", "value", "n") == [("b(kind)", "q", 1)]
    assert len(rules.REFERS) == 13 and len(rules.ONE_OF) == 9 and len(rules.UNIQUE) == 15


def test_dimensions_need_their_record(spark):
    chunks = spark.createDataFrame([(1, 0, [0.0, 1.0], 2), (2, 0, [0.0], 2), (3, 0, [0.0, 1.0], 3), (4, 0, None, 2), (5, 0, [1.0, 2.0], None)], "document_id long, chunk_index int, embedding array<double>, embed_dim int")
    told = lambda config, wanted=2: {(r.document_id, r.problem) for r in rules.wrong_dimensions(chunks, spark.createDataFrame(config, "key string, value string"), wanted).collect()}
    bad = {(2, "chunk"), (3, "chunk"), (4, "chunk"), (5, "chunk")}
    assert told([("vector", '{"embed_dim": 2}'), ("other", "{}")]) == bad
    assert told([("other", "{}")]) == bad | {(None, "missing")}
    assert told([("vector", "{}")]) == told([("vector", "no json")]) == bad | {(None, "malformed")}
    assert told([("vector", '{"embed_dim": 2}')], 64) == bad | {(None, "setting")}


def test_a_hot_word_is_scored_in_parts_and_pairs_are_asked_for(spark, monkeypatch):
    docs = spark.range(300).select(F.col("id").alias("document_id"), F.concat(F.lit("common "), F.repeat(F.lit("word "), (F.col("id") % 7 + 1).cast("int"))).alias("text"))
    queries = spark.createDataFrame([(1, ["common", "word"]), (2, ["word"]), (3, ["absent"])], "query_id long, words array<string>")
    whole = rows(search.bm25(docs, queries, 300), "query_id", "rank", "document_id", "score")
    monkeypatch.setattr(search, "POSTINGS", 20)
    assert rows(search.bm25(docs, queries, 300), "query_id", "rank", "document_id", "score") == whole and len(whole) == 600
    assert rows(search.bm25(docs, queries, 2), "query_id", "rank", "document_id", "score") == [r for r in whole if r[1] <= 2]
    pairs = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (1, 999)], "query_id long, document_id long")
    assert rows(search.text_rank(docs, queries, pairs), "query_id", "document_id", "score") == sorted((q, d, s) for q, _, d, s in whole if d == 5)


def test_a_cluster_of_near_copies_is_one_class(spark):
    """8,000 near copies, all in one bucket of most tables, beside spread-out vectors and a pair."""
    draw = np.random.default_rng(6)
    center = draw.standard_normal(16)
    x = np.concatenate([center + 0.02 * draw.standard_normal((8_000, 16)), draw.standard_normal((500, 16))])
    x = np.concatenate([x, x[-1:] * 2.5])
    frame = spark.createDataFrame(pd.DataFrame({"document_id": np.arange(len(x)), "embedding": x.tolist()}), "document_id long, embedding array<double>")
    got = {r.document_id: r.class_id for r in search.alike(frame, 0.93).collect()}
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert {got[i] for i in range(8_000)} == {0} and got[8_500] == got[8_499]
    near = (y[8_000:] @ y.T >= 0.93).sum(1)
    assert all(got[8_000 + i] == 8_000 + i for i in np.flatnonzero(near == 1))


def test_deletion_marks_first_and_purges_later(spark, tmp_path):
    stamp = lambda day: datetime.datetime(2024, 1, day)
    documents = conform(spark.createDataFrame([(1, None), (2, stamp(1)), (3, stamp(9)), (4, None)], "document_id long, deleted_at timestamp_ntz"), "documents")
    marked = deletion.mark(documents, spark.createDataFrame([(1,), (1,), (2,), (9,)], "document_id long"), F.lit(stamp(10)))
    assert rows(marked.filter("deleted_at is not null"), "document_id", "deleted_at") == [(1, stamp(10)), (2, stamp(1)), (3, stamp(9))] and marked.count() == 4
    tables = {name: conform(spark.createDataFrame([(i,) for i in (1, 2, 2, 3)], "document_id long"), name) for name in deletion.BELONGING} | {"documents": marked}
    deletion.purge(tables.__getitem__, str(tmp_path), F.lit(stamp(5)))
    assert rows(read(spark, str(tmp_path), "documents"), "document_id") == [(1,), (3,), (4,)]
    assert all(rows(read(spark, str(tmp_path), name), "document_id") == [(1,), (3,)] for name in deletion.BELONGING)


def test_default_vectors_of_like_texts_are_alike(spark):
    texts = ["the invoice of march", "The invoice of April", "ein ganz anderer Satz", "", None]
    v = np.array([r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", hooks.embedder(64)(F.col("t")).alias("v")).orderBy("i").collect()])
    assert np.allclose(np.linalg.norm(v, axis=1), 1) and v[0] @ v[1] > 0.5 > v[0] @ v[2] and (v[3] == v[4]).all()
