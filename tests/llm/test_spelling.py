"""Spelling variants against a search through deletions, over whole tables and random words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import spelling


def brute_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute_near(words):
    """By patterns: a word with a letter left out, or with one replaced by a mark."""
    by, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by[w[:i] + w[i + 1 :]].add(w)
            by[w[:i] + "?" + w[i + 1 :]].add(w)
    for pattern, of in by.items():
        of = of if "?" in pattern else ({pattern} if pattern in words else set())
        for w in by[pattern]:
            for v in of - {w}:
                near[w].add(v)
                near[v].add(w)
    return near


def brute(docs):
    words = brute_words(docs)
    near = brute_near(words)
    form = {}
    for w, of in near.items():
        best = min(of, key=lambda v: (-words[v], v))
        if words[best] >= 2 * words[w]:
            form[w] = best
    found = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        found[w] = (form.get(w), root, n, len(near[w]) if w in near else 0, words[form[w]] if w in form else None)
    return found


def told(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_query_equals_brute_force(spark, sf_dir):
    got = spelling.op12_spelling(spark, sf_dir)
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])
    assert told(got) == want and sum(form is not None for form, *_ in want.values()) > 20


def random_docs(seed, n, alphabet, lengths):
    draw = random.Random(seed)
    words = ["".join(draw.choice(alphabet) for _ in range(draw.choice(lengths))) for _ in range(n)]
    for w in list(words):
        i = draw.randrange(len(w))
        words += [w[:i] + w[i + 1 :], w[:i] + draw.choice(alphabet) + w[i:], w[:i] + draw.choice(alphabet) + w[i + 1 :]]
    return [(i, " ".join(w.title() if draw.random() < 0.3 else w for w in draw.choices(words, k=400))) for i in range(60)]


@pytest.mark.parametrize("alphabet, lengths", [("abcdefgh", range(5, 9)), ("ah", range(5, 12)), ("aáàâéèêzÿÀ", range(5, 8))])
def test_dense_words_in_chunks(spark, monkeypatch, alphabet, lengths):
    """Blocks of a few letters, all cut into small chunks and spread over several cells."""
    monkeypatch.setattr(spelling, "CHUNK", 20)
    monkeypatch.setattr(spelling, "COMING", 50)
    monkeypatch.setattr(spelling, "CELL_ROWS", 2000)
    monkeypatch.setattr(spelling, "COUNTED", 100)
    docs = random_docs(1, 300, alphabet, lengths)
    assert told(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_odd_rows_and_long_words(spark, odd_docs, no_docs):
    """Nulls, repeated rows, very long texts, words of 64 letters, of thousands, and of one letter; ties and chains."""
    draw = random.Random(2)
    long = ["".join(draw.choice("abcé") for _ in range(n)) for n in (63, 64, 65, 600, 3000)]
    many = []
    for w in long:
        many += [w] * 9 + [w[:40] + w[41:]] * 3 + [w[:50] + "x" + w[50:]] * 4 + [w[:9] + "z" + w[10:]] * 4 + [w + "q"] * 3
    many += ["bbbbb"] * 3 + ["abbbb"] * 6 + ["aabbb"] * 12 + ["cbbbb"] * 6 + ["aaaab"] * 30 + ["aaaaa"] * 3 + ["éèêëë"] * 3 + ["éèêë"] * 3 + ["ÀÀÀÀÀ"] * 3 + ["àààaa"] * 3 + ["×÷×÷×"] * 5
    docs = odd_docs.unionByName(spark.createDataFrame([(100, " ".join(many)), (None, "1".join(many)), (None, "日本 hello,hello;hello_ 'hellos'")], "doc_id long, text string"), allowMissingColumns=True)
    docs = docs.withColumns({c: F.lit(1) for c in ("word", "n", "key", "comes", "unit", "form")})
    assert told(spelling.variants(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert spelling.variants(no_docs).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, ""), (3, "abc 123")], "doc_id long, text string")).count() == 0


def test_keys_that_blocks_share_count_no_pair_twice(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PLACES", 3 ** np.arange(spelling.CLASSES, dtype=np.int64))
    docs = random_docs(3, 200, "abcdefghi", range(5, 8))
    assert told(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
