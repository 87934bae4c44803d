"""Packing: ids against whole texts, pieces against the documents, room, padding and costs."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import packing

SIZE = packing.SIZE


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_model())


def whole(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check(pieces, documents, size=SIZE):
    """pieces: (document, start, length, sequence, offset); documents: length by document. All ids once, no gaps, no padding."""
    of, sequences = defaultdict(list), defaultdict(list)
    for d, start, n, s, offset in pieces:
        assert n > 0
        of[d].append((start, n))
        sequences[s].append((offset, n))
    assert set(of) == set(documents)
    for d, parts in of.items():
        assert sum(n for _, n in parts) == documents[d]
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding, len(sequences)


@pytest.mark.parametrize("seed", range(6))
def test_place(seed):
    draw = random.Random(seed)
    n = draw.choice((1, 5, 300, 2000))
    lengths = [min(9000, 1 + int(draw.expovariate(1 / draw.choice((20, 300, 1500))))) for _ in range(n)]
    pieces, costs = packing.place(lengths)
    padding, n_sequences = check(pieces, dict(enumerate(lengths)))
    assert padding == 0 and n_sequences == len(costs)
    # Fewer cuts than sequences that are closed, beside those of documents longer than a sequence.
    assert len(pieces) - len(lengths) - sum(x // SIZE for x in lengths) <= n_sequences
    found = defaultdict(float)
    for _, _, k, s, _ in pieces:
        found[s] += packing.LINEAR * k + packing.QUADRATIC * k * k
    assert all(abs(found[s] - c) < 1e-6 * c for s, c in enumerate(costs))


def test_place_equals_a_plain_search_for_the_lowest_cost():
    """The heaps choose what looking through all sequences chooses."""
    draw = random.Random(4)
    lengths = [1 + int(draw.expovariate(1 / 400)) % 2047 for _ in range(400)]
    total = sum(lengths)
    room = [SIZE] * (total // SIZE) + [1 << b for b in reversed(range(11)) if total % SIZE >> b & 1]
    cost, want = [0.0] * len(room), []
    for doc in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        start, n = 0, lengths[doc]
        while start < n:
            fits = [s for s in range(len(room)) if room[s] >= n - start] if start == 0 else []
            s = min(fits or [s for s in range(len(room)) if room[s]], key=lambda s: (cost[s], s))
            k = min(n - start, room[s])
            want.append((doc, start, k, s))
            room[s], start, cost[s] = room[s] - k, start + k, cost[s] + packing.LINEAR * k + packing.QUADRATIC * k * k
    assert [p[:4] for p in packing.place(lengths)[0]] == want


def test_costs_are_balanced():
    """Where no document alone costs more than the mean, costs are within a few percent of it."""
    draw = random.Random(5)
    lengths = [1 + int(draw.expovariate(1 / 250)) % 900 for _ in range(8000)]
    costs = np.array(packing.place(lengths)[1])
    costs = costs[costs > packing.LINEAR * SIZE]
    shuffled = np.array(draw.sample(lengths, len(lengths)))
    plain = np.add.reduceat(packing.QUADRATIC * shuffled.astype(float) ** 2, np.flatnonzero(np.diff(np.cumsum(shuffled) // SIZE, prepend=-1)))
    assert costs.std() < 0.01 * costs.mean() and costs.max() < 1.03 * costs.mean() and costs.std() < 0.5 * plain.std()


def test_query_on_all_documents(spark, sf_dir, tokenizer):
    got = packing.op11_packing(spark, sf_dir).collect()
    docs = {r.doc_id: whole(tokenizer, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    padding, n_sequences = check([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in got], {d: len(i) for d, i in docs.items()})
    assert padding == 0 and n_sequences <= -(-sum(map(len, docs.values())) // SIZE) + 11
    for r in got:
        assert r.doc_tokens == len(docs[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(docs[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())


def test_models_that_keep_white_space_get_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, tokenizer = packing.Encoder(open(path, "rb").read()), Tokenizer.from_file(path)
    texts = ["Two  words\n and more", "", "x"]
    assert not encoder.by_word and [np.frombuffer(i, encoder.kind).tolist() for i in encoder.encode(texts)] == [tokenizer.encode(t).ids for t in texts]


def test_odd_rows_several_bins_and_columns(spark, odd_docs, no_docs, tokenizer):
    """Nulls, repeated rows and ids, a very long text, strange white space, marks of the model itself, clashing names."""
    strange = ["<|endoftext|>a<|startoftext|> b", "it's  WE'LL \t\n x\x0b\x0cy", "\x1c a\x1cb", "a b c　d", "é ́x ΑΣ İ", "日本語 テキスト", "naïve ÀÉ½x²,y_z.. a\x85b\xa0c µª <|ENDOFTEXT|> İI’s DON'T", "".join(map(chr, range(1, 256))), " ".join(map(chr, range(1, 0x250))), "퟿\U0001f600 #!?"]
    more = spark.createDataFrame([(2**60 + i, t, "en", "a", len(t)) for i, t in enumerate(strange)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd_docs.unionByName(more, allowMissingColumns=True).withColumns({c: F.lit("x") for c in ("start", "ids", "offset", "sequence_id", "_ids", "_bin", "_text", "_passed_0")})
    columns = ["doc_id", "words", "_row", "_bin", "_passed_0", "ids"]
    for bin_bytes in (packing.BIN_BYTES, 100_000):
        got = packing.pack(docs, columns, bin_bytes=bin_bytes)
        assert got.columns == ["doc_id", "words", "_row", "_bin", "_passed_0", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "cost"]
        rows = got.collect()
        pieces = defaultdict(list)
        for r in rows:
            pieces[r.doc_id].append((r.start, tuple(np.frombuffer(r.ids, "<u4"))))
        want = defaultdict(list)
        for r in docs.collect():
            want[r.doc_id].append(whole(tokenizer, r.text))
        for d, texts in want.items():
            assert sum(len(i) for _, i in pieces[d]) == sum(map(len, texts))
            if len(texts) == 1:
                assert [x for _, i in sorted(pieces[d]) for x in i] == texts[0]
        assert len({r.sequence_id >> 32 for r in rows}) == 1 or bin_bytes == 100_000
        assert sorted((r.doc_id is None, r.doc_id or 0, r.start, r.sequence_id, r.offset) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0, r.start, r.sequence_id, r.offset) for r in packing.pack(docs, columns, bin_bytes=bin_bytes).collect())
    assert packing.pack(no_docs, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(no_docs, ["doc_id"], size=1000)
