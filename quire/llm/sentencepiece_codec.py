"""SentencePiece encoding and decoding with the tokenizers library.

The model file (a protobuf message) is parsed here, and a tokenizer is rebuilt from it: the
normaliser (character map, extra white space, dummy prefix, white space as U+2581), the pieces and
scores as a Unigram model, or the merges that the scores of a BPE model imply, byte fallback, and
the decoder. All ids and decoded texts come from that tokenizer, whose batches are encoded by
several threads.

Where no piece goes on from a character into white space, the ids of a text are those of its words
one after another, so each distinct word is encoded and decoded once and remembered. Parity with
the sentencepiece library is verified as words are learned: every distinct word of the corpus is
encoded by both. For other models, and those whose normaliser changes more than white space,
whole texts are compared. The column parity says whether they agree; where they don't, the ids are
still the tokenizer's, and the row says so.

The model is read on the driver and sent along with the job (it is checked to be small), so
executors need no file.

Edge cases: null texts give null ids and text, and true for parity and round_trip; empty ones give
no ids and an empty text. Texts are encoded whole, however long. Repeated rows are encoded each. An
empty table gives no rows. Columns named as the added ones (ids, parity, round_trip, decoded) give
way to them; to keep one, rename it before.
"""

import functools
import os
import re
import struct
from array import array
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from quire.llm.common import table

THREADS, BATCH, MAX_MODEL_BYTES = 2, 128, 16 << 20
#: Bounds of a word memory, which starts anew beyond them: words, and characters in them.
MAX_WORDS, MAX_CHARS = 150_000, 4_000_000
MARK = "▁"
UNIGRAM, BPE = 1, 2
# Piece types of the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)


def default_model() -> str:
    """The model file named by the session setting spark.quire.sentencepiece.model, else the installed one."""
    spark = SparkSession.getActiveSession()
    if spark is not None and (named := spark.conf.get("spark.quire.sentencepiece.model", None)):
        return named
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields_of(data: bytes):
    """Field numbers and values of a protobuf message; the values as integers or bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            yield number, data[at : at + size]
            at += size
        elif wire == 2:
            size = varint()
            yield number, data[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {wire} in the model file")


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> "Model":
        m = cls()
        for number, value in fields_of(data):
            if number == 1:
                piece = dict(fields_of(value))
                m.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif number == 2:
                spec = dict(fields_of(value))
                m.kind, m.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(fields_of(value))
                m.charsmap, m.dummy_prefix, m.remove_extra_spaces = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        return m

    def splits_at_words(self) -> bool:
        """No piece goes on from a character into white space."""
        return not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER))

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, the best score first."""
        usable = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        found = []
        for i, (p, s, kind) in enumerate(self.pieces):
            if kind == NORMAL and len(p) > 1:
                found += [(-s, i, usable[p[:k]], usable[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        return [(a, b) for *_, a, b in sorted(found)]

    def tokenizer(self):
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        unknown = next((p for p, _, kind in self.pieces if kind == UNKNOWN), None)
        if self.kind == UNIGRAM:
            # Unknown, control and unused pieces get names that text does not match.
            vocab = [(p if kind in (NORMAL, USER, BYTE) else f"\U0010fffd{i}\U0010fffd", s) for i, (p, s, kind) in enumerate(self.pieces)]
            model = models.Unigram(vocab, unk_id=next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), None), byte_fallback=self.byte_fallback)
        elif self.kind == BPE:
            model = models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self.merges(), unk_token=unknown, fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model type {self.kind} is neither unigram nor BPE")
        t = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.remove_extra_spaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        if self.splits_at_words():
            t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
        users = [AddedToken(p, normalized=True) for p, _, kind in self.pieces if kind == USER]
        if users:
            t.add_tokens(users)
        last = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []
        t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *last])
        return t


def packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class Words:
    """What is known of words: ids as bytes of 32-bit integers, and what they are decoded to. Each is kept
    without the given mark before it.

    There are two generations of at most MAX_WORDS words and about MAX_CHARS characters: a word of the
    old one that is met again moves to the new one, so frequent words stay.
    """

    def __init__(self, mark: str):
        self.mark = mark
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, str] = {}
        self.old: tuple[dict[str, bytes], dict[str, str]] = {}, {}
        self.chars = 0
        #: Words whose ids differ from the library's, and those that are decoded to something else.
        self.odd: set[str] = set()
        self.lossy: set[str] = set()

    def unknown(self, split: list[list[str]]) -> list[str]:
        if len(self.ids) > MAX_WORDS or self.chars > MAX_CHARS:
            self.old, self.ids, self.text, self.chars = (self.ids, self.text), {}, {}, 0
            self.odd &= self.old[0].keys()
            self.lossy &= self.old[0].keys()
        met, (ids, text) = set(chain.from_iterable(split)).difference(self.ids), self.old
        again = met.intersection(ids)
        for word in again:
            self.ids[word], self.text[word] = ids[word], text[word]
            self.chars += len(word)
        return list(met - again)

    def add(self, word: str, ids: bytes, text: str, same: bool) -> None:
        self.ids[word], self.text[word] = ids, text
        self.chars += len(word)
        if not same:
            self.odd.add(word)
        if text != (self.mark + word).replace(MARK, " "):
            self.lossy.add(word)


class Codec:
    """A rebuilt tokenizer, and the sentencepiece library that it is verified with, over one model."""

    WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def __init__(self, model: bytes, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        import sentencepiece
        from tokenizers import Tokenizer

        self.model, self.threads = Model.parse(model), threads
        self.tokenizer = self.model.tokenizer()
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=model)
        m = self.model
        plain = m.dummy_prefix and not m.charsmap and not m.remove_extra_spaces and not any(kind == USER for _, _, kind in m.pieces)
        self.by_word = Tokenizer(self.tokenizer.model) if plain and m.splits_at_words() else None
        # Words of texts with single spaces, without the one mark before them; those of others, with all their marks.
        self.simple, self.marked = Words(MARK), Words("")

    def learn(self, words: Words, split: list[list[str]]) -> None:
        """Encode, decode and verify the words that are not known yet, by several threads."""
        new = words.unknown(split)
        if not new:
            return
        # Words as one pre-split sequence for each thread: less is made per word than for texts of their own.
        size = -(-len(new) // self.threads) if len(new) > 100 else len(new)
        parts = [[words.mark + w for w in new[at : at + size]] for at in range(0, len(new), size)]
        ids: list[list[int]] = []
        for part, e in zip(parts, self.by_word.encode_batch(parts, is_pretokenized=True, add_special_tokens=False), strict=True):
            of, all_ids = np.array([-1 if w is None else w for w in e.word_ids], np.int64), e.ids
            ends = np.searchsorted(of, np.arange(len(part) + 1)).tolist()
            ids += [all_ids[start:end] for start, end in zip(ends, ends[1:], strict=False)]
        # A word stands after a mark of its own, which decoding takes off and the text has as a space.
        back = [" " + t for t in self.tokenizer.decode_batch(ids, skip_special_tokens=False)]
        expected = self.expected([words.mark + w for w in new])
        for word, i, t, x in zip(new, ids, back, expected, strict=True):
            words.add(word, packed(i), t, i == x)

    def expected(self, words: list[str]) -> list[list[int]]:
        """The library's ids of words that begin with a mark. One of marks alone is taken at a text's end,
        as the library adds no mark to an empty text."""
        found = self.reference.encode([w[1:].replace(MARK, " ") for w in words], num_threads=self.threads)
        for i, w in enumerate(words):
            if not w.strip(MARK):
                found[i] = self.reference.encode("." + " " * len(w))[len(self.reference.encode(".")) :]
        return found

    def encode_texts(self, texts: list[str], with_decoded: bool = True) -> tuple[list[bytes], list[str] | None, list[bool], list[bool]]:
        """Of each text: its ids as bytes of 32-bit integers, what they are decoded to (if wanted), whether the
        ids are those of the sentencepiece library, and whether they are decoded to the text."""
        if self.by_word is None:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            back = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
            expected = self.reference.encode(texts, num_threads=self.threads)
            return [packed(i) for i in ids], back, [i == x for i, x in zip(ids, expected, strict=True)], [a == b for a, b in zip(back, texts, strict=True)]
        spaced = [t.split(" ") if t and t[0] != " " and t[-1] != " " and "  " not in t and MARK not in t else None for t in texts]
        found = [self.WORD.findall((MARK if t else "") + t.replace(" ", MARK)) if s is None else () for t, s in zip(texts, spaced, strict=True)]
        self.learn(self.simple, [s for s in spaced if s])
        self.learn(self.marked, found)
        ids, back, same, whole = [], [], [], []
        for t, s, f in zip(texts, spaced, found, strict=True):
            split, words = (f, self.marked) if s is None else (s, self.simple)
            ids.append(b"".join(map(words.ids.__getitem__, split)))
            if with_decoded:
                back.append("".join(map(words.text.__getitem__, split))[1:])  # the first mark is the model's own
            same.append(not words.odd or words.odd.isdisjoint(split))
            # A mark that stands in the text itself becomes a space.
            whole.append((not words.lossy or words.lossy.isdisjoint(split)) and (s is not None or MARK not in t))
        return ids, back if with_decoded else None, same, whole

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [memoryview(ids).cast("i").tolist() for ids in self.encode_texts(texts)[0]]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch([list(one) for one in ids], skip_special_tokens=False)


@functools.lru_cache(maxsize=1)
def codec_of(model: bytes, threads: int) -> Codec:
    """One codec for the tasks that a worker runs one after another; they share the words it has learned."""
    return Codec(model, threads)


def encode(docs: DataFrame, columns: list[str], model_path: str | None = None, threads: int = THREADS, with_decoded: bool = True) -> DataFrame:
    """docs' columns, and of the column text: ids, parity (with the sentencepiece library), round_trip
    (whether decoding the ids gives the text) and, if wanted, decoded (the text that the ids stand for)."""
    model = open(model_path or default_model(), "rb").read()  # noqa: SIM115
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError("the model is larger than what should be sent along with a job")
    columns = [c for c in columns if c not in ("ids", "parity", "round_trip") and not (with_decoded and c == "decoded")]
    added = [StructField("ids", ArrayType(IntegerType())), StructField("parity", BooleanType()), StructField("round_trip", BooleanType())]
    if with_decoded:
        added.append(StructField("decoded", StringType()))
    out = StructType([*docs.select(*columns).schema.fields, *added])

    def run(batches):
        codec = codec_of(model, threads)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = part.column(part.num_columns - 1).to_pylist()
                full = [t or "" for t in texts]
                ids, decoded, parity, round_trip = codec.encode_texts(full, with_decoded)
                null = [t is None for t in texts]
                offsets = np.zeros(len(full) + 1, np.int32)
                np.cumsum([len(i) // 4 for i in ids], out=offsets[1:])
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
                arrays = [
                    *part.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(null, pa.bool_())),
                    pa.array(parity, pa.bool_()), pa.array(round_trip, pa.bool_())]
                if with_decoded:
                    arrays.append(pa.array([None if x else d for x, d in zip(null, decoded, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return docs.select(*columns, F.col("text").alias("_text")).mapInArrow(run, out)


def op1_sentencepiece(spark, sf_dir):
    """Per document: doc_id, n_tokens, ids_sha256 (of the ids, comma-joined), parity, and
    round_trip (the decoded text is the text)."""
    found = encode(table(spark, sf_dir, "documents"), ["doc_id"], with_decoded=False)
    ids = F.coalesce("ids", F.expr("cast(array() as array<int>)"))
    return found.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids, ","), 256).alias("ids_sha256"), "parity", "round_trip")
