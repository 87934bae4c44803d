"""Cost-balanced packing of documents into training sequences.

A sequence's cost is estimated as linear in its tokens plus, for attention within each of its pieces,
quadratic in their lengths. Documents are taken in descending length, and each goes to the sequence of lowest
cost that still has room for it, so that long pieces end beside short ones and costs keep even.

Documents are dealt at random into bins of a few MB of text, which tasks pack independently; so every
bin has the mix of lengths of the whole table, costs are even between bins as within, and no task's work
grows with the table. A document longer than a sequence fills sequences of its own first; its rest is packed.
A bin has exactly as much room as tokens: full sequences, and for what is left over one sequence for
each power of two in that number, as such lengths need no padding. A document that has room nowhere as a whole
is cut: parts of it go to the sequences of lowest cost with any room. So nothing is padded, at the
price of at most one cut for each sequence that the bin closes.

Text is encoded by the tokenizers library. Where the model's normaliser and pre-tokenizer treat what white space
separates independently, distinct words are encoded once and kept, up to a bound. (A test compares this with whole texts.)

Edge cases: a null text is empty, and an empty text is its closing id alone. Texts of any length count
whole. Rows are packed each on its own, so null or repeated doc_ids and repeated rows give as many documents.
Equally long documents are taken in the order in which the table is read; which bin a row
belongs to follows from its place in the table's files, so a run on the same files agrees with
another. Other columns are passed on if asked for, whatever their names. An empty table gives no rows.
"""

import functools
import heapq
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from quire.llm.common import table

SIZE, CLOSING = 2048, 1
#: Cost of a token, and of a pair of tokens of one piece: in a transformer of width h, attention over 6 * h
#: tokens costs as much as all the rest; h is 1024 here.
LINEAR, QUADRATIC = 1.0, 1.0 / (6 * 1024)
#: Bytes of text of a bin, on average.
BIN_BYTES = 4 << 20
MAX_MODEL_BYTES = 16 << 20
#: Texts of a batch, and characters of words that a worker keeps.
BATCH, KEPT_CHARS = 64, 4_000_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# How a model that drops white space and ends words with a suffix splits a text into pieces.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters, numbers and white space among the first 256 characters, as class bodies.
LETTERS, NUMBERS, SPACES = "A-Za-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\xFF", "0-9\xB2\xB3\xB9\xBC-\xBE", "\t-\r \x85\xA0"
PIECE = re.compile(f"[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")


class Encoder:
    """Encodes texts. Where the model treats what white space separates independently, it does so word by word,
    and keeps the words that it has met; other models get whole texts."""

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(model)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        spec = json.loads(model)
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_word = ((spec["normalizer"] or {}).get("normalizers") == NORMALIZERS and splits[0].get("pattern") == {"Regex": PIECES} and splits[0].get("behavior") == "Removed"
                        and bool(spec["model"].get("end_of_word_suffix")))
        if self.by_word:
            from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

            suffix = spec["model"]["end_of_word_suffix"]
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith(suffix)]] = True
            # For pieces that are split and in lower case already.
            self.by_piece = Tokenizer(self.tokenizer.model)
            self.by_piece.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.forget()

    def forget(self) -> None:
        self.ids, self.pieces, self.chars = {"": b""}, {}, 0

    def learn(self, words: list[str]) -> None:
        """New words: plain ones are made of pieces, of which new ones are encoded as one text. A piece ends with an id that
        bears the suffix, which tells where the next begins. Other words are marked off by the library."""
        plain = {w: PIECE.findall(w.lower()) for w in words if (w.isascii() or max(w) < "\u0100") and "'" not in w and "<|" not in w}
        new = list(set(chain.from_iterable(plain.values())).difference(self.pieces))
        if new:
            ids = np.array(self.by_piece.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(new) or ends[-1] != len(ids):
                raise ValueError("the model splits words otherwise than expected")
            self.keep(self.pieces, new, ids, ends)
        self.ids.update((w, b"".join(map(self.pieces.__getitem__, of))) for w, of in plain.items())
        others = [w for w in words if w not in plain]
        if others:
            found = self.tokenizer.encode(others, is_pretokenized=True, add_special_tokens=False)
            self.keep(self.ids, others, np.array(found.ids, self.kind), np.searchsorted(np.array(found.word_ids, np.int64), np.arange(1, len(others) + 1)))
        self.chars += sum(map(len, words))

    def keep(self, known: dict[str, bytes], words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        packed, ends = ids.tobytes(), (ends * self.kind.itemsize).tolist()
        known.update((w, packed[a:b]) for w, a, b in zip(words, [0, *ends[:-1]], ends, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, packed as integers of self.kind."""
        if not self.by_word:
            return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if self.chars > KEPT_CHARS:
            self.forget()
        split = [self.lowered(t).replace("\n", " ").split(" ") for t in texts]
        new = set().union(*split).difference(self.ids)
        if new:
            self.learn(list(new))
        return [b"".join(map(self.ids.__getitem__, words)) for words in split]

    @staticmethod
    def lowered(text: str) -> str:
        """The text in lower case where that is the model's own and no mark of the model (which has case) is in it."""
        return text.lower() if (text.isascii() or max(text) < "\u0100") and "<|" not in text else text


@functools.lru_cache(maxsize=1)
def encoder_of(model: bytes) -> Encoder:
    """One encoder for the tasks that a worker runs one after another."""
    return Encoder(model)


def place(lengths: list[int], size: int = SIZE, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], list[float]]:
    """Pieces (document, start, length, sequence, offset) of documents of the given lengths, and the cost of each sequence."""
    pieces, costs = [], []
    rests = []
    for doc, n in enumerate(lengths):
        for start in range(0, n - size + 1, size):
            pieces.append((doc, start, size, len(costs), 0))
            costs.append(linear * size + quadratic * size * size)
        if n % size:
            rests.append((n % size, doc, n - n % size))
    rests.sort(key=lambda r: (-r[0], r[1]))
    total = sum(n for n, _, _ in rests)
    capacity = [size] * (total // size) + [1 << b for b in reversed(range(size.bit_length())) if total % size >> b & 1]
    base = len(costs)
    costs += [0.0] * len(capacity)
    room = list(capacity)
    # Sequences with room for the document at hand, by cost; those with less, by room; and all that have any, by
    # cost (with entries that are out of date). As lengths descend, a sequence only ever comes back to the first.
    wide = [(0.0, s) for s, r in enumerate(room)]
    narrow: list[tuple[int, int]] = []
    every = list(wide)
    heapq.heapify(wide)
    heapq.heapify(every)

    def put(doc: int, start: int, n: int, s: int) -> None:
        pieces.append((doc, start, n, base + s, capacity[s] - room[s]))
        room[s] -= n
        costs[base + s] += linear * n + quadratic * n * n
        if room[s]:
            heapq.heappush(every, (costs[base + s], s))

    for n, doc, start in rests:
        while narrow and -narrow[0][0] >= n:
            r, s = heapq.heappop(narrow)
            if room[s] == -r:
                heapq.heappush(wide, (costs[base + s], s))
        while wide:
            cost, s = heapq.heappop(wide)
            if cost != costs[base + s]:
                continue
            if room[s] >= n:
                put(doc, start, n, s)
                n = 0
            if room[s]:
                heapq.heappush(narrow, (-room[s], s))
            if not n:
                break
        while n:  # no sequence has room for it as a whole
            cost, s = heapq.heappop(every)
            if cost != costs[base + s] or not room[s]:
                continue
            part = min(n, room[s])
            put(doc, start, part, s)
            if room[s]:
                heapq.heappush(narrow, (-room[s], s))
            start, n = start + part, n - part
    return pieces, costs


def pack(docs: DataFrame, columns: list[str], model_path: str | None = None, size: int = SIZE, closing: int = CLOSING, bin_bytes: int = BIN_BYTES,
         linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """docs' columns (of which there must be `text` to encode), and per piece: start, length, ids (packed as little-endian
    unsigned 32-bit integers), doc_tokens, sequence_id, offset, and cost (of its sequence). size is a power of two."""
    model = open(model_path or default_model(), "rb").read()  # noqa: SIM115
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError("the model is larger than what should be sent along with a job")
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    added = [StructField("start", LongType()), StructField("length", LongType()), StructField("ids", BinaryType()), StructField("doc_tokens", LongType()),
             StructField("sequence_id", LongType()), StructField("offset", LongType()), StructField("cost", DoubleType())]
    columns = [c for c in columns if c not in {f.name for f in added}]
    passed = docs.select(*[docs[c].alias(f"_passed_{i}") for i, c in enumerate(columns)])
    names = passed.columns
    encoded = StructType([*passed.schema.fields, StructField("_row", LongType()), StructField("_ids", BinaryType())])

    def encode(batches):
        encoder = encoder_of(model)
        end = np.array([closing], encoder.kind).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                ids = encoder.encode([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([i + end for i in ids], pa.binary())], names=encoded.names)

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        kind = encoder_of(model).kind
        rows = rows.take(np.argsort(rows["_row"].to_numpy()))
        ids = [np.frombuffer(i, kind) for i in rows["_ids"].to_pylist()]
        pieces, costs = place([len(i) for i in ids], size, linear, quadratic)
        doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        cut = pa.array([ids[d][s : s + n].astype("<u4").tobytes() for d, s, n, _, _ in pieces], pa.binary())
        values = (start, length, cut, np.array([len(i) for i in ids], np.int64)[doc], (key[0].as_py() << 32) + sequence, offset, np.array(costs)[sequence])
        return pa.Table.from_arrays([*rows.select(names).take(doc).columns, *map(pa.array, values)], names=[*names, *[f.name for f in added]])

    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    placed = docs.select(*[docs[c].alias(f"_passed_{i}") for i, c in enumerate(columns)], F.monotonically_increasing_id().alias("_row"), docs["text"].alias("_text"))
    ids = placed.mapInArrow(encode, encoded)
    bins = ids.withColumn("_bin", F.pmod(F.xxhash64("_row"), F.lit(max(1, -(-n_bytes // bin_bytes)))))
    out = StructType([*passed.schema.fields, *added])
    found = bins.groupBy("_bin").applyInArrow(fill, out)
    return found.select(*[F.col(f"_passed_{i}").alias(c) for i, c in enumerate(columns)], *[f.name for f in added])


def op11_packing(spark, sf_dir):
    """Per piece, with the cost of its sequence."""
    found = pack(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost")
