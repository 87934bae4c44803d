"""Spelling variants: near words by blocked Gram matrices of letter counts.

A word is a vector of letter counts, and the squared distance of two vectors comes out of a matrix product
(|a|^2 + |b|^2 - 2ab). One replaced letter makes it 2, one inserted or deleted letter 1, so pairs at a distance
of 1 or 2 are the candidates; each is verified on its letters.

Products are made between blocks of words that are alike in length and in how many of their letters
belong to each of CLASSES classes (a letter's code point modulo CLASSES). A block meets itself and the
adjacent blocks only: those one edit away, of the same length (one letter moves from a class to another)
or of one letter less. All other blocks are farther than two. Each pair of words meets in one place: the
longer word, or of two of one length the one whose odd letter is of the smaller class, or of two of a block the
larger, goes to the block of the other. Blocks and what comes to them are cut into bounded chunks, each
product is of one chunk of either, and many small products share a task. No candidate is capped.

A word's form is the near word of largest count if that is at least twice the word's own; forms at least
double along a chain, so chains are short, and roots come from a few rounds of pointer doubling.

Edge cases: null and empty texts have no words. Texts and words of any length count whole. Where doc_id
is null nothing is deleted from a word (there is no `<doc_id>:<run>`). Rows count each on their own, repeated or not.
Ties in n go to the word that is smaller in code-point order. Other columns are not read, whatever
their names. An empty table gives no rows.
"""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, table

LEAST_LETTERS, LEAST_COUNT, DELETE_ONE_IN = 5, 3, 97
#: Words are bytes of ISO 8859-1, which holds all letters of runs, in code-point order. bytes.lower() turns only A-Z.
RUN = re.compile(rb"[a-z\xC0-\xFF]+")
CLASSES = 7
#: Words of a chunk of a block, and of what comes to it; rows of a task, about.
CHUNK, COMING, CELL_ROWS = 4096, 16384, 200_000
#: Words that a task counts before it hands on the counts.
COUNTED = 300_000
#: Longer words are verified one by one; those of more than EXACT letters are multiplied in double precision.
WIDTH, EXACT = 64, 1000
SLICE, CANDIDATES = 1024, 200_000
#: byte -> letter, from 0.
LETTER = np.full(256, -1, np.int16)
LETTER[[*range(97, 123), *range(0xC0, 0x100)]] = np.arange(26 + 64)
N_LETTERS = 26 + 64
#: What a class adds to a block's key: keys of words with under 512 letters of each class differ, others may not.
PLACES = 512 ** np.arange(CLASSES, dtype=np.int64)


def observed(text: str, doc_id) -> Counter:
    """The words of a text with their counts, one letter deleted where the hash says so."""
    found = Counter()
    for run, n in Counter(RUN.findall(text.encode("iso-8859-1", "replace").lower())).items():
        if doc_id is not None:
            h = zlib.crc32(f"{doc_id}:{run.decode('iso-8859-1')}".encode())
            if h % DELETE_ONE_IN == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
        if len(run) >= LEAST_LETTERS:
            found[run] += n
    return found


def words_of(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. word (bytes) and n of all words that are long and frequent enough."""

    def handed(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        counts = Counter()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                if texts[i].is_valid:
                    for word, n in observed(texts[i].as_py(), ids[i].as_py()).items():
                        counts[word] += n
                if len(counts) > COUNTED:
                    yield handed(counts)
                    counts = Counter()
        yield handed(counts)

    counted = docs.select("doc_id", "text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All words' letters in a row, and the word of each."""
    return LETTER[np.frombuffer(b"".join(words), np.uint8)], np.repeat(np.arange(len(words)), [len(w) for w in words])


def classes(words: list[bytes]) -> np.ndarray:
    """How many letters of each class a word has."""
    codes, of = np.frombuffer(b"".join(words), np.uint8), np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(of * CLASSES + codes % CLASSES, minlength=len(words) * CLASSES).reshape(-1, CLASSES)


def blocked(words: DataFrame) -> DataFrame:
    """word, n, comes and key: a row (comes false) for the word in its own block, and one for each block that it comes to."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                words = part.column(0).to_pylist()
                if not words:
                    continue
                counts = classes(words)
                own = counts @ PLACES
                every = np.arange(len(words))
                found = [(every, own, False), (every, own, True)]
                for i in range(CLASSES):
                    has = np.flatnonzero(counts[:, i])
                    found.append((has, own[has] - PLACES[i], True))
                    found += [(has, own[has] - PLACES[i] + PLACES[j], True) for j in range(i + 1, CLASSES)]
                rows = pa.array(np.concatenate([r for r, _, _ in found]))
                keys, comes = np.concatenate([k for _, k, _ in found]), np.concatenate([np.full(len(r), c) for r, _, c in found])
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(comes), pa.array(keys)], names=["word", "n", "comes", "key"])

    return words.select("word", "n").mapInArrow(run, "word binary, n long, comes boolean, key long")


def near_long(a: bytes, b: bytes) -> bool:
    """Whether b, which is at most one letter shorter, is one edit from a."""
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[at + 1 :] == (b[at + 1 :] if len(a) == len(b) else b[at:])


def near(words: list[bytes], padded: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) of rows are one edit apart. a is as long as b or longer by one, and differs from it."""
    found = np.zeros(len(a), bool)
    short = np.maximum(size[a], size[b]) <= WIDTH
    found[~short] = [near_long(words[i], words[j]) for i, j in zip(a[~short].tolist(), b[~short].tolist(), strict=True)]
    at = np.flatnonzero(short & (size[a] == size[b]))
    found[at] = (padded[a[at]] != padded[b[at]]).sum(1) == 1
    at = np.flatnonzero(short & (size[a] != size[b]))
    x, y = padded[a[at]], padded[b[at]]
    first = (x != y).argmax(1)  # they differ at the end of the shorter one, if not before
    apart = x[:, 1:] != y[:, :-1]
    last = np.where(apart.any(1), WIDTH - 2 - apart[:, ::-1].argmax(1), -1)
    found[at] = last < first
    return found


def candidates(coming: list[bytes], there: list[bytes]):
    """Pairs of positions (coming, there) at a squared distance of 1 or 2, a batch at a time."""
    kind = np.float64 if max(map(len, coming + there)) > EXACT else np.float32

    def vectors(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        codes, of = letters(words)
        counts = np.bincount(of * N_LETTERS + codes, minlength=len(words) * N_LETTERS).reshape(-1, N_LETTERS).astype(kind)
        return counts, (counts * counts).sum(1, keepdims=True) / 2

    d, d_half = vectors(there)
    # With half the squared lengths as two more components, the product is minus half the squared distance.
    d = np.hstack([d, np.ones_like(d_half), -d_half]).T
    for start in range(0, len(coming), SLICE):
        q, q_half = vectors(coming[start : start + SLICE])
        product = np.hstack([q, -q_half, np.ones_like(q_half)]) @ d
        at = np.flatnonzero(product >= -1)
        at = at[product.ravel()[at] < 0]
        yield at // len(there) + start, at % len(there)


def near_pairs(words: DataFrame) -> DataFrame:
    """words: word, n (unique). word, near and near_n: a row for each word and each of its near words."""
    every = cut(blocked(words))
    sizes = every.groupBy("key").agg(F.count_if(~F.col("comes")).alias("there"), F.count_if("comes").alias("coming"))
    cut_up = sizes.select("key", F.ceil(F.col("there") / CHUNK).cast("int").alias("chunks"), F.ceil(F.col("coming") / COMING).cast("int").alias("groups")).filter("chunks > 1 or groups > 1")
    dealt = every.join(cut_up, "key", "left").withColumns({"chunks": F.coalesce("chunks", F.lit(1)), "groups": F.coalesce("groups", F.lit(1))})
    own = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # A word comes to all chunks of a block, and what is there to all groups of what comes.
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("comes"), all_of("chunks")).otherwise(all_of("groups"))))
    chunk, group = F.when(F.col("comes"), F.col("part")).otherwise(own("chunks")), F.when(F.col("comes"), own("groups")).otherwise(F.col("part"))
    dealt = dealt.select("word", "n", "comes", F.xxhash64("key", chunk, group).alias("unit"), "key", chunk.alias("chunk"), group.alias("group"))

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        word, n, comes = rows["word"].to_pylist(), rows["n"].to_numpy(), rows["comes"].to_numpy()
        place = [rows[c].to_numpy() for c in ("key", "chunk", "group")]
        order = np.lexsort([comes, *place[::-1]])
        word, n, comes, place = [word[i] for i in order.tolist()], n[order], comes[order], [p[order] for p in place]
        bounds = np.flatnonzero(np.concatenate([[True], np.any([p[1:] != p[:-1] for p in place], axis=0), [True]]))
        size = np.array([len(w) for w in word])
        padded = np.frombuffer(b"".join(w[:WIDTH].ljust(WIDTH, b"\0") for w in word), np.uint8).reshape(-1, WIDTH)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def verify() -> None:
            a, b = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            step = size[a] - size[b]
            a, b = a[(step == 0) | (step == 1)], b[(step == 0) | (step == 1)]
            ok = near(word, padded, size, a, b)
            a, b = a[ok], b[ok]
            if len(a):
                # Whether this is the block where the two meet (blocks of very long words can share a key).
                move = classes([word[i] for i in b.tolist()]) - classes([word[i] for i in a.tolist()])
                to, off = (move == 1).argmax(1), (move == -1).argmax(1)
                larger = np.array([word[i] > word[j] for i, j in zip(a.tolist(), b.tolist(), strict=True)])
                ok = np.where(move.any(1), (size[a] > size[b]) | (off < to), larger)
                found.append((a[ok], b[ok]))

        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            middle = start + int((~comes[start:end]).sum())
            if start < middle < end:
                first = {w: i for i, w in enumerate(word[middle:end], middle)}  # a word comes once, even where keys are shared
                coming, rows_of = list(first), np.array(list(first.values()))
                for q, d in candidates(coming, word[start:middle]):
                    waiting.append((rows_of[q], d + start))
                if sum(len(a) for a, _ in waiting) > CANDIDATES:
                    verify()
        if waiting:
            verify()
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.array([], int), np.array([], int))
        one, other = np.concatenate([a, b]), np.concatenate([b, a])
        words = pa.array(word, pa.binary())
        return pa.Table.from_arrays([words.take(pa.array(one)), words.take(pa.array(other)), pa.array(n[other])], names=["word", "near", "near_n"])

    n_cells = max(1, -(-dealt.count() // CELL_ROWS))
    cells = dealt.groupBy(F.pmod("unit", F.lit(n_cells)).alias("cell"))
    return cells.applyInArrow(compare, "word binary, near binary, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """forms: word, form. word and root: the last word that forms lead to. Distances covered double each round."""
    known = cut(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("moved")))
    while True:
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        known = cut(known.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        if known.filter("moved").isEmpty():
            return known.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Per word: word, form, root, n, n_near, form_n."""
    words = cut(words_of(docs))
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus_n"), "near")).alias("best"))
    strong = -F.col("best.minus_n") >= 2 * F.col("n")
    met = cut(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.minus_n")).cast("long").alias("form_n")))
    rooted = met.join(roots(met.filter("form is not null")), "word", "left")
    said = lambda c: F.decode(c, "ISO-8859-1")
    return rooted.select(said(F.col("word")).alias("word"), said(F.col("form")).alias("form"), said(F.coalesce("root", "word")).alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir):
    return variants(table(spark, sf_dir, "documents"))
