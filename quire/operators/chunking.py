"""Packing pages into chunks: greedily with overlap, and by cumulative windows in SQL terms.

Pages are cut into paragraphs (at blank lines; the lines of a table are one of their own), these into sentences,
and sentences longer than a chunk between words; a word of more than LONGEST_WORD characters is cut. A table is kept
whole up to twice a chunk's size, beyond that it is cut into its lines. Pieces are packed in order: a chunk
takes a paragraph that fits a chunk as a whole or ends before it, and begins with the last pieces of
the one before, up to the overlap and as far as there is room. Short pages run on into the next.

Pieces are made by built-in expressions. Packing goes through a document's pieces in order, in a task that has
them sorted and holds one chunk; documents are spread over tasks by their id.
"""

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.functions import udtf

from quire.functions.text import CJK, estimate_tokens, sentences, trimmed

TARGET, OVERLAP = 512, 64
LONGEST_WORD = 1000
TABLE = r"(?md)((?:^\|[^\n]*(?:\n|\z))+)"  # d: only \n ends a line
PIECE = "document_id long, page int, paragraph int, place int, line int, text string, tokens long, whole long"
CHUNK = "document_id long, chunk_index int, page_from int, page_to int, text string, token_count int"


def paragraphs(text: Column) -> Column:
    """Paragraphs and tables of a page, in order."""
    apart = F.regexp_replace(text, TABLE, "\n\n$1\n\n")
    return F.filter(F.transform(F.split(apart, r"\n[ \t]*\n"), lambda p: trimmed(F.regexp_replace(p, r"^\n+|\n+\z", ""))), lambda p: p != "")


def wrapped(text: Column, width: Column) -> Column:
    """Lines of a long text, between words (those too long are cut): a word goes to the line in which it ends, in steps of width characters."""
    words = F.split(F.regexp_replace(text, rf"([^ ]{{{LONGEST_WORD}}})", "$1 "), " ")
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(-1).cast("long").alias("line"), F.expr("cast(array() as array<string>)").alias("lines"))

    def add(done: Column, word: Column) -> Column:
        line = F.floor((done["end"] + F.length(word) - 1) / width)
        n = F.size(done["lines"])
        longer = F.concat(F.slice(done["lines"], F.lit(1), n - 1), F.array(F.concat(F.element_at(done["lines"], -1), F.lit(" "), word)))
        lines = F.when(line == done["line"], longer).otherwise(F.concat(done["lines"], F.array(word)))
        return F.struct((done["end"] + F.length(word) + 1).alias("end"), line.alias("line"), lines.alias("lines"))

    return F.aggregate(words, start, add, lambda done: F.filter(F.transform(done["lines"], trimmed), lambda x: x != ""))


def pieces(pages: DataFrame, target: int = TARGET) -> DataFrame:
    """pages: document_id, page, text. Pieces with their place, tokens, and the tokens of their whole paragraph."""
    # What is used more than once goes through an array that is exploded, so that it is computed once. The outer form keeps the
    # optimiser from computing arrays again for a filter of empty ones; their rows are left out after it.
    found = F.transform(paragraphs(F.col("text")), lambda p: F.struct(p.alias("text"), p.rlike(CJK).alias("wide")))
    each = pages.select("document_id", "page", F.posexplode_outer(found).alias("paragraph", "p")).filter("paragraph is not null")
    n = lambda text: F.when(F.col("p.wide"), estimate_tokens(text)).otherwise(F.ceil(F.length(text) / 4.0).cast("long"))
    table = F.col("p.text").startswith("|")
    whole_table = table & (n(F.col("p.text")) <= 2 * target)
    cut = F.when(whole_table, F.array("p.text")).when(table, F.split("p.text", "\n")).otherwise(sentences(F.col("p.text")))
    each = each.withColumn("s", F.transform(cut, lambda s: F.struct(s.alias("text"), n(s).alias("tokens"))))
    total = F.aggregate("s", F.lit(0).cast("long"), lambda sum_, s: sum_ + s["tokens"])
    rows = each.select("document_id", "page", "paragraph", "p", total.alias("whole"), F.posexplode_outer("s").alias("place", "s")).filter("place is not null")
    fits = (F.col("s.tokens") <= target) | whole_table
    again = F.transform(wrapped(F.col("s.text"), F.floor(F.length("s.text") * target / F.col("s.tokens"))), lambda x: F.struct(x.alias("text"), n(x).alias("tokens")))
    lined = rows.select("document_id", "page", "paragraph", "place", "whole", F.posexplode_outer(F.when(fits, F.array("s")).otherwise(again)).alias("line", "s")).filter("line is not null")
    return lined.select("document_id", "page", "paragraph", "place", "line", "s.text", "s.tokens", "whole")


class Packer:
    """The chunk at hand of one document: pieces as (page, text, tokens), of which the first `kept` are the overlap."""

    def __init__(self, target: int, overlap: int):
        self.target, self.overlap = target, overlap
        self.current: list[tuple[int, str, int]] = []
        self.size = self.kept = 0

    def close(self) -> tuple[int, int, str, int]:
        return self.current[0][0], self.current[-1][0], " ".join(text for _, text, _ in self.current), self.size

    def add(self, page: int, text: str, tokens: int, need: int) -> tuple[int, int, str, int] | None:
        """Take a piece; the chunk that ends before it, if one does. need: the tokens that should go together from here on."""
        done = None
        if len(self.current) > self.kept and self.size + need > self.target:
            done = self.close()
            room, start = min(self.overlap, self.target - need), len(self.current)
            while start and (n := self.current[start - 1][2]) <= room:
                room, start = room - n, start - 1
            self.current = self.current[start:]
            self.size, self.kept = sum(n for _, _, n in self.current), len(self.current)
        self.current.append((page, text, tokens))
        self.size += tokens
        return done


def pack(rows: Iterable[tuple[int, int, str, int, int]], target: int = TARGET, overlap: int = OVERLAP) -> Iterator[tuple[int, int, str, int]]:
    """Rows (page, paragraph, text, tokens, whole) of a document in order. Chunks as (page_from, page_to, text, tokens)."""
    packer, before = Packer(target, overlap), None
    for page, paragraph, text, tokens, whole in rows:
        need = whole if (page, paragraph) != before and whole <= target else tokens
        before = page, paragraph
        if done := packer.add(page, text, tokens, need):
            yield done
    if len(packer.current) > packer.kept:
        yield packer.close()


def chunk_pages(pages: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """pages: document_id, page, text. Chunks of each document, from chunk_index 0."""
    order = ["document_id", "page", "paragraph", "place", "line"]
    names = [c.split()[0] for c in CHUNK.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, document, index, before = Packer(target, overlap), None, 0, None
        for batch in batches:
            out = []
            for d, page, paragraph, text, tokens, whole in zip(*(batch.column(c).to_pylist() for c in ("document_id", "page", "paragraph", "text", "tokens", "whole")), strict=True):
                if d != document:
                    if len(packer.current) > packer.kept:
                        out.append((document, index, *packer.close()))
                    packer, document, index, before = Packer(target, overlap), d, 0, None
                need = whole if (page, paragraph) != before and whole <= target else tokens
                before = page, paragraph
                if done := packer.add(page, text, tokens, need):
                    out.append((d, index, *done))
                    index += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names=names)
        if len(packer.current) > packer.kept:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((document, index, *packer.close()), kinds, strict=True)], names=names)

    return pieces(pages, target).repartition("document_id").sortWithinPartitions(*order).mapInArrow(run, CHUNK)


def sentence_rows(pages: DataFrame) -> DataFrame:
    """document_id, page, place (from 0), sentence."""
    return pages.select("document_id", "page", F.posexplode(sentences(F.col("text"))).alias("place", "sentence"))


def chunk_windows(pages: DataFrame, target: int = TARGET) -> DataFrame:
    """Chunks without overlap by windows of cumulative tokens: all in built-in expressions."""
    rows = sentence_rows(pages).withColumn("tokens", estimate_tokens(F.col("sentence")))
    run = W.partitionBy("document_id").orderBy("page", "place").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("chunk_index", F.floor((F.sum("tokens").over(run) - 1) / target).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "place", "sentence"))), lambda s: s["sentence"]), " ")
    return placed.groupBy("document_id", "chunk_index").agg(F.min("page").alias("page_from"), F.max("page").alias("page_to"), text.alias("text"), F.sum("tokens").alias("token_count"))


@udtf(returnType=CHUNK)
class ChunkPieces:
    """chunk_pieces(piece => table(...) partition by document_id order by (page, paragraph, place, line), target => ..., overlap => ...), for use in SQL."""

    def __init__(self):
        self.packer, self.document, self.before, self.index = None, None, None, 0

    def eval(self, piece, target: int, overlap: int):
        self.packer, self.document = self.packer or Packer(target, overlap), piece["document_id"]
        place = piece["page"], piece["paragraph"]
        need = piece["whole"] if place != self.before and piece["whole"] <= target else piece["tokens"]
        self.before = place
        if done := self.packer.add(piece["page"], piece["text"], piece["tokens"], need):
            yield self.document, self.index, *done
            self.index += 1

    def terminate(self):
        if self.packer and len(self.packer.current) > self.packer.kept:
            yield self.document, self.index, *self.packer.close()


def register(spark) -> None:
    spark.udtf.register("chunk_pieces", ChunkPieces)
