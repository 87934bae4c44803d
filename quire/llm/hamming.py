"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code is the signs of its components (a bit is set where one is positive), 64 bits to a
word. Equal codes of a block of data are one entry. In each block, codes are cut into segments, of
about log2(entries) bits each, and each segment has a table from its value to the entries. A query
probes the tables in order of radius: all values of segment 1 at Hamming distance r from its own,
then of segment 2, and so on, then r + 1. What it meets is verified by full distance. After all
segments at radius r - 1 and the first a segments at radius r, every entry within
segments * r + a - 1 has been met; the search ends when the kth verified distance is within that.
Blocks of data and groups of queries are dealt over tasks as a grid; a task returns k rows a query,
and the k best of all blocks are kept. No code is left out. (The grid's cells grow with blocks times groups of queries; what
a cell returns grows with its queries.)

Ties go to the smaller id. Edge cases: vectors that are null, empty, or hold nulls have no code and
are neither found nor queried; nan counts as not positive. Codes are compared between vectors of
one dimension only. A query does not find its own row; a repeated row (same id) is not found by it
either. With fewer than k others, all are returned. An empty table gives no rows. Other columns are
not read, whatever their names.
"""

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.llm.common import cut, table

K, EVERY = 10, 50
#: Rows of a block of data, and of a group of queries. Data is copied once a group, so groups are large; both
#: are codes of a few words, so a cell of the grid takes some tens of MB.
BLOCK, GROUP = 100_000, 50_000
#: Rows that are worth a block of their own while cores are idle.
SPREAD = 5_000
#: Queries of a cell that are searched before their results are packed.
BATCH = 1_000


def coded(vectors: DataFrame) -> DataFrame:
    """id, bits (dimension), code (array of 64-bit words)."""
    good = vectors.filter(F.col("id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda c: c.isNull()))
    bit = lambda c: F.when(F.isnan(c), 0).otherwise((c > 0).cast("int"))
    n = F.size("embedding")
    words = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 64).cast("int")), lambda w: F.aggregate(
        F.sequence(w * 64, F.least(w * 64 + 63, n - 1)), F.lit(0).cast("long"),
        lambda a, i: a.bitwiseOR(F.call_function("shiftleft", bit(F.get("embedding", i)).cast("long"), (i - w * 64).cast("int")))))
    return good.select("id", n.alias("bits"), words.alias("code"))


def segments_of(bits: int, n: int) -> list[tuple[int, int]]:
    """Start and width of the segments: near log2(n) bits, 16 at most, none across a word's end."""
    width = int(min(16, max(4, round(np.log2(max(n, 2))))))
    found = []
    for word in range(0, bits, 64):
        size = min(64, bits - word)
        parts = max(1, round(size / width), -(-size // 16))
        edges = [word + size * i // parts for i in range(parts + 1)]
        found += [(a, b - a) for a, b in zip(edges, edges[1:])]
    return found


def masks(width: int, r: int) -> np.ndarray:
    """All values of width bits with r of them set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), r)], np.int64)


class Index:
    """The segment tables of distinct codes (rows of words), with up to k + 1 smallest ids each."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.bits = codes, bits
        self.segments = segments_of(bits, len(codes))
        self.tables = []
        for at, width in self.segments:
            values = self.part(codes, at, width)
            self.tables.append((np.argsort(values, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(values, minlength=1 << width))])))
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def part(codes, at, width):
        return ((codes[..., at // 64] >> np.uint64(at % 64)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def search(self, code: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries and distances that hold the k nearest; weight: how many results an entry is worth."""
        n, m = len(self.codes), len(self.segments)
        seen = np.zeros(n, bool)
        entries, distances, within = [], [], np.zeros(self.bits + 2, np.int64)
        for r in range(max(w for _, w in self.segments) + 1):
            for a, ((at, width), (order, offsets)) in enumerate(zip(self.segments, self.tables, strict=True), 1):
                if r <= width:
                    if (width, r) not in self.masks:
                        self.masks[width, r] = masks(width, r)
                    values = self.masks[width, r] ^ self.part(code, at, width)
                    starts, counts = offsets[values], offsets[values + 1] - offsets[values]
                    starts, counts = starts[counts > 0], counts[counts > 0]
                    if len(counts):
                        steps = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                        met = order[np.repeat(starts, counts) + steps]
                        met = met[~seen[met]]
                        seen[met] = True
                        d = np.bitwise_count(self.codes[met] ^ code).sum(axis=1).astype(np.int64)
                        entries.append(met)
                        distances.append(d)
                        within += np.bincount(d, weights=weight[met], minlength=self.bits + 2).astype(np.int64)
                if within[: m * r + a].sum() >= k:  # all entries at distance m * r + a - 1 or less are met
                    e, d = np.concatenate(entries), np.concatenate(distances)
                    border = int(np.searchsorted(np.cumsum(within), k))
                    return e[d <= border], d[d <= border]
        return (np.concatenate(entries), np.concatenate(distances)) if entries else (np.empty(0, np.int64), np.empty(0, np.int64))


def top_k(vectors: DataFrame, is_query, k: int = K, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """vectors: id, embedding; is_query: condition on id. Per query and neighbour: query_id, rank (from 1), id, distance."""
    codes = cut(coded(vectors))
    n = codes.count()
    spread = min(codes.sparkSession.sparkContext.defaultParallelism, n // SPREAD)  # few rows still keep all cores busy
    blocks, groups = max(1, spread, -(-n // block)), max(1, -(-codes.filter(is_query).count() // group))
    data = codes.select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), "bits", "id", "code")
    # Of equal codes in a block only the k + 1 smallest ids can be among the k nearest of a query.
    few = W.partitionBy("block", "bits", "code").orderBy("id")
    data = data.distinct().withColumn("_rank", F.row_number().over(few)).filter(F.col("_rank") <= k + 1).drop("_rank")
    data = data.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    queries = codes.filter(is_query).distinct().select(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(groups)).cast("int").alias("group"), "bits", "id", "code")
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "id": [], "distance": []}).astype("int64")
        if data.empty or queries.empty:
            return empty
        data = data.sort_values("id", ignore_index=True)
        words = np.stack([np.asarray(c, np.int64) for c in data.code]).view(np.uint64)
        distinct, entry = np.unique(words, axis=0, return_inverse=True)
        order = np.argsort(entry, kind="stable")
        count = np.bincount(entry, minlength=len(distinct))
        first, ids = np.cumsum(count) - count, data.id.to_numpy()[order]
        index, out, part = Index(distinct, int(data.bits[0])), [], []
        for number, (query, code) in enumerate(zip(queries.id, queries.code, strict=True), 1):
            # One more than k, as the query itself may be among them.
            e, d = index.search(np.asarray(code, np.int64).view(np.uint64), count, k + 1)
            steps = np.arange(count[e].sum()) - np.repeat(np.cumsum(count[e]) - count[e], count[e])
            found, far = ids[np.repeat(first[e], count[e]) + steps], np.repeat(d, count[e])
            other = found != query
            found, far = found[other], far[other]
            best = np.lexsort((found, far))[:k]
            part.append(np.stack([np.full(len(best), query), found[best], far[best]]))
            if number % BATCH == 0 or number == len(queries):
                out.append(np.concatenate(part, axis=1))
                part = []
        return pd.DataFrame(np.concatenate(out, axis=1).T, columns=["query_id", "id", "distance"])

    cells = ["block", "group", "bits"]
    local = data.groupBy(*cells).cogroup(queries.groupBy(*cells)).applyInPandas(run, "query_id long, id long, distance long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", F.col("distance").cast("int"))


def op10_hamming_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = top_k(vectors, F.col("id") % EVERY == 0)
    return found.select(F.col("query_id").alias("vec_id"), "rank", F.col("id").alias("neighbour_id"), "distance")


def oracle() -> str:
    return f"""
with codes as (select distinct vec_id, len(embedding) as bits, list_transform(embedding, lambda x: case when isnan(x) then 0 when x > 0 then 1 else 0 end) as code
    from embeddings where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null)) = 0),
pairs as (select q.vec_id, d.vec_id as neighbour_id, len(list_filter(range(1, q.bits + 1), lambda i: q.code[i] <> d.code[i]))::int as distance
    from codes q join codes d on q.bits = d.bits and q.vec_id <> d.vec_id where q.vec_id % {EVERY} = 0),
ranked as (select vec_id, row_number() over (partition by vec_id order by distance, neighbour_id)::int as rank, neighbour_id, distance from pairs)
select vec_id, rank, neighbour_id, distance from ranked where rank <= {K}"""
