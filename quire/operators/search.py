"""Retrieval: filters, lexical scores, rank fusion, field search and answer context."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions.text import tokens
from quire.functions.vectors import nearest
from quire.operators.components import components
from quire.operators.ivf import usable
from quire.operators.lineage import cut

K1, B, RRF = 1.2, 0.75, 60
#: Rows of a word that a task scores.
POSTINGS = 100_000
#: Vectors of a bucket's block, and rows of a task that compares blocks.
BLOCK, CELL_ROWS = 4000, 20_000
SEARCHABLE = ("validated", "completed")


def filters(tag_ids=None, document_ids=None, statuses=None, since: Column | None = None, until: Column | None = None) -> Column:
    """A predicate on chunks; None or an empty list does not filter. Bounds are inclusive."""
    found = F.lit(True)
    for column, values in (("tag_id", tag_ids), ("document_id", document_ids), ("status", statuses)):
        if values:
            found = found & F.col(column).isin(*values)
    if since is not None:
        found = found & (F.col("created_at") >= since)
    if until is not None:
        found = found & (F.col("created_at") <= until)
    return found


def fetch(top_k: int) -> int:
    return min(max(top_k * 10, 100), 500)


def clamp(top_k: int) -> int:
    return min(top_k, 50)


def matches(rows: DataFrame, queries: DataFrame, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """rows: document_id, text; queries: query_id, words (array). Word sets (of, query_id), and for each set the rows that hold all of
    its words: of, document_id, score (BM25). pairs (query_id, document_id): only these are scored, by the statistics of all rows.

    Texts are split into words once, and only the words that are asked for go on. Queries of the same words are scored once. A word's
    rows are dealt to as many tasks as their number asks for.
    """
    sets = queries.select("query_id", F.array_sort(F.array_distinct("words")).alias("set"))
    wanted = cut(sets.select("set").distinct()).select(F.xxhash64("set").alias("of"), F.explode("set").alias("word"), F.size("set").alias("n_words"))
    of = sets.select(F.xxhash64("set").alias("of"), "query_id")
    vocabulary = [r.word for r in wanted.select("word").distinct().limit(1001).collect()]
    words = rows.select("document_id", tokens(F.col("text")).alias("words"))
    held = F.filter("words", lambda w: w.isin(vocabulary)) if len(vocabulary) <= 1000 else F.col("words")
    counts = words.select("document_id", F.size("words").alias("size"), F.explode_outer(held).alias("word")).groupBy("document_id", "size", "word").agg(F.count("*").alias("tf"))
    counts = cut(counts)
    overall = counts.groupBy("document_id", "size").agg(F.lit(1)).agg(F.count("*").alias("n"), F.avg("size").alias("mean")).first()
    counts = counts.filter("word is not null")
    idf = F.log((F.lit(overall.n or 0) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    known = counts.groupBy("word").agg(F.count("*").alias("df")).withColumn("salts", F.ceil(F.col("df") / POSTINGS).cast("int"))
    weighed = wanted.join(known, "word").withColumn("idf", idf)
    if pairs is not None:
        asked = pairs.join(of, "query_id").select("of", "document_id").distinct()
        hits = asked.join(weighed, "of").join(counts, ["document_id", "word"])
    else:
        salted = weighed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        hits = counts.join(known.select("word", "salts"), "word").withColumn("salt", F.pmod(F.xxhash64("document_id"), F.col("salts")).cast("int")).drop("salts").join(salted.drop("salts"), ["word", "salt"])
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(overall["mean"] or 1.0)))
    # Summed in order of the words, so that the sum is the same everywhere; a set has few words.
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("word", weight.alias("w")))), F.lit(0.0), lambda s, x: s + x["w"])
    scored = hits.groupBy("of", "document_id").agg(F.round(total, 6).alias("score"), F.count("*").alias("n"), F.max("n_words").alias("n_words")).filter("n = n_words")
    return of, scored.select("of", "document_id", "score")


def bm25(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best rows that hold all words of a query: query_id, document_id, score, rank. Each task hands on k rows a word set at most."""
    of, scored = matches(rows, queries)
    best = scored.withColumn("rank", F.row_number().over(W.partitionBy("of").orderBy(F.desc("score"), "document_id"))).filter(F.col("rank") <= k)
    return best.join(of, "of").select("query_id", "document_id", "score", "rank")


def text_rank(rows: DataFrame, queries: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """The scores of pairs (query_id, document_id) whose row holds all words of the query. Without pairs, of all such rows, with their rank.

    Hits of a word set are ranked in ranges of their order, and dealt to as many tasks again before they meet its queries.
    """
    of, scored = matches(rows, queries, pairs)
    if pairs is not None:
        return pairs.join(of, "query_id").join(scored, ["of", "document_id"]).select("query_id", "document_id", "score")
    parts, order = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), [F.desc("score"), F.col("document_id")]
    placed = cut(scored.repartitionByRange(parts, "of", *order).withColumn("range", F.spark_partition_id()))
    before = F.sum("n").over(W.partitionBy("of").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    starts = placed.groupBy("of", "range").agg(F.count("*").alias("n")).select("of", "range", F.coalesce(before, F.lit(0)).alias("start"))
    ranked = placed.withColumn("nth", F.row_number().over(W.partitionBy("of", "range").orderBy(*order))).join(starts, ["of", "range"])
    ranked = ranked.select("of", "document_id", "score", (F.col("start") + F.col("nth")).cast("int").alias("rank"), F.pmod(F.xxhash64("document_id"), F.lit(parts)).cast("int").alias("part"))
    return ranked.join(of.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), ["of", "part"]).select("query_id", "document_id", "score", "rank")


def fuse(rankings: list[DataFrame], constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, document_id, rank)."""
    every = rankings[0].select("query_id", "document_id", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query_id", "document_id", "rank"))
    fused = every.groupBy("query_id", "document_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 6).alias("score"))
    return fused.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "document_id")))


def hybrid(chunks: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """queries: query_id, embedding, words. Dense and lexical rankings fused; a query without a lexical
    hit gets its dense ranking and cosine scores (mode_used tells)."""
    n = fetch(top_k)
    dense = cut(nearest(chunks, queries, n))  # either is used more than once
    lexical = cut(bm25(chunks, queries, n))
    has = lexical.select("query_id").distinct()
    fused = fuse([dense.join(has, "query_id", "left_semi"), lexical]).withColumn("mode_used", F.lit("hybrid"))
    plain = dense.join(has, "query_id", "left_anti").select("query_id", "document_id", "score", "rank").withColumn("mode_used", F.lit("dense"))
    return fused.unionByName(plain).filter(F.col("rank") <= top_k)


def field_search(fields: DataFrame, conditions: list[tuple[str, str, object]]) -> DataFrame:
    """Documents whose fields (document_id, key, value) meet all conditions (key, operator, operand)."""
    number = F.col("value").try_cast("double")
    tests = {
        "eq": lambda v: F.col("value") == v, "neq": lambda v: F.col("value") != v, "gte": lambda v: number >= v, "lte": lambda v: number <= v,
        "contains": lambda v: F.contains(F.col("value"), F.lit(v)), "in": lambda v: F.col("value").isin(*v), "exists": lambda v: F.col("value").isNotNull()}
    named = [(F.col("key") == key) & tests[op](operand) for key, op, operand in conditions]
    some = fields.filter(F.col("key").isin(*{k for k, _, _ in conditions}))
    met = some.groupBy("document_id").agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(named)])
    keep = F.lit(True)
    for i in range(len(named)):
        keep = keep & F.col(f"c{i}")
    return met.filter(keep).select("document_id")


def budgeted(hits: DataFrame, budget: int) -> DataFrame:
    """hits: query_id, rank, tokens. The best hits of each query whose tokens fit the budget."""
    return hits.withColumn("used", F.sum("tokens").over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))).filter(F.col("used") <= budget)


def by_planes(rows: DataFrame, name: str, n_tables: int, bits: int, seed: int = 3) -> DataFrame:
    """name and key: in each of n_tables tables, the side of bits random hyperplanes that a vector lies on (and the
    table and the vector's size). Zero vectors, and those with nulls or nan, have none."""
    place = 1 << np.arange(bits, dtype=np.int64)

    def run(parts):
        planes: dict[int, np.ndarray] = {}
        for pdf in parts:
            for size, of in pdf.groupby(pdf.embedding.str.len()):
                if size not in planes:
                    planes[size] = np.random.Generator(np.random.PCG64([seed, int(size)])).standard_normal((int(size), n_tables * bits))
                side = (np.stack(of.embedding.to_list()).astype(np.float64) @ planes[size] > 0).reshape(len(of), n_tables, bits)
                keys = ((side @ place) * n_tables + np.arange(n_tables)) * 65536 + int(size)
                yield pd.DataFrame({name: of[name].to_numpy(), "keys": keys.tolist()})

    return usable(rows).select(name, "embedding").mapInPandas(run, f"{name} long, keys array<long>").select(name, F.explode("keys").alias("key"))


def bits_for(n: int) -> int:
    """Hyperplanes of a table so that a bucket of spread-out vectors keeps its size."""
    return int(min(40, max(4, round(np.log2(max(n, 1) / 32)))))


def linked(sides: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """sides: document_id, key. u, v: for vectors of one key that links of at least that cosine join, a link of each to the smallest of them.

    Keys of one vector are left out first. A key of many is cut into blocks, and each pair of blocks is compared by a matrix
    product in a task of its own; small keys share a task. What a task hands on is a link for each of its vectors, not its pairs.
    """
    shared = sides.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    each = sides.join(shared, "key").withColumn("block", F.pmod(F.xxhash64("document_id", "key"), F.col("blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = cut(each.select("document_id", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("unit")))
    n_cells = max(1, -(-each.count() // CELL_ROWS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["unit", "document_id"], ignore_index=True)
        bounds = np.flatnonzero(np.append(True, pdf.unit.to_numpy()[1:] != pdf.unit.to_numpy()[:-1])).tolist() + [len(pdf)]
        ids, found = pdf.document_id.to_numpy(), []
        for start, end in zip(bounds, bounds[1:], strict=False):
            x = np.stack(pdf.embedding[start:end].to_list()).astype(np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            root = np.arange(end - start)
            for first in range(0, len(x), 256):
                for hits in x[first : first + 256] @ x.T >= least:
                    of = root[hits]
                    if len(of) and (of != of[0]).any():  # what one vector is linked to is one group, under its least
                        root[np.isin(root, of)] = of.min()
            at = np.flatnonzero(root != np.arange(end - start))
            found.append(pd.DataFrame({"u": ids[start + at], "v": ids[start + root[at]]}))
        return pd.concat(found, ignore_index=True).drop_duplicates()

    cells = each.join(nodes.select("document_id", "embedding"), "document_id").groupBy(F.pmod("unit", F.lit(n_cells)).alias("cell"))
    return cells.applyInPandas(run, "u long, v long").distinct()


def alike(rows: DataFrame, least: float, missed: float = 1e-6) -> DataFrame:
    """rows: document_id, embedding. document_id and class_id, the smallest id that links reach: pairs whose cosine is
    least or more. A pair of exactly that likeness meets in no table with a chance of `missed`; the number
    of tables follows from that, whatever the size. Equal vectors are one in all joins but the last."""
    same = rows.filter("embedding is not null and document_id is not null").groupBy("embedding").agg(F.min("document_id").alias("class"))
    nodes = cut(same.select(F.col("class").alias("document_id"), "embedding"))
    bits = bits_for(nodes.count())
    met = (1 - np.arccos(least) / np.pi) ** bits
    sides = by_planes(nodes, "document_id", int(np.ceil(np.log(missed) / np.log(1 - met))), bits)
    found = components(linked(sides, nodes, least))
    classes = nodes.join(found, F.col("node") == F.col("document_id"), "left").select("embedding", F.coalesce("component", "document_id").alias("class_id"))
    return rows.select("document_id", "embedding").join(classes, "embedding", "left").select("document_id", F.coalesce("class_id", "document_id").alias("class_id"))
