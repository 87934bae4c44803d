"""Approximate nearest vectors by an inverted file: lists around centroids, residual codes, exact ranking of candidates.

Centroids come from a sample of at most SAMPLE vectors, by spherical k-means on the driver; every vector belongs to the list of the nearest one
and is stored there, as a file partition, beside a code of a byte per component of its residual. A query looks into the lists of
its nearest centroids only, and files of other lists are not read; codes give candidates, whose exact cosine gives the
result. Lists that outgrow a task are searched in chunks. Vectors of unlike size are never compared; null and zero
vectors, and those with nulls or nan, have no list.
"""

import uuid
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions.vectors import cosine, dot, nearest
from quire.operators.lineage import cut, shared_folder

#: Vectors that centroids are trained on, lists of a vector size, rows of a list that a task searches, and queries it searches for.
SAMPLE, MOST_LISTS, CHUNK, ASKED = 50_000, 4096, 20_000, 8192
#: Candidates by codes for each result.
PER_RESULT = 4


class Index(NamedTuple):
    folder: str
    centroids: dict[int, np.ndarray]  # by vector size


def usable(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & (dot(F.col("embedding"), F.col("embedding")) > 0))


def unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    draw = np.random.Generator(np.random.PCG64(k))
    centroids = x[draw.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        of = np.concatenate([(x[at : at + 4096] @ centroids.T).argmax(1) for at in range(0, len(x), 4096)])
        total = np.zeros_like(centroids)
        np.add.at(total, of, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centroids = np.where(norm > 0, total / np.where(norm > 0, norm, 1), x[draw.choice(len(x), k)])
    return centroids


def build(rows: DataFrame, folder: str | None = None) -> Index:
    """rows: document_id, embedding."""
    spark, good = rows.sparkSession, usable(rows).filter("document_id is not null").select("document_id", "embedding")
    n = good.count()
    sample = good.filter(F.pmod(F.xxhash64("document_id", F.lit(7)), F.lit(max(1, n))) < SAMPLE).select("embedding").limit(2 * SAMPLE).toPandas()
    centroids = {}
    for size, of in sample.groupby(sample.embedding.str.len()) if len(sample) else ():
        x = unit(of.embedding)
        centroids[int(size)] = k_means(x, int(min(MOST_LISTS, len(x), max(1, round(np.sqrt(n * len(x) / len(sample)))))))

    def put(parts):
        for pdf in parts:
            for size, of in pdf.groupby(pdf.embedding.str.len()):
                x, c = unit(of.embedding), centroids.get(size)
                if c is None:  # a size that no vector of the sample has: one list
                    c = np.zeros((1, x.shape[1]))
                lists = (x @ c.T).argmax(1)
                rest = x - c[lists]
                scale = np.maximum(np.abs(rest).max(1), 1e-30) / 127
                codes = np.rint(rest / scale[:, None]).astype(np.int8)
                yield pd.DataFrame({"size": np.int32(size), "list": lists.astype(np.int32), "document_id": of.document_id.to_numpy(), "scale": scale, "code": [r.tobytes() for r in codes], "embedding": of.embedding})

    folder = folder or f"{shared_folder(spark)}/ivf-{uuid.uuid4().hex}"
    placed = good.mapInPandas(put, "size int, list int, document_id long, scale double, code binary, embedding array<double>")
    placed.hint("rebalance", "size", "list").write.partitionBy("size", "list").parquet(folder)
    return Index(folder, centroids)


def search(index: Index, rows: DataFrame, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """queries: query_id, embedding. query_id, document_id, score and rank of about the k nearest of rows, which the index is of."""
    spark, centroids = rows.sparkSession, index.centroids

    def probed(parts):
        for pdf in parts:
            for size, of in pdf.groupby(pdf.embedding.str.len()):
                x, c = unit(of.embedding), centroids.get(size)
                if c is None:
                    c = np.zeros((1, x.shape[1]))
                near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield pd.DataFrame({"query_id": of.query_id, "size": np.int32(size), "lists": list(near), "_y": of.embedding})

    asked = usable(queries).filter("query_id is not null").select("query_id", "embedding").mapInPandas(probed, "query_id long, size int, lists array<int>, _y array<double>")
    asked = asked.select("query_id", "size", "_y", F.explode("lists").alias("list"))
    # At most MOST_LISTS for each vector size; they prune the files that are read.
    wanted = asked.select("size", "list").distinct().collect()
    stored = spark.read.schema("document_id long, scale double, code binary, embedding array<double>, size int, list int").parquet(index.folder)
    stored = stored.filter(F.col("size").isin({r["size"] for r in wanted}) & F.col("list").isin({r["list"] for r in wanted})) if wanted else stored.filter("false")
    cells = stored.groupBy("size", "list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    groups = asked.groupBy("size", "list").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("groups"))
    grid = cells.join(groups, ["size", "list"])
    own = lambda name, n: F.pmod(F.xxhash64(name, F.lit(3)), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = stored.select("size", "list", "document_id", "scale", "code").join(grid, ["size", "list"]).withColumns({"_d": own("document_id", "chunks")}).withColumn("_q", all_of("groups")).drop("chunks", "groups")
    sought = asked.join(grid, ["size", "list"]).withColumn("_q", own("query_id", "groups")).withColumn("_d", all_of("chunks")).drop("chunks", "groups")

    def run(key: tuple, data: pd.DataFrame, sought: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(sought):
            return pd.DataFrame({"query_id": [], "document_id": [], "about": []}).astype({"query_id": "int64", "document_id": "int64", "about": "float64"})
        codes = np.frombuffer(b"".join(data.code), np.int8).reshape(len(data), -1).astype(np.float32) * data.scale.to_numpy(np.float32)[:, None]
        center, docs, found = centroids[key[0]][key[1]] if key[0] in centroids else 0.0, data.document_id.to_numpy(), []
        for at in range(0, len(sought), 512):
            part = sought.iloc[at : at + 512]
            q = unit(part._y)
            about = q.astype(np.float32) @ codes.T + (q @ center if key[0] in centroids else np.zeros(len(q)))[:, None]
            most = min(PER_RESULT * k, about.shape[1])
            top = np.argpartition(-about, most - 1, axis=1)[:, :most]
            found.append(pd.DataFrame({"query_id": np.repeat(part.query_id.to_numpy(), most), "document_id": docs[top].ravel(), "about": np.take_along_axis(about, top, 1).ravel().astype(np.float64)}))
        return pd.concat(found, ignore_index=True)

    cell = ["size", "list", "_d", "_q"]
    about = data.groupBy(*cell).cogroup(sought.groupBy(*cell)).applyInPandas(run, "query_id long, document_id long, about double")
    best = about.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("about"), "document_id"))).filter(F.col("_n") <= PER_RESULT * k).select("query_id", "document_id")
    met = best.join(stored.select("document_id", F.col("embedding").alias("_x")), "document_id").join(queries.select("query_id", F.col("embedding").alias("_y")), "query_id")
    scored = met.select("query_id", "document_id", F.round(cosine(F.col("_x"), F.col("_y")), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "document_id"))).filter(F.col("rank") <= k)


def recall(found: DataFrame, true: DataFrame) -> float:
    """The share of the true neighbours (query_id, document_id) that were found."""
    hit = true.join(found.select("query_id", "document_id", F.lit(1).alias("hit")), ["query_id", "document_id"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    return hit.hits / hit.n if hit.n else 1.0


def probes_for(index: Index, true: DataFrame, rows: DataFrame, queries: DataFrame, least_recall: float) -> int:
    """How many lists queries must look into for that share of the true neighbours (query_id, document_id; a bounded sample) to lie in them."""
    met = true.join(rows.select("document_id", "embedding"), "document_id").join(queries.select("query_id", F.col("embedding").alias("_y")), "query_id").select("embedding", "_y").toPandas()
    ranks = []
    for size, of in met.groupby(met.embedding.str.len()) if len(met) else ():
        if size in index.centroids:
            c = index.centroids[size]
            of_row, by_query = (unit(of.embedding) @ c.T).argmax(1), unit(of._y) @ c.T
            ranks += (by_query > by_query[np.arange(len(of)), of_row][:, None]).sum(1).tolist()
    return int(np.quantile(ranks, least_recall, method="higher")) + 1 if ranks else 1


def approximate(rows: DataFrame, queries: DataFrame, k: int, least_recall: float = 0.9, sample: int = 100) -> DataFrame:
    """Builds an index of rows and searches it: query_id, document_id, score, rank, and recall, that of a sample of the
    queries against the exact search. As many lists are probed as hold half a share more of the sample's neighbours than least_recall
    asks for; if codes lose too many of them, twice as many. A query that finds fewer than k is searched exactly."""
    index = build(rows)
    probe = usable(queries).select("query_id", "embedding").orderBy(F.xxhash64("query_id", F.lit(5))).limit(sample)
    true = cut(nearest(rows, probe, k).select("query_id", "document_id"))
    probes, most = probes_for(index, true, rows, probe, (1 + least_recall) / 2), max((len(c) for c in index.centroids.values()), default=1)
    while True:
        found = cut(search(index, rows, queries, k, probes))
        got = recall(found, true)
        if got >= least_recall or probes >= most:
            break
        probes = min(most, 2 * probes)
    full = found.groupBy("query_id").count().filter(F.col("count") >= k).select("query_id")
    rest = queries.join(full, "query_id", "left_anti")
    if not rest.isEmpty():
        found = found.join(full, "query_id", "left_semi").unionByName(nearest(rows, rest, k).select(*found.columns))
    return found.withColumn("recall", F.lit(round(got, 4)))
