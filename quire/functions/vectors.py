"""Vector arithmetic: in expressions for single pairs, and by matrix products of blocks for a query set."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of a block of queries, and of a block of data; one task multiplies one of each.
QUERIES, ROWS = 8192, 20_000
#: Hits that blocks hand on without asking first how alike the kth of all blocks is.
HANDED_ON = 2_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for zero vectors and for those of unlike size."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def nearest(rows: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False, within: str | None = None) -> DataFrame:
    """The k most alike rows of each query by cosine, exactly; with `within`, among rows alike in that column.

    rows: document_id, embedding; queries: query_id, embedding. Returns query_id, document_id, score
    and rank. Data and queries are dealt into blocks by a hash, and each task multiplies a block of
    either: it hands on k rows a query (and what ties with the kth). Where these are too many, blocks are
    multiplied twice: the first time each tells the scores of its 1st, 2nd, 4th, ... and kth row only, which
    gives a score that k rows of all blocks reach (and hardly more than 2 k do); the second time
    rows below that stay behind. So what is ranked at last grows with queries, not with
    blocks or pairs. Nothing passes the driver but two counts.
    """
    group = F.col(within) if within else F.lit(0)
    data = rows.filter("embedding is not null and document_id is not null").select("document_id", F.col("embedding").alias("_x"), group.alias("_group"))
    asked = queries.filter("embedding is not null and query_id is not null").select("query_id", F.col("embedding").alias("_y"), group.alias("_asked"))
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, m = data.count(), asked.count()
    n_asked = max(1, -(-m // QUERIES))
    n_data = max(1, min(-(-spread // n_asked), n // 5000), -(-n // ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = data.withColumn("_d", F.pmod(F.xxhash64("document_id", F.lit(1)), F.lit(n_data)).cast("int")).withColumn("_q", every(n_asked))
    asked = asked.withColumn("_q", F.pmod(F.xxhash64("query_id", F.lit(2)), F.lit(n_asked)).cast("int")).withColumn("_d", every(n_data))
    # Vectors of unlike size are never compared.
    data, asked = data.withColumn("_size", F.size("_x")), asked.withColumn("_size", F.size("_y"))

    depths = sorted({min(1 << i, k) for i in range(k.bit_length() + 1)})

    def scores(data: pd.DataFrame, asked: pd.DataFrame):
        """Parts of asked, with their scores (-2: none) against data."""
        if len(data) and len(asked):
            x, docs = np.stack(data._x.to_list()).astype(np.float64), data.document_id.to_numpy()
            with np.errstate(invalid="ignore", divide="ignore"):
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
            for at in range(0, len(asked), 512):
                part = asked.iloc[at : at + 512]
                q, ids = np.stack(part._y.to_list()).astype(np.float64), part.query_id.to_numpy()
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ x.T
                s[~np.isfinite(s)] = -2
                if exclude_self:
                    s[ids[:, None] == docs[None, :]] = -2
                yield part, ids, docs, s

    def told(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": [], "score": [], "more": []}).astype({"query_id": "int64", "score": "float64", "more": "int64"})]
        for _, ids, _, s in scores(data, asked):
            at = [d for d in depths if d <= s.shape[1]]
            best = -np.partition(-s, [d - 1 for d in at], axis=1)[:, [d - 1 for d in at]]
            rows = pd.DataFrame({"query_id": np.repeat(ids, len(at)), "score": best.ravel(), "more": np.tile(np.diff(at, prepend=0), len(ids))})
            found.append(rows[rows.score > -2])
        return pd.concat(found, ignore_index=True)

    def run(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": [], "document_id": [], "score": []}).astype({"query_id": "int64", "document_id": "int64", "score": "float64"})]
        for part, ids, docs, s in scores(data, asked):
            kth = min(k, s.shape[1])
            border = -np.partition(-s, kth - 1, axis=1)[:, kth - 1 : kth]
            if "_least" in part.columns:
                border = np.fmax(border, part._least.to_numpy(np.float64)[:, None])
            # Scores are compared as rounded, so what comes near the kth is kept with what ties.
            i, j = np.nonzero((s >= border - 1e-6) & (s > -2))
            found.append(pd.DataFrame({"query_id": ids[i], "document_id": docs[j], "score": s[i, j]}))
        return pd.concat(found, ignore_index=True)

    cells = ["_d", "_q", "_size"]
    met = lambda asked: data.groupBy(*cells, "_group").cogroup(asked.groupBy(*cells, "_asked"))
    if n_data > 1 and m * n_data * k > HANDED_ON:
        upto = F.sum("more").over(W.partitionBy("query_id").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0))
        least = met(asked).applyInPandas(told, "query_id long, score double, more long").withColumn("upto", upto).filter(F.col("upto") >= k).groupBy("query_id").agg(F.max("score").alias("_least"))
        asked = asked.join(least, "query_id", "left")
    found = met(asked).applyInPandas(run, "query_id long, document_id long, score double")
    return found.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "document_id"))).filter(F.col("rank") <= k)
