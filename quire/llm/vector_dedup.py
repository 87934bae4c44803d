"""Near-duplicate vectors by range search on a robust-pruned flat graph.

Vectors are compared within a label (and dimension) only. Equal vectors are one node. The nodes of
a label are dealt to overlapping shards: those of their OVERLAP nearest pivots. In each shard a
flat graph is built by inserting nodes in batches of growing size: a greedy search from the medoid
finds candidates, robust pruning keeps the NEAR most alike and others that point in different directions, MAX_DEGREE
in all, and reverse edges are added and pruned likewise. A node's lists from all its shards are united. In
each of its shards, on that shard's part of the united graph, each node is searched for: greedily
from the medoid (and from itself), and where that comes within range, the range is expanded along
edges as long as they lead to nodes in range. Every link is verified by its cosine in double
precision; a pair in several shards counts in the first of them.

Each round's recall is audited: AUDIT nodes of any kind and AUDIT nodes with links are compared with
all vectors. If that of the graphs is below LEAST_RECALL, all pairs within each shard are compared, whose work
is bounded by shards too; if that is not enough, once more with more overlap; labels that are still below it then are
compared exactly, in pairs of blocks.

A shard of more than MAX_SHARD nodes is worked on in pairs of blocks, so no task holds more.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and those
without a label, link with nothing: n_links 0, their own component, kept. Null vec_ids too, with a
null component. Repeated rows are vectors of their own; if they share a vec_id, they count as each
other's links but give one component. Components take the smallest id, so ties cannot occur. Other
columns are not read, whatever their names. An empty table gives no rows.
"""

import logging

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.llm.common import cut, table
from quire.operators.components import components

OVERLAP, SHARD, MAX_SHARD, MAX_PIVOTS, ALL_PIVOTS = 4, 1000, 2048, 4096, 65_536
MAX_DEGREE, NEAR, BEAM, CANDIDATES, ALPHA = 24, 12, 32, 64, 1.2
AUDIT, LEAST_RECALL = 200, 0.999
#: (overlap, whether shards are compared exactly) of each round.
ROUNDS = ((OVERLAP, False), (OVERLAP, True), (4 * OVERLAP, True))


def beam_search(x, graph, queries, starts, width):
    """The width nodes most like each query (rows of x, by number) that a greedy search from starts meets."""
    n, b = len(x), len(queries)
    q, rows = x[queries], np.arange(b)[:, None]
    ids = np.full((b, width), -1)
    sims = np.full((b, width), -np.inf)
    open_ = np.zeros((b, width), bool)
    seen = np.zeros((b, n + 1), bool)
    new = starts
    while True:
        fresh = ~seen[rows, new] & (new >= 0)
        seen[rows, new] = True
        seen[:, n] = False
        for k in range(1, new.shape[1]):  # a node may come twice in one list
            fresh[:, k] &= ~((new[:, :k] == new[:, k : k + 1]) & fresh[:, :k]).any(axis=1)
        got = np.where(fresh, np.einsum("bd,bkd->bk", q, x[np.where(fresh, new, 0)]), -np.inf)
        all_ids, all_sims = np.concatenate([ids, new], 1), np.concatenate([sims, got], 1)
        all_open = np.concatenate([open_, fresh], 1)
        top = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
        ids, sims, open_ = all_ids[rows, top], all_sims[rows, top], all_open[rows, top]
        ids = np.where(np.isfinite(sims), ids, -1)
        open_ &= np.isfinite(sims)
        if not open_.any():
            return ids, sims
        pick = np.argmax(open_, axis=1)
        going = open_[rows[:, 0], pick]
        open_[rows[:, 0], pick] = False
        new = np.where(going[:, None], graph[np.where(going, ids[rows[:, 0], pick], 0)], -1)


def robust_prune(x, nodes, cand, degree):
    """For each node, up to degree of its candidates: the NEAR most alike, and of the others none much nearer to one already
    kept. (Without the first, a node at the border of a tight group keeps one edge into it, and the group falls apart.)"""
    out = np.full((len(nodes), degree), -1)
    for at in range(0, len(nodes), 128):
        p, c = nodes[at : at + 128], cand[at : at + 128]
        rows = np.arange(len(p))[:, None]
        c = np.sort(c, axis=1)
        bad = (c < 0) | (c == p[:, None])
        bad[:, 1:] |= c[:, 1:] == c[:, :-1]
        v = x[np.where(bad, 0, c)]
        far = 1 - np.where(bad, -np.inf, np.einsum("bd,bcd->bc", x[p], v))
        keep = np.argsort(far, axis=1)[:, :CANDIDATES]
        c, far, v = c[rows, keep], far[rows, keep], v[rows, keep]
        between, kept = 1 - v @ v.transpose(0, 2, 1), np.zeros(far.shape, bool)
        for k in range(degree):
            best = np.argmin(far, axis=1)
            ok = np.isfinite(far[rows[:, 0], best])
            if not ok.any():
                break
            out[at : at + 128, k] = np.where(ok, c[rows[:, 0], best], -1)
            far[rows[:, 0], best] = np.inf
            kept[rows[:, 0], best] = ok
            if k == NEAR - 1:
                nearest = np.where(kept[:, :, None], between, np.inf).min(axis=1)
                far[ALPHA * nearest <= far] = np.inf
            elif k >= NEAR:
                far[ALPHA * between[rows[:, 0], best] <= far] = np.inf
    return out


def medoid(x):
    return int(np.argmax(x @ x.mean(axis=0)))


def build_graph(x):
    """A robust-pruned flat graph of the rows of x, as an array of neighbours (-1: none)."""
    n = len(x)
    graph = np.full((n, MAX_DEGREE), -1)
    start = medoid(x)
    order = np.concatenate([[start], np.setdiff1d(np.random.Generator(np.random.PCG64(n)).permutation(n), [start], assume_unique=True)])
    at = 1
    while at < n:
        batch = order[at : at + min(max(at, 16), 512)]
        near, _ = beam_search(x, graph, batch, np.full((len(batch), 1), start), BEAM)
        peers = order[max(0, at - 8) : at + len(batch)]
        alike = np.argsort(-(x[batch] @ x[peers].T), axis=1)[:, : min(8, len(peers))]
        graph[batch] = robust_prune(x, batch, np.concatenate([near, peers[alike]], 1), MAX_DEGREE)
        add_reverse(x, graph, batch)
        at += len(batch)
    return graph


def add_reverse(x, graph, batch):
    to, frm = graph[batch].ravel(), np.repeat(batch, MAX_DEGREE)
    frm, to = frm[to >= 0], to[to >= 0]
    order = np.argsort(to, kind="stable")
    to, frm = to[order], frm[order]
    nodes, first, count = np.unique(to, return_index=True, return_counts=True)
    for at in range(0, len(nodes), 256):
        part = slice(at, at + 256)
        extra = np.full((len(nodes[part]), int(count[part].max())), -1)
        for row, (f, k) in enumerate(zip(first[part], count[part], strict=True)):
            extra[row, :k] = frm[f : f + k]
        graph[nodes[part]] = robust_prune(x, nodes[part], np.concatenate([graph[nodes[part]], extra], 1), MAX_DEGREE)


def in_range(x, graph, least):
    """For each node the others within range that the search meets, as arrays."""
    n, start = len(x), medoid(x)
    for at in range(0, n, 256):
        nodes = np.arange(at, min(at + 256, n))
        met, _ = beam_search(x, graph, nodes, np.stack([nodes, np.full(len(nodes), start)], 1), BEAM)
        for node, ids in zip(nodes, met, strict=True):
            seen = np.zeros(n, bool)
            seen[node] = True
            found, edge = [], ids[ids >= 0]
            edge = edge[edge != node]
            while len(edge):
                seen[edge] = True
                edge = edge[x[edge] @ x[node] >= least]
                found.append(edge)
                near = np.unique(graph[edge])
                near = near[near >= 0]
                edge = near[~seen[near]]
            yield int(node), np.concatenate(found) if found else ids[:0]


def all_in_range(x, least):
    """For each node all others within range, by products of blocks."""
    for at in range(0, len(x), 256):
        for node, hit in enumerate(x[at : at + 256] @ x.T >= least, at):
            hit[node] = False
            yield node, np.flatnonzero(hit)


def unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """Nodes: label, size (dimension), node (least vec_id), copies, vector; one for all equal vectors."""
    v = vectors.select("vec_id", "label", F.transform("embedding", lambda c: c.cast("double")).alias("vector"))
    scale = F.aggregate("vector", F.lit(0.0), lambda a, c: a + c * c)
    good = v.filter("vec_id is not null and label is not null and size(vector) > 0").filter(
        ~F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))).filter(scale > 0)
    return good.withColumns({"size": F.size("vector"), "h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")})


log = logging.getLogger(__name__)

KEY = ["label", "size", "h1", "h2"]


def shard_rows(nodes: DataFrame, overlap: int) -> DataFrame:
    """node, copies, vector, shards (sorted) of each node."""
    sizes = nodes.groupBy("label", "size").agg(F.count("*").alias("n"))
    wanted = sizes.filter(F.col("n") > SHARD).withColumn("k", F.least(F.lit(MAX_PIVOTS), F.ceil(F.col("n") * overlap / SHARD)).cast("int"))
    total = wanted.agg(F.sum("k")).first()[0] or 0
    thin = min(1.0, ALL_PIVOTS / max(1, total))  # the bound on what tasks are sent
    few = W.partitionBy("label", "size").orderBy(F.xxhash64("node", F.lit(2)), "node")
    ranked = nodes.withColumn("_rank", F.row_number().over(few)).filter(F.col("_rank") <= MAX_PIVOTS)
    pivots: dict = {}
    for r in ranked.join(wanted, ["label", "size"]).filter(F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("k") * thin))).select("label", "size", "_rank", "vector").toLocalIterator():
        pivots.setdefault((r.label, r.size), []).append((r._rank, r.vector))
    pivots = {k: unit([v for _, v in sorted(vs, key=lambda p: p[0])]).astype(np.float32) for k, vs in pivots.items()}

    def run(batches):
        for batch in batches:
            labels, dims, vectors = batch.column("label").to_pylist(), batch.column("size").to_pylist(), batch.column("vector").to_pylist()
            places: list = [[0]] * len(labels)
            groups: dict = {}
            for i, key in enumerate(zip(labels, dims, strict=True)):
                if key in pivots:
                    groups.setdefault(key, []).append(i)
            for key, rows in groups.items():
                for at in range(0, len(rows), 1024):
                    part = rows[at : at + 1024]
                    near = np.argsort(-(unit([vectors[i] for i in part]).astype(np.float32) @ pivots[key].T), axis=1, kind="stable")[:, :overlap]
                    for i, found in zip(part, near.tolist(), strict=True):
                        places[i] = sorted(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.list_(pa.int32()))], names=[*batch.schema.names, "places"])

    kind = nodes.schema["label"].dataType.simpleString()
    placed = nodes.select("label", "size", "node", "copies", "vector").mapInArrow(run, f"label {kind}, size int, node long, copies long, vector array<double>, places array<int>")
    return placed.select("node", "copies", "vector", F.transform("places", lambda p: F.xxhash64("label", "size", p)).alias("shards"))


def in_tasks(rows: DataFrame) -> DataFrame:
    """One row per node and task: task, shard, and the two blocks whose pairs the task counts."""
    each = rows.withColumn("shard", F.explode("shards"))
    counts = rows.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.ceil(F.count("*") * 2 / MAX_SHARD).cast("int").alias("_blocks"))
    each = each.join(counts, "shard").withColumn("_blocks", F.when(F.col("_blocks") <= 2, 1).otherwise(F.col("_blocks")))
    each = each.withColumn("block", F.pmod(F.xxhash64("node", "shard"), F.col("_blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return each.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).withColumn("task", F.xxhash64("shard", "low", "high")).drop("_blocks", "other")


def build(task_rows: DataFrame) -> DataFrame:
    """node, near: the union of the node's adjacency lists in all its tasks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        nodes = pdf.node.to_numpy()
        graph = build_graph(unit(pdf.vector)) if len(pdf) > 1 else np.full((1, 1), -1)
        return pd.DataFrame({"node": nodes, "near": [nodes[g[g >= 0]].tolist() for g in graph]})

    lists = task_rows.select("task", "node", "vector").groupBy("task").applyInPandas(run, "node long, near array<long>")
    return lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def search(task_rows: DataFrame, least: float, exact: bool = False) -> DataFrame:
    """task_rows with near. Per node and task: n (vectors linked, that this task counts) and root, a linked node.

    exact: compare all of a task's nodes instead of searching its graph."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        nodes, copies, x = pdf.node.to_numpy(), pdf.copies.to_numpy(), unit(pdf.vector)
        at = {v: i for i, v in enumerate(nodes.tolist())}
        lists = [[at[v] for v in near if v in at] for near in pdf.near]
        graph = np.full((len(x), max(1, max(map(len, lists)))), -1)
        for i, near in enumerate(lists):
            graph[i, : len(near)] = near
        shards = np.stack([np.asarray(s) for s in pdf.shards])
        shard, low, high, block = pdf.shard[0], pdf.low[0], pdf.high[0], pdf.block.to_numpy()
        own = np.argmax(shards == shard, axis=1)
        counts, pairs = np.zeros(len(x), np.int64), []
        for i, js in all_in_range(x, least) if exact else in_range(x, graph, least):
            js = js[(np.minimum(block[js], block[i]) == low) & (np.maximum(block[js], block[i]) == high)]
            if own[i] and len(js):  # the pair counts in the first shard that both are in
                js = js[~np.isin(shards[js], shards[i, : own[i]]).any(axis=1)]
            pairs.append((np.full(len(js), i), js))
        if not pairs:
            return pd.DataFrame({"node": nodes[:0], "n": counts[:0], "root": nodes[:0]})
        i, j = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        both = np.unique(np.concatenate([i * len(x) + j, j * len(x) + i]))  # a link found from either end
        i, j = both // len(x), both % len(x)
        np.add.at(counts, i, copies[j])
        root = np.arange(len(x))
        while True:  # least node of each component
            less = root.copy()
            np.minimum.at(less, i, root[j])
            less = less[less]
            if (less == root).all():
                break
            root = less
        out = pd.DataFrame({"node": nodes, "n": counts, "root": nodes[root]})
        return out[out.n > 0]

    return task_rows.select("task", "shard", "low", "high", "block", "node", "copies", "vector", "shards", "near").groupBy("task").applyInPandas(run, "node long, n long, root long")


def audit(nodes: DataFrame, found: DataFrame, least: float) -> list[tuple]:
    """(label, size, true, got): the links of a sample of nodes, against all nodes, and those of them that were found.

    The sample, by a hash, is AUDIT nodes of any kind and AUDIT nodes for which links were found."""
    got = found.groupBy("node").agg(F.sum("n").alias("n"))
    drawn = nodes.select("label", "size", "node", "vector").orderBy(F.xxhash64("node", F.lit(4)), "node")
    sample = {(r.label, r.size, r.node): r for r in drawn.limit(AUDIT).collect() + drawn.join(got.filter("n > 0"), "node", "left_semi").select(
        "label", "size", "node", "vector").orderBy(F.xxhash64("node", F.lit(5)), "node").limit(AUDIT).collect()}.values()
    by_key: dict = {}
    for r in sample:
        by_key.setdefault((r.label, r.size), []).append((r.node, r.vector))
    known = {k: (np.array([n for n, _ in v]), unit([x for _, x in v])) for k, v in by_key.items()}

    def run(batches):
        for batch in batches:
            total: dict[tuple, int] = {}
            labels, dims, ids, copies, vectors = (batch.column(c).to_pylist() for c in ("label", "size", "node", "copies", "vector"))
            groups: dict = {}
            for i, key in enumerate(zip(labels, dims, strict=True)):
                if key in known:
                    groups.setdefault(key, []).append(i)
            for key, rows in groups.items():
                nodes, x = known[key]
                for at in range(0, len(rows), 1024):
                    part = rows[at : at + 1024]
                    hit = unit([vectors[i] for i in part]) @ x.T >= least
                    hit &= np.array([ids[i] for i in part])[:, None] != nodes
                    for node, n in zip(nodes.tolist(), (hit * np.array([copies[i] for i in part])[:, None]).sum(axis=0).tolist(), strict=True):
                        total[*key, node] = total.get((*key, node), 0) + n
            label = pa.array([k[0] for k in total], batch.schema.field("label").type)
            yield pa.RecordBatch.from_arrays([label, pa.array([k[1] for k in total], pa.int32()), pa.array([k[2] for k in total], pa.int64()), pa.array(list(total.values()), pa.int64())], names=["label", "size", "node", "true"])

    kind = nodes.schema["label"].dataType.simpleString()
    true = nodes.select("label", "size", "node", "copies", "vector").mapInArrow(run, f"label {kind}, size int, node long, true long")
    true = true.groupBy("label", "size", "node").agg(F.sum("true").alias("true"))
    each = true.join(got, "node", "left").groupBy("label", "size").agg(F.sum("true").alias("true"), F.sum(F.least("true", F.coalesce("n", F.lit(0)))).alias("got"))
    return [tuple(r) for r in each.collect()]  # 2 * AUDIT rows at most


def compare_all(nodes: DataFrame, least: float) -> DataFrame:
    """What search returns, with each label as one shard and its pairs of blocks compared exactly."""
    whole = nodes.select("node", "copies", "vector", F.array(F.xxhash64("label", "size")).alias("shards"))
    return search(in_tasks(whole).withColumn("near", F.array().cast("array<long>")), least, exact=True)


def near_duplicates(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vectors: vec_id, embedding, label. Per row: vec_id, n_links, component_id, kept."""
    good = usable(vectors)
    nodes = cut(good.groupBy(*KEY).agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector")))
    for overlap, exact in ROUNDS:
        tasks = cut(in_tasks(shard_rows(nodes, overlap)))
        found = cut(search(tasks.withColumn("near", F.array().cast("array<long>")) if exact else tasks.join(build(tasks), "node"), least, exact))
        audited = audit(nodes, found, least)
        recall = sum(got for *_, got in audited) / max(1, sum(true for *_, true, _ in audited)) if any(true for *_, true, _ in audited) else 1.0
        log.info("overlap %d%s: recall %.4f of %d links", overlap, ", shards compared exactly" if exact else "", recall, sum(true for *_, true, _ in audited))
        if recall >= LEAST_RECALL:
            break
    else:
        low = F.lit(False)
        for label, size, true, got in audited:
            if got < LEAST_RECALL * true:
                low = low | ((F.col("label") == F.lit(label)) & (F.col("size") == size))
        again = nodes.filter(low)
        found = cut(found.join(again.select("node"), "node", "left_anti").select(*found.columns).union(compare_all(again, least)))
    links = found.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    joined = components(links)
    per_node = found.groupBy("node").agg(F.sum("n").alias("n"))
    classes = nodes.select(*KEY, "node", "copies").join(per_node, "node", "left").join(joined, "node", "left")
    classes = classes.select(*KEY, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("_of"))
    linked = good.select("vec_id", *KEY).join(classes, KEY).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("_of").alias("_of"))
    return vectors.select("vec_id").join(linked, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_of", "vec_id").cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("_of", "vec_id"), F.lit(True)).alias("kept"))


def op9_vector_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def oracle() -> str:
    return """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
good as (select vec_id, label, e from v where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
    and list_sum(list_transform(e, lambda x: x * x)) > 0),
links as materialized (select a.vec_id as u, b.vec_id as w from good a join good b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
    where list_cosine_similarity(a.e, b.e) >= 0.93),
reach(u, w) as (select u, w from links union select r.u, l.w from reach r join links l on r.w = l.u),
n as (select u, count(*) as n from links group by u), m as (select u, min(w) as m from reach group by u)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, least(v.vec_id, coalesce(m.m, v.vec_id)) as component_id, v.vec_id = least(v.vec_id, coalesce(m.m, v.vec_id)) as kept
from v left join n on n.u = v.vec_id left join m on m.u = v.vec_id"""
