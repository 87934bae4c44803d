"""Near-duplicate documents by an LSH forest over MinHash signatures.

Equal shingle sets are joined into classes first, so copies cost one aggregate. Each class has a
signature of N_HASHES values. Each tree sorts the classes by the signature's values
from another one on, so what shares a prefix there stands together. A region of a tree is a run of
its order with one common prefix: of DEPTHS[0] values where at most MAX_REGION classes share that,
and else of as many more as it takes (the depth adapts by region). All in a region are neighbours by
longest common prefix, nearest first, and are candidates of one another. Where more than
MAX_REGION classes still share DEPTHS[-1] values (they are nearly the same then), the order goes on
by a hash, another one in each tree, and is cut into runs of that size. As deep regions and runs
lose pairs of moderate similarity, there is a second pass over the crowded
regions: of each region of DEPTHS[0] values, the classes that are not in its main component yet are
compared with all of it, in parts. Where too many are apart for that, the depth adapts again, and what is
apart then is compared with the whole region of DEPTHS[0] values in a third pass: classes are dealt into
blocks, and each block of those apart meets every other block in a task of its own. So in the end all classes that share
DEPTHS[0] values in a tree were compared, or are joined already.

A candidate pair is compared by sketches (a byte of each hash), in the first region only that the
two share. Pairs whose sketches agree well enough are confirmed on full sets, best first; those that
confirmed links of the task join already need no confirmation. So a task gives at most one link per
class and no rows per pair, however large the group. The third pass is quadratic in the classes of a region that stay apart
(copies of one text are one class, and those that links join don't count).

Edge cases: null or empty texts have no set, are linked with nothing and are kept. Rows of a null
doc_id are linked with nothing, have a null component and are kept. Very long texts are shingled
whole, by segments. Repeated rows share a class. One doc_id with several texts: each row is in its
own text's class. Similarity of exactly percent % is a link (a tie counts). An empty table gives no
rows. Columns with names used here pass through deduplicate() unharmed.
"""

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.llm.common import cut, passing, table
from quire.operators.components import components
from quire.llm.shingles import Shingler, Signer, fingerprint, jaccard_counts

N_HASHES, DEPTHS, MAX_REGION = 96, (3, 4, 5, 6, 8, 11, 15, 20), 2048
#: The values of the signature that the trees begin with.
TREES = tuple(range(0, N_HASHES, 8))
#: Sketches may fall short of the similarity asked for by so many standard deviations.
DEVIATIONS = 4.0
#: Bytes of sets that a task keeps of one region; the others are made again when needed.
KEEP_BYTES = 32 << 20

SIGNED = "doc_id long, content long, n_shingles long, f1 long, f2 long, signature binary, sketch binary"


def sign(docs: DataFrame) -> DataFrame:
    """Signatures and set fingerprints of doc_id, text."""

    def run(batches):
        shingler, signer = Shingler(), Signer(N_HASHES)
        for batch in batches:
            ids, contents, texts = batch.columns
            for at in range(0, len(texts), 512):
                sets = [shingler.set_of(t.as_buffer().to_pybytes() if t.is_valid else None) for t in texts.slice(at, 512)]
                full = [i for i, s in enumerate(sets) if len(s)]
                signed = signer.sign([sets[i] for i in full]) if full else np.empty((0, N_HASHES), np.uint32)
                prints = [(0, 0)] * len(sets)
                signatures, sketches = [None] * len(sets), [None] * len(sets)
                low = (signed & np.uint32(255)).astype(np.uint8)
                for row, i in enumerate(full):
                    prints[i] = fingerprint(sets[i])
                    signatures[i], sketches[i] = signed[row].tobytes(), low[row].tobytes()
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, 512).cast(pa.int64()), contents.slice(at, 512), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()),
                    pa.array(signatures, pa.binary()), pa.array(sketches, pa.binary())],
                    names=["doc_id", "content", "n_shingles", "f1", "f2", "signature", "sketch"])

    return docs.select("doc_id", F.xxhash64("text").alias("content"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SIGNED)


def key(start, depth: int):
    """The first values of a tree's order; they go round the end of the signature."""
    return F.call_function("substring", F.concat("signature", "signature"), start * 4 + 1, F.lit(4 * depth))


def prefix(start, depth: int):
    return F.xxhash64(start, F.lit(depth), key(start, depth))


def start_of(tree):
    return F.element_at(F.array(*[F.lit(t) for t in TREES]), tree + 1)


def at_first_depth(classes: DataFrame) -> DataFrame:
    return classes.select("rep", F.posexplode(F.array(*[prefix(F.lit(t), DEPTHS[0]) for t in TREES])).alias("tree", "region"))


def deeper(rows: DataFrame, signatures: DataFrame, depth: int) -> DataFrame:
    return cut(rows.join(signatures, "rep").select("rep", "tree", prefix(start_of(F.col("tree")), depth).alias("region")))


def cut_by_hash(rows: DataFrame, counts: DataFrame, max_region: int) -> DataFrame:
    """Regions that no depth splits, as runs of a hash that is another one in each tree."""
    run = F.pmod(F.xxhash64("rep", "region"), F.ceil(F.col("count") * 2 / max_region))
    return rows.join(counts, "region").select("rep", "tree", F.xxhash64("region", run).alias("region"))


def in_regions(classes: DataFrame, max_region: int) -> tuple[DataFrame, DataFrame | None]:
    """classes: rep, signature and others. One row per class and tree with its region, and regions, those of all trees
    in their order; and the rows (rep, tree, region) of regions that were crowded at first, if any."""

    def crowded(rows):
        return cut(rows.groupBy("region").count().filter(F.col("count") > max_region))

    rows = at_first_depth(classes)
    large = crowded(rows)
    if large.isEmpty():
        return classes.withColumn("regions", F.array(*[prefix(F.lit(t), DEPTHS[0]) for t in TREES])).select("*", F.posexplode("regions").alias("tree", "region")), None
    settled, signatures = rows.join(large, "region", "left_anti"), classes.select("rep", "signature")
    pending = cut(rows.join(large, "region", "left_semi"))
    among_many = pending
    for depth in DEPTHS[1:]:
        rows = deeper(pending, signatures, depth)
        large = crowded(rows)
        settled, pending = settled.unionByName(rows.join(large, "region", "left_anti").select("rep", "tree", "region")), rows.join(large, "region", "left_semi")
        if large.isEmpty():
            break
    else:
        settled = settled.unionByName(cut_by_hash(pending, large, max_region))
    listed = settled.groupBy("rep").agg(F.transform(F.sort_array(F.collect_list(F.struct("tree", "region"))), lambda x: x.region).alias("regions"))  # one of each tree
    return classes.join(cut(listed), "rep").select("*", F.posexplode("regions").alias("tree", "region")), among_many


def mixed_regions(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """Regions that aren't of one component: the main one, its classes (most) and those of the region (count)."""
    held = rows.join(classes.select("rep", "of"), "rep").groupBy("region", "of").agg(F.count("*").alias("n"))
    return cut(held.groupBy("region").agg(F.max_by("of", F.struct("n", "of")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("count")).filter("most < count"))


def apart_in_regions(classes: DataFrame, rows: DataFrame, max_region: int) -> tuple[DataFrame, DataFrame | None]:
    """As in_regions, for the second pass over rows of crowded regions: of is what a class is joined with so far. In a region that
    isn't of one component, the classes outside its main one (at most max_region / 2) are with each part of the main one.
    Also the rows of regions in which more are apart, which are left to the third pass."""
    signatures, settled, left = classes.select("rep", "signature"), [], None
    for number in range(len(DEPTHS)):
        mixed = mixed_regions(classes, rows)
        few = F.col("count") - F.col("most") <= max_region // 2
        parts = F.ceil(F.col("most") * 2 / max_region).cast("int")
        placed = rows.join(mixed.filter(few), "region").join(classes.select("rep", "of"), "rep")
        part = F.explode(F.when(F.col("of") == F.col("main"), F.array(F.pmod(F.xxhash64("rep", "region"), parts).cast("int"))).otherwise(F.sequence(F.lit(0), parts - 1)))
        settled.append(placed.select("rep", "tree", "region", part.alias("part")).select("rep", "tree", F.xxhash64("region", "part").alias("region")))
        large = mixed.filter(~few)
        if large.isEmpty():
            break
        rows = rows.join(large, "region", "left_semi")
        if left is None:
            left = rows = cut(rows)
        if number + 1 == len(DEPTHS):
            settled.append(cut_by_hash(rows, large, max_region))
        else:
            rows = deeper(rows, signatures, DEPTHS[number + 1])
    return functools.reduce(DataFrame.unionByName, settled).join(classes, "rep").withColumn("regions", F.expr("cast(array() as array<long>)")), left


def apart_in_blocks(classes: DataFrame, rows: DataFrame, mixed: DataFrame, max_region: int) -> DataFrame:
    """As apart_in_regions, for the third pass, whatever number is apart: each block of those outside the main component with each other block of
    the region, so with all of it. Two blocks hold about max_region / 2 classes."""
    apart, parts = (F.ceil(F.col(n) * 4 / max_region).cast("int") for n in ("outside", "most"))
    placed = rows.join(mixed.withColumn("outside", F.col("count") - F.col("most")), "region").join(classes.select("rep", "of"), "rep")
    among, inside = F.xxhash64("rep", "region"), F.col("of") == F.col("main")
    placed = placed.withColumn("block", F.when(inside, apart + F.pmod(among, parts)).otherwise(F.pmod(among, apart)).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, apart).otherwise(apart + parts) - 1))).filter("block <> other")
    unit = F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other"))
    return placed.select("rep", "tree", unit.alias("region")).join(classes, "rep").withColumn("regions", F.expr("cast(array() as array<long>)"))


def runs(batches, columns):
    """Runs of rows with one region, from batches sorted by it."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch]).select(columns)
        rest = t if rest is None else pa.concat_tables([rest, t])
        task = rest.column("region").to_numpy()
        if len(task) == 0:
            continue
        starts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
        for at, end in zip(starts[:-1], starts[1:], strict=True):
            if end - at > 1:
                yield rest.slice(at, end - at)
        rest = rest.slice(starts[-1]).combine_chunks()
    if rest is not None and len(rest) > 1:
        yield rest


def close_pairs(run, least: int):
    """Pairs of a region, in its tree's order and the nearest first, that aren't joined yet, whose sketches agree in
    at least so many places, and that share no earlier region: arrays i, j and places, by distance in the order."""
    sketch = np.frombuffer(b"".join(run.column("sketch").to_pylist()), np.uint8).reshape(len(run), -1)
    tree = run.column("tree")[0].as_py()
    of = run.column("of").to_numpy()
    earlier = np.array(run.column("regions").to_pylist(), np.int64).reshape(len(run), -1)[:, :tree]
    for apart in range(1, len(run)):
        agree = np.count_nonzero(sketch[apart:] == sketch[:-apart], axis=1)
        i = np.flatnonzero((agree >= least) & (of[apart:] != of[:-apart]))
        if earlier.size and len(i):
            i = i[~(earlier[i] == earlier[i + apart]).any(axis=1)]
        if len(i):
            yield i, i + apart, agree[i]


def links_of(docs: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Confirmed links u, v between classes with another `of` that connect all that are percent % alike or more and
    are placed in a region together."""
    p = percent / 100
    least = int(N_HASHES * (p - DEVIATIONS * (p * (1 - p) / N_HASHES) ** 0.5))
    names = ["region", "tree", "rep", "of", "f1", "f2", "sketch", "regions"]
    # Of a class's regions only those of earlier trees are asked for.
    placed = placed.withColumn("regions", F.slice("regions", F.lit(1), F.col("tree"))).select(*names, key(start_of(F.col("tree")), DEPTHS[-1]).alias("key"))
    fields = "region long, tree int, rep long, of long, f1 long, f2 long, sketch binary, regions array<long>, key binary"

    def wanted(batches):
        for run in runs(batches, [*names, "key"]):
            used = np.zeros(len(run), bool)
            for i, j, _ in close_pairs(run, least):
                used[i] = used[j] = True
            if used.any():
                yield from run.filter(pa.array(used)).to_batches()

    needs = placed.repartition("region").sortWithinPartitions("region", "key", "rep").mapInArrow(wanted, fields)
    texts = docs.select(F.col("doc_id").alias("rep"), F.col("text").cast("binary").alias("text"))

    def confirm(batches):
        shingler = Shingler()
        for run in runs(batches, [*names, "text"]):
            texts, sets, kept = run.column("text"), {}, 0
            f1, f2, reps = run.column("f1").to_pylist(), run.column("f2").to_pylist(), run.column("rep").to_pylist()
            right: dict[int, bool] = {}

            def get(i, texts=texts, sets=sets, f1=f1, f2=f2, right=right):
                nonlocal kept
                if i not in sets:
                    s = shingler.set_of(texts[i].as_buffer().to_pybytes())
                    right[i] = fingerprint(s) == (f1[i], f2[i])  # a doc_id may have other texts
                    if kept + s.nbytes > KEEP_BYTES:
                        return s
                    sets[i], kept = s, kept + s.nbytes
                return sets[i]

            root = list(range(len(run)))

            def find(i, root=root):
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            got = list(close_pairs(run, least))
            if not got:
                continue
            first, second, level = (np.concatenate([x[k].astype(np.int32) for x in got]) for k in range(3))
            del got
            u, v = [], []
            for agree in np.unique(level)[::-1]:  # the most alike first
                at = np.flatnonzero(level == agree)
                for i, j in zip(first[at].tolist(), second[at].tolist(), strict=True):
                    a, b = find(i), find(j)
                    if a == b:
                        continue
                    both, either = jaccard_counts(get(i), get(j))
                    if right[i] and right[j] and 100 * both >= percent * either:
                        root[max(a, b)] = min(a, b)
                        u.append(reps[i])
                        v.append(reps[j])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    joined = needs.join(texts, "rep").select(*names, "key", "text")
    return joined.repartition("region").sortWithinPartitions("region", "key", "rep").mapInArrow(confirm, "u long, v long")


def near_duplicates(docs: DataFrame, percent: int = 80, max_region: int = MAX_REGION) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept, and content (the text's hash).

    Linked are documents that share at least percent % of the union of their shingle sets;
    component_id is the smallest doc_id reachable by links.
    """
    signed = cut(sign(docs))
    same = ["n_shingles", "f1", "f2"]
    with_set = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = cut(with_set.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature"), F.min("sketch").alias("sketch")))
    placed, many = in_regions(classes.withColumn("of", F.col("rep")), max_region)
    links = cut(links_of(docs, placed, percent))
    found = components(links)

    def joined(rows):
        return cut(classes.join(rows, "rep", "left_semi").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("of", F.coalesce("component", "rep")).drop("component"))

    if many is not None:
        placed, many = apart_in_regions(joined(many), many, max_region)
        links = links.union(cut(links_of(docs, placed, percent)))
        found = components(links)
    if many is not None:
        among = joined(many)
        mixed = mixed_regions(among, many)
        if not mixed.isEmpty():
            found = components(links.union(cut(links_of(docs, apart_in_blocks(among, many, mixed, max_region), percent))))
    linked = classes.select(*same, "rep").join(found, F.col("node") == F.col("rep"), "left").select(*same, F.coalesce("component", "rep").alias("_of"))
    return signed.select("doc_id", "content", *same).join(linked, same, "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("_of", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("_of", "doc_id"), F.lit(True)).alias("kept"), "content")


def deduplicate(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs without all but one document of each group; of repeated rows one stays."""
    rows, back = passing(docs, ["doc_id", "text"])
    kept = near_duplicates(rows, percent).filter("kept and doc_id is not null").select("doc_id", F.col("content").alias("_content")).distinct()
    marked = rows.withColumn("_content", F.xxhash64("text")).filter("doc_id is not null")
    stay = marked.join(kept, ["doc_id", "_content"], "left_semi")
    stay = stay.withColumn("_row", F.row_number().over(W.partitionBy("doc_id", "_content").orderBy(F.lit(0)))).filter("_row = 1")
    return back(stay.select(*rows.columns).unionByName(rows.filter("doc_id is null")))


def op3_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), 85).select("doc_id", "n_shingles", "component_id", "kept")


def oracle() -> str:
    return r"""
with recursive words as materialized (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
sets as materialized (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from words),
hashes as materialized (select doc_id, len(s) as n, unnest(list_transform(s, lambda x: hash(x))) as h from sets),
links as materialized (select a.doc_id as u, b.doc_id as v from hashes a join hashes b on a.h = b.h and a.doc_id <> b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(u, v) as (select distinct u, v from links union select r.u, l.v from reach r join links l on r.v = l.u),
smallest as (select u, min(v) as m from reach group by u)
select s.doc_id, len(s.s)::bigint as n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) as component_id, s.doc_id = least(s.doc_id, coalesce(m, s.doc_id)) as kept
from sets s left join smallest on u = s.doc_id"""
