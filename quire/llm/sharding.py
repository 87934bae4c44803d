"""Sharding: balanced label propagation over links between equal texts. [native]

Documents of one text are linked. A group larger than a shard (fewer than n_shards are) is laid
out first: in ranges of its ids' hash it fills whole shards, and the rest of it joins one shard where
that has room for it. Every other document starts in the shard of its id's hash, dealt in proportion
to the room left; beside large groups, those up to 1/SMALL of a shard start in that of the group's
hash, as full shards leave little room to gather. In each round, joins and aggregates find for every linked group the shard that holds most of it, and its
other members ask to move there. A shard admits what it has room for, with what leaves it in
return: the requests are thinned by a hash to that share, so nothing is ranked on one machine. The work of a
round is on (group, first shard) pieces, at most n_shards of them a group however large it is.
At last, documents in excess of a shard's exact quota (unlinked ones first) fill the gaps of
others. The law is `rows`: counts are at most one apart.

Edge cases: null texts are one group, of size 1 each and checksum 0; empty texts are another. Texts of
any length count whole. Null or repeated doc_ids are documents of their own; of rows equal in doc_id
and text, which of them comes first is open, and their results are alike. Other columns are not
read, whatever their names. An empty table gives no rows.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.llm.common import cut, table

N_SHARDS, ROUNDS = 16, 4
#: Documents of a shard are numbered within buckets: GROUP_BUCKETS for linked ones and two more, each dealt by
#: a hash over as many as keep about BUCKET_ROWS rows in one, if all were in the same (SUB_BUCKETS at least).
GROUP_BUCKETS, SUB_BUCKETS, BUCKET_ROWS = 64, 64, 20_000
#: A group larger than a shard is laid out in so many parts.
PARTS = 1024
SMALL = 64


def admitted(load: dict[int, int], asked: dict[tuple[int, int], int], quota: int) -> dict[int, float]:
    """The share of the requests (from, to) that each shard can admit, with what leaves it in return."""
    share = dict.fromkeys(load, 1.0)
    for _ in range(30):  # what leaves shrinks as others admit less, so shares only fall
        for to in share:
            wanted = sum(n for (_, t), n in asked.items() if t == to)
            leaves = sum(n * share[t] for (s, t), n in asked.items() if s == to)
            if wanted:
                share[to] = min(share[to], max(0.0, quota - load[to] + leaves) / wanted)
    return share


def lay_out(groups: list[list[int]], quota: list[int]) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """groups: the documents in each part of each. The (end part, shard) ranges of each group, and the room left."""
    free, ranges = list(quota), [[] for _ in groups]
    for g in sorted(range(len(groups)), key=lambda g: -sum(groups[g])):
        at, left = 0, sum(groups[g])
        while left:
            fits = [s for s, room in enumerate(free) if room >= left]
            to = min(fits, key=lambda s: free[s]) if fits else max(range(len(free)), key=lambda s: free[s])
            first = at
            # A part that fits nowhere goes where most room is; what is too much there moves at last.
            while at < len(groups[g]) and (at == first or groups[g][at] <= free[to]):
                free[to] -= groups[g][at]
                left -= groups[g][at]
                at += 1
            ranges[g].append((at, to))
    return ranges, free


def dealt(hashed, room: list[int]):
    """A shard drawn by a hash in proportion to room; null if there is none."""
    draw, start, below = F.pmod(hashed, F.lit(max(1, sum(room)))), F.lit(None).cast("int"), sum(room)
    for s in reversed(range(len(room))):
        start = F.when(draw < below, s).otherwise(start)
        below -= room[s]
    return start


def place_large(rows: DataFrame, large: list, quota: list[int]) -> tuple[DataFrame, list[int]]:
    """Adds home to the rows of large groups, deals the others anew by the room left, and returns that room."""
    which, part = F.lit(None).cast("int"), F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(PARTS)).cast("int")
    for g, r in enumerate(large):
        same = F.lit(True)
        for name, value in r["group"].asDict().items():
            same = same & F.col("group")[name].eqNullSafe(F.lit(value))
        which = F.when(same, g).otherwise(which)
    rows = rows.withColumns({"_which": which, "_part": part})
    groups = [[0] * PARTS for _ in large]
    for r in rows.filter("_which is not null").groupBy("_which", "_part").agg(F.count("*").alias("n")).collect():  # n_shards * PARTS rows at most
        groups[r._which][r._part] = r.n
    ranges, free = lay_out(groups, quota)
    home = F.lit(None).cast("int")
    for g, of in enumerate(ranges):
        for end, to in reversed(of):
            home = F.when((F.col("_which") == g) & (F.col("_part") < end), to).otherwise(home)
    start = dealt(F.xxhash64("doc_id", F.lit(5)), [max(0, n) for n in free])
    return rows.withColumn("home", home).withColumn("piece", F.coalesce("home", start, "piece")).drop("_which", "_part"), free


def propagate(pieces: DataFrame, quota: int, n_shards: int, rounds: int, taken: list[int]) -> DataFrame:
    """pieces: group, piece, n documents, shard (the first); taken: what else is in the shards. Renews shard in the rounds."""
    state = cut(pieces)
    for number in range(rounds):
        held = state.groupBy("group", "shard").agg(F.sum("n").alias("n"))
        wanted = held.groupBy("group").agg(F.max_by("shard", F.struct("n", F.pmod(F.xxhash64("group", "shard"), F.lit(1 << 30)))).alias("wanted"))
        asked = cut(state.join(wanted, "group"))
        flows = asked.groupBy("shard", "wanted").agg(F.sum("n").alias("n"))
        load, moves = dict(enumerate(taken)), {}
        for r in flows.collect():  # n_shards * n_shards rows at most
            load[r.shard] += r.n
            if r.shard != r.wanted:
                moves[r.shard, r.wanted] = r.n
        if not moves:
            break
        share = F.lit(0.0)
        for to, x in admitted(load, moves, quota).items():
            share = F.when(F.col("wanted") == to, x).otherwise(share)
        drawn = F.pmod(F.xxhash64("group", F.lit(number)), F.lit(1 << 30)) / (1 << 30)
        state = cut(asked.select("group", "piece", "n", F.when(drawn < share, F.col("wanted")).otherwise(F.col("shard")).alias("shard")))
    return state


def assign(docs: DataFrame, n_shards: int = N_SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """docs: doc_id, size, text_crc32, group. One row per document, with shard and slot."""
    rows = cut(docs.withColumn("piece", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(n_shards)).cast("int")))
    pieces = rows.groupBy("group", "piece").agg(F.count("*").alias("n"))
    linked = pieces.groupBy("group").agg(F.sum("n").alias("of")).filter("of > 1")
    total = rows.count()
    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    start, large, taken = F.col("piece"), linked.filter(F.col("of") > quota[0]).collect(), [0] * n_shards  # large: fewer than n_shards
    if large:
        rows, free = place_large(rows, large, quota)
        rows, taken = cut(rows), [most - left for most, left in zip(quota, free, strict=True)]
        start = F.when(F.col("of") * SMALL <= quota[0], dealt(F.xxhash64("group", F.lit(11)), [max(0, n) for n in free])).otherwise(start)
        pieces = rows.filter("home is null").groupBy("group", "piece").agg(F.count("*").alias("n"))
    else:
        rows = rows.withColumn("home", F.lit(None).cast("int"))
    first = pieces.join(linked.filter(F.col("of") <= quota[0]), "group").select("group", "piece", "n", start.alias("shard"))
    moved = propagate(first, quota[0], n_shards, rounds, taken).select("group", "piece", "shard")
    deals = max(SUB_BUCKETS, -(-total // (n_shards * BUCKET_ROWS)))
    labelled = cut(rows.join(moved, ["group", "piece"], "left").select(
        "doc_id", "size", "text_crc32",
        F.coalesce("home", "shard", "piece").alias("shard"),
        F.xxhash64("doc_id", "group", F.lit(7)).alias("draw"),
        # What comes last goes first where a shard is too full: unlinked documents, then those of groups in several shards anyway.
        F.when(F.col("home").isNotNull(), GROUP_BUCKETS).when(F.col("shard").isNull(), GROUP_BUCKETS + 1).otherwise(F.pmod(F.xxhash64("group"), F.lit(GROUP_BUCKETS))).alias("kind"),
    ).withColumn("bucket", F.col("kind").cast("long") * deals + F.pmod("draw", F.lit(deals))))
    sizes = labelled.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("shard", "bucket", (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    held = dict.fromkeys(range(n_shards), 0)
    held |= {r.shard: r.n for r in sizes.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # n_shards rows
    rank = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("draw", "doc_id", "text_crc32", "size"))
    ranked = labelled.withColumn("rank", rank).join(before, ["shard", "bucket"]).withColumn("rank", F.col("rank") + F.col("before") - 1)
    return balance(ranked, quota, held)


def balance(ranked: DataFrame, quota: list[int], held: dict[int, int]) -> DataFrame:
    """Move the documents whose rank exceeds their shard's quota into the gaps of the others."""
    spare, first_spare = F.lit(None).cast("long"), 0
    for s, most in enumerate(quota):
        spare = F.when((F.col("shard") == s) & (F.col("rank") >= most), F.col("rank") - most + first_spare).otherwise(spare)
        first_spare += max(0, held[s] - most)
    shard, slot, first_gap = F.col("shard"), F.col("rank"), 0
    for s, most in enumerate(quota):
        gap = max(0, most - held[s])
        here = F.col("spare").between(first_gap, first_gap + gap - 1)
        shard, slot = F.when(here, s).otherwise(shard), F.when(here, F.col("spare") - first_gap + held[s]).otherwise(slot)
        first_gap += gap
    return ranked.withColumn("spare", spare).withColumns({"_slot": slot.cast("long"), "shard": shard.cast("int")}).select(
        "doc_id", "size", "text_crc32", "shard", F.col("_slot").alias("slot"))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and group: a 160-bit fingerprint that equal texts share."""
    text = F.coalesce("text", F.lit(""))
    size, crc = F.octet_length(text).cast("long") + 1, F.crc32(text)
    return docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.struct(F.xxhash64("text"), crc, F.octet_length("text")).alias("group"))


def op5_sharding(spark, sf_dir):
    placed = assign(fingerprinted(table(spark, sf_dir, "documents")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
