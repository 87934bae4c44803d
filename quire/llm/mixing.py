"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order (by a hash), gone through at most
max_epochs times. A turn is a document, or a piece of one that is long for the total budget, and
its virtual finish time is its source's cumulative words divided by the source's target. All turns
are sorted by that time over the whole corpus, in ranges of virtual time, and the mix ends where
the running total of words passes the budget; the turn that passes it is taken in part. As the
targets add up to the budget, each source is then within about a piece of its target.

Pieces are as long as 1/PIECES of a source's mean share of the budget, so they add at most PIECES
turns a source, whatever the size of the corpus.

No step orders a whole source, or the whole corpus, on one machine: running totals are taken in
hash buckets (or ranges of virtual time), over the totals of the buckets before. The targets are
computed by windows over one row a source.

Edge cases: null or empty texts have size 0 and are taken with 0 words; null sources are one
source, the last. Very long texts are taken piece by piece. Ties of virtual time go by the hash,
then the doc_id. Repeated rows are documents of their own; which of two alike rows ends the mix is
left open, as nothing tells them apart. Where no source has a word, all targets are 0. An empty
table gives no rows. Other columns, also with names used here, pass through mix().
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.llm.common import SPACE, WORD, cut, passing, table

WEIGHTS, FRACTION, MAX_EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix-1"
#: A table of so many sources at most is broadcast; a larger one is joined by a shuffle.
MAX_BROADCAST_SOURCES = 10_000
#: Pieces in a source's mean share of the budget, and the least words of a piece.
PIECES, LEAST_PIECE = 10_000, 16


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights=WEIGHTS, fraction=FRACTION, max_epochs=MAX_EPOCHS) -> DataFrame:
    """totals: source, source_size; one row a source. Adds target: fraction of all words, shared by
    weight, none above max_epochs times its source; the excess is shared again by weight.

    Sources reach their limit in the order of limit over weight, so the level at which the rest
    share is found from running sums in that order. The windows run over one row a source.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    shares = totals.withColumn("_at", F.row_number().over(order)).withColumn(
        "_weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_at") - 1, F.lit(len(weights))) + 1)))
    by_limit = W.orderBy(F.col("source_size") / F.col("_weight"), "_at")
    everything = W.partitionBy()
    limit = F.col("source_size") * max_epochs
    run = shares.withColumns({
        "_rank": F.row_number().over(by_limit),
        "_budget": F.sum("source_size").over(everything) * fraction,
        "_limits": F.sum(limit).over(by_limit) - limit,
        "_weights": F.sum("_weight").over(by_limit.rowsBetween(0, W.unboundedFollowing)),
    }).withColumn("_level", (F.col("_budget") - F.col("_limits")) / F.col("_weights"))
    below = F.col("_weight") * F.col("_level") < limit
    level = F.min_by("_level", F.when(below, F.col("_rank"))).over(everything)
    return run.withColumn("_share", level).select(
        "source", "source_size", F.least(limit.cast("double"), F.coalesce(F.col("_weight") * F.col("_share"), limit.cast("double"))).alias("target"))


def turns(rows: DataFrame, weights=WEIGHTS, fraction=FRACTION, max_epochs=MAX_EPOCHS, seed=SEED) -> DataFrame:
    """rows: doc_id, source, size and others. One row per document, epoch (doc_copy) and piece, with source_size,
    target, finish (virtual), words (that the mix takes) and position (in the mix). _key, _bucket and _nth
    together number the rows."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), "size"))
    rows = rows.withColumn("_hash", F.md5(F.concat_ws(":", F.lit(seed), name)))
    totals = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n")))
    n_rows, n_sources, n_all = totals.agg(F.sum("_n"), F.count("*"), F.sum("source_size")).first()
    budget = int((n_all or 0) * fraction)
    piece = max(LEAST_PIECE, budget // (PIECES * max(1, n_sources)))
    digits = 2 if (n_rows or 0) < 5_000_000 else 3 if n_rows < 100_000_000 else 4
    rows = rows.withColumns({"_key": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), "_bucket": F.substring("_hash", 1, digits)})
    buckets = rows.groupBy("_key", "_bucket").agg(F.sum("size").alias("_words"))
    before = buckets.select("_key", "_bucket", (F.sum("_words").over(W.partitionBy("_key").orderBy("_bucket")) - F.col("_words")).alias("_before"))
    order = W.partitionBy("_key", "_bucket").orderBy("_hash", "doc_id", "size")
    running = rows.withColumns({"_upto": F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)), "_nth": F.row_number().over(order)})
    goals = targets(totals.select("source", "source_size"), weights, fraction, max_epochs).select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_key"), "source_size", "target")
    goals = F.broadcast(goals) if n_sources <= MAX_BROADCAST_SOURCES else goals
    queued = running.join(before, ["_key", "_bucket"]).join(goals, "_key")
    each = queued.withColumn("doc_copy", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("size") / piece)).cast("int")
    each = each.withColumn("piece", F.explode(F.sequence(F.lit(0), n_pieces - 1))).withColumn("_from", F.col("piece").cast("long") * piece)
    each = each.withColumn("words", F.least(F.lit(piece).cast("long"), F.col("size") - F.col("_from")))
    upto = F.col("doc_copy") * F.col("source_size") + F.col("_before") + F.col("_upto") - F.col("size") + F.col("_from") + F.col("words")
    each = each.withColumn("finish", F.when(F.col("target") > 0, upto / F.col("target")))
    return in_virtual_time(each, budget, 16 ** digits)


def in_virtual_time(each: DataFrame, budget: int, n_ranges: int) -> DataFrame:
    """Sort by virtual finish time in ranges; position is the words before. The mix ends where the running total
    passes the budget: words is what is taken up to there."""
    # Most of the mix ends before time 1; the ranges after it widen, as few turns there are taken.
    late = F.when(F.col("finish") > 1, 1 + F.log2("finish")).otherwise(F.col("finish"))
    each = each.withColumn("_range", F.when(F.col("finish").isNotNull(), F.floor(late * n_ranges)).otherwise(-1 - F.pmod(F.xxhash64("doc_id", "_nth"), F.lit(n_ranges))))
    ranges = each.groupBy("_range").agg(F.sum("words").alias("_in_range"))
    ahead = ranges.select("_range", (F.sum("_in_range").over(W.orderBy("_range")) - F.col("_in_range")).alias("_ahead"))
    order = W.partitionBy("_range").orderBy("finish", "_hash", "doc_id", "doc_copy", "piece", "words").rowsBetween(W.unboundedPreceding, 0)
    placed = each.withColumn("_run", F.sum("words").over(order)).join(ahead, "_range")
    placed = placed.withColumn("position", F.col("_ahead") + F.col("_run") - F.col("words"))
    return placed.withColumn("words", F.greatest(F.lit(0), F.least("words", F.lit(budget) - F.col("position"))).cast("long"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus, range-sorted by its order: the rows of docs, once for each turn that is taken.
    A text that is taken in part ends after so many words, and n_chars (if there) is renewed.

    The queue is computed on narrow rows; texts are shuffled once to meet their turns, and once into
    order. Rows alike in doc_id, source and text meet the turns of all of them.
    """
    rows, back = passing(docs, ["doc_id", "source", "text", "n_chars"])
    name, content = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("source", "text", F.col("doc_id").isNull())
    narrow = cut(rows.select("doc_id", "source", n_words("text").alias("size"), content.alias("_content")))
    # The pieces of a document that are taken are its first ones; it stands where the first of them does.
    taken = turns(narrow, **how).filter("words > 0").groupBy("_key", "_bucket", "_nth", "doc_copy").agg(
        F.first("doc_id").alias("doc_id"), F.first("_content").alias("_content"), F.first("size").alias("size"), F.sum("words").alias("words"), F.min("position").alias("position"))
    taken = taken.select(name.alias("_id"), "_content", F.when(F.col("words") < F.col("size"), F.col("words")).alias("_part"), F.col("position").alias("_position"))
    texts = rows.withColumns({"_id": name, "_content": content}).dropDuplicates(["_id", "_content"])
    begun = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[{SPACE}]*{WORD}"), F.lit(0)), F.lit(1), F.col("_part").cast("int")), "")
    mixed = texts.join(taken, ["_id", "_content"]).withColumn("text", F.when(F.col("_part").isNotNull(), begun).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        mixed = mixed.withColumn("n_chars", F.when(F.col("_part").isNotNull(), chars).otherwise(F.col("n_chars")))
    return back(mixed.repartitionByRange("_position").sortWithinPartitions("_position"))


def op2_mixing(spark, sf_dir):
    rows = cut(table(spark, sf_dir, "documents").select("doc_id", "source", n_words("text").alias("size")))
    each = turns(rows)
    return each.groupBy("_key", "_bucket", "_nth", "doc_id").agg(
        F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.sum("words").cast("long").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def oracle() -> str:
    return f"""
with counted as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
sized as (select *,
    md5('{SEED}:' || coalesce(doc_id::varchar, 'null ' || size)) as h from counted),
totals as (select source, sum(size)::bigint as source_size from sized group by source),
weighted as (select *, row_number() over (order by source is null, source) as nth from totals),
shares as (select *, case (nth - 1) % 3 when 0 then {WEIGHTS[0]} when 1 then {WEIGHTS[1]} else {WEIGHTS[2]} end as weight from weighted),
run as (select *, row_number() over (order by source_size / weight, nth) as rank,
    sum(source_size) over () * {FRACTION}::double as budget,
    sum(source_size * {MAX_EPOCHS}) over (order by source_size / weight, nth) - source_size * {MAX_EPOCHS} as limits,
    sum(weight) over (order by source_size / weight, nth rows between current row and unbounded following) as weights from shares),
levels as (select *, (budget - limits::double) / weights::double as level from run),
goal as (select source, source_size, least((source_size * {MAX_EPOCHS})::double, coalesce(weight::double * (min_by(level, case when weight::double * level < source_size * {MAX_EPOCHS} then rank end) over ()), (source_size * {MAX_EPOCHS})::double)) as target from levels),
budget as (select floor(sum(source_size) * {FRACTION})::bigint as budget, greatest({LEAST_PIECE}, floor(sum(source_size) * {FRACTION})::bigint // ({PIECES} * count(*)))::bigint as piece from totals),
queued as (select row_number() over () as row, s.doc_id, s.size, s.h, g.source_size, g.target,
    sum(s.size) over (partition by s.source order by h, s.doc_id, s.size rows unbounded preceding)::bigint - s.size as start
    from sized s join goal g on s.source is not distinct from g.source),
pieces as (select q.*, b.budget, b.piece as long, unnest(range(0, greatest(1, (q.size + b.piece - 1) // b.piece))) as part from queued q, budget b),
turns as (select *, least(long, size - part * long) as words, copy * source_size + start + part * long + least(long, size - part * long) as upto
    from pieces, (select unnest(range(0, {MAX_EPOCHS})) as copy)),
sorted as (select *, sum(words) over (order by upto / target, h, doc_id, copy, part rows unbounded preceding)::bigint as run from turns)
select any_value(doc_id) as doc_id, any_value(size) as size, any_value(source_size) as source_size, any_value(target) as target,
    sum(greatest(0, least(words, budget - run + words)))::bigint as taken
from sorted group by row"""
