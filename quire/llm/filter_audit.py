"""Filter interaction audit: forward-backward path counts over the lattice of applied filters.

Which documents a filter removes depends on the filters before it. The states of the lattice are the
sets of filters that have been applied; an order of n filters is a path from the empty set to the full
one, and an edge applies one more filter. A document with a set of failed filters survives a state that
holds none of them, and is removed by the first edge that adds one. So one count per part and failed
set (at most 2^n rows a part) tells what every edge removes, whatever the number of documents.

Forward, the orders that reach a state are counted from the states before it; backward, those that leave
it from the states after it. An edge lies on forward * backward orders: weighed by that, what its edges
remove sums to a filter's Shapley count over all orders. The steps of each order are read from the same
edges, so nothing is counted per order.

Documents go through one narrow row each: failed set, part, labels and a digest of the text. Equal texts
meet as counts by digest, which are combined before they are shuffled, so a text that a third of all rows
share is no large group.

Edge cases: null texts are empty (they fail A; of several, all but the one of smallest doc_id fail E). A
null source is the part of the empty string, together with empty sources. A null doc_id has no smaller
one and isn't smaller than others, so it never fails E; rows that repeat the smallest doc_id of their text don't
either. A document without a row in labels, or with nulls there, counts as neither good nor toxic; of
several rows of a doc_id in labels, any that says so counts. Texts of any length count whole. Other columns
are not read, whatever their names. An empty table gives no rows.
"""

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.llm.common import SPACE, table

#: n! orders of n steps are returned for each part.
MAX_FILTERS = 8


def paths(n: int) -> dict[tuple[int, int], int]:
    """(state, filter) -> the orders whose path takes that edge; states are bit sets of n filters."""
    full = (1 << n) - 1
    forward, backward = {0: 1}, {full: 1}
    for state in range(1, full + 1):  # the states before it are smaller numbers
        forward[state] = sum(forward[state & ~(1 << f)] for f in range(n) if state >> f & 1)
    for state in range(full - 1, -1, -1):
        backward[state] = sum(backward[state | 1 << f] for f in range(n) if not state >> f & 1)
    return {(state, f): forward[state] * backward[state | 1 << f] for state in range(full + 1) for f in range(n) if not state >> f & 1}


def steps_of_orders(names: str) -> list[tuple[str, int, int, int]]:
    """(order, step from 1, state before it, filter) of every order of the filters."""
    found = []
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, 1):
            found.append(("".join(names[i] for i in order), step, state, f))
            state |= 1 << f
    return found


def audit(counts: DataFrame, names: str, tallies: tuple[str, ...] = ()) -> DataFrame:
    """counts: part, failed (bit set: bit i for names[i]), n, and tallies, to be summed. Per part, order of the
    filters and step: kept, removed, redundant (failing, but removed before), unique_fails (failing this
    alone), shapley, and per tally t of what the step removes: t_lost. names has a letter for each filter."""
    if len(names) > MAX_FILTERS:
        raise ValueError(f"at most {MAX_FILTERS} filters: each part has a row for every step of every order")
    edges = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(1 << f).alias("bit"), F.lit(w).cast("long").alias("weight")) for (s, f), w in paths(len(names)).items()])
    alive, fails = F.col("failed").bitwiseAND(F.col("state")) == 0, F.col("failed").bitwiseAND(F.col("bit")) != 0
    total = lambda name, met: F.coalesce(F.sum(F.when(met, F.col(name))), F.lit(0)).cast("long")
    each = counts.groupBy("part", "failed").agg(*[F.sum(c).cast("long").alias(c) for c in ("n", *tallies)])
    each = each.select("*", F.inline(edges))
    by_edge = each.groupBy("part", "state", "filter", "weight").agg(
        total("n", alive & ~fails).alias("kept"), total("n", alive & fails).alias("removed"), total("n", fails & ~alive).alias("redundant"),
        total("n", F.col("failed") == F.col("bit")).alias("unique_fails"), *[total(t, alive & fails).alias(f"{t}_lost") for t in tallies])
    by_edge = by_edge.withColumn("shapley", F.sum(F.col("weight") * F.col("removed")).over(W.partitionBy("part", "filter")))
    orders = counts.sparkSession.createDataFrame(steps_of_orders(names), "filter_order string, step int, state int, filter int")
    return by_edge.join(orders, ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"{t}_lost" for t in tallies], "shapley")


def conditions(text: Column) -> dict[str, Column]:
    """When a text fails A (short), B (repetitive), C (capitals) or D (symbols)."""
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    return {
        "A": F.size(words) < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 2 * F.length(text), "D": text.rlike("[#$%&*|]")}


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs: doc_id, text, source; labels: doc_id, quality, toxic. Counts of documents per part and failed set
    (bits 0 to 4 for A to E): part, failed, n, good, toxic."""
    text = F.coalesce("text", F.lit(""))
    failed = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions(F.col("text")).values())), F.lit(0))
    narrow = docs.select("doc_id", text.alias("text"), F.coalesce("source", F.lit("")).alias("part"))
    narrow = narrow.select("doc_id", "part", failed.alias("failed"), F.unhex(F.sha2("text", 256)).alias("digest"))
    flags = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flagged = narrow.join(flags.filter("good or toxic"), "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)).cast("int") for c in ("good", "toxic")})
    # Rows of one id and text, then those of one text: partly combined before they are shuffled, so equal texts are few rows.
    alike = ["part", "failed", "digest", "good", "toxic"]
    by_id = flagged.groupBy("doc_id", *alike).agg(F.count("*").alias("n"))
    by_text = by_id.groupBy(*alike).agg(F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("no_id"))
    smallest = F.min("least.doc_id").over(W.partitionBy("digest"))
    at_least = F.when(F.col("least.doc_id") == smallest, F.col("least.n")).otherwise(0)
    first = F.coalesce(at_least, F.lit(0)) + F.coalesce("no_id", F.lit(0))
    split = by_text.select("part", "failed", "good", "toxic", "n", first.alias("first"))
    fate = F.inline(F.array(F.struct(F.col("failed"), F.col("first").alias("n")), F.struct(F.col("failed").bitwiseOR(F.lit(16)).alias("failed"), (F.col("n") - F.col("first")).alias("n"))))
    told = split.select("part", "good", "toxic", fate).filter("n > 0")
    return told.groupBy("part", "failed").agg(F.sum("n").alias("n"), F.sum(F.col("good") * F.col("n")).alias("good"), F.sum(F.col("toxic") * F.col("n")).alias("toxic"))


def op13_filter_audit(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return audit(failures(docs, labels), "ABCDE", ("good", "toxic"))


def oracle() -> str:
    return r"""
with base as (select doc_id, coalesce(text, '') as text, coalesce(source, '') as part, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from documents),
flags as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
firsts as (select text, min(doc_id) as least from base group by text),
masked as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    case when len(words) < 200 then 1 else 0 end + case when 100 * len(list_distinct(words)) < 50 * len(words) then 2 else 0 end
    + case when 100 * length(regexp_replace(base.text, '[^A-Z]', '', 'g')) > 2 * length(base.text) then 4 else 0 end
    + case when regexp_matches(base.text, '[#$%&*|]') then 8 else 0 end + case when base.doc_id > least then 16 else 0 end as failed
    from base join firsts on base.text = firsts.text left join flags on base.doc_id = flags.doc_id),
counted as (select part, failed, count(*) as n, sum(good) as good, sum(toxic) as toxic from masked group by part, failed),
bits as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(name, b)),
orders as (select v.name || w.name || x.name || y.name || z.name as filter_order, v.b as b1, w.b as b2, x.b as b3, y.b as b4, z.b as b5
    from bits v join bits w on v.b <> w.b join bits x on x.b not in (v.b, w.b) join bits y on y.b not in (v.b, w.b, x.b) join bits z on z.b not in (v.b, w.b, x.b, y.b)),
steps as (select filter_order, 1 as step, 0 as before, b1 as b from orders union all select filter_order, 2, b1, b2 from orders union all select filter_order, 3, b1 + b2, b3 from orders
    union all select filter_order, 4, b1 + b2 + b3, b4 from orders union all select filter_order, 5, b1 + b2 + b3 + b4, b5 from orders),
told as (select part, filter_order, step, b, sum(case when failed & (before | b) = 0 then n else 0 end)::bigint as kept,
    sum(case when failed & before = 0 and failed & b <> 0 then n else 0 end)::bigint as removed,
    sum(case when failed & before <> 0 and failed & b <> 0 then n else 0 end)::bigint as redundant,
    sum(case when failed = b then n else 0 end)::bigint as unique_fails,
    sum(case when failed & before = 0 and failed & b <> 0 then good else 0 end)::bigint as good_lost,
    sum(case when failed & before = 0 and failed & b <> 0 then toxic else 0 end)::bigint as toxic_lost
    from counted join steps on true group by part, filter_order, step, b)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, b)::bigint as shapley from told"""
