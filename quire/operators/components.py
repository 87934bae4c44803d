"""Connected components by alternating stars (Kiveris et al., 2014), as joins and aggregates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.lineage import cut


def components(links: DataFrame) -> DataFrame:
    """links: u, v. One row per node that has a link to another: node, component (its smallest node).

    Each round points every node at smaller ones; the rounds grow with the logarithm of the
    longest path. The edges never exceed the links in number, and no node's list is gathered.
    """
    edges = cut(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        # Large star: every larger neighbour of a node is linked to the node's smallest neighbour.
        both = edges.union(edges.select("v", "u"))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(smallest, "u").filter("w <> m").select(F.col("w").alias("u"), F.col("m").alias("v"))
        edges = cut(edges.distinct())
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = edges.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(smallest.select("u", F.col("m").alias("v")))
        edges = cut(edges.distinct())
        found = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if found == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        state = found
