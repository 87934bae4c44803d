"""What several operators share: table reading, cutting of lineage and passing of columns."""

from pyspark.sql import DataFrame, SparkSession

from quire.operators.lineage import cut as cut

#: White space that separates words, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passing(docs: DataFrame, needed: list[str]):
    """docs with all columns but the needed ones renamed out of the way, and a function that gives a
    result of such rows the columns of docs again, by name and order; columns it adds replace those of their names."""
    names = {c: c if c in needed else f"_passed_{i}" for i, c in enumerate(docs.columns)}
    safe = docs.select(*[docs[c].alias(n) for c, n in names.items()])
    return safe, lambda df, added=(): df.select(*[df[n].alias(c) for c, n in names.items() if c not in added], *added)
