"""Relational operators that tables of a corpus need: upserts, patches, pages of results, checks."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def same(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def last_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], kept: tuple[str, ...] = ()) -> DataFrame:
    """old with the rows of new put in by key; a replaced row keeps its own values of `kept` columns.

    Keys of new must be unique (see last_per_key). One shuffle on the key, whatever the sizes.
    """
    values = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*values).alias("_old"))
    b = new.select(*keys, F.struct(*values).alias("_new"))
    both = a.join(b, keys, "full_outer")
    pick = lambda c: F.when(F.col("_new").isNotNull() & (F.col("_old").isNull() | F.lit(c not in kept)), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
    return both.select(*keys, *[pick(c).alias(c) for c in values])


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old, keys, "left_anti").select(*old.columns))


def admit(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """new with outcome: `appended` for the first row (in order) of a key that old lacks, else `refused`."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1
    there = old.select(*keys, F.lit(True).alias("_there")).distinct()
    met = new.withColumn("_first", first).join(there, keys, "left")
    return met.withColumn("outcome", F.when(F.col("_first") & F.col("_there").isNull(), "appended").otherwise("refused")).drop("_first", "_there")


def patch(rows: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """patches: key, column, value (string, null is a legal new value). Only named columns change."""
    columns = [c for c in rows.columns if c != key]
    wide = patches.groupBy(key).agg(
        *[F.max(F.when(F.col("column") == c, F.lit(True))).alias(f"_set_{c}") for c in columns],
        *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"_new_{c}") for c in columns])
    changed = rows.join(wide, key, "left")
    kinds = dict(rows.dtypes)
    return changed.select(key, *[F.when(F.col(f"_set_{c}"), F.col(f"_new_{c}").cast(kinds[c])).otherwise(F.col(c)).alias(c) for c in columns])


def replace_groups(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that new names are replaced by new's."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def keyset_page(rows: DataFrame, order: list[tuple[str, bool]], after: tuple | None, limit: int) -> DataFrame:
    """The next rows in an order of (column, descending), after a row given by those columns' values."""
    if after is not None:
        further, equal = F.lit(False), F.lit(True)
        for (c, down), v in zip(order, after, strict=True):
            further = further | (equal & ((F.col(c) < F.lit(v)) if down else (F.col(c) > F.lit(v))))
            equal = equal & (F.col(c) == F.lit(v))
        rows = rows.filter(further)
    return rows.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in order]).limit(limit)


def running_total(rows: DataFrame, partition: list[str], order: list, value: str) -> Column:
    return F.sum(value).over(W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


# Integrity: each gives the offending rows; none means that the rule holds.


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(rows: DataFrame, column: str, parents: DataFrame, parent_column: str) -> DataFrame:
    return rows.filter(F.col(column).isNotNull()).join(parents.select(F.col(parent_column).alias(column)).distinct(), column, "left_anti")


def outside(rows: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(column) < low)
    if high is not None:
        bad = bad | (F.col(column) > high)
    return rows.filter(bad)


def not_member(rows: DataFrame, column: str, values) -> DataFrame:
    return rows.filter(F.col(column).isNotNull() & ~F.col(column).isin(*values))
