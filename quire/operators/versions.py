"""Versioned rows: current pointers, numbering of additions, diffs and corrections."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def flag_current(versions: DataFrame, key: str = "document_id") -> DataFrame:
    """is_current: the newest version of each key. An aggregate and a join, so a long history is no burden to a window."""
    newest = versions.groupBy(key).agg(F.max("version").alias("_newest"))
    return versions.join(newest, key).withColumn("is_current", F.col("version") == F.col("_newest")).drop("_newest")


def latest(versions: DataFrame, key: str = "document_id") -> DataFrame:
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("_r")).select(key, "_r.*")


def number_additions(versions: DataFrame, additions: DataFrame, order: list, key: str = "document_id") -> DataFrame:
    """additions with the version numbers that follow the present ones; several per key number on."""
    base = versions.groupBy(key).agg(F.max("version").alias("_base"))
    nth = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return additions.withColumn("_nth", nth).join(base, key, "left").withColumn("version", (F.coalesce("_base", F.lit(0)) + F.col("_nth")).cast("int")).drop("_nth", "_base")


def schema_diff(old: DataFrame, new: DataFrame, keys: list[str], bumping: list[str]) -> DataFrame:
    """keys and change: add, remove, or change of a column that makes a new version."""
    a = old.select(*keys, F.struct(*bumping).alias("_a"))
    b = new.select(*keys, F.struct(*bumping).alias("_b"))
    differs = reduce(lambda x, y: x | y, [~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in bumping])
    change = F.when(F.col("_a").isNull(), "add").when(F.col("_b").isNull(), "remove").when(differs, "change")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change")).filter("change is not null")


def corrected(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """fields: document_id, key, value, confidence; corrections: document_id, key, value, ok.

    The next version of each corrected document: corrected fields have confidence 1, the others are
    carried over. One bad correction rejects its document's whole submission.
    """
    good = corrections.groupBy("document_id").agg(F.bool_and("ok").alias("ok")).filter("ok").select("document_id")
    usable = corrections.join(good, "document_id", "left_semi").select("document_id", "key", F.struct(F.col("value").alias("to")).alias("_c"))
    carried = fields.join(good, "document_id", "left_semi").select("document_id", "key", F.struct("value", "confidence").alias("_f"))
    both = carried.join(usable, ["document_id", "key"], "full_outer")
    return both.select(
        "document_id", "key", F.when(F.col("_c").isNotNull(), F.col("_c.to")).otherwise(F.col("_f.value")).alias("value"),
        F.when(F.col("_c").isNotNull(), 1.0).otherwise(F.col("_f.confidence")).alias("confidence"),
        F.when(F.col("_c").isNotNull(), F.col("_f.value")).alias("was"), F.col("_c").isNotNull().alias("corrected"))
