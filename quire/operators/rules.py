"""Constraints of the data model as a table of rules, and the rows that break them.

All rules of a kind are checked together: values of a row in one pass over its table; the keys of all uniqueness rules
of all tables in one aggregate; the references of all foreign keys, each distinct one once, in one anti join.
"""

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.tables import DOCUMENT_STATUS, FIELD_TYPES, STEP_ORDER, STEP_STATUS


class Unique(NamedTuple):
    table: str
    keys: tuple[str, ...]
    where: str = "true"


class Refers(NamedTuple):
    table: str
    column: str
    parent: str
    parent_column: str


class Within(NamedTuple):
    """Bounds are inclusive; None: open."""

    table: str
    column: str
    low: float | None
    high: float | None


class OneOf(NamedTuple):
    table: str
    column: str
    values: tuple[str, ...]


# The constraints of the data model.
UNIQUE = (
    Unique("users", ("email",)), Unique("api_keys", ("key_hash",)), Unique("tags", ("slug",)), Unique("tag_fields", ("tag_id", "key")), Unique("tag_fields", ("tag_id", "position")),
    Unique("tag_versions", ("tag_id", "version")), Unique("documents", ("sha256",)), Unique("document_steps", ("document_id", "step")), Unique("document_pages", ("document_id", "page")),
    Unique("extraction_versions", ("document_id", "version")), Unique("extraction_versions", ("document_id",), "is_current"), Unique("chunks", ("document_id", "chunk_index", "embed_model")),
    Unique("idempotency_keys", ("key",)), Unique("pages", ("document_id", "page")), Unique("extractions", ("document_id", "version")))
REFERS = (
    Refers("tag_fields", "tag_id", "tags", "tag_id"), Refers("tag_versions", "tag_id", "tags", "tag_id"), Refers("documents", "tag_id", "tags", "tag_id"), Refers("document_steps", "document_id", "documents", "document_id"),
    Refers("document_events", "document_id", "documents", "document_id"), Refers("document_pages", "document_id", "documents", "document_id"), Refers("extraction_versions", "document_id", "documents", "document_id"),
    Refers("extraction_versions", "tag_id", "tags", "tag_id"), Refers("validations", "document_id", "documents", "document_id"), Refers("validations", "extraction_version_id", "extraction_versions", "mongo_id"),
    Refers("validations", "reviewer_id", "users", "id"), Refers("chunks", "document_id", "documents", "document_id"), Refers("webhook_deliveries", "webhook_id", "webhooks", "webhook_id"))
WITHIN = (
    Within("tags", "auto_approve_threshold", 0, 1), Within("documents", "document_confidence", 0, 1), Within("extraction_versions", "document_confidence", 0, 1), Within("extraction_versions", "version", 1, None),
    Within("extraction_versions", "tag_version", 1, None), Within("document_pages", "page", 1, None), Within("document_pages", "ocr_confidence", 0, 1), Within("document_pages", "char_count", 0, None),
    Within("pages", "page", 1, None), Within("pages", "confidence", 0, 1), Within("chunks", "chunk_index", -1, None), Within("chunks", "page_from", 1, None), Within("chunks", "page_to", 1, None))
ONE_OF = (
    OneOf("documents", "source", ("ui", "api")), OneOf("documents", "status", DOCUMENT_STATUS), OneOf("extraction_versions", "source", ("model", "human")), OneOf("tag_fields", "field_type", FIELD_TYPES),
    OneOf("document_steps", "step", STEP_ORDER), OneOf("document_steps", "status", STEP_STATUS), OneOf("users", "role", ("admin", "reviewer", "viewer")),
    OneOf("validations", "decision", ("approved", "rejected", "corrected")), OneOf("webhook_deliveries", "status", ("pending", "delivered", "failed")))

Tables = Callable[[str], DataFrame]


def name(rule) -> str:
    """As users see it: the table and what of it is constrained."""
    of = ", ".join(rule.keys) + (f" where {rule.where}" if rule.where != "true" else "") if isinstance(rule, Unique) else rule.column
    return f"{rule.table}({of})"


def _by_table(rules: tuple) -> dict[str, list]:
    return {t: [r for r in rules if r.table == t] for t in dict.fromkeys(r.table for r in rules)}


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def duplicates(tables: Tables, rules: tuple[Unique, ...] = UNIQUE) -> DataFrame:
    """Keys that more than one row has: rule, value, n. A key with a null in it is no duplicate.

    As most keys are there once, adding them up before the shuffle would only hold them twice; and they are dealt by number, since the
    optimiser sizes tasks by compressed bytes, of which keys that are much alike have few.
    """
    frames, place = [], {r: i for i, r in enumerate(rules)}
    for table, of in _by_table(rules).items():
        keys = [F.when(F.expr(r.where) & reduce(Column.__and__, [F.col(k).isNotNull() for k in r.keys]),
                       F.struct(F.lit(place[r]).alias("place"), F.concat_ws(", ", *[F.col(k).cast("string") for k in r.keys]).alias("value"))) for r in of]
        frames.append(tables(table).select(F.explode(F.array_compact(F.array(*keys))).alias("k")).select("k.*"))
    found = _union(frames)
    dealt = found.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "place", "value")
    many = dealt.groupBy("place", "value").agg(F.count("*").alias("n")).filter("n > 1")
    return many.select(F.get(F.array(*[F.lit(name(r)) for r in rules]), "place").alias("rule"), "value", "n")


def dangling(tables: Tables, rules: tuple[Refers, ...] = REFERS) -> DataFrame:
    """References to rows that aren't there: rule, value, n (the rows that hold it). Null refers to nothing."""
    frames = []
    for table, of in _by_table(rules).items():
        refs = [F.when(F.col(r.column).isNotNull(), F.struct(F.lit(name(r)).alias("rule"), F.lit(f"{r.parent}.{r.parent_column}").alias("parent"), F.col(r.column).cast("string").alias("value"))) for r in of]
        frames.append(tables(table).select(F.explode(F.array_compact(F.array(*refs))).alias("k")).select("k.*"))
    held = _union(frames).groupBy("rule", "parent", "value").agg(F.count("*").alias("n"))
    parents = [tables(t).select(F.lit(f"{t}.{c}").alias("parent"), F.col(c).cast("string").alias("value")) for t, c in dict.fromkeys((r.parent, r.parent_column) for r in rules)]
    return held.join(_union(parents), ["parent", "value"], "left_anti").select("rule", "value", "n")


def _offending(tables: Tables, rules: tuple, bad: Callable[..., Column]) -> DataFrame:
    frames = []
    for table, of in _by_table(rules).items():
        found = [F.when(bad(r), F.struct(F.lit(name(r)).alias("rule"), F.col(r.column).cast("string").alias("value"))) for r in of]
        frames.append(tables(table).select(F.explode(F.array_compact(F.array(*found))).alias("k")).select("k.*"))
    return _union(frames).groupBy("rule", "value").agg(F.count("*").alias("n"))


def outside(tables: Tables, rules: tuple[Within, ...] = WITHIN) -> DataFrame:
    """Values out of bounds: rule, value, n. Null is within any."""

    def bad(r: Within) -> Column:
        bounds = [F.col(r.column) < r.low] if r.low is not None else []
        return reduce(Column.__or__, bounds + ([F.col(r.column) > r.high] if r.high is not None else []))

    return _offending(tables, rules, bad)


def strangers(tables: Tables, rules: tuple[OneOf, ...] = ONE_OF) -> DataFrame:
    """Values that aren't members of their enumeration: rule, value, n."""
    return _offending(tables, rules, lambda r: ~F.col(r.column).isin(*r.values))


def wrong_dimensions(chunks: DataFrame, config: DataFrame, wanted: int) -> DataFrame:
    """chunks: document_id, chunk_index, embedding, embed_dim; config: key, value (JSON). Chunks whose vector, or what is said of
    it, hasn't the recorded dimension (problem `chunk`), and a row without document where the record itself is wrong:
    `missing`, `malformed`, or `setting` where it isn't the wanted one. Without a record, the wanted one holds."""
    value = config.filter("key = 'vector'").agg(F.max("value").alias("value"), F.count("*").alias("rows"))
    dim = F.get_json_object("value", "$.embed_dim").try_cast("int")
    problem = F.when(F.col("rows") == 0, "missing").when(F.col("dim").isNull(), "malformed").when(F.col("dim") != wanted, "setting")
    record = value.withColumn("dim", dim).withColumn("problem", problem)
    of_record = record.filter("problem is not null").select(F.lit(None).cast("long").alias("document_id"), F.lit(None).cast("int").alias("chunk_index"), F.col("dim").alias("embed_dim"), "problem")
    recorded = record.first().dim or wanted  # one row
    bad = chunks.filter((F.size("embedding") != recorded) | ~F.col("embed_dim").eqNullSafe(F.lit(recorded)) | F.col("embedding").isNull())
    return bad.select("document_id", "chunk_index", "embed_dim", F.lit("chunk").alias("problem")).unionByName(of_record)
