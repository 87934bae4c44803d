"""Deletion in two steps: a document is marked first, and purged later with what belongs to it."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.tables import append, conform

# Tables whose rows go with their document.
BELONGING = ("document_steps", "document_pages", "extraction_versions", "chunks", "pages", "extractions")


def mark(documents: DataFrame, asked: DataFrame, at: Column) -> DataFrame:
    """documents, with deleted_at set for those asked for (document_id) that are not marked yet."""
    met = documents.join(asked.select("document_id").distinct().withColumn("_asked", F.lit(True)), "document_id", "left")
    return met.withColumn("deleted_at", F.when(F.col("_asked") & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at"))).select(*documents.columns)


def purge(tables: Callable[[str], DataFrame], folder: str, before: Column, documents: DataFrame | None = None) -> None:
    """Writes documents, and the tables that belong to them, to another folder without those marked before a time (and without what
    belongs to them). The old folder stays as it is, so a purge that fails is simply done again."""
    documents = tables("documents") if documents is None else documents
    gone = documents.filter(F.col("deleted_at") < before).select("document_id")
    append(conform(documents.filter(F.col("deleted_at").isNull() | (F.col("deleted_at") >= before)), "documents"), folder, "documents")
    for name in BELONGING:
        append(tables(name).join(gone, "document_id", "left_anti"), folder, name)
