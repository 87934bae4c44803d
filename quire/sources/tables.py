"""Schemas of the corpus tables, and typed reading and writing of them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Stored states, steps and field types.
STEP_ORDER = ("store", "decompose", "ocr", "extract", "embed", "review")
DOCUMENT_STATUS = ("received", "processing", "pending_review", "validated", "completed", "failed", "quarantined")
STEP_STATUS = ("pending", "running", "succeeded", "failed", "skipped")
FIELD_TYPES = ("string", "number", "integer", "boolean", "date", "datetime", "enum", "array", "object")
TERMINAL = ("completed", "failed", "quarantined")

FIELDS = "array<struct<key:string,value:string,confidence:double,page:int,evidence:string,valid:boolean,validation_errors:array<string>>>"

#: DDL of each table of the data model.
SCHEMAS = {
    "users": "id string, email string, role string, is_active boolean, created_at timestamp_ntz",
    "api_keys": "id string, user_id string, key_hash string, scopes array<string>, expires_at timestamp_ntz, revoked_at timestamp_ntz",
    "tags": "tag_id long, slug string, name string, description string, version int, is_active boolean, auto_approve_threshold double, classification_hints string",
    "tag_fields": "tag_id long, key string, label string, field_type string, description string, is_required boolean, position int, enum_values array<string>, regex string, min_value double, max_value double, min_length int, max_length int, item_type string, object_schema string",
    "tag_versions": "tag_id long, version int, snapshot string, created_at timestamp_ntz",
    "documents": "document_id long, sha256 string, original_filename string, mime_type string, size_bytes long, blob_key string, page_count int, tag_id long, tag_version int, status string, current_step string, document_confidence double, needs_review boolean, title string, source string, uploaded_by string, metadata string, created_at timestamp_ntz, completed_at timestamp_ntz, deleted_at timestamp_ntz",
    "document_steps": "document_id long, step string, status string, attempt int, max_attempts int, started_at timestamp_ntz, finished_at timestamp_ntz, duration_ms long, error_code string, error_detail string, output_ref string, metrics map<string,double>",
    "document_events": "id long, document_id long, step string, event_type string, payload string, actor string, trace_id string, created_at timestamp_ntz",
    "document_pages": "document_id long, page int, blob_key string, thumb_key string, text_source string, char_count int, ocr_confidence double, is_blank boolean",
    "extraction_versions": "document_id long, version int, tag_id long, tag_version int, source string, model string, prompt_hash string, document_confidence double, mongo_id string, is_current boolean, created_by string, created_at timestamp_ntz",
    "validations": "document_id long, extraction_version_id string, decision string, reviewer_id string, notes string, corrected_fields string, auto boolean, created_at timestamp_ntz",
    "chunks": "document_id long, chunk_index int, text string, embedding array<float>, embed_model string, embed_dim int, token_count int, page_from int, page_to int, metadata map<string,string>, created_at timestamp_ntz",
    "webhooks": "webhook_id long, url string, events array<string>, is_active boolean, created_at timestamp_ntz",
    "webhook_deliveries": "id long, webhook_id long, event_type string, payload string, status string, attempt int, response_status int, error string, created_at timestamp_ntz, delivered_at timestamp_ntz",
    "idempotency_keys": "key string, request_hash string, response string, expires_at timestamp_ntz",
    "schema_config": "key string, value string",
    "pages": "document_id long, page int, text string, source string, confidence double, char_count int, created_at timestamp_ntz",
    "extractions": f"document_id long, version int, tag_id long, tag_version int, source string, model string, prompt_hash string, fields {FIELDS}, document_confidence double, created_at timestamp_ntz, created_by string",
    "raw_responses": "document_id long, step string, model string, request_summary string, response_text string, created_at timestamp_ntz",
}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the corpus, by its declared schema (nothing is inferred)."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with the columns of the table, in order; what is missing is null."""
    schema = df.sparkSession.createDataFrame([], SCHEMAS[name]).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def append(df: DataFrame, folder: str, name: str, at: str | None = None) -> None:
    """Append to a table; with `at`, partitioned by that timestamp's date."""
    if at:
        df.withColumn(f"{at}_date", F.to_date(at)).write.mode("append").partitionBy(f"{at}_date").parquet(f"{folder}/{name}")
    else:
        df.write.mode("append").parquet(f"{folder}/{name}")


def explode_fields(extractions: DataFrame) -> DataFrame:
    """Extractions with nested fields as the long table: one row per document, version and key."""
    each = extractions.select("document_id", "version", "tag_id", "tag_version", F.explode("fields").alias("f"))
    return each.select("document_id", "version", "tag_id", "tag_version", "f.*")


def retain(df: DataFrame, at: str, as_of, days: int = 30) -> DataFrame:
    """Rows younger than so many days at as_of."""
    return df.filter(F.col(at) > as_of - F.expr(f"interval {days} days"))
