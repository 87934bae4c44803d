"""The tables of the data model derived from the corpus, by expressions that Spark and DuckDB both take.

Some rows break constraints on purpose, so that checks have something to find.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.corpus import Corpus
from quire.sources.tables import SCHEMAS, conform

#: table -> (table of the corpus or of the driver, column -> expression)
MODEL = {
    "users": ("customer", {"id": "cast(c_custkey as string)", "email": "concat('user', cast(c_custkey % 140 as string), '@example.com')", "role": "case when c_custkey % 50 = 0 then 'owner' when c_custkey % 3 = 0 then 'admin' else 'viewer' end", "is_active": "c_acctbal > 0"}),
    "api_keys": ("supplier", {"id": "cast(s_suppkey as string)", "user_id": "cast(s_suppkey as string)", "key_hash": "cast(s_suppkey % 9 as string)"}),
    "tags": ("t_tags", {"tag_id": "tag_id", "slug": "slug", "name": "name", "version": "version", "is_active": "is_active", "auto_approve_threshold": "auto_approve_threshold + case when tag_id = 4 then 0.5 else 0 end"}),
    "tag_fields": ("t_tag_fields", {"tag_id": "tag_id + case when key = 'items' then 7 else 0 end", "key": "key", "label": "label", "field_type": "case when key = 'paid' then 'flag' else field_type end", "is_required": "is_required", "position": "case when key = 'priority' then 3 else position end"}),
    "tag_versions": ("t_documents", {"tag_id": "case when document_id % 40 = 0 then 9 else tag_id end", "version": "cast(floor(document_id / 2) as int)"}),
    "documents": ("t_documents", {"document_id": "document_id", "sha256": "sha256", "original_filename": "original_filename", "size_bytes": "size_bytes", "tag_id": "case when document_id % 31 = 0 then 8 else tag_id end",
        "status": "case when document_id % 23 = 0 then 'lost' else status end", "needs_review": "needs_review", "document_confidence": "document_confidence + case when document_id % 19 = 0 then 1 else 0 end", "title": "title",
        "source": "case when document_id % 17 = 0 then 'mail' when document_id % 2 = 0 then 'ui' else 'api' end", "created_at": "created_at", "deleted_at": "deleted_at"}),
    "document_steps": ("t_steps", {"document_id": "document_id", "step": "case when document_id % 29 = 0 and step = 'embed' then 'ocr' else step end", "status": "case when document_id % 37 = 0 and status = 'running' then 'stalled' else status end", "attempt": "attempt", "max_attempts": "max_attempts", "started_at": "started_at"}),
    "document_events": ("t_events", {"id": "id", "document_id": "document_id + case when id % 1000 = 0 then 1000000 else 0 end", "step": "step", "event_type": "event_type", "payload": "payload", "created_at": "created_at"}),
    "document_pages": ("t_pages", {"document_id": "case when document_id % 41 = 0 then -document_id else document_id end", "page": "page - case when document_id % 13 = 0 then 1 else 0 end", "text_source": "'layer'", "char_count": "length(text)", "ocr_confidence": "(document_id % 107) / 100.0", "is_blank": "length(text) = 0"}),
    "extraction_versions": ("t_versions", {"document_id": "document_id", "version": "case when document_id % 100 = 7 then 2 else version end", "tag_id": "tag_id + case when document_id % 200 = 1 then 10 else 0 end", "tag_version": "tag_version - case when document_id % 300 = 2 then 3 else 0 end",
        "source": "case when document_id % 400 = 3 then 'robot' else source end", "document_confidence": "document_confidence + case when document_id % 500 = 4 then 1 else 0 end", "mongo_id": "concat(cast(document_id as string), ':', cast(version as string))",
        "is_current": "version % 3 = 1", "created_at": "created_at"}),
    "validations": ("labels", {"document_id": "doc_id + case when doc_id % 9 = 0 then 5000000 else 0 end", "extraction_version_id": "concat(cast(doc_id as string), ':1')", "decision": "case when doc_id % 11 = 0 then 'undecided' when toxic = 1 then 'rejected' else 'approved' end", "reviewer_id": "cast(doc_id as string)", "auto": "quality = 1"}),
    "chunks": ("t_chunks", {"document_id": "case when document_id % 10 = 3 then document_id - 1 else document_id end", "chunk_index": "chunk_index - case when document_id % 50 = 8 then 2 else 0 end", "embed_model": "embed_model", "embed_dim": "embed_dim", "page_from": "cast(document_id % 5 as int)", "page_to": "1"}),
    "webhooks": ("t_webhooks", {"webhook_id": "webhook_id", "url": "concat('https://example.com/', cast(webhook_id as string))", "events": "events", "is_active": "is_active"}),
    "webhook_deliveries": ("t_deliveries", {"id": "id", "webhook_id": "webhook_id + case when id % 700 = 0 then 10000 else 0 end", "event_type": "event_type", "status": "case when id % 900 = 0 then 'unknown' else status end", "attempt": "attempt", "created_at": "created_at"}),
    "idempotency_keys": ("conversations", {"key": "concat('conversation ', cast(conv_id as string))", "request_hash": "sha256(text)"}),
    "schema_config": ("t_tags", {"key": "case when tag_id = 1 then 'vector' else slug end", "value": "case when tag_id = 1 then '{\"embed_dim\": 64}' else '{}' end"}),
    "pages": ("t_pages", {"document_id": "document_id", "page": "page - case when document_id % 43 = 0 then 2 else 0 end", "text": "text", "source": "'layer'", "confidence": "case when document_id % 47 = 0 then -0.25 else 0.5 end", "char_count": "length(text)"}),
    "extractions": ("t_versions", {"document_id": "document_id", "version": "case when document_id % 150 = 5 then 1 else version end", "tag_id": "tag_id", "tag_version": "tag_version", "source": "source", "document_confidence": "document_confidence"}),
    "raw_responses": ("t_events", {"document_id": "document_id", "step": "step", "response_text": "payload", "created_at": "created_at"}),
}


def table(c: Corpus, name: str) -> DataFrame:
    """A table of the model, with the columns that are derived; the others are null."""
    source, columns = MODEL[name]
    rows = getattr(c, source[2:]) if source.startswith("t_") else c.table(source)
    exprs = [f"{e.replace('sha256(text)', 'sha2(text, 256)')} as {column}" for column, e in columns.items()]
    return conform(rows.selectExpr(*exprs), name)


def kinds(name: str) -> dict[str, str]:
    return {column.split()[0]: column.split()[1] for column in SCHEMAS[name].split(", ")}


def sql(name: str) -> str:
    """The same rows and columns in DuckDB."""
    source, columns = MODEL[name]
    duck = {"string": "varchar", "long": "bigint", "array<string>": "varchar[]", "timestamp_ntz": "timestamp"}
    return f"select {', '.join(f'cast({e} as {duck.get(kinds(name)[c], kinds(name)[c])}) as {c}' for c, e in columns.items())} from {source}"


def row_text(name: str, spark: bool):
    """A row's derived columns as one text, for comparing values: a Spark column, or DuckDB SQL."""
    parts = []
    for c in MODEL[name][1]:
        kind = kinds(name)[c]
        if kind == "double":
            parts.append(f"cast(cast(round({c} * 1000) as bigint) as string)")
        elif kind == "timestamp_ntz":
            parts.append(f"date_format({c}, 'yyyy-MM-dd HH:mm:ss')" if spark else f"strftime({c}, '%Y-%m-%d %H:%M:%S')")
        elif kind == "array<string>":
            parts.append(f"array_join({c}, ',')" if spark else f"array_to_string({c}, ',')")
        else:
            parts.append(f"cast({c} as string)")
    text = "concat(" + ", '|', ".join(f"coalesce({p}, 'none')" for p in parts) + ")"
    return F.expr(text) if spark else text
