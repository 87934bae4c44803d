"""Corpus tables derived from the driver's tables, each in Spark and as DuckDB SQL.

The derivations stand in for a corpus: what they make grows with the tables they read.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.sources.tables import DOCUMENT_STATUS, STEP_ORDER

STATUSES = ", ".join(f"'{s}'" for s in DOCUMENT_STATUS)
STEPS = ", ".join(f"'{s}'" for s in STEP_ORDER)
EVENTS = "case event_type when 'signup' then 'uploaded' when 'view' then 'step_started' when 'click' then 'step_succeeded' when 'error' then 'step_failed' else 'validated' end"

TAG_ROWS = "(1, 'en', 'Invoice', 2, true, 0.8), (2, 'fr', 'Facture', 1, true, null), (3, 'de', 'Rechnung', 3, true, 0.5), (4, 'es', 'Factura', 1, false, 0.9)"
TAG_COLUMNS = "tag_id, slug, name, version, is_active, auto_approve_threshold"
FIELD_ROWS = """(1, 'total', 'Total', 'number', true, 1, null, null, 1000.0, 400000.0, null, null),
(1, 'order_date', 'Date of order', 'date', true, 2, null, null, null, null, null, null),
(1, 'status', 'Status', 'enum', true, 3, 'F|O', null, null, null, null, null),
(1, 'priority', 'Priority', 'string', false, 4, null, '^[1-5]-', null, null, 5, 12),
(1, 'customer', 'Customer', 'string', false, 5, null, '^Customer', null, null, null, 30),
(2, 'total', 'Total', 'number', true, 1, null, null, 0.0, null, null, null),
(2, 'paid', 'Payé', 'boolean', false, 2, null, null, null, null, null, null),
(3, 'total', 'Summe', 'integer', true, 1, null, null, 0.0, 10.0, null, null),
(3, 'items', 'Posten', 'array', false, 2, null, null, null, null, null, null)"""
FIELD_COLUMNS = "tag_id, key, label, field_type, is_required, position, enum_values, regex, min_value, max_value, min_length, max_length"

#: DuckDB SQL of each derived table; tables named t_* are put before a query that uses them.
SQL = {
    "t_tags": f"select tag_id::bigint as tag_id, slug, name, version, is_active, auto_approve_threshold::double as auto_approve_threshold from (values {TAG_ROWS}) t({TAG_COLUMNS})",
    "t_tag_fields": f"select tag_id::bigint as tag_id, key, label, field_type, is_required, position, string_split(enum_values, '|') as enum_values, regex, min_value::double as min_value, max_value::double as max_value, min_length, max_length from (values {FIELD_ROWS}) t({FIELD_COLUMNS})",
    "t_documents": f"""select doc_id as document_id, text, sha256(text) as sha256, source || '-' || doc_id || '.txt' as original_filename, source as title, source,
    octet_length(encode(text))::bigint as size_bytes, lang as tag_slug, case lang when 'en' then 1 when 'fr' then 2 when 'de' then 3 else 4 end::bigint as tag_id,
    list_extract([{STATUSES}], (doc_id % 7 + 1)::int) as status, doc_id % 7 = 2 as needs_review, round((doc_id * 37 % 1000) / 1000.0, 3)::double as document_confidence,
    timestamp '2024-01-01' + to_minutes(doc_id) as created_at, case when doc_id % 11 = 0 then timestamp '2024-06-01' + to_minutes(doc_id) end as deleted_at from documents""",
    "t_pages": """select document_id, (i + 1)::int as page, array_to_string(lines[i * 5 + 1:i * 5 + 5], chr(10)) as text from
    (select doc_id as document_id, lines, unnest(range(0, (len(lines) + 4) // 5)) as i from (select doc_id, string_split(text, chr(10)) as lines from documents))""",
    "t_chunks": """select vec_id as document_id, 0 as chunk_index, text, embedding::double[] as embedding, 'model-' || label % 2 as embed_model, len(embedding)::int as embed_dim,
    d.tag_id, d.tag_slug, d.status, d.title, d.created_at from embeddings join t_documents d on vec_id = d.document_id""",
    "t_events": f"select event_id as id, user_id as document_id, list_extract([{STEPS}], (event_id % 6 + 1)::int) as step, {EVENTS} as event_type, value, props as payload, ts as created_at from events",
    "t_steps": f"""select document_id, step, arg_max(case event_type when 'uploaded' then 'pending' when 'step_started' then 'running' when 'step_succeeded' then 'succeeded' when 'step_failed' then 'failed' else 'skipped' end, id) as status,
    least(count(*) filter (event_type = 'step_started'), 3)::int as attempt, 3 as max_attempts, max(created_at) filter (event_type = 'step_started') as started_at, max(created_at) as updated_at,
    arg_max(value, id) as value, (list_position([{STEPS}], step))::int as step_pos from t_events group by document_id, step""",
    "t_fields": """select o_orderkey as document_id, 1::bigint as tag_id, key, case when (o_orderkey * k) % 17 = 0 then null else value end as value, ((o_orderkey * 7 + k * 13) % 101) / 100.0::double as confidence,
    (o_orderkey % 3 + 1)::int as page, o_custkey from (select o_orderkey, o_custkey, unnest([1, 2, 3, 4, 5]) as k, unnest(['total', 'order_date', 'status', 'priority', 'customer']) as key,
    unnest([round(o_totalprice)::bigint::varchar, strftime(o_orderdate, '%Y-%m-%d'), o_orderstatus, o_orderpriority, c_name]) as value from orders join customer on o_custkey = c_custkey)""",
    "t_versions": """select l_orderkey as document_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate)::int as version,
    case l_linestatus when 'O' then 'model' else 'human' end as source, round(1 - l_discount * 5, 3) as document_confidence, (l_linenumber % 3 + 1)::int as tag_version, 1 + l_suppkey % 4 as tag_id, l_shipdate as created_at from lineitem""",
    "t_webhooks": """select s_suppkey as webhook_id, s_acctbal > 0 as is_active, list_filter(['uploaded', 'step_failed', 'validated'], lambda e: (s_suppkey + len(e)) % 2 = 0) as events, s_nationkey from supplier""",
    "t_deliveries": """select event_id as id, user_id % (select count(*) from supplier) + 1 as webhook_id, event_type, case when event_type in ('error', 'view') then 'failed' else 'delivered' end as status,
    (event_id % 6 + 1)::int as attempt, ts as created_at from events""",
}


class Corpus:
    """The derived tables of one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def tags(self) -> DataFrame:
        return self.spark.sql(f"select cast(tag_id as bigint) as tag_id, slug, name, version, is_active, cast(auto_approve_threshold as double) as auto_approve_threshold from values {TAG_ROWS} t({TAG_COLUMNS})")

    @cached_property
    def tag_fields(self) -> DataFrame:
        return self.spark.sql(f"select cast(tag_id as bigint) as tag_id, key, label, field_type, is_required, position, split(enum_values, '[|]') as enum_values, cast(regex as string) as regex, cast(min_value as double) as min_value, cast(max_value as double) as max_value, cast(min_length as int) as min_length, cast(max_length as int) as max_length from values {FIELD_ROWS} t({FIELD_COLUMNS})")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents").selectExpr(
            "doc_id as document_id", "text", "sha2(text, 256) as sha256", "concat(source, '-', doc_id, '.txt') as original_filename", "source as title", "source",
            "cast(octet_length(text) as bigint) as size_bytes", "lang as tag_slug", "cast(case lang when 'en' then 1 when 'fr' then 2 when 'de' then 3 else 4 end as bigint) as tag_id",
            f"element_at(array({STATUSES}), cast(doc_id % 7 + 1 as int)) as status", "doc_id % 7 = 2 as needs_review", "round((doc_id * 37 % 1000) / 1000.0D, 3) as document_confidence",
            "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(doc_id as int), 0) as created_at",
            "case when doc_id % 11 = 0 then timestamp_ntz'2024-06-01' + make_dt_interval(0, 0, cast(doc_id as int), 0) end as deleted_at")

    @cached_property
    def pages(self) -> DataFrame:
        lines = self.table("documents").select(F.col("doc_id").alias("document_id"), F.split("text", "\n").alias("lines"))
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 5).cast("int")), lambda i: F.array_join(F.slice("lines", i * 5 + 1, F.lit(5)), "\n"))
        return lines.filter("lines is not null").select("document_id", F.posexplode(parts).alias("page", "text")).withColumn("page", F.col("page") + 1)

    @cached_property
    def chunks(self) -> DataFrame:
        vectors = self.table("embeddings").selectExpr("vec_id as document_id", "0 as chunk_index", "cast(embedding as array<double>) as embedding", "concat('model-', label % 2) as embed_model", "size(embedding) as embed_dim")
        return vectors.join(self.documents.select("document_id", "text", "tag_id", "tag_slug", "status", "title", "created_at"), "document_id")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").selectExpr("event_id as id", "user_id as document_id", f"element_at(array({STEPS}), cast(event_id % 6 + 1 as int)) as step", f"{EVENTS} as event_type", "value", "props as payload", "ts as created_at")

    @cached_property
    def steps(self) -> DataFrame:
        status = "case event_type when 'uploaded' then 'pending' when 'step_started' then 'running' when 'step_succeeded' then 'succeeded' when 'step_failed' then 'failed' else 'skipped' end"
        return self.events.groupBy("document_id", "step").agg(
            F.expr(f"max_by({status}, id)").alias("status"), F.expr("cast(least(count_if(event_type = 'step_started'), 3) as int)").alias("attempt"), F.lit(3).alias("max_attempts"),
            F.expr("max(created_at) filter (where event_type = 'step_started')").alias("started_at"), F.max("created_at").alias("updated_at"), F.expr("max_by(value, id)").alias("value"),
        ).withColumn("step_pos", F.expr(f"cast(array_position(array({STEPS}), step) as int)"))

    @cached_property
    def fields(self) -> DataFrame:
        joined = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        each = joined.selectExpr("o_orderkey", "o_custkey", "inline(array(named_struct('k', 1, 'key', 'total', 'value', cast(cast(round(o_totalprice) as bigint) as string)), named_struct('k', 2, 'key', 'order_date', 'value', date_format(o_orderdate, 'yyyy-MM-dd')), named_struct('k', 3, 'key', 'status', 'value', o_orderstatus), named_struct('k', 4, 'key', 'priority', 'value', o_orderpriority), named_struct('k', 5, 'key', 'customer', 'value', c_name)))")
        return each.selectExpr("o_orderkey as document_id", "cast(1 as bigint) as tag_id", "key", "case when (o_orderkey * k) % 17 = 0 then null else value end as value", "((o_orderkey * 7 + k * 13) % 101) / 100.0D as confidence", "cast(o_orderkey % 3 + 1 as int) as page", "o_custkey")

    @cached_property
    def versions(self) -> DataFrame:
        order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
        return self.table("lineitem").withColumn("version", F.row_number().over(order)).selectExpr(
            "l_orderkey as document_id", "version", "case l_linestatus when 'O' then 'model' else 'human' end as source", "round(1 - l_discount * 5, 3) as document_confidence",
            "cast(l_linenumber % 3 + 1 as int) as tag_version", "1 + l_suppkey % 4 as tag_id", "l_shipdate as created_at")

    @cached_property
    def webhooks(self) -> DataFrame:
        return self.table("supplier").selectExpr("s_suppkey as webhook_id", "s_acctbal > 0 as is_active", "filter(array('uploaded', 'step_failed', 'validated'), e -> (s_suppkey + length(e)) % 2 = 0) as events", "s_nationkey")

    @cached_property
    def deliveries(self) -> DataFrame:
        n = self.table("supplier").count()
        return self.table("events").selectExpr("event_id as id", f"user_id % {n} + 1 as webhook_id", "event_type", "case when event_type in ('error', 'view') then 'failed' else 'delivered' end as status", "cast(event_id % 6 + 1 as int) as attempt", "ts as created_at")


def with_tables(sql: str) -> str:
    """A DuckDB query with the derived tables that it names put before it."""
    used, todo = [], [sql]
    while todo:
        text = todo.pop()
        for name in SQL:
            if name in text and name not in used:
                used.append(name)
                todo.append(SQL[name])
    order = [n for n in SQL if n in used]
    if not order:
        return sql
    head = ", ".join(f"{n} as ({SQL[n]})" for n in order)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {head}, {body[len('with recursive '):]}"
    return f"with {head}, {body[5:]}" if body.lower().startswith("with ") else f"with {head} {body}"
