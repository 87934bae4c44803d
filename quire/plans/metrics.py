"""Aggregates and windows over the corpus: confidence, metrics, histories."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import values as V
from quire.operators import versions as VS
from quire.operators.lineage import cut
from quire.operators.relations import admit
from quire.plans.registry import query
from quire.plans.tables import AS_OF, as_of, scratch
from quire.sources.tables import STEP_ORDER, append, conform, read

STEPS = ", ".join(f"'{s}'" for s in STEP_ORDER)


@query("select document_id, count(*) as n, count(distinct embed_model) as models from t_chunks group by document_id")
def chunk_count(c):
    return c.chunks.groupBy("document_id").agg(F.count("*").alias("n"), F.countDistinct("embed_model").alias("models"))


@query("select o_orderkey as document_id, (coalesce(max(version), 0) + 1)::int as next_version from orders left join t_versions on document_id = o_orderkey group by o_orderkey")
def next_version(c):
    have = c.versions.groupBy("document_id").agg(F.max("version").alias("v"))
    asked = c.table("orders").select(F.col("o_orderkey").alias("document_id"))
    return asked.join(have, "document_id", "left").select("document_id", (F.coalesce("v", F.lit(0)) + 1).cast("int").alias("next_version"))


#: Fields checked against their specifications; what the rules find is used by several queries.
CHECKED = r"""checked as (select document_id, key, value, f.confidence, is_required, auto_approve_threshold,
 list_filter([case when is_required and value is null then 'required' end,
  case when field_type = 'date' and value is not null and try_strptime(value, '%Y-%m-%d') is null then 'not a date' end,
  case when enum_values is not null and value is not null and not list_contains(enum_values, value) then 'not allowed' end,
  case when regex is not null and value is not null and not regexp_matches(value, regex) then 'pattern' end,
  case when field_type in ('number', 'integer') and (try_cast(regexp_replace(value, '[^0-9.\-]', '', 'g') as double) < min_value or try_cast(regexp_replace(value, '[^0-9.\-]', '', 'g') as double) > max_value) then 'out of range' end,
  case when length(value) < min_length or length(value) > max_length then 'length' end], lambda e: e is not null) as errors
 from t_fields f join t_tag_fields s using (tag_id, key) join t_tags using (tag_id)),
adjusted as (select *, case when is_required and value is null then 0.0 when len(errors) > 0 then least(confidence, 0.4) else confidence end as adj from checked),
scored as (select document_id, any_value(auto_approve_threshold) as threshold, bool_or(is_required and value is null) as missing, bool_or(len(errors) > 0) as invalid, min(adj) as weakest,
 case when bool_or(is_required and len(errors) > 0) then least(round(sum(adj * case when is_required then 2 else 1 end) / sum(case when is_required then 2 else 1 end), 6), 0.5)
 else round(sum(adj * case when is_required then 2 else 1 end) / sum(case when is_required then 2 else 1 end), 6) end as document_confidence,
 count(*) as fields_total, count(value) as populated, count(*) filter (len(errors) > 0) as invalid_fields from adjusted group by document_id)"""


def checked(c):
    # Specifications are a small dimension: the optimiser broadcasts them while their size allows.
    f = c.fields.join(c.tag_fields, ["tag_id", "key"]).join(c.tags.select("tag_id", "auto_approve_threshold"), "tag_id")
    value = F.col("value")
    found = V.errors(
        V.check_required(value, F.col("is_required")), V.check_date(value, F.col("field_type")), V.check_enum(value, F.col("enum_values")), V.check_regex("value", "regex"),
        V.check_range(value, F.col("field_type"), F.col("min_value"), F.col("max_value")), V.check_length(value, F.col("min_length"), F.col("max_length")))
    f = f.withColumn("errors", found)
    return f.withColumn("adj", V.adjusted(F.col("confidence"), value, F.col("is_required"), F.size("errors") > 0))


def scored(c):
    weight = F.when(F.col("is_required"), 2).otherwise(1)
    agg = checked(c).groupBy("document_id").agg(
        F.first("auto_approve_threshold").alias("threshold"), F.bool_or(F.col("is_required") & F.col("value").isNull()).alias("missing"), F.bool_or(F.size("errors") > 0).alias("invalid"),
        F.min("adj").alias("weakest"), F.round(F.sum(F.col("adj") * weight) / F.sum(weight), 6).alias("mean"), F.bool_or(F.col("is_required") & (F.size("errors") > 0)).alias("capped"),
        F.count("*").alias("fields_total"), F.count("value").alias("populated"), F.count_if(F.size("errors") > 0).alias("invalid_fields"))
    return agg.withColumn("document_confidence", F.when(F.col("capped"), F.least("mean", F.lit(0.5))).otherwise(F.coalesce("mean", F.lit(1.0))))


@query(f"with {CHECKED} select document_id, document_confidence from scored")
def document_confidence(c):
    return scored(c).select("document_id", "document_confidence")


@query(f"with {CHECKED} select document_id, weakest from scored")
def weakest_link(c):
    return scored(c).select("document_id", "weakest")


@query(f"with {CHECKED} select document_id, fields_total, populated, invalid_fields from scored")
def extraction_metrics(c):
    return scored(c).select("document_id", "fields_total", "populated", "invalid_fields")


@query(f"with {CHECKED} select document_id, key, array_to_string(errors, ',') as errors, adj as confidence from adjusted where len(errors) > 0")
def validation_errors(c):
    return checked(c).filter(F.size("errors") > 0).select("document_id", "key", F.array_join("errors", ",").alias("errors"), F.col("adj").alias("confidence"))


for _rule, _text in (("required", "required"), ("date_parseable", "not a date"), ("enum", "not allowed"), ("regex", "pattern"), ("range", "out of range"), ("length", "length")):
    def _check(c, text=_text):
        return checked(c).filter(F.array_contains("errors", text)).select("document_id", "key", "value")

    _check.__name__ = f"check_{_rule}"
    query(f"with {CHECKED} select document_id, key, value from checked where list_contains(errors, '{_text}')")(_check)


@query(f"with {CHECKED} select document_id, key, adj as confidence from adjusted")
def adjust_confidence(c):
    return checked(c).select("document_id", "key", F.col("adj").alias("confidence"))


@query(f"""with {CHECKED} select document_id, case when threshold is null then 'pending_review:no_threshold' when missing then 'pending_review:missing' when invalid then 'pending_review:invalid'
when document_confidence < threshold then 'pending_review:document_confidence' when weakest < threshold then 'pending_review:field_confidence' else 'validated:ok' end as decision from scored""")
def review_decision(c):
    return scored(c).select("document_id", V.decision(F.col("threshold"), F.col("missing"), F.col("invalid"), F.col("document_confidence"), F.col("weakest")).alias("decision"))


@query(f"""with {CHECKED} select document_id, 'approved' as decision, true as auto from scored where threshold is not null and not missing and not invalid and document_confidence >= threshold and weakest >= threshold""")
def auto_approve(c):
    verdict = V.decision(F.col("threshold"), F.col("missing"), F.col("invalid"), F.col("document_confidence"), F.col("weakest"))
    return scored(c).filter(verdict == "validated:ok").select("document_id", F.lit("approved").alias("decision"), F.lit(True).alias("auto"))


OCR = r"""ocr as (select document_id, page, length(text) as chars, length(trim(text)) = 0 as blank, case when length(text) >= 120 and length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))::double / length(text) >= 0.55 then 'text_layer'
 when (document_id + page) % 3 = 0 then 'vlm' when (document_id + page) % 3 = 1 then 'tesseract' else 'none' end as source from t_pages)"""


def ocr_pages(c):
    n = (F.col("document_id") + F.col("page")) % 3
    source = F.when(T.usable_text(F.col("text")), "text_layer").when(n == 0, "vlm").when(n == 1, "tesseract").otherwise("none")
    return c.pages.select("document_id", "page", "text", F.length("text").alias("chars"), (F.length(F.trim("text")) == 0).alias("blank"), source.alias("source"))


@query(f"""with {OCR} select document_id, count(*) as pages, count(*) filter (source = 'text_layer') as text_layer, count(*) filter (source = 'vlm') as vlm, count(*) filter (source = 'tesseract') as tesseract,
count(*) filter (blank) as blank, count(*) filter (source = 'none') as failed, sum(chars)::bigint as total_chars from ocr group by document_id""")
def ocr_metrics(c):
    counts = [F.count_if(F.col("source") == s).alias(s) for s in ("text_layer", "vlm", "tesseract")]
    return ocr_pages(c).groupBy("document_id").agg(F.count("*").alias("pages"), *counts, F.count_if("blank").alias("blank"), F.count_if(F.col("source") == "none").alias("failed"), F.sum("chars").cast("long").alias("total_chars"))


@query(f"with {OCR} select document_id, case when count(*) filter (source = 'none') > 0.5 * count(*) then 'failed' else 'succeeded' end as outcome from ocr group by document_id")
def ocr_step_outcome(c):
    return ocr_pages(c).groupBy("document_id").agg(F.when(F.count_if(F.col("source") == "none") > 0.5 * F.count("*"), "failed").otherwise("succeeded").alias("outcome"))


@query("select source, count(*)::bigint as children, sum(size_bytes)::bigint as bytes, sum(pages)::bigint as pages from t_documents join (select document_id, count(*) as pages from t_pages group by document_id) using (document_id) group by source")
def decompose_metrics(c):
    pages = c.pages.groupBy("document_id").agg(F.count("*").alias("pages"))
    return c.documents.join(pages, "document_id").groupBy("source").agg(F.count("*").alias("children"), F.sum("size_bytes").alias("bytes"), F.sum("pages").alias("pages"))


@query("select embed_model, count(*) as chunks, sum(ceil(length(text) / 4.0))::bigint as tokens, ceil(count(*) / 32.0)::bigint as batches, count(*) filter (length(text) < 200) as skipped from t_chunks group by embed_model")
def embed_metrics(c):
    return c.chunks.groupBy("embed_model").agg(F.count("*").alias("chunks"), F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"), F.ceil(F.count("*") / 32.0).cast("long").alias("batches"), F.count_if(F.length("text") < 200).alias("skipped"))


@query("select coalesce(step, 'all') as step, coalesce(status, 'all') as status, count(*) as n from t_steps group by rollup (step, status)")
def status_counts(c):
    return c.steps.rollup("step", "status").agg(F.count("*").alias("n")).select(F.coalesce("step", F.lit("all")).alias("step"), F.coalesce("status", F.lit("all")).alias("status"), "n")


@query("select step, count(*) filter (status = 'pending') as pending, max(date_diff('microsecond', updated_at, timestamp '2024-02-01') // 1000000) filter (status = 'pending')::bigint as oldest_s from t_steps group by step")
def queue_depth(c):
    age = F.floor(V.duration_ms(F.col("updated_at"), as_of("2024-02-01 00:00:00")) / 1000)
    return c.steps.groupBy("step").agg(F.count_if(F.col("status") == "pending").alias("pending"), F.max(F.when(F.col("status") == "pending", age)).cast("long").alias("oldest_s"))


@query("select step, count(*) as n, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, count(*) filter (value < 10) as under_10, count(*) filter (value >= 10 and value < 100) as under_100, count(*) filter (value >= 100) as rest from t_events where event_type = 'step_succeeded' group by step")
def step_durations(c):
    done = c.events.filter("event_type = 'step_succeeded'")
    return done.groupBy("step").agg(
        F.count("*").alias("n"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"),
        F.count_if(F.col("value") < 10).alias("under_10"), F.count_if((F.col("value") >= 10) & (F.col("value") < 100)).alias("under_100"), F.count_if(F.col("value") >= 100).alias("rest"))


@query("select step, count(*) filter (event_type = 'step_started') as started, count(*) filter (event_type = 'step_succeeded') as succeeded, count(*) filter (event_type = 'step_failed') as failed, count(*) filter (event_type = 'uploaded') as uploaded from t_events group by step")
def step_counters(c):
    kinds = {"started": "step_started", "succeeded": "step_succeeded", "failed": "step_failed", "uploaded": "uploaded"}
    return c.events.groupBy("step").agg(*[F.count_if(F.col("event_type") == k).alias(n) for n, k in kinds.items()])


@query("select coalesce(tag_slug, 'all') as tag, coalesce(floor(document_confidence * 10)::bigint, -1) as band, count(*) as n, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') as oldest from t_documents where status = 'pending_review' group by rollup (tag_slug, floor(document_confidence * 10)::bigint)")
def review_queue_stats(c):
    rows = c.documents.filter("status = 'pending_review'").withColumn("band", F.floor(F.col("document_confidence") * 10))
    return rows.rollup("tag_slug", "band").agg(F.count("*").alias("n"), F.date_format(F.min("created_at"), "yyyy-MM-dd HH:mm:ss").alias("oldest")).select(F.coalesce("tag_slug", F.lit("all")).alias("tag"), F.coalesce("band", F.lit(-1)).alias("band"), "n", "oldest")


@query("select t.slug, count(d.document_id) as n from t_tags t left join (select * from t_documents where size_bytes > 3000) d using (tag_id) group by t.slug")
def tag_document_counts(c):
    counts = c.documents.filter("size_bytes > 3000").groupBy("tag_id").agg(F.count("*").alias("n"))
    return c.tags.join(counts, "tag_id", "left").select("slug", F.coalesce("n", F.lit(0)).alias("n"))


@query("select document_id, max(confidence) as best, string_agg(key, ',' order by confidence desc, key) as hits from t_fields where value is not null group by document_id")
def group_by_document(c):
    listed = c.fields.filter("value is not null").groupBy("document_id").agg(F.max("confidence").alias("best"), F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("s"), "key"))).alias("h"))
    return listed.select("document_id", "best", F.array_join(F.transform("h", lambda x: x["key"]), ",").alias("hits"))


CORRECTIONS = "corrections as (select document_id, key, value as old, value || '!' as new, document_id % 7 <> 0 as ok from t_fields where document_id % 5 = 0 and key in ('status', 'priority'))"


def corrections(c):
    rows = c.fields.filter("document_id % 5 = 0 and key in ('status', 'priority')")
    return rows.select("document_id", "key", F.concat("value", F.lit("!")).alias("value"), (F.col("document_id") % 7 != 0).alias("ok"), F.col("value").alias("old"))


@query(f"with {CORRECTIONS} select key, old, new, count(*) as n from corrections where ok group by all")
def correction_log(c):
    return corrections(c).filter("ok").groupBy("key", "old", F.col("value").alias("new")).agg(F.count("*").alias("n"))


@query("""with corrections as (select document_id, key, value || '!' as value, document_id % 7 <> 0 as ok from t_fields where document_id % 5 = 0 and key in ('status', 'priority')),
good as (select document_id from corrections group by document_id having bool_and(ok))
select f.document_id, f.key, case when k.key is not null then k.value else f.value end as value, case when k.key is not null then 1.0 else f.confidence end as confidence, case when k.key is not null then f.value end as was, k.key is not null as corrected
from t_fields f join good using (document_id) left join corrections k on f.document_id = k.document_id and f.key = k.key""")
def apply_corrections(c):
    return VS.corrected(c.fields.select("document_id", "key", "value", "confidence"), corrections(c).select("document_id", "key", "value", "ok"))


@query("select webhook_id, count(*) as attempts, count(*) filter (status = 'delivered') as delivered, arg_max(status, id) as last_status from t_deliveries group by webhook_id")
def delivery_stats(c):
    return c.deliveries.groupBy("webhook_id").agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == "delivered").alias("delivered"), F.max_by("status", "id").alias("last_status"))


TYPES = " ".join(f"when '{k}' then '{v}'" for k, v in V.TYPE_SCHEMAS.items())


@query(f"""select d.document_id, s.body from t_documents d join (select tag_id, '{{"properties":{{' || string_agg('"' || key || '":' || case field_type {TYPES} end, ',' order by key) || '}}}}' as body from t_tag_fields group by tag_id) s using (tag_id)""")
def schema_object(c):
    return c.documents.join(schemas(c), "tag_id").select("document_id", "body")


def schemas(c):
    parts = F.array_sort(F.collect_list(F.struct("key", V.type_schema(F.col("field_type")).alias("s"))))
    text = F.array_join(F.transform(parts, lambda p: F.concat(F.lit('"'), p["key"], F.lit('":'), p["s"])), ",")
    return c.tag_fields.groupBy("tag_id").agg(F.concat(F.lit('{"properties":{'), text, F.lit("}}")).alias("body"))


@query(f"""select d.document_id, s.hash from t_documents d join (select tag_id, sha256('{{"properties":{{' || string_agg('"' || key || '":' || case field_type {TYPES} end, ',' order by key) || '}}}}') as hash from t_tag_fields group by tag_id) s using (tag_id)""")
def schema_hash(c):
    return c.documents.join(schemas(c).select("tag_id", F.sha2("body", 256).alias("hash")), "tag_id").select("document_id", "hash")


@query(f"select f.document_id, f.key, case s.field_type {TYPES} end as fragment from t_fields f join t_tag_fields s using (tag_id, key)")
def field_type_schema(c):
    return c.fields.join(c.tag_fields, ["tag_id", "key"]).select("document_id", "key", V.type_schema(F.col("field_type")).alias("fragment"))


@query("select embed_model, embed_dim, count(*) as n, count(distinct document_id) as documents from t_chunks group by all")
def active_models(c):
    return c.chunks.groupBy("embed_model", "embed_dim").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"))


@query("select document_id, version, source, document_confidence from t_versions qualify version = max(version) over (partition by document_id)")
def latest_version(c):
    return VS.latest(c.versions.select("document_id", "version", "source", "document_confidence"))


@query("select document_id, version, version = max(version) over (partition by document_id) as is_current from t_versions")
def current_pointer(c):
    return VS.flag_current(c.versions.select("document_id", "version"))


@query("select document_id, version, document_confidence, round(document_confidence - lag(document_confidence) over (partition by document_id order by version), 6) as change from t_versions")
def version_history(c):
    before = F.lag("document_confidence").over(W.partitionBy("document_id").orderBy("version"))
    return c.versions.select("document_id", "version", "document_confidence", F.round(F.col("document_confidence") - before, 6).alias("change"))


@query("select document_id, version, was, source as now from (select document_id, version, source, lag(source) over (partition by document_id order by version) as was from t_versions) where was is not null and was <> source")
def version_diff(c):
    was = F.lag("source").over(W.partitionBy("document_id").orderBy("version"))
    return c.versions.select("document_id", "version", was.alias("was"), F.col("source").alias("now")).filter("was is not null and was <> now")


@query("with base as (select document_id, max(version) as v from t_versions where version % 2 = 1 group by document_id), extra as (select * from t_versions where version % 2 = 0) select e.document_id, e.version as asked, (coalesce(v, 0) + row_number() over (partition by e.document_id order by e.version))::int as version from extra e left join base using (document_id)")
def extraction_add(c):
    old, new = c.versions.filter("version % 2 = 1"), c.versions.filter("version % 2 = 0").select("document_id", F.col("version").alias("asked"))
    return VS.number_additions(old, new, ["asked"]).select("document_id", "asked", "version")


@query("with r as (select document_id % 50 as query_id, document_id, confidence, row_number() over (partition by document_id % 50 order by confidence desc, document_id, key) - 1 as rank0 from t_fields) select query_id, document_id, (rank0 + 1)::int as rank, round(1.0::double / (60 + rank0 + 1), 6) as weight from r where rank0 < 100")
def rrf_rank(c):
    rows = c.fields.withColumn("query_id", F.col("document_id") % 50)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("confidence"), "document_id", "key"))
    return rows.withColumn("rank", rank).filter("rank <= 100").select("query_id", "document_id", "rank", F.round(1.0 / (60 + F.col("rank")), 6).alias("weight"))


@query("select tag_id, document_id, lag(document_id) over w as previous, lead(document_id) over w as next from t_documents where needs_review window w as (partition by tag_id order by document_confidence, document_id)")
def review_neighbours(c):
    w = W.partitionBy("tag_id").orderBy("document_confidence", "document_id")
    return c.documents.filter("needs_review").select("tag_id", "document_id", F.lag("document_id").over(w).alias("previous"), F.lead("document_id").over(w).alias("next"))


@query("select document_id, page, used from (select document_id, page, sum(ceil(length(text) / 4.0)::bigint) over (partition by document_id order by page rows unbounded preceding)::bigint as used from t_pages) where used <= 600")
def context_budget(c):
    run = W.partitionBy("document_id").orderBy("page").rowsBetween(W.unboundedPreceding, 0)
    return c.pages.withColumn("used", F.sum(T.estimate_tokens(F.col("text"))).over(run)).filter("used <= 600").select("document_id", "page", "used")


@query("""with islands as (select webhook_id, id, status, sum(case when status = 'delivered' then 1 else 0 end) over (partition by webhook_id order by created_at, id) as island from t_deliveries),
streaks as (select webhook_id, island, count(*) filter (status = 'failed') as n from islands group by all) select webhook_id, max(n)::bigint as longest, max(n) >= 5 as disabled from streaks group by webhook_id""")
def consecutive_failures(c):
    island = F.sum(F.when(F.col("status") == "delivered", 1).otherwise(0)).over(W.partitionBy("webhook_id").orderBy("created_at", "id"))
    streaks = c.deliveries.withColumn("island", island).groupBy("webhook_id", "island").agg(F.count_if(F.col("status") == "failed").alias("n"))
    return streaks.groupBy("webhook_id").agg(F.max("n").alias("longest")).withColumn("disabled", F.col("longest") >= 5)


@query("select document_id, step, id, row_number() over w::int as nth, date_diff('microsecond', lag(created_at) over w, created_at) // 1000 as gap_ms from t_events where event_type = 'step_started' window w as (partition by document_id, step order by created_at, id)".replace("row_number() over w::int", "(row_number() over w)::int"))
def retry_chain(c):
    w = W.partitionBy("document_id", "step").orderBy("created_at", "id")
    return c.events.filter("event_type = 'step_started'").select("document_id", "step", "id", F.row_number().over(w).alias("nth"), V.duration_ms(F.lag("created_at").over(w), F.col("created_at")).alias("gap_ms"))


@query(f"select document_id, max(step_pos) filter (status = 'succeeded') as last_pos, list_extract([{STEPS}], (coalesce(max(step_pos) filter (status = 'succeeded'), 0) + 1)::int) as next_step from t_steps group by document_id")
def step_progress(c):
    last = c.steps.groupBy("document_id").agg(F.max(F.when(F.col("status") == "succeeded", F.col("step_pos"))).alias("last_pos"))
    return last.select("document_id", "last_pos", F.get(F.array(*[F.lit(s) for s in STEP_ORDER]), F.coalesce("last_pos", F.lit(0))).alias("next_step"))


@query("select document_id, id, was, event_type as now, 'document.' || event_type as name from (select document_id, id, event_type, lag(event_type) over (partition by document_id order by created_at, id) as was from t_events) where was is distinct from event_type")
def status_transitions(c):
    was = F.lag("event_type").over(W.partitionBy("document_id").orderBy("created_at", "id"))
    rows = c.events.select("document_id", "id", was.alias("was"), F.col("event_type").alias("now"))
    return rows.filter(~F.col("was").eqNullSafe(F.col("now"))).withColumn("name", F.concat(F.lit("document."), "now"))


@query("select document_id, id, row_number() over (partition by document_id order by created_at, id)::int as place from t_events")
def event_sequence(c):
    return c.events.select("document_id", "id", F.row_number().over(W.partitionBy("document_id").orderBy("created_at", "id")).alias("place"))


@query("select document_id, key, confidence from t_fields qualify row_number() over (partition by document_id order by confidence desc, key) = 1")
def best_chunk_per_document(c):
    rank = F.row_number().over(W.partitionBy("document_id").orderBy(F.desc("confidence"), "key"))
    return c.fields.withColumn("r", rank).filter("r = 1").select("document_id", "key", "confidence")


@query("select document_id, (page - 1) // 4 as chunk_index, min(page)::int as page_from, max(page)::int as page_to, sum(length(text))::bigint as chars from t_pages group by document_id, (page - 1) // 4")
def page_ranges(c):
    return c.pages.groupBy("document_id", F.floor((F.col("page") - 1) / 4).cast("int").alias("chunk_index")).agg(F.min("page").alias("page_from"), F.max("page").alias("page_to"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("""with every as (select webhook_id, status, attempt, created_at from t_deliveries union all select webhook_id, 'pending', attempt + 1, created_at + interval 1 minute from t_deliveries where status = 'failed' and attempt < 6)
select webhook_id, status, count(*) as n, max(attempt)::int as attempt, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') as last from every group by webhook_id, status""")
def delivery_record(c):
    """Each failed delivery with attempts left gets a pending one appended."""
    folder = scratch(c)
    append(conform(c.deliveries, "webhook_deliveries"), folder, "webhook_deliveries")
    failed = read(c.spark, folder, "webhook_deliveries").filter("status = 'failed' and attempt < 6")
    again = cut(failed.withColumns({"status": F.lit("pending"), "attempt": F.col("attempt") + 1, "created_at": F.col("created_at") + F.expr("interval 1 minute")}))
    append(again, folder, "webhook_deliveries")
    stored = read(c.spark, folder, "webhook_deliveries")
    return stored.groupBy("webhook_id", "status").agg(F.count("*").alias("n"), F.max("attempt").alias("attempt"), F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss").alias("last"))


@query("""with asked as (select s_suppkey + 7 as webhook_id, s_suppkey as by_id from supplier union all select s_suppkey + 9, s_suppkey + 1000000 from supplier where s_suppkey % 3 = 0)
select webhook_id, by_id, case when webhook_id in (select webhook_id from t_webhooks) or row_number() over (partition by webhook_id order by by_id) > 1 then 'refused' else 'appended' end as outcome from asked""")
def subscription_add(c):
    """Subscriptions are appended; one that is there, or is asked for a second time, is refused."""
    s = c.table("supplier")
    asked = s.select((F.col("s_suppkey") + 7).alias("webhook_id"), F.col("s_suppkey").alias("by_id")).unionByName(s.filter("s_suppkey % 3 = 0").select((F.col("s_suppkey") + 9).alias("webhook_id"), (F.col("s_suppkey") + 1000000).alias("by_id")))
    return admit(c.webhooks, asked, ["webhook_id"], [F.col("by_id")]).select("webhook_id", "by_id", "outcome")
