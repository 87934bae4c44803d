"""Scans, sinks, projections and predicates over the corpus."""

import uuid

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import relations as R
from quire.operators import search
from quire.operators.lineage import cut, shared_folder
from quire.plans.registry import query
from quire.sources import blob_store, blobs, model
from quire.sources.corpus import Corpus
from quire.sources.tables import TERMINAL, append, conform, explode_fields, read, retain

AS_OF = "2024-01-20 12:00:00"


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def as_of(text: str = AS_OF):
    return F.expr(f"timestamp_ntz'{text}'")


def scratch(c: Corpus) -> str:
    """A new folder in the cluster's shared folder."""
    return f"{shared_folder(c.spark)}/tables-{uuid.uuid4().hex}"


@query("select document_id, page, text, length(text)::int as char_count from t_pages")
def scan_pages(c):
    return c.pages.select("document_id", "page", "text", F.length("text").alias("char_count"))


@query("select document_id, sha256, original_filename, size_bytes, tag_id, status, needs_review, document_confidence from t_documents")
def scan_tables(c):
    folder = scratch(c)
    append(conform(c.documents, "documents"), folder, "documents")
    return read(c.spark, folder, "documents").select("document_id", "sha256", "original_filename", "size_bytes", "tag_id", "status", "needs_review", "document_confidence")


@query(" union all ".join(f"select '{name}' as name, md5({model.row_text(name, spark=False)}) as digest from ({model.sql(name)})" for name in model.MODEL))
def scan_every_table(c):
    """Each table of the model written, read back by its declared schema, and its values told by a digest of each row."""
    folder, found = scratch(c), None
    for name in model.MODEL:
        append(model.table(c, name), folder, name)
        rows = read(c.spark, folder, name).select(F.lit(name).alias("name"), F.md5(model.row_text(name, spark=True).cast("binary")).alias("digest"))
        found = rows if found is None else found.unionByName(rows)
    return found


@query("select document_id, version, tag_id, key, value, confidence, page from (select *, 1 as version from t_fields)")
def scan_extractions(c):
    entry = F.struct("key", "value", "confidence", "page", F.lit(None).cast("string").alias("evidence"), F.col("value").isNotNull().alias("valid"), F.expr("cast(array() as array<string>)").alias("validation_errors"))
    nested = c.fields.groupBy("document_id", "tag_id").agg(F.collect_list(entry).alias("fields"))
    folder = scratch(c)
    append(conform(nested.withColumn("version", F.lit(1)), "extractions"), folder, "extractions")
    return explode_fields(read(c.spark, folder, "extractions")).select("document_id", "version", "tag_id", "key", "value", "confidence", "page")


@query("select count(*)::bigint as n, sum(octet_length(encode(coalesce(text, ''))))::bigint as bytes from documents")
def scan_blobs(c):
    """Texts written as blobs under their content keys, and read back: folders are listed and blobs read by tasks."""
    folder = scratch(c)
    blobs.write(c.documents.select(F.concat(T.original_key(F.col("sha256")), F.lit("-"), "document_id").alias("blob_key"), F.coalesce("text", F.lit("")).cast("binary").alias("content")), folder)
    return blobs.scan(c.spark, folder).agg(F.count("*").alias("n"), F.sum(F.length("content")).cast("long").alias("bytes"))


KEY = "'originals/' || substr(sha256, 1, 2) || '/' || sha256"


@query(f"select {KEY} as blob_key, greatest(1, ceil(any_value(size_bytes) / 3000.0))::bigint as ranges, any_value(size_bytes) as bytes, sha256 from t_documents where sha256 is not null group by sha256")
def scan_blob_ranges(c):
    """Texts as blobs, written in parts and read in byte ranges, whose digest one after the other is that of the whole."""
    folder = scratch(c)
    one = c.documents.filter("sha256 is not null").dropDuplicates(["sha256"]).select(T.original_key(F.col("sha256")).alias("blob_key"), F.col("text").cast("binary").alias("bytes"), F.col("size_bytes").alias("size"))
    parts = one.select("blob_key", "size", "bytes", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / 5000))).alias("part"))
    blob_store.put(parts.select("blob_key", "part", F.substring("bytes", F.col("part") * 5000 + 1, F.lit(5000)).alias("content"), "size"), folder)
    return blob_store.digests(blob_store.ranges(c.spark, folder, 3000, 1_000_000))


@query(f"""with new as (select sha256, min(document_id) as document_id from t_documents where sha256 is not null group by sha256),
stored as (select distinct sha256 from t_documents where document_id % 3 = 0 and sha256 is not null)
select {KEY} as blob_key, document_id, case when sha256 in (from stored) then 'exists' when document_id % 7 = 0 then 'rejected' else 'written' end as outcome,
 sha256 in (from stored) or document_id % 7 <> 0 as readable from new""")
def sink_blobs_dedup(c):
    """Blobs are written where their keys are not there yet; some are declared with a wrong size, and rejected."""
    folder = scratch(c)
    docs = c.documents.filter("sha256 is not null").select("document_id", T.original_key(F.col("sha256")).alias("blob_key"), F.col("text").cast("binary").alias("content"), F.col("size_bytes").alias("size"))
    blob_store.put(docs.filter("document_id % 3 = 0").dropDuplicates(["blob_key"]), folder)
    first = blob_store.without_stored(docs, folder).groupBy("blob_key").agg(F.min_by(F.struct("document_id", "content", "size"), "document_id").alias("r")).select("blob_key", "r.*")
    declared = first.withColumn("size", F.when(F.col("document_id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")))
    told = blob_store.put(declared, folder)
    there = blob_store.ranges(c.spark, folder).select("blob_key").distinct().withColumn("_there", F.lit(True))
    ids = docs.groupBy("blob_key").agg(F.min("document_id").alias("document_id"))  # apart from first, whose contents would be shuffled once more
    return told.join(ids, "blob_key").join(there, "blob_key", "left").select("blob_key", "document_id", "outcome", F.coalesce("_there", F.lit(False)).alias("readable"))


@query("""select k.document_id, k.blob_key in (select 'originals/' || substr(sha256, 1, 2) || '/' || sha256 from t_documents where document_id % 2 = 0) as stored
from (select document_id, 'originals/' || substr(sha256, 1, 2) || '/' || sha256 as blob_key from t_documents) k""")
def blob_exists(c):
    docs = c.documents.select("document_id", T.original_key(F.col("sha256")).alias("blob_key"))
    return blobs.exists(docs, docs.filter("document_id % 2 = 0").select("blob_key")).select("document_id", "stored")


@query("select distinct sha256 from t_documents where deleted_at is not null and sha256 not in (select sha256 from t_documents where deleted_at is null and sha256 is not null)")
def blob_gc(c):
    return blobs.collectable(c.documents)


@query("""with new as (select document_id, page, 'new ' || text as text from t_pages where page = 2 union all select document_id, 1000, 'added' from t_documents where document_id % 50 = 0)
select coalesce(n.document_id, o.document_id) as document_id, coalesce(n.page, o.page)::int as page, coalesce(n.text, o.text) as text
from t_pages o full join new n on o.document_id = n.document_id and o.page = n.page""")
def sink_pages_upsert(c):
    new = c.pages.filter("page = 2").withColumn("text", F.concat(F.lit("new "), "text")).unionByName(c.documents.filter("document_id % 50 = 0").select("document_id", F.lit(1000).alias("page"), F.lit("added").alias("text")))
    return R.upsert(c.pages, new, ["document_id", "page"])


@query("""with new as (select document_id, max(version) + 1 as version from t_versions group by document_id union all select document_id, 1 from t_versions where version = 1 and document_id % 10 = 0)
select document_id, version::int as version, 'stored' as outcome from t_versions
union all select document_id, version::int, case when (document_id, version) in (select (document_id, version) from t_versions) then 'refused' else 'appended' end from new""")
def sink_extractions_append(c):
    """Versions are immutable: one that is there already is refused, the others are appended. What is stored is read back."""
    folder = scratch(c)
    append(conform(c.versions, "extraction_versions"), folder, "extraction_versions")
    old = read(c.spark, folder, "extraction_versions").select("document_id", "version")
    new = old.groupBy("document_id").agg((F.max("version") + 1).cast("int").alias("version")).unionByName(old.filter("version = 1 and document_id % 10 = 0"))
    told = cut(R.admit(old, new, ["document_id", "version"], [F.col("version")]))
    append(conform(told.filter("outcome = 'appended'"), "extraction_versions"), folder, "extraction_versions")
    stored = read(c.spark, folder, "extraction_versions").select("document_id", "version")
    fresh = told.filter("outcome = 'appended'").select("document_id", "version", "outcome")
    seen = stored.join(fresh, ["document_id", "version"], "left").withColumn("outcome", F.coalesce("outcome", F.lit("stored")))
    return seen.unionByName(told.filter("outcome = 'refused'").select("document_id", "version", "outcome"))


@query(f"select id, document_id, payload from t_events where created_at > timestamp '{AS_OF}' - interval 10 day")
def sink_raw_responses_ttl(c):
    folder = scratch(c)
    append(c.events.select("id", "document_id", "payload", "created_at"), folder, "raw", at="created_at")
    # The date partitions let the scan skip what has expired.
    rows = c.spark.read.parquet(f"{folder}/raw").filter(F.col("created_at_date") >= F.to_date(as_of() - F.expr("interval 10 days")))
    return retain(rows, "created_at", as_of(), 10).select("id", "document_id", "payload")


@query("""with new as (select document_id, chunk_index, embed_model, 'new ' || title as title, created_at + interval 1 year as created_at from t_chunks where document_id % 4 = 0)
select o.document_id, o.chunk_index, o.embed_model, coalesce(n.title, o.title) as title, strftime(o.created_at, '%Y-%m-%d %H:%M:%S') as created_at
from t_chunks o left join new n on o.document_id = n.document_id and o.chunk_index = n.chunk_index and o.embed_model = n.embed_model""")
def sink_chunks_upsert(c):
    key = ["document_id", "chunk_index", "embed_model"]
    old = c.chunks.select(*key, "title", "created_at")
    new = old.filter("document_id % 4 = 0").withColumns({"title": F.concat(F.lit("new "), "title"), "created_at": F.col("created_at") + F.expr("interval 1 year")})
    return R.upsert(old, new, key, kept=("created_at",)).select(*key, "title", stamp("created_at"))


@query("select strftime(created_at, '%Y-%m-%d') as day, count(*) as n from t_events group by 1")
def sink_events_append(c):
    folder = scratch(c)
    append(c.events, folder, "document_events", at="created_at")
    return c.spark.read.parquet(f"{folder}/document_events").groupBy(F.col("created_at_date").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("select document_id, step, attempt from t_steps where status = 'failed' and attempt >= max_attempts")
def sink_dead_letters(c):
    return c.steps.filter("status = 'failed' and attempt >= max_attempts").select("document_id", "step", "attempt")


@query("""select sha256, min(document_id) as document_id, count(*) as copies, max(size_bytes)::bigint as size_bytes, 'originals/' || substr(sha256, 1, 2) || '/' || sha256 as blob_key, 'text/plain' as mime
from t_documents where text is not null group by sha256""")
def ingest_manifest(c):
    return blobs.manifest(c.documents.filter("text is not null").select("document_id", "original_filename", F.col("text").cast("binary").alias("content")))


#: Mean entries and bytes of an archive that packing aims at, well within the limits of expansion.
PACK_ENTRIES, PACK_BYTES = 250, 64 << 20


@query(f"""with d as (select document_id, coalesce(source, '') as source, coalesce(original_filename, document_id || '.txt') as name, coalesce(text, '') as text from t_documents),
parts as (select source, greatest(ceil(count(*) / {PACK_ENTRIES}), ceil(sum(strlen(text)) / {PACK_BYTES}), 1)::bigint as n from d group by source)
select source || '/' || (('0x' || substr(md5(document_id::varchar), 1, 8))::bigint % n) as archive, name, strlen(text)::int as size, sha256(text) as sha256, null::varchar as problem from d join parts using (source)""")
def expand_archives(c):
    """Documents packed into archives and expanded again under the limits.

    A source has as many archives as its documents and bytes need, so archives (and the tasks that hold
    one each) do not grow with it; a hash of the id deals the documents out."""
    text = F.coalesce("text", F.lit(""))
    docs = c.documents.select("document_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("original_filename", F.concat("document_id", F.lit(".txt"))).alias("name"), text.cast("binary").alias("content"))
    parts = docs.groupBy("source").agg(F.greatest(F.ceil(F.count("*") / PACK_ENTRIES), F.ceil(F.sum(F.length("content")) / PACK_BYTES), F.lit(1)).alias("n"))
    part = F.conv(F.substring(F.md5(F.col("document_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % F.col("n")
    packed = blobs.pack(docs.join(parts, "source").select(F.concat("source", F.lit("/"), part.cast("string")).alias("archive"), "name", "content"))
    return blobs.expand(packed).select("archive", "name", F.length("content").alias("size"), F.sha2("content", 256).alias("sha256"), "problem")


@query("""with entries as (select source || '/' || (document_id % 64) as archive, coalesce(size_bytes, 0) as size, coalesce(size_bytes, 0) // (1 + document_id % 120) as packed, case when document_id % 40 = 0 then 2 else document_id % 2 end::int as depth from t_documents),
told as (select archive, count(*) as entries, sum(size)::bigint as total, max(case when size = 0 then 0 when packed = 0 then 1e9 else size::double / packed end) as ratio, max(depth)::int as depth from entries group by archive)
select archive, entries, total, round(least(ratio, 1e9), 6) as ratio, depth, case when entries > 500 then 'too_many_entries' when total > 100000 then 'too_large' when ratio > 100 then 'ratio' when depth > 1 then 'nested' end as problem from told""")
def archive_limits(c):
    size = F.coalesce("size_bytes", F.lit(0))
    entries = c.documents.select(F.concat("source", F.lit("/"), (F.col("document_id") % 64).cast("string")).alias("archive"), size.alias("size"),
        F.floor(size / (1 + F.col("document_id") % 120)).alias("packed"), F.when(F.col("document_id") % 40 == 0, 2).otherwise(F.col("document_id") % 2).cast("int").alias("depth"))
    return blobs.over_limits(entries, total=100_000).withColumn("ratio", F.round(F.least("ratio", F.lit(1e9)), 6))


@query("""select document_id, 'originals/' || substr(sha256, 1, 2) || '/' || sha256 as original, printf('pages/%s/%05d.png', document_id::varchar, (document_id % 7 + 1)::int) as page, printf('thumbs/%s/%05d.jpg', document_id::varchar, (document_id % 7 + 1)::int) as thumb from t_documents""")
def blob_keys(c):
    page = (F.col("document_id") % 7 + 1).cast("int")
    return c.documents.select("document_id", T.original_key(F.col("sha256")).alias("original"), T.page_key(F.col("document_id"), page).alias("page"), T.page_key(F.col("document_id"), page, True).alias("thumb"))


@query("select document_id, sha256, regexp_full_match(sha256, '[0-9a-f]{64}') as well_formed from t_documents")
def content_hash(c):
    return c.documents.select("document_id", "sha256", F.col("sha256").rlike("^[0-9a-f]{64}$").alias("well_formed"))


@query("select document_id, status from t_documents where deleted_at is null")
def live_documents(c):
    return c.documents.filter("deleted_at is null").select("document_id", "status")


@query("select document_id, sha256 from t_documents where deleted_at is null and sha256 in (select sha256 from t_documents where document_id % 9 = 0)")
def find_by_sha256(c):
    wanted = c.documents.filter("document_id % 9 = 0").select("sha256")
    return c.documents.filter("deleted_at is null").join(wanted, "sha256", "left_semi").select("document_id", "sha256")


@query("select document_id, title, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at from t_documents where deleted_at is null and status = 'pending_review' and needs_review and tag_id = 1 order by created_at desc, document_id desc limit 20 offset 5")
def list_documents(c):
    live = c.documents.filter("deleted_at is null and status = 'pending_review' and needs_review and tag_id = 1")
    return live.orderBy(F.desc("created_at"), F.desc("document_id")).offset(5).limit(20).select("document_id", "title", stamp("created_at"))


@query("select document_id, original_filename from t_documents where deleted_at is null and (original_filename ilike '%SRC1-%' or title ilike '%SRC1-%') and created_at between timestamp '2024-01-01' and timestamp '2024-03-01'")
def list_documents_q(c):
    q = F.col("original_filename").ilike("%SRC1-%") | F.col("title").ilike("%SRC1-%")
    return c.documents.filter("deleted_at is null").filter(q & F.col("created_at").between(as_of("2024-01-01 00:00:00"), as_of("2024-03-01 00:00:00"))).select("document_id", "original_filename")


@query("select document_id, tag_id, status from t_chunks where tag_id in (1, 3) and status in ('validated', 'completed', 'failed') and created_at >= timestamp '2024-01-01 01:00:00' and created_at <= timestamp '2024-01-20'")
def search_filters(c):
    kept = search.filters(tag_ids=[1, 3], document_ids=[], statuses=["validated", "completed", "failed"], since=as_of("2024-01-01 01:00:00"), until=as_of("2024-01-20 00:00:00"))
    return c.chunks.filter(kept).select("document_id", "tag_id", "status")


@query("select document_id, status from t_chunks where status in ('validated', 'completed')")
def default_status_filter(c):
    return c.chunks.filter(search.filters(statuses=search.SEARCHABLE)).select("document_id", "status")


@query("select t.slug, t.name, count(d.document_id) as n from t_tags t left join t_documents d on d.tag_id = t.tag_id where t.is_active group by all")
def active_tags(c):
    return c.tags.filter("is_active").join(c.documents.select("tag_id", "document_id"), "tag_id", "left").groupBy("slug", "name").agg(F.count("document_id").alias("n"))


@query("select d.document_id, t.tag_id from t_documents d join t_tags t on lower(t.slug) = lower(upper(d.tag_slug))")
def tag_by_slug(c):
    docs = c.documents.select("document_id", F.upper("tag_slug").alias("asked"))
    return docs.join(c.tags, F.lower("slug") == F.lower("asked")).select("document_id", "tag_id")


@query("select o_orderkey, c_custkey as user_id from orders join customer on lower(c_name || '@Example.com') = lower(upper('CUSTOMER#' || lpad(o_custkey::varchar, 9, '0') || '@example.COM'))")
def user_by_email(c):
    """Addresses are compared without regard to case."""
    users = c.table("customer").select(F.col("c_custkey").alias("user_id"), F.concat("c_name", F.lit("@Example.com")).alias("email"))
    asked = c.table("orders").select("o_orderkey", F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("@example.COM")).alias("email"))
    return asked.withColumn("email", F.lower("email")).join(users.withColumn("email", F.lower("email")), "email").select("o_orderkey", "user_id")


@query("select webhook_id, array_to_string(events, ',') as events from t_webhooks where is_active")
def active_webhooks(c):
    return c.webhooks.filter("is_active").select("webhook_id", F.array_join("events", ",").alias("events"))


@query("""select document_id, case document_id % 4 when 0 then 'application/pdf' when 1 then 'image/png' when 2 then 'text/plain' else 'application/octet-stream' end as mime,
case document_id % 4 when 0 then 'pdf' when 1 then 'image' else 'unsupported' end as container from t_documents""")
def sniff_mime(c):
    head = F.when(F.col("document_id") % 4 == 0, F.lit("%PDF-1.7")).when(F.col("document_id") % 4 == 1, F.unhex(F.lit("89504E470D0A1A0A")).cast("string")).otherwise("")
    name = F.when(F.col("document_id") % 4 == 3, F.lit("x.bin")).otherwise(F.col("original_filename"))
    raw = F.when(F.col("document_id") % 4 == 1, F.unhex(F.lit("89504E470D0A1A0A"))).otherwise(F.concat(head, F.coalesce("text", F.lit(""))).cast("binary"))
    mime = T.sniff_mime(raw, name)
    return c.documents.select("document_id", mime.alias("mime"), T.container_class(mime).alias("container"))


@query("select document_id, case lang when 'en' then 'application/pdf' when 'de' then 'text/plain' else 'image/tiff' end in ('application/pdf', 'image/png', 'image/jpeg', 'image/tiff', 'application/zip') as allowed from (select doc_id as document_id, lang from documents)")
def allowed_mime(c):
    mime = F.when(F.col("tag_slug") == "en", "application/pdf").when(F.col("tag_slug") == "de", "text/plain").otherwise("image/tiff")
    return c.documents.select("document_id", mime.isin(*T.ALLOWED).alias("allowed"))


@query(r"select document_id, page, length(text) >= 120 and length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))::double / length(text) >= 0.55 as usable from t_pages")
def usable_text_layer(c):
    return c.pages.select("document_id", "page", T.usable_text(F.col("text")).alias("usable"))


@query("select id, document_id, step, step <> 'store' as accepted from t_events where event_type = 'uploaded'")
def reprocess_guard(c):
    return c.events.filter("event_type = 'uploaded'").select("id", "document_id", "step", (F.col("step") != "store").alias("accepted"))


@query("select id, (payload->>'$.k')::int as k from t_events")
def metadata_path(c):
    return c.events.select("id", F.get_json_object("payload", "$.k").cast("int").alias("k"))


@query("""select document_id, case when document_id % 5 = 0 then 'failed' else status end as status, case when document_id % 10 = 0 then null else title end as title, document_confidence from t_documents""")
def patch_columns(c):
    rows = c.documents.select("document_id", "status", "title", "document_confidence")
    p = rows.filter("document_id % 5 = 0").select("document_id", F.lit("status").alias("column"), F.lit("failed").alias("value"))
    p = p.unionByName(rows.filter("document_id % 10 = 0").select("document_id", F.lit("title").alias("column"), F.lit(None).cast("string").alias("value")))
    return R.patch(rows, p, "document_id")


@query("select document_id, status from t_documents where document_id in (select doc_id from labels where toxic = 1)")
def point_lookup(c):
    ids = c.table("labels").filter("toxic = 1").select(F.col("doc_id").alias("document_id"))
    return c.documents.join(ids, "document_id", "left_semi").select("document_id", "status")


@query("select document_id, page, printf('pages/%s/%05d.png', document_id::varchar, page) as blob_key, length(text)::int as char_count, length(trim(text)) = 0 as is_blank from t_pages")
def page_index(c):
    return c.pages.select("document_id", "page", T.page_key(F.col("document_id"), F.col("page")).alias("blob_key"), F.length("text").alias("char_count"), (F.length(F.trim("text")) == 0).alias("is_blank"))


@query("select document_id, status from t_documents where status not in ('completed', 'failed', 'quarantined')")
def in_flight(c):
    return c.documents.filter(~F.col("status").isin(*TERMINAL)).select("document_id", "status")
