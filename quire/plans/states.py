"""State transitions, integrity checks and retrieval over the corpus."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.vectors import cosine, nearest
from quire.operators import relations as R
from quire.operators import deletion, ivf, rules, search, state
from quire.operators import versions as VS
from quire.operators.lineage import cut
from quire.plans.joins import KNN, query_vectors, review_rows, step_rows
from quire.plans.metrics import CHECKED, checked
from quire.plans.registry import query
from quire.plans.tables import as_of, scratch
from quire.sources import model
from quire.sources.tables import STEP_ORDER, append, conform, read

AT = "2024-02-01 00:00:00"
STEPS = ", ".join(f"'{s}'" for s in STEP_ORDER)
FULL = """full_steps as (select document_id, step, step_pos, status, attempt, max_attempts, started_at, case when status in ('succeeded', 'failed') then updated_at end as finished_at,
 case when status = 'succeeded' then floor(value * 100)::bigint end as duration_ms, case when status = 'failed' then 'bad_pdf' end as error_code from t_steps)"""


@query("select coalesce(n.document_id, o.document_id) as document_id, coalesce(n.status, o.status) as status, coalesce(o.title, n.title) as title from t_documents o full join (select document_id + 500 as document_id, 'failed' as status, 'new' as title from t_documents where document_id % 3 = 0) n on n.document_id = o.document_id")
def upsert(c):
    old = c.documents.select("document_id", "status", "title")
    new = old.filter("document_id % 3 = 0").select((F.col("document_id") + 500).alias("document_id"), F.lit("failed").alias("status"), F.lit("new").alias("title"))
    return R.upsert(old, new, ["document_id"], kept=("title",))


@query(f"""with {FULL}, cmd as (select document_id, step, min('worker-' || id % 5) as claimant from t_events where event_type = 'uploaded' group by all)
select s.document_id, s.step, case when c.claimant is not null and status = 'pending' then 'running' else status end as status, (attempt + case when c.claimant is not null and status = 'pending' then 1 else 0 end)::int as attempt,
case when c.claimant is not null then status = 'pending' end as applied from full_steps s left join cmd c using (document_id, step)""")
def claim(c):
    cmd = c.events.filter("event_type = 'uploaded'").select("document_id", "step", F.concat(F.lit("worker-"), F.col("id") % 5).alias("claimant"))
    return state.claim(step_rows(c), cmd, as_of(AT)).select("document_id", "step", "status", "attempt", "applied")


@query(f"""with {FULL} select document_id, step, case when document_id % 2 = 0 and status = 'running' then 'succeeded' else status end as status,
case when document_id % 2 = 0 and status = 'running' then coalesce(case when document_id % 4 = 0 then 77 end, date_diff('microsecond', started_at, timestamp '{AT}') // 1000) else duration_ms end as duration_ms from full_steps""")
def mark_succeeded(c):
    cmd = c.steps.filter("document_id % 2 = 0").select("document_id", "step", F.when(F.col("document_id") % 4 == 0, F.lit(77).cast("long")).alias("duration_ms"))
    return state.succeed(step_rows(c), cmd, as_of(AT)).select("document_id", "step", "status", "duration_ms")


@query(f"with {FULL} select document_id, step, case when document_id % 3 = 0 and status = 'running' then 'failed' else status end as status, case when document_id % 3 = 0 and status = 'running' then 'timeout' else error_code end as error_code, case when document_id % 3 = 0 then status = 'running' end as applied from full_steps")
def mark_failed(c):
    cmd = c.steps.filter("document_id % 3 = 0").select("document_id", "step", F.lit("timeout").alias("error_code"))
    return state.fail(step_rows(c), cmd, as_of(AT)).select("document_id", "step", "status", "error_code", "applied")


@query(f"with {FULL} select document_id, step, case when document_id % 3 = 1 and step_pos >= 3 then 'pending' else status end as status, (case when document_id % 3 = 1 and step_pos >= 3 then 0 else attempt end)::int as attempt, case when document_id % 3 = 1 and step_pos >= 3 then null else error_code end as error_code from full_steps")
def reset_from(c):
    cmd = c.steps.filter("document_id % 3 = 1").select("document_id", F.lit("ocr").alias("from_step")).distinct()
    return state.reset_from(step_rows(c), cmd).select("document_id", "step", "status", "attempt", "error_code")


@query("select document_id, page from t_pages where document_id % 6 not in (0, 1, 2)")
def reprocess_cleanup(c):
    """What a reset from store, decompose or ocr deletes of the pages; later resets leave them."""
    cmd = c.documents.select("document_id", F.get(F.array(*[F.lit(s) for s in STEP_ORDER]), (F.col("document_id") % 6).cast("int")).alias("from_step"))
    gone = cmd.filter(state.position(F.col("from_step")) <= 3)
    return c.pages.join(gone, "document_id", "left_anti").select("document_id", "page")


@query(f"""with {FULL} select document_id, case when document_id % 13 = 0 then 'quarantined' when count(*) filter (status = 'failed') > 0 then 'failed' when count(*) filter (status in ('succeeded', 'skipped')) = 6 then case when document_id % 2 = 0 then 'pending_review' else 'completed' end
when count(*) filter (step <> 'store' and status <> 'pending') = 0 then 'received' else 'processing' end as status from full_steps group by document_id""")
def recompute_status(c):
    flags = c.steps.select("document_id").distinct().select("document_id", (F.col("document_id") % 13 == 0).alias("quarantined"), (F.col("document_id") % 2 == 0).alias("needs_review"))
    return state.document_status(step_rows(c), flags)


@query(f"with {FULL} select document_id, step, case when status = 'running' and started_at < timestamp '{AT}' - interval 60 hour then case when attempt < max_attempts then 'pending' else 'failed' end else status end as status, coalesce(status = 'running' and started_at < timestamp '{AT}' - interval 60 hour, false) as swept from full_steps")
def sweep_stuck(c):
    return state.sweep_stuck(step_rows(c), as_of(AT), minutes=3600).select("document_id", "step", "status", "swept")


@query("select document_id, step from t_steps where status = 'pending' and not (document_id % 2 = 0)")
def orphan_requeue(c):
    queue = c.steps.filter("document_id % 2 = 0").select("document_id", "step")
    return c.steps.filter("status = 'pending'").join(queue, ["document_id", "step"], "left_anti").select("document_id", "step")


@query("select document_id, step, case when status = 'failed' and attempt < 3 then 'pending' when status = 'pending' and document_id % 9 = 0 then 'skipped' when status = 'failed' and document_id % 2 = 0 then 'pending' else status end as status from t_steps")
def retry_single(c):
    """Retry of failed steps with attempts left, cancellation of pending ones, replay of dead letters."""
    failed, pending = F.col("status") == "failed", F.col("status") == "pending"
    after = F.when(failed & (F.col("attempt") < 3), "pending").when(pending & (F.col("document_id") % 9 == 0), "skipped").when(failed & (F.col("document_id") % 2 == 0), "pending").otherwise(F.col("status"))
    return c.steps.select("document_id", "step", after.alias("status"))


@query("select document_id, sha256 in (select sha256 from t_documents where deleted_at is null and document_id % 2 = 0) as deduplicated from t_documents where document_id % 2 = 1")
def document_create(c):
    live = c.documents.filter("deleted_at is null and document_id % 2 = 0").select("sha256").distinct().withColumn("_live", F.lit(True))
    return c.documents.filter("document_id % 2 = 1").join(live, "sha256", "left").select("document_id", F.when(F.col("sha256").isNotNull(), F.coalesce("_live", F.lit(False))).alias("deduplicated"))


@query("""with asked as (select *, row_number() over (partition by sha256 order by document_id) as nth from t_documents where document_id % 2 = 1), live as (select distinct sha256 from t_documents where deleted_at is null and document_id % 2 = 0)
select document_id, case when size_bytes > 20000 then 413 when tag_slug = 'es' then 415 when nth > 1 or sha256 in (select sha256 from live where sha256 is not null) then 200 else 202 end as code from asked""")
def ingest_outcome(c):
    asked, live = c.documents.filter("document_id % 2 = 1"), c.documents.filter("deleted_at is null and document_id % 2 = 0").select("sha256").distinct().withColumn("_live", F.lit(True))
    first = asked.groupBy("sha256").agg(F.min("document_id").alias("first_id"))
    met = asked.join(first, "sha256").join(live, "sha256", "left")
    code = F.when(F.col("size_bytes") > 20000, 413).when(F.col("tag_slug") == "es", 415).when((F.col("document_id") != F.col("first_id")) | F.col("_live"), 200).otherwise(202)
    return met.select("document_id", code.alias("code"))


DECISION = "case when quality = 1 and toxic = 0 then 'approved' when toxic = 1 then 'rejected' else 'corrected' end"


@query(f"""select doc_id as document_id, {DECISION} as decision, false as auto from labels union all
select document_id, 'approved', true from t_documents where document_confidence >= 0.8 and document_id in (select doc_id from labels where quality = 1 and toxic = 0)""")
def validation_add(c):
    """Decisions are only ever appended: first those made automatically, then the reviewers'."""
    folder = scratch(c)
    labels = c.table("labels").select(F.col("doc_id").alias("document_id"), F.expr(DECISION).alias("decision"), F.lit(False).alias("auto"))
    sure = c.documents.filter("document_confidence >= 0.8").select("document_id").join(labels.filter("decision = 'approved'"), "document_id", "left_semi")
    append(conform(sure.select("document_id", F.lit("approved").alias("decision"), F.lit(True).alias("auto")), "validations"), folder, "validations")
    append(conform(labels, "validations"), folder, "validations")
    return read(c.spark, folder, "validations").select("document_id", "decision", "auto")


@query("select document_id, case when l.doc_id is null then status when toxic = 1 then 'quarantined' when status = 'pending_review' then 'completed' else status end as status from t_documents left join labels l on l.doc_id = document_id")
def bulk_approve(c):
    labels = c.table("labels").select(F.col("doc_id").alias("document_id"), "toxic")
    after = F.when(F.col("toxic") == 1, "quarantined").when(F.col("toxic").isNotNull() & (F.col("status") == "pending_review"), "completed").otherwise(F.col("status"))
    return c.documents.join(labels, "document_id", "left").select("document_id", after.alias("status"))


@query(f"""with {FULL} select document_id, step, case when step_pos >= 4 and document_id in (select doc_id from labels where toxic = 1) then 'pending' else status end as status,
case when step_pos >= 4 and document_id in (select doc_id from labels where toxic = 1) then 0 else attempt end as attempt from full_steps""")
def bulk_reject(c):
    """Rejected documents are processed again from extraction on."""
    rejected = c.table("labels").filter("toxic = 1").select(F.col("doc_id").alias("document_id"), F.lit("extract").alias("from_step"))
    return state.reset_from(step_rows(c), rejected).select("document_id", "step", "status", "attempt")


SEEN = "t.version - document_id % 2"


@query(f"""with asked as (select d.document_id, d.tag_id, {SEEN} + 1 as tag_version, t.version from t_documents d join t_tags t using (tag_id))
select document_id, tag_version, case when tag_version > version and row_number() over (partition by tag_id, tag_version order by document_id) = 1 then 'appended' else 'refused' end as outcome from asked""")
def tag_bump(c):
    """Documents ask for the version after the one that they have seen. Snapshots are immutable: one that is there is
    refused, and of several new ones the first is appended."""
    folder = scratch(c)
    there = c.tags.select("tag_id", F.explode(F.sequence(F.lit(1), "version")).alias("version"), F.col("slug").alias("snapshot"))
    append(conform(there, "tag_versions"), folder, "tag_versions")
    asked = c.documents.join(c.tags.select("tag_id", F.col("version").alias("now"), "slug"), "tag_id")
    asked = asked.select("document_id", "tag_id", (F.col("now") - F.col("document_id") % 2 + 1).cast("int").alias("version"), F.col("slug").alias("snapshot"))
    told = cut(R.admit(read(c.spark, folder, "tag_versions"), asked, ["tag_id", "version"], [F.col("document_id")]))
    append(conform(told.filter("outcome = 'appended'"), "tag_versions"), folder, "tag_versions")
    stored = read(c.spark, folder, "tag_versions")
    assert R.duplicate_keys(stored, ["tag_id", "version"]).isEmpty()
    return told.select("document_id", F.col("version").alias("tag_version"), "outcome")


@query("""with asked as (select document_id, case when document_id % 5 = 0 then (select slug from t_tags where t_tags.tag_id = d.tag_id) else source end as slug, title as name from t_documents d),
told as (select *, slug not in (select slug from t_tags) and row_number() over (partition by slug order by document_id) = 1 as made from asked)
select document_id, slug, case when made then 'appended' else 'refused' end as outcome, case when made then name end as name,
 case when made then '1 total number required, 2 kind' || document_id % 3 || ' string' end as fields from told""")
def tag_create(c):
    """Requests for tags, each with its fields in order. The first for a slug that isn't there makes the tag and its fields; the others are refused."""
    folder = scratch(c)
    append(conform(c.tags, "tags"), folder, "tags")
    append(conform(c.tag_fields, "tag_fields"), folder, "tag_fields")
    asked = c.documents.join(c.tags.select("tag_id", F.col("slug").alias("_there")), "tag_id").select(
        (F.col("document_id") + 1000).alias("tag_id"), F.when(F.col("document_id") % 5 == 0, F.col("_there")).otherwise(F.col("source")).alias("slug"), F.col("title").alias("name"),
        F.array(F.struct(F.lit("total").alias("key"), F.lit("number").alias("field_type"), F.lit(True).alias("is_required")),
                F.struct(F.concat(F.lit("kind"), F.col("document_id") % 3).alias("key"), F.lit("string").alias("field_type"), F.lit(False).alias("is_required"))).alias("fields"))
    told = cut(R.admit(read(c.spark, folder, "tags"), asked, ["slug"], [F.col("tag_id")]))
    made = told.filter("outcome = 'appended'")
    append(conform(made.withColumns({"version": F.lit(1), "is_active": F.lit(True)}), "tags"), folder, "tags")
    append(conform(made.select("tag_id", F.posexplode("fields").alias("position", "f")).select("tag_id", (F.col("position") + 1).alias("position"), "f.*"), "tag_fields"), folder, "tag_fields")
    stored = read(c.spark, folder, "tags")
    assert rules.duplicates({"tags": stored, "tag_fields": read(c.spark, folder, "tag_fields")}.__getitem__, tuple(r for r in rules.UNIQUE if r.table in ("tags", "tag_fields"))).isEmpty()
    shown = F.concat_ws(" ", F.col("position").cast("string"), "key", "field_type", F.when(F.col("is_required"), "required"))
    listed = read(c.spark, folder, "tag_fields").groupBy("tag_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", shown.alias("s")))), lambda x: x["s"]), ", ").alias("fields"))
    made = stored.select("tag_id", "name").join(listed, "tag_id", "left")
    return told.select("tag_id", "slug", "outcome").join(made, "tag_id", "left").select((F.col("tag_id") - 1000).alias("document_id"), "slug", "outcome", "name", "fields")


PURGED_AT = "2024-07-01 00:00:00"
GONE = f"(select document_id from t_documents where deleted_at < timestamp '{PURGED_AT}')"


@query(f"select 'documents' as part, document_id, 1 as n, document_id % 5 = 0 or deleted_at is not null as marked from t_documents where deleted_at is null or deleted_at >= timestamp '{PURGED_AT}' union all "
       + " union all ".join(f"select '{name}', document_id, count(*), null from ({model.sql(name)}) where document_id not in {GONE} group by document_id" for name in deletion.BELONGING))
def soft_delete(c):
    """Documents asked for are marked; those marked before a day are purged, with all that belongs to them; the tables are read back."""
    old, new = scratch(c), scratch(c)
    for name in ("documents", *deletion.BELONGING):
        append(model.table(c, name), old, name)
    stored = lambda name: read(c.spark, old, name)
    marked = deletion.mark(stored("documents"), c.documents.filter("document_id % 5 = 0"), as_of("2024-08-01 00:00:00"))
    deletion.purge(stored, new, as_of(PURGED_AT), marked)
    found = read(c.spark, new, "documents").select(F.lit("documents").alias("part"), "document_id", F.lit(1).cast("long").alias("n"), F.col("deleted_at").isNotNull().alias("marked"))
    for name in deletion.BELONGING:
        kept = read(c.spark, new, name).groupBy("document_id").agg(F.count("*").alias("n"))
        found = found.unionByName(kept.select(F.lit(name).alias("part"), "document_id", "n", F.lit(None).cast("boolean").alias("marked")))
    return found


@query("select id, status, case when status = 'delivered' then strftime(created_at + interval 2 second, '%Y-%m-%d %H:%M:%S') end as delivered_at from t_deliveries")
def delivery_complete(c):
    at = F.when(F.col("status") == "delivered", F.date_format(F.col("created_at") + F.expr("interval 2 seconds"), "yyyy-MM-dd HH:mm:ss"))
    return c.deliveries.select("id", "status", at.alias("delivered_at"))


@query("""with recursive claims as (select id, document_id || ':' || event_type as key, floor(epoch(created_at))::bigint as made, sha256(payload) as response from t_events),
c as (select *, row_number() over (partition by key order by made, id) as nth from claims),
fold as (select key, nth, id, made + 259200 as until, true as won, id as holder, response from c where nth = 1
 union all select c.key, c.nth, c.id, case when c.made >= f.until then c.made + 259200 else f.until end, c.made >= f.until, case when c.made >= f.until then c.id else f.holder end, case when c.made >= f.until then c.response else f.response end
 from fold f join c on c.key = f.key and c.nth = f.nth + 1)
select key, id, won, holder, response from fold""")
def idempotency_claim(c):
    """The first request of each key wins, and again once its time is over; the others get the response of the one that holds."""
    claims = c.events.select(F.concat_ws(":", "document_id", "event_type").alias("key"), F.unix_seconds(F.col("created_at").cast("timestamp")).alias("at"), "id", F.lit(86400 * 3).cast("long").alias("ttl"), F.sha2("payload", 256).alias("response"))
    return state.claims_within_ttl(claims)


@query(f"""with {FULL}, there as (select sha256, min(document_id) as document_id, arg_min_null(case when document_id % 4 = 0 then tag_id end, document_id) as tag_id from t_documents where document_id % 2 = 0 and sha256 is not null group by sha256),
new as (select sha256, min_by(tag_id, document_id) as tag_id from t_documents where document_id % 2 = 1 and document_id % 3 > 0 and sha256 is not null group by sha256),
met as (select there.document_id, coalesce(there.tag_id, new.tag_id) as tag_id, there.tag_id is null as attached from there join new using (sha256))
select m.document_id, m.tag_id, attached, step, case when attached and step_pos >= 4 then 'pending' else status end as status, case when attached and step_pos >= 4 then 0 else attempt end::int as attempt,
 case when attached and step_pos >= 4 then null else error_code end as error_code from met m left join full_steps s on s.document_id = m.document_id""")
def attach_tag_on_dup(c):
    """An upload that brings a tag, of content whose document has none, gives it to that; its steps begin anew at the extraction. A tag that is there stays."""
    known = c.documents.filter("sha256 is not null")
    there = known.filter("document_id % 2 = 0").groupBy("sha256").agg(F.min("document_id").alias("document_id"), F.min_by(F.when(F.col("document_id") % 4 == 0, F.col("tag_id")), "document_id").alias("old"))
    new = known.filter("document_id % 2 = 1 and document_id % 3 > 0").groupBy("sha256").agg(F.min_by("tag_id", "document_id").alias("new"))
    met = there.join(new, "sha256").select("document_id", F.coalesce("old", "new").alias("tag_id"), F.col("old").isNull().alias("attached"))
    steps = state.reset_from(step_rows(c), met.filter("attached").select("document_id", F.lit("extract").alias("from_step")))
    return met.join(steps, "document_id", "left").select("document_id", "tag_id", "attached", "step", "status", "attempt", "error_code")


@query("select document_id, case when document_id % 3 = 0 then tag_id when document_confidence >= 0.7 then 2 end as tag_id, document_id % 3 <> 0 and document_confidence < 0.7 as needs_tag from t_documents")
def tag_assignment(c):
    guess = F.when(F.col("document_confidence") >= 0.7, F.lit(2).cast("long"))
    if c.tags.filter("is_active").count() == 1:  # one active tag serves all
        guess = F.lit(c.tags.filter("is_active").first().tag_id)
    tag = F.when(F.col("document_id") % 3 == 0, F.col("tag_id")).otherwise(guess)
    return c.documents.select("document_id", tag.alias("tag_id")).withColumn("needs_tag", F.col("tag_id").isNull())


def of_model(c):
    return lambda name: model.table(c, name)


def rule_sql(parts) -> str:
    return " union all ".join(f"select '{rules.name(r)}' as rule, {told} " for r, told in parts)


@query(rule_sql((r, f"concat_ws(', ', {', '.join(f'{k}::varchar' for k in r.keys)}) as value, count(*) as n from ({model.sql(r.table)}) where {r.where} and {' and '.join(f'{k} is not null' for k in r.keys)} group by {', '.join(r.keys)} having count(*) > 1") for r in rules.UNIQUE))
def dup_key(c):
    """All uniqueness rules of the data model."""
    return rules.duplicates(of_model(c))


@query("select document_id, count(*) as n from t_versions where version % 3 = 1 group by document_id having count(*) > 1")
def one_current(c):
    return c.versions.groupBy("document_id").agg(F.count_if(F.col("version") % 3 == 1).alias("n")).filter("n > 1")


@query(rule_sql((r, f"{r.column}::varchar as value, count(*) as n from ({model.sql(r.table)}) where {r.column} is not null and {r.column} not in (select {r.parent_column} from ({model.sql(r.parent)}) where {r.parent_column} is not null) group by {r.column}") for r in rules.REFERS))
def fk(c):
    """All foreign keys of the data model."""
    return rules.dangling(of_model(c))


def bounds(r):
    return " or ".join([f"{r.column} < {r.low}"] * (r.low is not None) + [f"{r.column} > {r.high}"] * (r.high is not None))


@query("select rule, round(value, 6) as value, n from (" + rule_sql((r, f"{r.column}::double as value, count(*) as n from ({model.sql(r.table)}) where {bounds(r)} group by {r.column}") for r in rules.WITHIN) + ")")
def range_(c):
    """All bounds of the data model."""
    return rules.outside(of_model(c)).withColumn("value", F.round(F.col("value").cast("double"), 6))


@query(rule_sql((r, f"{r.column} as value, count(*) as n from ({model.sql(r.table)}) where {r.column} not in ({', '.join(repr(v) for v in r.values)}) group by {r.column}") for r in rules.ONE_OF))
def enum_member(c):
    """All enumerations of the data model."""
    return rules.strangers(of_model(c))


@query("select document_id, chunk_index, embed_dim, 'chunk' as problem from (select document_id, chunk_index, case when document_id % 10 = 0 then 32 else embed_dim end::int as embed_dim from t_chunks) where embed_dim <> 64")
def embed_dim(c):
    """Chunks against the dimension that the configuration table records; some say another one."""
    chunks = c.chunks.withColumn("embed_dim", F.when(F.col("document_id") % 10 == 0, 32).otherwise(F.col("embed_dim")).cast("int"))
    return rules.wrong_dimensions(chunks, model.table(c, "schema_config"), 64)


@query("select document_id, count(*) as pages, 'too_many_pages' as reason from t_pages group by document_id having count(*) > 5")
def page_ceiling(c):
    return c.pages.groupBy("document_id").agg(F.count("*").alias("pages")).filter("pages > 5").withColumn("reason", F.lit("too_many_pages"))


@query("select d.document_id, f.key, case when field_type = 'enum' and enum_values is null then 'enum' when field_type = 'array' then 'array' when min_value > max_value then 'range' else 'ok' end as problem from t_documents d join t_tag_fields f using (tag_id) where field_type in ('array', 'enum')")
def field_spec(c):
    problem = F.when((F.col("field_type") == "enum") & F.col("enum_values").isNull(), "enum").when(F.col("field_type") == "array", "array").when(F.col("min_value") > F.col("max_value"), "range").otherwise("ok")
    bad = c.tag_fields.filter("field_type in ('array', 'enum')").select("tag_id", "key", problem.alias("problem"))
    return c.documents.select("document_id", "tag_id").join(bad, "tag_id").select("document_id", "key", "problem")


# Retrieval.


@query(f"with {KNN.format(on='c.status in (' + chr(39) + 'validated' + chr(39) + ', ' + chr(39) + 'completed' + chr(39) + ')')} select query_id, document_id, score, rank from ranked where rank <= 10")
def search_dense(c):
    return nearest(c.chunks.filter(search.filters(statuses=search.SEARCHABLE)), query_vectors(c), 10)


# A set of lexical queries, one for each residue of query_id.
TERMS = (["the", "of"], ["und", "der"], ["les", "de"], ["que", "la"], ["the", "and", "is"])
TERM_SQL = "[" + ", ".join("[" + ", ".join(f"'{w}'" for w in ws) + "]" for ws in TERMS) + "]"


def term_queries(c):
    words = F.get(F.array(*[F.array(*[F.lit(w) for w in ws]) for ws in TERMS]), (F.col("query_id") % 5).cast("int"))
    return query_vectors(c).withColumn("words", words)


BM25 = rf"""q as (select document_id as query_id, embedding, list_extract({TERM_SQL}, (document_id % 5 + 1)::int) as words from t_chunks where document_id % 25 = 0),
sized as (select document_id, words, len(words) as size from (select document_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') as words from t_chunks)),
overall as (select count(*) as n, avg(size) as mean from sized), wanted as (select query_id, unnest(words) as word, len(words) as n_words from q),
counts as (select document_id, size, word, count(*) as tf from (select document_id, size, unnest(words) as word from sized) group by all),
hits as (select query_id, word, n_words, document_id, size, tf, count(*) over (partition by query_id, word) as df from counts join wanted using (word)),
lexical as (select query_id, document_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / mean))), 6) as score from hits, overall group by query_id, document_id having count(*) = max(n_words)),
lexical_ranked as (select *, row_number() over (partition by query_id order by score desc, document_id)::int as rank from lexical)"""


@query(f"with {BM25} select query_id, document_id, score, rank from lexical_ranked where rank <= 10")
def search_sparse(c):
    return search.bm25(c.chunks, term_queries(c), 10)


@query(f"with {BM25} select query_id, document_id, score, rank from lexical_ranked")
def text_rank(c):
    """Scores and ranks of all documents that hold all words of a query."""
    return search.text_rank(c.chunks, term_queries(c))


HYBRID = f"""{BM25}, dense as (select q.query_id, c.document_id, round(list_cosine_similarity(q.embedding, c.embedding), 6) as score from q join t_chunks c on true),
dense_ranked as (select *, row_number() over (partition by query_id order by score desc, document_id)::int as rank from dense),
every as (select query_id, document_id, rank from dense_ranked where rank <= 100 and query_id in (select query_id from lexical) union all select query_id, document_id, rank from lexical_ranked where rank <= 100),
fused as (select query_id, document_id, round(sum(1.0::double / (60 + rank)), 6) as score from every group by all),
fused_ranked as (select *, row_number() over (partition by query_id order by score desc, document_id)::int as rank, 'hybrid' as mode_used from fused
 union all select query_id, document_id, score, rank, 'dense' from dense_ranked where query_id not in (select query_id from lexical))"""


@query(f"with {HYBRID} select query_id, document_id, score, rank, mode_used from fused_ranked where rank <= 10")
def search_hybrid(c):
    return search.hybrid(c.chunks, term_queries(c), search.clamp(10))


@query(f"with {HYBRID} select query_id, count(*) as n, max(rank)::int as last from fused_ranked where rank <= 50 group by query_id")
def topk_clamp(c):
    return search.hybrid(c.chunks, term_queries(c), search.clamp(500)).groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("last"))


@query(f"with {KNN.format(on='c.tag_id = q.tag_id')} select query_id, document_id, score, rank from ranked where rank <= 3")
def search_batch(c):
    """A table of queries, each within its own tag."""
    queries = c.chunks.filter("document_id % 25 = 0").select(F.col("document_id").alias("query_id"), "embedding", "tag_id")
    return nearest(c.chunks, queries, 3, within="tag_id")


@query("select document_id, embedding[1] as first, round(list_cosine_similarity(embedding, list_transform(range(1, 65), lambda i: (i % 5)::double)), 6) as score from t_chunks order by score desc, document_id limit 20")
def dense_topk(c):
    probe = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i % 5).cast("double"))
    return c.chunks.select("document_id", F.col("embedding")[0].alias("first"), F.round(cosine(F.col("embedding"), probe), 6).alias("score")).orderBy(F.desc("score"), "document_id").limit(20)


@query()
def search_ann(c):
    """Approximate neighbours by an inverted file, ranked by the exact cosine; recall is measured against search_dense's method."""
    return ivf.approximate(c.chunks, query_vectors(c), 10)


@query("select document_id from t_fields group by document_id having count(*) filter (key = 'total' and try_cast(value as double) >= 100000) > 0 and count(*) filter (key = 'status' and value in ('F', 'O')) > 0 and count(*) filter (key = 'customer' and contains(value, '1')) > 0")
def field_search(c):
    return search.field_search(c.fields, [("total", "gte", 100000), ("status", "in", ["F", "O"]), ("customer", "contains", "1")])


@query(f"""with {BM25}, top as (select query_id, r.document_id, rank, ceil(length(text) / 4.0)::bigint as tokens, text from lexical_ranked r join t_chunks c on r.document_id = c.document_id where rank <= 10),
kept as (select *, sum(tokens) over (partition by query_id order by rank rows unbounded preceding) as used from top qualify sum(tokens) over (partition by query_id order by rank rows unbounded preceding) <= 3000)
select q.query_id, coalesce(sha256(string_agg('[doc:' || document_id || '] ' || text, chr(10) order by rank)), 'no_relevant_documents') as context from q left join kept using (query_id) group by q.query_id""")
def rag_context(c):
    queries = term_queries(c)
    hits = search.bm25(c.chunks, queries, 10).join(c.chunks.select("document_id", "text"), "document_id")
    kept = search.budgeted(hits.withColumn("tokens", T.estimate_tokens(F.col("text"))), 3000)
    line = F.concat(F.lit("[doc:"), "document_id", F.lit("] "), "text")
    listed = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    joined = queries.select("query_id").join(listed, "query_id", "left")
    return joined.select("query_id", F.coalesce(F.sha2(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), 256), F.lit("no_relevant_documents")).alias("context"))


@query(f"""with {CHECKED}, queue as (select document_id, tag_id, lag(document_id) over w as previous, lead(document_id) over w as next from t_documents where status = 'pending_review' and tag_id in (1, 2) and document_confidence between 0.1 and 0.9 and created_at < timestamp '2024-03-01' window w as (partition by tag_id order by document_confidence, document_id)),
pages as (select document_id, string_agg(printf('pages/%s/%05d.png', document_id::varchar, page::int), ',' order by page) as page_keys from t_pages group by document_id),
specs as (select tag_id, string_agg(key || ':' || field_type || case when is_required then '!' else '' end, ',' order by position) as schema from t_tag_fields group by tag_id),
shown as (select c.document_id, string_agg(c.key || '=' || coalesce(c.value, '') || ' ' || round(c.confidence * 100)::int || '% p' || f.page || case when len(errors) > 0 then ' ' || array_to_string(errors, '+') else '' end, '; ' order by s.position) as fields
 from checked c join t_fields f on f.document_id = c.document_id and f.key = c.key join t_tag_fields s on s.key = c.key and s.tag_id = f.tag_id group by c.document_id)
select q.document_id, q.previous, q.next, schema, page_keys, fields from queue q left join pages using (document_id) left join specs using (tag_id) left join shown using (document_id)""")
def review_payload(c):
    """All that a review shows of a document: its fields as they are now, with confidence, page and errors, the schema they belong to, its pages, and its neighbours in the queue."""
    w = W.partitionBy("tag_id").orderBy("document_confidence", "document_id")
    queue = review_rows(c).select("document_id", "tag_id", F.lag("document_id").over(w).alias("previous"), F.lead("document_id").over(w).alias("next"))
    in_order = lambda rows, by, order, text: rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))).alias("l"))
    joined = lambda sep: F.array_join(F.transform("l", lambda x: x["t"]), sep)
    pages = in_order(c.pages, "document_id", "page", T.page_key(F.col("document_id"), F.col("page"))).select("document_id", joined(",").alias("page_keys"))
    specs = in_order(c.tag_fields, "tag_id", "position", F.concat("key", F.lit(":"), "field_type", F.when(F.col("is_required"), "!").otherwise(""))).select("tag_id", joined(",").alias("schema"))
    errors = F.when(F.size("errors") > 0, F.concat(F.lit(" "), F.array_join("errors", "+"))).otherwise("")
    field = F.concat("key", F.lit("="), F.coalesce("value", F.lit("")), F.lit(" "), F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("% p"), F.col("page").cast("string"), errors)
    fields = in_order(checked(c), "document_id", "position", field).select("document_id", joined("; ").alias("fields"))
    return queue.join(pages, "document_id", "left").join(specs, "tag_id", "left").join(fields, "document_id", "left").select("document_id", "previous", "next", "schema", "page_keys", "fields")


@query(f"with {CHECKED} select key, count(*) as n, count(*) filter (len(errors) > 0) as invalid, round(avg(adj), 6) as mean from adjusted group by key")
def field_quality(c):
    return checked(c).groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.size("errors") > 0).alias("invalid"), F.round(F.avg("adj"), 6).alias("mean"))


@query("select document_id, version, source from t_versions qualify version = max(version) over (partition by document_id)")
def current_sources(c):
    return VS.latest(c.versions.select("document_id", "version", "source"))
