"""Joins, set operations and sorted pages over the corpus."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.vectors import nearest
from quire.operators import relations as R
from quire.operators import search, state
from quire.operators.versions import schema_diff
from quire.plans.registry import query
from quire.plans.tables import as_of, stamp
from quire.sources.tables import STEP_ORDER

STEPS = ", ".join(f"'{s}'" for s in STEP_ORDER)
BLOCK_IDS, PACK_IDS, SLICES = 16_384, 256, 64


@query("select d.document_id, d.tag_id, t.slug as tag_slug, t.is_active from t_documents d left join t_tags t on d.tag_id = t.tag_id and t.is_active")
def doc_tag_left_join(c):
    # Tags are a small dimension; the optimiser broadcasts them while their size allows.
    tags = c.tags.filter("is_active").select("tag_id", F.col("slug").alias("tag_slug"), "is_active")
    return c.documents.select("document_id", "tag_id").join(tags, "tag_id", "left").select("document_id", "tag_id", "tag_slug", "is_active")


@query("""select c.document_id, c.chunk_index, 'chunk_kind=text;document_status=' || d.status || ';tag_slug=' || coalesce(t.slug, 'null') as metadata
from t_chunks c join t_documents d on c.document_id = d.document_id left join t_tags t on d.tag_id = t.tag_id and t.is_active""")
def refresh_metadata(c):
    """Tag and status pushed onto all chunks: the right side wins, other keys stay, a missing tag is an explicit null."""
    old = c.chunks.select("document_id", "chunk_index", F.create_map(F.lit("chunk_kind"), F.lit("text"), F.lit("document_status"), F.lit("stale")).alias("old"))
    docs = c.documents.join(c.tags.filter("is_active").select("tag_id", "slug"), "tag_id", "left")
    new = docs.select("document_id", F.create_map(F.lit("document_status"), "status", F.lit("tag_slug"), "slug").alias("new"))
    kept = F.map_filter("old", lambda k, v: ~F.array_contains(F.map_keys("new"), k))
    both = F.array_sort(F.map_entries(F.map_concat(kept, "new")))
    shown = F.array_join(F.transform(both, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ";")
    return old.join(new, "document_id").select("document_id", "chunk_index", shown.alias("metadata"))


@query("""select t.slug, count(d.document_id) as documents, any_value(f.fields) as fields from t_tags t left join t_documents d on d.tag_id = t.tag_id
left join (select tag_id, string_agg(key || ':' || field_type, ',' order by position) as fields from t_tag_fields group by tag_id) f on f.tag_id = t.tag_id group by t.slug""")
def tags_with_fields(c):
    listed = c.tag_fields.groupBy("tag_id").agg(F.sort_array(F.collect_list(F.struct("position", "key", "field_type"))).alias("f"))
    shown = F.array_join(F.transform("f", lambda x: F.concat(x["key"], F.lit(":"), x["field_type"])), ",")
    counts = c.documents.groupBy("tag_id").agg(F.count("*").alias("documents"))
    return c.tags.join(listed, "tag_id", "left").join(counts, "tag_id", "left").select("slug", F.coalesce("documents", F.lit(0)).alias("documents"), shown.alias("fields"))


@query("select document_id, string_agg(step || '=' || status, ',' order by step_pos) as steps from t_steps group by document_id")
def doc_with_steps(c):
    listed = c.steps.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("step_pos", "step", "status"))).alias("s"))
    return listed.select("document_id", F.array_join(F.transform("s", lambda x: F.concat(x["step"], F.lit("="), x["status"])), ",").alias("steps"))


@query("select v.document_id, v.version, t.slug || '@' || v.tag_version as snapshot from t_versions v join t_tags t on v.tag_id = t.tag_id and v.tag_version <= t.version")
def extraction_at_version(c):
    snapshots = c.tags.select("tag_id", "slug", F.explode(F.sequence(F.lit(1), "version")).alias("tag_version"))
    return c.versions.join(snapshots, ["tag_id", "tag_version"]).select("document_id", "version", F.concat("slug", F.lit("@"), "tag_version").alias("snapshot"))


KNN = """pairs as (select q.document_id as query_id, c.document_id, round(list_cosine_similarity(q.embedding, c.embedding), 6) as score from t_chunks q join t_chunks c on {on} where q.document_id % 25 = 0),
ranked as (select query_id, document_id, score, row_number() over (partition by query_id order by score desc, document_id)::int as rank from pairs)"""


def query_vectors(c):
    return c.chunks.filter("document_id % 25 = 0").select(F.col("document_id").alias("query_id"), "embedding")


@query(f"with {KNN.format(on='true')} select query_id, document_id, score, rank from ranked where rank <= 10")
def knn_cross_join(c):
    return nearest(c.chunks, query_vectors(c), 10)


@query(f"with {KNN.format(on='true')} select r.query_id, r.rank, r.document_id, d.title, t.slug, printf('pages/%s/%05d.png', d.document_id::varchar, 1) as page_key from ranked r join t_documents d on r.document_id = d.document_id join t_tags t on d.tag_id = t.tag_id where rank <= 5")
def hit_enrichment(c):
    hits = nearest(c.chunks, query_vectors(c), 5)
    docs = c.documents.select("document_id", "title", "tag_id").join(c.tags.select("tag_id", "slug"), "tag_id")
    return hits.join(docs, "document_id").select("query_id", "rank", "document_id", "title", "slug", T.page_key(F.col("document_id"), F.lit(1)).alias("page_key"))


@query(f"with {KNN.format(on='q.document_id <> c.document_id')} select query_id, document_id, score, rank from ranked where rank <= 10")
def similar_documents(c):
    return nearest(c.chunks, query_vectors(c), 10, exclude_self=True)


@query("""with recursive links as materialized (select a.document_id as u, b.document_id as v from t_chunks a join t_chunks b on a.document_id <> b.document_id where list_cosine_similarity(a.embedding, b.embedding) >= 0.93),
reach(u, v) as (select u, v from links union select r.u, l.v from reach r join links l on r.v = l.u), smallest as (select u, min(v) as m from reach group by u)
select document_id, least(document_id, coalesce(m, document_id)) as class_id from t_chunks left join smallest on u = document_id""")
def near_duplicates(c):
    """A self join of all vectors, by hyperplane buckets; one row per document with its class."""
    return search.alike(c.chunks, 0.93)


@query("select document_id, sha256, first_id, document_id <> first_id as deduplicated from (select document_id, sha256, min_by(document_id, (created_at, document_id)) over (partition by sha256) as first_id from t_documents where deleted_at is null)")
def exact_duplicates(c):
    """The first of each digest by an aggregate that combines before the shuffle, so a text with many copies is no burden."""
    live = c.documents.filter("deleted_at is null").select("document_id", "sha256", "created_at")
    first = live.groupBy("sha256").agg(F.min_by("document_id", F.struct("created_at", "document_id")).alias("first_id"))
    return live.join(first, "sha256").select("document_id", "sha256", "first_id", (F.col("document_id") != F.col("first_id")).alias("deduplicated"))


@query("""select coalesce(v.document_id, o.o_orderkey) as document_id, case when v.document_id is null then 'state_only' else 'content_only' end as problem
from (select distinct document_id from t_versions where version >= 2) v full join (select o_orderkey from orders where o_orderkey % 2 = 0) o on v.document_id = o.o_orderkey where v.document_id is null or o.o_orderkey is null""")
def orphans(c):
    content = c.versions.filter("version >= 2").select("document_id").distinct().withColumn("_c", F.lit(True))
    rows = c.table("orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("document_id")).withColumn("_s", F.lit(True))
    lone = content.join(rows, "document_id", "full_outer").filter("_c is null or _s is null")
    return lone.select("document_id", F.when(F.col("_c").isNull(), "state_only").otherwise("content_only").alias("problem"))


@query("select tag_id, slug from t_tags where tag_id not in (select tag_id from t_documents where status = 'received' and size_bytes > 5000)")
def deletable_tags(c):
    return c.tags.join(c.documents.filter("status = 'received' and size_bytes > 5000").select("tag_id"), "tag_id", "left_anti").select("tag_id", "slug")


@query("select document_id, version as based_on, current_version from (select document_id, version, max(version) over (partition by document_id) as current_version from t_versions) where version % 2 = 1 and version < current_version")
def stale_submissions(c):
    current = c.versions.groupBy("document_id").agg(F.max("version").alias("current_version"))
    based = c.versions.filter("version % 2 = 1").select("document_id", F.col("version").alias("based_on"))
    return based.join(current, "document_id").filter("based_on < current_version")


ANSWERS = "(select conv_id, turn, text || ' [doc:' || (conv_id * 7) || ' p:' || (turn + 1) || '] and [doc:' || (conv_id * 900) || ' p:1]' as answer from conversations where role = 'assistant')"


def answers(c):
    marked = F.concat("text", F.lit(" [doc:"), F.col("conv_id") * 7, F.lit(" p:"), F.col("turn") + 1, F.lit("] and [doc:"), F.col("conv_id") * 900, F.lit(" p:1]"))
    return c.table("conversations").filter("role = 'assistant'").select("conv_id", "turn", marked.alias("answer"))


@query(f"""with marks as (select conv_id, turn, unnest(regexp_extract_all(answer, '\\[doc:[0-9]+ p:[0-9]+\\]')) as mark from {ANSWERS}),
cited as (select conv_id, turn, regexp_extract(mark, 'doc:([0-9]+)', 1)::bigint as document_id, regexp_extract(mark, 'p:([0-9]+)', 1)::int as page from marks)
select conv_id, turn, c.document_id, c.page from cited c join t_pages p on c.document_id = p.document_id and c.page = p.page""")
def citation_join(c):
    cited = answers(c).select("conv_id", "turn", F.explode(T.citations(F.col("answer"))).alias("m"))
    cited = cited.select("conv_id", "turn", F.split_part("m", F.lit(":"), F.lit(1)).cast("long").alias("document_id"), F.split_part("m", F.lit(":"), F.lit(2)).cast("int").alias("page"))
    return cited.join(c.pages.select("document_id", "page"), ["document_id", "page"]).select("conv_id", "turn", "document_id", "page")


@query("""select f.document_id, f.key, contains(p.text, f.evidence) as found from (select document_id, page, key, value as evidence from t_fields where key in ('status', 'customer') and value is not null) f
join t_pages p on f.document_id = p.document_id and f.page = p.page""")
def evidence_join(c):
    """Every field's evidence, sought in the page of its own document that it names."""
    f = c.fields.filter("key in ('status', 'customer') and value is not null").select("document_id", "page", "key", F.col("value").alias("evidence"))
    return f.join(c.pages, ["document_id", "page"]).select("document_id", "key", F.contains("text", "evidence").alias("found"))


@query("select page as key_page, max(value) filter (key = 'status') as status, max(value) filter (key = 'priority') as priority, max(value) filter (key = 'customer') as customer from t_fields group by page")
def field_pivot_compare(c):
    return c.fields.groupBy(F.col("page").alias("key_page")).pivot("key", ["status", "priority", "customer"]).agg(F.max("value"))


@query(r"""with words as (select document_id, page, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''))) as word from t_pages),
labels as (select unnest(['the', 'of', 'und', 'les', 'que', 'total', 'order']) as word),
overlap as (select document_id, page, count(*) as n from words join labels using (word) group by document_id, page),
ranked as (select p.document_id, p.page, row_number() over (partition by p.document_id order by coalesce(n, 0) desc, p.page) as r, max(p.page) over (partition by p.document_id) as last from t_pages p left join overlap o on p.document_id = o.document_id and p.page = o.page)
select document_id, page from ranked where r <= 3 or page = 1 or page = last""")
def page_selection_overlap(c):
    words = c.pages.select("document_id", "page", F.size(F.array_intersect(F.array_distinct(T.tokens(F.col("text"))), F.array(*[F.lit(w) for w in ("the", "of", "und", "les", "que", "total", "order")]))).alias("n"))
    rank = F.row_number().over(W.partitionBy("document_id").orderBy(F.desc("n"), "page"))
    last = F.max("page").over(W.partitionBy("document_id"))
    return words.withColumns({"r": rank, "last": last}).filter("r <= 3 or page = 1 or page = last").select("document_id", "page")


@query("""with ranked as (select document_id, row_number() over (order by size_bytes desc, document_id) as a, row_number() over (order by document_confidence desc, document_id) as b from t_documents)
select document_id, round((case when a <= 100 then 1.0::double / (60 + a) else 0 end) + (case when b <= 100 then 1.0::double / (60 + b) else 0 end), 6) as score from ranked where a <= 100 or b <= 100""")
def rrf_union(c):
    docs = c.documents.withColumn("query_id", F.lit(1).cast("long"))
    rankings = []
    for column in ("size_bytes", "document_confidence"):
        top = docs.orderBy(F.desc(column), "document_id").limit(100)  # a ranking is as long as asked
        rankings.append(top.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(column), "document_id"))))
    return search.fuse(rankings).select("document_id", "score")


@query(f"""select d.document_id, s.step, coalesce(t.status, 'pending') as status, coalesce(t.attempt, 0)::int as attempt from (select distinct document_id from t_steps union select doc_id from documents) d
join (select unnest([{STEPS}]) as step) s on true left join t_steps t on t.document_id = d.document_id and t.step = s.step""")
def ensure_steps(c):
    ids = c.steps.select("document_id").union(c.documents.select("document_id"))
    return state.ensure_steps(step_rows(c), ids).select("document_id", "step", "status", "attempt")


def step_rows(c):
    """The step table with all columns of a state transition."""
    return c.steps.select("document_id", "step", "status", "attempt", "max_attempts", "started_at", F.when(F.col("status").isin("succeeded", "failed"), F.col("updated_at")).alias("finished_at"),
                          F.when(F.col("status") == "succeeded", F.floor(F.col("value") * 100).cast("long")).alias("duration_ms"), F.when(F.col("status") == "failed", F.lit("bad_pdf")).alias("error_code"))


@query("""select document_id, key, value from t_fields where document_id % 8 <> 0 union all select document_id, 'total', 'new' from (select distinct document_id from t_fields where document_id % 8 = 0)""")
def replace_fields(c):
    old = c.fields.select("document_id", "key", "value")
    new = old.filter("document_id % 8 = 0").select("document_id", F.lit("total").alias("key"), F.lit("new").alias("value")).distinct()
    return R.replace_groups(old, new, "document_id")


@query("""select document_id, key, case when o.version is null then 'add' when n.version is null then 'remove' else 'change' end as change from (select document_id, tag_version as key, version, source from t_versions where version <= 2 and version = 1) o
full join (select document_id, tag_version as key, version, source from t_versions where version = 2) n using (document_id, key) where o.version is null or n.version is null or o.source <> n.source""")
def schema_diff_(c):
    old = c.versions.filter("version = 1").selectExpr("document_id", "tag_version as key", "source")
    new = c.versions.filter("version = 2").selectExpr("document_id", "tag_version as key", "source")
    return schema_diff(old, new, ["document_id", "key"], ["source"])


@query("select document_id, page from t_pages where length(trim(text)) = 0 or page % 4 = 0")
def resume_pages(c):
    done = c.pages.filter(F.length(F.trim("text")) > 0).filter("page % 4 <> 0").select("document_id", "page")
    return c.pages.select("document_id", "page").join(done, ["document_id", "page"], "left_anti")


@query("select document_id, page from (select document_id, page, max(page) over (partition by document_id) as last from t_pages) where page = 1 or page = last or page = 3")
def first_last_union(c):
    ends = c.pages.groupBy("document_id").agg(F.array_distinct(F.array(F.lit(1), F.max("page"))).alias("p"))
    return ends.select("document_id", F.explode("p").alias("page")).union(c.pages.filter("page = 3").select("document_id", "page")).distinct()


@query("""with have as (select document_id, embed_model from t_chunks), missing as (select count(*) as n from have h where embed_model = 'model-0' and not exists (select 1 from have g where g.document_id = h.document_id and g.embed_model = 'model-1'))
select document_id, embed_model from have where embed_model <> 'model-0' or (select n from missing) > 0""")
def reindex_swap(c):
    """The old model's rows go only once the new model has them all."""
    have = c.chunks.select("document_id", "embed_model")
    lacking = have.filter("embed_model = 'model-0'").join(have.filter("embed_model = 'model-1'"), "document_id", "left_anti")
    return have if not lacking.isEmpty() else have.filter("embed_model <> 'model-0'")


@query("select document_id, title, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at from t_documents order by created_at desc, document_id desc limit 50 offset 100")
def offset_page(c):
    return c.documents.orderBy(F.desc("created_at"), F.desc("document_id")).offset(100).limit(50).select("document_id", "title", stamp("created_at"))


@query("select document_id, title, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at from t_documents where (created_at, document_id) < (timestamp '2024-01-01 05:00:00', 300) order by created_at desc, document_id desc limit 50")
def cursor_page(c):
    after = (F.expr("timestamp_ntz'2024-01-01 05:00:00'"), 300)
    rows = c.documents.select("document_id", "title", "created_at")
    further = (F.col("created_at") < after[0]) | ((F.col("created_at") == after[0]) & (F.col("document_id") < 300))
    return R.keyset_page(rows.filter(further), [("created_at", True), ("document_id", True)], None, 50).select("document_id", "title", stamp("created_at"))


@query("select id, document_id, event_type, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at from t_events where document_id = 7 order by t_events.created_at, id limit 100")
def events_page(c):
    return c.events.filter("document_id = 7").orderBy("created_at", "id").limit(100).select("id", "document_id", "event_type", stamp("created_at"))


@query("select doc_id as document_id, case when quality = 1 then 'approved' else 'rejected' end as decision, row_number() over (order by doc_id desc)::int as place from labels order by doc_id desc limit 200")
def validations_list(c):
    rows = c.table("labels").filter("doc_id is not null").orderBy(F.desc("doc_id")).limit(200)
    place = F.row_number().over(W.orderBy(F.desc("document_id")))  # over the page only
    return rows.select(F.col("doc_id").alias("document_id"), F.when(F.col("quality") == 1, "approved").otherwise("rejected").alias("decision")).withColumn("place", place)


QUEUE = "t_documents where status = 'pending_review' and tag_id in (1, 2) and document_confidence between 0.1 and 0.9 and created_at < timestamp '2024-03-01'"


def review_rows(c):
    return c.documents.filter("status = 'pending_review' and tag_id in (1, 2)").filter(F.col("document_confidence").between(0.1, 0.9)).filter(F.col("created_at") < as_of("2024-03-01 00:00:00"))


@query(f"select document_id, document_confidence, tag_id from {QUEUE} order by document_confidence nulls last, document_id limit 100")
def review_queue(c):
    return review_rows(c).orderBy(F.asc_nulls_last("document_confidence"), "document_id").limit(100).select("document_id", "document_confidence", "tag_id")


@query("select o_custkey as request, count(*) as n, count(*) <= 12 as accepted from orders group by o_custkey")
def bulk_cap(c):
    return c.table("orders").groupBy(F.col("o_custkey").alias("request")).agg(F.count("*").alias("n")).withColumn("accepted", F.col("n") <= 12)


@query("""select document_id, string_agg(text, chr(10) order by page) || case when max(n) > 20 then chr(10) || '[truncated: continue with page_from=21]' else '' end as text
from (select document_id, page, text, count(*) over (partition by document_id) as n from t_pages) where page <= 20 group by document_id""")
def text_page_bound(c):
    n = c.pages.groupBy("document_id").agg(F.max("page").alias("n"))
    first = c.pages.filter("page <= 20").groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    return first.join(n, "document_id").select("document_id", F.concat(text, F.when(F.col("n") > 20, "\n[truncated: continue with page_from=21]").otherwise("")).alias("text"))


@query("select document_id, step, step_pos, row_number() over (partition by document_id order by step_pos)::int as place from t_steps")
def step_order_sort(c):
    return c.steps.withColumn("step_pos", state.position(F.col("step"))).select("document_id", "step", "step_pos", F.row_number().over(W.partitionBy("document_id").orderBy("step_pos")).alias("place"))


@query("select document_id, step, strftime(updated_at, '%Y-%m-%d %H:%M:%S') as updated_at from t_steps where status = 'failed' order by t_steps.updated_at desc, document_id, step limit 50")
def recent_failures(c):
    return c.steps.filter("status = 'failed'").orderBy(F.desc("updated_at"), "document_id", "step").limit(50).select("document_id", "step", stamp("updated_at"))


@query("select e.id, w.webhook_id from t_events e join (select webhook_id, unnest(events) as event_type from t_webhooks where is_active) w on e.event_type = w.event_type")
def subscription_match(c):
    """Events meet webhooks as packs of ids, and pairs are made last: what is shuffled grows with the tables only. The ids of a
    short pack come again for one webhook after the other, where columns take little room. Slices deal the packs of a kind to many tasks."""
    kind = ["event_type", "slice"]
    wanted = c.webhooks.filter("is_active").select("webhook_id", F.explode("events").alias("event_type"))
    wanted = wanted.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    events = c.events.select(F.struct("id").alias("id"), "event_type", F.expr(f"id div {BLOCK_IDS}").alias("block"))
    blocks = events.groupBy("event_type", "block").agg(F.collect_list("id")["id"].alias("ids"))
    starts = F.sequence(F.lit(1), F.size("ids"), F.lit(PACK_IDS))
    packs = blocks.select("event_type", "block", F.posexplode(F.transform(starts, lambda i: F.slice("ids", i, F.lit(PACK_IDS)))).alias("pack", "ids"))
    packs = packs.select("event_type", F.pmod(F.hash("block", "pack"), F.lit(SLICES)).alias("slice"), "ids")
    # By number: the optimiser would take as many tasks as the packs need, and not their pairs. By a merge: it would send all slices along, by the size of one.
    dealt = packs.repartition(int(c.spark.conf.get("spark.sql.shuffle.partitions")), *kind)
    return dealt.join(wanted.hint("merge"), kind).select(F.explode("ids").alias("id"), "webhook_id")
