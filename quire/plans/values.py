"""Scalar functions over the corpus: text, coercion, keys and payloads."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import values as V
from quire.functions import vectors
from quire.plans.joins import answers
from quire.plans.metrics import OCR, ocr_pages
from quire.plans.registry import query
from quire.plans.tables import as_of

TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
RATIO = r"case when length(text) > 0 then length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))::double / length(text) else 0 end"


@query(f"select document_id, page, len({TOKENS})::int as n, sha256(array_to_string({TOKENS}, ' ')) as digest from t_pages")
def tokenize_simple(c):
    words = T.tokens(F.col("text"))
    return c.pages.select("document_id", "page", F.size(words).alias("n"), F.sha2(F.array_join(words, " "), 256).alias("digest"))


@query(f"select document_id, page, list_has_all({TOKENS}, ['the', 'of']) as en, list_has_all({TOKENS}, ['der', 'die', 'und']) as de from t_pages")
def match_all_terms(c):
    words, of = T.tokens(F.col("text")), lambda *w: F.array(*[F.lit(x) for x in w])
    return c.pages.select("document_id", "page", T.matches_all(words, of("the", "of")).alias("en"), T.matches_all(words, of("der", "die", "und")).alias("de"))


@query(r"select document_id, page, (ceil((length(text) - (length(text) - length(regexp_replace(text, '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]', '', 'g')))) / 4.0) + (length(text) - length(regexp_replace(text, '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]', '', 'g'))))::bigint as tokens from t_pages")
def estimate_tokens(c):
    return c.pages.select("document_id", "page", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"select document_id, page, round({RATIO}, 6) as ratio from t_pages")
def alnum_ratio(c):
    return c.pages.select("document_id", "page", F.round(T.alnum_ratio(F.col("text")), 6).alias("ratio"))


@query(f"select document_id, page, round(least(1.0, ({RATIO}) * 0.5 + least(length(text) / 400.0::double, 1.0) * 0.5), 6) as quality from t_pages")
def vlm_text_quality(c):
    return c.pages.select("document_id", "page", F.round(T.read_quality(F.col("text")), 6).alias("quality"))


@query(f"with {OCR} select document_id, page, case when o.blank then null when source = 'text_layer' then 1.0::double when source = 'tesseract' then (document_id * 13 % 100) / 100.0::double when source = 'vlm' then round(least(1.0, ({RATIO}) * 0.5 + least(length(text) / 400.0::double, 1.0) * 0.5), 6) end as confidence from ocr o join t_pages using (document_id, page)")
def page_confidence(c):
    source = F.col("source")
    said = F.when(F.col("blank"), None).when(source == "text_layer", 1.0).when(source == "tesseract", (F.col("document_id") * 13 % 100) / 100.0).when(source == "vlm", F.round(T.read_quality(F.col("text")), 6))
    return ocr_pages(c).select("document_id", "page", said.alias("confidence"))


@query("""with candidates as (select document_id, page, 'text_layer' as source, 1 as priority, text from t_pages where page % 3 <> 0 union all select document_id, page, 'vlm', 2, text || ' v' from t_pages where page % 2 = 0 union all select document_id, page, 'tesseract', 3, text || ' t' from t_pages)
select document_id, page, arg_min(source, priority) as source, sha256(arg_min(text, priority)) as digest from candidates where length(text) >= 20 group by document_id, page""")
def resolve_page_text(c):
    def candidate(rows, source, priority, suffix):
        return rows.select("document_id", "page", F.lit(source).alias("source"), F.lit(priority).alias("priority"), F.concat("text", F.lit(suffix)).alias("text"))

    every = candidate(c.pages.filter("page % 3 <> 0"), "text_layer", 1, "").unionByName(candidate(c.pages.filter("page % 2 = 0"), "vlm", 2, " v")).unionByName(candidate(c.pages, "tesseract", 3, " t"))
    best = every.filter(F.length("text") >= 20).groupBy("document_id", "page").agg(F.min_by(F.struct("source", "text"), "priority").alias("b"))
    return best.select("document_id", "page", "b.source", F.sha2("b.text", 256).alias("digest"))


@query("""select document_id, sha256(string_agg('<page n="' || page || '">' || text || '</page>', chr(10) order by page)) as digest from t_pages group by document_id""")
def page_markers(c):
    return c.pages.groupBy("document_id").agg(F.sha2(T.page_markers(F.collect_list(F.struct("page", "text"))), 256).alias("digest"))


@query("select document_id, '[' || t.name || ' — ' || original_filename || ', pages ' || 1 || '-' || (document_id % 9 + 1) || ']' || chr(10) || text as text from t_documents join t_tags t using (tag_id)")
def context_header(c):
    docs = c.documents.join(c.tags.select("tag_id", "name"), "tag_id")
    return docs.select("document_id", T.context_header(F.col("name"), F.col("original_filename"), F.lit(1), F.col("document_id") % 9 + 1, F.col("text")).alias("text"))


@query("select document_id, -1 as chunk_index, 'summary' as kind, string_agg(key || ': ' || value, ' | ' order by position) as text from t_fields join t_tag_fields using (tag_id, key) where value is not null group by document_id")
def summary_chunk(c):
    rows = c.fields.filter("value is not null").join(c.tag_fields.select("tag_id", "key", "position"), ["tag_id", "key"])
    listed = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("position", F.concat("key", F.lit(": "), "value").alias("t")))).alias("l"))
    return listed.select("document_id", F.lit(-1).alias("chunk_index"), F.lit("summary").alias("kind"), F.array_join(F.transform("l", lambda x: x["t"]), " | ").alias("text"))


@query(r"""select conv_id, turn, unnest(list_transform(regexp_extract_all(text || ' [doc:' || (conv_id * 7) || ' p:' || (turn + 1) || '] and [doc:' || (conv_id * 900) || ' p:1]', '\[doc:[0-9]+ p:[0-9]+\]'), lambda m: regexp_replace(m, '\[doc:([0-9]+) p:([0-9]+)\]', '\1:\2'))) as citation from conversations where role = 'assistant'""")
def parse_citations(c):
    return answers(c).select("conv_id", "turn", F.explode(T.citations(F.col("answer"))).alias("citation"))


@query("select doc_id as document_id, source || '_' || lang as key, regexp_full_match(source || '_' || lang, '[a-z][a-z0-9_]{0,62}') as valid, regexp_full_match(lang || '-' || doc_id, '[a-z][a-z0-9_]{0,62}') as dashed from documents")
def slug_check(c):
    key = F.concat("source", F.lit("_"), "tag_slug")
    return c.documents.select("document_id", key.alias("key"), T.valid_key(key).alias("valid"), T.valid_key(F.concat("tag_slug", F.lit("-"), "document_id")).alias("dashed"))


@query("select document_id, document_id % 5 in (0, 1, 2) as escapes from t_documents")
def path_escape(c):
    kind = F.col("document_id") % 5
    name = F.when(kind == 0, F.concat(F.lit("../"), "title")).when(kind == 1, F.concat(F.lit("/etc/"), "title")).when(kind == 2, F.concat("title", F.lit("\\..\\x"))).when(kind == 3, F.concat(F.lit("a/"), "title")).otherwise(F.concat("title", F.lit("..txt")))
    return c.documents.select("document_id", T.escapes(name).alias("escapes"))


FENCED = "(select event_id, case event_id % 4 when 0 then '```json' || chr(10) || props || chr(10) || '```' when 1 then props when 2 then substr(props, 2) else 'see: ' || props end as response, event_type from events)"


@query(rf"select event_type, count(*) as n, count(*) filter (json_valid(regexp_replace(response, '^```[a-z]*\n|\n```$', '', 'g'))) as parseable from {FENCED} group by event_type")
def raw_response_audit(c):
    kind, props = F.col("id") % 4, F.col("payload")
    response = F.when(kind == 0, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(kind == 1, props).when(kind == 2, F.substring(props, F.lit(2), F.length(props))).otherwise(F.concat(F.lit("see: "), props))
    plain = F.regexp_replace(response, r"^```[a-z]*\n|\n```$", "")
    rows = c.table("events").select(F.col("event_id").alias("id"), F.col("props").alias("payload"), "event_type").withColumn("ok", F.call_function("try_parse_json", plain).isNotNull() & plain.rlike(r"^\s*[{\[]"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("ok").alias("parseable"))


@query("""select id, '{"type":"document.' || event_type || '","document_id":' || document_id || ',"occurred_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '","self":"/documents/' || document_id || '"}' as body from t_events""")
def delivery_payload(c):
    body = F.to_json(F.struct(F.concat(F.lit("document."), "event_type").alias("type"), "document_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("occurred_at"), F.concat(F.lit("/documents/"), "document_id").alias("self")))
    return c.events.select("id", body.alias("body"))


SPELLED = "case o_orderkey % 5 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%d/%m/%Y') when 2 then strftime(o_orderdate, '%b %-d, %Y') when 3 then strftime(o_orderdate, '%d.%m.%Y') else 'not a date' end"


@query(f"select o_orderkey as document_id, v as value, coalesce(try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%d/%m/%Y'), try_strptime(v, '%b %d, %Y'), try_strptime(v, '%d.%m.%Y'))::date::varchar as day from (select o_orderkey, {SPELLED} as v from orders)")
def coerce_date(c):
    kind, day = F.col("o_orderkey") % 5, lambda f: F.date_format("o_orderdate", f)
    v = F.when(kind == 0, day("yyyy-MM-dd")).when(kind == 1, day("dd/MM/yyyy")).when(kind == 2, day("MMM d, yyyy")).when(kind == 3, day("dd.MM.yyyy")).otherwise("not a date")
    return c.table("orders").select(F.col("o_orderkey").alias("document_id"), v.alias("value")).withColumn("day", V.to_date(F.col("value")).cast("string"))


@query(r"select o_orderkey as document_id, v as value, try_cast(regexp_replace(v, '[^0-9.\-]', '', 'g') as decimal(18,2))::double as number from (select o_orderkey, case o_orderkey % 4 when 0 then '$' || printf('%.2f', o_totalprice) when 1 then 'EUR ' || (round(o_totalprice)::bigint) when 2 then '-' || (round(o_totalprice)::bigint) || ' ' else 'n/a' end as v from orders)")
def coerce_number(c):
    kind, total = F.col("o_orderkey") % 4, F.round("o_totalprice").cast("long").cast("string")
    v = F.when(kind == 0, F.concat(F.lit("$"), F.format_string("%.2f", "o_totalprice"))).when(kind == 1, F.concat(F.lit("EUR "), total)).when(kind == 2, F.concat(F.lit("-"), total, F.lit(" "))).otherwise("n/a")
    return c.table("orders").select(F.col("o_orderkey").alias("document_id"), v.alias("value")).withColumn("number", V.to_number(F.col("value")).cast("double"))


@query("select o_orderkey as document_id, case when v in ('true', 'yes', 'y', '1', 'on') then true when v in ('false', 'no', 'n', '0', 'off') then false end as flag from (select o_orderkey, lower(trim(list_extract(['Yes', ' no', 'TRUE', '0', 'maybe', 'Off'], (o_orderkey % 6 + 1)::int))) as v from orders)")
def coerce_bool(c):
    spelled = F.get(F.array(*[F.lit(x) for x in ("Yes", " no", "TRUE", "0", "maybe", "Off")]), (F.col("o_orderkey") % 6).cast("int"))
    return c.table("orders").select(F.col("o_orderkey").alias("document_id"), V.to_boolean(spelled).alias("flag"))


@query("select document_id, step, date_diff('microsecond', started_at, updated_at) // 1000 as ms from t_steps where started_at is not null")
def duration_ms(c):
    return c.steps.filter("started_at is not null").select("document_id", "step", V.duration_ms(F.col("started_at"), F.col("updated_at")).alias("ms"))


@query("select id, least(15 * pow(2, attempt), 900)::bigint as delay_s from t_deliveries")
def retry_delay(c):
    return c.deliveries.select("id", V.backoff(F.col("attempt"), 15, 2, 900).alias("delay_s"))


@query("select id, least(10 * pow(4, attempt - 1), 3600)::bigint as delay_s from t_deliveries where status = 'failed' and attempt < 6")
def delivery_delay(c):
    return c.deliveries.filter("status = 'failed' and attempt < 6").select("id", V.backoff(F.col("attempt") - 1, 10, 4, 3600).alias("delay_s"))


@query("select document_id, round(1 - list_cosine_similarity(embedding, list_transform(range(1, 65), lambda i: (i % 7)::double)), 6) as distance from t_chunks")
def cosine_distance(c):
    probe = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i % 7).cast("double"))
    return c.chunks.select("document_id", F.round(1 - vectors.cosine(F.col("embedding"), probe), 6).alias("distance"))


@query("select document_id, round(sum(1.0::double / (60 + r)), 6) as score from (select document_id, row_number() over (partition by key order by confidence desc, document_id) as r from t_fields) where r <= 500 group by document_id")
def rrf_score(c):
    ranked = c.fields.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy(F.desc("confidence"), "document_id"))).filter("r <= 500")
    return ranked.groupBy("document_id").agg(F.round(F.sum(1.0 / (60 + F.col("r"))), 6).alias("score"))


@query("select id, 'k=' || (payload->>'$.k') || ';seen=yes;step=' || step as merged from t_events")
def jsonb_merge(c):
    old = F.map_concat(F.from_json("payload", "map<string,string>"), F.create_map(F.lit("step"), F.lit("none")))
    new = F.create_map(F.lit("seen"), F.lit("yes"), F.lit("step"), "step")
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    entries = F.array_sort(F.map_entries(F.map_concat(kept, new)))
    return c.events.select("id", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("merged"))


@query("select webhook_id, list_contains(events, 'validated') as validated, list_contains(events, 'uploaded') as uploaded from t_webhooks")
def array_member(c):
    return c.webhooks.select("webhook_id", F.array_contains("events", "validated").alias("validated"), F.array_contains("events", "uploaded").alias("uploaded"))


@query("select conv_id, turn, sha256('search|' || lower(trim(text)) || '|hybrid|10|' || role) as key from conversations")
def search_key(c):
    return c.table("conversations").select("conv_id", "turn", F.sha2(F.concat_ws("|", F.lit("search"), F.lower(F.trim("text")), F.lit("hybrid"), F.lit("10"), "role"), 256).alias("key"))


REQUEST = "sha256('POST|/conversations/' || conv_id || '|' || {})"


@query(f"""with asked as (select conv_id, turn, {REQUEST.format("lower(trim(text))")} as request_hash, case when turn % 3 = 0 then conv_id || ':' || turn else conv_id || ':x' end as key from conversations)
select conv_id, turn, request_hash, case when turn = min(turn) over w then 'first' when request_hash = first_value(request_hash) over (partition by key order by turn) then 'replay' else 'conflict' end as outcome
from asked window w as (partition by key)""")
def request_hash(c):
    """The first request under a key is stored; an equal one later is answered from the store, another one is a conflict."""
    body = F.concat(F.lit("POST|/conversations/"), "conv_id", F.lit("|"), F.lower(F.trim("text")))
    key = F.when(F.col("turn") % 3 == 0, F.concat("conv_id", F.lit(":"), "turn")).otherwise(F.concat("conv_id", F.lit(":x")))
    asked = c.table("conversations").select("conv_id", "turn", F.sha2(body, 256).alias("request_hash"), key.alias("key"))
    stored = asked.groupBy("key").agg(F.min("turn").alias("first"), F.min_by("request_hash", "turn").alias("stored"))
    outcome = F.when(F.col("turn") == F.col("first"), "first").when(F.col("request_hash") == F.col("stored"), "replay").otherwise("conflict")
    return asked.join(stored, "key").select("conv_id", "turn", "request_hash", outcome.alias("outcome"))


@query("select document_id, page, contains(text, split_part(text, ' ', 3)) as verbatim, contains(text, upper(split_part(text, ' ', 1)) || '?!') as altered from t_pages where text <> ''")
def evidence_valid(c):
    part = lambda n: F.split_part("text", F.lit(" "), F.lit(n))
    return c.pages.filter("text <> ''").select("document_id", "page", F.contains("text", part(3)).alias("verbatim"), F.contains("text", F.concat(F.upper(part(1)), F.lit("?!"))).alias("altered"))


@query("select document_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') as at from t_documents where created_at < timestamp '2024-01-01 10:00:00'")
def created_range(c):
    return c.documents.filter(F.col("created_at") < as_of("2024-01-01 10:00:00")).select("document_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("at"))
