"""Chunking, hooks and streams over the corpus; a stream's SQL is that of its batch twin."""

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators import chunking, hooks, state
from quire.plans.registry import query
from quire.plans.tables import as_of, scratch
from quire.sources.tables import retain
from quire.streaming import ingest, steps, streams

SENTENCES = r"""sents as (select document_id, page, (i - 1)::int as place, s[i] as sentence from (select document_id, page, s, unnest(range(1, len(s) + 1)) as i from
 (select document_id, page, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\f\r]+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') as s from t_pages)))"""


@query(f"with {SENTENCES} select document_id, page, place, sentence from sents")
def sentence_split(c):
    return chunking.sentence_rows(c.pages)


@query(f"""with {SENTENCES}, run as (select *, sum(ceil(length(sentence) / 4.0)) over (partition by document_id order by page, place rows unbounded preceding)::bigint as used from sents)
select document_id, ((used - 1) // 512)::int as chunk_index, min(page)::int as page_from, max(page)::int as page_to, string_agg(sentence, ' ' order by page, place) as text, sum(ceil(length(sentence) / 4.0))::bigint as token_count from run group by document_id, (used - 1) // 512""")
def chunk_windows(c):
    return chunking.chunk_windows(c.pages)


TOKENS = r"(ceil((length({0}) - length(regexp_replace({0}, '[^\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{AC00}}-\x{{D7AF}}]', '', 'g'))) / 4.0) + length(regexp_replace({0}, '[^\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{AC00}}-\x{{D7AF}}]', '', 'g')))::bigint"
PACKED = rf"""with recursive split as (select document_id, page, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '(?m)((?:^\|[^\n]*(?:\n|\z))+)', chr(10) || chr(10) || '\1' || chr(10) || chr(10), 'g'), '\n[ \t]*\n'),
  lambda p: trim(regexp_replace(p, '^\n+|\n+$', '', 'g'))), lambda p: p <> '') as ps from t_pages where text is not null),
paras as (select document_id, page, i as paragraph, ps[i] as p, {TOKENS.format("ps[i]")} as size from (select *, unnest(range(1, len(ps) + 1)) as i from split)),
cut as (select document_id, page, paragraph, starts_with(p, '|') and size <= 1024 as tabular, case when starts_with(p, '|') and size <= 1024 then [p] when starts_with(p, '|') then string_split(p, chr(10))
  else list_filter(list_transform(string_split(regexp_replace(p, '([.!?])[ \t\n\f\r]+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') end as ss from paras),
sents as (select document_id, page, paragraph, tabular, i as place, ss[i] as text, {TOKENS.format("ss[i]")} as tokens from (select *, unnest(range(1, len(ss) + 1)) as i from cut)),
sized as (select *, sum(tokens) over (partition by document_id, page, paragraph)::bigint as whole from sents),
words as (select document_id, page, paragraph, place, whole, floor(length(text) * 512 / tokens)::bigint as width, i, ws[i] as w
  from (select *, unnest(range(1, len(ws) + 1)) as i from (select *, string_split(regexp_replace(text, '([^ ]{{1000}})', '\1 ', 'g'), ' ') as ws from sized where tokens > 512 and not tabular))),
lined as (select *, (sum(length(w) + 1) over (partition by document_id, page, paragraph, place order by i rows unbounded preceding) - 2) // width as line from words),
lines as (select document_id, page, paragraph, place, line, whole, trim(string_agg(w, ' ' order by i)) as text from lined group by document_id, page, paragraph, place, line, whole),
pieces as (select document_id, page, paragraph, place, 0 as line, text, tokens, whole from sized where tokens <= 512 or tabular
  union all select document_id, page, paragraph, place, line, text, {TOKENS.format("text")}, whole from lines where text <> ''),
numbered as (select *, row_number() over w as nth, sum(tokens) over w as total, case when row_number() over (partition by document_id, page, paragraph order by place, line) = 1 and whole <= 512 then whole else tokens end as need
  from pieces window w as (partition by document_id order by page, paragraph, place, line rows unbounded preceding)),
backs as (select a.document_id, a.nth, min(b.nth) as back from numbered a join numbered b on a.document_id = b.document_id and b.nth between a.nth - 64 and a.nth - 1
  and a.total - a.tokens - b.total + b.tokens <= least(64, 512 - a.need) group by a.document_id, a.nth),
steps as (select n.document_id, n.nth, n.need, n.total, coalesce(back, n.nth) as back, coalesce(p.total, 0) - coalesce(q.total, 0) as before from numbered n left join backs on n.document_id = backs.document_id and n.nth = backs.nth
  left join numbered p on p.document_id = n.document_id and p.nth = n.nth - 1 left join numbered q on q.document_id = n.document_id and q.nth = coalesce(back, n.nth) - 1),
fold as (select document_id, nth, 0 as chunk_index, 1::bigint as start, 1::bigint as fresh, total, total as size from steps where nth = 1
 union all select s.document_id, s.nth, case when f.size + s.need > 512 then f.chunk_index + 1 else f.chunk_index end, case when f.size + s.need > 512 then s.back else f.start end,
  case when f.size + s.need > 512 then s.nth else f.fresh end, s.total, case when f.size + s.need > 512 then s.before + s.total - f.total else f.size + s.total - f.total end
 from fold f join steps s on s.document_id = f.document_id and s.nth = f.nth + 1),
chunks as (select document_id, chunk_index, any_value(start) as start, max(nth) as last from fold group by document_id, chunk_index)
select c.document_id, chunk_index, min(page)::int as page_from, max(page)::int as page_to, string_agg(text, ' ' order by nth) as text, sum(tokens)::int as token_count
from chunks c join numbered n on n.document_id = c.document_id and n.nth between c.start and c.last group by c.document_id, chunk_index"""


@query(PACKED)
def chunk_pages(c):
    return chunking.chunk_pages(c.pages)


@query(PACKED)
def chunker(c):
    """The same as a table function, for use in SQL."""
    chunking.register(c.spark)
    view = f"pieces_{uuid.uuid4().hex}"
    chunking.pieces(c.pages).createOrReplaceTempView(view)
    return c.spark.sql(f"select * from chunk_pieces(piece => table({view}) partition by document_id order by (page, paragraph, place, line), target => 512, overlap => 64)")


@query("select document_id, page, sha256(text) as digest, length(trim(text)) = 0 as is_blank, page = max(page) over (partition by document_id) as is_last from t_pages")
def split_pages(c):
    return c.pages.select("document_id", "page", F.sha2("text", 256).alias("digest"), (F.length(F.trim("text")) == 0).alias("is_blank"), (F.col("page") == F.max("page").over(W.partitionBy("document_id"))).alias("is_last"))


@query("select c.document_id, c.chunk_index, 'text' as kind, c.embed_model, c.embed_dim, t.slug, d.status, d.original_filename, d.title, 1 as page_from, p.pages::int as page_to from t_chunks c join t_documents d on c.document_id = d.document_id join t_tags t on d.tag_id = t.tag_id join (select document_id, max(page) as pages from t_pages group by document_id) p on p.document_id = c.document_id")
def chunk_rows(c):
    pages = c.pages.groupBy("document_id").agg(F.max("page").alias("page_to"))
    docs = c.documents.join(c.tags.select("tag_id", "slug"), "tag_id").select("document_id", "slug", "status", "original_filename", "title")
    rows = c.chunks.select("document_id", "chunk_index", "embed_model", "embed_dim").join(docs, "document_id").join(pages, "document_id")
    return rows.select("document_id", "chunk_index", F.lit("text").alias("kind"), "embed_model", "embed_dim", "slug", "status", "original_filename", "title", F.lit(1).alias("page_from"), "page_to")


def streamed(c, rows, name):
    """rows written to files, and read as a stream."""
    folder = scratch(c)
    rows.write.parquet(f"{folder}/{name}")
    return streams.read(c.spark, f"{folder}/{name}", rows.schema), folder


HASH_TTL, REQUEST_TTL = 36_000, 120
INGEST = f"""with recursive uploads as (select document_id as id, case when document_id % 3 > 0 then 'r' || document_id // 4 end as request_key, sha256 as digest, epoch_us(created_at) as us from t_documents where sha256 is not null),
bounds as (select (max(us) // 1000 - 3600000) * 1000 as upto from uploads), passed as (select * from uploads where us <= (select upto from bounds)),
asked as (select *, row_number() over (partition by request_key order by us, id) as nth from passed where request_key is not null),
requests as (select request_key, nth, id, digest, us, id as holder, digest as held, us + {REQUEST_TTL}000000 as until from asked where nth = 1
 union all select a.request_key, a.nth, a.id, a.digest, a.us, case when a.us >= r.until then a.id else r.holder end, case when a.us >= r.until then a.digest else r.held end, case when a.us >= r.until then a.us + {REQUEST_TTL}000000 else r.until end
 from requests r join asked a on a.request_key = r.request_key and a.nth = r.nth + 1),
first_asked as (select id, digest, us from passed where request_key is null union all select id, digest, us from requests where id = holder),
brought as (select *, row_number() over (partition by digest order by us, id) as nth from first_asked),
known as (select digest, nth, id, id as document, us + {HASH_TTL}000000 as until from brought where nth = 1
 union all select b.digest, b.nth, b.id, case when b.us >= k.until then b.id else k.document end, case when b.us >= k.until then b.us + {HASH_TTL}000000 else k.until end from known k join brought b on b.digest = k.digest and b.nth = k.nth + 1)
select id, case when document = id then 'created' else 'deduplicated' end as outcome, document from known
union all select r.id, 'replayed', k.document from requests r join known k on k.id = r.holder where r.id <> r.holder"""


@query(INGEST)
def stream_ingest(c):
    """Some documents are uploaded without a request key; the others share one with those uploaded minutes before or after."""
    restore = rocksdb(c)
    try:
        key = F.when(F.col("document_id") % 3 > 0, F.concat(F.lit("r"), F.floor(F.col("document_id") / 4)))
        uploads, folder = streamed(c, c.documents.filter("sha256 is not null").select(F.col("document_id").alias("id"), key.alias("request_key"), "sha256", "created_at"), "uploads")
        return streams.run_to_table(ingest.ingest(uploads, "1 hour", HASH_TTL, REQUEST_TTL), f"{folder}/out", f"{folder}/state").select("id", "outcome", "document")
    finally:
        restore()


@query("""with windows as (select step, date_trunc('hour', created_at) as start, count(*) as n, count(*) filter (event_type = 'step_failed') as failed, round(sum(value), 4) as total from t_events group by all)
select strftime(start, '%Y-%m-%d %H:%M:%S') as start, step, n, failed, total from windows where windows.start + interval 1 hour <= (select max(created_at) - interval 1 hour from t_events)""")
def stream_metrics(c):
    """Windows that the watermark has closed; the others stay in the state."""
    events, folder = streamed(c, c.events, "events")
    found = streams.run_to_table(streams.step_metrics(events), f"{folder}/out", f"{folder}/state")
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "step", "n", "failed", "total")


@query("""with each as (select document_id as key, created_at, unnest(range(0, 10)) as back from t_events), windows as (select key, date_trunc('minute', created_at) - to_minutes(back) as start, created_at from each),
counts as (select key, start, count(*) as n from windows where created_at < windows.start + interval 10 minute group by all)
select strftime(start, '%Y-%m-%d %H:%M:%S') as start, key, n, n > 1 as over from counts where counts.start + interval 10 minute <= (select max(created_at) - interval 10 minute from t_events)""")
def stream_rate_limit(c):
    requests, folder = streamed(c, c.events.select(F.col("document_id").alias("key"), "created_at"), "requests")
    found = streams.run_to_table(streams.rate_limit(requests, 1), f"{folder}/out", f"{folder}/state")
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "key", "n", "over")


@query("""select key, strftime(last, '%Y-%m-%d %H:%M:%S') as last from (select document_id as key, date_trunc('minute', created_at) as start, max(created_at) as last from t_events group by all)
where start + interval 1 minute <= (select max(created_at) - interval 1 minute from t_events)""")
def stream_last_used(c):
    requests, folder = streamed(c, c.events.select(F.col("document_id").alias("key"), "created_at"), "requests")
    found = streams.run_to_table(streams.last_used(requests), f"{folder}/out", f"{folder}/state")
    return found.select("key", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"))


@query("select id, document_id from t_events where created_at > timestamp '2024-01-20 12:00:00' - interval 10 day")
def stream_ttl(c):
    """A stream whose rows older than the time to live are dropped on the way."""
    events, folder = streamed(c, c.events.select("id", "document_id", "created_at"), "events")
    return streams.run_to_table(retain(events, "created_at", as_of(), 10).select("id", "document_id"), f"{folder}/out", f"{folder}/state")


def rocksdb(c):
    """Stateful processors need this state store; the session's own setting is put back by the caller."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = c.spark.conf.get(key, None)
    c.spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return lambda: c.spark.conf.set(key, before) if before else c.spark.conf.unset(key)


@query("""with told as (select webhook_id, id, status, epoch_us(created_at) as us from t_deliveries), passed as (select * from told where us <= (select (max(us) // 1000 - 3600000) * 1000 from told)),
islands as (select webhook_id, id, us, status, sum(case when status = 'delivered' then 1 else 0 end) over (partition by webhook_id order by us, id) as island from passed),
runs as (select webhook_id, id, us, row_number() over (partition by webhook_id, island order by us, id) as n from islands where status = 'failed')
select webhook_id, id from (select *, row_number() over (partition by webhook_id order by us, id) as first from runs where n >= 5) where first = 1""")
def stream_webhook_health(c):
    restore = rocksdb(c)
    try:
        deliveries, folder = streamed(c, c.deliveries, "deliveries")
        return streams.run_to_table(streams.webhook_health(deliveries, 5), f"{folder}/out", f"{folder}/state")
    finally:
        restore()


#: Longer times than the defaults, as the events lie hours apart.
STEP_RULES = steps.Rules(max_attempts=3, stuck_s=216_000, backoff_s=21_600, longest_s=100_000, ttl_s=864_000)
STREAM_FROM = "2024-01-12 00:00:00"
_R, _US = STEP_RULES, 1_000_000
STEP_SQL = f"""with recursive told as (select document_id, step, id, epoch_us(created_at) as us, event_type as kind from t_events),
bounds as (select (max(us) // 1000 - 3600000) * 1000 as upto from told),
e as (select *, row_number() over (partition by document_id, step order by us, id) as nth from told where kind <> 'validated' and us <= (select upto from bounds)),
fold as (select distinct document_id, step, 0::bigint as nth, 0::bigint as id, 0::bigint as us, '' as cause, 'pending' as status, 0 as attempt, null::bigint as changed, null::bigint as due,
  false as fired, false as ok, '' as status1, 0::bigint as changed1 from e
 union all select document_id, step, nth, id, us, kind, case when not ok then status2 when kind = 'step_started' then 'running' when kind = 'step_succeeded' then 'succeeded' when kind = 'step_failed' and attempt2 >= {_R.max_attempts} then 'failed' else 'pending' end,
  case when not ok then attempt2 when kind = 'uploaded' then 0 when kind = 'step_started' then attempt2 + 1 else attempt2 end, case when ok then us when gone then null else changed1 end,
  case when ok and kind = 'step_failed' and attempt2 < {_R.max_attempts} then us + least({_R.backoff_s} * (1 << attempt2), {_R.longest_s})::bigint * {_US} when not ok then due1 end, fired, ok, status1, changed1
  from (select *, kind = 'uploaded' or (kind = 'step_started' and status2 = 'pending' and due1 is null and attempt2 < {_R.max_attempts}) or (kind in ('step_succeeded', 'step_failed') and status2 = 'running') as ok
   from (select *, case when gone then 'pending' else status1 end as status2, case when gone then 0 else attempt end as attempt2
    from (select *, coalesce(status1 <> 'running' and due1 is null and changed1 + {_R.ttl_s * _US} <= us, false) as gone
     from (select e.document_id, e.step, e.nth, e.id, e.us, e.kind, f.attempt, FIRED))))),
ends as (select *, row_number() over (partition by document_id, step order by nth desc) as back from fold),
rest as (select FINAL),
changes as (select document_id, step, us, id, cause, status, attempt from fold where ok
 union all select f.document_id, f.step, f.changed1, null, case when p.status = 'running' then 'stuck' else 'retry_due' end, f.status1, p.attempt from fold f join fold p on f.document_id = p.document_id and f.step = p.step and f.nth = p.nth + 1 where f.fired
 union all select document_id, step, changed1, null, case when before = 'running' then 'stuck' else 'retry_due' end, status1, attempt from rest where fired)
select document_id, step, us as at_us, id, cause, status, attempt from changes where us > epoch_us(timestamp '{STREAM_FROM}')"""
_PASSED = f"""case when f.status = 'running' and f.changed + {_R.stuck_s * _US} <= NOW then case when f.attempt < {_R.max_attempts} then 'pending' else 'failed' end else f.status end as status1,
      case when f.status = 'running' and f.changed + {_R.stuck_s * _US} <= NOW then f.changed + {_R.stuck_s * _US} when f.due <= NOW then f.due else f.changed end as changed1, case when f.due <= NOW then null else f.due end as due1,
      coalesce((f.status = 'running' and f.changed + {_R.stuck_s * _US} <= NOW) or f.due <= NOW, false) as fired"""
STEP_SQL = STEP_SQL.replace("FIRED", _PASSED.replace("NOW", "e.us") + " from fold f join e on f.document_id = e.document_id and f.step = e.step and e.nth = f.nth + 1")
STEP_SQL = STEP_SQL.replace("FINAL", "f.document_id, f.step, f.attempt, f.status as before, " + _PASSED.replace("NOW", "(select upto from bounds)") + " from ends f where back = 1")


@query(STEP_SQL)
def stream_steps(c):
    """What is before a day is replayed in batch; from there the stream goes on, up to its watermark."""
    restore = rocksdb(c)
    try:
        day = as_of(STREAM_FROM)
        before = steps.replay(c.events, day, STEP_RULES)
        events, folder = streamed(c, c.events.filter(F.col("created_at") > day), "events")
        before.filter("cause = 'state'").write.parquet(f"{folder}/before")
        found = streams.run_to_table(steps.step_machine(events, "1 hour", STEP_RULES, c.spark.read.parquet(f"{folder}/before")), f"{folder}/out", f"{folder}/state")
        return found.drop("due").withColumnRenamed("at", "at_us")
    finally:
        restore()


@query("select event_type = 'step_failed' as dead, count(*) as n from t_events group by 1")
def stream_sink_fanout(c):
    events, folder = streamed(c, c.events, "events")
    bad = F.col("event_type") == "step_failed"
    streams.fan_out(events, f"{folder}/good", f"{folder}/bad", bad, f"{folder}/state").awaitTermination()
    return c.spark.read.parquet(f"{folder}/good").unionByName(c.spark.read.parquet(f"{folder}/bad")).groupBy(bad.alias("dead")).agg(F.count("*").alias("n"))


@query("select document_id, step, case when step in ('store', 'ocr') then 'done' else 'skipped' end as outcome, case step when 'store' then 'decompose' when 'ocr' then 'embed' when 'extract' then 'embed' end as next_step from t_steps where step in ('store', 'ocr', 'extract')")
def step_handler(c):
    def handler(outcome, following):
        return lambda rows: rows.withColumns({"outcome": F.lit(outcome), "next_step": F.lit(following)})

    return hooks.route(c.steps.select("document_id", "step"), {"store": handler("done", "decompose"), "ocr": handler("done", "embed"), "extract": handler("skipped", "embed")})


@query("select document_id, 64 as dim, 1.0::double as norm from t_documents")
def embedder(c):
    vectors = c.documents.select("document_id", hooks.embedder(64)(F.col("text")).alias("v"))
    return vectors.select("document_id", F.size("v").alias("dim"), F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


PATTERNS = ((1, "ending", r"([A-Za-z]+tion) "), (3, "heading", r"([A-Za-z]+heit)"), (2, "first", r"^([A-Za-z]+)"))


@query("with patterns as (select * from (values " + ", ".join(f"({t}, '{k}', '{p}')" for t, k, p in PATTERNS) + """) t(tag_id, key, pattern)),
met as (select p.document_id, page, key, regexp_extract(p.text, pattern, 1) as value, regexp_extract(p.text, pattern, 0) as evidence from t_pages p join t_documents d on p.document_id = d.document_id join patterns on patterns.tag_id = d.tag_id)
select document_id, key, arg_min(value, page) as value, arg_min(evidence, page) as evidence, min(page)::int as page from met where evidence <> '' group by document_id, key""")
def field_extractor(c):
    patterns = c.spark.createDataFrame(PATTERNS, "tag_id long, key string, pattern string")
    return hooks.extract_fields(c.pages.join(c.documents.select("document_id", "tag_id"), "document_id"), patterns)


@query("select document_id, step, status, attempt from t_steps where step_pos >= 4")
def steps_after(c):
    return c.steps.filter(state.position(F.col("step")) >= 4).select("document_id", "step", "status", "attempt")
