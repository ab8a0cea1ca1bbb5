"""Queries on listings, queues, batches, attachments and agents' runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import agent_runs, chat, ingest
from lodestone.operators.running import numbered
from lodestone.plans.model_sql import with_tables
from lodestone.plans.registry import query
from lodestone.sources import connectors
from lodestone.sources.scratch import saved, shared_folder
from lodestone.sources.tables import Model

# ---------------------------------------------------------------- listings


def _entries(m: Model) -> DataFrame:
    """A drive: a folder a source and a language, files in them, shortcuts to folders (one back to the top) and to files, and trash."""
    d, c = m.read("documents"), F.col
    none, no = F.lit(None).cast("string"), F.lit(False)
    place = F.concat_ws("/", "source", "lang")
    entry = lambda i, parent, name, mime, target=none, kind=none, trashed=no: [i.alias("id"), parent.alias("parent_id"), name.alias("name"), mime.alias("mime"), target.alias("target_id"), kind.alias("target_mime"), trashed.alias("trashed")]
    folder, i = F.lit(ingest.FOLDER), c("doc_id")
    folders = d.select(*entry(c("source"), F.lit("root"), c("source"), folder)).union(d.select(*entry(place, c("source"), c("lang"), folder))).distinct()
    back = d.select(*entry(F.concat(F.lit("cut:"), place), place, F.lit("back"), F.lit(ingest.SHORTCUT), F.lit("root"), folder)).distinct()
    kind = F.when(i % 9 == 0, ingest.SHORTCUT).when(i % 9 == 1, "image/png").when(i % 9 == 2, "application/zip").otherwise(ingest.READ[0])
    files = d.select(*entry(F.concat(F.lit("file:"), i), place, F.concat(F.lit("doc_"), i), kind, trashed=i % 7 == 0))
    root = m.spark.range(1).select(*entry(F.lit("root"), none, F.lit("Base"), folder))
    return root.union(folders).union(back).union(files)


_ENTRIES = """f as (select distinct source, lang from documents),
e as (select 'root' as id, null::varchar as parent_id, 'Base' as name, 'folder' as kind union all select distinct source, 'root', source, 'folder' from f
  union all select source || '/' || lang, source, lang, 'folder' from f union all select 'root', source || '/' || lang, 'back', 'folder' from f
  union all select 'file:' || doc_id, source || '/' || lang, 'doc_' || doc_id, case doc_id % 9 when 0 then 'shortcut' when 1 then 'png' when 2 then 'zip' else 'pdf' end from documents where doc_id % 7 <> 0)"""


@query("drive_walk_shortcuts", "with recursive " + _ENTRIES + """, w as (select id, name as path, kind from e where parent_id is null union all select e.id, w.path || '/' || e.name, e.kind from w join e on e.parent_id = w.id where w.kind = 'folder' and e.name <> 'back')
select id, path from w where kind = 'pdf'""")
def _(m):
    return ingest.walk(ingest.listed(_entries(m)), ["root"])


def _drive(m: Model, wanted: dict | None = None) -> DataFrame:
    """The same drive through its connector."""
    path = f"{shared_folder(m.spark, 'drive')}/entries"
    connectors.write_drive(_entries(m).withColumn("size", F.lit(None).cast("long")), path)
    return connectors.listing(m.spark, "drive", wanted, path=path)


@query("connector_walk", "with recursive " + _ENTRIES + """, w as (select id, name as path, kind from e where parent_id is null union all select e.id, w.path || '/' || e.name, e.kind from w join e on e.parent_id = w.id where w.kind = 'folder' and e.name <> 'back')
select id, path from w where kind = 'pdf'""")
def _(m):
    entries = saved(_drive(m), "listing")  # a drive is listed once, not once a level
    return ingest.walk(ingest.listed(entries.withColumn("trashed", F.lit(False))), ["root"])


@query("connector_listing", "with " + _ENTRIES + " select id, parent_id, name, cast((row_number() over (partition by parent_id order by name, id) - 1) // 100 as integer) as page from e where parent_id in ('src1/en', 'src2/en') and kind = 'pdf'")
def _(m):
    x = _drive(m, {"parent_id": ["src1/en", "src2/en"], "mime": [ingest.READ[0]]}).where(F.col("mime") == ingest.READ[0])
    place = F.row_number().over(Window.partitionBy("parent_id").orderBy("page", "name", "id")) - 1  # two folders' entries
    return x.select("id", "parent_id", "name", F.floor(place / connectors.PAGE).cast("int").alias("page"))


@query("drive_discovery", "with recursive " + _ENTRIES + """, t as (select id, row_number() over (order by name, id) - 1 as n from e where parent_id = 'root' and kind = 'folder'),
q1 as (select cast(n % 2 as integer) as scanner, id, id as path, n from t),
q2 as (select scanner, e.id, path || '/' || name as path, row_number() over (order by scanner, q1.n, name, e.id) as n from q1 join e on parent_id = q1.id where kind = 'folder' and e.name <> 'back'),
q as (select 0 as level, * from q1 union all select 1, * from q2 union all select level, scanner, 'root', path || '/back', n from (select 2 as level, scanner, path, n from q2 qualify row_number() over (partition by scanner order by n) = 1)),
q3 as (select 3 as level, q.scanner, e.id, q.path || '/' || e.name as path, row_number() over (order by q.scanner, e.name, e.id) as n from q join e on q.level = 2 and e.parent_id = 'root' and e.kind = 'folder' where not exists (select * from q1 where q1.id = e.id and q1.scanner = q.scanner)),
q4 as (select 4 as level, q3.scanner, e.id, q3.path || '/' || e.name as path, row_number() over (order by q3.scanner, q3.n, e.name, e.id) as n from q3 join e on e.parent_id = q3.id where e.kind = 'folder' and e.name <> 'back'),
x as (select q.scanner, q.level, q.n, e.id, q.path, e.name from (select * from q union all select * from q3 union all select * from q4) q join e on e.parent_id = q.id where e.kind = 'pdf')
select scanner, row_number() over (partition by scanner order by level, n, name, id) - 1 as place, id, path, name from x""")
def _(m):
    return ingest.discovered(ingest.listed(_entries(m)), "root")


@query("drive_browse", "with " + _ENTRIES + " select id, parent_id, name, kind = 'folder' as is_folder, row_number() over (order by kind <> 'folder', name, id, parent_id) - 1 as place from e where kind in ('folder', 'png', 'pdf')")
def _(m):
    seen = ingest.browsable(ingest.listed(_entries(m))).withColumn("is_folder", F.col("mime") == ingest.FOLDER)
    placed = numbered(seen.withColumn("last", ~F.col("is_folder")), ["last", "name", "id", "parent_id"], "place")
    return placed.select("id", "parent_id", "name", "is_folder", "place")


@query("drive_import", """with x as (select doc_id, 'f' || doc_id || '.' || (['PDF', 'png', 'doc', 'zip', 'txt', 'docx'])[cast(doc_id % 6 as integer) + 1] as file_name from documents)
select file_name, case doc_id % 6 when 0 then 'application/pdf' when 1 then 'image/png' when 4 then 'text/plain' else 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' end as mime from x where doc_id % 6 <> 3""")
def _(m):
    kinds = F.array(*map(F.lit, ("PDF", "png", "doc", "zip", "txt", "docx")))
    i = F.col("doc_id")
    names = m.read("documents").select(F.concat(F.lit("f"), i, F.lit("."), F.get(kinds, (i % 6).cast("int"))).alias("file_name"))
    return ingest.importable(names)


@query("file_classification", with_tables("files", sql=" select id, case when doc_id % 3 = 0 and id not like '%:old' then '{\"major\": \"' || split_part(folder_path, '/', 1) || '\"}' else '{}' end as classification from files"))
def _(m):
    found = m.files().where("doc_id % 3 = 0 and id not like '%:old'")
    classes = found.select(F.col("id").alias("file_id"), F.concat(F.lit('{"major": "'), F.split("folder_path", "/")[0], F.lit('"}')).alias("classification"))
    return ingest.classified(m.files(), classes).select("id", "classification")


@query("download_failures", with_tables("files", sql=" select id, case doc_id % 4 when 0 then 'skipped' when 1 then 'skipped' else 'failed' end as stage from files"))
def _(m):
    errors = F.array(*map(F.lit, ("403: exportSizeLimitExceeded", "x cannotExportFile y", "timeout", "500")))
    return m.files().select("id", ingest.failure_stage(F.get(errors, (F.col("doc_id") % 4).cast("int"))).alias("stage"))


@query("documents_filtered", with_tables("docs", sql=" select id, filename from docs where status = 'ready' and user_id = 3"))
def _(m):
    return ingest.filtered(m.documents(), status="ready", source=None, user_id=3).select("id", "filename")


@query("available_models", """with k as (select distinct event_type as model, case when event_type in ('click', 'error') then 'a' when event_type = 'view' then 'b' else 'c' end as provider, case when event_type in ('click', 'error') then 3 when event_type = 'view' then 2 else 1 end as priority, event_type <> 'error' as is_default from events)
select model, provider, model = (select arg_min(model, struct_pack(p := priority, m := model)) from k where provider in ('a', 'b') and is_default) as picked from k where provider in ('a', 'b')""")
def _(m):
    c = F.col("model")
    models = m.read("events").select(F.col("event_type").alias("model")).distinct()
    by = lambda a, b, o: F.when(c.isin("click", "error"), a).when(c == "view", b).otherwise(o)
    models = models.select("model", by("a", "b", "c").alias("provider"), by(3, 2, 1).alias("priority"), (c != "error").alias("is_default"))
    keys = m.spark.createDataFrame([("a", "user"), ("b", "server"), ("b", "user")], "provider string, owner string")
    return ingest.available_models(models, keys)


# ---------------------------------------------------------------- queues and batches


@query("next_files", with_tables("files", sql=" select id, created_at from files where status = 'pending' order by created_at, id limit 20"))
def _(m):
    return ingest.next_files(m.files()).select("id", "created_at")


@query("file_monitor", with_tables("files", sql=" select id, status, row_number() over (order by status <> 'processing', created_at desc, id) as place from files qualify place <= 100"))
def _(m):
    top = ingest.running_first(m.files()).limit(100)
    return top.select("id", "status", (F.monotonically_increasing_id() + 1).alias("place"))  # the limit leaves one partition, in order


@query("pipeline_counters", with_tables("files", sql=""" select count(*) filter (stage in ('downloaded', 'extracting', 'extracted', 'embedding', 'embedded', 'kg_done', 'embed_failed', 'kg_failed')) as downloaded,
count(*) filter (stage in ('extracted', 'embedding', 'embedded', 'kg_done', 'embed_failed', 'kg_failed')) as extracted, count(*) filter (stage in ('embedded', 'kg_done', 'kg_failed')) as embedded, count(*) filter (stage = 'kg_done') as kg_done,
count(*) filter (status = 'failed') as failed, count(*) filter (status = 'skipped') as skipped, count(*) filter (retry_count > 0 and stage = 'kg_done') as retry_succeeded, count(*) filter (retry_count > 0 and status = 'failed') as retry_failed from files"""))
def _(m):
    return ingest.pipeline_counters(m.files())


@query("embed_batches", with_tables("files", sql=""", r as (select job_id, id as file_id, size_bytes // 100000 + 1 as n, row_number() over (partition by job_id order by created_at, id) as k from files),
b as (select job_id, file_id, n, k, 0 as batch, n as held, 1 as c from r where k = 1
  union all select r.job_id, r.file_id, r.n, r.k, case when held >= 100 or c >= 5 then batch + 1 else batch end, case when held >= 100 or c >= 5 then r.n else held + r.n end, case when held >= 100 or c >= 5 then 1 else c + 1 end
  from b join r on r.job_id = b.job_id and r.k = b.k + 1)
select job_id, file_id, n as n_chunks, cast(batch as bigint) as batch from b"""))
def _(m):
    f = m.files()
    rows = f.select("job_id", F.col("id").alias("file_id"), F.unix_micros("created_at").alias("seq"), (F.floor(F.col("size_bytes") / 100000) + 1).alias("n_chunks"))
    return ingest.embed_batches(rows)


@query("batch_outcomes", with_tables("files", sql=" select id, case when doc_id % 3 = 0 then 'embed_failed' when doc_id % 5 = 0 then 'kg_failed' else 'kg_done' end as stage from files"))
def _(m):
    return m.files().select("id", ingest.outcome(F.col("doc_id") % 3 != 0, F.col("doc_id") % 5 != 0).alias("stage"))


_RETRY = "case when (regexp_extract({0}, '[0-9]+', 0)::bigint + {1}) % 3 = 0 then 'kg_done' when {2} = 'download' and (regexp_extract({0}, '[0-9]+', 0)::bigint + {1}) % 3 = 1 then 'embed_failed' when {2} = 'download' then 'failed' else 'kg_failed' end"


@query("retry_attempts", with_tables("files", sql=f""", a as (
  select id, retry_count + 1 as attempt, case when stage in ('failed', 'downloading') then 'download' else 'embed' end as step from files where stage in ('failed', 'downloading', 'embed_failed', 'kg_failed') and retry_count < case when stage in ('failed', 'downloading') then 2 else 3 end
  union all select id, attempt + 1, case when s = 'failed' then 'download' else 'embed' end from (select *, {_RETRY.format('id', 'attempt', 'step')} as s from a) where s <> 'kg_done' and attempt < case when s = 'failed' then 2 else 3 end),
o as (select *, {_RETRY.format('id', 'attempt', 'step')} as stage from a)
select id, cast(attempt as integer) as attempt, step, cast(least(2 ** (attempt - 1), 30) as bigint) as wait_seconds, stage, stage <> 'kg_done' and attempt >= case when stage = 'failed' then 2 else 3 end as given_up from o"""))
def _(m):
    def outcome(i, attempt, step):
        n = F.regexp_extract(i, "[0-9]+", 0).cast("long") + attempt
        return F.when(n % 3 == 0, "kg_done").when((step == "download") & (n % 3 == 1), "embed_failed").when(step == "download", "failed").otherwise("kg_failed")

    return ingest.retried(m.files(), outcome, most_download=2, most_embed=3)


# ---------------------------------------------------------------- chats


@query("conversation_artifacts", " select 'artifact:' || conv_id || ':' || turn as artifact_id, left(text, 80) as title from conversations where conv_id = 3 and turn % 3 = 1")
def _(m):
    return chat.artifacts_of(m.artifacts(), m.conversations(), 3, 3).select("artifact_id", "title")


@query("linked_users", "select 'user:' || c_custkey as user_id, lower(c_name) || '@example.org' as email, 'google-' || c_custkey as provider_user_id from customer where c_custkey % 3 = 0")
def _(m):
    return chat.linked_users(*m.users(), "google")


@query("attachments_missing", "select 'file:' || doc_id as id from documents where doc_id % 4 = 0 and doc_id % 5 <> 1")
def _(m):
    d = m.read("documents").select(F.concat(F.lit("file:"), "doc_id").alias("id"), "doc_id")
    return chat.missing(d.where("doc_id % 4 = 0"), d.where("doc_id % 5 = 1"))


@query("attachment_contexts", """with x as (select doc_id, doc_id // 4 as m, 'f' || doc_id as n, text as t from documents)
select m as message_id, coalesce(string_agg('[Attached: ' || n || ']' || chr(10) || '<file_content>' || chr(10) || case when doc_id % 4 = 1 then chr(65533) || chr(65533) else '' end || t || chr(10) || '</file_content>', chr(10) || chr(10) order by doc_id) filter (doc_id % 4 < 2), '') as context,
coalesce(string_agg('data:image/png;base64,' || base64(encode(t)), ' ' order by doc_id) filter (doc_id % 4 = 2), '') as images from x group by m""")
def _(m):
    i = F.col("doc_id")
    mime = F.when(i % 4 < 2, "text/plain").when(i % 4 == 2, "image/png").otherwise("application/zip")
    files = m.read("documents").select(F.floor(i / 4).alias("message_id"), i.alias("seq"), F.concat(F.lit("f"), i).alias("file_name"), mime.alias("mime"), F.concat(F.when(i % 4 == 1, F.unhex(F.lit("fffe"))).otherwise(F.unhex(F.lit(""))), F.encode("text", "utf-8")).alias("content"))
    return chat.attachment_context(files).select("message_id", "context", F.array_join("images", " ").alias("images"))


@query("interleaved_steps", """with a as (select conv_id, turn, role, text, row_number() over (partition by conv_id, role = 'user' order by turn) as i from conversations)
select conv_id as message_id, cast(row_number() over (partition by conv_id order by i, role <> 'user') - 1 as integer) as place, case when role = 'user' then 'thinking' else 'tool_call' end as kind, text as content from a""")
def _(m):
    from pyspark.sql import Window

    c = m.read("conversations").withColumn("user", F.col("role") == "user")
    c = c.withColumn("i", F.row_number().over(Window.partitionBy("conv_id", "user").orderBy("turn"))).select(F.col("conv_id").alias("message_id"), "i", F.col("text").alias("content"), "user")
    return chat.interleaved(c.where("user").drop("user"), c.where("not user").drop("user"))


def _events(m: Model) -> DataFrame:
    """Runs of agents, made of events: a run a user, starts and results of two tools, thoughts, narrations and tokens by turns."""
    i = F.col("event_id")
    kind = F.get(F.array(*map(F.lit, ("tool_start", "thinking", "tool_start", "tool_result", "narration_end", "tool_result", "token", "tool_result"))), (i * 5 % 8).cast("int"))
    return m.read("events").select(
        F.col("user_id").alias("run_id"), i.alias("seq"), kind.alias("event"), F.when(kind.startswith("tool"), F.when(i % 3 == 0, "search").otherwise("fetch")).alias("name"),
        F.concat(F.lit("e"), i).alias("content"), (i % 11 == 0).alias("failed"),
    )


_EVENTS = """with recursive e as (select user_id as run_id, event_id as seq, (['tool_start', 'thinking', 'tool_start', 'tool_result', 'narration_end', 'tool_result', 'token', 'tool_result'])[cast(event_id * 5 % 8 as integer) + 1] as event,
  case when event_id % 3 = 0 then 'search' else 'fetch' end as name, 'e' || event_id as content, event_id % 11 = 0 as failed from events)"""


@query("agent_steps", _EVENTS + """, t as (select *, row_number() over (partition by run_id, name order by seq) as k from e where event like 'tool%'),
f as (select run_id, name, k, case when event = 'tool_start' then [seq] else []::bigint[] end as waiting, null::bigint as ended, seq as by_seq from t where k = 1
  union all select t.run_id, t.name, t.k, case when event = 'tool_start' then list_append(waiting, seq) else waiting[:-2] end, case when event = 'tool_result' then waiting[-1] end, seq
  from f join t on t.run_id = f.run_id and t.name = f.name and t.k = f.k + 1)
select s.run_id, s.seq, 'tool_call' as kind, s.name, null as content, case when r.seq is null then 'running' when r.failed then 'error' else 'done' end as status, r.content as summary
from e s left join f on f.run_id = s.run_id and f.name = s.name and f.ended = s.seq left join e r on r.run_id = s.run_id and r.seq = f.by_seq where s.event = 'tool_start'
union all select run_id, seq, case event when 'thinking' then 'thinking' else 'narration' end, null, content, null, null from e where event in ('thinking', 'narration_end')""")
def _(m):
    return chat.assembled_steps(_events(m))


@query("agent_answers", _EVENTS + """, c as (select run_id, coalesce(max(seq) filter (event = 'narration_end'), -1) as cut from e group by 1)
select run_id, coalesce(string_agg(content, '' order by seq) filter (event = 'token' and seq > cut), '') as answer from e join c using (run_id) group by run_id""")
def _(m):
    return chat.answers(_events(m))


# ---------------------------------------------------------------- logs of runs


def _log(m: Model) -> DataFrame:
    """Logs of runs: what events of a user are in order of time, a run a user."""
    kind = F.get(F.array(*map(F.lit, ("tool_start", "thinking", "tool_start", "tool_result", "tool_result", "narration_end", "tool_start", "token"))), (F.col("event_id") * 5 % 8).cast("int"))
    return m.read("events").select(F.col("user_id").alias("run_id"), F.struct("ts", "event_id").alias("seq"), "ts", kind.alias("event"))


_LOG = """with e as (select user_id as run_id, event_id, ts, (['tool_start', 'thinking', 'tool_start', 'tool_result', 'tool_result', 'narration_end', 'tool_start', 'token'])[cast(event_id * 5 % 8 as integer) + 1] as event from events),
f as (select *, case when event <> 'tool_result' and lag(event) over w = 'tool_result' then 1 else 0 end as b, sum(case event when 'tool_start' then 1 when 'tool_result' then -1 else 0 end) over w as s,
  date_diff('microsecond', ts, lead(ts) over w) as micros from e window w as (partition by run_id order by ts, event_id)),
x as (select *, 1 + sum(b) over w as iteration, s - least(0, min(s) over w) as open from f window w as (partition by run_id order by ts, event_id rows unbounded preceding))"""


@query("agent_run_summary", _LOG + """ select run_id, cast(max(iteration) as bigint) as iterations, count(*) filter (event = 'tool_start') as calls, count(*) filter (event = 'tool_start' and iteration > 5) as calls_cut, cast(max(open) as bigint) as peak_open,
cast(coalesce(sum(micros) filter (open >= 1), 0) as bigint) as busy_micros, cast(coalesce(sum(micros) filter (open >= 2), 0) as bigint) as parallel_micros from x group by run_id""")
def _(m):
    return agent_runs.summary(_log(m))


@query("agent_iterations", _LOG + """ select run_id, cast(iteration as bigint) as iteration, count(*) as events, count(*) filter (event = 'tool_start') as calls, count(*) filter (event = 'tool_result') as results, cast(max(open) as bigint) as peak_open,
cast(coalesce(sum(micros), 0) as bigint) as micros, iteration > 5 as cut from x group by run_id, iteration""")
def _(m):
    return agent_runs.iterations(_log(m))
