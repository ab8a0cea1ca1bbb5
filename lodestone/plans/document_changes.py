"""Queries that change documents, jobs, settings and chats; each returns the rows of the new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import changes
from lodestone.plans.model_sql import with_tables
from lodestone.plans.registry import query
from lodestone.sources.tables import AS_OF, Model

LATER = "2024-01-11 00:00:00"


def _vectors(m: Model) -> DataFrame:
    return m.vectors().select(F.concat(F.lit("vec:"), "chunk_id").alias("id"), F.concat(F.lit("doc:"), "document_id").alias("document_id"))


def _stacked(*tables: tuple[str, DataFrame, str]) -> DataFrame:
    """(kind, id, value) of several tables."""
    parts = [df.select(F.lit(kind).alias("kind"), "id", F.col(value).alias("value")) for kind, df, value in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


_STACK = """select 'document' as kind, id, status as value from docs2 union all select 'chunk', id, document_id from pieces where document_id not in (select id from gone)
union all select 'vector', 'vec:' || chunk_id, 'doc:' || document_id from vecs where 'doc:' || document_id not in (select id from gone)"""


@query("delete_document", with_tables("docs", "pieces", "vecs", "ents", sql=", gone as (select 'doc:6' as id), docs2 as (select * from docs where id <> 'doc:6') " + _STACK + """
union all select 'entity', id, case when source_document_id <> 'doc:6' then source_document_id end from ents"""))
def _(m):
    d, e = m.documents(), m.entities()
    gone = changes.owned_document(d, "doc:6", 1)
    documents, chunks, vectors, entities = changes.without_documents(d, m.chunks(), _vectors(m), e, gone)
    return _stacked(("document", documents, "status"), ("chunk", chunks, "document_id"), ("vector", vectors, "document_id"), ("entity", entities, "source_document_id"))


@query("expire_documents", with_tables("docs", "pieces", "vecs", sql=f""", gone as (select id from docs where expires_at < timestamp '{AS_OF}' and status <> 'expired'),
docs2 as (select id, case when id in (select id from gone) then 'expired' else status end as status from docs) """ + _STACK))
def _(m):
    documents, chunks, vectors = changes.with_expired(m.documents(), m.chunks(), _vectors(m), AS_OF)
    return _stacked(("document", documents, "status"), ("chunk", chunks, "document_id"), ("vector", vectors, "document_id"))


@query("delete_embeddings", with_tables("vecs", sql=" select count(*) as deleted from vecs where document_id = 7"))
def _(m):
    return changes.without_vectors(m.vectors(), 7)[1]


@query("embeddings_left", with_tables("vecs", sql=" select chunk_id, document_id, label from vecs where document_id is distinct from 7"))
def _(m):
    return changes.without_vectors(m.vectors(), 7)[0].select("chunk_id", "document_id", "label")


# ---------------------------------------------------------------- jobs

_STALE = f"status in ('pending', 'scanning', 'processing') and started_at < timestamp '{{}}' - interval 135 minute"
_SET = "select job_id, case when {0} then '{1}' else status end as status, case when {0} then {2} else error_message end as error_message, case when {0} then timestamp '{3}' else completed_at end as completed_at from jobs"
_COLUMNS = ["job_id", "status", "error_message", "completed_at"]


@query("fail_stale_jobs", with_tables("jobs", sql=" " + _SET.format(_STALE.format(AS_OF), "failed", f"'{changes.STALE}'", AS_OF)))
def _(m):
    return changes.with_stale_failed(m.jobs(), AS_OF).select(_COLUMNS)


@query("fail_active_jobs", with_tables("jobs", sql=" " + _SET.format("status in ('pending', 'scanning', 'processing')", "failed", "'worker restarted'", AS_OF)))
def _(m):
    return changes.with_active_failed(m.jobs(), AS_OF).select(_COLUMNS)


@query("cancel_job", with_tables("jobs", sql=" " + _SET.format("status in ('pending', 'scanning', 'processing') and job_id = (select max(job_id) from jobs where status = 'processing')", "cancelled", "error_message", AS_OF)))
def _(m):
    jobs = m.jobs()
    newest = jobs.where("status = 'processing'").agg(F.max("job_id")).first()[0]
    out = changes.with_cancelled(jobs, newest, AS_OF) if newest else jobs
    return out.select(_COLUMNS)


@query("job_counters", with_tables("jobs", sql=""" select job_id, case when status = 'failed' then 'cancelled' else status end as status, case when status = 'failed' then 0 else processed_files end as processed_files,
case when status = 'failed' then 0 else failed_files end as failed_files, case when status = 'failed' then 0 else skipped_files end as skipped_files from jobs"""))
def _(m):
    none = {c: F.lit(0).cast("long") for c in ("processed_files", "failed_files", "skipped_files")}
    jobs = m.jobs().withColumns({**none, "status": F.when(F.col("status") == "failed", "cancelled").otherwise(F.col("status"))})
    return changes.with_counters(jobs, m.files()).select("job_id", "status", *none)


_AGAIN = "job_id = 'job:src1' and status in ('failed', 'pending', 'processing')"


@query("retry_reset", with_tables("jobs", sql=f""" select id, case when {_AGAIN} then 'pending' else status end as status, case when {_AGAIN} then 'pending' else stage end as stage from files
union all select job_id, case when job_id = 'job:src1' then 'processing' else status end, cast(case when job_id = 'job:src1' then 0 else failed_files end as varchar) from jobs"""))
def _(m):
    jobs, files = changes.retried(m.jobs(), m.files(), "job:src1")
    return files.select("id", "status", "stage").union(jobs.select("job_id", "status", F.col("failed_files").cast("string")))


@query("trigger_job", with_tables("jobs", sql=f""" select job_id, case when {_STALE.format(LATER)} then 'failed' else status end as status, folder_id from jobs union all select 'job:new', 'pending', 'saved'"""))
def _(m):
    return changes.triggered(m.jobs(), "job:new", LATER, folder="", saved_folder="saved", default_folder="default").select("job_id", "status", "folder_id")


@query("progress_log", with_tables("files", sql=" select job_id, seq, message from (select job_id, doc_id * 2 + case when id like '%:old' then 0 else 1 end as seq, file_name as message from files) qualify row_number() over (partition by job_id order by seq desc) <= 50"))
def _(m):
    seq = F.col("doc_id") * 2 + F.when(F.col("id").endswith(":old"), 0).otherwise(1)
    return changes.progress_logs(m.files().select("job_id", seq.alias("seq"), F.col("file_name").alias("message")))


# ---------------------------------------------------------------- settings and chats


@query("latest_settings", "select user_id as key, arg_max(event_type, event_id) as value from events group by user_id")
def _(m):
    return changes.latest_values(m.read("events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq")))


_DEFAULTS = "select 0 as k union select user_id * 10 from events"


@query("settings_created", f"""with d as ({_DEFAULTS}), w as (select user_id as key, arg_max(event_type, event_id) as value from events group by user_id)
select d.k as key, coalesce(w.value, 'default') as value, w.key is null as created from d left join w on w.key = d.k""")
def _(m):
    writes = m.read("events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    asked = m.spark.range(1).select(F.col("id").alias("key")).union(writes.select(F.col("key") * 10)).distinct().withColumn("value", F.lit("default"))
    return changes.get_or_created(writes, asked)[1]


@query("artifacts_added", with_tables("convs", sql=""", old as (select 'artifact:' || conv_id || ':' || turn as artifact_id, conv_id as conversation_id from conversations where turn % 3 = 1),
new as (select 'artifact:' || conv_id || ':' || turn as artifact_id, case when conv_id % 7 = 0 then -1 else conv_id end as conversation_id from conversations where turn % 3 in (1, 2))
select artifact_id, conversation_id from old union all select artifact_id, conversation_id from new anti join old using (artifact_id) where conversation_id in (select conversation_id from convs)"""))
def _(m):
    c = m.read("conversations").where("turn % 3 in (1, 2)")
    conversation = F.when(F.col("conv_id") % 7 == 0, -1).otherwise(F.col("conv_id")).cast("long")
    new = c.select(F.concat(F.lit("artifact:"), "conv_id", F.lit(":"), "turn").alias("artifact_id"), conversation.alias("conversation_id"), F.col("text").alias("title"), F.timestamp_seconds(F.lit(1714067200) + F.col("turn")).alias("created_at"))
    return changes.with_artifacts(m.conversations(), m.artifacts(), new)[1].select("artifact_id", "conversation_id")


_NEW = """, new as (select conv_id + 1000000 as conversation_id, turn, role, text, to_timestamp(1714067200 + turn)::timestamp as created_at from conversations where conv_id % 5 = 0),
fit as (select * from new where conversation_id in (select conversation_id from convs)),
f as (select conversation_id, max(created_at) as newest, left(arg_min(text, turn) filter (role = 'user'), 80) as title from fit group by 1)"""


def _chats(m: Model) -> tuple[DataFrame, DataFrame]:
    messages = m.messages()
    new = messages.where("conversation_id % 5 = 0").withColumns({"conversation_id": F.col("conversation_id") + 1_000_000, "created_at": F.timestamp_seconds(F.lit(1714067200) + F.col("turn"))})
    return changes.with_messages(m.conversations(), messages, new)


@query("append_messages", with_tables("msgs", "convs", sql=_NEW + " select conversation_id, turn, role, created_at from msgs union all select conversation_id, turn, role, created_at from fit"))
def _(m):
    return _chats(m)[1].select("conversation_id", "turn", "role", "created_at")


@query("append_messages_conversations", with_tables("convs", sql=_NEW + " select c.conversation_id, user_id, coalesce(c.title, f.title) as title, c.created_at, greatest(updated_at, coalesce(newest, updated_at)) as updated_at from convs c left join f using (conversation_id)"))
def _(m):
    return _chats(m)[0]
