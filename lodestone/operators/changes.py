"""Changes of documents, jobs, settings and chats: each takes tables and gives their new versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import shortened_to
from lodestone.operators.ingest import RETRIED, expired, stale_jobs

ACTIVE = ["pending", "scanning", "processing"]
STALE = "job exceeded its maximum run time"


class NotFoundError(LookupError):
    """No row has the key."""


class JobRunningError(RuntimeError):
    """Another job is active."""


# ---------------------------------------------------------------- documents


def without_documents(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, entities: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The tables without the documents ``gone`` (id): their chunks and vectors go with them, their entities stay without a source.

    chunks and vectors name their document in document_id, entities in source_document_id.
    """
    ids = gone.select("id").distinct()
    of = ids.withColumnRenamed("id", "document_id")
    mine = ids.select(F.col("id").alias("source_document_id"), F.lit(True).alias("_gone"))
    freed = entities.join(mine, "source_document_id", "left").withColumn("source_document_id", F.when(F.col("_gone").isNull(), F.col("source_document_id")))
    return (
        documents.join(ids, "id", "left_anti"), chunks.join(of, "document_id", "left_anti"), vectors.join(of, "document_id", "left_anti"),
        freed.select(entities.columns),
    )


def owned_document(documents: DataFrame, document_id: str, user_id: int) -> DataFrame:
    """The one row (id) to delete; NotFoundError if the user has no such document."""
    found = documents.where((F.col("id") == document_id) & (F.col("user_id") == user_id)).select("id").limit(1)
    if found.isEmpty():
        raise NotFoundError(document_id)
    return found


def without_vectors(vectors: DataFrame, document_id) -> tuple[DataFrame, DataFrame]:
    """(the vectors of other documents, one row: how many went)."""
    mine = F.col("document_id").eqNullSafe(F.lit(document_id))
    return vectors.where(~mine), vectors.agg(F.count_if(mine).alias("deleted"))


def with_expired(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, vectors): documents past their time are marked expired and lose chunks and vectors."""
    due = expired(documents, as_of).select("id")
    marked = documents.join(due.select("id", F.lit(True).alias("_due")), "id", "left")
    marked = marked.withColumn("status", F.when(F.col("_due"), "expired").otherwise(F.col("status"))).select(documents.columns)
    of = due.withColumnRenamed("id", "document_id")
    return marked, chunks.join(of, "document_id", "left_anti"), vectors.join(of, "document_id", "left_anti")


# ---------------------------------------------------------------- jobs


def _failed(jobs: DataFrame, which, as_of: str, error: str) -> DataFrame:
    at = F.lit(as_of).cast("timestamp")
    return jobs.withColumns({
        "status": F.when(which, "failed").otherwise(F.col("status")),
        "error_message": F.when(which, F.lit(error)).otherwise(F.col("error_message")),
        "completed_at": F.when(which, at).otherwise(F.col("completed_at")),
    })


def with_stale_failed(jobs: DataFrame, as_of: str, minutes: int = 135) -> DataFrame:
    """Jobs, the active ones that started more than so long ago failed."""
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"interval {minutes} minutes")
    return _failed(jobs, F.coalesce(F.col("status").isin(ACTIVE) & (F.col("started_at") < cutoff), F.lit(False)), as_of, STALE)


def with_active_failed(jobs: DataFrame, as_of: str) -> DataFrame:
    """Jobs as a worker finds them when it starts: none of the active ones can be running."""
    return _failed(jobs, F.coalesce(F.col("status").isin(ACTIVE), F.lit(False)), as_of, "worker restarted")


def with_counters(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Jobs with the counters that their files give; a cancelled job keeps its own."""
    names = {"processed_files": "completed", "failed_files": "failed", "skipped_files": "skipped"}
    tally = files.groupBy("job_id").agg(*(F.count_if(F.col("status") == s).alias(f"_{c}") for c, s in names.items()))
    new = {c: F.when(F.col("status") == "cancelled", F.col(c)).otherwise(F.coalesce(f"_{c}", F.lit(0))) for c in names}
    return jobs.join(tally, "job_id", "left").withColumns(new).select(jobs.columns)


def with_cancelled(jobs: DataFrame, job_id: str, as_of: str) -> DataFrame:
    """Jobs, this one cancelled if it is active; NotFoundError if there is none."""
    if jobs.where(F.col("job_id") == job_id).isEmpty():
        raise NotFoundError(job_id)
    it = (F.col("job_id") == job_id) & F.col("status").isin(ACTIVE)
    return jobs.withColumns({
        "status": F.when(it, "cancelled").otherwise(F.col("status")),
        "completed_at": F.when(it, F.lit(as_of).cast("timestamp")).otherwise(F.col("completed_at")),
    })


def retried(jobs: DataFrame, files: DataFrame, job_id: str) -> tuple[DataFrame, DataFrame]:
    """(jobs, files): the job's retryable files pending without error, the job processing without failures. ValueError if no file is retryable."""
    again = (F.col("job_id") == job_id) & F.col("status").isin(RETRIED)
    if files.where(again).isEmpty():
        raise ValueError(f"{job_id} has no files to retry")
    reset = files.withColumns({c: F.when(again, "pending").otherwise(F.col(c)) for c in ("stage", "status")})
    if "error" in files.columns:
        reset = reset.withColumn("error", F.when(~again, F.col("error")))
    it = F.col("job_id") == job_id
    new = {"status": F.when(it, "processing").otherwise(F.col("status")), "failed_files": F.when(it, 0).otherwise(F.col("failed_files"))}
    return jobs.withColumns({**new, "completed_at": F.when(~it, F.col("completed_at")), "error_message": F.when(~it, F.col("error_message"))}), reset.select(files.columns)


def triggered(jobs: DataFrame, job_id: str, as_of: str, folder: str | None = None, saved_folder: str | None = None, default_folder: str | None = None) -> DataFrame:
    """Jobs with a new pending one, stale ones failed first; JobRunningError if one is active then.

    The folder is the request's, or the saved one, or the default; empty names count as none.
    """
    now = with_stale_failed(jobs, as_of)
    if not now.where(F.col("status").isin(ACTIVE)).isEmpty():
        raise JobRunningError("a job is active")
    chosen = folder or saved_folder or default_folder or None
    values = {"job_id": F.lit(job_id), "status": F.lit("pending"), "folder_id": F.lit(chosen).cast("string"), "started_at": F.lit(as_of).cast("timestamp")}
    new = [values.get(f.name, F.lit(0) if f.name.endswith("_files") else F.lit(None)).cast(f.dataType).alias(f.name) for f in jobs.schema]
    return now.union(jobs.sparkSession.range(1).select(*new))


def progress_logs(entries: DataFrame, most: int = 50) -> DataFrame:
    """(job_id, seq, message): each job's last ``most`` log entries by seq; each task sends on no more than so many of a job."""
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("seq")))
    return entries.withColumn("r", rank).where(F.col("r") <= most).select("job_id", "seq", "message")


# ---------------------------------------------------------------- settings and chats


def latest_values(writes: DataFrame) -> DataFrame:
    """(key, value) after all writes (key, value, seq): the newest of each key."""
    return writes.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def get_or_created(settings: DataFrame, defaults: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all settings, the asked ones) of settings (key, value, seq) and defaults (key, value): the newest value of an asked key,
    null ones too, or its default where it was never written; defaults are written then, with seq 0."""
    now = latest_values(settings).withColumn("_there", F.lit(True))
    asked = defaults.dropDuplicates(["key"]).join(now.withColumnRenamed("value", "_now"), "key", "left")
    new = asked.where("_there is null").select("key", "value", F.lit(0).cast(settings.schema["seq"].dataType).alias("seq"))
    return settings.select("key", "value", "seq").union(new), asked.select("key", F.when(F.col("_there"), F.col("_now")).otherwise(F.col("value")).alias("value"), F.col("_there").isNull().alias("created"))


def with_artifacts(conversations: DataFrame, artifacts: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, artifacts) after new artifacts: those of no conversation are left out, of an id that is there too; a
    conversation is as new as its newest artifact."""
    fits = new.join(conversations.select("conversation_id"), "conversation_id", "left_semi").join(artifacts.select("artifact_id"), "artifact_id", "left_anti")
    fits = fits.select(artifacts.columns)
    at = fits.groupBy("conversation_id").agg(F.max("created_at").alias("_at"))
    newer = conversations.join(at, "conversation_id", "left").withColumn("updated_at", F.greatest("updated_at", "_at"))
    return newer.select(conversations.columns), artifacts.union(fits)


def with_messages(conversations: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) after new messages: conversations are as new as their newest message, and untitled ones get their
    first message of a user, at most 80 characters of it, as title. Messages to no conversation are left out."""
    fits = new.join(conversations.select("conversation_id"), "conversation_id", "left_semi").select(messages.columns)
    first = F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.struct("created_at", "turn")))
    news = fits.groupBy("conversation_id").agg(F.max("created_at").alias("_at"), first.alias("_first"))
    joined = conversations.join(news, "conversation_id", "left").withColumns({
        "updated_at": F.greatest("updated_at", "_at"), "title": F.coalesce("title", shortened_to(F.col("_first"), 80)),
    })
    return joined.select(conversations.columns), messages.union(fits)
