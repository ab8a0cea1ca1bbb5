"""Files on their way into a corpus: scanning, guards, states, retries, roll-ups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import extension, path_leaf, path_parent
from lodestone.operators.running import numbered, numbered_within
from lodestone.sources.scratch import saved

#: Types of files that are read, and what entries without content are (fixed values of the source's API).
FOLDER, SHORTCUT = "application/vnd.google-apps.folder", "application/vnd.google-apps.shortcut"
READ = [
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.google-apps.document",
    "application/vnd.google-apps.spreadsheet",
    "application/vnd.google-apps.presentation",
]
#: Types that a chat can attach, extensions that stand for them, and errors of the source's API that mean a file can't be exported (fixed values).
ATTACHABLE = [
    "image/png", "image/jpeg", "image/gif", "image/webp", "text/plain", "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.google-apps.document",
]
EXTENSIONS = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "txt": "text/plain", "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
UNEXPORTABLE = ["exportSizeLimitExceeded", "fileNotExportable", "cannotExportFile"]
#: Stages by how far a file has come.
PASSED = ["pending", "downloading", "downloaded", "extracting", "extracted", "embedding", "embed_failed", "embedded", "kg_failed", "kg_done"]
ENDED = ["kg_done", "failed", "skipped", "embed_failed", "kg_failed", "cancelled"]
RETRIED = ["failed", "pending", "processing"]
#: Files of a job in a block when batches are numbered.
BLOCK = 100_000


def entry_action(mime: Column) -> Column:
    """What to do with a folder's entry: recurse, keep or drop."""
    return F.when(mime == FOLDER, "recurse").when(mime.isin(READ), "keep").otherwise("drop")


def size_action(size: Column, most_mb: float = 50) -> Column:
    """skipped above the limit, else pending; unknown and empty sizes pass."""
    return F.when(size > most_mb * 1024 * 1024, "skipped").otherwise("pending")


def latest_files(files: DataFrame) -> DataFrame:
    """The newest row of each drive_file_id (the larger id at a tie), by an aggregate with partial maxima."""
    rest = [c for c in files.columns if c not in ("drive_file_id", "created_at", "id")]
    newest = F.max_by(F.struct("created_at", "id", *rest), F.struct("created_at", "id")).alias("r")
    return files.groupBy("drive_file_id").agg(newest).select("drive_file_id", "r.*").select(files.columns)


def already_indexed(documents: DataFrame) -> DataFrame:
    """(drive_file_id, document_id) of base documents from a drive that are there or on their way."""
    held = documents.where("source = 'google_drive' and is_base_knowledge and status in ('ready', 'processing')")
    return held.select(F.get_json_object("metadata", "$.drive_file_id").alias("drive_file_id"), F.col("id").alias("document_id")).where("drive_file_id is not null")


def marked_known(files: DataFrame, documents: DataFrame, force: bool = False) -> DataFrame:
    """files with ``action``: skip if a document of theirs exists, else process (all, if forced)."""
    if force:
        return files.withColumn("action", F.lit("process"))
    known = already_indexed(documents).select("drive_file_id", F.lit(True).alias("known")).distinct()
    return files.join(known, "drive_file_id", "left").withColumn("action", F.when(F.col("known"), "skip").otherwise("process")).drop("known")


def expired(documents: DataFrame, as_of: str) -> DataFrame:
    return documents.where((F.col("expires_at") < F.lit(as_of).cast("timestamp")) & (F.col("status") != "expired"))


def stale_jobs(jobs: DataFrame, as_of: str, minutes: int = 135) -> DataFrame:
    """Active jobs that started more than so long ago."""
    return jobs.where(F.col("status").isin("pending", "processing") & (F.col("started_at") < F.lit(as_of).cast("timestamp") - F.expr(f"interval {minutes} minutes")))


def folder_rollup(files: DataFrame) -> DataFrame:
    """(path, depth, place, total, completed) of every folder, files of folders below included; the empty path counts all files.

    place: a folder's number, from 1, among those of its parent, by lower-case name.
    A file is counted for each prefix of its path: depth rows a file, summed in each task first.
    """
    parts = F.split("folder_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    paths = F.when(F.col("folder_path") != "", F.concat(F.array(F.lit("")), above)).otherwise(F.array(F.lit("")))
    rows = files.select(F.explode(paths).alias("path"), (F.col("status") == "completed").cast("long").alias("done"))
    sums = rows.groupBy("path").agg(F.count(F.lit(1)).alias("total"), F.sum("done").alias("completed"))
    depth = F.when(F.col("path") == "", -1).otherwise(F.size(F.split("path", "/")) - 1)
    order = Window.partitionBy("depth", path_parent(F.col("path"))).orderBy(F.lower(path_leaf(F.col("path"))), "path")
    return sums.withColumn("depth", depth).withColumn("place", F.row_number().over(order))


def listed(entries: DataFrame) -> DataFrame:
    """Entries (id, parent_id, name, mime, target_id, target_mime, trashed) as a folder's listing shows them: id, parent_id, name, mime.

    Trashed ones go, and a shortcut to a folder stands for that folder.
    """
    to_folder = (F.col("mime") == SHORTCUT) & (F.col("target_mime") == FOLDER) & F.col("target_id").isNotNull()
    return entries.where("not coalesce(trashed, false)").select(
        F.when(to_folder, F.col("target_id")).otherwise(F.col("id")).alias("id"), "parent_id", "name", F.when(to_folder, FOLDER).otherwise(F.col("mime")).alias("mime")
    )


def folders_first(entries: DataFrame) -> DataFrame:
    """Entries in the order in which a browser shows them."""
    return entries.orderBy(F.col("mime") != FOLDER, "name", "id")


def browsable(entries: DataFrame) -> DataFrame:
    """Folders, and files that a chat can attach."""
    return entries.where((F.col("mime") == FOLDER) | F.col("mime").isin(ATTACHABLE))


def walk(entries: DataFrame, roots: list[str]) -> DataFrame:
    """(id, path) of the readable files under the root folders; entries: id, parent_id, name, mime.

    Breadth first, a join a level, until no folder is new. A folder reached
    again, through a shortcut, isn't entered again; of several ways to one on the
    same level the smaller path counts. Levels are written, so that none is planned twice.
    """
    front = folders = saved(entries.where(F.col("id").isin(roots)).groupBy("id").agg(F.min("name").alias("path")), "folders")
    kept = None
    while True:
        below = entries.join(front.select(F.col("id").alias("parent_id"), "path"), "parent_id")
        below = saved(below.select("id", F.concat("path", F.lit("/"), "name").alias("path"), entry_action(F.col("mime")).alias("action")), "entries")
        files = below.where("action = 'keep'").select("id", "path")
        kept = files if kept is None else kept.union(files)
        new = below.where("action = 'recurse'").groupBy("id").agg(F.min("path").alias("path")).join(folders.select("id"), "id", "left_anti")
        front = saved(new, "folders")
        if front.isEmpty():
            return kept
        folders = folders.union(front)


def classified(files: DataFrame, classes: DataFrame) -> DataFrame:
    """files with their classification (file_id, classification), an empty object where there is none."""
    named = classes.select(F.col("file_id").alias("id"), "classification").dropDuplicates(["id"])
    return files.join(named, "id", "left").withColumn("classification", F.coalesce("classification", F.lit("{}")))


def failure_stage(error: Column) -> Column:
    """What becomes of a file whose download failed: skipped if it can't be exported at all, else failed."""
    return F.when(F.greatest(*(error.contains(e) for e in UNEXPORTABLE)), "skipped").otherwise("failed")


def importable(files: DataFrame) -> DataFrame:
    """files (file_name, ...) that a chat can attach, with the MIME type that their extension gives."""
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return files.withColumn("mime", F.element_at(known, extension(F.col("file_name")))).where(F.col("mime").isin(ATTACHABLE))


def available_models(models: DataFrame, keys: DataFrame) -> DataFrame:
    """models (model, provider, priority, is_default) of the providers with a key (provider, owner), and which of them is picked.

    Picked is the default model of the provider of least priority.
    """
    there = models.join(keys.select("provider").distinct(), "provider", "left_semi")
    best = there.where("is_default").agg(F.min_by("model", F.struct("priority", "model")).alias("best"))
    return there.crossJoin(F.broadcast(best)).select("model", "provider", F.coalesce(F.col("model") == F.col("best"), F.lit(False)).alias("picked"))  # one row


def next_files(files: DataFrame, n: int = 20) -> DataFrame:
    """The work queue's next n pending files, oldest first."""
    return files.where("status = 'pending'").orderBy("created_at", "id").limit(n)


def running_first(files: DataFrame) -> DataFrame:
    """Files as a monitor lists them: those in work first, then the newest."""
    return files.orderBy(F.col("status") != "processing", F.desc("created_at"), "id")


def pipeline_counters(files: DataFrame) -> DataFrame:
    """One row: how many files passed each step, ended early, or were tried again with or without success."""
    reached = lambda stage: F.count_if(F.col("stage").isin(PASSED[PASSED.index(stage):]))
    again = F.col("retry_count") > 0
    return files.agg(
        reached("downloaded").alias("downloaded"), reached("extracted").alias("extracted"), F.count_if(F.col("stage").isin("embedded", "kg_done", "kg_failed")).alias("embedded"),
        F.count_if(F.col("stage") == "kg_done").alias("kg_done"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(again & (F.col("stage") == "kg_done")).alias("retry_succeeded"), F.count_if(again & (F.col("status") == "failed")).alias("retry_failed"),
    )


def filtered(rows: DataFrame, **equal) -> DataFrame:
    """rows whose columns equal the given values; what is None isn't asked for."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def embed_batches(files: DataFrame, chunks: int = 100, most_files: int = 5, block: int = BLOCK) -> DataFrame:
    """files (job_id, file_id, seq, n_chunks) with the number, from 0, of their job's batch that each goes into, in order of seq, then file_id.

    A batch closes once it has ``chunks`` chunks or ``most_files`` files. A job is
    cut into blocks of ``block`` files. What a block needs to know of those before
    is how many files of an open batch end them, fewer than ``most_files``: a pass
    over the blocks batches each for every such number, from the last files of the
    block before, and what a block makes of them leads to the next, a row a block.
    So a job of any length is as many groups as blocks.

    A null n_chunks counts as none, a null job_id as a job. Columns beyond these are ignored.
    """
    if chunks < 1 or most_files < 1 or block < most_files:
        raise ValueError("chunks and most_files start at 1, and a block holds a batch")
    rows = files.select(F.col("job_id").cast("string"), F.col("file_id").cast("string"), F.col("seq").cast("long"), F.coalesce(F.col("n_chunks").cast("long"), F.lit(0)).alias("n"), F.col("n_chunks").cast("long"))
    placed = numbered_within(rows, "job_id", ["seq", "file_id"], "k")
    own = F.floor(F.col("k") / block)
    blocks = F.when(F.col("k") % block > block - most_files, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = placed.withColumn("block", F.explode(blocks)).repartition("job_id", "block").sortWithinPartitions("job_id", "block", "k")
    shape = "job_id string, block long, file_id string, n_chunks long, numbers array<long>, after array<int>, closed array<long>"
    tried = saved(dealt.select("job_id", "block", "k", "file_id", "n", "n_chunks").mapInArrow(_batched(chunks, most_files, block), shape), "batches")

    def linked(ends: pd.DataFrame) -> pd.DataFrame:
        at, base, entries = 0, 0, []
        for b, after, closed in ends.sort_values("block")[["block", "after", "closed"]].itertuples(index=False):
            at, base = int(after[at]), base + int(closed[at])
            entries.append((ends["job_id"].iloc[0], b + 1, at, base))
        return pd.DataFrame(entries, columns=["_job", "_block", "_at", "_base"])

    ends = tried.where("after is not null").select("job_id", "block", "after", "closed")  # a row a block
    entered = ends.groupBy("job_id").applyInPandas(linked, "_job string, _block long, _at int, _base long")
    both = tried.join(entered, F.col("job_id").eqNullSafe(F.col("_job")) & (F.col("block") == F.col("_block")), "left")
    number = F.coalesce("_base", F.lit(0)) + F.get("numbers", F.coalesce("_at", F.lit(0)))
    return both.select("job_id", "file_id", "n_chunks", number.cast("long").alias("batch"))


def _batched(chunks: int, most_files: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks' files, in order and after the last ones of the block before, with their batch's number in the block for each
    number of files that the batch open at its start has; a full block's last file also with what is open after it, and the batches closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None
        #: number of files open at the block's start -> [chunks, files] of the batch now open, and its number
        ways: dict[int, list[int]] = {}
        for rows in batches:
            out: list[tuple] = []
            for job, b, k, file, n, kept in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if (job, b) != here:
                    here, ways = (job, b), {0: [0, 0, 0]}
                before = b * block - k
                if before > 0:  # a batch may begin here; those that close before the block aren't open at its start
                    ways[before] = [0, 0, 0]
                for c in [c for c in ways if c or before <= 0]:
                    way = ways[c]
                    way[0], way[1] = way[0] + n, way[1] + 1
                    if before > 0 and (way[0] >= chunks or way[1] >= most_files):
                        del ways[c]
                if before > 0:
                    continue
                numbers = [ways[c][2] if c in ways else None for c in range(most_files)]
                for way in ways.values():
                    if way[0] >= chunks or way[1] >= most_files:
                        way[:] = [0, 0, way[2] + 1]
                last = k % block == block - 1
                part = lambda i: [ways[c][i] if c in ways else None for c in range(most_files)] if last else None  # noqa: B023, E731
                out.append((job, b, file, kept, numbers, part(1), part(2)))
            if out:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["job_id", "block", "file_id", "n_chunks", "numbers", "after", "closed"])

    return run


def outcome(embedded: Column, linked: Column) -> Column:
    """A file's stage after its batch: by success of embedding and of graph building."""
    return F.when(~embedded, "embed_failed").when(~linked, "kg_failed").otherwise("kg_done")


def retry_plan(files: DataFrame, most: int = 2) -> DataFrame:
    """Failed files that may be tried again: how, the attempt's number, and the wait before it."""
    bad = files.where(F.col("stage").isin("failed", "embed_failed", "kg_failed") & (F.col("retry_count") < most))
    how = F.when(F.col("stage") == "failed", "download").otherwise("embed")
    return bad.select("id", how.alias("step"), (F.col("retry_count") + 1).alias("attempt"), F.least(F.pow(F.lit(2), F.col("retry_count")), F.lit(30)).cast("long").alias("wait_seconds"))


def file_states(events: DataFrame) -> DataFrame:
    """(file_id, stage, ts, ended) after the newest event of each file; at one time the larger stage name."""
    last = events.groupBy("file_id").agg(F.max(F.struct("ts", "stage")).alias("x"))
    return last.select("file_id", F.col("x.stage").alias("stage"), F.col("x.ts").alias("ts"), F.col("x.stage").isin(ENDED).alias("ended"))


def rate_limited(requests: DataFrame, seconds: int = 60, most: int = 10) -> DataFrame:
    """requests (event_id, user_id, ts) with ``recent`` (those of the user in the window before) and ``allowed``.

    Denied ones count too, so a frame by time says it all. Requests of one
    instant are told apart by event_id. Time is cut into spans of the window's
    length; a request stands in its own span and, to be counted, in the next. So
    a user's requests, however many, are as many groups as spans.
    """
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    own = F.floor(t / (seconds * 1_000_000))
    both = requests.select("event_id", "user_id", "ts", own.alias("_own"), F.explode(F.array(own, own + 1)).alias("_span"))
    span = Window.partitionBy("user_id", "_span").orderBy(t).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    same = Window.partitionBy("user_id", "_span", "ts")
    here = both.withColumn("n", F.count(F.lit(1)).over(span) - F.count(F.lit(1)).over(same) + F.row_number().over(same.orderBy("event_id")) - 1)
    return here.where("_span = _own").select("event_id", "user_id", "ts", F.col("n").alias("recent"), (F.col("n") < most).alias("allowed"))


def retried(files: DataFrame, outcome: Callable[[Column, Column, Column], Column], most_download: int = 2, most_embed: int = 2) -> DataFrame:
    """Every attempt of failed files (id, stage, retry_count) until each succeeds or reaches its class's cap.

    id, attempt (the file's count after it), step (download or embed), wait_seconds
    before it, stage after it, given_up (no attempt is left). outcome(id, attempt,
    step) is the stage that an attempt ends with. What fails anew re-enters, in
    the class of the stage it failed at, so a download that is mended can still
    fail to embed. A round is one pass over the files still failed; rounds end
    with them, at the larger cap at most. Files whose cap is reached already, and
    those that didn't fail, have no rows.
    """
    kinds = {"download": (["failed", "downloading"], most_download), "embed": (["embed_failed", "kg_failed"], most_embed)}
    step = F.when(F.col("stage").isin(kinds["embed"][0]), "embed").otherwise("download")
    cap = lambda s: F.when(s == "embed", most_embed).otherwise(most_download)
    bad = [x for stages, _ in kinds.values() for x in stages]
    here = files.where(F.col("stage").isin(bad)).select("id", "stage", F.col("retry_count").cast("int").alias("count"))
    done = None
    while True:
        tried = here.withColumn("step", step).where(F.col("count") < cap(F.col("step")))
        wait = F.least(F.pow(F.lit(2), F.col("count")), F.lit(30)).cast("long")
        tried = tried.select("id", (F.col("count") + 1).alias("attempt"), "step", wait.alias("wait_seconds"))
        ended = tried.withColumn("stage", outcome(F.col("id"), F.col("attempt"), F.col("step")))
        again = F.when(F.col("stage").isin(kinds["embed"][0]), F.lit(most_embed)).when(F.col("stage").isin(kinds["download"][0]), F.lit(most_download))
        ended = saved(ended.withColumn("given_up", F.coalesce(F.col("attempt") >= again, F.lit(False))), "attempts")
        done = ended if done is None else done.union(ended)
        here = ended.where(F.col("stage").isin(bad) & ~F.col("given_up")).select("id", "stage", F.col("attempt").alias("count"))
        if here.isEmpty():
            return done


def discovered(entries: DataFrame, root: str, scanners: int = 2) -> DataFrame:
    """(scanner, place, id, path, name) of the readable files under a root folder, in the order in which scanners find them.

    entries: id, parent_id, name, mime, as listed. The root's own files come
    first (scanner null). Its folders are dealt to the scanners in turn, in
    listing order (by name, then id), and each scanner goes breadth first: a
    folder's files before its folders' files, folders in the order in which they
    were queued. A folder that is queued again isn't scanned again; places count
    from 0 for each scanner. Numbers of folders and files are given by ranges of
    their order, not in one task.
    """
    listing = entries.select("parent_id", "id", "name", entry_action(F.col("mime")).alias("action"))
    top = saved(listing.where(F.col("parent_id") == root), "top")
    front = numbered(top.where("action = 'recurse'").groupBy("id").agg(F.min("name").alias("path")), ["path", "id"], "n")
    front = saved(front.select((F.col("n") % scanners).cast("int").alias("scanner"), "id", "path", "n"), "queue")
    seen, files = front.select("scanner", "id"), None
    level = 0
    while not front.isEmpty():
        q = front.select("scanner", F.col("id").alias("parent_id"), F.col("path").alias("folder"), "n")
        below = saved(listing.join(q, "parent_id").where("action <> 'drop'"), "below")
        kept = below.where("action = 'keep'").select("scanner", F.lit(level).alias("level"), "n", "id", "folder", "name")
        files = kept if files is None else files.union(kept)
        # of several ways to a folder on one level the first in the queue counts
        found = below.where("action = 'recurse'").groupBy("scanner", "id").agg(F.min(F.struct("n", "name", "folder")).alias("x"))
        found = found.join(seen, ["scanner", "id"], "left_anti").select("scanner", "id", "x.n", "x.name", F.concat("x.folder", F.lit("/"), "x.name").alias("path"))
        front = saved(numbered(found.withColumnRenamed("n", "above"), ["scanner", "above", "name", "id"], "n").select("scanner", "id", "path", "n"), "queue")
        seen = seen.union(front.select("scanner", "id"))
        level += 1
    own = top.where("action = 'keep'").select(F.lit(None).cast("int").alias("scanner"), F.lit(-1).alias("level"), F.lit(0).cast("long").alias("n"), "id", F.lit("").alias("folder"), "name")
    files = numbered(own if files is None else own.union(files), ["scanner", "level", "n", "name", "id"], "at")
    files = saved(files, "discovered")
    first = files.groupBy(F.col("scanner").alias("_s")).agg(F.min("at").alias("_first"))  # a row a scanner
    placed = files.join(F.broadcast(first), F.col("scanner").eqNullSafe(F.col("_s")))
    return placed.select("scanner", (F.col("at") - F.col("_first")).alias("place"), "id", F.col("folder").alias("path"), "name")
