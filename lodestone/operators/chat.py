"""Conversations, usage and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import attached, drive_url, snippet

#: So many missing ids an error names: more than any request asks for.
MISSING = 1000
IMAGES = ["image/png", "image/jpeg", "image/gif", "image/webp"]

#: Fields of a tool's result that a citation is made of (fixed names).
TEXTS = ["document_id", "document_name", "entity_id", "entity_name", "entity_type", "entity_description", "content"]
SCORES = ["similarity", "score", "relevance_score"]

#: JSON as strict as parse_json's, but with texts of any length; parse_json takes one of over 20,000,000 characters for broken.
JSON = {"maxStringLen": str(2**31 - 1), "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def conversation_list(conversations: DataFrame, messages: DataFrame, user_id: int | None = None, limit: int = 50) -> DataFrame:
    """Newest conversations with their number of messages, 0 for those without any."""
    rows = conversations if user_id is None else conversations.where(F.col("user_id") == user_id)
    newest = rows.orderBy(F.desc("created_at"), "conversation_id").limit(limit)
    shown = F.broadcast(newest.select("conversation_id"))  # limit rows
    each = messages.join(shown, "conversation_id", "left_semi").groupBy("conversation_id").agg(F.count(F.lit(1)).alias("messages"))
    return newest.join(each, "conversation_id", "left").select("conversation_id", "created_at", F.coalesce("messages", F.lit(0)).alias("messages"))


def first_messages(messages: DataFrame, conversation_id: int, n: int = 100) -> DataFrame:
    """A conversation's oldest n messages."""
    return messages.where(F.col("conversation_id") == conversation_id).orderBy("created_at", "turn").limit(n)


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """The ``number``-th page (from 1), each row with the number of all rows."""
    if number < 1 or size < 1:
        raise ValueError("page and size start at 1")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row


def usage_by_model(calls: DataFrame) -> DataFrame:
    """Calls, tokens and cost by model, and over all (model null)."""
    sums = calls.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost")
    )
    every = sums.agg(F.lit(None).cast("string").alias("model"), *(F.sum(c).alias(c) for c in ("calls", "input_tokens", "output_tokens", "cost")))
    both = sums.union(every)
    return both.select("model", "calls", "input_tokens", "output_tokens", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), F.round("cost", 6).alias("cost"))


def _items(text: Column) -> Column:
    """Items of a JSON list as variants; null if it is broken.

    A variant holds 128 MiB. A list with a larger item is read as texts, and the
    fields of its items that make a citation are what goes into variants, those
    that end in a snippet as far as it goes. There, a text that reads as an object counts as one.
    """
    long = ["entity_description", "content"]
    kept = lambda x: F.map_filter(F.from_json(x, "map<string,string>", JSON), lambda k, _: k.isin(TEXTS + SCORES))
    lean = F.transform(F.from_json(text, "array<string>", JSON), lambda x: F.transform_values(kept(x), lambda k, v: F.when(k.isin(long), snippet(v)).otherwise(v)))
    return F.coalesce(F.from_json(text, "array<variant>", JSON), F.from_json(F.to_json(lean, {"ignoreNullFields": "false"}), "array<variant>", JSON))


def citations(results: DataFrame, bare: bool = False) -> DataFrame:
    """Citations in tool results (call_id, result: JSON of one or a list): those with content, scored by the first measure that is there, null or not.
    What isn't an object is skipped.

    An entity without content cites its name, type and description. bare: a document is cited without content, too,
    with a snippet that is empty or null as its content is.
    """
    text = F.when(F.ltrim("result").startswith("["), F.col("result")).otherwise(F.concat(F.lit("["), "result", F.lit("]")))
    raw = results.select("call_id", F.posexplode(_items(text)).alias("ordinal", "v"))
    fields = raw.select("call_id", "ordinal", "v", F.try_variant_get("v", "$", "map<string,variant>").alias("f")).where("f is not null")
    kept = [F.try_variant_get("v", f"$.{name}", kind).alias(name) for names, kind in ((TEXTS, "string"), (SCORES, "double")) for name in names]
    items = fields.select("call_id", "ordinal", F.struct(*kept).alias("c"), F.map_keys("f").alias("keys"))
    entity = F.concat("c.entity_name", F.lit(" ("), F.coalesce("c.entity_type", F.lit("")), F.lit("): "), F.coalesce("c.entity_description", F.lit("")))
    content = F.when(F.coalesce("c.content", F.lit("")) != "", F.col("c.content")).otherwise(F.coalesce(entity, "c.content"))
    score = F.lit(0.0)
    for name in reversed(SCORES):
        score = F.when(F.array_contains("keys", name), F.col(f"c.{name}")).otherwise(score)
    rows = items.select(
        "call_id", "ordinal", "c.document_id", "c.document_name", "c.entity_id", "c.entity_name",
        snippet(content).alias("snippet"), score.alias("score"),
    )
    return rows.where("snippet <> '' or document_id <> ''" if bare else "snippet <> ''")


def first_citations(cited: DataFrame) -> DataFrame:
    """One citation for each document, or entity, or document name: the first by (call_id, ordinal)."""
    key = F.coalesce("document_id", "entity_id", "document_name")
    rest = [c for c in cited.columns if c not in ("call_id", "ordinal")]
    return cited.groupBy(key.alias("source_key")).agg(F.min_by(F.struct("call_id", "ordinal", *rest), F.struct("call_id", "ordinal")).alias("x")).select("source_key", "x.*")


def enriched(cited: DataFrame, documents: DataFrame) -> DataFrame:
    """Citations with ``title``, their document's file name or an entity's name where there is no document, and ``url``."""
    names = documents.select(F.col("id").alias("document_id"), "filename", drive_url(F.col("source"), F.col("metadata")).alias("url"))
    return cited.join(names, "document_id", "left").withColumn("title", F.coalesce("filename", "document_name", "entity_name")).drop("filename")


def transcript(messages: DataFrame) -> DataFrame:
    """(conversation_id, prompt): turns in order, the user's as such and all others as the assistant's."""
    who = F.when(F.col("role") == "user", "User: ").otherwise("Assistant: ")
    each = messages.groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat(who, "content").alias("line")))).alias("x"))
    return each.select("conversation_id", F.array_join("x.line", "\n\n").alias("prompt"))


def artifacts_of(artifacts: DataFrame, conversations: DataFrame, conversation_id: int, user_id: int) -> DataFrame:
    """A conversation's artifacts, oldest first, if it is the user's."""
    own = conversations.where((F.col("conversation_id") == conversation_id) & (F.col("user_id") == user_id)).select("conversation_id")
    return artifacts.join(F.broadcast(own.limit(1)), "conversation_id", "left_semi").orderBy("created_at", "artifact_id")


def linked_users(users: DataFrame, accounts: DataFrame, provider: str) -> DataFrame:
    """Users with their account at a provider: user_id, email, provider_user_id."""
    own = accounts.where(F.col("provider") == provider).select("user_id", "provider_user_id")
    return users.join(own, "user_id").select("user_id", "email", "provider_user_id")


def missing(wanted: DataFrame, owned: DataFrame) -> DataFrame:
    """wanted (id) that aren't among owned (id)."""
    return wanted.select("id").distinct().join(owned.select("id"), "id", "left_anti")


def required(wanted: DataFrame, owned: DataFrame) -> DataFrame:
    """The owned rows that are wanted; LookupError that lists the missing ids, if there are any (the first MISSING of them)."""
    lost = [str(r["id"]) for r in missing(wanted, owned).orderBy("id").limit(MISSING).collect()]
    if lost:
        raise LookupError(", ".join(lost))
    return owned.join(wanted.select("id").distinct(), "id", "left_semi")


def attachment_context(files: DataFrame) -> DataFrame:
    """(message_id, context, images) of files (message_id, seq, file_name, mime, content: bytes): texts as they stand in a prompt,
    joined by blank lines, and images as data URLs; other types are left out. Bytes of texts that aren't UTF-8 become U+FFFD."""
    image = F.col("mime").isin(IMAGES)
    text = F.when(F.col("mime") == "text/plain", attached(F.col("file_name"), F.make_valid_utf8(F.col("content").cast("string"))))
    url = F.when(image, F.concat(F.lit("data:"), "mime", F.lit(";base64,"), F.regexp_replace(F.base64("content"), r"\s", "")))
    each = files.groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("seq", text.alias("t"), url.alias("u")))).alias("x"))
    there = lambda name: F.filter(F.col(f"x.{name}"), lambda v: v.isNotNull())
    return each.select("message_id", F.array_join(there("t"), "\n\n").alias("context"), there("u").alias("images"))


def interleaved(thoughts: DataFrame, tools: DataFrame) -> DataFrame:
    """(message_id, place, kind, content) from both (message_id, i, content): the i-th thought before the i-th tool call, what is left over at the end."""
    of = lambda df, kind, o: df.select("message_id", "i", F.lit(o).alias("o"), F.lit(kind).alias("kind"), "content")
    both = of(thoughts, "thinking", 0).union(of(tools, "tool_call", 1))
    order = Window.partitionBy("message_id").orderBy("i", "o")
    return both.withColumn("place", F.row_number().over(order) - 1).select("message_id", "place", "kind", "content")


def assembled_steps(events: DataFrame) -> DataFrame:
    """(run_id, seq, kind, name, content, status, summary): the steps that a run's events (run_id, seq, event, name, content, failed) make.

    A tool's result ends the latest call of its name that still runs, and one
    that none waits for is ignored: calls and results nest like brackets, so
    a call's result is the next event on its level. The level is the number of
    open calls, a running sum that no result takes below 0.
    """
    named = Window.partitionBy("run_id", "name").orderBy("seq")
    tools = events.where("event in ('tool_start', 'tool_result')").withColumn("d", F.when(F.col("event") == "tool_start", 1).otherwise(-1))
    summed = tools.withColumn("s", F.sum("d").over(named))
    level = F.col("s") - F.least(F.lit(0), F.min("s").over(named))  # after the event
    # a result without a call leaves the level at 0, as it was
    before = F.coalesce(F.lag("level").over(named), F.lit(0))
    leveled = summed.withColumn("level", level).withColumn("own", F.when(F.col("d") == 1, F.col("level")).otherwise(before))
    on = Window.partitionBy("run_id", "name", "own").orderBy("seq")
    after = lambda c: F.lead(c).over(on)
    done = leveled.where("own > 0").select(
        "run_id", "seq", F.lit("tool_call").alias("kind"), "name", F.lit(None).cast("string").alias("content"),
        F.when(after("event").isNull(), "running").when(after("failed"), "error").otherwise("done").alias("status"), after("content").alias("summary"), "event",
    )
    spoken = events.where("event in ('thinking', 'narration_end')").select(
        "run_id", "seq", F.when(F.col("event") == "thinking", "thinking").otherwise("narration").alias("kind"), F.lit(None).cast("string"), "content",
        F.lit(None).cast("string"), F.lit(None).cast("string"),
    )
    return done.where("event = 'tool_start'").drop("event").union(spoken)


def answers(events: DataFrame) -> DataFrame:
    """(run_id, answer): the tokens after a run's last narration."""
    cut = F.max(F.when(F.col("event") == "narration_end", F.col("seq")))
    token = F.when(F.col("event") == "token", F.struct("seq", "content"))
    each = events.groupBy("run_id").agg(F.coalesce(cut, F.lit(-1)).alias("cut"), F.sort_array(F.collect_list(token)).alias("x"))
    return each.select("run_id", F.array_join(F.transform(F.filter("x", lambda t: t.seq > F.col("cut")), lambda t: t.content), "").alias("answer"))
