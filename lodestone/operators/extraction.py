"""What texts and answers say, as rows: entities and relations recognised in texts, and classifications from models' answers.

All of it is column expressions: a text's mentions are an array that is made in
place, so nothing is shuffled before the mentions of unlike texts are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import salvaged_json

#: Mentions that carry their type in their form, looked for in this order.
FORMS = {
    "Email": r"[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "Address": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "Phone": r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
}
#: A name: capitalised words in a row behind what doesn't end a sentence; first what stands before it, then the name.
NAME = r"([^.!?\s]+)[ \t]+(\p{Lu}[\p{L}\p{N}]+(?: \p{Lu}[\p{L}\p{N}]+)*)"
#: NAME as it is run: tried only where a run of such characters begins (or the last match ended), and runs are never shortened; neither loses or changes a match.
_NAMES = r"(?:\G|(?<![^.!?\s]))[^.!?\s]++[ \t]++\p{Lu}[\p{L}\p{N}]++(?: \p{Lu}[\p{L}\p{N}]++)*+"
#: A sign without which a text has no mention of the form.
_SIGNS = {"Email": "@", "Address": ".", "Phone": "+"}
#: Types of names by the word before them, lower-cased; other names are a Name.
CONTEXTS = {
    "Place": ["in", "at", "from", "near", "aus", "nach", "von", "en", "à", "desde"],
    "Person": ["by", "with", "mr", "ms", "dr", "herr", "frau", "par", "por", "avec", "con"],
    "Work": ["the", "a", "of", "der", "die", "das", "le", "la", "les", "el", "los", "und", "and"],
}


def mentions(text: Column) -> Column:
    """Array of (name, entity_type) in ``text``: those with a form of their own, then names in order of their places."""
    kind = lambda b: F.coalesce(*(F.when(F.lower(b).isin(words), t) for t, words in CONTEXTS.items()), F.lit("Name"))
    ends = F.transform(F.regexp_extract_all(text, F.lit(_NAMES), F.lit(0)), lambda x: F.split(x, "[ \t]+", 2))  # what stands before a name has no blank
    names = F.transform(ends, lambda x: F.struct(x[1].alias("name"), kind(x[0]).alias("entity_type")))

    def of_form(kind: str, pattern: str) -> Column:
        found = F.when(F.contains(text, F.lit(_SIGNS[kind])), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).when(text.isNotNull(), F.array().cast("array<string>"))
        return F.transform(found, lambda x: F.struct(x.alias("name"), F.lit(kind).alias("entity_type")))

    return F.concat(*(of_form(*form) for form in FORMS.items()), names)


def extracted(chunks: DataFrame) -> DataFrame:
    """(document_id, chunk, mentions) of chunks (document_id, chunk_index, content) that mention anything; texts are read once.

    Mentions come as a generated column, so that conditions on them don't look for them again.
    """
    found = chunks.select("document_id", F.col("chunk_index").alias("chunk"), F.explode(F.array(mentions(F.col("content")))).alias("mentions"))
    return found.where(F.size("mentions") > 0)


def candidates(found: DataFrame) -> DataFrame:
    """Entity candidates of ``extracted`` chunks, a row a mention: document_id, chunk, position, name, entity_type, description.

    They are what ``kg.first_entities`` merges, document by document or over all.
    """
    rows = found.select("document_id", "chunk", F.posexplode("mentions").alias("position", "m"))
    note = F.concat(F.lit("mentioned as "), F.col("m.entity_type"))
    return rows.select("document_id", "chunk", "position", F.col("m.name").alias("name"), F.col("m.entity_type").alias("entity_type"), note.alias("description"))


def co_mentions(found: DataFrame, window: int = 3, kind: str = "MENTIONED_WITH") -> DataFrame:
    """Relations of ``extracted`` chunks: document_id, chunk, source, target, type.

    A mention is related to the ``window`` that follow it in its chunk, of other
    names. So a chunk of n mentions has window * n relations at most, not n * n.
    """
    if window < 1:
        raise ValueError("window must be 1 or more")
    n = F.size("mentions")
    at = lambda i: F.get("mentions", i)["name"]
    ahead = lambda i: F.transform(F.sequence(i + 1, F.least(i + window, n - 1)), lambda j: F.struct(at(i).alias("source"), at(j).alias("target")))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), ahead))
    rows = found.where(n > 1).select("document_id", "chunk", F.explode(pairs).alias("p"))
    return rows.where(F.lower("p.source") != F.lower("p.target")).select("document_id", "chunk", "p.source", "p.target", F.lit(kind).alias("type"))


def classifications(files: DataFrame, answers: DataFrame) -> DataFrame:
    """files (folder, file_id, ...) with their classification (a JSON object) from a model's answer for their folder.

    An answer (folder, answer) may be an array of objects, each for the file that
    its file_id names; one object with a file_id, for that file; one without,
    for every file of the folder; or broken, missing or anything else: then, and
    for files that aren't named, it is {}. Of several objects for one file the
    last counts. An answer is parsed once, as VARIANT, and becomes a row a named
    file, so that files are joined with their own entry, not with the answer.
    """
    parsed = F.try_parse_json(salvaged_answer(F.col("answer")))
    whole = F.try_variant_get(parsed, "$", "array<variant>")
    one = F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)
    listed = F.coalesce(whole, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<variant>"))
    fields = F.filter(F.transform(listed, lambda v: F.try_variant_get(v, "$", "map<string,variant>")), lambda f: f.isNotNull())
    bare = lambda f: F.to_json(F.map_filter(f, lambda k, _: k != "file_id"))
    key = lambda f: F.coalesce(F.try_variant_get(F.element_at(f, "file_id"), "$", "string"), F.lit(""))
    named = F.filter(F.transform(fields, lambda f: F.struct(key(f).alias("file_id"), bare(f).alias("value"))), lambda x: x.file_id != "")
    common = F.when(one.isNotNull() & (F.size(named) == 0) & ~F.map_contains_key(fields[0], "file_id"), bare(fields[0]))
    by_folder = answers.groupBy("folder").agg(F.max("answer").alias("answer")).select("folder", named.alias("_named"), common.alias("_common"))
    entries = by_folder.select("folder", F.posexplode("_named").alias("_at", "_e")).select("folder", F.col("_e.file_id").alias("file_id"), "_at", "_e.value")
    entries = entries.groupBy("folder", "file_id").agg(F.max_by("value", "_at").alias("_own"))
    rows = files.join(entries, ["folder", "file_id"], "left").join(by_folder.where("_common is not null").select("folder", "_common"), "folder", "left")
    return rows.select(*files.columns, F.coalesce("_own", "_common", F.lit("{}")).alias("classification"))


def salvaged_answer(c: Column) -> Column:
    """A JSON text from a model's answer, arrays included: the whole, a fenced block, or from the first brace to the last; else null."""
    fence = F.trim(F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1))
    whole = F.trim(c)
    return F.coalesce(*(F.when((t != "") & F.try_parse_json(t).isNotNull(), t) for t in (whole, fence)), salvaged_json(c))
