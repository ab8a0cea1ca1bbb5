"""Column functions on names, paths, sizes and texts. None needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of files that have a text processor, by extension (fixed values).
PROCESSORS = {"pdf": "pdf", "docx": "docx", "doc": "docx", "txt": "text", "md": "text"}
MIME_PROCESSORS = {"application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/msword": "docx", "text/plain": "text"}


def safe_label(c: Column) -> Column:
    """Letters, digits (of any script) and underscores; all else goes."""
    return F.regexp_replace(c, r"(?U)[^\p{Alnum}_]", "")


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^\p{Alnum}]", "_")


def safe_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)[^\p{Alnum} _-]", ""))


def tokens_by_length(c: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.char_length(c) / 4)


def words(c: Column) -> Column:
    """Words by Unicode white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def shortened(c: Column, most: int = 200) -> Column:
    """The first ``most`` characters and three dots, if there are more."""
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def snippet(c: Column, most: int = 200) -> Column:
    return F.substring(c, 1, most)


def relevance(score: Column) -> Column:
    """Full-text scores on 0 to 1: a fifth, and 1 at most."""
    return F.least(score / 5, F.lit(1.0))


def joined_path(parent: Column, name: Column) -> Column:
    return F.when(parent.isNull() | (parent == ""), name).otherwise(F.concat(parent, F.lit("/"), name))


def path_parent(c: Column) -> Column:
    return F.when(F.instr(c, "/") > 0, F.regexp_extract(c, r"^(.*)/[^/]*$", 1)).otherwise("")


def path_leaf(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)$", 1)


def extension(c: Column) -> Column:
    """Lower case, without the dot; empty where there is none."""
    return F.lower(F.regexp_extract(c, r"\.([^./]+)$", 1))


def processor(c: Column, mime: Column | None = None) -> Column:
    """Name of the processor: that of the MIME type if it is known, else that of the file name's extension; or null."""
    of = lambda known, x: F.element_at(F.create_map(*[F.lit(y) for pair in known.items() for y in pair]), x)
    by_name = of(PROCESSORS, extension(c))
    return by_name if mime is None else F.coalesce(of(MIME_PROCESSORS, F.lower(mime)), by_name)


def human_size(c: Column) -> Column:
    """Bytes in the largest unit that leaves a number below 1024, with one decimal."""
    value, unit = c.cast("double"), F.lit("B")
    power = F.least(F.floor(F.log2(F.greatest(value, F.lit(1.0))) / 10), F.lit(4))
    unit = F.get(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), power.cast("int"))
    return F.concat(F.format_string("%.1f", F.bround(value / F.pow(F.lit(1024.0), power), 1)), F.lit(" "), unit)


def bumped_patch(version: Column) -> Column:
    """x.y.z with z one higher."""
    return F.concat(F.regexp_extract(version, r"^(\d+\.\d+\.)", 1), (F.regexp_extract(version, r"(\d+)$", 1).cast("int") + 1).cast("string"))


def backoff_seconds(retry: Column, most: int = 30) -> Column:
    return F.least(F.pow(F.lit(2), retry), F.lit(most)).cast("long")


def salvaged_json(c: Column) -> Column:
    """A JSON text from a model's answer: the whole, a fenced block, or from the first brace to the last; else null."""
    fence = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    tries = [F.trim(c), F.trim(fence), braces]
    return F.coalesce(*[F.when((t != "") & F.try_parse_json(t).isNotNull(), t) for t in tries])


def shortened_to(c: Column, most: int) -> Column:
    """The first ``most`` characters: of errors (500, 300, 200) and titles (80)."""
    return F.substring(c, 1, most)


def token_format(c: Column) -> Column:
    """1234 as 1.2K, 3400000 as 3.4M, less than 1000 as it is."""
    n = c.cast("double")
    return F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1_000_000), F.lit("M"))).when(n >= 1000, F.concat(F.format_string("%.1f", n / 1000), F.lit("K"))).otherwise(c.cast("string"))


def drive_url(source: Column, metadata: Column) -> Column:
    """Where a drive's file can be viewed, by the id in its document's metadata; null for other sources."""
    file_id = F.get_json_object(metadata, "$.drive_file_id")
    return F.when((source == "google_drive") & (file_id != ""), F.concat(F.lit("https://drive.google.com/file/d/"), file_id, F.lit("/view")))


def expiry(at: Column, days: int = 7) -> Column:
    return at.cast("timestamp") + F.make_dt_interval(days=F.lit(days))


def kept_key(new: Column, old: Column) -> Column:
    """A key's new value: null clears it, an empty text keeps the old one."""
    return F.when(new == "", old).otherwise(new)


def zoom_tier(zoom: Column) -> Column:
    """Tier of a cluster view at a zoom: 1 below 0.4, 2 below 1.2, else 3."""
    return F.when(zoom < 0.4, 1).when(zoom < 1.2, 2).otherwise(3)


def attached(name: Column, content: Column) -> Column:
    """A file's text as it stands in a prompt."""
    return F.concat(F.lit("[Attached: "), name, F.lit("]\n<file_content>\n"), content, F.lit("\n</file_content>"))
