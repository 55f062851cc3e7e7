"""Deterministic shards of documents: text windows, row ranges, chapters, sections, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, all_blanks, collapse, language_tag, trim
from .ordered import rolling_digest
from .prefix import running_totals

MAX_SHARDS, MAX_CHARS, MAX_SOURCE_BYTES = 10_000, 128 << 20, 64 << 20


def source_id(path: Column, digest: Column) -> Column:
    return F.concat(F.lit("source:"), F.substring(F.sha2(F.concat(path, F.lit("\x00"), digest), 256), 1, 16))


def language_source_id(digest: Column, source: Column, target: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x00", digest, source, target), 256), 1, 16)


def starts(n: Column, chunk: int, overlap: int) -> Column:
    """Starts of the windows over ``n`` characters, up to the first that reaches the end."""
    step = chunk - overlap
    if chunk <= 0 or not 0 <= overlap < chunk:
        raise ValueError("invalid_chunk_options")
    last = F.greatest(F.lit(0), F.ceil((n - chunk) / F.lit(step))).cast("int") * step
    return F.sequence(F.lit(0), last, F.lit(step))


def plan_bounds(docs: DataFrame, text: str = "text", chunk: int = 1000, overlap: int = 100) -> DataFrame:
    """``n_shards, n_chars`` that sharding would make, and whether the caps allow it; nothing is made."""
    n, step = F.length(text).cast("long"), chunk - overlap
    shards = F.when(n == 0, 0).otherwise(F.greatest(F.lit(0), F.ceil((n - chunk) / F.lit(step))) + 1).cast("long")
    chars = n + F.greatest(F.lit(0), shards - 1) * overlap
    return docs.withColumn("n_shards", shards).withColumn("shard_chars", chars).withColumn("allowed", (shards > 0) & (shards <= MAX_SHARDS) & (chars <= MAX_CHARS) & (F.octet_length(text) <= MAX_SOURCE_BYTES))


def text_shards(docs: DataFrame, path: Column, text: str = "text", chunk: int = 1000, overlap: int = 100) -> DataFrame:
    """``docs`` and one row for each window: index, bounds, text, digest and shard id. Empty texts give none."""
    df = docs.where(F.length(text) > 0).withColumn("source_sha256", F.sha2(text, 256)).withColumn("source_id", source_id(path, F.col("source_sha256")))
    df = df.select("*", F.posexplode(starts(F.length(text), chunk, overlap)).alias("chunk_index", "start_char"))
    df = df.withColumn("shard_text", F.substr(text, F.col("start_char") + 1, F.lit(chunk)))
    df = df.withColumn("end_char", F.col("start_char") + F.length("shard_text")).withColumn("shard_sha256", F.sha2("shard_text", 256))
    return df.withColumn("shard_id", F.format_string("%s:chunk:%06d", "source_id", F.col("chunk_index") + 1))


def row_shards(rows: DataFrame, source: str, order: list[str], record: Column, size: int) -> DataFrame:
    """Ranges of ``size`` records of each source with row and byte bounds; a record ends in a line feed."""
    sized = rows.withColumn("bytes", (F.octet_length(record) + 1).cast("long"))
    df = running_totals(sized.select(source, *order, "bytes"), [F.col(c) for c in order], {"row": F.lit(1), "byte_end": F.col("bytes")}, [F.col(source)])
    df = df.withColumn("chunk_index", F.floor((F.col("row") - 1) / size).cast("long"))
    out = df.groupBy(source, "chunk_index").agg(F.min("row").cast("long").alias("row_start"), F.max("row").cast("long").alias("row_end"), F.count(F.lit(1)).alias("row_count"), F.min(F.col("byte_end") - F.col("bytes")).alias("byte_start"), F.max("byte_end").alias("byte_end"))
    return out.withColumn("shard_id", F.format_string("%s:rows:%08d-%08d", F.col(source).cast("string"), "row_start", "row_end"))


# Patterns of headings; a label is what follows the marks of a marked line, or the line itself.
MARKED = r"\A#{1,6}\s+(.+)\z"
NAMED = (r"(?i)\A(?:chapter|ch\.?)(?:\s|\z)", r"(?i)\Apart\s+(?:[0-9]+|[ivxlcdm]+|[a-z]+)")
NUMBERED = r"(?i)\A(?:[0-9]{1,4}|[ivxlcdm]{1,12})[.)\-:–—]\s+\S+"
MAX_HEADING = 2000
#: A line that may be a heading, anywhere in a text: each line that has a label begins so once it is trimmed.
_MAY_HEAD = rf"(?i)(?:\A|\n){SPACE}*(?:#|chapter|ch\.|ch{SPACE}|ch\z|part{SPACE})"


def heading_label(line: Column) -> Column:
    """The chapter label that a line states, else null."""
    line = trim(line)
    mark, chapter, part, numbered = map(all_blanks, (MARKED, *NAMED, NUMBERED))
    marked = line.rlike(mark)
    label = collapse(F.when(marked, F.regexp_extract(line, mark, 1)).otherwise(line))
    named = label.rlike(chapter) | label.rlike(part)
    return F.when((F.length(line) <= MAX_HEADING) & (named | marked & label.rlike(numbered)), label)


def chapter_segments(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, chapter, chapter_index, chapter_start, chapter_end``.

    From heading to heading; text before the first is front matter with index 0; blank
    segments are left out; a text without headings is one chapter. A line's place counts
    all characters before it, those of its line ends too. Lines become rows only for
    texts in which one pattern finds what may be a heading; ``key`` names a text.
    """
    df = docs.where(F.length(text) > 0).select(F.col(key).alias("key"), F.col(text).alias("text"))
    may = F.col("text").rlike(_MAY_HEAD)
    lines = df.where(may).select("key", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    before = F.sum(F.length("raw") + 1).over(Window.partitionBy("key").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.select("key", "line", (before - F.length("raw") - 1).alias("start"), (before - 1).alias("end"), heading_label(F.col("raw")).alias("label"), (trim(F.col("raw")) != "").alias("written"))
    found = lines.groupBy("key").agg(F.max("end").alias("n"), F.sort_array(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("start", "label")))).alias("heads"), F.min(F.when(F.col("written"), F.col("start"))).alias("first_written"))
    part = lambda label, index, start, end: F.struct(label.alias("chapter"), index.cast("long").alias("chapter_index"), start.cast("long").alias("chapter_start"), end.cast("long").alias("chapter_end"))
    n, top = F.col("n"), F.get("heads", F.lit(0))["start"]
    headed = F.transform("heads", lambda h, i: part(h["label"], i + 1, h["start"], F.coalesce(F.get("heads", i + 1)["start"], n)))
    front = F.when(F.col("first_written") < top, F.array(part(F.lit("Front matter"), F.lit(0), F.lit(0), top))).otherwise(F.slice(headed, 1, 0))
    whole = lambda end: part(F.lit("Whole book"), F.lit(1), F.lit(0), end)
    parts = F.when(F.size("heads") > 0, F.concat(front, headed)).when(F.col("first_written").isNotNull(), F.array(whole(n))).otherwise(F.slice(headed, 1, 0))
    plain = df.where(~may & (trim(F.col("text")) != "")).select("key", F.inline(F.array(whole(F.length("text")))))
    return found.select("key", F.inline(parts)).unionByName(plain).withColumnRenamed("key", key)


def book_plan(segments: DataFrame, key: str, chunk: int = 8000, overlap: int = 800) -> DataFrame:
    """``key, n_shards, shard_chars, allowed`` of the windows that chapters would give; nothing is made."""
    if chunk <= 0 or not 0 <= overlap < chunk:
        raise ValueError("invalid_chunk_options")
    n, step = F.col("chapter_end") - F.col("chapter_start"), chunk - overlap
    count = F.greatest(F.lit(0), F.ceil((n - chunk) / F.lit(step))) + 1
    sums = segments.groupBy(key).agg(F.sum(count).cast("long").alias("n_shards"), F.sum(n + (count - 1) * overlap).cast("long").alias("shard_chars"))
    return sums.withColumn("allowed", (F.col("n_shards") <= MAX_SHARDS) & (F.col("shard_chars") <= MAX_CHARS))


def book_shards(docs: DataFrame, key: str, text: str = "text", chunk: int = 8000, overlap: int = 800) -> DataFrame:
    """Windows inside each chapter; ``chunk_index`` runs through the whole book. Books that
    ``book_plan`` doesn't allow give none."""
    segments = chapter_segments(docs, key, text)
    allowed = book_plan(segments, key, chunk, overlap).where("allowed").select(key)
    df = segments.join(allowed, key, "left_semi").join(docs.select(key, text), key)
    df = df.select("*", F.explode(starts((F.col("chapter_end") - F.col("chapter_start")).cast("int"), chunk, overlap)).alias("local"))
    df = df.withColumn("start_char", F.col("chapter_start") + F.col("local")).withColumn("end_char", F.least(F.col("chapter_end"), F.col("start_char") + chunk))
    df = df.withColumn("chunk_index", (F.row_number().over(Window.partitionBy(key).orderBy("chapter_index", "local")) - 1).cast("long"))
    body = F.substr(text, (F.col("start_char") + 1).cast("int"), (F.col("end_char") - F.col("start_char")).cast("int"))
    return df.select(key, "chapter", "chapter_index", "chapter_start", "chapter_end", "chunk_index", "start_char", "end_char", body.alias("shard_text"), F.sha2(body, 256).alias("shard_sha256"))


def outline_plan(sections: DataFrame, key: str) -> DataFrame:
    """``key, shard_chars, allowed`` of ``outline_sections``: the texts of an outline are bounded together."""
    return sections.groupBy(key).agg(F.sum(F.length("shard_text")).cast("long").alias("shard_chars")).withColumn("allowed", F.col("shard_chars") <= MAX_CHARS)


def translation_shards(docs: DataFrame, source_lang: Column, target_lang: Column, text: str = "text", chunk: int = 4000, overlap: int = 0) -> DataFrame:
    """Windows with both languages in their bounds; the source id holds the digest and the languages. Rows with a bad language tag give none."""
    df = docs.withColumn("source_lang", language_tag(source_lang)).withColumn("target_lang", language_tag(target_lang)).where("source_lang is not null and target_lang is not null")
    df = df.where(F.length(text) > 0).withColumn("source_sha256", F.sha2(text, 256))
    df = df.withColumn("source_id", language_source_id(F.col("source_sha256"), F.col("source_lang"), F.col("target_lang")))
    df = df.select("*", F.posexplode(starts(F.length(text), chunk, overlap)).alias("chunk_index", "start_char"))
    df = df.withColumn("shard_text", F.substr(text, F.col("start_char") + 1, F.lit(chunk))).withColumn("shard_sha256", F.sha2("shard_text", 256))
    df = df.withColumn("end_char", F.col("start_char") + F.length("shard_text"))
    return df.withColumn("shard_id", F.format_string("%s:chunk:%06d", "source_id", F.col("chunk_index") + 1))


OUTLINE = "title STRING, audience STRING, voice STRING, sections ARRAY<STRUCT<title: STRING, brief: STRING>>"


def outline_sections(outlines: DataFrame, key: str, outline: str = "outline") -> DataFrame:
    """One row for each section of JSON outlines: index, count, text and blockers."""
    df = outlines.select(key, F.from_json(outline, OUTLINE).alias("o"))
    df = df.select(key, "o", F.size("o.sections").alias("section_count"), F.posexplode_outer("o.sections").alias("at", "s"))
    repeated = F.size(F.filter("o.sections", lambda x: F.lower(x["title"]) == F.lower(F.col("s.title")))) > 1
    blank = lambda c: F.coalesce(trim(c), F.lit("")) == ""
    blockers = F.array_compact(F.array(F.when(blank(F.col("o.title")), F.lit("outline_title_required")), F.when(F.col("section_count") < 1, F.lit("outline_sections_required")), F.when(F.col("section_count") > MAX_SHARDS, F.lit("outline_too_many_sections")), F.when((F.col("section_count") > 0) & (blank(F.col("s.title")) | blank(F.col("s.brief"))), F.lit("outline_section_fields_required")), F.when(repeated, F.lit("outline_duplicate_title")), F.when(F.greatest(F.length("s.title"), F.length("s.brief")) > 200_000, F.lit("outline_field_too_long"))))
    text = F.concat_ws("\n\n", F.concat(F.lit("Title: "), F.col("o.title")), F.concat(F.lit("Audience: "), F.col("o.audience")), F.concat(F.lit("Voice: "), F.col("o.voice")), F.format_string("Section %d of %d: %s", F.col("at") + 1, "section_count", "s.title"), F.concat(F.lit("Brief: "), F.col("s.brief")))
    return df.select(key, F.format_string("%s:section:%06d", F.col(key).cast("string"), F.col("at") + 1).alias("shard_id"), (F.col("at") + 1).cast("long").alias("section_index"), F.col("section_count").cast("long").alias("section_count"), text.alias("shard_text"), blockers.alias("blockers"))


def page_shards(sources: DataFrame, key: str, pages: str) -> DataFrame:
    """One row for each 1-based page."""
    return sources.where(F.col(pages) >= 1).select(key, F.col(pages).cast("long").alias("page_count"), F.explode(F.sequence(F.lit(1), F.col(pages).cast("int"))).alias("page_number")).withColumn("shard_id", F.format_string("%s:page:%06d", F.col(key).cast("string"), "page_number"))


def reconciled(shards: DataFrame, key: str, position: str, text: str, separator: str = "\n\n") -> DataFrame:
    """``key, n_shards, n_bytes, output_sha256`` of the texts of each job in order, joined. The joined text is
    never held: its parts stream through the digest. ``write_ordered`` writes it."""
    out = rolling_digest(shards, [key], [F.col(position), F.col(text)], F.col(text), separator)
    return out.select(key, F.col("n_rows").alias("n_shards"), "n_bytes", F.col("sha256").alias("output_sha256"))


def reconcile(shards: DataFrame, key: str, position: str, text: str, separator: str = "\n\n") -> DataFrame:
    """The texts of each job in order, joined, with digest, as one row: for outputs that fit in one. ``reconciled`` and
    ``write_ordered`` take any size."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(position, text))), lambda s: s[text])
    return shards.groupBy(key).agg(F.count(F.lit(1)).alias("n_shards"), F.array_join(parts, separator).alias("output")).withColumn("output_sha256", F.sha2("output", 256))

