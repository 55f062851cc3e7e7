"""Text functions as column expressions.

Patterns keep to ASCII word boundaries and ``\\z``, whatever the regex engine's flags.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: White space of the source format: Unicode spaces, line ends and the byte order mark.
SPACE = r"[\x09-\x0D\x20   -     　﻿]"
#: The same characters as a string.
SPACES = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: What stands between the brackets of ``SPACE``.
BLANKS = SPACE[1:-1]
WORD_START, WORD_END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
WORD = r"\p{L}[\p{L}\p{M}\p{N}'’_-]*"


def trim(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    return trim(F.regexp_replace(c, f"{SPACE}+", " "))


def comparable(c: Column) -> Column:
    return F.lower(collapse(c))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def code_points(c: Column) -> Column:
    return F.length(c).cast("long")


def word_count(c: Column) -> Column:
    """Words that begin with a letter."""
    return F.size(F.regexp_extract_all(c, F.lit(WORD), F.lit(0))).cast("long")


def space_word_count(c: Column) -> Column:
    """Runs between white space; none in an empty text."""
    return F.when(trim(c) == "", F.lit(0)).otherwise(F.size(F.split(trim(c), f"{SPACE}+"))).cast("long")


#: White space as ``\s`` in DuckDB's patterns, and the blanks that its ``trim`` takes off.
ASCII_SPACE = r"[\t\n\f\r ]"
TRIMMED = " \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def ascii_space_word_count(c: Column) -> Column:
    """Pieces between runs of ASCII white space, blanks of any kind at the ends left out; an empty text is one piece."""
    spaced = F.trim(F.regexp_replace(c, f"{ASCII_SPACE}+", " "), F.lit(TRIMMED))
    return F.array_size(F.split(spaced, " ")).cast("long")


def nontrivial(c: Column) -> Column:
    """Eight letters or two words; the eighth letter ends the search."""
    return c.rlike(r"\A(?:\P{L}*+\p{L}){8}") | (word_count(c) >= 2)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def primary_language(c: Column) -> Column:
    return F.split_part(F.replace(F.lower(trim(c)), F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1))


def languages_differ(a: Column, b: Column) -> Column:
    x, y = primary_language(F.coalesce(a, F.lit(""))), primary_language(F.coalesce(b, F.lit("")))
    return (x != "") & (y != "") & (x != y)


def language_tag(c: Column) -> Column:
    """A tag with hyphens, or null if it isn't one."""
    tag = F.replace(trim(c), F.lit("_"), F.lit("-"))
    return F.when(tag.rlike(r"\A[A-Za-z]{2,8}(?:-[A-Za-z0-9]{1,8})*\z"), tag)


def contains_term(text: Column, term: Column) -> Column:
    return F.contains(F.lower(text), F.lower(term))


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_.:-]", "_")


def render_template(template: str, values: dict[str, Column]) -> Column:
    """One pass: ``{{key}}`` becomes its value; unknown keys stay; values aren't expanded again."""
    import re

    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\{\{([A-Za-z0-9_]+)\}\}", template):
        if m[1] in values:
            parts += [F.lit(template[at : m.start()]), F.coalesce(values[m[1]].cast("string"), F.lit(""))]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


# Parts of messages and codes in the next two functions.
def error_class(message: Column) -> Column:
    return F.when(message.contains("ENOENT"), "missing_input").when(message.rlike("EACCES|EPERM"), "permission_denied").otherwise("processor_error")


def exit_code(code: Column) -> Column:
    """0 to 3 of an error code: 3 safety, 2 input, 1 else."""
    safety = code.rlike(r"blocked|authority|approval_receipt|budget_exhausted|\Aapi_key_not_present\z")
    wrong = code.rlike(r"\Ainvalid_|\Amissing_|_not_found\z|_required\z")
    return F.when(code.isNull(), 0).when(safety, 3).when(wrong, 2).otherwise(1)


# Command rules, first match wins.
COMMAND_RULES = (
    (r"\brm\s+.*?((/(?=\s|\z|;|&))|~(?=\s|\z|;|&)|(?<!\w)\*(?!\w)|\$HOME\b|/(etc|usr|var|boot|dev|sys|proc)\b)", "destructive rm"),
    (r"\bsudo\b", "sudo escalation"),
    (r"\bgit\s+push\s+(?:-[fF]|--force)\b.*\s+(?:origin|upstream)\s+(?:main|master)\b", "force push to main"),
    (r"\bgit\s+push\s+(?:origin|upstream)\s+(?:main|master)\s+(?:-[fF]|--force)\b", "force push to main"),
    (r"\bcurl\b.*\|.*\b(sh|bash|zsh|dash)\b", "curl-to-shell"),
    (r"\bwget\b.*\|.*\b(sh|bash|zsh|dash)\b", "wget-to-shell"),
    (r"\bchmod\s+(?:-[Rr]\s+|--recursive\s+)?0?777\b", "world-writable chmod"),
    (r"\bdd\s+if=", "raw disk write"),
    (r"\bmkfs\.", "filesystem format"),
    (r":\(\)\s*\{", "fork bomb"),
    (r"\beval(?:[\s'\"$`(]|\z)", "eval injection"),
    (r"\bnpm\s+(?:publish|unpublish)\b", "npm publish"),
    (r"\bdocker\s+exec\b", "docker exec"),
    (r"\bkill\s+(?:-9\b|-(?:SIG)?KILL\b|-s\s+(?:KILL|9)\b)", "SIGKILL"),
    (r"\b(?:shutdown|reboot|halt|poweroff)\b", "system power"),
)
_ASCII_BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def all_blanks(pattern: str) -> str:
    """``\\s`` of a pattern as the source format means it, inside brackets too: Unicode spaces among them."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        if pattern[at] == "\\":
            pair = pattern[at : at + 2]
            out.append(pair if pair != r"\s" else BLANKS if inside else SPACE)
            at += 2
            continue
        inside = pattern[at] == "[" or inside and pattern[at] != "]"
        out.append(pattern[at])
        at += 1
    return "".join(out)


def ascii_boundaries(pattern: str) -> str:
    """Boundaries between ASCII word characters and others; before or after a word one side is enough."""
    import re

    out = re.sub(r"\\b(?=[A-Za-z0-9]|\[A-Z0-9]|\[A-Z\]|\(\?:[a-z]|\([a-z])", lambda m: WORD_START, pattern)
    return out.replace(r"\b", _ASCII_BOUNDARY)


def command_label(command: Column) -> Column:
    """The label of the first rule that the command breaks, else null."""
    seen = collapse(F.split_part(command, F.lit("\x00"), F.lit(1)))
    first = F.lit(None).cast("string")
    for pattern, label in reversed(COMMAND_RULES):
        first = F.when(seen.rlike(ascii_boundaries(pattern)), label).otherwise(first)
    return first


def status_block(text: Column) -> Column:
    """``status, summary, concerns, context_needed, blocker`` of a fenced status block."""
    body = F.regexp_extract(text, r"(?s)```status\r?\n(.*?)\r?\n```", 1)
    there = text.rlike(r"(?s)```status\r?\n.*?\r?\n```")
    lines = F.transform(F.split(body, r"\r?\n"), trim)

    def field(name: str) -> Column:
        hit = F.get(F.filter(lines, lambda x: x.startswith(f"{name}:")), F.lit(0))
        return trim(F.substring(hit, len(name) + 2, 1 << 30))

    status = F.coalesce(field("status"), F.lit("DONE"))
    return F.struct(
        F.when(there & status.isin("DONE", "DONE_WITH_CONCERNS", "NEEDS_CONTEXT", "BLOCKED"), status).otherwise("DONE").alias("status"),
        F.when(there, F.coalesce(field("summary"), F.lit(""))).otherwise(F.substring(text, 1, 200)).alias("summary"),
        *(F.when(there, field(n)).alias(n) for n in ("concerns", "context_needed", "blocker")),
    )


@pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition, for which there is no built-in function."""
    return texts.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFC", x))


def memory_source(c: Column) -> Column:
    """Line ends as line feeds, then canonical composition."""
    return nfc(F.replace(c, F.lit("\r\n"), F.lit("\n")))


MAX_JSON_DEPTH = 200
_quoted = json.JSONEncoder(ensure_ascii=False).encode


def _number(x: float | int) -> str:
    """Shortest decimal form, with exponents only from 1e21 and below 1e-6."""
    if isinstance(x, int):
        x = float(x) if abs(x) > 2**53 else x
        if isinstance(x, int):
            return str(x)
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent
    if -6 < point <= 21:
        out = text.ljust(point, "0") if point >= len(text) else f"{text[:point]}.{text[point:]}" if point > 0 else f"0.{'0' * -point}{text}"
    else:
        out = f"{text[0]}{'.' + text[1:] if len(text) > 1 else ''}e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return "-" * sign + out


def canonical_json(value, depth: int = 0) -> str:
    """Keys in order of UTF-16 code units, no white space, numbers in shortest form."""
    if depth > MAX_JSON_DEPTH:
        raise ValueError("canonical_json_depth_exceeded")
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, int | float):
        return _number(value)
    if isinstance(value, str):
        return _quoted(value)
    if isinstance(value, list | tuple):
        return "[" + ",".join(canonical_json(x, depth + 1) for x in value) + "]"
    keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(f"{canonical_json(k)}:{canonical_json(value[k], depth + 1)}" for k in keys) + "}"


@pandas_udf(StringType())
def canonical(texts: pd.Series) -> pd.Series:
    """Canonical form of JSON texts; null for what isn't JSON."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else canonical_json(json.loads(x))
        except ValueError:
            return None

    return texts.map(one)


def namespace(c: Column) -> Column:
    """Trimmed, of 1 to 128 code points; else null."""
    name = trim(c)
    return F.when(F.length(name).between(1, 128), name)


def relative_path(path: Column, root: Column) -> Column:
    """What follows ``root`` in ``path``, with slashes; null outside it."""
    slashes = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    inside = F.concat(F.rtrim(slashes(root), F.lit("/")), F.lit("/"))
    return F.when(F.startswith(slashes(path), inside), F.substr(slashes(path), F.length(inside) + 1))


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def result_content(result_json: Column) -> Column:
    """The text ``content`` of a JSON object, else the JSON as it is."""
    v = F.try_parse_json(result_json)
    content = F.try_variant_get(v, "$.content", "variant")
    return F.when(_kind(content) == "STRING", F.try_variant_get(v, "$.content", "string")).otherwise(result_json)


# Keys that are kept of an engine's JSON.
OCR_KEYS = ("page", "page_number", "page_count", "width", "height", "confidence", "schema_version")


def ocr_metadata(engine_json: Column) -> Column:
    """A map of ``OCR_KEYS`` with scalar values as texts: those of the object itself, or of its ``metadata`` where it has none."""
    v = F.try_parse_json(engine_json)
    entries = []
    for key in OCR_KEYS:
        top, nested = F.try_variant_get(v, f"$.{key}", "variant"), F.try_variant_get(v, f"$.metadata.{key}", "variant")
        chosen = F.when(_kind(top) != "VOID", top).otherwise(nested)
        scalar = (_kind(chosen) != "VOID") & ~_kind(chosen).rlike("^(?:ARRAY|OBJECT)")
        entries.append(F.when(scalar, F.struct(F.lit(key).alias("key"), F.try_variant_get(chosen, "$", "string").alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*entries)))
