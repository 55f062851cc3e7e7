"""Scans: whole texts, JSON lines with byte bounds, media with probes, pages by OCR engines, manifests, ledgers, SQLite."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType

from ..functions.text import trim
from ..operators.ordered import rolling_digest
from ..operators.prefix import running_totals
from ..plans.staging import staged

MAX_SOURCE_BYTES, MAX_RECORD_BYTES, MAX_SHARDS = 64 << 20, 16 << 20, 10_000


def binary_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """``path, length, modificationTime, content`` of regular files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def text_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, text, source_sha256, error``: strict UTF-8, at most 64 MiB; a bad file has an error and no text. Spark's scans pass over files of no bytes."""
    df = binary_files(spark, path, glob)
    error = F.when(F.col("length") > MAX_SOURCE_BYTES, "source_too_large").when(~F.is_valid_utf8(F.col("content").cast("string")), "invalid_utf8")
    return df.select("path", F.when(error.isNull(), F.col("content").cast("string")).alias("text"), F.sha2("content", 256).alias("source_sha256"), error.alias("error"))


JSONL_SCHEMA = "path string, source_sha256 string, chunk_index long, row_start long, row_end long, row_count long, byte_start long, byte_end long, shard_sha256 string, error string"


def _strict(constant: str):
    raise ValueError(constant)


def scan_jsonl(content: bytes, per_shard: int) -> tuple[list[tuple], str | None]:
    """``(index, first row, last row, first byte, end byte, digest)`` of each shard, or the first error with its row.

    Records end in line feeds, which belong to them; the last may lack its own.
    """
    if per_shard < 1:
        raise ValueError("records_per_shard must be positive")
    out, row, at, first_byte, first_row, digest = [], 0, 0, 0, 1, hashlib.sha256()
    while at < len(content):
        end = content.find(b"\n", at) + 1 or len(content)
        row, record = row + 1, content[at:end]
        if len(record) > MAX_RECORD_BYTES:
            return [], f"record_too_large:{row}"
        try:
            text = record.decode()
        except UnicodeDecodeError:
            return [], f"invalid_utf8:{row}"
        if not text.strip():
            return [], f"blank_record:{row}"
        try:
            json.loads(text, parse_constant=_strict)
        except ValueError:
            return [], f"invalid_json:{row}"
        digest.update(record)
        at = end
        if row - first_row + 1 == per_shard or at == len(content):
            out.append((len(out), first_row, row, first_byte, at, digest.hexdigest()))
            if len(out) > MAX_SHARDS:
                return [], "too_many_shards"
            first_byte, first_row, digest = at, row + 1, hashlib.sha256()
    return out, None if out else "source_empty"


@pandas_udf(BooleanType())
def _is_json(texts: pd.Series) -> pd.Series:
    def one(x: str | None) -> bool:
        try:
            json.loads(x or "", parse_constant=_strict)
        except (ValueError, RecursionError):
            return False
        return True

    return texts.map(one)


def jsonl_records(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, row, byte_start, byte_end, value, error`` of each record of JSON-lines files of any size.

    Files are read in ranges: a record belongs to the range in which it begins, so a large
    file is many tasks. Rows and bytes are numbered by running sums over (range, place in
    it). A record ends in a line feed, which counts as its byte; the last may lack its own.
    """
    reader = spark.read.option("lineSep", "\n")
    lines = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    size = (F.octet_length("value") + 1).cast("long")
    lines = lines.select(F.regexp_replace(F.col("_metadata.file_path"), r"\Afile:///", "file:/").alias("path"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"), "value", size.alias("bytes"))
    rows = running_totals(lines, [F.col("start"), F.col("place")], {"row": F.lit(1), "byte_end": F.col("bytes")}, [F.col("path")])
    whole = rows.groupBy("path", "file_size").agg(F.max("byte_end").alias("read"))
    # Without a last line feed a byte is counted too many; a byte order mark is passed over by the reader.
    whole = whole.select(F.col("path").alias("p"), "read", F.when(F.col("file_size") - F.col("read") >= 2, 3).otherwise(0).alias("mark"), (F.col("read") - F.col("file_size")).isin(1, -2).alias("open"))
    rows = rows.join(whole, F.col("path") == F.col("p"))
    valid = F.is_valid_utf8("value")
    parsed = _is_json(F.when(valid, F.col("value")))
    marked = (F.col("mark") > 0) & (F.col("row") == 1)
    error = F.when(F.col("bytes") > MAX_RECORD_BYTES, "record_too_large").when(~valid, "invalid_utf8").when(trim(F.when(valid, F.col("value"))) == "", "blank_record").when(marked | ~parsed, "invalid_json")
    end = F.col("byte_end") + F.col("mark") - F.when(F.col("open") & (F.col("byte_end") == F.col("read")), 1).otherwise(0)
    begin = F.when(F.col("row") == 1, 0).otherwise(F.col("byte_end") - F.col("bytes") + F.col("mark"))
    raw = F.concat(F.when(marked, F.lit(b"\xef\xbb\xbf")).otherwise(F.lit(b"")), F.col("value").cast("binary"), F.when(F.col("open") & (F.col("byte_end") == F.col("read")), F.lit(b"")).otherwise(F.lit(b"\n")))
    return rows.select("path", "row", begin.cast("long").alias("byte_start"), end.cast("long").alias("byte_end"), "value", raw.alias("raw"), error.alias("error"))


def jsonl_shards(spark: SparkSession, path: str, per_shard: int, glob: str | None = None) -> DataFrame:
    """Row ranges of JSON-lines files with exact byte bounds and digests, or the first error of a file with its row.

    Files may be of any size; a record has at most 16 MiB, a file at most 10,000 shards. Bounds
    and the digests of shards are made in many tasks; only the digest of a whole file, one
    byte after another, is one task's work, which streams it.
    """
    if per_shard < 1:
        raise ValueError("records_per_shard must be positive")
    rows = staged(jsonl_records(spark, path, glob).withColumn("chunk_index", F.floor((F.col("row") - 1) / per_shard)), "jsonl")
    bad = rows.where("error is not null").groupBy("path").agg(F.min(F.struct("row", "error")).alias("e")).select("path", F.concat_ws(":", "e.error", F.col("e.row").cast("string")).alias("error"))
    many = rows.groupBy("path").agg(F.max("chunk_index").alias("m")).where(F.col("m") >= MAX_SHARDS).select("path", F.lit("too_many_shards").alias("many"))
    sources = rolling_digest(rows, ["path"], [F.col("row")], F.col("raw")).select("path", F.col("sha256").alias("source_sha256")).join(bad, "path", "left").join(many, "path", "left").select("path", "source_sha256", F.coalesce("error", "many").alias("error"))
    sources = staged(sources, "jsonl-sources")
    bounds = rows.groupBy("path", "chunk_index").agg(F.min("row").alias("row_start"), F.max("row").alias("row_end"), F.count(F.lit(1)).alias("row_count"), F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"))
    digests = rolling_digest(rows, ["path", "chunk_index"], [F.col("row")], F.col("raw")).select("path", "chunk_index", F.col("sha256").alias("shard_sha256"))
    columns = [c.split()[0] for c in JSONL_SCHEMA.split(", ")]
    good = bounds.join(digests, ["path", "chunk_index"]).join(sources.where("error is null"), "path").select(columns)
    return good.unionByName(sources.where("error is not null"), allowMissingColumns=True).select(columns)


def read_slices(shards: DataFrame, files: DataFrame) -> DataFrame:
    """``shards`` with ``input_text``: inline text, else the bytes ``[byte_start, byte_end)`` of the file, else the whole file."""
    df = shards.join(files.select(F.col("path").alias("input_path"), "content"), "input_path", "left")
    whole = F.col("content")
    part = F.when(F.col("byte_start").isNull(), whole).otherwise(F.substring(whole, F.col("byte_start").cast("int") + 1, (F.col("byte_end") - F.col("byte_start")).cast("int")))
    text = F.coalesce("inline_text", F.when(F.is_valid_utf8(part.cast("string")), part.cast("string")))
    return df.withColumn("input_text", text).drop("content")


# Stream fields that are kept of a media probe.
STREAM_FIELDS = "index codec_type codec_name codec_long_name profile level width height coded_width coded_height pix_fmt sample_fmt sample_rate channels channel_layout bit_rate duration start_time time_base nb_frames avg_frame_rate r_frame_rate field_order is_avc".split()
PROBE = "streams ARRAY<STRUCT<" + ", ".join(f"{f}: STRING" for f in STREAM_FIELDS) + ">>, format STRUCT<duration: STRING, format_name: STRING, size: STRING>"


def probed_media(files: DataFrame, probe: Column) -> DataFrame:
    """``files`` with what their probe JSON says; rows without an audio or video stream and a duration go."""
    df = files.withColumn("p", F.from_json(probe, PROBE))
    kind = lambda k: F.exists("p.streams", lambda s: s["codec_type"] == k)
    seconds = F.col("p.format.duration").try_cast("double")
    df = df.withColumn("duration_seconds", F.when((seconds >= 0) & (seconds < float("inf")), seconds)).withColumn("media_type", F.when(kind("video"), "video").when(kind("audio"), "audio"))
    return df.where("media_type is not null and duration_seconds is not null").withColumn("container", F.col("p.format.format_name")).withColumn("streams", F.col("p.streams")).drop("p")


#: An OCR engine: image bytes and a 1-based page to text.
Engine = Callable[[bytes, int], str]


def fake_engine(content: bytes, page: int) -> str:
    return f"page {page} of {hashlib.sha256(content).hexdigest()[:12]}"


def ocr_pages(pages: DataFrame, engine: Engine = fake_engine) -> DataFrame:
    """``source_id, page_number, text, error`` from ``source_id, page_number, content``; an empty text is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, errors = [], []
            for content, page in zip(pdf["content"], pdf["page_number"], strict=True):
                try:
                    text = engine(bytes(content), int(page)).strip()
                    texts.append(text or None)
                    errors.append(None if text else "ocr_empty")
                except Exception as e:  # an engine's failure is that page's result
                    texts.append(None)
                    errors.append(f"ocr_failed:{type(e).__name__}")
            yield pd.DataFrame({"source_id": pdf["source_id"], "page_number": pdf["page_number"], "text": texts, "error": errors})

    return pages.select("source_id", F.col("page_number").cast("long").alias("page_number"), "content").mapInPandas(run, "source_id string, page_number long, text string, error string")


def engine_text(value) -> str:
    """The first text that is not blank among markdown, text, content and result; lists and pages by blank lines."""
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, list):
        return "\n\n".join(t for t in map(engine_text, value) if t)
    if isinstance(value, dict):
        for k in ("markdown", "text", "content", "result"):
            if k in value and (t := engine_text(value[k])):
                return t
        return engine_text(value.get("pages") or [])
    return ""


@pandas_udf(StringType())
def engine_texts(outputs: pd.Series) -> pd.Series:
    """``engine_text`` of JSON texts; null for what isn't JSON, and empty where there is no text. Nested deeper than Python can follow is no JSON."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else engine_text(json.loads(x))
        except (ValueError, RecursionError):
            return None

    return outputs.map(one)


def page_bounds_ok(kind: Column, page_start: Column, page_end: Column, page_count: Column) -> Column:
    """One page of those there are; images have page 1 alone."""
    one = (page_start == page_end) & (page_start >= 1) & (page_start <= page_count)
    return F.coalesce(F.when(kind == "image", one & (page_start == 1)).otherwise(one), F.lit(False))


RUN_MANIFEST = "schema_version STRING, run_id STRING, project STRING, egress_class STRING, transport STRING, model STRING, response_format STRING, max_tokens INT, concurrency INT, cost_cap_usd DOUBLE, canonical_writes BOOLEAN, external_side_effects BOOLEAN, items ARRAY<STRUCT<id: STRING, prompt: STRING, messages: ARRAY<STRUCT<role: STRING, content: STRING>>, metadata: MAP<STRING, STRING>>>"
CORPUS_MANIFEST = "job_id STRING, project STRING, workload_type STRING, privacy_lane STRING, processor STRUCT<type: STRING, engine: STRING>, max_retries INT, max_shards_per_batch INT, max_batch_input_bytes BIGINT, sources ARRAY<STRUCT<id: STRING, path: STRING, sha256: STRING, type: STRING>>, shards ARRAY<STRUCT<id: STRING, source_id: STRING, input_path: STRING, inline_text: STRING, bounds: MAP<STRING, STRING>>>"


def manifests(texts: DataFrame, column: str, schema: str, lists: tuple[str, ...]) -> DataFrame:
    """``texts`` with ``manifest`` and ``error``: JSON of this schema whose ``lists`` have 1 to 10,000 entries."""
    df = texts.withColumn("manifest", F.from_json(column, schema + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("manifest").isNull() | F.col("manifest._bad").isNotNull()
    for name in lists:
        bad = bad | ~F.coalesce(F.size(f"manifest.{name}").between(1, MAX_SHARDS), F.lit(False))
    return df.withColumn("error", F.when(bad, "invalid_manifest")).withColumn("manifest", F.when(~bad, F.col("manifest").dropFields("_bad")))


LEDGER = "job_id STRING, status STRING, updated_at STRING, shards ARRAY<STRUCT<shard_id: STRING, source_id: STRING, status: STRING, attempts: INT, input_sha256: STRING, output_sha256: STRING, next_retry_at: STRING>>"


def ledgers(spark: SparkSession, root: str) -> DataFrame:
    """``path, ledger, error`` of all ``*/ledger.json``; a broken one doesn't hide the others."""
    df = spark.read.text(f"{root}/*/ledger.json", wholetext=True).select(F.input_file_name().alias("path"), "value")
    return manifests(df, "value", LEDGER, ()).select("path", F.col("manifest").alias("ledger"), F.when(F.col("manifest.job_id").isNull(), "invalid_ledger").alias("error"))


def running_jobs(spark: SparkSession, root: str) -> DataFrame:
    return ledgers(spark, root).where("error is null and ledger.status = 'running'").select("ledger.job_id", "path", "ledger").orderBy("job_id", "path")


def newest_jobs(spark: SparkSession, root: str, n: int = 5) -> DataFrame:
    return ledgers(spark, root).where("error is null").select("ledger.*").orderBy(F.col("updated_at").desc(), "job_id").limit(n)


def pinned_text(spark: SparkSession, paths: list[str], separator: str = "\n\n") -> str:
    """Contents of a fixed list of files in its order; missing ones are left out."""
    out = []
    for p in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            out.append(spark.read.text(p, wholetext=True).first().value)
    return separator.join(out)


# Parts of paths that no source may have.
FORBIDDEN_PARTS = ("/.ssh/", "/.gnupg/", "/library/keychains/", "/.config/opencode/auth", "/.codex/auth")
SENSITIVE_SEGMENTS = (".aws", ".git", ".kube", ".netrc", ".npmrc", ".pypirc", "certs", "certificates", "credential", "credentials", "keychain", "keychains", "passwords", "private-keys", "private_keys", "private-workspace-state", "secret", "secrets", "token", "tokens")
SENSITIVE_NAMES = (r"\.env(?:\..*)?", r"authorized_keys|id_(?:dsa|ecdsa|ed25519|rsa)|known_hosts", r".*\.(?:jks|key|keystore|p12|pem|pfx)", r"(?:.*[._-])?(?:auth|credential|password|private[-_]?key|secret|token)(?:[._-].*)?")
SENSITIVE_ROOTS = ("etc", "system")
PRIVATE_NOTES = r"/users/[^/]+/documents/obsidian/"


def safe_path(path: str, root: str) -> bool:
    """Inside ``root``, without parent steps, null characters or forbidden or sensitive parts, in any case."""
    p = PurePosixPath(path)
    if "\0" in path or not path.strip() or ".." in p.parts or PurePosixPath(root) not in (p, *p.parents):
        return False
    parts = [x.lower() for x in p.parts if x != "/"]
    whole = f"/{'/'.join(parts)}/"
    if any(x in whole for x in FORBIDDEN_PARTS) or re.search(PRIVATE_NOTES, whole):
        return False
    name = parts[-1] if parts else ""
    return not (any(x in SENSITIVE_SEGMENTS for x in parts) or any(re.fullmatch(n, name, re.DOTALL) for n in SENSITIVE_NAMES) or parts[:1] and parts[0] in SENSITIVE_ROOTS)


def sensitive(path: Column) -> Column:
    """Whether a path has forbidden or sensitive parts: ``safe_path``'s rules as an expression."""
    whole = F.concat(F.lit("/"), F.array_join(F.filter(F.split(F.lower(path), "/"), lambda x: x != ""), "/"), F.lit("/"))
    parts = F.split(whole, "/")
    bad = whole.rlike(PRIVATE_NOTES) | F.arrays_overlap(parts, F.array(*map(F.lit, SENSITIVE_SEGMENTS))) | F.get(parts, F.lit(1)).isin(*SENSITIVE_ROOTS)
    for part in FORBIDDEN_PARTS:
        bad = bad | F.contains(whole, F.lit(part))
    for name in SENSITIVE_NAMES:
        bad = bad | F.element_at(parts, -2).rlike(rf"(?s)\A(?:{name})\z")
    return bad


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", "4"))
        self.columns = [f.name for f in schema.fields]

    def _connect(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def _name(self, name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    def partitions(self):
        with self._connect() as con:
            low, high = con.execute(f"select min(rowid), max(rowid) from {self._name(self.table)}").fetchone()
        if low is None:
            return [_Range(0, -1)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range):
        with self._connect() as con:
            yield from con.execute(f"select {', '.join(map(self._name, self.columns))} from {self._name(self.table)} where rowid between ? and ?", (partition.low, partition.high))


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").schema(...).option("table", ...).load(path)``: row-id ranges of a table in a file that executors reach."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema):
        return _SqliteReader(self.options, schema)
