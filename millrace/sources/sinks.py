"""Sinks: outputs with proofs, writes that never clobber, keyed merges, reports and quarantine."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.text import safe_file_name
from ..operators.translation import upsert
from ..plans.staging import staged


class ConflictError(ValueError):
    """What is stored under a key differs from what was to be written there."""


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def append_new(rows: DataFrame, path: str, keys: list[str], digest: str) -> int:
    """Append rows whose keys aren't stored yet; equal digests are a no-op, others raise. Returns how many were new."""
    spark = rows.sparkSession
    doubled = rows.groupBy(*keys).agg(F.countDistinct(digest).alias("n")).where("n > 1")
    if not doubled.isEmpty():
        raise ConflictError("a key is written twice with different contents")
    rows = rows.dropDuplicates(keys)
    if exists(spark, path):
        stored = spark.read.parquet(path).select(*keys, F.col(digest).alias("__stored"))
        joined = rows.join(stored, keys, "left")
        if not joined.where(F.col("__stored").isNotNull() & (F.col("__stored") != F.col(digest))).isEmpty():
            raise ConflictError("stored contents differ")
        rows = joined.where("__stored is null").drop("__stored")
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def commit_outputs(outputs: DataFrame, root: str, proof_columns: list[str]) -> int:
    """Outputs first, proofs after them: a crash between leaves outputs that recovery proves anew.

    ``outputs``: ``job_id, shard_id, output`` and the proof's columns.
    """
    rows = outputs.withColumn("output_sha256", F.sha2("output", 256))
    append_new(rows.select("job_id", "shard_id", "output", "output_sha256"), f"{root}/outputs", ["job_id", "shard_id"], "output_sha256")
    return append_new(rows.select("job_id", "shard_id", "output_sha256", *proof_columns), f"{root}/proofs", ["job_id", "shard_id"], "output_sha256")


def write_snapshot(rows: DataFrame, root: str) -> str:
    """A new version of a table; readers see it once its name stands in ``CURRENT``."""
    spark, name = rows.sparkSession, f"v-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/{name}")
    write_text(spark, f"{root}/CURRENT", name, overwrite=True)
    return name


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{spark.read.text(f'{root}/CURRENT').first().value}")


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions that were published, ascending."""
    at, fs = _path(spark, f"{root}/versions")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()) if fs.exists(at) else []


def read_version(spark: SparkSession, root: str, number: int | None = None) -> DataFrame | None:
    """The table as of a version, by default the last; None before the first."""
    known = versions(spark, root)
    if not known:
        return None
    name = spark.read.text(f"{root}/versions/{known[-1] if number is None else number}", wholetext=True).first().value
    return spark.read.parquet(f"{root}/{name}")


def merge_version(spark: SparkSession, root: str, change: Callable[[DataFrame | None], DataFrame], attempts: int = 20) -> int:
    """Publish ``change(current)`` as the next version of the table at ``root``; returns its number.

    Versions are numbered pointers. Each is created exclusively: of two writers that started
    from one version, one finds its number taken, reads the new version and changes that. So
    no writer's rows are lost, and readers see whole versions only.
    """
    for _ in range(attempts):
        known = versions(spark, root)
        number, name = (known[-1] + 1 if known else 1), f"data-{uuid.uuid4().hex}"
        change(read_version(spark, root, known[-1]) if known else None).write.parquet(f"{root}/{name}")
        if _create(spark, f"{root}/versions/{number}", name):
            return number
        lost, fs = _path(spark, f"{root}/{name}")
        fs.delete(lost, True)
    raise ConflictError("merge_attempts_exhausted")


def store_memory(spark: SparkSession, root: str, batch: DataFrame, now: Column) -> int:
    """Merge a reviewed batch into the stored memory of translations, whole or not at all; returns the new version's number."""
    empty = batch.limit(0).withColumns({c: now for c in ("created_at", "updated_at")})
    return merge_version(spark, root, lambda old: upsert(empty if old is None else old, batch, now).drop("inserted"))


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its content, in one step; False if there is one.

    Where the store creates exclusively and renames without replacing (HDFS), a rename of a
    written file decides; a local file system replaces on rename, so there a hard link does.
    """
    target, fs = _path(spark, path)
    beside, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    fs.mkdirs(target.getParent())
    stream = fs.create(beside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if fs.getUri().getScheme() == "file":
            try:
                os.link(beside.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        return not fs.exists(target) and fs.rename(beside, target)
    finally:
        fs.delete(beside, False)


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """One small file, written beside and renamed. Without ``overwrite`` an equal file is fine and another raises."""
    target, fs = _path(spark, path)
    if fs.exists(target) and not overwrite:
        if spark.read.text(path, wholetext=True).first().value != text:
            raise ConflictError("artifact_output_exists")
        return
    beside, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(beside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if overwrite:
        # One step, so that a crash leaves the old file or the new one.
        jvm = spark.sparkContext._jvm
        options = jvm.org.apache.hadoop.fs.Options.Rename
        how = spark.sparkContext._gateway.new_array(options, 1)
        how[0] = options.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(target), how)
    else:
        fs.delete(beside, False)
        if not _create(spark, path, text) and spark.read.text(path, wholetext=True).first().value != text:
            raise ConflictError("artifact_output_exists")


def write_results(items: DataFrame, path: str) -> None:
    """JSON lines ordered by item id."""
    items.orderBy("item_id").write.json(path)


def report_json(runs: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """One JSON text for each run: its row and, by name, the rows of other tables that belong to it."""
    df = runs
    for name, rows in parts.items():
        rest = [c for c in rows.columns if c != key]
        df = df.join(rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name)), key, "left")
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("report"))


class _OrderedWriter(DataSourceArrowWriter):
    """One file for each key, written as its rows arrive, with the digest of its bytes."""

    def __init__(self, options: dict):
        self.root, self.separator = options["path"].rstrip("/"), options.get("separator", "\n\n").encode()

    def _open(self, name: str):
        from pyarrow import fs

        if "://" in self.root or self.root.startswith("file:"):
            files, root = fs.FileSystem.from_uri(self.root if "://" in self.root else self.root.replace("file:", "file://", 1))
        else:
            files, root = fs.LocalFileSystem(), self.root
        return files, f"{root}/{name}"

    def write(self, iterator):
        import hashlib

        written, at, out = [], None, None

        def closed() -> None:
            if out is not None:
                out.close()
                written.append((at[0], at[1], at[2].hexdigest(), at[3], at[4]))

        for batch in iterator:
            for key, data in zip(batch.column(0), batch.column(1), strict=True):
                key = key.as_py()
                if at is None or key != at[0]:
                    closed()
                    part = f"_parts/{uuid.uuid4().hex}"
                    files, where = self._open(part)
                    files.create_dir(where.rsplit("/", 1)[0], recursive=True)
                    out, at = files.open_output_stream(where), [key, part, hashlib.sha256(), 0, 0]
                at[4] += 1
                if not data.is_valid:
                    continue
                for piece in (self.separator, data.as_buffer()) if at[3] else (data.as_buffer(),):
                    out.write(piece)
                    at[2].update(piece)
                at[3] += 1
        closed()
        return _Written(written)

    def commit(self, messages):
        """Files take their names once all of them are there. An equal file is fine, another raises and nothing is published."""
        import hashlib

        from pyarrow import fs

        found = [w for m in messages if m is not None for w in m.files]
        files, root = self._open("")
        names = [f"{root.rstrip('/')}/{w[0]}.txt" for w in found]
        for w, name in zip(found, names, strict=True):
            if files.get_file_info(name).type != fs.FileType.NotFound:
                digest = hashlib.sha256()
                with files.open_input_stream(name) as old:
                    while piece := old.read(1 << 20):
                        digest.update(piece)
                if digest.hexdigest() != w[2]:
                    self.abort(messages)
                    raise ConflictError(f"artifact_output_exists: {w[0]}")
        for w, name in zip(found, names, strict=True):
            files.move(f"{root.rstrip('/')}/{w[1]}", name)
        with files.open_output_stream(f"{root.rstrip('/')}/outputs.jsonl") as out:
            out.write("".join(json.dumps({"key": w[0], "sha256": w[2], "n_shards": w[4]}) + "\n" for w in sorted(found)).encode())

    def abort(self, messages):
        files, root = self._open("_parts")
        for m in messages:
            for w in m.files if m is not None else ():
                files.delete_file(f"{root.rsplit('/', 1)[0]}/{w[1]}")


@dataclass
class _Written(WriterCommitMessage):
    files: list


class OrderedTexts(DataSource):
    """``df.write.format("ordered_texts")`` of ``key string, text string``; see ``write_ordered``."""

    @classmethod
    def name(cls) -> str:
        return "ordered_texts"

    def writer(self, schema, overwrite):
        return _OrderedWriter(self.options)


def write_ordered(shards: DataFrame, root: str, key: str, position: str, text: str, separator: str = "\n\n") -> DataFrame:
    """One file ``<key>.txt`` for each job: its texts in order, joined. Returns ``key, sha256, n_shards``.

    A job's texts stream through one task into its file; none is ever held whole, so an output
    may be larger than any memory or row. ``root`` is a shared folder that pyarrow's file
    systems reach. Keys are made safe as file names; two that become one raise.
    """
    spark = shards.sparkSession
    spark.dataSource.register(OrderedTexts)
    named = shards.select(safe_file_name(F.col(key).cast("string")).alias("key"), F.col(key).cast("string").alias("own"), F.col(position).alias("at"), F.col(text).alias("text"))
    if not named.groupBy("key").agg(F.countDistinct("own").alias("n")).where("n > 1").isEmpty():
        raise ConflictError("two keys have one file name")
    rows = named.repartition("key").sortWithinPartitions("key", "at", "text").select("key", F.col("text").cast("binary").alias("text"))
    rows.write.format("ordered_texts").option("separator", separator).mode("append").save(root)
    return spark.read.schema("key string, sha256 string, n_shards long").json(f"{root}/outputs.jsonl")


#: What a file of stored bytes can be to the bytes that belong there.
SAME, CUT_OFF, CONFLICT, ABSENT = "same", "cut_off", "conflict", "absent"


def remnants(artifacts: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    """``artifacts`` (``keys, content``) with ``outcome``: the stored bytes are the same, are cut off (a strict
    beginning: what a writer left that was lost), are others, or are absent."""
    old = stored.select(*keys, F.col("content").cast("binary").alias("__old"))
    df = artifacts.join(old, list(keys), "left")
    new, was = F.col("content").cast("binary"), F.col("__old")
    begins = (F.octet_length(was) < F.octet_length(new)) & (F.substring(new, F.lit(1), F.octet_length(was)) == was)
    outcome = F.when(was.isNull(), ABSENT).when(was == new, SAME).when(begins, CUT_OFF).otherwise(CONFLICT)
    return df.withColumn("outcome", outcome)


def write_artifacts(artifacts: DataFrame, root: str, *keys: str) -> dict[str, int]:
    """Store ``artifacts`` (``keys, content``) as a new version of the table at ``root``: equal ones again do nothing, remnants that
    were cut off go to the quarantine table, named by the digest of their bytes, and are written whole; any conflict
    raises before anything is written. Returns how many rows had each outcome."""
    spark = artifacts.sparkSession
    rows = artifacts.select(*keys, F.col("content").cast("binary").alias("content"))
    if not rows.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ConflictError("a key is written twice")
    stored = read_snapshot(spark, root) if exists(spark, f"{root}/CURRENT") else spark.createDataFrame([], rows.schema)
    judged = staged(remnants(rows, stored, *keys), "artifacts")
    counts = {r.outcome: r["count"] for r in judged.groupBy("outcome").count().collect()}
    if CONFLICT in counts:
        raise ConflictError(f"shard_artifact_conflict: {counts[CONFLICT]}")
    if CUT_OFF in counts:
        lost = judged.where(F.col("outcome") == CUT_OFF)
        lost.select(*keys, F.format_string("interrupted-%s.partial", F.substring(F.sha2("__old", 256), 1, 16)).alias("name"), F.col("__old").alias("content")).write.mode("append").parquet(f"{root}/quarantine")
    if {CUT_OFF, ABSENT} & set(counts):
        new = judged.where(F.col("outcome").isin(CUT_OFF, ABSENT)).select(*keys, "content")
        write_snapshot(stored.join(new.select(*keys), list(keys), "left_anti").unionByName(new), root)
    return counts


def split_quarantine(rows: DataFrame, bad: str) -> tuple[DataFrame, DataFrame]:
    """Rows without and with a value in ``bad``."""
    return rows.where(F.col(bad).isNull()).drop(bad), rows.where(F.col(bad).isNotNull())


def create_run(spark: SparkSession, root: str, run: DataFrame, items: DataFrame) -> int:
    """Store a run and its items, items first: a run that can be seen has them all. Then its event. Returns the new items.

    ``run``: ``run_id, manifest, ...``; ``items``: ``run_id, item_id, payload, ...``.
    """
    digest = lambda rows, column: rows.withColumn("sha256", F.sha2(column, 256))
    made = append_new(digest(items, "payload"), f"{root}/items", ["run_id", "item_id"], "sha256")
    if append_new(digest(run, "manifest"), f"{root}/runs", ["run_id"], "sha256"):
        run.select("run_id", F.lit("run_created").alias("type"), F.current_timestamp().alias("ts")).write.mode("append").parquet(f"{root}/events")
    return made


def acquire_lock(spark: SparkSession, path: str, owner: str, stale_ms: int = 900_000) -> bool:
    """Create a lock file if there is none; one that is older than ``stale_ms`` is moved aside, once, and taken over."""
    target, fs = _path(spark, path)
    for attempt in range(2):
        try:
            stream = fs.create(target, False)
        except Exception:  # it is there already
            try:
                age = spark.sparkContext._jvm.System.currentTimeMillis() - fs.getFileStatus(target).getModificationTime()
            except Exception:  # and has just been given back
                continue
            aside, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.stale")
            if attempt or age <= stale_ms or not fs.rename(target, aside):
                return False
            fs.delete(aside, False)
            continue
        stream.write(bytearray(owner.encode()))
        stream.close()
        return True
    return False


def release_lock(spark: SparkSession, path: str, owner: str) -> bool:
    """Remove the lock if ``owner`` holds it."""
    target, fs = _path(spark, path)
    if not fs.exists(target) or spark.read.text(path, wholetext=True).first().value != owner:
        return False
    return fs.delete(target, False)
