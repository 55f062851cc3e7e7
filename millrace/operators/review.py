"""Joins of shards, outputs and reviews; state transitions; redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signatures import signed_by
from ..functions.text import trim
from .ordered import rolling_digest
from .translation import quality

REDACTED = "[redacted]"


def redact(receipt: Column, *fields: str) -> Column:
    """A receipt struct with its signature (or other fields) replaced; null stays null."""
    out = receipt
    for f in fields or ("signature",):
        out = out.withField(f, F.lit(REDACTED))
    return F.when(receipt.isNotNull(), out)


def interrupted_runs(shards: DataFrame, results: DataFrame) -> DataFrame:
    """Running shards of an interrupted processor run: completed items commit, others are quarantined; the rest is untouched.

    ``shards``: ``run_id, item_id, status, ...``; ``results``: ``run_id, item_id, status``.
    """
    r = results.select("run_id", "item_id", F.col("status").alias("__r"))
    df = shards.join(r, ["run_id", "item_id"], "left")
    running = F.col("status") == "running"
    return df.withColumn("status", F.when(running & (F.col("__r") == "completed"), "succeeded").when(running, "quarantined").otherwise(F.col("status"))).drop("__r")


def translation_blockers(shards: DataFrame, outputs: DataFrame, source_lang: str, target_lang: str, glossary: list[tuple[str, str]] = (), low: float = 0.25, high: float = 4.0) -> DataFrame:
    """``shard_id, blocker``: ``translation_qa:{shard}:{code}`` of succeeded shards.

    ``shards``: ``shard_id, status, input_text, source_lang, target_lang``; null languages fall back to the job's.
    """
    df = shards.where("status = 'succeeded'").join(outputs.select("shard_id", "output"), "shard_id")
    q = quality(F.col("input_text"), F.col("output"), F.coalesce("source_lang", F.lit(source_lang)), F.coalesce("target_lang", F.lit(target_lang)), list(glossary), low, high)
    return df.select("shard_id", F.explode(q["blockers"]).alias("code")).select("shard_id", F.concat_ws(":", F.lit("translation_qa"), "shard_id", "code").alias("blocker"))


def review_mismatches(entries: DataFrame, shards: DataFrame) -> DataFrame:
    """``shard_id, reason``: succeeded shards without a reviewed entry of the same source and target digest."""
    e = entries.select("shard_id", F.col("source_sha256").alias("__s"), F.col("target_sha256").alias("__t"))
    df = shards.where("status = 'succeeded'").join(e, "shard_id", "left")
    reason = F.when(F.col("__s").isNull(), "review_entry_missing").when(F.col("__s") != F.col("input_sha256"), "review_source_mismatch").when(F.col("__t") != F.col("output_sha256"), "review_target_mismatch")
    return df.select("shard_id", reason.alias("reason")).where("reason is not null")


def review_digests(entries: DataFrame, job: str, *fields: str) -> DataFrame:
    """``job, entries, payload_sha256``: digest of each job's entries as JSON, in the order of their shards (texts are collated); they stream through it."""
    names = sorted({"shard_id", *fields})
    entry = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    shard = F.col("shard_id")
    order = [F.collate(shard, "UNICODE"), shard] if dict(entries.dtypes)["shard_id"] == "string" else [shard]
    out = rolling_digest(entries, [job], [*order, entry], entry, ",", "[", "]")
    return out.select(job, F.col("n_rows").alias("entries"), F.col("sha256").alias("payload_sha256"))


def incomplete_reviews(ledger: DataFrame, outputs: DataFrame) -> DataFrame:
    """``shard_id, reason``: shards of a review that have no output, or one of another digest. A review of a job needs
    every shard of its ledger."""
    stored = outputs.select("shard_id", F.sha2("output", 256).alias("__sha"))
    df = ledger.join(stored, "shard_id", "left")
    reason = F.when((F.col("status") != "succeeded") | F.col("__sha").isNull(), "translation_review_output_missing").when(~F.col("__sha").eqNullSafe(F.col("output_sha256")), "translation_review_output_hash_mismatch")
    return df.select("shard_id", reason.alias("reason")).where("reason is not null")


def transition(items: DataFrame, to: str, allowed: tuple[str, ...], run_id: str | None = None) -> DataFrame:
    """Items of a run (or of all) in one of ``allowed`` states move to ``to``; starting counts an attempt."""
    mine = F.col("status").isin(*allowed) & (F.lit(True) if run_id is None else F.col("run_id") == run_id)
    df = items
    if to == "running" and "attempts" in items.columns:
        df = df.withColumn("attempts", F.col("attempts") + F.when(mine, 1).otherwise(0))
    return df.withColumn("status", F.when(mine, to).otherwise(F.col("status")))


def set_run_status(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """``runs`` with the status and error that ``changes`` (``run_id, status, error``) give; other runs stay."""
    new = changes.select("run_id", F.struct("status", "error").alias("__new"))
    df = runs.join(new, "run_id", "left")
    changed = F.col("__new").isNotNull()
    df = df.withColumns({c: F.when(changed, F.col(f"__new.{c}")).otherwise(F.col(c)) for c in ("status", "error")})
    return df.drop("__new").select(*runs.columns)


def interrupted_run_ids(shards: DataFrame) -> DataFrame:
    """The runs that hold running shards, each once."""
    return shards.where("status = 'running' and run_id is not null").select("run_id").distinct()


def transition_events(before: DataFrame, after: DataFrame, *keys: str, prefix: str = "item_") -> DataFrame:
    """``keys, type`` for each row whose status changed: ``item_{status}``, or another prefix."""
    b = before.select(*keys, F.col("status").alias("__b"))
    return after.join(b, list(keys)).where(~F.col("status").eqNullSafe(F.col("__b"))).select(*keys, F.concat(F.lit(prefix), F.col("status")).alias("type"))


def chat_messages(messages: DataFrame, calls: str = "tool_calls_json") -> DataFrame:
    """Adds ``tool_calls`` parsed from JSON; what can't be parsed is dropped silently."""
    return messages.withColumn("tool_calls", F.from_json(calls, "ARRAY<STRUCT<id: STRING, type: STRING, function: STRUCT<name: STRING, arguments: STRING>>>")).drop(calls)


def capped(rows: DataFrame, order: list[str], cap: int = 50) -> tuple[DataFrame, int]:
    """The first ``cap`` rows and how many more there are."""
    return rows.orderBy(*order).limit(cap), max(0, rows.count() - cap)


def retained(reports: DataFrame, key: str, order: str, keep: int = 10) -> DataFrame:
    """The last ``keep`` reports of each key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return reports.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= keep).drop("__n")


def health(reports: DataFrame) -> DataFrame:
    return reports.agg(F.coalesce(F.bool_or(~F.col("ok")), F.lit(False)).alias("any_failed"), F.count(F.lit(1)).alias("reports"))


def receipt_blockers(receipt: Column, job: Column, project: Column, payload_sha256: Column, now: Column, key_configured: bool = True, well_formed: Column | None = None, signed: Column | None = None) -> Column:
    """Blockers of a review receipt: struct ``status, issuer, job_id, project, review_payload_sha256, issued_at,
    expires_at`` or null. ``well_formed`` and ``signed`` are what ``signed_receipt_blockers`` finds out."""
    r = lambda f: receipt.getField(f)
    differs = lambda f, want: receipt.isNotNull() & ~r(f).eqNullSafe(want)
    unapproved = differs("status", F.lit("approved")) | differs("issuer", F.lit("owner"))
    whole = receipt.isNotNull() if well_formed is None else well_formed
    window = F.coalesce(r("expires_at") > r("issued_at"), F.lit(False))
    late = F.timestamp_micros(F.unix_micros(now) + 5 * 60 * 1_000_000)
    # Names of blockers, in their order.
    name = lambda test, code: F.when(test, F.lit(f"translation_review_receipt_{code}"))
    return F.array_compact(
        F.array(
            name(F.lit(not key_configured), "public_key_not_configured"),
            name(unapproved, "not_owner_approved"),
            name(differs("job_id", job), "job_mismatch"),
            name(differs("project", project), "project_mismatch"),
            name(differs("review_payload_sha256", payload_sha256), "payload_digest_mismatch"),
            name(~whole & ~unapproved, "invalid"),
            name(whole & ~unapproved & ~window, "time_window_invalid"),
            name(whole & ~unapproved & window & (r("issued_at") > late), "not_yet_valid"),
            name(whole & ~unapproved & window & (r("expires_at") <= now), "expired"),
            name(F.lit(False) if signed is None else whole & ~unapproved & ~signed, "signature_invalid"),
        )
    )


REVIEW_RECEIPT = "schema_version STRING, receipt_id STRING, status STRING, issuer STRING, reviewer STRING, issued_at STRING, expires_at STRING, nonce STRING, job_id STRING, project STRING, review_payload_sha256 STRING, signature_base64 STRING"
# What the fields of a review receipt must be like.
RECEIPT_FIELDS = {
    "receipt_id": r"\A[A-Za-z0-9_.:-]{8,200}\z", "status": r"\Aapproved\z", "issuer": r"\Aowner\z", "reviewer": r"(?s)\A.{1,200}\z", "nonce": r"\A[A-Za-z0-9_-]{16,200}\z", "job_id": r"(?s)\A.{1,200}\z", "project": r"(?s)\A.{1,200}\z",
    "review_payload_sha256": r"\A[a-f0-9]{64}\z", "signature_base64": r"(?s)\A.{1,1000}\z", "issued_at": r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)\z", "expires_at": r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)\z",
}


def signed_receipt_blockers(receipt_json: Column, job: Column, project: Column, payload_sha256: Column, now: Column, public_key: str | None, schema_version: str = "millrace.review-receipt.v1") -> Column:
    """Blockers of a review receipt as JSON text: its fields, and no others, must be there and be
    well formed, and its signature must be the owner's (PEM)."""
    keyed = bool((public_key or "").strip())
    receipt = F.from_json(receipt_json, REVIEW_RECEIPT)
    receipt = F.when(F.json_object_keys(receipt_json).isNotNull(), receipt)
    fields = [f.split()[0] for f in REVIEW_RECEIPT.split(", ")]
    same = F.array_sort(F.json_object_keys(receipt_json)) == F.array_sort(F.array(*map(F.lit, fields)))
    well = same & (receipt["schema_version"] == schema_version)
    for f, pattern in RECEIPT_FIELDS.items():
        well = well & receipt[f].rlike(pattern)
    for f in ("reviewer", "job_id", "project"):
        well = well & (trim(receipt[f]) != "")
    timed = F.when(receipt.isNotNull(), receipt.withField("issued_at", receipt["issued_at"].try_cast("timestamp")).withField("expires_at", receipt["expires_at"].try_cast("timestamp")))
    signed = F.coalesce(signed_by(receipt_json, public_key), F.lit(False)) if keyed else F.lit(True)
    # A one-element array binds the parsed receipt and the verdict on its signature.
    bound = F.array(F.struct(timed.alias("r"), F.coalesce(well, F.lit(False)).alias("well"), signed.alias("signed")))
    return F.get(F.transform(bound, lambda x: receipt_blockers(x["r"], job, project, payload_sha256, now, keyed, x["well"], x["signed"])), F.lit(0))


def processor_matches(processor: Column, engine: Column, version: Column, memory_hit: Column) -> Column:
    """Whether a proof's processor version is one that the manifest's processor gives."""
    ocr = F.regexp_extract(version, r"\A(?:local_ocr)\.(macos_vision|focr|tesseract)\.v1\z", 1)
    batch = (version == "model_batch.v1") | (version == "translation_memory.v1") & F.coalesce(memory_hit, F.lit(False))
    fits = F.when(processor == "copy_text", version == "copy_text.v1").when(processor == "local_ocr", (ocr != "") & ((engine == "auto") | (ocr == engine))).otherwise(batch)
    return F.coalesce(fits, F.lit(False))


def page_count(supplied: Column, detected: Column, most: int = 10_000) -> Column:
    """``pages, error`` of a document with pages: what was supplied and what was detected must agree."""
    n = F.coalesce(supplied, detected)
    error = F.when(supplied <= 0, "invalid_ocr_page_count").when(n.isNull() | (n <= 0), "ocr_pdf_pages_unavailable").when(n > most, "ocr_page_limit_exceeded").when(supplied != detected, "invalid_ocr_page_count")
    return F.struct(F.when(error.isNull(), n).alias("pages"), error.alias("error"))


def unsafe_inputs(shards: DataFrame, sources: DataFrame, sensitive) -> DataFrame:
    """``shard_id, reason`` of file-backed shards whose path isn't their source's file, or not inside its directory.

    ``shards``: ``shard_id, source_id, input_path``; ``sources``: ``id, path, is_file, sha256``; ``sensitive``:
    a predicate of paths.
    """
    s = sources.select(F.col("id").alias("source_id"), F.rtrim("path", F.lit("/")).alias("__path"), F.col("is_file").alias("__file"), F.col("sha256").alias("__sha"))
    df = shards.where("input_path is not null").join(s, "source_id", "left")
    path = F.col("input_path")
    inside = F.when(F.col("__file"), path == F.col("__path")).otherwise(F.startswith(path, F.concat("__path", F.lit("/"))) & ~path.rlike(r"(?:\A|/)\.\.(?:/|\z)"))
    reason = F.when(sensitive(path), "corpus_sensitive_source_path_blocked").when(F.col("__path").isNull(), "corpus_input_source_path_required").when(F.col("__file") & F.col("__sha").isNull(), "corpus_source_hash_required").when(~inside, "corpus_input_outside_source")
    return df.select("shard_id", reason.alias("reason")).where("reason is not null")


def with_columns_of(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` with the columns of ``schema`` that they lack, null: rows written before a column was added stay readable and untrusted."""
    return rows.unionByName(rows.sparkSession.createDataFrame([], schema), allowMissingColumns=True)


def collated(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows in the order that a reader of their language expects, not that of code points."""
    return rows.orderBy(*(F.collate(F.col(c), "UNICODE") for c in columns))
