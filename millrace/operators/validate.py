"""Checks of workload records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import space_word_count


def _without(fields: Column, layer: Column) -> Column:
    return F.map_filter(fields, lambda k, v: ~F.map_contains_key(layer, k))


def merged_fields(*layers: Column) -> Column:
    """Later maps win key by key, with null values too (``spark.sql.mapKeyDedupPolicy`` LAST_WIN isn't needed)."""
    out = layers[0]
    for layer in layers[1:]:
        out = F.map_concat(_without(out, layer), layer)
    return out


def known(fields: Column, key: str) -> Column:
    v = F.element_at(fields, key)
    return v.isNotNull() & (v != "")


def is_sha256(fields: Column, key: str) -> Column:
    return F.coalesce(F.element_at(fields, key).rlike(r"(?i)\A[a-f0-9]{64}\z"), F.lit(False))


def _number(fields: Column, key: str) -> Column:
    return F.element_at(fields, key).try_cast("double")


def workload_blockers(workload: Column, fields: Column, label: Column, provenance: Column) -> Column:
    """Blockers ``code:label`` of a record, by its workload. ``provenance``: the contract asks for digests."""
    any_of = lambda test, *keys: F.greatest(*(F.coalesce(test(fields, k), F.lit(False)) for k in keys)) if len(keys) > 1 else test(fields, keys[0])
    has = lambda k: F.coalesce(known(fields, k), F.lit(False))
    book, rows, media, translation = (workload == w for w in ("book_reading", "dataset_transform", "media_catalogue", "translation"))
    start, end, count = (_number(fields, k) for k in ("row_start", "row_end", "row_count"))
    expected = end - start + 1
    sidecar = provenance | any_of(known, "duration", "duration_seconds", "duration_ms", "hash", "sha256", "content_hash")
    tagged = provenance | any_of(known, "source_lang", "target_lang")
    digest = F.when(provenance, any_of(is_sha256, "hash", "sha256", "content_hash")).otherwise(any_of(known, "hash", "sha256", "content_hash"))
    at = lambda code: F.concat(F.lit(f"{code}:"), label)
    whole = lambda x: x.cast("long").cast("string")
    return F.array_compact(
        F.array(
            F.when(book & ~(has("chapter") | has("page") | has("page_number") | has("page_start") & has("page_end")), at("book_reading_missing_chapter_or_page_bounds")),
            F.when(rows & ~(has("row_start") & has("row_end")), at("dataset_transform_missing_row_bounds")),
            F.when(rows & (expected != count), F.concat(at("dataset_transform_row_count_mismatch"), F.lit(":expected:"), whole(expected), F.lit(":actual:"), whole(count))),
            F.when(media & sidecar & ~any_of(known, "duration", "duration_seconds", "duration_ms"), at("media_catalogue_missing_duration")),
            F.when(media & sidecar & ~digest, at("media_catalogue_missing_hash")),
            F.when(media & provenance & ~any_of(is_sha256, "sidecar_hash", "sidecar_sha256", "shard_sha256"), at("media_catalogue_missing_sidecar_hash")),
            F.when(translation & tagged & ~has("source_lang"), at("translation_missing_source_lang")),
            F.when(translation & tagged & ~has("target_lang"), at("translation_missing_target_lang")),
            F.when(translation & provenance & ~is_sha256(fields, "source_sha256"), at("translation_missing_source_sha256")),
            F.when(translation & provenance & ~is_sha256(fields, "shard_sha256"), at("translation_missing_shard_sha256")),
        )
    )


#: Processors that a workload's contract allows.
PROCESSORS = {"translation": "model_batch", "media_catalogue": "copy_text"}


def contract_blockers(workload: Column, processor: Column, sources: Column, acceptance: Column) -> Column:
    """Blockers of a job's contract. ``sources``: array of ``id, path, sha256, type``; ``acceptance``: struct
    ``source_lang, target_lang, preserve_placeholders`` or null. Other workloads have none."""
    none = F.array().cast("array<string>")
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    kind = F.when(filled(processor), processor).otherwise("missing")
    label = lambda s, i: F.when(filled(s["id"]), s["id"]).otherwise(F.concat(F.lit("source["), i.cast("string"), F.lit("]")))
    hashed = lambda s: F.coalesce(s["sha256"].rlike(r"(?i)\A[a-f0-9]{64}\z"), F.lit(False))
    each = lambda code, bad: F.array_compact(F.transform(sources, lambda s, i: F.when(bad(s), F.concat(F.lit(f"{code}:"), label(s, i)))))
    unfit = lambda w: F.array_compact(F.array(F.when(kind != PROCESSORS[w], F.concat(F.lit(f"{w}_processor_incompatible:"), kind))))
    wanted = F.array_compact(
        F.array(
            F.when(~filled(acceptance["source_lang"]), F.lit("translation_acceptance_missing_source_lang")),
            F.when(~filled(acceptance["target_lang"]), F.lit("translation_acceptance_missing_target_lang")),
            F.when(~F.coalesce(acceptance["preserve_placeholders"], F.lit(False)), F.lit("translation_placeholder_preservation_required")),
        )
    )
    translation = F.concat(unfit("translation"), F.coalesce(each("translation_source_sha256_required", lambda s: ~hashed(s)), none), F.when(acceptance.isNull(), F.array(F.lit("translation_acceptance_missing"))).otherwise(wanted))
    # All that is wrong with a source stands together.
    of_source = lambda s, i: F.array_compact(F.array(F.when(~filled(s["path"]), F.concat(F.lit("media_catalogue_source_path_required:"), label(s, i))), F.when(~hashed(s), F.concat(F.lit("media_catalogue_source_sha256_required:"), label(s, i))), F.when(~F.coalesce(s["type"].isin("audio", "video"), F.lit(False)), F.concat(F.lit("media_catalogue_source_type_invalid:"), label(s, i)))))
    media = F.concat(unfit("media_catalogue"), F.coalesce(F.flatten(F.transform(sources, of_source)), none))
    return F.when(workload == "translation", translation).when(workload == "media_catalogue", media).otherwise(none)


def job_blockers(jobs: DataFrame, records: DataFrame) -> DataFrame:
    """``job_id, blocker`` of contracts and of all records, manifest and ledger alike.

    ``jobs``: ``job_id, workload, contract, processor, sources, acceptance``; ``contract`` tells whether
    there is one. ``records``: ``job_id, label, fields``.
    """
    own = jobs.where("contract").select("job_id", F.explode(contract_blockers(*map(F.col, ("workload", "processor", "sources", "acceptance")))).alias("blocker"))
    known_jobs = jobs.select("job_id", "workload", "contract")
    return own.unionByName(records.join(known_jobs, "job_id").select("job_id", F.explode(workload_blockers(F.col("workload"), F.col("fields"), F.col("label"), F.col("contract"))).alias("blocker")))


def source_problems(shards: DataFrame, sources: DataFrame) -> DataFrame:
    """``shard_id, reason``: the source is unknown, a file-backed shard has no digest, or digests differ."""
    s = sources.select(F.col("id").alias("source_id"), F.col("sha256").alias("__sha"), F.lit(True).alias("__there"))
    df = shards.join(s, "source_id", "left")
    reason = F.when(F.col("__there").isNull(), "source_missing").when(F.col("inline_text").isNull() & F.col("input_sha256").isNull(), "shard_digest_required").when(F.col("inline_text").isNotNull() & (F.sha2("inline_text", 256) != F.col("input_sha256")), "input_digest_mismatch").when(F.col("source_sha256").isNotNull() & (F.col("source_sha256") != F.col("__sha")), "source_digest_mismatch")
    return df.select("shard_id", reason.alias("reason")).where("reason is not null")


def longform_problems(outputs: DataFrame, key: str, text: str, minimum: int, count: Callable[[Column], Column] = space_word_count) -> DataFrame:
    """``key, words, blocker`` of texts with fewer words than ``minimum``, as ``count`` finds them."""
    df = outputs.withColumn("words", count(F.col(text))).where((F.lit(minimum) > 0) & (F.col("words") < minimum))
    return df.select(key, "words", F.concat(F.lit("minimum_words_not_met:"), F.col("words").cast("string"), F.lit(f":{minimum}")).alias("blocker"))
