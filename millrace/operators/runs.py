"""Batch runs: row generators, transports without a network, plans and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signatures import signed_by

LIVE_CONCURRENCY, LIVE_COST_USD = 20, 5.0
MAX_ITEMS = 10_000


def expand_items(items: DataFrame, key: str, n: int, round_: int = 1) -> DataFrame:
    """Items cycled to ``n`` rows with new ids ``{id}-r{round}-i{number}``. A run has at most
    ``MAX_ITEMS`` items, so that one task may number them; more raise."""
    from pyspark.sql import Window

    if items.limit(MAX_ITEMS + 1).count() > MAX_ITEMS:
        raise ValueError("run_item_limit_exceeded")
    numbered = items.withColumn("__at", F.row_number().over(Window.orderBy(key)) - 1)
    size = items.count()
    wanted = items.sparkSession.range(n).select(F.col("id").alias("__n"), (F.col("id") % size).alias("__at"))
    return wanted.join(numbered, "__at").withColumn("item_id", F.format_string(f"%s-r{round_}-i%d", F.col(key).cast("string"), F.col("__n") + 1)).drop("__at", "__n")


def fails(item_id: Column, ids: list[str] | None = None, every: int | None = None) -> Column:
    """Injected failure: listed, or the trailing digits divide by ``every``."""
    listed = item_id.isin(*ids) if ids else F.lit(False)
    if not every:
        return listed
    digits = F.regexp_extract(item_id, r"(\d+)\z", 1)
    return listed | F.coalesce(F.try_to_number(digits, F.lit("9" * 18)).cast("long") % every == 0, F.lit(False))


def fake_completion(item_id: Column, payload_json: Column) -> Column:
    """A completion that depends on the item alone."""
    return F.concat(F.lit("fake:"), item_id, F.lit(":"), F.substring(F.sha2(payload_json, 256), 1, 12))


def worker_completion(item_id: Column, payload_json: Column, response_format: Column) -> Column:
    """As ``fake_completion``; a JSON object with sorted keys where that is the format asked for."""
    digest = F.substring(F.sha2(payload_json, 256), 1, 12)
    return F.when(response_format == "json_object", F.to_json(F.struct(digest.alias("digest"), F.lit(True).alias("fake"), item_id.alias("item_id")))).otherwise(fake_completion(item_id, payload_json))


def worker_report(items: DataFrame, status: str, elapsed_ms: Column, *keys: str) -> DataFrame:
    """``run_status, completed, failed, items_per_second``: partial with any failure; the number itself without elapsed time."""
    done = F.count_if(F.col(status) == "completed")
    speed = F.when(elapsed_ms > 0, F.round(done / (elapsed_ms / 1000), 2)).otherwise(done.cast("double"))
    return items.groupBy(*keys).agg(F.when(done == F.count(F.lit(1)), "completed").otherwise("partial").alias("run_status"), done.alias("completed"), (F.count(F.lit(1)) - done).alias("failed"), speed.alias("items_per_second"))


def request_json(model: str, messages: Column, temperature: Column, max_tokens: Column) -> Column:
    """The request that a live call would send; absent fields are left out."""
    return F.to_json(F.struct(F.lit(model).alias("model"), messages.alias("messages"), temperature.alias("temperature"), max_tokens.alias("max_tokens")))


def rate(items: Column, ms: Column) -> Column:
    """Items a second, 2 places; null without elapsed time."""
    return F.when(ms > 0, F.round(items / (ms / 1000), 2))


def compare_models(items: DataFrame, models: list[str]) -> DataFrame:
    """Each item under each model; the model list is an argument, so its array is bounded by the call."""
    return items.withColumn("model", F.explode(F.array(*map(F.lit, models))))


def fastest(runs: DataFrame, name: str, speed: str) -> DataFrame:
    return runs.agg(F.max_by(name, F.struct(speed, name)).alias("fastest"), F.bool_and(F.col("status") == "completed").alias("ok"))


# Catalogue of workload templates.
WORKLOADS = ("classification", "extraction", "scoring", "summarisation", "drafting", "second_opinion")


def workload_catalogue(spark: SparkSession, prompts: int = 3) -> DataFrame:
    return spark.range(len(WORKLOADS)).select(F.element_at(F.array(*map(F.lit, WORKLOADS)), (F.col("id") + 1).cast("int")).alias("workload"), F.lit(prompts).alias("prompts"))


def failure_canary(spark: SparkSession) -> DataFrame:
    """Four items of which the second fails."""
    return spark.range(1, 5).select(F.format_string("canary-%d", "id").alias("item_id"), (F.col("id") == 2).alias("fails"))


def closest(words: DataFrame, word: str, commands: list[str]) -> DataFrame:
    """``words`` with the command of least edit distance, ties by name, if the distance is at most 2 or a third of the command's length."""
    near = F.array_min(F.array(*(F.struct(F.levenshtein(F.col(word), F.lit(c)).alias("distance"), F.lit(c).alias("command")) for c in commands)))
    df = words.withColumn("__near", near)
    enough = (F.col(word) != "") & (F.col("__near.distance") <= F.greatest(F.lit(2), F.floor(F.length("__near.command") / 3)))
    return df.withColumn("distance", F.col("__near.distance").cast("long")).withColumn("closest", F.when(enough, F.col("__near.command"))).drop("__near")


RECEIPT = "receipt_id STRING, status STRING, issuer STRING, provider STRING, model STRING, egress_class STRING, payload_sha256 STRING, issued_at TIMESTAMP, expires_at TIMESTAMP, max_items INT, max_concurrency INT, max_cost_usd DOUBLE, daily_cost_cap_usd DOUBLE, signature_base64 STRING"


def plan(run: DataFrame, now: Column, allow_live: bool = False, key_present: bool = False, receipt_json: str | None = None, public_key: str | None = None, provider: str | None = None) -> DataFrame:
    """Adds ``blockers``, ``warnings`` and ``ok`` to runs.

    ``receipt_json`` names the column of signed receipts as JSON text (``RECEIPT``); then ``receipt`` is read
    from it, and the signature is verified with the owner's ``public_key`` (PEM). Without it, ``receipt`` is a
    struct whose signature was verified before.

    Columns: transport (fake, dry-run, live), egress_class, recommended_class,
    canonical_writes, external_side_effects, failure_injection, max_tokens, concurrency,
    cost_cap_usd, reserved_usd, response_format, receipt (struct or null), payload_sha256,
    model, item_count.
    """
    live = F.col("transport") == "live"
    r = lambda f: F.col(f"receipt.{f}")
    has = F.col("receipt").isNotNull()
    keyed, forged = bool((public_key or "").strip()), F.lit(False)
    if receipt_json is not None:
        run = run.withColumn("receipt", F.from_json(receipt_json, RECEIPT))
        if keyed:
            run = run.withColumn("__signed", signed_by(F.when(live, F.col(receipt_json)), public_key))
            forged = ~F.coalesce("__signed", F.lit(False))
    private, advised = F.col("egress_class") != "non_sensitive_bulk", F.col("recommended_class") != "non_sensitive_bulk"
    window = r("expires_at") > r("issued_at")
    late = F.timestamp_micros(F.unix_micros(now) + 5 * 60 * 1_000_000)
    # Names of blockers and warnings.
    rules = [
        (F.col("canonical_writes"), "canonical_writes_must_be_false"),
        (F.col("external_side_effects"), "external_side_effects_must_be_false"),
        (live & F.col("failure_injection"), "failure_injection_not_allowed_for_live"),
        (live & private, "live_requires_non_sensitive_bulk_egress"),
        (live & advised, "privacy_classifier_blocks_live"),
        (live & ~F.lit(allow_live), "live_call_not_enabled_by_caller"),
        (live & ~has, "signed_approval_receipt_required_for_live"),
        (live & has & F.lit(receipt_json is not None and not keyed), "approval_receipt_public_key_not_configured"),
        (live & has & ~(r("status").eqNullSafe(F.lit("approved")) & r("issuer").eqNullSafe(F.lit("owner"))), "approval_receipt_not_owner_approved"),
        (live & has & ~F.coalesce(window, F.lit(False)), "approval_receipt_time_window_invalid"),
        (live & has & window & (r("issued_at") > late), "approval_receipt_not_yet_valid"),
        (live & has & window & (r("expires_at") <= now), "approval_receipt_expired"),
        (live & has & (F.lit(False) if provider is None else ~r("provider").eqNullSafe(F.lit(provider))), "approval_receipt_provider_mismatch"),
        (live & has & ~r("model").eqNullSafe(F.col("model")), "approval_receipt_model_mismatch"),
        (live & has & (~r("egress_class").eqNullSafe(F.col("egress_class")) | private), "approval_receipt_egress_mismatch"),
        (live & has & ~r("payload_sha256").eqNullSafe(F.col("payload_sha256")), "approval_receipt_payload_digest_mismatch"),
        (live & has & (F.col("item_count") > r("max_items")), "approval_receipt_item_cap_exceeded"),
        (live & has & (F.col("concurrency") > r("max_concurrency")), "approval_receipt_concurrency_cap_exceeded"),
        (live & has & (F.col("cost_cap_usd") > r("max_cost_usd")), "approval_receipt_run_cost_cap_exceeded"),
        (live & has & (r("max_cost_usd") > r("daily_cost_cap_usd")), "approval_receipt_daily_cost_cap_invalid"),
        (live & has & forged, "approval_receipt_signature_invalid"),
        (live & F.col("max_tokens").isNull(), "max_tokens_required_for_live"),
        (live & has & (F.col("reserved_usd") > F.col("cost_cap_usd")), "worst_case_reservation_exceeds_manifest_cost_cap"),
        (live & has & (F.col("reserved_usd") > r("max_cost_usd")), "worst_case_reservation_exceeds_receipt_cost_cap"),
        (live & (F.col("concurrency") > LIVE_CONCURRENCY), f"live_concurrency_cap_exceeded_{LIVE_CONCURRENCY}"),
        (live & (F.col("cost_cap_usd") > LIVE_COST_USD), f"live_cost_cap_exceeded_{LIVE_COST_USD:g}"),
        (live & ~F.lit(key_present), "api_key_not_present"),
    ]
    notes = [
        (F.col("transport") == "dry-run", F.lit("request_shape_only_no_network_call")),
        (~live & F.col("failure_injection"), F.lit("failure_injection_enabled_for_local_transport")),
        (~live & private, F.lit("non_external_transport_selected_for_sensitive_or_private_egress")),
        (advised, F.concat(F.lit("privacy_classifier_recommends_"), F.col("recommended_class"))),
        (F.col("response_format") == "json_object", F.lit("json_output_requires_prompt_instruction_to_return_json")),
    ]
    df = run.withColumn("blockers", F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in rules)))).withColumn("warnings", F.array_compact(F.array(*(F.when(c, n) for c, n in notes))))
    return df.withColumn("ok", F.size("blockers") == 0).drop("__signed")


def workload_items(prompts: DataFrame, workload: str, n: int | None = None) -> DataFrame:
    """``item_id, prompt, workload, prompt_index``: a workload's prompts cycled to ``n`` items (as many as there are, six at least).

    ``prompts``: ``workload, prompt_index, prompt``, prompts numbered from 0.
    """
    own = prompts.where(F.col("workload") == workload)
    size = own.count()
    if not size:
        raise ValueError("invalid_workload")
    wanted = prompts.sparkSession.range(max(size, 6) if n is None else n).select("id", (F.col("id") % size).cast("int").alias("prompt_index"))
    df = wanted.join(own.withColumn("prompt_index", F.col("prompt_index").cast("int")), "prompt_index")
    return df.select(F.format_string("%s-%d", "workload", F.col("id") + 1).alias("item_id"), "prompt", "workload", "prompt_index")


def agent_canary(spark: SparkSession) -> DataFrame:
    """Three items that exercise planning, safety and proof."""
    items = [("canary-plan", "Name readiness, missing inputs and next action."), ("canary-safety", "Name side effects that are blocked."), ("canary-proof", "Name the proofs to inspect after a run.")]
    return spark.createDataFrame(items, "item_id string, prompt string")


def queued(items: DataFrame) -> DataFrame:
    return items.where("status = 'queued'")


def split_live(jobs: DataFrame, live: Column) -> tuple[DataFrame, DataFrame]:
    """Jobs that can run unattended, and those deferred because they need live calls."""
    needs = F.coalesce(live, F.lit(False))
    return jobs.where(~needs), jobs.where(needs)


def transport(name: str, model: str = "", allow_live: bool = False):
    """The completion of a transport: a function of item id and payload JSON. Live calls aren't made here."""
    if name == "fake":
        return fake_completion
    if name == "dry-run":
        return lambda item_id, payload_json: payload_json
    raise ValueError("live_transport_not_available" if allow_live or name != "live" else "live_call_not_enabled_by_caller")


def newest_runs(runs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """``run_id, created_at, status, counts``: the newest ``n`` runs with their items by status."""
    newest = runs.orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(n)
    counts = items.join(newest.select("run_id"), "run_id", "left_semi").groupBy("run_id", F.col("status").alias("s")).count()
    counts = counts.groupBy("run_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("s", "count")))).alias("counts"))
    return newest.select("run_id", "created_at", "status").join(counts, "run_id", "left")
