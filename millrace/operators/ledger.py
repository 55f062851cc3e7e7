"""Shard ledgers: states, selection, batches, overlay, recovery and proofs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged
from .prefix import running_totals
from .review import processor_matches

# States of shards and jobs.
SHARD_STATES = ("pending", "leased", "running", "succeeded", "failed", "quarantined", "cancelled", "invalidated")
OPEN_STATES = ("pending", "leased", "running")
LEASE_MINUTES, BACKOFF_SECONDS = 15, 30


def status_counts(rows: DataFrame, key: str, status: str) -> DataFrame:
    """Sparse: a map of the states that occur."""
    return rows.groupBy(key, status).count().groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(status, "count")))).alias("counts"), F.sum("count").alias("item_count"))


def dense_counts(rows: DataFrame, status: str, states: tuple[str, ...], *keys: str) -> DataFrame:
    """Dense: a column for each state, zeros included."""
    return rows.groupBy(*keys).agg(*(F.count_if(F.col(status) == s).alias(s) for s in states), F.count(F.lit(1)).alias("total"))


def retry_due(status: Column, next_retry_at: Column, now: Column) -> Column:
    return ~F.coalesce((status == "failed") & (next_retry_at > now), F.lit(False))


def next_retry(attempts: Column, max_attempts: Column, now: Column) -> Column:
    """Linear backoff; null once attempts are used up."""
    return F.when(attempts < max_attempts, F.timestamp_micros(F.unix_micros(now) + BACKOFF_SECONDS * 1_000_000 * F.greatest(F.lit(1), attempts)))


def run_status(rows: DataFrame, status: str, *keys: str) -> DataFrame:
    """cancelled before failed before completed."""
    some = lambda s: F.coalesce(F.bool_or(F.col(status) == s), F.lit(False))
    return rows.groupBy(*keys).agg(F.when(some("cancelled"), "cancelled").when(some("failed"), "failed").otherwise("completed").alias("run_status"))


def job_status(shards: DataFrame, status: str, attempts: str, max_attempts: int, *keys: str) -> DataFrame:
    """failed before running before completed: one shard that is quarantined or out of attempts decides."""
    s, a = F.col(status), F.col(attempts)
    lost = F.bool_or((s == "quarantined") | (s == "failed") & (a >= max_attempts))
    unfinished = F.bool_or(s.isin(*OPEN_STATES) | (s == "failed") & (a < max_attempts))
    done, total = F.count_if(s == "succeeded"), F.count(F.lit(1))
    return shards.groupBy(*keys).agg(F.when(lost, "failed").when(unfinished, "running").otherwise("completed").alias("job_status"), done.alias("completed"), total.alias("total"))


def select_shards(ledger: DataFrame, key: str, position: str, cap: int, max_attempts: int, now: Column, same_pass_quarantine: bool = True) -> DataFrame:
    """Adds ``action``: run (at most ``cap`` of a job, in ledger order), quarantine, wait or skip."""
    s = F.col("status")
    spent = (s == "failed") & (F.col("attempts") >= max_attempts)
    can = s.isin(*OPEN_STATES) | (s == "failed") & ~spent & retry_due(s, F.col("next_retry_at"), now)
    df = ledger.withColumn("__can", F.coalesce(can, F.lit(False)))
    df, nth = running_totals(df, [F.col(position)], {"__nth": F.col("__can").cast("int")}, [F.col(key)]), F.col("__nth")
    df = df.withColumn("action", F.when(spent, "quarantine" if same_pass_quarantine else "skip").when(F.col("__can") & (nth <= cap), "run").when(F.col("__can") | (s == "failed"), "wait").otherwise("skip"))
    return df.drop("__can", "__nth")


def batch_prefix(shards: DataFrame, key: str, position: str, size: str, cap_bytes: int, cap_count: int, cap_item: int | None = None) -> DataFrame:
    """Adds ``placed``: batch, quarantined (too large for any batch, met before the batch is full) or left.

    Exact for the first batch: the scan stops at the first shard that would overflow it.
    """
    fits = F.col(size) <= (cap_bytes if cap_item is None else cap_item)
    df = running_totals(shards, [F.col(position)], {"__bytes": F.when(fits, F.col(size)), "__count": fits.cast("int")}, [F.col(key)])
    over = (F.col("__bytes") > cap_bytes) | (F.col("__count") > cap_count)
    return df.withColumn("placed", F.when(over, "left").when(fits, "batch").otherwise("quarantined")).drop("__bytes", "__count")


#: Rows of a job that one task looks at together, at least.
PACK_BLOCK = 10_000


def pack_batches(shards: DataFrame, key: str, position: str, size: str, cap_bytes: int, cap_count: int) -> DataFrame:
    """``key, position, size, batch`` for all batches of each job; ``batch`` is null for shards too large for any.

    Where a batch ends depends on where it began, yet no job is folded in one task. With
    running sums each shard knows where the next batch would begin if one began at it.
    Shards lie in blocks of at least ``PACK_BLOCK``; a batch reaches into the next block at
    most, so what matters of a block is where a batch that enters it leaves it. Those
    jumps are doubled: 1, 2, 4, ... blocks at once, until each block's entry is known. Each
    block then follows its own pointers from there.
    """
    types = dict(shards.dtypes)
    rows = shards.select(key, position, size)
    fits = F.coalesce(F.col(size) <= cap_bytes, F.lit(False))
    numbered = running_totals(rows.where(fits), [F.col(position)], {"__n": F.lit(1), "__s": F.col(size)}, [F.col(key)])
    block = max(PACK_BLOCK, 4 * (cap_count + 1))
    numbered = staged(numbered.withColumn("__block", F.floor(F.col("__n") / block)).withColumn("__p", F.col("__s") - F.col(size)), "pack-numbered")

    # each block with the first shards of the next
    seen = numbered.select("*", F.explode(F.when((F.col("__n") % block <= cap_count) & (F.col("__block") > 0), F.array("__block", F.col("__block") - 1)).otherwise(F.array("__block"))).alias("__in"))
    within = Window.partitionBy(key, "__in").orderBy("__p").rangeBetween(0, cap_bytes)
    last, filled = F.max("__n").over(within), F.max("__s").over(within)
    after = F.least(F.when(filled <= F.col("__p") + cap_bytes, last + 1).otherwise(last), F.col("__n") + cap_count)
    pointers = staged(seen.withColumn("__next", after).where("__in = __block").drop("__in"), "pack-pointers")

    entries = pointers.where("__n = 1").select(key, "__n")
    if (numbered.agg(F.max("__n")).first()[0] or 0) >= block:
        entries = _entries(pointers, entries, key, types[key], block, cap_count)
    first = entries.select(F.col(key).alias("__k"), F.floor(F.col("__n") / block).alias("__b"), F.col("__n").alias("__entry"))
    known = pointers.join(first, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__block") == F.col("__b")), "left").drop("__k", "__b")

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of one block after another; three numbers of state."""
        block_of, number, at = None, -1, None
        for pdf in batches:
            out = []
            for g, b, n, jump, entry in zip(pdf["__g"], pdf["__block"], pdf["__n"], pdf["__next"], pdf["__entry"], strict=True):
                if (g, b) != block_of:
                    block_of, number, at = (g, b), -1, entry
                if n == at:
                    number, at = number + 1, jump
                out.append(number)
            yield pdf[[key, position, size, "__block"]].assign(__local=out)

    rows_of = known.withColumn("__g", F.xxhash64(key)).repartition("__g", "__block").sortWithinPartitions("__g", key, "__block", "__n")
    local = staged(rows_of.mapInPandas(follow, f"{key} {types[key]}, {position} {types[position]}, {size} {types[size]}, __block long, __local long"), "pack-local")
    blocks = local.groupBy(key, "__block").agg((F.max("__local") + 1).alias("__begun"))
    upto = running_totals(blocks, [F.col("__block")], {"__upto": F.col("__begun")}, [F.col(key)]).select(F.col(key).alias("__k"), F.col("__block").alias("__b"), (F.col("__upto") - F.col("__begun")).alias("__before"))
    packed = local.join(upto, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__block") == F.col("__b"))).select(key, position, size, (F.col("__before") + F.col("__local")).alias("batch"))
    return packed.unionByName(rows.where(~fits).withColumn("batch", F.lit(None).cast("long")))


def _entries(pointers: DataFrame, entries: DataFrame, key: str, key_type: str, block: int, cap_count: int) -> DataFrame:
    """Where the first batch of each block begins, for all jobs: jumps from block to block, doubled until none lands."""

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__n")
        n, jump = pdf["__n"].to_numpy(), pdf["__next"].to_numpy()
        out = jump.copy()
        for i in range(len(n) - 1, -1, -1):
            if jump[i] <= n[-1]:
                out[i] = out[jump[i] - n[0]]
        entered = (n % block <= cap_count) | (n == 1)
        return pd.DataFrame({key: pdf[key][entered], "__n": n[entered], "__next": out[entered]})

    jumps = staged(pointers.select(key, "__block", "__n", "__next").groupBy(key, "__block").applyInPandas(leave, f"{key} {key_type}, __n long, __next long"), "pack-jumps")
    there = jumps.select(F.col(key).alias("__k"), F.col("__n").alias("__at"), F.col("__next").alias("__to"))
    entries = staged(entries, "pack-entries")
    while True:
        landed = entries.join(jumps.select(F.col(key).alias("__k"), F.col("__n").alias("__at"), F.col("__next").alias("__to")), F.col(key).eqNullSafe(F.col("__k")) & (F.col("__n") == F.col("__at"))).select(key, F.col("__to").alias("__n"))
        landed = staged(landed.join(there, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__n") == F.col("__at")), "left_semi"), "pack-landed")
        if landed.isEmpty():
            return entries
        entries = staged(entries.union(landed).distinct(), "pack-entries")
        second = jumps.select(F.col(key).alias("__k"), F.col("__n").alias("__at"), F.col("__next").alias("__to"))
        jumps = staged(jumps.join(second, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__next") == F.col("__at"))).select(key, "__n", F.col("__to").alias("__next")), "pack-jumps")


def fits_one_batch(shards: DataFrame, size: str, cap_bytes: int, cap_count: int, *keys: str) -> DataFrame:
    return shards.groupBy(*keys).agg(((F.count(F.lit(1)) <= cap_count) & (F.max(size) <= cap_bytes) & (F.sum(size) <= cap_bytes)).alias("fits"))


def overlay(ledger: DataFrame, checkpoints: DataFrame, *keys: str) -> DataFrame:
    """Each ledger row replaced as a whole by its checkpoint, where there is one. A checkpoint
    without a row, or a second one for a row, raises."""
    bad = foreign_checkpoints(ledger, checkpoints, *keys).limit(1).collect()
    if bad:
        raise ValueError(bad[0].reason)
    rest = [c for c in ledger.columns if c not in keys]
    new = checkpoints.select(*keys, F.struct(*rest).alias("__new"))
    df = ledger.select(*keys, F.struct(*rest).alias("__old")).join(new, list(keys), "left")
    return df.select(*keys, F.coalesce("__new", "__old").alias("s")).select(*keys, "s.*").select(*ledger.columns)


def foreign_checkpoints(ledger: DataFrame, checkpoints: DataFrame, *keys: str) -> DataFrame:
    """Checkpoints without a ledger row, or more than one for a row: the overlay refuses them."""
    doubled = checkpoints.groupBy(*keys).count().where("count > 1").select(*keys, F.lit("checkpoint_repeated").alias("reason"))
    return checkpoints.join(ledger, list(keys), "left_anti").select(*keys, F.lit("checkpoint_unknown").alias("reason")).unionByName(doubled)


def apply_results(shards: DataFrame, results: DataFrame, key: str, now: Column | None = None, max_attempts: int = 3) -> DataFrame:
    """Batch results onto the shards that the batch holds, which are the running ones.

    Completed items commit. A miss or another state fails with its error or a default, and a
    time for the next attempt while there are any left. All other shards stay as they are.
    """
    r = results.select(key, F.struct("status", "error", "output").alias("__r"))
    df = shards.join(r, key, "left")
    mine = F.coalesce(F.col("status") == "running", F.lit(False))
    ok = mine & F.coalesce(F.col("__r.status") == "completed", F.lit(False))
    kept = lambda c, kind: F.col(c) if c in shards.columns else F.lit(None).cast(kind)
    error = F.coalesce("__r.error", F.lit("processor_result_missing_or_failed"))
    new = {"status": F.when(ok, "succeeded").when(mine, "failed").otherwise(F.col("status")), "output_text": F.when(ok, F.col("__r.output")).when(~mine, kept("output_text", "string")), "last_error": F.when(mine & ~ok, error).when(~mine, kept("last_error", "string"))}
    if now is not None:
        new["next_retry_at"] = F.when(mine & ~ok, next_retry(F.col("attempts"), F.lit(max_attempts), now)).when(~mine, kept("next_retry_at", "timestamp"))
    return df.withColumns(new).drop("__r")


def latest_state(events: DataFrame, key: str, ts: str, order: str, state: str) -> DataFrame:
    """The state that each shard's last event leaves it in, with attempts and the first start."""
    last = F.max_by(state, F.struct(ts, order))
    started = F.col(state).isin("leased", "running")
    return events.groupBy(key).agg(last.alias("state"), F.count_if(F.col(state) == "running").alias("attempts"), F.min(F.when(started, F.col(ts))).alias("first_started_at"), F.count(F.lit(1)).alias("events"))


def cancel(shards: DataFrame) -> DataFrame:
    return shards.withColumn("status", F.when(F.col("status").isin(*OPEN_STATES), "cancelled").otherwise(F.col("status")))


def coverage(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """``reason, key``: on one side only, or repeated on a side."""
    a, b = left.groupBy(key).agg(F.count(F.lit(1)).alias("n")), right.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    parts = [a.join(b, key, "left_anti").select(F.lit(f"only_in_{names[0]}").alias("reason"), key), b.join(a, key, "left_anti").select(F.lit(f"only_in_{names[1]}").alias("reason"), key)]
    parts += [x.where("n > 1").select(F.lit(f"repeated_in_{n}").alias("reason"), key) for x, n in zip((a, b), names, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


PROOF_SCHEMA_VERSION = "millrace.shard-proof.v1"


def proof_mismatches(ledger: DataFrame, proofs: DataFrame, manifest: DataFrame, allowed_versions: list[str]) -> DataFrame:
    """``shard_id, reason`` for each way in which a succeeded shard's proof disagrees with ledger and manifest, or is missing.

    ``manifest``: ``shard_id, expected_sha256``.
    """
    p = proofs.select("shard_id", F.struct(*[c for c in proofs.columns if c != "shard_id"]).alias("p"))
    df = ledger.where("status = 'succeeded'").join(p, "shard_id", "left").join(manifest.withColumn("__there", F.lit(True)), "shard_id", "left")
    differs = lambda a, b: ~F.col(f"p.{a}").eqNullSafe(F.col(b))
    proved = F.col("p").isNotNull()
    there = F.col("__there").isNotNull() & proved
    checks = [
        (~proved, "missing"),
        (proved & F.col("__there").isNull(), "manifest_shard_missing"),
        (there & ~F.col("p.schema_version").eqNullSafe(F.lit(PROOF_SCHEMA_VERSION)), "schema_mismatch"),
        (there & differs("job_id", "job_id"), "job_mismatch"),
        (there & differs("source_id", "source_id"), "source_mismatch"),
        (there & differs("processor_version", "processor_version"), "processor_mismatch"),
        (there & ~F.coalesce(F.col("p.processor_version").isin(*allowed_versions), F.lit(False)), "processor_manifest_mismatch"),
        (there & (F.col("p.input_sha256").isNull() | differs("input_sha256", "input_sha256") | differs("input_sha256", "expected_sha256")), "input_hash_mismatch"),
        (there & (F.col("p.output_sha256").isNull() | differs("output_sha256", "output_sha256")), "output_hash_mismatch"),
        (there & differs("committed_at", "committed_at"), "commit_mismatch"),
    ]
    return df.select("shard_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(f"proof_{n}")) for c, n in checks)))).alias("reason"))


def missing_artifacts(ledger: DataFrame, outputs: DataFrame, proofs: DataFrame) -> DataFrame:
    """``shard_id, reason``: succeeded shards without a stored output, or without a stored proof."""
    done = ledger.where("status = 'succeeded'").select("shard_id")
    missing = lambda stored, reason: done.join(stored.select("shard_id"), "shard_id", "left_anti").select("shard_id", F.lit(reason).alias("reason"))
    return missing(outputs, "missing_output").unionByName(missing(proofs, "missing_proof"))


def fail_unlisted(ledger: DataFrame, manifest: DataFrame, now: Column, max_attempts: int) -> DataFrame:
    """Shards that would run but aren't in the manifest fail with ``shard_missing_from_manifest`` and a retry time."""
    there = manifest.select("shard_id").distinct().withColumn("__there", F.lit(True))
    runnable = F.col("status").isin(*OPEN_STATES) | (F.col("status") == "failed") & retry_due(F.col("status"), F.col("next_retry_at"), now)
    df = ledger.join(there, "shard_id", "left").withColumn("__lost", F.col("__there").isNull() & F.coalesce(runnable, F.lit(False)))
    before = F.col("last_error") if "last_error" in ledger.columns else F.lit(None).cast("string")
    df = df.withColumn("last_error", F.when(F.col("__lost"), "shard_missing_from_manifest").otherwise(before)).withColumn("status", F.when(F.col("__lost"), "failed").otherwise(F.col("status")))
    return df.withColumn("next_retry_at", F.when(F.col("__lost"), next_retry(F.col("attempts"), F.lit(max_attempts), now)).otherwise(F.col("next_retry_at"))).drop("__there", "__lost")


def event_log(before: DataFrame, after: DataFrame, now: Column, *keys: str) -> DataFrame:
    """``keys, ts, type, payload``: a line of the event log for each row whose status has changed, as ``shard_<status>``."""
    old = before.select(*keys, F.col("status").alias("__old"))
    changed = after.join(old, list(keys)).where(~F.col("__old").eqNullSafe(F.col("status")))
    payload = F.to_json(F.struct(*keys, "attempts"))
    return changed.select(*keys, now.alias("ts"), F.concat(F.lit("shard_"), F.col("status")).alias("type"), payload.alias("payload"))


def checkpoints(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """The rows of ``after`` that differ from ``before``: what a crash must not lose. ``overlay`` puts them back."""
    rest = [c for c in after.columns if c not in keys]
    old = before.select(*keys, F.struct(*rest).alias("__old"))
    return after.join(old, list(keys), "left").where(~F.struct(*rest).eqNullSafe(F.col("__old"))).select(*after.columns)


#: What a shard that is done no longer has.
CLEARED = ("last_error", "error", "last_error_type", "next_retry_at", "lease_owner", "lease_expires_at")


def recover(ledger: DataFrame, outputs: DataFrame, proofs: DataFrame, manifest: DataFrame, processor: str, engine: str = "auto") -> DataFrame:
    """Shards that aren't settled and have a stored output and a whole proof of it become succeeded; ``recovered`` tells which.

    ``ledger``: ``job_id, shard_id, source_id, status, ...``; ``outputs``: ``shard_id, output``; ``proofs``:
    ``shard_id, proof`` (JSON text); ``manifest``: ``shard_id, input_sha256``, the digest that the shard's input
    has now. A proof that was cut off while it was written is passed over. Any other that
    contradicts ledger, manifest, processor or output raises when the result is read, as does a
    second output or proof of a shard: no such shard is skipped in silence.
    """
    one = lambda rows, value, name: rows.groupBy("shard_id").agg(F.min(value).alias(name), F.count(F.lit(1)).alias(f"{name}_n"))
    # Only the digest of an output travels.
    out = one(outputs.select("shard_id", F.sha2("output", 256).alias("d")), "d", "__sha")
    prf = one(proofs, "proof", "__proof")
    listed = one(manifest, "input_sha256", "__expected").withColumn("__listed", F.lit(True)).drop("__expected_n")
    df = ledger.join(out, "shard_id", "left").join(prf, "shard_id", "left").join(listed, "shard_id", "left")
    stored = F.col("__sha_n").isNotNull() & F.col("__proof_n").isNotNull() & F.coalesce(F.col("status").isin(*OPEN_STATES, "failed"), F.lit(False))
    fields = "schema_version STRING, job_id STRING, shard_id STRING, source_id STRING, input_sha256 STRING, output_sha256 STRING, processor_version STRING, processor_run_id STRING, committed_at STRING, translation_memory_hit BOOLEAN"
    df = df.withColumn("__p", F.when(stored, F.from_json("__proof", fields + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"})))
    p = lambda f: F.col(f"__p.{f}")
    whole = p("_bad").isNull() & F.col("__p").isNotNull() & F.coalesce(F.ltrim("__proof").startswith("{"), F.lit(False))
    quoted = lambda c: F.to_json(F.array(c.cast("string")))
    begins = F.concat(F.lit('{\n  "schema_version": "' + PROOF_SCHEMA_VERSION + '",\n'), *(x for f in ("job_id", "shard_id", "source_id") for x in (F.lit(f'  "{f}": '), F.substring(quoted(F.col(f)), 2, 1 << 20).substr(F.lit(1), F.length(quoted(F.col(f))) - 2), F.lit(",\n"))))
    cut = ~whole & interrupted_proof(F.col("__proof"), F.rtrim(begins, F.lit("\n")))
    digest = lambda c: F.coalesce(c.rlike(r"\A[a-f0-9]{64}\z"), F.lit(False))
    same = lambda f, c: p(f).eqNullSafe(c.cast("string"))
    # What is wrong, in the order in which it is looked for.
    problems = [
        (F.col("__sha_n") > 1, "output_repeated"),
        (F.col("__proof_n") > 1, "proof_repeated"),
        (F.octet_length("__proof") > 1 << 20, "proof_too_large"),
        (~whole & ~F.coalesce(cut, F.lit(False)), "proof_not_json"),
        (whole & F.col("__listed").isNull(), "no_manifest_shard"),
        (whole & ~processor_matches(F.lit(processor), F.lit(engine), p("processor_version"), p("translation_memory_hit")), "processor_mismatch"),
        (whole & ~(same("schema_version", F.lit(PROOF_SCHEMA_VERSION)) & same("job_id", F.col("job_id")) & same("shard_id", F.col("shard_id")) & same("source_id", F.col("source_id"))), "identity_mismatch"),
        (whole & (p("input_sha256").isNull() | ~same("input_sha256", F.col("__expected"))), "input_mismatch"),
        (whole & (~digest(p("output_sha256")) | ~same("output_sha256", F.col("__sha")) | p("committed_at").try_cast("timestamp").isNull()), "output_mismatch"),
    ]
    problem = F.coalesce(*(F.when(c, F.lit(n)) for c, n in problems))
    said = F.concat(F.lit("corpus_shard_proof_invalid:"), problem, F.lit(":"), F.col("shard_id").cast("string"))
    # The check is a value that the new status depends on, so no plan can leave it out.
    good = F.when(~stored, F.lit(False)).when(problem.isNotNull(), F.raise_error(said).cast("boolean")).otherwise(whole)
    df = df.withColumn("recovered", good)
    taken = {"input_sha256": p("input_sha256"), "output_sha256": p("output_sha256"), "processor_version": p("processor_version"), "processor_run_id": F.coalesce(p("processor_run_id"), F.col("processor_run_id") if "processor_run_id" in ledger.columns else F.lit(None)), "committed_at": p("committed_at"), "finished_at": p("committed_at")}
    types = dict(ledger.dtypes)
    new = {"status": F.when(F.col("recovered"), "succeeded").otherwise(F.col("status"))}
    new |= {c: F.when(F.col("recovered"), v.cast(types.get(c, "string"))).otherwise(F.col(c) if c in types else F.lit(None)) for c, v in taken.items()}
    new |= {c: F.when(~F.col("recovered"), F.col(c)) for c in CLEARED if c in types}
    return df.withColumns(new).select(*ledger.columns, *(c for c in taken if c not in ledger.columns), "recovered")


def interrupted_proof(content: Column, expected: Column) -> Column:
    """Whether stored bytes are a cut-off form of the expected proof, or begin with it."""
    return (F.octet_length(content) <= 1 << 20) & (expected.startswith(content) | content.startswith(expected))


def fair_selection(jobs: DataFrame, key: str, cursor: str | None, n: int) -> DataFrame:
    """The next ``n`` jobs after the cursor, round the sorted list."""
    behind = F.lit(False) if cursor is None else F.col(key) <= cursor
    return jobs.orderBy(behind, key).limit(n)
