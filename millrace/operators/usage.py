"""Usage, cost and budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import utf16_length
from .prefix import running_totals

# USD for a million tokens (cache hit, cache miss, output).
CHAT_RATES = {"flash": (0.0028, 0.14, 0.28), "pro": (0.003625, 0.435, 0.87)}
MESSAGE_OVERHEAD_BYTES = 64


def item_characters(prompt: Column, messages: Column, metadata: Column | None = None) -> Column:
    """UTF-16 units of the prompt, of ``role:content`` lines and of the metadata's JSON."""
    lines = F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    size = lambda c: F.coalesce(utf16_length(c), F.lit(0))
    return size(prompt) + size(lines) + (size(F.to_json(metadata)) if metadata is not None else F.lit(0))


def usage(items: DataFrame, characters: str, max_tokens: int | None, *keys: str) -> DataFrame:
    """Characters, estimated prompt tokens (four characters each) and completion tokens (null without a cap)."""
    total = F.sum(characters).cast("long")
    out = [F.count(F.lit(1)).alias("item_count"), total.alias("characters"), F.ceil(total / 4).cast("long").alias("prompt_tokens"), (F.count(F.lit(1)) * F.lit(max_tokens).cast("long")).alias("completion_tokens")]
    return items.groupBy(*keys).agg(*out)


def reservation(messages: Column, max_tokens: Column, input_rate: float, output_rate: float) -> Column:
    """Worst-case cost of an item: UTF-8 bytes of its messages' JSON and an overhead for each, and all completion tokens; rounded to 8 places."""
    tokens = F.octet_length(F.to_json(messages)) + MESSAGE_OVERHEAD_BYTES * F.size(messages)
    return F.round(tokens * F.lit(input_rate) / 1e6 + max_tokens * F.lit(output_rate) / 1e6, 8)


def reservations(items: DataFrame, cost: str, *keys: str) -> DataFrame:
    return items.groupBy(*keys).agg(F.count(F.lit(1)).alias("items"), F.round(F.sum(cost), 8).alias("reserved_usd"))


def observed_cost(prompt_tokens: Column, completion_tokens: Column, input_rate: float, output_rate: float) -> Column:
    fine = (prompt_tokens >= 0) & (completion_tokens >= 0)
    return F.when(fine, F.round(prompt_tokens * F.lit(input_rate) / 1e6 + completion_tokens * F.lit(output_rate) / 1e6, 8))


def chat_cost(model: Column, cached: Column, fresh: Column, output: Column, prompt: Column | None = None) -> Column:
    """Cost of a turn. Models other than ``pro`` have the rates of ``flash``; without usage
    (null output) it is 0; fresh tokens that aren't given are those of ``prompt`` that weren't cached."""
    hits = F.coalesce(cached, F.lit(0))
    misses = fresh if prompt is None else F.coalesce(fresh, F.greatest(F.lit(0), prompt - hits))
    of = lambda name: (hits * CHAT_RATES[name][0] + F.coalesce(misses, F.lit(0)) * CHAT_RATES[name][1] + output * CHAT_RATES[name][2]) / 1e6
    return F.round(F.when(output.isNull(), 0.0).when(model == "pro", of("pro")).otherwise(of("flash")), 8)


def cost_ledger(items: DataFrame, prompt: str, completion: str, cost: str, *keys: str) -> DataFrame:
    """Token sums count null as 0; the cost is null where no item has one; the charge where one item lacks it."""
    total = F.col(prompt) + F.col(completion)
    return items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("item_count"),
        F.count(total).alias("items_with_usage"),
        F.coalesce(F.sum(prompt), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum(completion), F.lit(0)).alias("completion_tokens"),
        F.coalesce(F.sum(total), F.lit(0)).alias("total_tokens"),
        F.round(F.sum(cost), 6).alias("cost_usd"),
        F.round(F.when(F.count(cost) == F.count(F.lit(1)), F.sum(cost)), 6).alias("charged_usd"),
    )


#: Amounts are added as whole hundred-millionths, so that no order of adding changes a sum.
UNITS = 100_000_000


def rolling_spend(events: DataFrame, key: str, ts: str, amount: Column, hours: int = 24) -> DataFrame:
    """``spend`` of the ``hours`` up to and with each event, by key; an event without a time has none.

    An amount enters the sum at its time and leaves it again after ``hours``, so the sum of all
    entries and exits so far is what the window holds; a busy key may lie in many tasks.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    sums = events.select(F.col(key).alias("__k"), at.alias("__at"), F.round(amount * UNITS).cast("long").alias("__x")).where("__at is not null").groupBy("__k", "__at").agg(F.coalesce(F.sum("__x"), F.lit(0)).alias("__x"))
    moves = sums.select("__k", F.explode(F.array(F.struct(F.col("__at").alias("__t"), F.lit(True).alias("__in"), F.col("__x")), F.struct((F.col("__at") + (hours * 3_600_000_000 + 1)).alias("__t"), F.lit(False).alias("__in"), (-F.col("__x")).alias("__x")))).alias("m")).select("__k", "m.*")
    spent = running_totals(moves, [F.col("__t"), F.col("__in")], {"__spend": F.col("__x")}, [F.col("__k")]).where("__in")
    df = events.withColumn("__at", at).join(spent.select("__k", "__t", "__spend"), F.col(key).eqNullSafe(F.col("__k")) & (F.col("__at") == F.col("__t")), "left")
    return df.select(*events.columns, (F.col("__spend") / UNITS).alias("spend"))


def settle(reserved: Column, charged: Column) -> Column:
    return F.when(charged.isNull(), "retained_conservative").when(charged > reserved + 1e-9, "overrun").otherwise("reconciled")


def admit(requests: DataFrame, key: str, ts: str, amount: str, cap: float, hours: int = 24, receipt: str | None = None) -> DataFrame:
    """Requests in order, each with ``decision``: admitted, cap_exceeded or replayed.

    A refused request spends nothing, so each decision depends on the ones before: an
    ordered fold for each key. A key's rows stream through one task; only the window's
    admitted requests and the receipts seen are in memory.
    """
    import pandas as pd

    schema = f"{key} {dict(requests.dtypes)[key]}, {ts} timestamp, {amount} double, receipt string, decision string, committed double"
    rows = requests.select(key, F.col(ts).cast("timestamp").alias(ts), F.col(amount).cast("double").alias(amount), (F.col(receipt).cast("string") if receipt else F.lit(None).cast("string")).alias("receipt"))

    def fold(batches):
        from collections import deque

        current, window, total, seen, begun = None, deque(), 0.0, set(), False
        for batch in batches:
            decisions, committed = [], []
            for k, t, x, r in zip(batch[key], batch[ts], batch[amount], batch["receipt"], strict=True):
                if not begun or k != current:
                    current, window, total, seen, begun = k, deque(), 0.0, set(), True
                while window and window[0][0] < t - pd.Timedelta(hours=hours):
                    window.popleft()
                    total = sum(y for _, y in window)
                if r is not None and r in seen:
                    decisions.append("replayed")
                elif total + x > cap + 1e-9:
                    decisions.append("cap_exceeded")
                else:
                    decisions.append("admitted")
                    window.append((t, x))
                    total += x
                    if r is not None:
                        seen.add(r)
                committed.append(round(total, 8))
            yield batch.assign(decision=decisions, committed=committed)

    return rows.repartition(key).sortWithinPartitions(key, ts, amount, "receipt").mapInPandas(fold, schema)


def budget_status(budgets: DataFrame, key: str, value: str) -> DataFrame:
    """The one row of a budget, or none."""
    return budgets.where(F.col(key) == value)
