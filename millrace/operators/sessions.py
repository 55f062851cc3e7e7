"""Sessions, messages and their histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def history_window(messages: DataFrame, key: str, order: list[str], role: str, n: int = 25) -> DataFrame:
    """The last ``n`` messages of each session, from the user message at or before the cut."""
    w = Window.partitionBy(key)
    df = messages.withColumn("position", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn("__n", F.count(F.lit(1)).over(w))
    cut = F.greatest(F.lit(0), F.col("__n") - n)
    start = F.coalesce(F.max(F.when((F.col(role) == "user") & (F.col("position") <= cut), F.col("position"))).over(w), F.lit(0))
    df = df.withColumn("__start", F.when(cut > 0, start).otherwise(0))
    return df.where("position >= __start").drop("__n", "__start")


def context_tokens(messages: DataFrame, text: Column, *keys: str) -> DataFrame:
    return messages.groupBy(*keys).agg(F.ceil(F.sum(F.length(text)) / 4).cast("long").alias("tokens"))


def session_totals(messages: DataFrame, key: str, ts: str, tokens: Column) -> DataFrame:
    return messages.groupBy(key).agg(F.count(F.lit(1)).alias("message_count"), F.sum(tokens).cast("long").alias("total_tokens"), F.min(ts).alias("created_at"), F.max(ts).alias("updated_at"))


def newest(rows: DataFrame, ts: str, key: str, n: int) -> DataFrame:
    return rows.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def last_rows(rows: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__k")


def delete_sessions(sessions: DataFrame, messages: DataFrame, gone: DataFrame, session_key: str, foreign_key: str) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages without those of ``gone``; messages go with their session."""
    ids = gone.select(F.col(session_key).alias("__id")).distinct()
    return sessions.join(ids, F.col(session_key) == F.col("__id"), "left_anti"), messages.join(ids, F.col(foreign_key) == F.col("__id"), "left_anti")


def add_messages(messages: DataFrame, new: DataFrame, sessions: DataFrame, session_key: str, foreign_key: str) -> DataFrame:
    """Messages of known sessions are appended; others are refused."""
    known = sessions.select(F.col(session_key).alias("__id")).distinct()
    return messages.unionByName(new.join(known, F.col(foreign_key) == F.col("__id"), "left_semi"), allowMissingColumns=True)


def update_session(sessions: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Partial update: nulls keep what was there; counters below 0 or not finite are refused."""
    cols = [c for c in sessions.columns if c != key]
    df = sessions.join(changes.select(key, *(F.col(c).alias(f"__{c}") for c in cols if c in changes.columns)), key, "left")

    def merged(c: str) -> Column:
        if c not in changes.columns:
            return F.col(c)
        new = F.col(f"__{c}")
        if dict(sessions.dtypes)[c] in ("int", "bigint", "double", "float"):
            new = F.when((new >= 0) & ~F.isnan(new.cast("double")) & (new.cast("double") < float("inf")), new)
        return F.coalesce(new, F.col(c)).alias(c)

    return df.select(key, *map(merged, cols))


def numbered_lines(docs: DataFrame, key: str, text: str, offset: int, limit: int) -> DataFrame:
    """Lines ``offset`` to ``offset + limit - 1`` (from 1) of each text, numbered."""
    lines = F.slice(F.split(text, "\n"), offset, limit)
    return docs.select(key, F.posexplode(lines).alias("at", "line")).select(key, (F.col("at") + offset).cast("long").alias("line_number"), "line")


def search_lines(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    df = docs.where(F.col(text).rlike(f"(?m){pattern}")).select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    return df.where(F.col("line").rlike(pattern)).select(key, (F.col("at") + 1).cast("long").alias("line_number"), "line")


def transcript(events: DataFrame, key: str, order: str) -> DataFrame:
    """``key, entries, status, tokens`` from agent events ``type, text, name, error, tokens``.

    Text and reasoning deltas gather until a tool starts or the turn ends; then they are
    entries, reasoning first. The events of a session are folded in one row.
    """
    items = F.sort_array(F.collect_list(F.struct(order, "type", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("error", F.lit(False)).alias("error"), F.col("tokens").cast("long").alias("tokens"))))
    entry = lambda kind, text: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), text.alias("text"))
    none = F.array().cast("array<struct<kind:string,text:string>>")
    state = lambda entries, reasoning, text, status, tokens: F.struct(entries.alias("entries"), reasoning.alias("reasoning"), text.alias("text"), status.alias("status"), tokens.alias("tokens"))
    blank = F.lit("")

    def step(s: Column, e: Column) -> Column:
        pending = F.concat(F.when(s["reasoning"] != "", F.array(entry("reasoning", s["reasoning"]))).otherwise(none), F.when(s["text"] != "", F.array(entry("assistant", s["text"]))).otherwise(none))
        kind = e["type"]
        ends = kind.isin("tool_start", "turn_complete")
        new = F.when(kind == "tool_start", F.concat(pending, F.array(entry("tool", F.concat(e["name"], F.lit(" "), e["text"]))))).when(kind == "turn_complete", pending)
        new = new.when(kind == "tool_end", F.array(entry(F.when(e["error"], "tool_error").otherwise("tool_ok"), F.concat(e["name"], F.lit(" — "), e["text"])))).otherwise(none)
        reasoning = F.when(ends, blank).when(kind == "reasoning_delta", F.concat(s["reasoning"], e["text"])).otherwise(s["reasoning"])
        text = F.when(ends, blank).when(kind == "text_delta", F.concat(s["text"], e["text"])).otherwise(s["text"])
        status = F.when(kind == "turn_complete", "idle").otherwise(s["status"])
        tokens = F.when(kind.isin("usage", "turn_complete"), e["tokens"]).otherwise(s["tokens"])
        return state(F.concat(s["entries"], new), reasoning, text, status, tokens)

    start = state(none, blank, blank, F.lit("running"), F.lit(0).cast("long"))
    df = events.groupBy(key).agg(F.aggregate(items, start, step).alias("__folded"))
    return df.select(key, "__folded.entries", "__folded.status", "__folded.tokens")


def turn_problems(events: DataFrame, *keys: str, most_rounds: int = 8, most_calls: int = 32) -> DataFrame:
    """``keys, blocker`` of agent turns beyond their bounds. ``events``: ``keys, type, round``."""
    counts = events.groupBy(*keys).agg(F.countDistinct("round").alias("rounds"), F.count_if(F.col("type") == "tool_start").alias("calls"))
    found = F.array_compact(F.array(F.when(F.col("rounds") > most_rounds, F.concat(F.lit("turn_rounds_exceeded:"), F.col("rounds").cast("string"))), F.when(F.col("calls") > most_calls, F.concat(F.lit("turn_tool_calls_exceeded:"), F.col("calls").cast("string")))))
    return counts.select(*keys, F.explode(found).alias("blocker"))
