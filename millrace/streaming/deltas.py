"""Event streams: delta lines, stateful assembly, folds, workers and fair supervision."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACES, trim
from ..operators.ledger import fair_selection
from ..sources.sinks import exists, write_text

CHUNK = "choices ARRAY<STRUCT<delta: STRUCT<content: STRING, reasoning_content: STRING, tool_calls: ARRAY<STRUCT<index: INT, id: STRING, function: STRUCT<name: STRING, arguments: STRING>>>>>>, usage STRUCT<prompt_tokens: BIGINT, completion_tokens: BIGINT, total_tokens: BIGINT>"


def deltas(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines ``data: {json}`` become ``content, reasoning, tool_calls, usage``; other lines and bad JSON go. Works on streams."""
    df = lines.withColumn(line, trim(F.col(line))).where(F.col(line).startswith("data: ") & (F.col(line) != "data: [DONE]"))
    df = df.withColumn("__c", F.from_json(F.substring(line, 7, 1 << 30), CHUNK)).where("__c is not null and (size(__c.choices) > 0 or __c.usage is not null)")
    first = F.get("__c.choices", F.lit(0))["delta"]
    return df.withColumn("content", first["content"]).withColumn("reasoning", first["reasoning_content"]).withColumn("tool_calls", first["tool_calls"]).withColumn("usage", F.col("__c.usage")).drop("__c", line)


def assemble(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Whole responses from ``deltas``: texts concatenated, last usage, tool calls by index (last id, name and arguments appended)."""
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(order, c)))), lambda x: x[c]), "")
    texts = rows.groupBy(key).agg(joined("content").alias("text"), joined("reasoning").alias("reasoning"), F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col(order))).alias("usage"))
    calls = rows.select(key, order, F.inline("tool_calls")).select(key, order, "index", "id", F.col("function.name").alias("name"), F.col("function.arguments").alias("arguments"))
    calls = calls.groupBy(key, "index").agg(F.max_by("id", F.when(F.col("id").isNotNull(), F.col(order))).alias("id"), joined("name").alias("name"), joined("arguments").alias("arguments"))
    calls = calls.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("index", "id", "name", "arguments"))).alias("tool_calls"))
    return texts.join(calls, key, "left")


def assemble_stream(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Running state of each response on a stream: ``key, text, total_tokens, parts``, once for each batch it appears in."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, tokens, parts = state.get if state.exists else ("", 0, 0)
        for pdf in batches:
            pdf = pdf.sort_values(order)
            text += "".join(x for x in pdf["content"] if x is not None)
            parts += len(pdf)
            used = [int(u) for u in pdf["total"] if pd.notna(u)]
            tokens = used[-1] if used else tokens
        state.update((text, tokens, parts))
        yield pd.DataFrame({key: [keys[0]], "text": [text], "total_tokens": [tokens], "parts": [parts]})

    kind = dict(rows.dtypes)[key]
    flat = rows.select(key, order, "content", F.col("usage.total_tokens").alias("total"))
    return flat.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, text string, total_tokens long, parts long", "text string, tokens long, parts long", "update", GroupStateTimeout.NoTimeout)


#: Where a response stands: bytes of an unfinished line, texts, usage and tool calls.
RESPONSE = "remainder binary, text string, reasoning string, prompt_tokens long, completion_tokens long, total_tokens long, tool_calls array<struct<index: int, id: string, name: string, arguments: string>>, n_bytes long"


class Response:
    """A response put together from its bytes, whatever pieces they come in."""

    def __init__(self, state: tuple | None = None):
        remainder, text, reasoning, prompt, completion, total, calls, n = state or (b"", "", "", None, None, None, [], 0)
        self.remainder, self.text, self.reasoning, self.usage, self.n_bytes = bytes(remainder), text, reasoning, (prompt, completion, total), n
        self.calls = {c[0]: list(c[1:]) for c in calls}

    def feed(self, data: bytes) -> None:
        """Whole lines are taken; what follows the last line feed waits, so no character or line is cut."""
        self.n_bytes += len(data)
        *lines, self.remainder = (self.remainder + data).split(b"\n")
        for line in lines:
            self._take(line)

    def _take(self, line: bytes) -> None:
        text = line.decode("utf-8", "replace").strip(SPACES)
        if not text.startswith("data: ") or text == "data: [DONE]":
            return
        try:
            chunk = json.loads(text[6:])
        except ValueError:
            return
        if not isinstance(chunk, dict):
            return
        if isinstance(used := chunk.get("usage"), dict) and used:
            self.usage = tuple(int(used.get(k) or 0) for k in ("prompt_tokens", "completion_tokens", "total_tokens"))
        choices = chunk.get("choices")
        delta = choices[0].get("delta") if isinstance(choices, list) and choices and isinstance(choices[0], dict) else None
        if not isinstance(delta, dict):
            return
        self.text += delta["content"] if isinstance(delta.get("content"), str) else ""
        self.reasoning += delta["reasoning_content"] if isinstance(delta.get("reasoning_content"), str) else ""
        for call in delta.get("tool_calls") or ():
            made = self.calls.setdefault(call.get("index"), [None, "", ""])
            made[0] = call.get("id") or made[0]
            function = call.get("function") or {}
            made[1] += function.get("name") or ""
            made[2] += function.get("arguments") or ""

    def state(self) -> tuple:
        return (self.remainder, self.text, self.reasoning, *self.usage, [(k, *v) for k, v in sorted(self.calls.items())], self.n_bytes)

    def ended(self) -> Response:
        """As it would be if nothing followed: an unfinished line counts."""
        end = Response(self.state())
        end._take(end.remainder)
        end.remainder = b""
        return end


def assemble_bytes(pieces: DataFrame, key: str, order: str, data: str = "data") -> DataFrame:
    """Responses on a stream of their raw bytes: ``key`` and what ``assemble`` gives of all bytes so far, once for each batch
    that has a piece of the response. Pieces may end anywhere, within lines, escapes and characters."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    columns = ["remainder", "text", "reasoning", "prompt_tokens", "completion_tokens", "total_tokens", "tool_calls", "n_bytes"]

    def fold(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        response = Response(state.get if state.exists else None)
        for pdf in [pd.concat(list(batches)).sort_values(order)]:
            for piece in pdf[data]:
                response.feed(bytes(piece))
        state.update(response.state())
        end = dict(zip(columns, response.ended().state(), strict=True))
        end["tool_calls"] = [dict(zip(("index", "id", "name", "arguments"), c, strict=True)) for c in end["tool_calls"]]
        yield pd.DataFrame({key: [keys[0]]} | {c: pd.Series([end[c]], dtype=object if c not in ("prompt_tokens", "completion_tokens", "total_tokens") else "Int64") for c in columns[1:]})

    kind = dict(pieces.dtypes)[key]
    out = RESPONSE.split(", ", 1)[1]
    return pieces.select(key, order, data).where(F.col(data).isNotNull()).groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, {out}", RESPONSE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts: str, kind: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by kind and time window with a watermark (an addition of this library)."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width), kind).count().select(F.col("window.start").alias("window_start"), kind, "count")


def work_available(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, timeout_s: int = 600) -> int:
    """Process what is there now in batches, then stop; returns the number of batches. A rerun takes up where this ended."""
    seen = []

    def batch(df: DataFrame, number: int) -> None:
        work(df, number)
        seen.append(number)

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not q.awaitTermination(timeout_s):
        q.stop()
        raise TimeoutError("worker")
    return len(seen)


def supervise(spark: SparkSession, discover: Callable[[], DataFrame], work: Callable[[str], None], state: str, cycles: int = 1, jobs: int = 100, keep: int = 10) -> list[dict]:
    """Bounded cycles over running jobs in fair order; the last ``keep`` reports.

    The cursor is stored before the work, so a job that ends the process isn't first
    again. One job's failure is its report.
    """
    if not (1 <= cycles <= 10_000 and 1 <= jobs <= 1_000):
        raise ValueError("invalid_supervisor_bounds")
    reports: list[dict] = []
    for cycle in range(cycles):
        cursor = spark.read.text(f"{state}/cursor").first().value if exists(spark, f"{state}/cursor") else None
        chosen = [r.job_id for r in fair_selection(discover().select("job_id"), "job_id", cursor, jobs).collect()]
        if chosen:
            write_text(spark, f"{state}/cursor", chosen[-1], overwrite=True)
        errors = {}
        for job in chosen:
            try:
                work(job)
            except Exception as e:  # isolated by job
                errors[job] = f"{type(e).__name__}: {e}"
        reports = [*reports, {"cycle": cycle, "jobs": chosen, "errors": errors, "ok": not errors}][-keep:]
    return reports
