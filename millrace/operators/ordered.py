"""Digests of many rows in their order, without ever holding them together.

A digest is made of one byte after another, so the rows of one key pass through one task;
Spark sorts and spills them, and the task sees one batch of them at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rolling_digest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, separator: str = "", begin: str = "", end: str = "") -> DataFrame:
    """``keys, n_rows, n_bytes, sha256``: SHA-256 of each key's values in (ascending) order, as if they were joined by ``separator``
    between ``begin`` and ``end``. Null values are left out of the text, but counted as rows."""
    n = len(keys)
    sorted_rows = rows.select(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)), *(o.alias(f"o{i}") for i, o in enumerate(order)), value.cast("binary").alias("v"))
    sorted_rows = sorted_rows.repartition(*(F.col(f"k{i}") for i in range(n))).sortWithinPartitions(*(f"k{i}" for i in range(n)), *(f"o{i}" for i in range(len(order)))).select(*(f"k{i}" for i in range(n)), "v")
    types = [f"{rows.schema[k].dataType.simpleString()}" for k in keys]
    between, first, last = separator.encode(), begin.encode(), end.encode()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, counted, size, written, digest = None, 0, 0, False, None
        kinds: list[pa.DataType] = []

        def done() -> pa.RecordBatch:
            digest.update(last)
            return pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(key, kinds, strict=True)), pa.array([counted], pa.int64()), pa.array([size + len(last)], pa.int64()), pa.array([digest.hexdigest()])], names=[*(f"k{i}" for i in range(n)), "n_rows", "n_bytes", "sha256"])

        for batch in batches:
            kinds = [c.type for c in batch.columns[:n]]
            for *now, data in zip(*(c.to_pylist() for c in batch.columns[:n]), batch.column(n), strict=True):
                if now != key:
                    if digest is not None:
                        yield done()
                    key, counted, size, written, digest = now, 0, len(first), False, hashlib.sha256(first)
                counted += 1
                if not data.is_valid:
                    continue
                if written:
                    digest.update(between)
                    size += len(between)
                body = data.as_buffer()
                digest.update(body)
                size, written = size + body.size, True
        if digest is not None:
            yield done()

    schema = ", ".join([*(f"k{i} {t}" for i, t in enumerate(types)), "n_rows long", "n_bytes long", "sha256 string"])
    out = sorted_rows.mapInArrow(fold, schema)
    return out.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), "n_rows", "n_bytes", "sha256")
