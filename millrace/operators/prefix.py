"""Row numbers and running sums without a window that holds a whole key.

A window that is ordered within a key puts all rows of the key in one task. Here rows
are dealt by ranges of (key, order), so a key's rows may lie in many tasks; each range
sums its own rows from zero, and a table of one total for each key and range gives what
came before. Only a range's first key can have begun in an earlier range, so at most one
number for each range is added back.

Ranges are written to a working table before any total is taken from them: which row
lies in which range is settled once, whatever runs again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.staging import staged

_RANGE = "__range"


def running_totals(df: DataFrame, order: Sequence[Column], totals: dict[str, Column], by: Sequence[Column] = ()) -> DataFrame:
    """``df`` with a column for each of ``totals``: the sum of its value (null counts 0) over
    the rows of the same ``by`` up to and with this one in ``order``. Null keys are a key.

    ``order`` should tell the rows of a key apart; equal rows count one after another, as it
    falls out. No rows give no rows.
    """
    keys = [f"__key{i}" for i in range(len(by))]
    values = {name: f"__value{i}" for i, name in enumerate(totals)}
    ready = df.withColumns({k: c for k, c in zip(keys, by, strict=True)} | {values[n]: F.coalesce(v, F.lit(0)) for n, v in totals.items()})
    dealt = ready.repartitionByRange(*(F.col(k) for k in keys), *order).withColumn(_RANGE, F.spark_partition_id())
    ranged = staged(dealt, "running")

    inside = Window.partitionBy(_RANGE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({n: F.sum(v).over(inside) for n, v in values.items()})

    ends = ranged.groupBy(_RANGE, *keys).agg(*(F.sum(v).alias(v) for v in values.values()))
    # as many rows of a key as there are ranges, at most
    earlier = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(F.col(_RANGE).alias("__at"), *(F.col(k).alias(f"{k}_at") for k in keys), *(F.sum(v).over(earlier).alias(f"{v}_before") for v in values.values()))
    before = before.where(" or ".join(f"{v}_before is not null" for v in values.values()))
    same = F.col(_RANGE) == F.col("__at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_at"))
    # at most one row for each range: its first key
    joined = summed.join(F.broadcast(before), same, "left")
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), *((F.col(f"`{n}`") + F.coalesce(F.col(f"{v}_before"), F.lit(0))).alias(n) for n, v in values.items()))


def row_numbers(df: DataFrame, order: Sequence[Column], name: str = "row_number", by: Sequence[Column] = ()) -> DataFrame:
    """``df`` with its rows' numbers in ``order`` within ``by``, from 1."""
    return running_totals(df, order, {name: F.lit(1).cast("long")}, by)
