"""Mixing sources to target weights by hash thresholds, in DataFrame operations only.

Documents have a fixed hash. Each source takes its documents in ascending order of the
hash until its share is spent, so a larger share always holds a smaller one. The place
where the share ends is found without sorting documents: sum sizes by source and hash
bucket, find the bucket where the running sum passes the share, and sum that bucket
alone again by the next bits, until one hash is left. Then one filter on the hash.

A target above a source's size repeats the source: each document is taken as often as
the target holds the source, and once more below the threshold. The document at the
threshold is taken in part, so a source's words meet its target to the word.

Defined results: a null text has size 0; null is a source of its own, last in order;
equal rows have equal hashes, and at the threshold share what is left in proportion to
their sizes, rounded down; a null id is a value like others; whole texts count, however
long; no rows give no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SPLIT, staged

#: Bits of the hash that each round resolves: 65,536 sums a source at most.
ROUND_BITS, HASH_BITS = 16, 64
WEIGHTS, SHARE, MOST_REPEATS = (3.0, 1.0, 2.0), 1.5, 2


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.array_remove(F.split(text, WORD_SPLIT), ""))).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """``source, source_size, target`` from one row ``source, source_size`` for each source.

    ``share`` of all sizes is dealt by weight; a source takes ``most`` times its size at
    most, and what is above goes to the others by weight. In ascending order of most
    times size over weight, the first source whose even share fits under its own limit
    sets the level for itself and all after it; those before are at their limits.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    df = sizes.withColumn("place", F.row_number().over(by_source))
    df = df.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    df = df.withColumn("limit", (most * F.col("source_size")).cast("double")).withColumn("ratio", F.col("limit") / F.col("weight"))
    df = df.withColumn("budget", share * F.sum("source_size").over(everything))
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("level", (F.col("budget") - before) / left)
    df = df.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    return df.select("source", "source_size", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("weight"))).alias("target"))


def thresholds(base: DataFrame, goals: DataFrame) -> DataFrame:
    """``source, source_size, target, copies, edge, edge_size, edge_rest``: take ``copies``
    of each document, one more where its hash is below ``edge``, and of the documents at
    ``edge`` (``edge_size`` words) ``edge_rest`` words together.

    ``base``: ``source, size, hash``.
    """
    goals = goals.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goals = staged(goals.withColumn("rest", F.greatest(F.lit(0), F.floor("target") - F.col("copies") * F.col("source_size"))), "mix-goals")
    open_ = goals.where("rest > 0").select(F.col("source").alias("s"), F.col("rest").alias("r"), F.lit(0).cast("long").alias("prefix"))
    shift, found = HASH_BITS, None
    while shift > 0:
        bits, shift = shift, shift - ROUND_BITS
        inside = F.lit(True) if bits == HASH_BITS else F.shiftrightunsigned("hash", bits) == F.col("prefix")
        rows = base.where("size > 0").join(open_, F.col("source").eqNullSafe(F.col("s")) & inside)
        sums = rows.groupBy("s", "r", F.shiftrightunsigned("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        # At most 2 ** ROUND_BITS rows of a source; the top round's buckets are unsigned numbers.
        upto = F.sum("size").over(Window.partitionBy("s").orderBy("bucket"))
        edge = sums.withColumn("upto", upto).where((F.col("upto") >= F.col("r")) & (F.col("upto") - F.col("size") < F.col("r")))
        edge = staged(edge.select("s", (F.col("r") - F.col("upto") + F.col("size")).alias("r"), "bucket", "size", "low", "high"), "mix-edge")
        done = edge.where("low = high").select("s", F.col("low").alias("edge"), F.col("size").alias("edge_size"), F.col("r").alias("edge_rest"))
        found = done if found is None else found.unionByName(done)
        more = edge.where("low <> high")
        if more.isEmpty():
            break
        open_ = more.select("s", "r", F.col("bucket").alias("prefix"))
    return staged(goals.join(found, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "rest"), "mix-thresholds")


def _unsigned(hash_: Column) -> Column:
    """Signed order of this is unsigned order of ``hash_``."""
    return hash_.bitwiseXOR(F.lit(-(2**63)))


def taken_column() -> Column:
    below, at = _unsigned(F.col("hash")) < _unsigned(F.col("edge")), F.col("hash") == F.col("edge")
    part = F.floor(F.col("edge_rest").cast("decimal(20,0)") * F.col("size") / F.col("edge_size"))
    extra = F.when(below, F.col("size")).when(at, F.least(part.cast("long"), F.col("size"))).otherwise(0)
    return (F.col("copies") * F.col("size") + F.coalesce(extra, F.lit(0))).cast("long")


def _base(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, *more: Column) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(*more, F.col(f"`{source_col}`").alias("source"), word_count(text).alias("size"), F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), text).alias("hash"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    base = staged(_base(docs, id_col, text_col, source_col, seed, F.col(f"`{id_col}`").alias("doc_id")), "mix-sizes")
    edges = _edges(base, weights, share, most)
    return base.join(edges, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "size", "source_size", "target", taken_column().alias("taken"))


def _edges(base: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    return thresholds(base, targets(sizes, weights, share, most)).withColumnRenamed("source", "of")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken. The document at a source's threshold is
    taken whole or not at all, whichever is nearer to the target, so no text is cut and a source is off
    its target by half of that document at most. Documents without words are in no mix."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    base = staged(_base(docs, id_col, text_col, source_col, seed, F.struct(*columns).alias("row")), "mix-rows")
    edges = _edges(base, weights, share, most)
    rows = base.join(edges, F.col("source").eqNullSafe(F.col("of"))).where("size > 0")
    copies = F.floor(taken_column() / F.col("size") + 0.5).cast("int")
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), copies))).select("row.*")
