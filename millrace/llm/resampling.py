"""Importance resampling towards a target distribution, over hashed n-grams of words.

A document weighs as much as its n-grams speak for the target texts rather than for all
documents; the draw adds Gumbel noise to the weights, so that the highest sums are a sample
without replacement.

Words become integers before anything is counted. Documents are put in blocks; each block
numbers its own words, so a word crosses the network once for each block that has it and
not once for each time it occurs, and no word, however common, is a hot key. All blocks'
distinct words make the dictionary: word, id. With the ids sent back, n-grams are tuples
of ids; each block counts its distinct tuples, equal tuples of all blocks are added up,
and each distinct tuple's bytes are put together from the dictionary and hashed once. What
a tuple's bucket gains goes back to the blocks, where weights are sums over documents.

Defined results: words are read of whole texts, ``A-Z`` lower-cased; a null text has none; a
document without n-grams weighs 0; a null id draws as the text ``null`` and comes first in
ties; repeated rows each get a rank of their own; no rows give no rows, and without target texts every
gain is that of no occurrences; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.prefix import row_numbers

from .common import dropped, staged

#: Bytes of text after which a block is closed; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20
#: A long text is parted into words in pieces of so many bytes.
PIECE_BYTES = 1 << 20
#: Buckets that n-grams are hashed into; their gains are broadcast.
BUCKETS, MOST_BUCKETS = 10_000, 1_000_000

_WORD, _GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")


class _Numbers(dict):
    """Numbers for words, in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte: most of their upper bytes are alike."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def words_of(text: str) -> Iterator[list[bytes]]:
    """Words of a text, piece after piece; no word is cut."""
    data, at = text.encode().lower(), 0  # bytes.lower() changes A-Z only
    while at < len(data):
        gap = _GAP.search(data, at + PIECE_BYTES) if at + PIECE_BYTES < len(data) else None
        end = gap.start() if gap else len(data)
        yield _WORD.findall(data[at:end])
        at = end


def _coded_blocks(target: bool, id_type: pa.DataType):
    """A row for each block: ids and word counts of its documents, their words as numbers, and the words by number."""

    def block(name: int, ids: list, lengths: list[int], codes: array, numbers: _Numbers) -> pa.RecordBatch:
        columns = [pa.array([name], pa.int64()), pa.array([target]), pa.array([ids], pa.list_(id_type)), pa.array([lengths], pa.list_(pa.int64())), pa.array([packed(np.frombuffer(codes, np.int32))], pa.binary()), pa.array([[w.decode() for w in numbers]], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["block", "target", "ids", "lengths", "codes", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32 | target << 62
        ids, lengths, codes, numbers, held = [], [], array("i"), _Numbers(), 0
        for batch in batches:
            for id_, text in zip(*batch.columns, strict=True):
                text = text.as_py() or ""
                if ids and held + len(text) > BLOCK_BYTES:
                    yield block(name, ids, lengths, codes, numbers)
                    name, ids, lengths, codes, numbers, held = name + 1, [], [], array("i"), _Numbers(), 0
                before = len(codes)
                for words in words_of(text):
                    codes.extend(map(numbers.__getitem__, words))
                ids.append(id_.as_py())
                lengths.append(len(codes) - before)
                held += len(text)
        if ids:
            yield block(name, ids, lengths, codes, numbers)

    return run


def coded_blocks(rows: DataFrame, target: bool) -> DataFrame:
    """Blocks of ``rows`` (id, text), in whatever partitions they come."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema[0].dataType
    return rows.mapInArrow(_coded_blocks(target, to_arrow_type(kind)), f"block long, target boolean, ids array<{kind.simpleString()}>, lengths array<long>, codes binary, words array<string>")


def _ngrams(codes: np.ndarray, lengths: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size from 1 to ``n``: where its n-grams begin, which number each has among the distinct ones, and
    one place of each distinct one."""
    number, seen = codes, int(codes.max(initial=-1)) + 1
    starts, first = np.arange(len(codes), dtype=np.int32), np.empty(seen, np.int32)
    first[codes[::-1]] = starts[::-1]  # numbers are dense, and the last assignment is the first place
    yield starts, codes, first
    ends = np.repeat(np.cumsum(lengths), lengths) if n > 1 else None
    for size in range(2, n + 1):
        # a longer n-gram is the one before it and one word more, within the document
        inside = starts + size <= ends[starts]
        starts = starts[inside]
        number = number[inside].astype(np.int64) * seen + codes[starts + size - 1]
        _, first, number = np.unique(number, return_index=True, return_inverse=True)
        yield starts, number, starts[first]


def _row(values: pa.Array) -> pa.ListArray:
    """All values as one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _placed(places: pa.ListScalar, values: pa.ListScalar) -> np.ndarray:
    """Values in the order of their places, which are all numbers from 0 on; null lists are empty."""
    if not places.is_valid:
        return np.zeros(0, np.int64)
    out = np.zeros(len(places), np.int64)
    out[places.values.to_numpy()] = values.values.to_numpy()
    return out


def _counted_tuples(n: int):
    """Each block's distinct tuples of ids, how often each occurs, and the number of each n-gram's tuple, document by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = {f: batch.column(i)[row] for i, f in enumerate(batch.schema.names)}
                codes, lengths = unpacked(at["codes"].as_py()), at["lengths"].values.to_numpy(zero_copy_only=False)
                global_id = _placed(at["places"], at["word_ids"])
                of_doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
                docs, numbers, tuples, sizes, counts, known = [], [], [], [], [], 0
                for size, (starts, number, first) in enumerate(_ngrams(codes, lengths, n), 1):
                    docs.append(of_doc[starts])
                    numbers.append(number + known)
                    tuples.append(global_id[codes[first[:, None] + np.arange(size)]].ravel())
                    sizes.append(np.full(len(first), size))
                    counts.append(np.bincount(number, minlength=len(first)))
                    known += len(first)
                of_feature, numbers = np.concatenate(docs), np.concatenate(numbers)
                features = np.bincount(of_feature, minlength=len(lengths))
                if n > 1:  # document by document again
                    numbers = numbers[np.argsort(of_feature, kind="stable")]
                ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tuples)))
                columns = [
                    pa.array([at["block"].as_py()], pa.int64()), pa.array([at["target"].as_py()]), pa.array([at["ids"].as_py()], at["ids"].type), _row(pa.array(lengths)), _row(pa.array(features, pa.int64())),
                    pa.array([packed(numbers)], pa.binary()), _row(ids), _row(pa.array(np.concatenate(counts), pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "target", "ids", "n_words", "n_features", "numbers", "tuples", "counts"])

    return run


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            at = {f: batch.column(i)[row] for i, f in enumerate(batch.schema.names)}
            gain = _placed(at["places"], at["gains"])
            features = at["n_features"].values.to_numpy(zero_copy_only=False)
            upto = np.concatenate([[0], np.cumsum(gain[unpacked(at["numbers"].as_py())])])
            ends = np.cumsum(features)
            weights = upto[ends] - upto[ends - features]
            yield pa.RecordBatch.from_arrays([at["ids"].values, at["n_words"].values, at["n_features"].values, pa.array(weights, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])


def dictionary(blocks: DataFrame) -> DataFrame:
    """``word, id`` of all distinct words."""
    return staged(blocks.select(F.explode("words").alias("word")).distinct().withColumn("id", F.monotonically_increasing_id()), "dictionary")


def tuple_buckets(tuples: DataFrame, words: DataFrame, n: int, buckets: int) -> DataFrame:
    """``tuples`` (column ``tuple``) with ``bucket``: each tuple's words are looked up and their bytes hashed, once."""
    for k in range(n):
        named = words.select(F.col("id").alias(f"id{k}"), F.col("word").alias(f"word{k}"))
        tuples = tuples.join(named, F.get("tuple", F.lit(k)) == F.col(f"id{k}"), "left").drop(f"id{k}")
    return tuples.withColumn("bucket", F.crc32(F.concat_ws(" ", *(f"word{k}" for k in range(n))).cast("binary")) % buckets).drop(*(f"word{k}" for k in range(n)))


def gains(counts: DataFrame, buckets: int) -> DataFrame:
    """``bucket, gain`` from ``bucket, s, t``: how often n-grams of a bucket occur in all documents and in the target."""
    by_bucket = staged(counts.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    all_ = by_bucket.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    ratio = (F.col("t") + 1.0) * F.lit(float(all_["s"] + buckets)) / ((F.col("s") + 1.0) * F.lit(float(all_["t"] + buckets)))
    return by_bucket.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every document; ``n``: the longest n-gram."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets from 1 to {MOST_BUCKETS} are wanted")
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    aims = target.select(F.lit(None).cast(id_type).alias("id"), F.col(f"`{target_col}`").alias("text"))
    blocks = staged(coded_blocks(rows, False).unionByName(coded_blocks(aims, True)), "coded")
    words = dictionary(blocks)
    places = blocks.select("block", F.posexplode("words").alias("place", "word")).join(words, "word")
    # the two lists of a block are in the same order: one aggregation fills them row by row
    numbered = places.groupBy("block").agg(F.collect_list("place").alias("places"), F.collect_list("id").alias("word_ids"))
    known = blocks.drop("words").join(numbered, "block", "left")
    kind = id_type.simpleString()
    counted = staged(known.mapInArrow(_counted_tuples(n), f"block long, target boolean, ids array<{kind}>, n_words array<long>, n_features array<long>, numbers binary, tuples array<array<long>>, counts array<long>"), "counted")

    dropped(blocks)

    own = counted.select("block", "target", F.posexplode(F.arrays_zip("tuples", "counts")).alias("place", "x")).select("block", "target", "place", F.col("x.tuples").alias("tuple"), F.col("x.counts").alias("n"))
    sums = own.groupBy("tuple").agg(F.sum(F.when(~F.col("target"), F.col("n")).otherwise(0)).alias("s"), F.sum(F.when(F.col("target"), F.col("n")).otherwise(0)).alias("t"))
    hashed = staged(tuple_buckets(sums, words, n, buckets), "hashed")
    dropped(words)
    # at most MOST_BUCKETS rows
    by_bucket = F.broadcast(gains(hashed, buckets))
    back = own.where(~F.col("target")).select("block", "place", "tuple").join(hashed.select("tuple", "bucket").join(by_bucket, "bucket"), "tuple")
    back = back.groupBy("block").agg(F.collect_list("place").alias("places"), F.collect_list(F.col("gain").cast("int")).alias("gains"))
    rest = counted.where(~F.col("target")).select("block", "ids", "n_words", "n_features", "numbers").join(back, "block", "left")
    weighed = staged(rest.mapInArrow(_weighed, f"doc_id {kind}, n_words long, n_features long, weight long"), "weights")
    dropped(counted, hashed)
    return weighed


def noise(id_: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, from a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(2.0**32))))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, n: int = 1, buckets: int = BUCKETS, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank``: of the documents with ``least_words`` words or more, the
    ``percent`` of a hundred with the highest scores have a rank; ties go to the smaller id."""
    scored = weights(docs, target, n, buckets, id_col, text_col, target_col)
    scored = staged(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    fit = F.col("n_words") >= least_words
    most = percent * scored.where(fit).count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features").asc()]
    ranked = row_numbers(scored.where(fit), order, "rank")
    rest = scored.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).unionByName(rest).drop("n_words")
