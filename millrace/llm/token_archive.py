"""Token-id archives: one zstandard frame for each document, one shared dictionary.

Format of a file (all numbers little-endian)::

    "MRTA" | version u16 | flags u16 | shard u32 | block u32 | n_docs u32 | n_tokens u64
    | sha256 of the dictionary, 32 bytes
    | index: n_docs x (doc_id i64, has_id u8, offset u64, frame_bytes u32, n_tokens u32)
    | crc32 of everything above, u32 | frames | "MRTE"

``offset`` counts from the first frame. A frame holds a document's ids as unsigned
32-bit integers, compressed with the shared dictionary, so one short document is read
by one seek. The dictionary is the only file of ``<archive>/dictionary``; readers
refuse a file whose dictionary hash differs.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_raw_files, staged, write_raw_files
from .encoding import encoder

HEAD = struct.Struct("<4sHHIIIQ32s")
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("frame_bytes", "<u4"), ("n_tokens", "<u4")])
TRAILER = b"MRTE"
#: A file closes beyond so many bytes of frames or so many documents.
BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 65_536
#: The dictionary is trained on so many documents of at most so many characters: those with the smallest hashes.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 800, 20_000, 64 << 10
LEVEL = 3


class ArchiveError(ValueError):
    pass


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """A zstandard dictionary from the id arrays of a bounded, hash-chosen sample of whole documents.

    Too few or too small documents give an empty dictionary (plain frames). Empty documents
    and those of more than ``SAMPLE_CHARS`` characters aren't in it.
    """
    import zstandard

    chosen = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where((F.length("t") > 0) & (F.length("t") <= SAMPLE_CHARS))
    # Rows with hashes in a range that should hold twice the sample: tasks send few rows to the driver, however many tasks there are.
    chosen = chosen.where(F.pmod(F.xxhash64("i", "t", F.lit("dictionary")), F.lit(1 << 40)) < int((1 << 40) * min(1.0, 2 * SAMPLE_DOCS / max(docs.count(), 1))))
    rows = chosen.orderBy(F.xxhash64("i", "t", F.lit("dictionary")), "i", "t").limit(SAMPLE_DOCS).collect()
    enc = encoder(tokenizer_path, False)
    arrays = [enc.encode(r.t) + struct.pack("<I", end_id) for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


def pack_block(shard: int, block: int, docs: list[tuple[int | None, bytes, bytes]], dictionary_hash: bytes) -> bytes:
    """A file's bytes, but for its trailer, from ``(doc_id, frame, ids)``."""
    index = np.zeros(len(docs), INDEX)
    at = 0
    for k, (doc_id, frame, ids) in enumerate(docs):
        index[k] = (doc_id or 0, doc_id is not None, at, len(frame), len(ids) // 4)
        at += len(frame)
    head = HEAD.pack(b"MRTA", 1, 0, shard, block, len(docs), int(index["n_tokens"].sum(dtype=np.int64)), dictionary_hash) + index.tobytes()
    return b"".join([head, struct.pack("<I", zlib.crc32(head)), *(frame for _, frame, _ in docs)])


class Block:
    """Random access to the documents of one file."""

    def __init__(self, content: bytes, dictionary: bytes):
        import zstandard

        if len(content) < HEAD.size + 8 or content[-4:] != TRAILER:
            raise ArchiveError("truncated archive file")
        magic, version, _, self.shard, self.block, n, self.n_tokens, digest = HEAD.unpack_from(content)
        if magic != b"MRTA" or version != 1:
            raise ArchiveError("not an archive file")
        end = HEAD.size + n * INDEX.itemsize
        if zlib.crc32(content[:end]) != struct.unpack_from("<I", content, end)[0]:
            raise ArchiveError("index checksum differs")
        if digest != hashlib.sha256(dictionary).digest():
            raise ArchiveError("the file was written with another dictionary")
        self.content, self.at = memoryview(content), end + 4
        self.index = np.frombuffer(content, INDEX, n, HEAD.size)
        self.unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def ids(self, k: int) -> bytes:
        """The ids of the ``k``-th document, and of no other."""
        e = self.index[k]
        a = self.at + int(e["offset"])
        return self.unzip.decompress(self.content[a : a + int(e["frame_bytes"])], max_output_size=4 * int(e["n_tokens"]))


def write_archive(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Tokenise ``text_col`` and write an archive in ascending order of ``id_col``.

    A null text is an empty document, holding the end id alone. Rows with a null id come
    first; rows that repeat an id follow each other, by a hash of their texts and then the
    texts. No rows give an archive without documents; whole texts are encoded, however long;
    other columns are not read, whatever their names. One range shuffle on the id and the
    hash, so that an id that very many rows share is dealt out; each task then streams its
    sorted range, with one block in memory.
    """
    import zstandard

    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer_path, end_id, id_col, text_col)
    spark.createDataFrame([(bytearray(dictionary),)], "blob binary").coalesce(1).write.parquet(f"{path}/dictionary")
    digest, end = hashlib.sha256(dictionary).digest(), struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
        enc, shard, block, held, size = encoder(tokenizer_path, False), TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py() or "") + end
                frame = zip_.compress(ids)
                held.append((doc_id, frame, ids))
                size += len(frame) + len(ids)
                if size > 4 * BLOCK_BYTES or len(held) >= BLOCK_DOCS:
                    yield pa.RecordBatch.from_pydict({"blob": [pack_block(shard, block, held, digest)]})
                    block, held, size = block + 1, [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"blob": [pack_block(shard, block, held, digest)]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    write_raw_files(ordered.mapInArrow(encode, "blob binary"), f"{path}/data", TRAILER)


def load_dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first().blob)


def _decoded(spark: SparkSession, path: str, keep_ids: bool) -> DataFrame:
    dictionary = load_dictionary(spark, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                b, at = Block(content.as_py(), dictionary), 0
                for lo in range(0, len(b.index), 4096):
                    part = b.index[lo : lo + 4096]
                    data = [b.ids(k) for k in range(lo, lo + len(part))]
                    n = part["n_tokens"].astype(np.int64)
                    starts = at + np.cumsum(n) - n
                    at += int(n.sum())
                    out = {
                        "shard": pa.array(np.full(len(part), b.shard, np.int64)), "block": pa.array(np.full(len(part), b.block, np.int64)),
                        "doc_id": pa.array(part["doc_id"].astype(np.int64), mask=part["has_id"] == 0), "local_start": pa.array(starts), "n_tokens": pa.array(n),
                        "ids_crc32": pa.array([zlib.crc32(x) for x in data], pa.int64()), "frame_bytes": pa.array(part["frame_bytes"].astype(np.int64)),
                    }
                    if keep_ids:
                        out["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in data], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    schema = "shard long, block long, doc_id long, local_start long, n_tokens long, ids_crc32 long, frame_bytes long" + ", ids array<long>" * keep_ids
    return read_raw_files(spark, f"{path}/data").select("content").mapInArrow(decode, schema)


def _with_start(rows: DataFrame) -> DataFrame:
    """``start`` from the token counts of files: a running sum over the files of each
    shard, then over the shards, of which there are as many as write tasks."""
    files = rows.groupBy("shard", "block").agg(F.sum("n_tokens").alias("file_tokens"))
    shards = files.groupBy("shard").agg(F.sum("file_tokens").alias("shard_tokens"))

    def before(value: str, w: Window) -> Column:
        return F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    shards = shards.select("shard", before("shard_tokens", Window.orderBy("shard")).alias("shard_start"))
    files = files.join(shards, "shard").select("shard", "block", (F.col("shard_start") + before("file_tokens", Window.partitionBy("shard").orderBy("block"))).alias("file_start"))
    return rows.join(files, ["shard", "block"]).withColumn("start", F.col("file_start") + F.col("local_start"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document."""
    return _with_start(_decoded(spark, path, True)).select("doc_id", "start", "n_tokens", "ids")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, frame_bytes`` of every document, all decoded from the files."""
    return _with_start(staged(_decoded(spark, path, False), "token-digests")).select("doc_id", "start", "n_tokens", "ids_crc32", "frame_bytes")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id, ids`` of the named documents; only their frames are decompressed."""
    dictionary, wanted = load_dictionary(spark, path), np.array(sorted(set(doc_ids)), np.int64)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                b = Block(content.as_py(), dictionary)
                for k in np.flatnonzero(np.isin(b.index["doc_id"], wanted) & (b.index["has_id"] == 1)):
                    ids = np.frombuffer(b.ids(int(k)), "<u4").astype(np.int64)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([int(b.index["doc_id"][k])]), "ids": pa.array([ids], pa.list_(pa.int64()))})

    return read_raw_files(spark, f"{path}/data").select("content").mapInArrow(pick, "doc_id long, ids array<long>")
