"""Media columns: TIFF images in a binary column, read page by page.

``read_pages`` walks the chain of image directories of each file, in either byte order,
decodes strips and tiles (stored plain, PackBits, LZW or deflate), undoes the
horizontal predictor and emits one row for each page. ``encode_tiff`` writes such
files. Samples have 1, 2, 4, 8, 16 or 32 bits, chunky or planar; those of less than 8
bits take a byte each when read, larger ones are little-endian.

A page that can't be decoded gives a row with ``error`` and the walk goes on with the
next; where the chain itself breaks (no TIFF, a directory beyond the file, a chain that
returns to itself), a last row has ``error`` and no page. A page of a declared size that
its strips can't hold, whatever their compression, is an error before memory is taken.

Defined results: a null text is empty; an empty one has 64 zero bytes; equal texts give
equal files, and repeated rows a row each; a null id is kept; no rows give no rows; whole
texts are stored, however long (a binary value holds 2 GiB at most); other columns are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the TIFF 6.0 format: tags, field types and compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
FIELD_FORMATS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946

#: Bytes that a compressed byte can stand for, at most.
EXPANSION = {PLAIN: 1, PACKBITS: 64, LZW: 2736, DEFLATE: 1040, OLD_DEFLATE: 1040}
SAMPLE_BITS = (1, 2, 4, 8, 16, 32)
#: Width of the rows that text payloads are laid out in, and bytes of a strip.
ROW_BYTES, STRIP_BYTES = 64, 1 << 16


class TiffError(ValueError):
    pass


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[at]))
            at += run
            continue
        end = at + 1
        while end < len(data) and end - at < 128 and not (end + 1 < len(data) and data[end] == data[end + 1]):
            end += 1
        out.append(end - at - 1)
        out += data[at:end]
        at = end
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Most significant bit first; codes widen one code early, as TIFF has it."""
    table: list[bytes] = [bytes((b,)) for b in range(256)] + [b"", b""]
    out, buffer, bits, width, last, at = bytearray(), 0, 0, 9, b"", 0
    while len(out) < size:
        while bits < width and at < len(data):
            buffer, bits, at = buffer << 8 | data[at], bits + 8, at + 1
        if bits < width:
            break
        bits -= width
        code = buffer >> bits
        buffer &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise TiffError("LZW code out of range")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, buffer, bits = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    width = 9

    def emit(code: int) -> None:
        nonlocal buffer, bits
        buffer, bits = buffer << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(buffer >> bits & 255)
        buffer &= (1 << bits) - 1

    def reset() -> None:
        table.clear()
        table.update({bytes((b,)): b for b in range(256)})

    emit(256)
    reset()
    next_, prefix = 258, b""
    for b in data:
        grown = prefix + bytes((b,))
        if grown in table:
            prefix = grown
            continue
        emit(table[prefix])
        table[grown] = next_
        next_ += 1
        # The reader's table is one entry behind, and widens one code early.
        width = 9 if next_ - 1 < 511 else 10 if next_ - 1 < 1023 else 11 if next_ - 1 < 2047 else 12
        prefix = bytes((b,))
        if next_ - 1 == 4093:
            emit(256)
            reset()
            next_, width = 258, 9
            # The byte in hand starts the new table.
    if prefix:
        emit(table[prefix])
        width = 9 if next_ < 511 else 10 if next_ < 1023 else 11 if next_ < 2047 else 12
    emit(257)
    if bits:
        out.append(buffer << 8 - bits & 255)
    return bytes(out)


def _inflate(data: bytes, size: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, size)
    except zlib.error as e:
        raise TiffError(f"deflate: {e}") from None


DECODERS = {PLAIN: lambda data, size: data, LZW: lzw_decode, DEFLATE: _inflate, OLD_DEFLATE: _inflate, PACKBITS: unpack_bits}
ENCODERS = {PLAIN: bytes, LZW: lzw_encode, DEFLATE: lambda data: zlib.compress(data, 1), PACKBITS: pack_bits}


def _pack(block: np.ndarray, bits: int, order: str) -> bytes:
    """The bytes of ``rows x width x depth`` samples; a row of less than 8 bits a sample ends at a byte."""
    if bits >= 8:
        return block.astype(f"{order}u{bits // 8}").tobytes()
    flat = block.reshape(len(block), -1)
    return np.packbits((flat[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8) & 1).reshape(len(block), -1), axis=1).tobytes()


def _unpack(data: bytes, rows: int, width: int, depth: int, bits: int, order: str) -> np.ndarray:
    if bits >= 8:
        return np.frombuffer(data, f"{order}u{bits // 8}", rows * width * depth).reshape(rows, width, depth).astype(f"<u{bits // 8}")
    each = np.unpackbits(np.frombuffer(data, np.uint8, rows * _row_bytes(width, depth, bits)).reshape(rows, -1), axis=1)
    values = each.reshape(rows, -1, bits) @ (1 << np.arange(bits - 1, -1, -1)).astype(np.uint8)
    return values[:, : width * depth].reshape(rows, width, depth).astype(np.uint8)


def _row_bytes(width: int, depth: int, bits: int) -> int:
    return (width * depth * bits + 7) // 8


def encode_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, strip_bytes: int = STRIP_BYTES, tile: tuple[int, int] | None = None, order: str = "<", planar: bool = False, bits: int | None = None) -> bytes:
    """A file of pages ``height x width (x samples)``, in strips or in tiles of ``(height,
    width)``, each plane by itself if ``planar``. Samples have the bits of their type, or
    ``bits``. Equal pages give equal bytes."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        page = np.ascontiguousarray(page if page.ndim == 3 else page[:, :, None])
        height, width, samples = page.shape
        deep = bits or 8 * page.dtype.itemsize
        planes = [page[:, :, k : k + 1] for k in range(samples)] if planar else [page]
        blocks = []
        for plane in planes:
            if tile:
                th, tw = tile
                padded = np.zeros((-(-height // th) * th, -(-width // tw) * tw, plane.shape[2]), page.dtype)
                padded[:height, :width] = plane
                blocks += [padded[y : y + th, x : x + tw] for y in range(0, padded.shape[0], th) for x in range(0, padded.shape[1], tw)]
            else:
                rows = max(1, strip_bytes // _row_bytes(width, plane.shape[2], deep))
                blocks += [plane[y : y + rows] for y in range(0, height, rows)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
            data = ENCODERS[compression](_pack(block, deep, order))
            out += b"\0" * (len(out) & 1)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        layout = [(TILE_WIDTH, 4, [tile[1]]), (TILE_HEIGHT, 4, [tile[0]]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows]), (STRIP_COUNTS, 4, counts)]
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [deep] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [2 if planar else 1]), (PREDICTOR, 3, [predictor]), *layout]
        entries = []
        for tag, kind, values in sorted(fields):
            data = struct.pack(f"{order}{len(values)}{FIELD_FORMATS[kind]}", *values)
            if len(data) > 4:
                out += b"\0" * (len(out) & 1)
                at, data = len(out), data
                out += data
                data = struct.pack(order + "I", at)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
        out += b"\0" * (len(out) & 1)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    """Fields and the place of the next directory. A field beyond the file is left out: the page may do without it."""
    fields: dict[int, tuple[int, ...]] = {}
    (n,) = struct.unpack_from(order + "H", data, at)
    (after,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    for k in range(n):
        entry = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        if kind not in FIELD_FORMATS:
            continue  # text, rationals and such: nothing that decoding needs
        size = FIELD_BYTES[kind] * count
        where = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
        if where + size <= len(data):
            fields[tag] = struct.unpack_from(f"{order}{count}{FIELD_FORMATS[kind]}", data, where)
    return fields, after


def _page(data: bytes, f: dict[int, tuple[int, ...]], order: str) -> np.ndarray:
    one = lambda tag, default=None: (f.get(tag) or (default,))[0]
    width, height, samples, deep = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), set(f.get(BITS, (1,)))
    if not width or not height or not samples:
        raise TiffError("page without a size")
    if len(deep) != 1 or not deep <= set(SAMPLE_BITS):
        raise TiffError("samples of unknown or of several sizes")
    (bits,) = deep
    compression, predictor = one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
    decode = DECODERS.get(compression)
    if decode is None or predictor not in (1, 2) or predictor == 2 and bits < 8:
        raise TiffError("unknown compression or predictor")
    planes = samples if one(PLANAR, 1) == 2 else 1
    depth = samples // planes
    tiled = TILE_OFFSETS in f
    bh, bw = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, height), height), width)
    offsets, counts = (f.get(TILE_OFFSETS), f.get(TILE_COUNTS)) if tiled else (f.get(STRIP_OFFSETS), f.get(STRIP_COUNTS))
    down, across = -(-height // bh) if bh else 0, -(-width // bw) if bw else 0
    if not offsets or not counts or not down or not across or len(offsets) != len(counts) or len(offsets) != down * across * planes:
        raise TiffError("strips or tiles don't cover the page")
    row = _row_bytes(bw, depth, bits)
    if any(at + n > len(data) for at, n in zip(offsets, counts, strict=True)):
        raise TiffError("strip or tile reaches beyond the file")
    for k, n in enumerate(counts):
        rows = bh if tiled else min(bh, height - k % down * bh)
        if rows * row > EXPANSION[compression] * n:
            raise TiffError("strip or tile is too short")
    page = np.empty((height, width, samples), f"<u{max(bits, 8) // 8}")
    for k, (at, n) in enumerate(zip(offsets, counts, strict=True)):
        plane, rest = divmod(k, down * across)
        y, x = rest // across * bh, rest % across * bw
        rows = bh if tiled else min(bh, height - y)
        block = decode(data[at : at + n], rows * row)
        if len(block) < rows * row:
            raise TiffError("strip or tile is too short")
        block = _unpack(block, rows, bw, depth, bits, order)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        h, w = min(rows, height - y), min(bw, width - x)
        page[y : y + h, x : x + w, plane * depth : (plane + 1) * depth] = block[:h, :w]
    return page


def walk_tiff(data: bytes) -> Iterator[tuple[int | None, np.ndarray | TiffError]]:
    """Number and samples of each page, one at a time, or what is wrong with it; the
    number is None where the chain of directories breaks."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        yield None, TiffError("not a TIFF file")
        return
    order = "<" if data[:2] == b"II" else ">"
    version, at = struct.unpack_from(order + "HI", data, 2)
    if version != 42 or not at:
        yield None, TiffError("not a TIFF file" if version != 42 else "no directory")
        return
    seen: set[int] = set()
    while at:
        if at in seen:
            yield None, TiffError("the chain of directories returns to itself")
            return
        seen.add(at)
        try:
            fields, at = _directory(data, at, order)
        except struct.error:
            yield None, TiffError("directory reaches beyond the file")
            return
        try:
            page = _page(data, fields, order)
        except TiffError as e:
            page = e
        yield len(seen) - 1, page


def decode_tiff(data: bytes) -> Iterator[np.ndarray]:
    """The pages of a file, one at a time; raises at the first that is broken."""
    for _, page in walk_tiff(data):
        if isinstance(page, TiffError):
            raise page
        yield page


def feature(samples: np.ndarray) -> str:
    """Mean and deviation of the samples, and a coarse histogram of 8 bins: from exact integer sums."""
    if samples.dtype.itemsize > 1:
        samples = (samples >> 8 * (samples.dtype.itemsize - 1)).astype(np.uint8)  # the highest byte
    counts = np.bincount(samples.ravel(), minlength=256)
    n, values = int(counts.sum()), np.arange(256)
    s, q = int(counts @ values), int(counts @ (values * values))
    bins = counts.reshape(8, 32).sum(axis=1) * 1000 // n
    return f"{s * 1000 // n}/{(q * n - s * s) * 1000 // (n * n)}/" + ".".join(map(str, bins))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes filled with zeros to a positive multiple of ``ROW_BYTES``, and their own number."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * (-len(data) % ROW_BYTES if data else ROW_BYTES), len(data)


def text_images(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", compression: int = DEFLATE, predictor: int = 1) -> DataFrame:
    """``id, n_bytes, media``: each whole text as a one-page image of 64 samples a row. A null text is empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, media = [], []
                for text in part.column(1):
                    data, size = payload_of(text.as_py())
                    n.append(size)
                    media.append(encode_tiff([np.frombuffer(data, np.uint8).reshape(-1, ROW_BYTES)], compression, predictor))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(encode, "id long, n_bytes long, media binary")


PAGE_SCHEMA = "id long, n_bytes long, page int, width int, height int, samples_per_pixel int, samples binary, media_bytes long, media_sha256 string, feature string, error string"


def read_pages(media: DataFrame, digest_tail: int | None = None) -> DataFrame:
    """One row for each page of ``id, n_bytes, media``; a null file gives a row with an error.

    With ``digest_tail``, ``samples`` holds, instead of all samples, their SHA-256 and
    the CRC-32 of the last ``digest_tail``, and ``payload_bytes`` counts them.
    """

    def rows(i, n, data):
        if data is None:
            yield (i, n, None, None, None, None, None, 0, None, None, "no file")
            return
        own = len(data), hashlib.sha256(data).hexdigest()
        for k, page in walk_tiff(data):
            if isinstance(page, TiffError):
                yield (i, n, k, None, None, None, None, *own, None, str(page))
                continue
            raw = page.tobytes()
            kept = raw if digest_tail is None else hashlib.sha256(raw).digest() + struct.pack("<IQ", zlib.crc32(raw[-digest_tail:]), len(raw))
            yield (i, n, k, page.shape[1], page.shape[0], page.shape[2], kept, *own, feature(page), None)

    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            held: list[tuple] = []
            size = 0
            for i, n, data in zip(ids, ns, batch.column(2), strict=True):
                for row in rows(i, n, data.as_py()):
                    held.append(row)
                    size += len(row[6] or b"")
                    if size > 1 << 24 or len(held) >= 1024:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return media.select("id", "n_bytes", "media").mapInArrow(read, PAGE_SCHEMA)


def digests(media: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature`` from the stored bytes."""
    s = F.hex("samples")
    little = lambda at, n: F.conv(F.concat(*(F.substring(s, at + 2 * k, 2) for k in reversed(range(n)))), 16, 10).cast("long")
    return read_pages(media, digest_tail=64).select(F.col("id").alias("doc_id"), "n_bytes", little(73, 8).alias("payload_bytes"), F.lower(F.substring(s, 1, 64)).alias("payload_sha256"), little(65, 4).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")
