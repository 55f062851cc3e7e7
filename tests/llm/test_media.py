import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from millrace.llm import media

RNG = random.Random(9)


def image(h, w, s, kind):
    r = np.random.default_rng(h * w + s)
    return r.integers(0, 256, (h, w, s), np.uint8) if kind == "noise" else np.tile(np.arange(w, dtype=np.uint8)[None, :, None] // 3, (h, 1, s))


@pytest.mark.parametrize("compression", [media.PLAIN, media.PACKBITS, media.LZW, media.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("order", ["<", ">"])
def test_round_trip(compression, predictor, order):
    for kind in ("noise", "smooth"):
        pages = [image(h, w, s, kind) for h, w, s in ((1, 1, 1), (70, 33, 3), (130, 64, 1))]
        for tile in (None, (16, 32)):
            data = media.encode_tiff(pages, compression, predictor, 500, tile, order)
            got = list(media.decode_tiff(data))
            assert len(got) == 3 and all((a == b).all() for a, b in zip(got, pages, strict=True))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 127, 128, 129, 130, 255, 256, 257, 700, 3836, 3837, 3838, 3839, 20000, 60000])
def test_codecs_at_their_edges(n):
    for data in (bytes(RNG.randrange(256) for _ in range(n)), b"a" * n, bytes(RNG.choice(b"ab") for _ in range(n))):
        assert media.lzw_decode(media.lzw_encode(data), n) == data
        assert media.unpack_bits(media.pack_bits(data), n) == data


def test_planar_pages_and_broken_files():
    page = image(4, 6, 1, "noise")
    whole = media.encode_tiff([page, page])
    for cut in range(0, len(whole), 7):
        with pytest.raises(media.TiffError):
            list(media.decode_tiff(whole[:cut]))
    looped = bytearray(media.encode_tiff([page], media.PLAIN))
    (first,) = struct.unpack_from("<I", looped, 4)
    looped[-4:] = struct.pack("<I", first)
    with pytest.raises(media.TiffError, match="itself"):
        list(media.decode_tiff(bytes(looped)))


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression", [media.PLAIN, media.PACKBITS, media.LZW, media.DEFLATE])
def test_planes_and_sample_sizes(compression, order):
    r = np.random.default_rng(4)
    for bits in media.SAMPLE_BITS:
        pages = [r.integers(0, 1 << bits, size, f"u{max(bits, 8) // 8}") for size in ((7, 13, 1), (20, 9, 3))]
        for planar in (False, True):
            for tile in (None, (8, 16)):
                for predictor in (1, 2) if bits >= 8 else (1,):
                    got = list(media.decode_tiff(media.encode_tiff(pages, compression, predictor, 40, tile, order, planar, bits)))
                    assert len(got) == 2 and all((a == b).all() for a, b in zip(got, pages, strict=True))
    with pytest.raises(media.TiffError):
        list(media.decode_tiff(media.encode_tiff([pages[0]], bits=32).replace(struct.pack("<HHIHH", 258, 3, 1, 32, 0), struct.pack("<HHIHH", 258, 3, 1, 24, 0))))


def test_pages_after_a_broken_one_are_read(spark):
    pages = [image(9, 9, 1, "noise") for _ in range(3)]
    data = bytearray(media.encode_tiff(pages, media.DEFLATE))
    (first,) = struct.unpack_from("<I", data, 4)
    (n,) = struct.unpack_from("<H", data, first)
    (second,) = struct.unpack_from("<I", data, first + 2 + 12 * n)
    entries = {struct.unpack_from("<H", data, second + 2 + 12 * k)[0]: second + 2 + 12 * k for k in range(n)}
    (strip,) = struct.unpack_from("<I", data, entries[media.STRIP_OFFSETS] + 8)
    damaged, huge, astray = bytearray(data), bytearray(data), bytearray(data)
    damaged[strip + 2 : strip + 12] = b"\xff" * 10
    struct.pack_into("<I", huge, entries[media.HEIGHT] + 8, 0xFFFFFFF0)
    struct.pack_into("<I", astray, entries[media.STRIP_OFFSETS] + 8, 0xFFFFFF)
    df = spark.createDataFrame([(k, 0, x) for k, x in enumerate((data, damaged, huge, astray))], "id long, n_bytes long, media binary")
    rows = media.read_pages(df).collect()
    for k in range(4):
        own = {r.page: r for r in rows if r.id == k}
        assert set(own) == {0, 1, 2} and (own[1].error is None) == (k == 0)
        assert bytes(own[0].samples) == pages[0].tobytes() and bytes(own[2].samples) == pages[2].tobytes()


def test_texts(spark):
    data = [(1, None), (2, ""), (3, "a" * 64), (4, "a" * 65), (5, "é🙂" * 500), (6, "x" * 200_000), (7, "same"), (8, "same"), (None, "null id")]
    df = spark.createDataFrame([(*x, "clash") for x in data], "doc_id long, text string, media string")
    got = {(r.doc_id): r for r in media.digests(media.text_images(df)).collect()}
    assert len(got) == len(data)
    for i, t in data:
        raw = (t or "").encode()
        padded = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert tuple(got[7])[1:] == tuple(got[8])[1:] and tuple(got[1])[1:] == tuple(got[2])[1:]
    assert media.digests(media.text_images(df.limit(0))).count() == 0


def test_one_row_for_each_page(spark):
    pages = [image(5, 5, 1, "noise"), image(2, 9, 3, "smooth")]
    df = spark.createDataFrame([(1, 0, bytearray(media.encode_tiff(pages, media.LZW))), (2, 0, bytearray(b"II*\0junk")), (3, 0, None)], "id long, n_bytes long, media binary")
    rows = media.read_pages(df).collect()
    assert [(r.page, r.width, r.height, r.samples_per_pixel, bytes(r.samples)) for r in rows if r.id == 1] == [(k, p.shape[1], p.shape[0], p.shape[2], p.tobytes()) for k, p in enumerate(pages)]
    assert all(r.error and r.page is None for r in rows if r.id != 1)
