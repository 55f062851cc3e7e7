import random
import struct
import zlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import encoding, packing, token_archive
from millrace.llm.common import new_path
from millrace.llm.queries import vocabulary

ODD = ["", " ", "\n\n a", "a  b\n\nc ", "x\t y\r\n z", "<|endoftext|> hi<|endoftext|>x", "é é ́x", "don't  'S  it's", "　 a b", "日本語 text🙂 🙂", "a\x1c b\x85 c", "A" * 5000 + " b", "1234 567\n89", "\t\n", "end ", "İstanbul ΣΑΣ Σ"]


@pytest.mark.parametrize(("name", "keeps"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_units_give_the_tokenizers_ids(name, keeps):
    plain, enc = Tokenizer.from_file(vocabulary(name)), encoding.Encoder(vocabulary(name), keeps)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["a", "Be", " ", "\n", "\t", "é", "'s", "9", "🙂", "_", " ", "."]) for _ in range(60)) for _ in range(400)]
    for t in texts:
        ids = plain.encode(t, add_special_tokens=False).ids
        assert enc.encode(t) == struct.pack(f"<{len(ids)}I", *ids), repr(t)


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_a_tokenizer_that_units_do_not_fit_gets_whole_texts(name, keeps):
    plain, enc = Tokenizer.from_file(vocabulary(name)), encoding.Encoder(vocabulary(name), keeps)
    assert not enc.cut
    for t in ODD:
        ids = plain.encode(t, add_special_tokens=False).ids
        assert enc.encode(t) == struct.pack(f"<{len(ids)}I", *ids), repr(t)
    assert encoding.Encoder(vocabulary(name), not keeps).cut


def rows(spark):
    data = [(k, t) for k, t in enumerate(ODD)] + [(100, None), (None, "null id"), (3, ODD[3]), (-5, "neg")]
    return spark.createDataFrame([(*x, "clash") for x in data], "doc_id long, text string, start string"), data


def test_archive_round_trip(spark):
    df, data = rows(spark)
    path, name = new_path(spark, "t"), vocabulary("word_bpe_49k.json")
    token_archive.write_archive(df, path, name)
    plain, at, want = Tokenizer.from_file(name), 0, []
    for i, t in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids))
        at += len(ids)
    key = lambda r: r[1]
    assert sorted([tuple(r)[:4] for r in token_archive.read_digests(spark, path).collect()], key=key) == [w[:4] for w in want]
    assert [r.ids for r in sorted(token_archive.read_archive(spark, path).collect(), key=key)] == [w[4] for w in want]
    assert {(r.doc_id, tuple(r.ids)) for r in token_archive.read_documents(spark, path, [3, -5, 999]).collect()} == {(w[0], tuple(w[4])) for w in want if w[0] in (3, -5)}


def test_archive_of_nothing_and_broken_files(spark):
    path = new_path(spark, "t")
    token_archive.write_archive(spark.createDataFrame([], "doc_id long, text string"), path, vocabulary("word_bpe_49k.json"))
    assert token_archive.read_digests(spark, path).count() == 0
    block = token_archive.pack_block(0, 0, [(7, b"x", b"\1\0\0\0")], b"\0" * 32)
    for broken in (block, block[:40] + b"!" + block[41:] + b"MRTE", b""):
        with pytest.raises(token_archive.ArchiveError):
            token_archive.Block(broken, b"")


def test_many_rows_of_one_id_are_dealt_out(spark):
    """Rows of a null id or one id go to several files, still in order."""
    df = spark.range(900).selectExpr("if(id < 300, null, if(id < 600, 7L, id)) doc_id", "concat('text ', id) text")
    path, name = new_path(spark, "t"), vocabulary("word_bpe_49k.json")
    token_archive.write_archive(df, path, name, shards=9)
    got = token_archive._with_start(token_archive._decoded(spark, path, False)).orderBy("start").collect()
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert len(got) == 900 and order == sorted(order)
    assert len({r.shard for r in got if r.doc_id is None}) > 1 and len({r.shard for r in got if r.doc_id == 7}) > 1


def test_short_document_access_uses_the_dictionary():
    import hashlib

    import zstandard

    docs = [struct.pack("<50I", *[(k * j) % 50 + 300 for j in range(50)]) for k in range(400)]
    d = zstandard.train_dictionary(4096, docs).as_bytes()
    z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d))
    b = token_archive.Block(token_archive.pack_block(1, 2, [(k, z.compress(x), x) for k, x in enumerate(docs)], hashlib.sha256(d).digest()) + b"MRTE", d)
    assert b.ids(17) == docs[17] and b.ids(399) == docs[399]


def test_packing_covers_every_token_without_padding():
    rng = random.Random(3)
    for lengths in ([], [1], [2048], [2047, 2], [5000, 3, 3, 700], [rng.choice([1, 5, 90, 300, 700, 1500, 2048, 2100, 9000]) for _ in range(300)]):
        windows, seen = packing.pack_chunk(lengths), {}
        for width, pieces in windows:
            assert sum(p[2] for p in pieces) == width <= 2048 and width & (width - 1) == 0
            for d, a, n in pieces:
                assert n > 0
                seen.setdefault(d, []).append((a, n))
        for d, n in enumerate(lengths):
            at = 0
            for a, m in sorted(seen[d]):
                assert a == at
                at += m
            assert at == n
        groups = packing.step_groups(windows)
        tiers = {}
        for (w, _), g in zip(windows, groups, strict=True):
            tiers.setdefault(g, set()).add(w)
        assert all(len(v) == 1 for v in tiers.values())


def test_packing_rows(spark):
    df, data = rows(spark)
    name = vocabulary("byte_bpe_50k.json")
    got = packing.pack_documents(df, name, keep_ids=True).collect()
    plain = Tokenizer.from_file(name)
    want = sorted(tuple([*plain.encode(t or "", add_special_tokens=False).ids, 1]) for _, t in data)
    by_sequence = {}
    for r in got:
        assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *r.ids))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length, r.context))
    for pieces in by_sequence.values():
        at = 0
        for o, n, context in sorted(pieces):
            assert o == at
            at += n
        assert at == context
    assert sum(r.length for r in got) == sum(map(len, want))
    whole = {}
    for r in sorted(got, key=lambda r: r.start):
        whole.setdefault((r.doc_id, r.doc_tokens), []).extend(r.ids)
    assert {tuple(v) for k, v in whole.items() if k[0] != 3} <= set(want)
    assert packing.pack_documents(df.limit(0), name).count() == 0


def test_a_worker_remembers_few_units_and_gives_the_same_rows(spark):
    def rows(max_units):
        found = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), max_units=max_units)
        return sorted(map(tuple, found.collect()))

    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{n}" for n in range(40))) for k in range(60)], "doc_id long, text string").coalesce(1)
    assert rows(100) == rows(encoding.MAX_UNITS)
    enc = encoding.Encoder(vocabulary("byte_bpe_50k.json"), True, 100)
    for k in range(60):
        enc.encode(" ".join(f"w{k}x{n}" for n in range(40)))
        assert len(enc.units) <= 100 + 3 * 40
    assert corpus_pipeline.UNITS < encoding.MAX_UNITS
