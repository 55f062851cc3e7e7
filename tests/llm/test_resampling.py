import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from millrace.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ngrams(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, percent=10, least=20, n=1, buckets=10_000, seed="2024"):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in ngrams(x, n)[1]) for texts in ([x for _, x in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, text in docs:
        words, features = ngrams(text, n)
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in features)
        out.append([i, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[5] = k
    return [(i, f, w, sc, r) for i, _, f, w, sc, r in out]


def corpus(seed, docs=300):
    rng = random.Random(seed)
    common, rare = ["the", "The", "de", "été", "É", "x9"], [f"w{k}" for k in range(60)]
    text = lambda: "".join(rng.choice(common if rng.random() < 0.7 else rare) + rng.choice([" ", ", ", "\n", "-", "_", " "]) for _ in range(rng.choice([0, 5, 19, 20, 21, 80])))
    rows = [(k, text()) for k in range(docs)] + [(None, None), (None, "a " * 30), (7, "again " * 25), (7, "again " * 25), (-3, ""), (10**12, "long " * 4000 + "é" * 3000)]
    return rows, [text() for _ in range(9)] + [None, ""]


@pytest.mark.parametrize(("n", "buckets", "percent", "block"), [(1, 10_000, 10, 8 << 20), (1, 7, 50, 300), (3, 1000, 33, 2000), (2, 1_000_000, 100, 1)])
def test_against_counters(spark, monkeypatch, n, buckets, percent, block):
    monkeypatch.setattr(resampling, "BLOCK_BYTES", block)
    docs, target = corpus(n)
    df = spark.createDataFrame([(*d, 1, "clash") for d in docs], "doc_id long, text string, weight int, block string").repartition(3)
    aims = spark.createDataFrame([(t, 2) for t in target], "text string, doc_id int")
    got = resampling.resample(df, aims, percent=percent, n=n, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain(docs, target, percent, n=n, buckets=buckets)))


def test_no_rows_and_no_target(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(empty, empty).collect() == []
    docs, _ = corpus(5, 40)
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), empty.select("text"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain(docs, [])))


def test_each_distinct_tuple_is_hashed_once(spark):
    docs = spark.createDataFrame([(k, "same words here and same words there") for k in range(50)], "id long, text string").repartition(5)
    blocks = resampling.coded_blocks(docs, False).cache()
    words = resampling.dictionary(blocks)
    assert sorted(r.word for r in words.collect()) == ["and", "here", "same", "there", "words"]
    ids = {r.word: r.id for r in words.collect()}
    tuples = spark.createDataFrame([([ids["same"], ids["words"]],), ([ids["and"]],)], "tuple array<long>")
    got = {tuple(r.tuple): r.bucket for r in resampling.tuple_buckets(tuples, words, 2, 10_000).collect()}
    assert got == {(ids["same"], ids["words"]): zlib.crc32(b"same words") % 10_000, (ids["and"],): zlib.crc32(b"and") % 10_000}


@pytest.mark.parametrize("size", [1, 3, 10, 1 << 20])
def test_words_of_pieces(monkeypatch, size):
    monkeypatch.setattr(resampling, "PIECE_BYTES", size)
    for text in ("", "a", "Ab cD", "é é_É", "x" * 40 + " y" * 9, " -- ", "日本 語9🙂z"):
        assert [w.decode() for p in resampling.words_of(text) for w in p] == ngrams(text, 1)[0]
