import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import decontamination as dec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CASE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(CASE))


def plain(docs, items, size=10, slop=2):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add("null" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, exact, near = words(text), set(), set(), set()
        for x, of in windows.items():
            k = len(x)
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) == x:
                    hit |= set(range(s, s + k))
                    exact |= of
            need = Counter(x)
            if any(w[s] in need and not need - Counter(w[s : s + k + slop]) for s in range(len(w))):
                near |= of
        out.append((i, len(w), len(hit), len(exact), len(near), sorted(exact), bool(hit)))
    return out


def same(spark, docs, items, **more):
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, term string, pos int").repartition(3)
    tests = spark.createDataFrame([(*x, 4) for x in items], "item_id long, text string, doc_id int")
    got = dec.contamination(df, tests, **more)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "n_near_items", "items", "contaminated"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain(docs, items, **more)))


def corpus(seed):
    rng = random.Random(seed)
    pool = ["the", "The", "of", "é", "É", "x1"] * 6 + [f"w{k}" for k in range(30)]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(k, text(rng.choice([3, 9, 10, 14]))) for k in range(12)] + [(2, text(12)), (None, text(10)), (50, None), (51, ""), (52, "--"), (53, "single"), (54, "the the the the the the the the the the the the"), (55, "never seen words at all")]
    docs = []
    for k in range(120):
        parts = [text(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "x").split()
            change = rng.randrange(4)
            if change == 1:
                rng.shuffle(w)
            if change == 2 and w:
                w.insert(rng.randrange(len(w)), "extra")
            if change == 3 and w:
                w.pop()
            parts += [", ".join(w), text(rng.randrange(5))]
        docs.append((k, "\n".join(parts)))
    docs += [(None, items[0][1]), (None, None), (3, ""), (3, items[1][1]), (3, items[1][1]), (-9, "the " * 300), (10**12, f"{text(2000)} {items[4][1]} {text(2000)}")]
    return docs, items


@pytest.mark.parametrize(("seed", "more"), [(1, {}), (2, {"size": 4, "slop": 0}), (3, {"size": 1}), (4, {"size": 6, "slop": 9})])
def test_against_all_places(spark, seed, more):
    same(spark, *corpus(seed), **more)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(dec, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(dec, "STRETCH", 5)
    same(spark, *corpus(5))


def test_no_rows(spark):
    docs, items = corpus(6)
    same(spark, [], items)
    same(spark, docs[:20], [])
    same(spark, [], [])


def test_the_whole_index(spark):
    docs = spark.createDataFrame([(1, "B a, b"), (2, None), (3, "C")], "doc_id long, text string")
    terms = dec.terms_of(docs)
    index = dec.build_index(docs, terms).join(terms, "term", "left")
    got = sorted((r.doc_id, r.word or "", r.pos) for r in index.collect())
    assert got == [(1, "", 3), (1, "a", 1), (1, "b", 0), (1, "b", 2), (2, "", 0), (3, "", 1), (3, "c", 0)]


def test_matches_name_place_and_kind(spark):
    docs = spark.createDataFrame([(1, "x one two three y"), (2, "three q two one"), (3, "one two q q q three")], "doc_id long, text string")
    tests = spark.createDataFrame([(7, "one two three")], "item_id long, text string")
    terms = dec.terms_of(tests)
    index = dec.build_index(docs, terms)
    phrases, _ = dec.phrases_of(tests)
    found = dec.matches(index, dec.plans(phrases, terms, index), slop=1).join(index.where("term is null").select("row", "doc_id"), "row")
    got = {r.doc_id: (r.exact, r.start if r.exact else None) for r in found.select("doc_id", "exact", F.col("start")).collect()}
    assert got == {1: (True, 1), 2: (False, None)}
