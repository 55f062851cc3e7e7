import random
from fractions import Fraction

import pytest

from millrace.llm import ngram_join


def shingles(t):
    w = (t or "").encode().split()
    n = min(5, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()


def brute(data):
    """doc_id -> (class_id, copy_of, n_links), by all pairs."""
    sets = [shingles(t) for _, t in data]
    parent = list(range(len(data)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = [0] * len(data)
    for a in range(len(data)):
        for b in range(a):
            if data[a][0] is None or data[b][0] is None or data[a][1] is None or data[b][1] is None:
                continue
            x, y = sets[a], sets[b]
            if data[a][1] == data[b][1] or x and y and Fraction(len(x & y), len(x | y)) >= Fraction(4, 5):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    out = []
    for k, (i, t) in enumerate(data):
        if i is None or t is None:
            out.append((i, i, i, 0))
            continue
        out.append((i, min(data[j][0] for j in range(len(data)) if root(j) == root(k)), min(j for j, u in data if u == t and j is not None), links[k]))
    return sorted(out, key=str)


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 5)))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rng.choice([6, 30, 80, 200]))]
        if rng.random() < 0.4:
            base = base[:10] + passage + base[10:]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    hub = [word() for _ in range(120)]
    for _ in range(40):
        copy = list(hub)
        copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    texts += [texts[0]] * 6 + ["", "", " ", "one two", "one two", "one  two", None, None]
    rng.shuffle(texts)
    return [(k * 3, t) for k, t in enumerate(texts)] + [(None, "one two"), (None, None)]


@pytest.mark.parametrize("limit", [1000, 12])
def test_against_all_pairs(spark, limit, monkeypatch):
    monkeypatch.setattr(ngram_join, "NODE_DOCS", limit)
    data = corpus(random.Random(11))
    df = spark.createDataFrame([(*x, "clash") for x in data], "doc_id long, text string, key string")
    got = sorted([tuple(r) for r in ngram_join.links(df).collect()], key=str)
    assert got == brute(data)


@pytest.mark.parametrize("limit", [1000, 12])
def test_one_document_of_each_class_stays(spark, limit, monkeypatch):
    monkeypatch.setattr(ngram_join, "NODE_DOCS", limit)
    data = corpus(random.Random(12))
    data += [(data[3][0], data[3][1])] * 2 + [(1_000_000, "first text under one id"), (1_000_000, "second text under one id, quite another")]
    df = spark.createDataFrame([(*x, "clash", "a", b"b", "c") for x in data], "doc_id long, text string, key string, __id string, __digest binary, row string")
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert kept.select("key", "__id", "__digest", "row").distinct().collect() == [("clash", "a", b"b", "c")]
    want = [*{c for i, c, _, _ in brute(data) if i is not None}, 1_000_000]
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 2


def test_a_large_group_and_a_common_passage(spark, monkeypatch):
    """Pairs in large nodes: near copies that are all alike, others at the threshold, and texts that share a passage only."""
    monkeypatch.setattr(ngram_join, "NODE_DOCS", 25)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 6)))
    hub, passage = [word() for _ in range(110)], [word() for _ in range(60)]
    texts = []
    for _ in range(120):
        copy = list(hub)
        for _ in range(rng.choice([1, 1, 2])):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    for _ in range(150):
        texts.append(" ".join([*passage, *(word() for _ in range(60))]))
        if rng.random() < 0.3:
            copy = texts[-1].split()
            copy[rng.randrange(60, len(copy))] = word()
            texts.append(" ".join(copy))
    data = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted([tuple(r) for r in ngram_join.links(df).collect()], key=str)
    want = brute(data)
    found, there = sum(r[3] for r in got), sum(r[3] for r in want)
    assert there > 4000 and there * 0.999 <= found <= there
    assert [r[:3] for r in got] == [r[:3] for r in want]
    kept = sorted(r.doc_id for r in ngram_join.keep_one(df).collect())
    assert kept == sorted({r[1] for r in want})


@pytest.mark.parametrize("method", ["keep_one", "links"])
def test_rows_of_a_group_of_near_copies(spark, method, monkeypatch):
    """Classes cost rows in proportion to a group, not one for each block that a document meets."""
    monkeypatch.setattr(ngram_join, "NODE_DOCS", 25)
    rng, m = random.Random(8), 300
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(4, 7)))
    hub, texts = [word() for _ in range(160)], []
    for _ in range(m):
        copy = list(hub)
        copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    met, edges = [], []
    roles, components = ngram_join._roles, ngram_join._components

    def counted_roles(*args):
        rows, stars = roles(*args)
        met.append(sum(r.upto for r in rows.select("upto").collect()))
        return rows, stars

    def counted_components(rows):
        edges.append(rows.distinct().count())
        return components(rows)

    monkeypatch.setattr(ngram_join, "_roles", counted_roles)
    monkeypatch.setattr(ngram_join, "_components", counted_components)
    data = list(enumerate(texts))
    rows = getattr(ngram_join, method)(spark.createDataFrame(data, "doc_id long, text string")).collect()
    if method == "keep_one":
        assert [r.doc_id for r in rows] == [0]
        assert max(met) <= m
    else:
        assert sorted(map(tuple, rows), key=str) == brute(data)
    assert max(edges) <= 2 * m


@pytest.mark.parametrize("method", ["keep_one", "links"])
def test_a_group_that_stays_together_is_not_split(spark, method, monkeypatch):
    """Near copies of one text that are seldom linked to each other: no document is dealt to children of nodes that are left whole."""
    monkeypatch.setattr(ngram_join, "NODE_DOCS", 25)
    rng, m = random.Random(9), 300
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(4, 7)))
    hub, texts = [word() for _ in range(160)], []
    for _ in range(m):
        copy = list(hub)
        for at in rng.sample(range(160), 2):
            copy[at] = word()
        texts.append(" ".join(copy))
    made, staged = [], ngram_join.staged

    def counted(rows, name):
        out = staged(rows, name)
        if name == "join-split":
            made.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "staged", counted)
    data = list(enumerate(texts))
    want = brute(data)
    assert 0 < sum(r[3] for r in want) < m * m / 2
    rows = getattr(ngram_join, method)(spark.createDataFrame(data, "doc_id long, text string")).collect()
    if method == "links":
        assert sorted(map(tuple, rows), key=str) == want
    else:
        assert sorted(r.doc_id for r in rows) == sorted({r[1] for r in want})
    assert sum(made) <= m


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.links(df).count() == 0 == ngram_join.keep_one(df).count()


def test_recall_of_pairs_at_the_threshold():
    import numpy as np

    rng, missed, runs = np.random.default_rng(0), 0, ngram_join.runs_for(0.9999)
    for _ in range(4000):
        n = 90
        g = rng.integers(0, 2**64, 10 * n // 9, dtype=np.uint64, endpoint=False)
        a, b = np.unique(g[:n]), np.unique(g[len(g) - n :])
        missed += len(np.intersect1d(ngram_join.root_nodes(a, runs, 0.8), ngram_join.root_nodes(b, runs, 0.8))) < 2
    assert missed <= 3
