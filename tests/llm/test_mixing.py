import random
import re

import pytest

from millrace.llm import mixing

WS = re.compile(r"[\x20\x09-\x0D]+")


def size(t):
    return len([w for w in WS.split(t or "") if w])


def water(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def check(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string, source string, hash string")
    rows = mixing.mix(df).collect()
    assert len(rows) == len(data)
    sizes, taken = {}, {}
    for _, t, s, _ in data:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = water(sizes)
    source_of = {}
    for i, _, s, _ in data:
        source_of.setdefault(i, set()).add(s)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        if len(source_of[r.doc_id]) == 1:
            s = next(iter(source_of[r.doc_id]))
            assert r.target == pytest.approx(want[s]) and r.source_size == sizes[s]
            taken[s] = taken.get(s, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1 + 3, (s, n, want[s])
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df).collect()))
    whole = mixing.mixed_documents(df)
    assert whole.columns == df.columns
    mixed, most = {}, {}
    for r in whole.collect():
        mixed[r.source] = mixed.get(r.source, 0) + size(r.text)
    for _, t, s, _ in data:
        most[s] = max(most.get(s, 0), size(t))
    # one document, or equal ones, are taken whole or not
    assert all(abs(mixed.get(s, 0) - n) <= most[s] + 3 for s, n in taken.items())
    assert {r.text for r in whole.collect()} <= {t for _, t, _, _ in data}
    return rows


def test_against_water_filling(spark):
    rng = random.Random(4)
    data = [(k, "w " * rng.choice([0, 1, 3, 50, 400]), rng.choice(["a", "b", "B", "é", None, "hot", "hot", "hot", "z"]), "c") for k in range(600)]
    data += [(10_000, "x " * 9000, "one", "c"), (10_001, None, "empty", "c"), (10_002, "", "empty", "c")]
    check(spark, data)


def test_equal_rows_share_the_edge(spark):
    check(spark, [(1, "p q r s t", "only", "c")] * 4 + [(2, "u", "other", "c")])


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0 == mixing.mixed_documents(df).count()
    one = spark.createDataFrame([(None, None, None)], "doc_id long, text string, source string")
    assert [tuple(r) for r in mixing.mix(one).collect()] == [(None, 0, 0, 0.0, 0)]


def test_larger_budgets_hold_smaller_ones(spark):
    df = spark.createDataFrame([(k, "w " * (k % 7 + 1), "ab"[k % 2]) for k in range(400)], "doc_id long, text string, source string")
    small, large = ({r.doc_id: r.taken for r in mixing.mix(df, share=s).collect()} for s in (0.4, 0.9))
    assert all(small[k] <= large[k] for k in small)


def test_no_text_is_cut_and_the_nearer_side_is_taken(spark):
    rng = random.Random(9)
    data = [(k, "\n " + "w  " * rng.randrange(1, 300), "abc"[k % 3]) for k in range(150)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    exact = {r.doc_id: (r.size, r.taken) for r in mixing.mix(df).collect()}
    rows = mixing.mixed_documents(df).collect()
    copies = {k: sum(r.doc_id == k for r in rows) for k in exact}
    assert {r.text for r in rows} <= {t for _, t, _ in data}
    assert all(abs(copies[k] * n - t) <= n / 2 for k, (n, t) in exact.items()) and any(t % n for n, t in exact.values())


def test_names_that_clash(spark):
    names = ["row", "of", "hash", "size", "copies", "taken", "copy", "edge", "target", "source_size"]
    data = [(k, "w " * (k % 9), "abc"[k % 3], *names) for k in range(90)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    plain = df.select("doc_id", "text", "source")
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns and got.select(*names).distinct().collect() == [tuple(names)]
    assert sorted(map(tuple, got.select("doc_id", "text", "source").collect())) == sorted(map(tuple, mixing.mixed_documents(plain).collect()))
    assert sorted(map(tuple, mixing.mix(df).collect())) == sorted(map(tuple, mixing.mix(plain).collect()))
