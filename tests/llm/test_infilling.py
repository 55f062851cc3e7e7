import hashlib
import random
import re
import tracemalloc

import pytest

from millrace.llm import infilling

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.DOTALL)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text, seed="1"):
    """The contract, with all units in a list."""
    text = text or ""
    digest = sha(f"{seed}:{'null' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = [None, "", " ", "a", "<", "a<P>b", "<S>", "x<M>", "<P", "S><", "<<P>", "é", "a\nb\r\nc d", "🙂🙂 ab🙂", "a" * 3000, "1" * 3000, "\x00a\x00", "é é", "ends <", "<M", "P>", "word " * 9000]


def test_against_a_list_of_units(spark):
    rng = random.Random(3)
    data = [(k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (None, None), (3, "a"), (3, "a"), (-7, "below zero")]
    data += [(100 + k, "".join(rng.choice(["ab", "C", " ", "\n", "<", "P", "S>", "é", "7", "🙂"]) for _ in range(rng.randrange(40)))) for k in range(400)]
    df = spark.createDataFrame([(*x, "clash", 5) for x in data], "doc_id long, text string, output string, n long").repartition(3)
    got = infilling.fill_in_middle(df)
    want = sorted(map(repr, ((i, *plain(i, t)) for i, t in data)))
    assert sorted(map(repr, map(tuple, got.collect()))) == want
    rows = infilling.digests(got).collect()
    texts = {}
    for i, t in data:
        texts.setdefault(i, set()).add(sha(t or ""))
    assert len(rows) == len(data) and all(r.restored_sha256 in texts[r.doc_id] for r in rows)
    forms = [r.form for r in rows]
    assert {"plain", "psm", "spm"} == set(forms)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert infilling.digests(infilling.fill_in_middle(df)).collect() == []


def test_other_marks_units_and_ids(spark):
    df = spark.createDataFrame([(f"k{k}", f"one two  three{k} four") for k in range(60)], "name string, body string")
    got = infilling.fill_in_middle(df, "seed", r"\S+|\s+", ("[pre]", "[suf]", "[mid]"), 0, 50, "name", "body")
    rows = got.select("*", infilling.restored(got.output, got.form, ("[pre]", "[suf]", "[mid]")).alias("text")).collect()
    assert {r.form for r in rows} == {"psm", "spm"} and all(r.n == 7 and r.text == f"one two  three{r.doc_id[1:]} four" for r in rows)
    with pytest.raises(ValueError, match="marks"):
        infilling.fill_in_middle(df, marks=("<P>", "<P>x", "<M>"), id_col="name", text_col="body")


def test_long_texts_need_no_list_of_units():
    text = "a " * 1_000_000
    tracemalloc.start()
    assert infilling.count_units(UNIT, text) == 2_000_000
    assert infilling.ends_of(UNIT, text, 1_000_000, 2_000_000) == (1_000_000, 2_000_000)
    assert tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()


def test_units_are_counted_and_found():
    for text in (t or "" for t in ODD):
        units = UNIT.findall(text)
        n = len(units)
        assert infilling.count_units(UNIT, text) == n
        for a, b in {(0, 0), (0, n), (n, n), (n // 2, n), (n // 3, n // 2)}:
            assert infilling.ends_of(UNIT, text, a, b) == (len("".join(units[:a])), len("".join(units[:b])))
