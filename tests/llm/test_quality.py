import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import quality

WS = re.compile(r"[\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = [w for w in WS.split(text) if w]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WS.sub("", x)]
    n, r = len(words), len(covered)
    return (n, sum(map(len, words)), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n)


def texts():
    rng = random.Random(5)
    out = [None, "", " \n ", "a", "a b", "a b c", "a a a a", "a b c a b c", "x y z\nx y z\n\n \nx y z", "  lead\ttab\x0bvt\x0cff\rcr ", "nbsp\xa0one word", "é🙂 ü", "\x01\n\x01 \x01 \x01 \x01", "a\x00b " * 5, "w " * 30000, "Z" * 40000, "# $ % & | < > * !"]
    for _ in range(150):
        out.append("".join(rng.choice(["a ", "b ", "ab ", "c", "\n", " ", "d e f g ", "!", "|", "\t"]) for _ in range(rng.choice([3, 30, 200]))))
    return out + ["same text here"] * 3


def test_counts_against_brute_force(spark):
    data = [(k, t, 9) for k, t in enumerate(texts())] + [(None, "null id", 9), (0, None, 9)]
    df = spark.createDataFrame(data, "doc_id long, text string, n_words int")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(df).collect())
    assert got == sorted((i is not None, i or 0, *brute(t)) for i, t, _ in data)


def test_rejected_by_votes_and_rows_kept_whole(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgnorstu") for _ in range(rng.randint(2, 9)))
    good = [" ".join(word() for _ in range(rng.randint(60, 300))) for _ in range(300)]
    junk = [" ".join(word().upper() + "!!" for _ in range(120)) for _ in range(12)] + [" | ".join(word() for _ in range(120)) for _ in range(12)]
    df = spark.createDataFrame([(k, t, *"xyzuvw") for k, t in enumerate(good + junk)], "doc_id long, text string, kept string, words string, row string, counts string, __words string, hashes string")
    rows = quality.keep_good(df)
    assert rows.columns == df.columns
    assert rows.drop("doc_id", "text").distinct().collect() == [tuple("xyzuvw")]
    assert {r.doc_id for r in rows.collect()} == set(range(300))
    assert rows.where(F.col("kept") != "x").count() == 0
    assert quality.judge(df.limit(0)).count() == 0 == quality.keep_good(df.limit(0)).count()


def plain_votes(text):
    """Votes of all rules, in plain Python."""
    n, chars, symbols, dup_lines, repeats, _ = brute(text)
    text = text or ""
    words = [w for w in WS.split(text) if w]
    lines = [x for x in text.split("\n") if WS.sub("", x)]
    share = lambda a, b: a / b if b else None
    values = {
        "symbols": share(symbols, n),
        "repeats": share(repeats, n),
        "exclaims": share(text.count("!"), n),
        "capitals": share(sum("A" <= c <= "Z" for c in text), chars),
        "dup_lines": share(dup_lines, len(lines)),
        "word_length": abs(math.log(chars / n / 5.5)) if n else None,
        "short": share(50, n),
        "variety": 1 - len(set(words)) / min(n, 400) if n else None,
    }
    return [0 if values[r.name] is None else -1 if values[r.name] > r.bad else 1 if values[r.name] < r.good else 0 for r in quality.RULES]


def plain_kept(texts):
    """Whether each document is kept, and its posterior (None where the base rules reject it)."""
    passed = [k for k, t in enumerate(texts) if not brute(t)[-1]]
    found = dict(zip(passed, plain_estimate([plain_votes(texts[k]) for k in passed]) if passed else [], strict=True))
    return [(found.get(k, 0) >= 0.5, found.get(k)) for k in range(len(texts))]


def plain_estimate(votes):
    """Posterior of each document by a plain loop over documents; ``votes``: one list for each."""
    n, total = len(votes[0]), len(votes)
    weigh = lambda share: max(share * total, quality.BELIEF_LEAST)
    overall = [[(sum(v[j] == x for v in votes) + quality.BELIEF_LEAST / 3) / (total + quality.BELIEF_LEAST) for x in (-1, 0, 1)] for j in range(n)]
    belief = []
    for k in range(n + 1):
        rows = []
        for j in range(n):
            rest = overall[j][1] + overall[j][2]
            if k == 0:
                mean, weight = [quality.FALSE_REJECTS, (1 - quality.FALSE_REJECTS) * overall[j][1] / rest, (1 - quality.FALSE_REJECTS) * overall[j][2] / rest], weigh(quality.BELIEF_GOOD)
            elif k == j + 1:
                mean, weight = quality.JUNK_VOTES, weigh(quality.BELIEF_OWN)
            else:
                mean, weight = overall[j], weigh(quality.BELIEF_OTHER)
            rows.append([m * weight for m in mean])
        belief.append(rows)
    shares = [quality.GOOD_SHARE * quality.BELIEF_LEAST] + [(1 - quality.GOOD_SHARE) / n * quality.BELIEF_LEAST] * n
    prior_shares = list(shares)

    def alike(a, b):
        ma, mb = sum(v[a] for v in votes) / total, sum(v[b] for v in votes) / total
        cov = sum((v[a] - ma) * (v[b] - mb) for v in votes)
        va, vb = sum((v[a] - ma) ** 2 for v in votes), sum((v[b] - mb) ** 2 for v in votes)
        return 1.0 if a == b else abs(cov) / math.sqrt(va * vb) if va > 1e-9 and vb > 1e-9 else 0.0

    weights = [1 / sum(alike(a, b) for b in range(n)) for a in range(n)]
    chances = belief
    before = None
    for _ in range(quality.MOST_STEPS):
        p = [[[c / sum(row) for c in row] for row in kind] for kind in chances]
        q = [x / sum(shares) for x in shares]
        of = []
        for v in votes:
            score = [math.log(q[k]) + sum((1.0 if k == j + 1 else weights[j]) * (math.log(p[k][j][v[j] + 1]) - math.log(p[0][j][v[j] + 1])) for j in range(n)) for k in range(n + 1)]
            e = [math.exp(x - max(score)) for x in score]
            of.append([x / sum(e) for x in e])
        if before and max(abs(x - y) for a, b in zip(of, before, strict=True) for x, y in zip(a, b, strict=True)) <= quality.TOLERANCE:
            break
        before = of
        chances = [[[belief[k][j][x] + sum(o[k] for o, v in zip(of, votes, strict=True) if v[j] == x - 1) for x in range(3)] for j in range(n)] for k in range(n + 1)]
        shares = [prior_shares[k] + sum(o[k] for o in of) for k in range(n + 1)]
    return [o[0] for o in of]


def test_posterior_and_kept_against_a_plain_estimate(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgnorstu") for _ in range(rng.randint(2, 9)))
    data = [" ".join(word() for _ in range(rng.randint(52, 120))) for _ in range(150)]
    data += [" ".join(word().upper() + "!" for _ in range(90)) for _ in range(9)] + [" | ".join(word() for _ in range(90)) for _ in range(9)] + [" ".join(word() + ("|" if rng.random() < 0.1 else "") for _ in range(60)) for _ in range(9)]
    data += ["a line of it\n" * 3 + " ".join(word() for _ in range(50)), "few words", "", None]
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    rows = quality.judge(df).collect()
    want = plain_kept(data)
    for r in rows:
        kept, posterior = want[r.doc_id]
        assert r.kept == kept and r.base_failed == (posterior is None)
        assert r.base_failed or r.posterior == pytest.approx(posterior, abs=1e-4)
    assert {r.doc_id for r in rows if not r.kept and not r.base_failed} == set(range(150, 168))


def test_one_reject_can_stay_and_none_can_go():
    """Production parameters: a rule that seldom rejects drops nothing alone, and abstentions usual for junk do."""
    rng, patterns, truth = random.Random(7), Counter(), Counter()
    for _ in range(40000):
        good = rng.random() < 0.88
        v = [0 if rng.random() < 0.02 else 1 for _ in range(8)]
        if good and rng.random() < 0.001:
            v[7] = -1
        if not good:
            v[0] = -1 if rng.random() < 0.6 else 0
            for j in (1, 2, 3):
                v[j] = 0 if rng.random() < 0.8 else 1
        patterns[tuple(v)] += 1
        truth[tuple(v), good] += 1
    model = quality.expectation_maximisation(dict(patterns))
    assert model.posterior((1, 1, 1, 1, 1, 1, 1, -1)) > 0.5
    assert model.posterior((0, 0, 0, 0, 1, 1, 1, 1)) < 0.5
    assert model.posterior((-1, 0, 0, 1, 1, 1, 1, 1)) < 0.1 and model.posterior((1, 1, 1, 1, 1, 0, 1, 1)) > 0.9
    right = sum(n for (v, good), n in truth.items() if (model.posterior(v) >= 0.5) == good)
    assert right >= 0.98 * 40000
    # What is estimated is near to what was planted.
    assert model.shares[0] == pytest.approx(0.88, abs=0.02)
    assert model.chances[1][0][0] == pytest.approx(0.6, abs=0.05)


def test_no_patterns_and_rules_that_vote_alike():
    assert quality.expectation_maximisation({(0,) * 8: 0}).posterior((1,) * 8) > 0.5
    assert quality.independence({(1, 1, 1): 5, (-1, -1, 1): 5, (1, 1, -1): 5, (-1, -1, -1): 5}) == pytest.approx((0.5, 0.5, 1.0))


def test_agreement_with_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").where("toxic = 0")
    rows = quality.judge(spark.read.parquet(f"{d}/documents.parquet")).join(labels, "doc_id").select("n_words", "base_failed", "kept", "quality").collect()
    clean = [r for r in rows if r.quality == 1 and not r.base_failed]
    junk = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)
    assert sum(r.kept for r in junk) <= 0.1 * len(junk)
