import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import secrets

WS = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(secrets.labelled_findings(spark))


def test_held_out_accuracy(spark, forest):
    df = secrets.labelled_findings(spark, 1500, "held out")
    rows = secrets.with_findings(df, forest).selectExpr("is_secret", "text", "explode(__findings) f").selectExpr("is_secret", "text", "f.score score").collect()
    assert len(rows) > 900
    right = sum((r.score >= 0.5) == bool(r.is_secret) for r in rows)
    secrets_ = [r for r in rows if r.is_secret]
    assert right >= 0.97 * len(rows) and sum(r.score >= 0.5 for r in secrets_) >= 0.98 * len(secrets_)


def test_column_and_plain_scores_agree(spark, forest):
    df = secrets.with_candidates(secrets.labelled_findings(spark, 200, "agree"))
    for r in df.selectExpr("explode(__candidates) f").select("f", forest.score(F.col("f")).alias("score")).collect():
        assert r.score == pytest.approx(forest.score(r.f.asDict()))


def brute_runs(text):
    out = []
    for k, w in enumerate(x for x in WS.split(text or "") if x):
        out += [(k, m.group()) for m in re.finditer(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{16,}={0,2}", w)]
    return out


def test_candidates(spark, forest):
    token = "04dbebab91ab85687d33eeaaf9ac699e" + "1188f962"
    texts = [None, "", "plain words only", f'a token = "{token}" b', f"{token},{token} x", "https://h/a1/" + "b2" * 20, "word " * 5000 + token, "A1" * 20_000, "schchchheitverkeitlichungen " * 3, token]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, f"token={token}", 1)], "doc_id long, text string, score int")
    got = secrets.with_candidates(df.select("doc_id", "text")).selectExpr("doc_id", "text", "explode(__candidates) f").selectExpr("doc_id", "text", "f.word_index", "f.candidate").collect()
    for k, t in enumerate(texts):
        assert [(r.word_index, r.candidate) for r in got if r.doc_id == k] == brute_runs(t)
    scan = secrets.scan(df, forest)
    assert scan.where("doc_id = 3 and is_secret").count() == 1 and scan.where("doc_id is null and is_secret").count() == 1
    assert secrets.scan(df.limit(0), forest).count() == 0
    masked = {r.doc_id: r for r in secrets.mask(df, forest).collect()}
    assert masked[3].text == 'a token = "[SECRET]" b' and masked[0].text is None and masked[2].text == texts[2] and masked[8].text == texts[8]
    assert masked[None].text == "token=[SECRET]" and masked[3].score == 1


def test_short_assigned_values_are_candidates(spark):
    df = spark.createDataFrame([(1, 'password = "hunter22x"'), (2, "db_password=letmein99"), (3, "the password is safe"), (4, "token: abc")], "doc_id long, text string")
    rows = {(r.doc_id, r.c) for r in secrets.with_candidates(df).selectExpr("doc_id", "explode(__candidates.candidate) c").collect()}
    assert rows == {(1, "hunter22x"), (2, "letmein99")}


def test_all_values_of_a_word_are_candidates(spark):
    run = "0123456789abcdef0"
    want = {
        f'{{"session":"{run}","password":"hunter22x"}}': [run, "hunter22x"],
        '{"password":"hunter22x","token":"letmein99"}': ["hunter22x", "letmein99"],
        "https://h/?password=hunter22x&token=letmein99&page=2": ["hunter22x", "letmein99"],
        f"pwd=ab&cdefgh,token={run},pwd=ab&cdefgh": [run, "ab&cdefgh", "ab&cdefgh"],
        f'{{"id":"hunter22x{run}","password":"hunter22x"}}': [f"hunter22x{run}", "hunter22x"],
        'password = "hunter22x",token="letmein99"': ["hunter22x", "letmein99"],
        f"token = {run}": [run],
        "password=" + "é!" * 20_000 + "&token=letmein99": ["é!" * 20_000, "letmein99"],
    }
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r.doc_id: r.c for r in secrets.with_candidates(df).selectExpr("doc_id", "__candidates.candidate c").collect()}
    assert [got[k] for k in range(len(want))] == list(want.values())


def test_the_filter_of_texts_drops_no_candidate(spark, monkeypatch):
    texts = ['secret_value = "hunter22x"', "password_prod: hunter22x", 'token_id = "abcd12"', "my token x: hunter22x", "PWD2 value= hunter22x", "auth\n\n\n'x': hunter22x", "a: b = c", "token password", None, "", "key = A1" + "b2" * 8]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 100", "text"))
    found = lambda: sorted(map(tuple, secrets.with_candidates(docs).selectExpr("doc_id", "explode(__candidates) f").select("doc_id", "f.*").collect()))
    filtered = found()
    assert {r[0] for r in filtered if r[0] < 100} == {0, 1, 2, 3, 4, 5, 10}
    monkeypatch.setattr(secrets, "may_have_candidates", lambda text: text.isNotNull())
    assert found() == filtered


def test_planted_tokens_are_found_and_masked(spark, forest):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = docs.selectExpr("doc_id", "explode(regexp_extract_all(text, '(?i)token = \"([0-9a-f]{40})\"', 1)) c").collect()
    found = secrets.scan(docs, forest).where("is_secret").collect()
    assert len(planted) > 5 and len(found) == len(planted)
    masked = secrets.mask(docs, forest)
    assert masked.where("text rlike '(?i)token = \"[0-9a-f]{40}\"'").count() == 0
    assert masked.columns == docs.columns and masked.where("n_chars <> length(text)").count() == docs.where("n_chars <> length(text)").count()


BASE = "q7Zt3LmVx9KdW2pRfY6cJh8sBn4gTe1aUo5iXwPz"


def test_keys_without_a_name_are_found_and_words_beside_them_stay(spark, forest):
    jwt = "ey" + "J0eXAiOiJKV1QiLCJhbGciOiJIUzI1" + ".ey" + "J1c2VyIjoiYjA4Zjg2YWYzNWRhNDhmMm" + ".9f3kQz7Lm2Xv8Rt4Wp6Yb1Nc5Hd0Js"
    secret = {
        1: "we saw " + "AK" + "IA" + "Q7ZT3LMVX9KDW2PR" + " in it",
        2: "use " + "gh" + "p_" + BASE[:36] + " here",
        3: f"see {jwt} for more",
        4: 'password = "hunter22x" then',
        5: "db_pwd: Garden84! now",
        6: "Authorization: Bearer " + BASE[:24],
        7: "and pass" + "word=65f08e5e2ed6b028bd it",
        8: "and pass" + "word=6190852a02e4c4b9a4 it",
        9: "and tok" + "en: 04dbebab91ab85687d33 it",
    }
    plain = {
        11: "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 of it",
        12: "trace 2b0f1c3a-4d5e-6f70-8192-a3b4c5d6e7f8",
        13: "the token page https://www.example.com/garden/river_letter_2021.html",
        14: "password: required",
        15: "Authorization: Bearer",
        16: "token = placeholder",
    }
    df = spark.createDataFrame([*secret.items(), *plain.items()], "doc_id long, text string")
    rows = secrets.scan(df, forest).where("is_secret").collect()
    assert {r.doc_id for r in rows} == set(secret)
    masked = {r.doc_id: r.text for r in secrets.mask(df, forest).collect()}
    assert masked[1] == "we saw [SECRET] in it" and masked[2] == "use [SECRET] here" and masked[3] == "see [SECRET].[SECRET].[SECRET] for more"
    assert masked[4] == 'password = "[SECRET]" then' and masked[5] == "db_pwd: [SECRET] now" and masked[6] == "Authorization: Bearer [SECRET]"
    assert {k: masked[k] for k in plain} == plain


def test_masked_by_place(spark, monkeypatch):
    """All candidates count as secret here: what is masked is where it was found, whatever its characters."""
    texts = {
        " \n password: monkey1x and monkey1xyz\tmonkey1x ": " \n password: [SECRET] and monkey1xyz\tmonkey1x ",
        "monkey1x password: monkey1x": "monkey1x password: [SECRET]",
        "password=monkey1x&user=monkey1xyz": "password=[SECRET]&user=monkey1xyz",
        "pwd=a+b$1\\E(c9[x]{2}^|?*.\\d": "pwd=[SECRET]}^|?*.\\d",
        "token=éä+ö$€🙂 x": "token=[SECRET]",
        "KEY0123456789012=abc KEY0123456789012==== x": "[SECRET]abc [SECRET]== x",
        '{"id":"hunter22x0123456789abcdef0","password":"hunter22x"}': '{"id":"[SECRET]","password":"[SECRET]"}',
        "a b c": "a b c",
        "": "",
        "word " * 3000 + "token=letmein99\n" + "word " * 3000: "word " * 3000 + "token=[SECRET]\n" + "word " * 3000,
    }
    data = [(k, t, "m", "f", "r", "c") for k, t in enumerate(texts)] + [(99, None, "m", "f", "r", "c")]
    df = spark.createDataFrame(data, "doc_id long, text string, __masked string, __findings string, row string, masked string")
    rows = secrets.mask(df, secrets.Forest((1.0,)))
    assert rows.columns == df.columns
    got = {r.doc_id: r for r in rows.collect()}
    assert [got[k].text for k in range(len(texts))] == list(texts.values()) and got[99].text is None
    assert {tuple(r)[2:] for r in got.values()} == {("m", "f", "r", "c")}


def test_keys_in_addresses_logins_and_after_hard_blanks(spark, forest):
    texts = {
        "get https://api.example.com/a/token?x=1&token=1234567890abcdef12 now": "get https://api.example.com/a/token?x=1&token=[SECRET] now",
        "url postgres://svc:Tr0ub4dor7x@db.example.com/main end": "url postgres://svc:[SECRET]@db.example.com/main end",
        "set pass" + "word\u00a0=\u00a0hunter22x\u2003now": "set password\u00a0=\u00a0[SECRET]\u2003now",
        "see https://www.example.com/a/b_1.html?page=12 and mailto:a@b.example": "see https://www.example.com/a/b_1.html?page=12 and mailto:a@b.example",
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert [r.text for r in secrets.mask(df, forest).orderBy("doc_id").collect()] == list(texts.values())


def test_training_compiles(spark, capfd):
    """What can't be compiled runs expression by expression, many times slower."""
    spark.sparkContext.setLogLevel("WARN")
    try:
        secrets.train(secrets.labelled_findings(spark, seed="compiled"))
    finally:
        spark.sparkContext.setLogLevel("ERROR")
    assert "Failed to compile" not in "".join(capfd.readouterr())


def brute_findings(text):
    """``word index, candidate, features`` in plain Python."""
    run = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{16,}={0,2}"
    hard = "\u00a0\u2000-\u200a\u202f\u3000"
    value = rf"(?:(?!&[A-Za-z0-9_.~%-]+=)[^\x22',}};{hard}]){{6,}}+"
    names, others = secrets.KEY_NAMES, secrets.OTHER_NAMES
    words = [w for w in WS.split(text or "") if w]
    at = lambda i: words[i] if 0 <= i < len(words) else ""
    out = []
    for i, w in enumerate(words):
        runs = [m.group() for m in re.finditer(run, w)]
        sign = r"(?:^|[A-Za-z\x22'])[:=]{1,2}$"
        named = bool(re.search(sign, at(i - 1)) and re.search(f"(?i){names}", f"{at(i - 2)} {at(i - 1)}"))
        scheme = bool(re.search(rf"^[\x22']?(?i:{secrets.SCHEMES})$", at(i - 1)) and re.search(sign, at(i - 2)) and re.search(f"(?i){names}", f"{at(i - 3)} {at(i - 2)}"))
        values = [m[1] for m in [re.match(rf"[\x22']?({value})", w)] if m and (named or scheme)]
        values += [m[1] for m in re.finditer(rf"(?i)(?:{names})[\x22']?[{hard}]*[:=]{{1,2}}[{hard}]*[\x22']?({value})", w)]
        values += [m[1] for m in re.finditer(r"://[^\x20\x09-\x0D:/@]*:([^\x20\x09-\x0D:/@]{6,})@", w)]
        for c in runs + [v for v in values if not re.fullmatch(run, v) and v.lower() not in secrets.SCHEMES.split("|")]:
            n, low, before = len(c), c.lower(), " ".join((at(i - 3), at(i - 2), at(i - 1)))
            lead = w.split(c)[0]
            context = f"{before} {lead}"
            kinds = re.sub("[0-9]+", "0", re.sub("[A-Z]+", "A", re.sub("[a-z]+", "a", c)))
            f = {
                "length": n,
                "digits": sum(x in "0123456789" for x in c) / n,
                "uppers": sum("A" <= x <= "Z" for x in c) / n,
                "others": len(re.findall("[^A-Za-z0-9]", c)) / n,
                "switches": (len(kinds) - 1) / n,
                "pairs": sum(low[k : k + 2] in secrets.PAIRS.split() for k in range(n)) / n,
                "distinct": len(set(c)) / n,
                "dictionary": (n - len(re.sub(f"(?:{secrets.DICTIONARY})", "", low))) / n,
                "path": bool(re.search(r"://|^[./~]|/[^/]+/|\.[a-z]{2,4}(?:[^a-z]|$)|^data:", w)),
                "key_name": bool(re.search(f"(?i){names}", context)),
                "other_name": bool(re.search(rf"(?i)(?:^|[^a-z])(?:{others})(?:[^a-z]|$)", context)),
                "assigned": bool(re.search(rf"[:=]{{1,2}}[{hard}]*[\x22']?$", context)),
                "quoted": bool(re.search(r"[\x22']$", lead)),
                "hex": bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", c)),
                "uuid": bool(re.fullmatch("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", c)),
                "repeats": (n - len(re.sub(r"(.)\1{2,}", r"\1", c))) / n,
                "prefix": bool(re.match(f"(?:{secrets.PREFIXES})", c)),
            }
            out.append((i, c, f))
    return out


def test_candidates_features_and_scan_against_brute_force(spark, forest):
    docs = secrets.labelled_findings(spark, 600, "brute").selectExpr("monotonically_increasing_id() doc_id", "text")
    docs = docs.union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 10000000000", "text")).persist()
    want = {r.doc_id: brute_findings(r.text) for r in docs.collect()}
    got = {r.doc_id: r.f for r in secrets.with_candidates(docs).selectExpr("doc_id", "__candidates f").collect()}
    assert sum(map(len, want.values())) > 500
    for k, findings in want.items():
        assert [(f.word_index, f.candidate) for f in got[k]] == [(i, c) for i, c, _ in findings]
        for f, (_, _, x) in zip(got[k], findings, strict=True):
            assert all(f[name] == pytest.approx(float(x[name])) for name in secrets.FEATURES), (f, x)
    scores = sorted((k, i, len(c), round(forest.score(f), 4)) for k, fs in want.items() for i, c, f in fs)
    scan = sorted((r.doc_id, r.word_index, r.length, round(r.score, 4)) for r in secrets.scan(docs, forest).collect())
    assert [x[:3] for x in scan] == [x[:3] for x in scores] and all(abs(a[3] - b[3]) < 2e-4 for a, b in zip(scan, scores, strict=True))
