"""Literal cases and brute-force versions."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions import privacy, text
from millrace.operators import ledger, review, runs, sessions, shards, translation, usage, validate


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_text_windows(spark):
    df = spark.createDataFrame([("a", "abcdefghijklmnopqrstuvwxyz"), ("b", ""), ("c", "a😀b" * 5)], "p string, text string")
    got = shards.text_shards(df, F.col("p"), chunk=10, overlap=2).orderBy("p", "chunk_index")
    assert rows(got.where("p = 'a'").select("shard_text", "start_char", "end_char")) == [("abcdefghij", 0, 10), ("ijklmnopqr", 8, 18), ("qrstuvwxyz", 16, 26)]
    assert "".join(r.shard_text for r in shards.text_shards(df, F.col("p"), chunk=4, overlap=0).where("p = 'c'").orderBy("chunk_index").collect()) == "a😀b" * 5
    for n in range(1, 60):
        for chunk, overlap in ((10, 3), (7, 0), (5, 4)):
            want, at = [], 0
            while True:
                want.append(at)
                if at + chunk >= n:
                    break
                at += chunk - overlap
            if n in (1, 9, 10, 11, 17, 24, 59):
                t = spark.createDataFrame([("x" * n,)], "text string")
                assert t.select(shards.starts(F.length("text"), chunk, overlap)).first()[0] == want
                assert shards.plan_bounds(t, chunk=chunk, overlap=overlap).first().n_shards == len(want)
    with pytest.raises(ValueError):
        shards.starts(F.lit(3), 5, 5)


def test_book_chapters(spark):
    book = "# Chapter 1\nbody one is here\n\nChapter 2: Return\nbody two\r\n## IV. Coda x\nend"
    df = spark.createDataFrame([(1, book), (2, "no headings"), (3, "front\nPart two\nx"), (4, " \n# Chapter 9\n"), (5, "12. not marked\nx"), (6, "")], "k int, text string")
    got = {}
    for r in shards.chapter_segments(df, "k").orderBy("k", "chapter_start").collect():
        got.setdefault(r.k, []).append((r.chapter, r.chapter_index))
        whole = {1: book, 2: "no headings", 3: "front\nPart two\nx", 4: " \n# Chapter 9\n", 5: "12. not marked\nx"}[r.k]
        assert 0 <= r.chapter_start < r.chapter_end <= len(whole)
    assert got == {1: [("Chapter 1", 1), ("Chapter 2: Return", 2), ("IV. Coda x", 3)], 2: [("Whole book", 1)], 3: [("Front matter", 0), ("Part two", 1)], 4: [("Chapter 9", 1)], 5: [("Whole book", 1)]}
    parts = shards.book_shards(df.where("k = 1"), "k", chunk=24, overlap=4).orderBy("chunk_index").collect()
    assert [p.chunk_index for p in parts] == list(range(len(parts))) and all(book[p.start_char : p.end_char] == p.shard_text for p in parts)


def test_outlines(spark):
    good = '{"title":"T","audience":"A","sections":[{"title":"Opening","brief":"b1"},{"title":"Practice","brief":"b2"}]}'
    df = spark.createDataFrame([("g", good), ("d", '{"title":"T","sections":[{"title":"X","brief":"b"},{"title":"x","brief":"b"}]}'), ("e", '{"title":"","sections":[]}')], "k string, outline string")
    got = shards.outline_sections(df, "k")
    assert rows(got.where("k = 'g'").orderBy("section_index").select("section_index", "section_count", "shard_text")) == [(1, 2, "Title: T\n\nAudience: A\n\nSection 1 of 2: Opening\n\nBrief: b1"), (2, 2, "Title: T\n\nAudience: A\n\nSection 2 of 2: Practice\n\nBrief: b2")]
    assert all("outline_duplicate_title" in r.blockers for r in got.where("k = 'd'").collect())
    assert {"outline_title_required", "outline_sections_required"} <= set(got.where("k = 'e'").first().blockers)


def test_privacy_literals(spark):
    cases = [("password=abc", "credential_assignment"), ("PASSWORD=letmein", "credential_assignment"), ("db_password=secret", "credential_assignment"), ("tok" + "en=abc123", "credential_assignment"), ("client_secret=foo", "credential_assignment"), ("/Users/x/Documents/Obsidian", "private_workspace_origin"), ("é dna édna", "health_topic_discussion"), ("AK" + "IA" + "A" * 16, "aws_access_key"), ("call 07" + "123456789", "uk_mobile_number"), ("a.b@c.example", "email_address"), ("Bea" + "rer " + "a" * 16, "bearer_token")]
    df = spark.createDataFrame(cases + [("plain text", None)], "t string, s string").select("s", privacy.findings(F.col("t")).alias("f"), privacy.privacy_class(privacy.findings(F.col("t"))).alias("c"))
    for r in df.collect():
        signals = [x.signal for x in r.f]
        assert r.s in signals if r.s else signals == []
    topic = spark.createDataFrame([("Explain why API keys should not appear in logs.",)], "t string").select(privacy.privacy_class(privacy.findings(F.col("t")))).first()[0]
    assert topic == "non_sensitive_bulk"
    hexes = "0123456789abcdef" * 4
    item = spark.createDataFrame([("p", {"input_sha256": hexes, "note": hexes})], "p string, m map<string,string>").select(privacy.item_text(F.col("p"), F.array().cast("array<struct<content:string>>"), F.col("m"))).first()[0]
    assert item.count(hexes) == 1


def test_entropy(spark):
    run = "aB3dE5gH7jK9mN1pQ2rS4tU6"
    want = -sum(n / len(run) * math.log2(n / len(run)) for n in Counter(run).values())
    got = spark.createDataFrame([(run,)], "r string").select(privacy.entropy(F.col("r")), F.size(privacy.high_entropy_runs(F.concat(F.lit("x "), "r")))).first()
    assert got[0] == pytest.approx(want) and got[1] == 1


def test_translation_literals(spark):
    g = [("medical cannabis", "cannabis médical")]
    cases = [
        ("Please greet {{name}} and mention medical cannabis.", "Veuillez saluer la personne.", "en", "fr", ["placeholders_lost", "glossary_terms_missing"]),
        ("Hello world", "", "en", "fr", ["empty_output"]),
        ("The same sentence here", "The same  sentence here", "en", "fr", ["unchanged_nontrivial_output"]),
        ("x" * 400, "x", "en", "en", ["length_ratio_out_of_bounds"]),
        ("OK", "OK", "en", "fr", []),
        ("The same sentence here", "The same sentence here", "en", "en-GB", []),
        ("Hello {{name}} ${x} [[y]] {z} %A% %1$s", "Hi {{name}} ${x} [[y]] {z} %A% %1$s", "en", "fr", []),
        ("%s and %s", "%s und", "en", "de", ["placeholders_lost"]),
    ]
    df = spark.createDataFrame([c[:4] for c in cases], "s string, t string, a string, b string").select(translation.quality(F.col("s"), F.col("t"), F.col("a"), F.col("b"), g)["blockers"])
    assert [r[0] for r in df.collect()] == [c[4] for c in cases]
    assert translation.glossary_terms('{"terms":[["a","b"],{"from":"c","to":"d"},["a ","b"]]}') == [("a", "b"), ("c", "d")]
    assert translation.glossary_terms({"x": "y"}) == [("x", "y")]
    with pytest.raises(ValueError):
        translation.glossary_terms([["", "b"]])


def test_memory_hits_are_normalised(spark):
    df = spark.createDataFrame([("Hello\r\nworld", "Hello\nworld"), ("é", "é"), ("a", "b")], "x string, y string").select((translation.memory_key(F.col("x")) == translation.memory_key(F.col("y"))))
    assert [r[0] for r in df.collect()] == [True, True, False]


def test_guarded_upsert_and_conflicts(spark):
    cols = "namespace string, source_sha256 string, source_lang string, target_lang string, glossary_sha256 string, target_text string, review_receipt_id string, reviewer string, review_payload_sha256 string, reviewed_at string"
    old = spark.createDataFrame([("n", "k1", "en", "fr", None, "old", "r", "o", "a" * 64, "d", 1, 1), ("n", "k2", "en", "fr", None, "old", None, "o", "a" * 64, "d", 1, 1)], cols + ", created_at int, updated_at int")
    new = spark.createDataFrame([("n", k, "en", "fr", "", "new", None, None, None, None) for k in ("k1", "k2", "k3")], cols)
    got = {r.source_sha256: (r.target_text, r.created_at, r.inserted) for r in translation.upsert(old, new, F.lit(5), True).collect()}
    assert got == {"k1": ("old", 1, None), "k2": ("new", 1, False), "k3": ("new", 5, True)}
    assert translation.batch_conflicts(new.union(new.limit(1))).count() == 1 and translation.batch_conflicts(new).count() == 0


def test_budget_admission_against_a_loop(spark):
    rng = random.Random(1)
    data = [(k, f"2024-01-0{rng.randint(1, 4)} {rng.randint(0, 23):02d}:00:00", float(rng.randint(1, 60)), f"r{rng.randint(0, 40)}") for k in (1, 2) for _ in range(60)]
    df = spark.createDataFrame(data, "u int, t string, x double, r string").withColumn("t", F.to_timestamp("t"))
    got = usage.admit(df, "u", "t", "x", 100.0, receipt="r").collect()
    state = {}
    for r in sorted(got, key=lambda r: (r.u, r.t, r.x, r.receipt)):
        w, seen = state.setdefault(r.u, ([], set()))
        spent = sum(x for t, x in w if (r.t - t).total_seconds() <= 86400)
        want = "replayed" if r.receipt in seen else "cap_exceeded" if spent + r.x > 100 + 1e-9 else "admitted"
        assert r.decision == want
        if want == "admitted":
            w.append((r.t, r.x))
            seen.add(r.receipt)


def test_batches_against_a_loop(spark):
    rng = random.Random(3)
    data = [(j, p, rng.choice([10, 300, 700, 1500])) for j in range(4) for p in range(50)]
    got = ledger.pack_batches(spark.createDataFrame(data, "j int, p int, n long"), "j", "p", "n", 1000, 4).collect()
    want = {}
    for j in range(4):
        number = used = count = 0
        for _, p, n in sorted(x for x in data if x[0] == j):
            if n > 1000:
                want[j, p] = None
                continue
            if count and (used + n > 1000 or count >= 4):
                number, used, count = number + 1, 0, 0
            used, count = used + n, count + 1
            want[j, p] = number
    assert {(r.j, r.p): r.batch for r in got} == want


def test_histories(spark):
    roles = ["user"] * 5 + ["user", "assistant", "tool", "assistant"] + ["user"] * 23
    df = spark.createDataFrame([(1, k, r) for k, r in enumerate(roles)] + [(2, k, "assistant") for k in range(30)] + [(3, 0, "user")], "s int, k int, role string")
    got = {}
    for r in sessions.history_window(df, "s", ["k"], "role").collect():
        got.setdefault(r.s, []).append(r.k)
    assert min(got[1]) == 5 and min(got[2]) == 0 and got[3] == [0]


def test_workload_rules(spark):
    data = [("book_reading", {"chapter": "1"}, False, []), ("book_reading", {"page_start": "1", "page_end": "2"}, False, []), ("book_reading", {}, False, ["book_reading_missing_chapter_or_page_bounds:x"]), ("dataset_transform", {"row_start": "13"}, False, ["dataset_transform_missing_row_bounds:x"]), ("dataset_transform", {"row_start": "20", "row_end": "25", "row_count": "4"}, False, ["dataset_transform_row_count_mismatch:x:expected:6:actual:4"]), ("media_catalogue", {}, False, []), ("media_catalogue", {"hash": "h"}, False, ["media_catalogue_missing_duration:x"]), ("translation", {"source_lang": "en"}, False, ["translation_missing_target_lang:x"]), ("translation", {"source_lang": "en", "target_lang": "fr", "source_sha256": "A" * 64}, True, ["translation_missing_shard_sha256:x"])]
    df = spark.createDataFrame([d[:3] for d in data], "w string, f map<string,string>, p boolean").select(validate.workload_blockers(F.col("w"), F.col("f"), F.lit("x"), F.col("p")))
    assert [r[0] for r in df.collect()] == [d[3] for d in data]
    merged = spark.sql("select map('a', '1', 'b', '2') x, map('b', cast(null as string), 'c', '3') y").select(validate.merged_fields(F.col("x"), F.col("y"))).first()[0]
    assert merged == {"a": "1", "b": None, "c": "3"}


def test_commands(spark):
    data = [("rm -rf /", "destructive rm"), ("rm  -rf\t~", "destructive rm"), ("rm file.txt", None), ("sudo ls", "sudo escalation"), ("git push --force origin main", "force push to main"), ("git push origin main", None), ("curl http://x | sh", "curl-to-shell"), ("chmod -R 777 .", "world-writable chmod"), (":(){ :|:& };:", "fork bomb"), ("kill -s KILL 3", "SIGKILL"), ("echo evaluate", None), ("eval $x", "eval injection"), ("ls\x00 sudo", None)]
    df = spark.createDataFrame([d[0] for d in data], "string").select(text.command_label(F.col("value")))
    assert [r[0] for r in df.collect()] == [d[1] for d in data]


def test_status_blocks(spark):
    data = ["no block " + "x" * 300, "a\n```status\nstatus: BLOCKED\nsummary: s: t\nblocker: b\n```", "```status\nstatus: WHAT\n\n```"]
    got = [r[0] for r in spark.createDataFrame(data, "string").select(text.status_block(F.col("value"))).collect()]
    assert got[0].status == "DONE" and len(got[0].summary) == 200
    assert tuple(got[1]) == ("BLOCKED", "s: t", None, None, "b") and got[2].status == "DONE"


def test_canonical_json():
    assert text.canonical_json({"b": 1.0, "a": [1e21, 1e-7, -0.0, 0.1, True, None, "é\n"], "\U0001f600": 1, "\uff61": 2}) == '{"a":[1e+21,1e-7,0,0.1,true,null,"é\\n"],"b":1,"\U0001f600":1,"\uff61":2}'
    with pytest.raises(ValueError):
        deep = 1
        for _ in range(300):
            deep = [deep]
        text.canonical_json(deep)


def test_recovery_and_selection(spark):
    led = spark.createDataFrame([("a", "running", "i"), ("b", "running", "i"), ("c", "succeeded", "i")], "shard_id string, status string, input_sha256 string")
    assert rows(ledger.cancel(led).select("status")) == [("cancelled",), ("cancelled",), ("succeeded",)]
    cut = spark.createDataFrame([('{"a":1', '{"a":1}'), ("x", '{"a":1}')], "c string, e string").select(ledger.interrupted_proof(F.col("c"), F.col("e")))
    assert [r[0] for r in cut.collect()] == [True, False]


def test_runs(spark):
    assert rows(runs.failure_canary(spark).select(F.count_if("fails"), F.count_if(~F.col("fails")))) == [(1, 3)]
    assert runs.workload_catalogue(spark).count() == 6
    speeds = spark.createDataFrame([("a", 1.5, "completed"), ("b", 2.5, "failed")], "n string, s double, status string")
    assert rows(runs.fastest(speeds, "n", "s")) == [("b", False)]
    assert spark.range(1).select(runs.rate(F.lit(5), F.lit(0))).first()[0] is None


def test_sessions_tables(spark):
    s = spark.createDataFrame([(1, 5, "m"), (2, 6, "m")], "id int, total_tokens int, model string")
    m = spark.createDataFrame([(1, "x")], "session_id int, content string")
    assert sessions.add_messages(m, spark.createDataFrame([(2, "y"), (9, "z")], m.schema), s, "id", "session_id").count() == 2
    got = sessions.update_session(s, spark.createDataFrame([(1, -4, None), (2, 9, "n")], s.schema), "id").orderBy("id")
    assert rows(got) == [(1, 5, "m"), (2, 9, "n")]


def test_sources_of_shards(spark):
    src = spark.createDataFrame([("s", "d")], "id string, sha256 string")
    sh = spark.createDataFrame([("1", "s", "t", None, None), ("2", "zz", "t", None, None), ("3", "s", None, None, None), ("4", "s", "t", "bad", None), ("5", "s", "t", None, "other")], "shard_id string, source_id string, inline_text string, input_sha256 string, source_sha256 string")
    assert {tuple(r) for r in validate.source_problems(sh, src).collect()} == {("2", "source_missing"), ("3", "shard_digest_required"), ("4", "input_digest_mismatch"), ("5", "source_digest_mismatch")}


def test_reviews(spark):
    sh = spark.createDataFrame([("a", "succeeded", "Hello {{x}} world out there", None, None), ("b", "failed", "t", None, None)], "shard_id string, status string, input_text string, source_lang string, target_lang string")
    out = spark.createDataFrame([("a", "Bonjour"), ("b", "")], "shard_id string, output string")
    assert rows(review.translation_blockers(sh, out, "en", "fr").select("blocker")) == [("translation_qa:a:placeholders_lost",)]
    m = spark.createDataFrame([('[{"id":"c","function":{"name":"f","arguments":"{}"}}]',), ("junk",), (None,)], "tool_calls_json string")
    assert [r.tool_calls and r.tool_calls[0].function.name for r in review.chat_messages(m).collect()] == ["f", None, None]
    first, more = review.capped(spark.range(60), ["id"])
    assert first.count() == 50 and more == 10
    reports = spark.range(15).selectExpr("id % 1 as k", "id", "id <> 3 as ok")
    assert review.retained(reports, "k", "id").count() == 10 and tuple(review.health(reports).first()) == (True, 15)
    assert spark.range(1).select(review.redact(F.lit(None).cast("struct<signature:string>"))).first()[0] is None


def test_states_of_jobs(spark):
    data = [("a", "quarantined", 0), ("a", "pending", 0), ("b", "failed", 1), ("b", "succeeded", 0), ("c", "failed", 2), ("c", "running", 0), ("d", "succeeded", 0), ("e", "cancelled", 0), ("e", "leased", 0)]
    df = spark.createDataFrame(data, "job string, status string, attempts int")
    assert {r.job: r.job_status for r in ledger.job_status(df, "status", "attempts", 2, "job").collect()} == {"a": "failed", "b": "running", "c": "failed", "d": "completed", "e": "running"}


def test_closest_command_and_file_names(spark):
    df = spark.createDataFrame([("statu",), ("abcdefghijk",), ("",), ("x",), ("rvn",)], "w string")
    got = {r.w: r.closest for r in runs.closest(df, "w", ["status", "run", "corpus-translate"]).collect()}
    assert got == {"statu": "status", "abcdefghijk": None, "": None, "x": None, "rvn": "run"}
    # Five edits: a third of the command's sixteen characters, more than a third of the word's eleven.
    near = spark.createDataFrame([("corpus-tran",)], "w string")
    assert runs.closest(near, "w", ["corpus-translate"]).first().closest == "corpus-translate"
    names = spark.createDataFrame([("a:b/c d_é.-X",)], "n string").select(text.safe_file_name(F.col("n"))).first()[0]
    assert names == "a:b_c_d__.-X"


def test_chat_costs(spark):
    data = [("pro", 1_000_000, 1_000_000, 1_000_000, None), ("flash", 1_000_000, 1_000_000, 1_000_000, None), ("unknown", 1_000_000, 1_000_000, 1_000_000, None), ("pro", None, None, None, None), ("flash", 400_000, None, 0, 1_000_000), ("flash", None, None, 1_000_000, None)]
    df = spark.createDataFrame(data, "m string, c long, f long, o long, p long").select(usage.chat_cost(F.col("m"), F.col("c"), F.col("f"), F.col("o"), F.col("p")))
    assert [r[0] for r in df.collect()] == pytest.approx([1.308625, 0.4228, 0.4228, 0.0, 0.08512, 0.28])


def test_long_runs_are_cut_into_candidates(spark):
    rng = random.Random(8)
    run = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789") for _ in range(300))
    df = spark.createDataFrame([(f"x {run} y",), (run[:210],), ("short",), ("a" * 300,)], "t string").select(privacy.high_entropy_runs(F.col("t")).alias("r"), privacy.findings(F.col("t")).alias("f"))
    got = df.collect()
    assert got[0].r == [run[:200], run[200:]] and got[1].r == [run[:200]] and got[2].r == got[3].r == []
    assert [x.signal for x in got[0].f] == ["high_entropy_credential_candidate"]


def test_digests_are_masked_at_any_depth(spark):
    h = "0123456789abcdefABCDEF0123456789" * 2
    text_ = f'{{"INPUT_sha256":"{h}","note":"{h}","deep":[{{"target_sha256" : "{h}"}}],"shard_sha256":"{h}0","said":"\\"input_sha256\\":\\"{h}\\""}}'
    got = spark.createDataFrame([(text_,)], "t string").select(privacy.mask_digests(F.col("t"))).first()[0]
    assert got == text_.replace(f'"INPUT_sha256":"{h}"', '"INPUT_sha256":"[digest]"').replace(f'"target_sha256" : "{h}"', '"target_sha256" : "[digest]"')


def test_outbound_payloads(spark):
    data = [('{"messages":[{"content":"my pass' + 'word: x"}]}', "secrets_or_credentials", False), ('{"a":"API keys in general"}', "non_sensitive_bulk", True), (None, "non_sensitive_bulk", True), ('{"to":"someone@example.org"}', "personal_sensitive", False)]
    for (p, c, ok), r in zip(data, spark.createDataFrame([d[:1] for d in data], "p string").select(privacy.outbound_report(F.col("p")).alias("r")).collect(), strict=True):
        assert (r.r.recommended_egress_class, r.r.external_allowed) == (c, ok), p
        assert all(f.severity == ("warning" if f.category == "non_sensitive_bulk" else "blocker") for f in r.r.findings)


def test_chapters_with_carriage_returns_and_blanks(spark):
    data = [
        (1, "front\r\n\r\n# Chapter 1\r\nbody\r\n  Part two\r\nend"),
        (2, "  # Chapter 9\nx"),
        (3, "\t## 12. Marked\r\n"),
        (4, " \r\n \n"),
        (5, "12. unmarked\nchapters are many\napart from that"),
        (6, "Chapter " + "x" * 2000 + "\ny"),
        (7, "ch\nch. 2\nCHAPTER\n"),
    ]
    df = spark.createDataFrame([(*x, "clash") for x in data], "k int, text string, line string")
    texts = dict(data)

    def want(t):
        heads, at = [], 0
        for raw in t.split("\n"):
            line = raw.removesuffix("\r").strip()
            m = re.match(r"#{1,6}\s+(.+)$", line)
            label = re.sub(r"\s+", " ", (m[1] if m else line).strip())
            if line and len(line) <= 2000 and (re.match(r"(?i)(?:chapter|ch\.?)(?:\s|$)", label) or re.match(r"(?i)part\s+(?:[0-9]+|[ivxlcdm]+|[a-z]+)", label) or m and re.match(r"(?i)(?:[0-9]{1,4}|[ivxlcdm]{1,12})[.)\-:–—]\s+\S+", label)):
                heads.append((at, label))
            at += len(raw) + 1
        parts = [(label, i + 1, a, b) for i, ((a, label), b) in enumerate(zip(heads, [*(h[0] for h in heads[1:]), len(t)], strict=False))]
        parts = [("Front matter", 0, 0, heads[0][0]), *parts] if heads else [("Whole book", 1, 0, len(t))]
        return [p for p in parts if t[p[2] : p[3]].strip()]

    got = {}
    for r in shards.chapter_segments(df, "k").orderBy("k", "chapter_start").collect():
        got.setdefault(r.k, []).append(tuple(r)[1:])
    assert got == {k: want(t) for k, t in texts.items() if want(t)}
    assert [p[2] for p in got[1]] == [0, 9, 28] and got[2] == [("Chapter 9", 1, 0, 15)]
    plan = {r.k: (r.n_shards, r.shard_chars, r.allowed) for r in shards.book_plan(shards.chapter_segments(df, "k"), "k", 10, 2).collect()}
    made = shards.book_shards(df, "k", chunk=10, overlap=2).groupBy("k").agg(F.count(F.lit(1)), F.sum(F.length("shard_text"))).collect()
    assert {r[0]: (r[1], r[2], True) for r in made} == plan


def test_lost_artifacts_and_unlisted_shards(spark):
    led = spark.createDataFrame([("a", "succeeded", 0, None), ("b", "succeeded", 0, None), ("c", "pending", 1, None), ("d", "failed", 0, "2024-01-01 00:00:00"), ("e", "failed", 0, "2024-01-03 00:00:00"), ("f", "quarantined", 9, None)], "shard_id string, status string, attempts int, r string").withColumn("next_retry_at", F.to_timestamp("r"))
    one = led.where("shard_id = 'a'").select("shard_id")
    assert set(rows(ledger.missing_artifacts(led, one, one.limit(0)))) == {("b", "missing_output"), ("a", "missing_proof"), ("b", "missing_proof")}
    now = F.to_timestamp(F.lit("2024-01-02 00:00:00"))
    got = {r.shard_id: (r.status, r.last_error) for r in ledger.fail_unlisted(led, one, now, 3).collect()}
    lost = ("failed", "shard_missing_from_manifest")
    assert got == {"a": ("succeeded", None), "b": ("succeeded", None), "c": lost, "d": lost, "e": ("failed", None), "f": ("quarantined", None)}
    new = led.withColumn("status", F.when(F.col("shard_id") == "c", "running").otherwise(F.col("status")))
    assert rows(ledger.event_log(led, new, now, "shard_id").select("shard_id", "type")) == [("c", "shard_running")]
    assert rows(ledger.checkpoints(led, new, "shard_id").select("shard_id", "status")) == [("c", "running")]
    with pytest.raises(ValueError, match="checkpoint_unknown"):
        ledger.overlay(led.where("shard_id <> 'c'"), ledger.checkpoints(led, new, "shard_id"), "shard_id")


def test_glossaries_and_batches_are_refused(spark):
    data = [('[{"source":"a","target":"b"}]', True), ("[]", True), ('[{"source":" ","target":"b"}]', False), ('[{"source":"a"}]', False), ("{", False), (None, False)]
    got = spark.createDataFrame([d[:1] for d in data], "g string").select(translation.glossary_valid(F.col("g"))).collect()
    assert [r[0] for r in got] == [d[1] for d in data]
    cols = "namespace string, source_sha256 string, source_lang string, target_lang string, glossary_sha256 string, target_text string, review_receipt_id string, reviewer string, review_payload_sha256 string, reviewed_at string"
    twice = spark.createDataFrame([("n", "k", "en", "fr", g, "t", None, None, None, None) for g in (None, "")], cols)
    with pytest.raises(ValueError, match="memory_batch_conflict"):
        translation.upsert(twice.limit(0).withColumns({"created_at": F.lit(0), "updated_at": F.lit(0)}), twice, F.lit(1))


def test_fixed_workloads(spark):
    assert [r.workload for r in runs.workload_catalogue(spark).orderBy("workload").collect()] == ["classification", "drafting", "extraction", "scoring", "second_opinion", "summarisation"]


def test_white_space_as_a_string_and_as_a_class():
    found = {c for c in map(chr, range(0x10000)) if re.fullmatch(text.SPACE, c)}
    assert found == set(text.SPACES)


def test_run_generators(spark):
    assert [r.item_id for r in runs.agent_canary(spark).orderBy("item_id").collect()] == ["canary-plan", "canary-proof", "canary-safety"]
    prompts = spark.createDataFrame([("scoring", k, f"p{k}") for k in range(3)] + [("drafting", 0, "d")], "workload string, prompt_index int, prompt string")
    assert rows(runs.workload_items(prompts, "scoring").orderBy("item_id")) == [(f"scoring-{k + 1}", f"p{k % 3}", "scoring", k % 3) for k in range(6)]
    assert runs.workload_items(prompts, "drafting", 2).count() == 2
    with pytest.raises(ValueError):
        runs.workload_items(prompts, "none")
    done = runs.transport("fake")(F.lit("a"), F.lit("{}"))
    assert spark.range(1).select(done).first()[0].startswith("fake:a:")
    assert spark.range(1).select(runs.transport("dry-run")(F.lit("a"), F.lit("{}"))).first()[0] == "{}"
    for live in (False, True):
        with pytest.raises(ValueError):
            runs.transport("live", allow_live=live)


def test_transcripts(spark):
    data = [(1, "reasoning_delta", "why", None, None, None), (2, "text_delta", "Hel", None, None, None), (3, "text_delta", "lo", None, None, None), (4, "tool_start", "{}", "read", None, None), (5, "tool_end", "ok", "read", False, None), (6, "tool_end", "bad", "read", True, None), (7, "usage", None, None, None, 5), (8, "text_delta", "end", None, None, None), (9, "turn_complete", None, None, None, 9)]
    df = spark.createDataFrame([("s", *x) for x in data] + [("t", 1, "text_delta", "open", None, None, None)], "s string, k int, type string, text string, name string, error boolean, tokens long")
    got = {r.s: r for r in sessions.transcript(df, "s", "k").collect()}
    assert [tuple(e) for e in got["s"].entries] == [("reasoning", "why"), ("assistant", "Hello"), ("tool", "read {}"), ("tool_ok", "read — ok"), ("tool_error", "read — bad"), ("assistant", "end")]
    assert (got["s"].status, got["s"].tokens) == ("idle", 9) and (got["t"].status, got["t"].entries, got["t"].tokens) == ("running", [], 0)


def test_names_paths_and_order(spark):
    data = [("/in/a/b.txt", "/in/", "a/b.txt"), ("C:\\in\\a.txt", "C:\\in", "a.txt"), ("/inner/a", "/in", None)]
    got = spark.createDataFrame([d[:2] for d in data], "p string, r string").select(text.relative_path(F.col("p"), F.col("r"))).collect()
    assert [r[0] for r in got] == [d[2] for d in data]
    names = spark.createDataFrame([(" a ",), ("x" * 128,), ("x" * 129,), (" ",), (None,)], "n string").select(text.namespace(F.col("n"))).collect()
    assert [r[0] for r in names] == ["a", "x" * 128, None, None, None]
    terms = spark.createDataFrame([("f",), ("é",), ("e",), ("Z",), ("a",)], "t string")
    assert [r.t for r in review.collated(terms, "t").collect()] == ["a", "e", "é", "f", "Z"]
    old = review.with_columns_of(terms, "t string, reviewer string, reviewed_at string")
    assert old.columns == ["t", "reviewer", "reviewed_at"] and old.where("reviewer is null").count() == 5


def test_run_states_and_bounds(spark):
    before = spark.createDataFrame([("a", "running", None), ("b", "running", "old"), ("c", "queued", None)], "run_id string, status string, error string")
    changes = spark.createDataFrame([("a", "failed", "boom"), ("b", "completed", None), ("z", "failed", None)], before.schema)
    after = review.set_run_status(before, changes)
    assert sorted(rows(after), key=str) == [("a", "failed", "boom"), ("b", "completed", None), ("c", "queued", None)]
    assert sorted(rows(review.transition_events(before, after, "run_id", prefix="run_"))) == [("a", "run_failed"), ("b", "run_completed")]
    assert rows(review.interrupted_run_ids(before.unionByName(before)).orderBy("run_id")) == [("a",), ("b",)]
    assert usage.budget_status(before, "run_id", "c").count() == 1 and usage.budget_status(before, "run_id", "q").count() == 0
    turns = spark.createDataFrame([("s", "tool_start", k % 9) for k in range(33)] + [("t", "usage", 1)], "s string, type string, round int")
    assert sorted(rows(sessions.turn_problems(turns, "s"))) == [("s", "turn_rounds_exceeded:9"), ("s", "turn_tool_calls_exceeded:33")]
    with pytest.raises(ValueError):
        runs.expand_items(spark.range(10_001), "id", 3)
