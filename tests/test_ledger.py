import json
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import privacy, terms, text
from millrace.operators import ledger, shards, translation, usage


def packed(rows, cap_bytes, cap_count):
    """Each job's shards in order, one after another."""
    out, state = [], {}
    for j, p, n in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if n is None or n > cap_bytes:
            out.append((j, p, None))
            continue
        number, used, count = state.get(j, (0, 0, 0))
        if count and (used + n > cap_bytes or count >= cap_count):
            number, used, count = number + 1, 0, 0
        state[j] = number, used + n, count + 1
        out.append((j, p, number))
    return out


@pytest.mark.parametrize(("block", "cap", "most"), [(10_000, 100, 7), (1, 100, 7), (1, 30, 3), (40, 1000, 9)])
def test_packing_against_a_loop(spark, monkeypatch, block, cap, most):
    monkeypatch.setattr(ledger, "PACK_BLOCK", block)
    rng = random.Random(block + cap)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), p, rng.choice([0, 1, 5, 20, 99, 100, 101, None])) for p in rng.sample(range(10**6), 900)]
    got = ledger.pack_batches(spark.createDataFrame(rows, "j string, p int, n long").repartition(5), "j", "p", "n", cap, most).collect()
    assert sorted(((r.j, r.p, r.batch) for r in got), key=repr) == sorted(packed(rows, cap, most), key=repr)


def test_packing_nothing(spark):
    df = spark.createDataFrame([], "j string, p int, n long")
    assert ledger.pack_batches(df, "j", "p", "n", 10, 2).collect() == []


def proof(shard, **more):
    fields = {"schema_version": ledger.PROOF_SCHEMA_VERSION, "job_id": "j", "shard_id": shard, "source_id": "s", "processor_version": "copy_text.v1", "input_sha256": "i" * 64, "output_sha256": digest("text"), "committed_at": "2024-01-01T00:00:00Z"} | more
    return json.dumps({k: v for k, v in fields.items() if v is not None}, indent=2)


def digest(value):
    import hashlib

    return hashlib.sha256(value.encode()).hexdigest()


def recovered(spark, stored, outputs=(("a", "text"),), manifest=(("a", "i" * 64),), status="running", processor="copy_text"):
    led = spark.createDataFrame([("j", "a", "s", status, "old", "lease")], "job_id string, shard_id string, source_id string, status string, last_error string, lease_owner string")
    out = spark.createDataFrame(list(outputs), "shard_id string, output string")
    prf = spark.createDataFrame([("a", p) for p in stored], "shard_id string, proof string")
    return ledger.recover(led, out, prf, spark.createDataFrame(list(manifest), "shard_id string, input_sha256 string"), processor).collect()


def test_a_whole_proof_commits_with_its_fields(spark):
    (r,) = recovered(spark, [proof("a", processor_run_id="run")])
    assert (r.status, r.recovered, r.last_error, r.lease_owner, r.output_sha256, r.processor_version, r.processor_run_id, r.committed_at, r.finished_at, r.input_sha256) == ("succeeded", True, None, None, digest("text"), "copy_text.v1", "run", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z", "i" * 64)


@pytest.mark.parametrize("cut", [0, 1, 20, 60, 130, 150])
def test_a_proof_that_was_cut_off_is_passed_over(spark, cut):
    (r,) = recovered(spark, [proof("a")[:cut]])
    assert (r.status, r.recovered, r.last_error, r.lease_owner) == ("running", False, "old", "lease")


def test_settled_shards_and_lost_files_stay(spark):
    assert [r.status for r in recovered(spark, ["nonsense"], status="succeeded")] == ["succeeded"]
    assert [r.status for r in recovered(spark, [])] == ["running"]
    assert [r.status for r in recovered(spark, [proof("a")], outputs=[])] == ["running"]


@pytest.mark.parametrize(
    ("what", "stored", "more"),
    [
        ("proof_not_json", ["nonsense"], {}),
        ("proof_not_json", ["[1]"], {}),
        ("proof_too_large", [proof("a", note="x" * (1 << 20))], {}),
        ("no_manifest_shard", [proof("a")], {"manifest": []}),
        ("processor_mismatch", [proof("a", processor_version="local_ocr.focr.v1")], {}),
        ("processor_mismatch", [proof("a", processor_version="translation_memory.v1")], {"processor": "model_batch"}),
        ("identity_mismatch", [proof("a", schema_version="v0")], {}),
        ("identity_mismatch", [proof("a", job_id="other")], {}),
        ("identity_mismatch", [proof("b")], {}),
        ("identity_mismatch", [proof("a", source_id=None)], {}),
        ("input_mismatch", [proof("a", input_sha256="x")], {}),
        ("input_mismatch", [proof("a", input_sha256=None)], {}),
        ("output_mismatch", [proof("a", output_sha256=digest("other"))], {}),
        ("output_mismatch", [proof("a", output_sha256="short")], {}),
        ("output_mismatch", [proof("a", committed_at="some day")], {}),
        ("output_repeated", [proof("a")], {"outputs": [("a", "text"), ("a", "text")]}),
        ("proof_repeated", [proof("a"), proof("a")], {}),
    ],
)
def test_contradictions_raise(spark, what, stored, more):
    with pytest.raises(Exception, match=f"corpus_shard_proof_invalid:{what}:a"):
        recovered(spark, stored, **more)


def test_results_touch_running_shards_only(spark):
    led = spark.createDataFrame([("a", "running", 1, "e"), ("b", "running", 3, "e"), ("c", "succeeded", 1, "e"), ("d", "cancelled", 1, "e"), ("e", "running", 1, "e")], "k string, status string, attempts int, last_error string")
    results = spark.createDataFrame([("a", "failed", "boom", None), ("c", "failed", "boom", None), ("e", "completed", None, "out")], "k string, status string, error string, output string")
    now = F.to_timestamp(F.lit("2024-01-02 00:00:00"))
    got = {r.k: (r.status, r.last_error, r.output_text, r.next_retry_at and str(r.next_retry_at)) for r in ledger.apply_results(led, results, "k", now, 3).collect()}
    assert got == {"a": ("failed", "boom", None, "2024-01-02 00:00:30"), "b": ("failed", "processor_result_missing_or_failed", None, None), "c": ("succeeded", "e", None, None), "d": ("cancelled", "e", None, None), "e": ("succeeded", None, "out", None)}


def test_unlisted_shards_keep_others_errors(spark):
    led = spark.createDataFrame([("a", "failed", 1, "old error"), ("b", "pending", 0, None)], "shard_id string, status string, attempts int, last_error string").withColumn("next_retry_at", F.to_timestamp(F.lit("2099-01-01")))
    none = spark.createDataFrame([], "shard_id string")
    got = {r.shard_id: (r.status, r.last_error) for r in ledger.fail_unlisted(led, none, F.to_timestamp(F.lit("2024-01-02")), 3).collect()}
    assert got == {"a": ("failed", "old error"), "b": ("failed", "shard_missing_from_manifest")}


def test_rolling_spend_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "b", None]), 3600 * rng.randrange(100), rng.choice([None, 0.1, 0.2, 7.25, -1.5])) for _ in range(400)]
    df = spark.createDataFrame([(k, n, t, x) for n, (k, t, x) in enumerate(rows)], "k string, n int, t long, x double").withColumn("t", F.timestamp_seconds("t"))
    got = {r.n: r.spend for r in usage.rolling_spend(df, "k", "t", F.col("x")).collect()}
    for n, (k, t, _) in enumerate(rows):
        assert got[n] == pytest.approx(sum(x or 0 for a, b, x in rows if a == k and t - 86400 <= b <= t), abs=1e-9)


BLANKS = text.SPACES


def test_patterns_hold_all_blanks(spark):
    """A literal for each pattern with blanks, once with each kind of blank."""
    cases = ["Bearer{b}abcdefghijklmnop", "api{b}key{b}:{b}x", "pass" + "word{b}={b}hunter2hunter", "nhs{b}number{b}:{b}1234567890", "patient{b}id{b}:{b}ABC12", "date of birth{b}:{b}1/2/1990", "passport{b}:{b}abcdef", "SW1A{b}1AA", "private{b}keys"]
    signals = ["bearer_token", "credential_assignment", "credential_assignment", "nhs_identifier", "medical_identifier", "date_of_birth", "personal_identifier", "uk_postcode", "credential_discussion"]
    data = [(s, c.format(b=b)) for c, s in zip(cases, signals, strict=True) for b in BLANKS]
    got = spark.createDataFrame(data, "s string, t string").select("s", "t", F.transform(privacy.findings(F.col("t")), lambda f: f["signal"]).alias("f")).collect()
    assert [(r.s, r.t) for r in got if r.s not in r.f] == []
    ends = spark.createDataFrame([(f"x token={b}",) for b in BLANKS], "t string").select(F.transform(privacy.findings(F.col("t")), lambda f: f["signal"]).alias("f")).collect()
    assert not any("credential_assignment" in r.f for r in ends)


def test_headings_hold_all_blanks_and_the_guard_lets_them_through(spark):
    a, b = "\u3000", "\xa0"
    lines = [f"{a}Part{b}II", f"{a}##{b}Chapter{b}1", f"{a}ch{b}x", f"{a}#{b}3.{b}Three", f"{a}ch.", f"{a}#{b}IV) four", f"{a}chapter"]
    # a mark's line has no other line ends within
    lines += [f"Part{x}two" for x in BLANKS if x != "\n"] + [f"#{x}ch{x}1" for x in BLANKS if x not in "\n\r\u2028\u2029"]
    df = spark.createDataFrame([(k, f"front\n{line}\nrest") for k, line in enumerate(lines)], "k int, t string")
    want = df.select("k", shards.heading_label(F.split("t", "\n")[1]).alias("label")).where("label is not null")
    got = shards.chapter_segments(df, "k", "t").where("chapter_index = 1").select("k", "chapter")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == len(lines)
    assert text.all_blanks(r"[^\s,]\s\\s") == f"[^{text.BLANKS},]{text.SPACE}\\\\s"


def test_quality_measures_trimmed_texts(spark):
    q = lambda s, t, g=(): spark.createDataFrame([(s, t)], "s string, t string").select(translation.quality(F.col("s"), F.col("t"), F.lit("en"), F.lit("fr"), g).alias("q")).first().q
    r = q("1234567\n\n", "x")
    assert (r.source_chars, r.length_ratio_checked, r.blockers) == (7, False, [])
    assert q(None, None).blockers == ["empty_output"]
    r = q("say THE word %s now", "dis %s le mot", [("the", "le"), ("word", "parole")])
    assert (r.blockers, r.missing_terms, r.required_terms) == (["glossary_terms_missing"], ["parole"], ["le", "parole"])
    for bad in ("{", [["a"]], {"terms": 7}, 5, [{"source": "a"}]):
        r = q("a text of words", "un texte", bad)
        assert r.blockers == ["invalid_glossary"] and r.glossary_invalid
    assert q("a text of words", "un texte", "").blockers == []
    with pytest.raises(ValueError, match="ratio_bounds"):
        translation.quality(F.col("s"), F.col("t"), F.lit("a"), F.lit("b"), (), 2.0, 1.0)


def test_quality_reads_each_text_once_for_each_pattern(spark):
    df = spark.createDataFrame([("a {{n}} %s ${x}", "b {{n}}")], "s string, t string")
    df = df.select(translation.quality(F.col("s"), F.col("t"), F.lit("en"), F.lit("fr")).alias("q"))
    assert set(df.first().q.lost_placeholders) == {"${x}", "%s", "{x}"}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f", {p}, 0)") for p in translation.PLACEHOLDERS] == [2] * len(translation.PLACEHOLDERS)


def test_nontrivial_by_letters_or_words(spark):
    cases = {"a1b2c3d4e5f6g7": False, "a1b2c3d4e5f6g7h": True, "\U0001d49c" * 7: False, "\U0001d49c\n" * 4 + "éàñç": True, "a b": True, "1 2 3 4 5 6 7 8 9": False, "": False}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", text.nontrivial(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == cases


def test_terms_against_single_searches(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abÀé ") for _ in range(n))
    pairs = [(w, word(2) + "z") for w in {word(rng.randrange(1, 4)) + "b" for _ in range(60)}] + [("AB", "1"), ("ab", "2")]
    texts = [word(rng.randrange(40)) for _ in range(60)] + ["", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: [tuple(x) for x in r.f] for r in df.select("k", terms.terms_in(F.col("t"), pairs).alias("f")).collect()}
    assert got == {k: [p for p in pairs if t is not None and p[0].lower() in t.lower()] for k, t in enumerate(texts)}
    both = df.select("k", terms.terms_kept(F.col("t"), F.reverse("t"), pairs).alias("q")).collect()
    for r in both:
        t = texts[r.k] or ""
        assert [tuple(x) for x in r.q.missing] == [p for p in got[r.k] if p[1] not in t[::-1]]
    plan = translation.required_terms(df, "t", translation.glossary_table(spark, pairs))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan
    with pytest.raises(ValueError, match="glossary_too_large"):
        translation.required_terms(df, "t", spark.range(10_001).select(F.col("id").cast("string").alias("source_term"), F.lit("x").alias("target_term")))


def test_term_search_holds_one_text_at_a_time(monkeypatch):
    """What the search adds to a batch of texts in Python's memory is far less than the batch."""
    texts = pa.array(["The token " + "x" * 1_000_000] * 30 + [None])
    pairs = [("token", "jeton"), ("THE", "le"), ("absent", "a")]
    monkeypatch.setattr(terms, "arrow_udf", lambda find, kind: find)  # called on arrays, not columns
    tracemalloc.start()
    try:
        found = terms.terms_in(texts, pairs)
        kept = terms.terms_kept(texts, texts, pairs)
        assert tracemalloc.get_traced_memory()[1] < texts.nbytes / 3
    finally:
        tracemalloc.stop()
    want = [{"source": s, "target": t} for s, t in pairs[:2]]
    assert found.to_pylist() == [want] * 30 + [[]]
    assert kept.to_pylist() == [{"required": want, "missing": want}] * 30 + [{"required": [], "missing": []}]
