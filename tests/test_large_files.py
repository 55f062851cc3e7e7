import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import ordered, review, shards
from millrace.sources import files, sinks


@pytest.fixture
def small_ranges(spark):
    """Ranges of 4 KiB, so that small files are read in many tasks."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "4096")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def one_pass(path, per_shard):
    """Bounds and digests of a file, read from its begin to its end."""
    content = path.read_bytes()
    found, error = files.scan_jsonl(content, per_shard)
    sha = hashlib.sha256(content).hexdigest()
    return [(sha, k, a, b, b - a + 1, x, y, d, None) for k, a, b, x, y, d in found] or [(sha, *[None] * 7, error)]


def test_json_lines_in_many_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(1)
    line = lambda k: json.dumps({"k": k, "t": "é x" * rng.randrange(60)}, ensure_ascii=rng.random() < 0.5)
    lines = [line(k) for k in range(900)]
    texts = {
        "closed": "".join(f"{x}\n" for x in lines), "open": "\n".join(lines), "crlf": "".join(f"{x}\r\n" for x in lines[:300]), "one": "{}", "one_closed": "7\n", "nan": "".join(f"{x}\n" for x in [*lines[:500], "NaN", "{"]), "blank": "".join(f"{x}\n" for x in [*lines[:400], "　", "{"]), "two": "1 2\n{}\n",
        "doubled": '{"a":1,"a":2}\n[1]\n', "mark": "﻿{}\n{}\n", "mark_open": "﻿{}\n{}", "deep": "[" * 100_000 + "\n",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.jsonl").write_bytes(text.encode())
    (tmp_path / "bytes.jsonl").write_bytes(b"".join(x.encode() + b"\n" for x in lines[:200]) + b'"\xff"\n')
    got = {}
    for r in files.jsonl_shards(spark, str(tmp_path), 7).orderBy("path", "chunk_index").collect():
        got.setdefault(r.path.rsplit("/", 1)[1][:-6], []).append(tuple(r)[1:])
    del texts["deep"]
    assert got.pop("deep")[0][-1] == "invalid_json:1"
    assert got == {name: one_pass(tmp_path / f"{name}.jsonl", 7) for name in [*texts, "bytes"]}
    assert got["mark"][0][-1] == "invalid_json:1" and got["bytes"][0][-1] == "invalid_utf8:201"
    assert spark.read.option("lineSep", "\n").text(str(tmp_path / "closed.jsonl")).rdd.getNumPartitions() > 4


def test_json_lines_beyond_the_old_limit(spark, tmp_path):
    """200 MiB: several tasks, the bounds of one pass."""
    body = b'{"t":"' + b"x" * 1000 + b'"}\n'
    n = (200 << 20) // len(body)
    with (tmp_path / "big.jsonl").open("wb") as f:
        for _ in range(n // 1000):
            f.write(body * 1000)
        f.write(body * (n % 1000))
    got = files.jsonl_shards(spark, str(tmp_path), 50_000).orderBy("chunk_index").collect()
    full = hashlib.sha256()
    with (tmp_path / "big.jsonl").open("rb") as f:
        while piece := f.read(1 << 20):
            full.update(piece)
    assert [(r.row_start, r.row_end, r.byte_start, r.byte_end) for r in got] == [(a + 1, min(a + 50_000, n), a * len(body), min(a + 50_000, n) * len(body)) for a in range(0, n, 50_000)]
    assert {r.source_sha256 for r in got} == {full.hexdigest()} and got[0].shard_sha256 == hashlib.sha256(body * 50_000).hexdigest()
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 1


def test_too_many_shards_and_large_records(spark, tmp_path, monkeypatch):
    (tmp_path / "many.jsonl").write_bytes(b"1\n" * 10_001)
    (tmp_path / "large.jsonl").write_bytes(b"1\n" + b'"' + b"x" * (16 << 20) + b'"\n')
    got = {r.path.rsplit("/", 1)[1]: r.error for r in files.jsonl_shards(spark, str(tmp_path), 1).select("path", "error").distinct().collect()}
    assert got == {"many.jsonl": "too_many_shards", "large.jsonl": "record_too_large:2"}


def test_rolling_digest_against_joined_texts(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "b", None]), p, rng.choice(["", "é" * 50, "x\ny", None])) for p in rng.sample(range(10**6), 500)]
    df = spark.createDataFrame(rows, "k string, p long, t string").repartition(5)
    got = {r.k: (r.n_rows, r.n_bytes, r.sha256) for r in ordered.rolling_digest(df, ["k"], [-F.col("p")], F.col("t"), ", ", "<", ">").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: -r[1])
        body = f"<{', '.join(r[2] for r in own if r[2] is not None)}>".encode()
        want[k] = (len(own), len(body), hashlib.sha256(body).hexdigest())
    assert got == want
    assert ordered.rolling_digest(df.limit(0), ["k"], [F.col("p")], F.col("t")).collect() == []


def test_ordered_files(spark, tmp_path):
    rows = [(f"job/{k % 3}", p, f"text {k} é\n" * (p % 5)) for k, p in enumerate(random.Random(4).sample(range(1000), 90))]
    df = spark.createDataFrame(rows, "job string, p int, t string").repartition(6)
    root = f"file://{tmp_path}/out"
    made = {r.key: (r.sha256, r.n_shards) for r in sinks.write_ordered(df, root, "job", "p", "t").collect()}
    digests = {r.job: (r.output_sha256, r.n_shards) for r in shards.reconciled(df, "job", "p", "t").collect()}
    for j in range(3):
        want = "\n\n".join(t for _, _, t in sorted((r for r in rows if r[0] == f"job/{j}"), key=lambda r: r[1]))
        assert (tmp_path / "out" / f"job_{j}.txt").read_bytes() == want.encode()
        assert made[f"job_{j}"] == digests[f"job/{j}"] == (hashlib.sha256(want.encode()).hexdigest(), 30)
    sinks.write_ordered(df, root, "job", "p", "t")  # the same again is fine
    with pytest.raises(Exception, match="artifact_output_exists"):
        sinks.write_ordered(df.where("p > 10"), root, "job", "p", "t")
    assert os.listdir(tmp_path / "out" / "_parts") == []
    with pytest.raises(sinks.ConflictError, match="one file name"):
        sinks.write_ordered(spark.createDataFrame([("a/b", 1, "x"), ("a_b", 1, "y")], "job string, p int, t string"), f"file://{tmp_path}/other", "job", "p", "t")


def test_interleaved_merges_both_survive(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    row = lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    assert sinks.read_version(spark, root) is None
    assert sinks.merge_version(spark, root, lambda old: row(1)) == 1
    meanwhile = []

    def slow(old):
        if not meanwhile:  # another writer comes first, once
            meanwhile.append(sinks.merge_version(spark, root, lambda now: now.union(row(2))))
        return old.union(row(3))

    assert sinks.merge_version(spark, root, slow) == 3 and meanwhile == [2]
    assert sorted(r.x for r in sinks.read_version(spark, root).collect()) == [1, 2, 3]
    assert sorted(r.x for r in sinks.read_version(spark, root, 2).collect()) == [1, 2]
    assert sinks.versions(spark, root) == [1, 2, 3] and len([p for p in os.listdir(tmp_path / "table") if p.startswith("data-")]) == 3
    with pytest.raises(sinks.ConflictError):

        def hopeless(old):
            sinks.merge_version(spark, root, lambda now: now)
            return old

        sinks.merge_version(spark, root, hopeless, attempts=2)


def test_small_files_are_created_once(spark, tmp_path):
    path = f"file://{tmp_path}/note.txt"
    sinks.write_text(spark, path, "one")
    sinks.write_text(spark, path, "one")
    with pytest.raises(sinks.ConflictError):
        sinks.write_text(spark, path, "two")
    assert not sinks._create(spark, path, "two") and (tmp_path / "note.txt").read_text() == "one"
    sinks.write_text(spark, path, "two", overwrite=True)
    assert (tmp_path / "note.txt").read_text() == "two" and [p for p in os.listdir(tmp_path) if p.endswith(".tmp")] == []


def test_artifacts_and_what_is_left_of_them(spark, tmp_path):
    root = f"file://{tmp_path}/artifacts"
    make = lambda *rows: spark.createDataFrame(rows, "shard_id string, content string")
    assert sinks.write_artifacts(make(("a", "whole text"), ("b", "é")), root, "shard_id") == {"absent": 2}
    assert sinks.write_artifacts(make(("a", "whole text")), root, "shard_id") == {"same": 1}
    sinks.write_snapshot(make(("a", "whole"), ("b", "é"), ("c", "")).withColumn("content", F.col("content").cast("binary")), root)
    with pytest.raises(sinks.ConflictError, match="conflict"):
        sinks.write_artifacts(make(("a", "whole text"), ("b", "other")), root, "shard_id")
    assert not sinks.exists(spark, f"{root}/quarantine")
    assert sinks.write_artifacts(make(("a", "whole text"), ("b", "é"), ("c", "new"), ("d", "x")), root, "shard_id") == {"cut_off": 2, "same": 1, "absent": 1}
    assert {r.shard_id: bytes(r.content).decode() for r in sinks.read_snapshot(spark, root).collect()} == {"a": "whole text", "b": "é", "c": "new", "d": "x"}
    lost = {r.shard_id: (r.name, bytes(r.content)) for r in spark.read.parquet(f"{root}/quarantine").collect()}
    assert lost == {"a": (f"interrupted-{hashlib.sha256(b'whole').hexdigest()[:16]}.partial", b"whole"), "c": (f"interrupted-{hashlib.sha256(b'').hexdigest()[:16]}.partial", b"")}
    with pytest.raises(sinks.ConflictError, match="twice"):
        sinks.write_artifacts(make(("a", "x"), ("a", "x")), root, "shard_id")


def test_reviews_need_every_shard_in_collated_order(spark):
    led = spark.createDataFrame([("s:é", "succeeded", "t"), ("s:f", "succeeded", "x"), ("s:g", "failed", None), ("s:h", "succeeded", "t")], "shard_id string, status string, o string").withColumn("output_sha256", F.sha2("o", 256)).drop("o")
    out = spark.createDataFrame([("s:é", "t"), ("s:f", "t")], "shard_id string, output string")
    got = {r.shard_id: r.reason for r in review.incomplete_reviews(led, out).collect()}
    assert got == {"s:f": "translation_review_output_hash_mismatch", "s:g": "translation_review_output_missing", "s:h": "translation_review_output_missing"}
    entries = led.select(F.lit("j").alias("job"), "shard_id")
    body = "[" + ",".join(json.dumps({"shard_id": s}, ensure_ascii=False, separators=(",", ":")) for s in ("s:é", "s:f", "s:g", "s:h")) + "]"
    assert review.review_digests(entries, "job").first().payload_sha256 == hashlib.sha256(body.encode()).hexdigest()


def test_two_batches_of_translations_are_stored(spark, tmp_path):
    cols = "namespace string, source_sha256 string, source_lang string, target_lang string, glossary_sha256 string, target_text string, review_receipt_id string, reviewer string, review_payload_sha256 string, reviewed_at string"
    batch = lambda *texts: spark.createDataFrame([("n", k, "en", "fr", None, t, "r", "o", "a" * 64, "d") for k, t in texts], cols)
    root = f"file://{tmp_path}/memory"
    assert sinks.store_memory(spark, root, batch(("k1", "one"), ("k2", "two")), F.lit(1)) == 1
    assert sinks.store_memory(spark, root, batch(("k2", "new"), ("k3", "three")), F.lit(2)) == 2
    got = {r.source_sha256: (r.target_text, r.created_at, r.updated_at) for r in sinks.read_version(spark, root).collect()}
    assert got == {"k1": ("one", 1, 1), "k2": ("new", 1, 2), "k3": ("three", 2, 2)}
    with pytest.raises(ValueError, match="memory_batch_conflict"):
        sinks.store_memory(spark, root, batch(("k4", "x"), ("k4", "y")), F.lit(3))
    assert sinks.versions(spark, root) == [1, 2]
