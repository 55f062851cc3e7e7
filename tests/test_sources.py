import json
import os
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from millrace.sources import files, sinks
from millrace.streaming import deltas


def test_jsonl_bounds(spark, tmp_path):
    records = ['{"a":"é"}', '{"b":"雪"}', '{"c":"🙂"}']
    data = (records[0] + "\r\n" + records[1] + "\r\n" + records[2]).encode()
    (tmp_path / "x.jsonl").write_bytes(data)
    (tmp_path / "bad.jsonl").write_bytes(b'{"a":1}\nNaN\n')
    (tmp_path / "blank.jsonl").write_bytes(b'{"a":1}\n\n{"b":1}')
    (tmp_path / "utf.jsonl").write_bytes(b'"\xff"')
    (tmp_path / "two.jsonl").write_bytes(b"1 2\n")
    got = {}
    for r in files.jsonl_shards(spark, str(tmp_path), 2).orderBy("path", "chunk_index").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.row_start, r.row_end, r.byte_start, r.byte_end, r.error))
    first = len((records[0] + "\r\n" + records[1] + "\r\n").encode())
    assert got["x.jsonl"] == [(1, 2, 0, first, None), (3, 3, first, len(data), None)]
    assert [got[f"{n}.jsonl"][0][4] for n in ("bad", "blank", "utf", "two")] == ["invalid_json:2", "blank_record:2", "invalid_utf8:1", "invalid_json:1"]
    shards = files.jsonl_shards(spark, str(tmp_path), 2, "x.jsonl").withColumn("input_path", F.col("path")).withColumn("inline_text", F.lit(None).cast("string"))
    texts = [r.input_text for r in files.read_slices(shards, files.binary_files(spark, str(tmp_path), "x.jsonl")).orderBy("chunk_index").collect()]
    assert "".join(texts).encode() == data


def test_texts(spark, tmp_path):
    for n, b in (("a", b"ok \xc3\xa9"), ("b", b"\xff"), ("c", b"")):
        (tmp_path / f"{n}.txt").write_bytes(b)
    assert [(r.text, r.error) for r in files.text_files(spark, str(tmp_path)).orderBy("path").collect()] == [("ok é", None), (None, "invalid_utf8")]


def test_probes_and_pages(spark):
    probe = json.dumps({"streams": [{"codec_type": "audio", "codec_name": "aac", "codec_long_name": "AAC", "is_avc": "false", "secret": "x"}], "format": {"duration": "1.5", "format_name": "mp4"}})
    df = spark.createDataFrame([("a", probe), ("b", '{"streams":[],"format":{"duration":"1"}}'), ("c", "junk")], "id string, probe string")
    r = files.probed_media(df, F.col("probe")).collect()
    assert [(x.id, x.media_type, x.duration_seconds, x.container) for x in r] == [("a", "audio", 1.5, "mp4")] and "secret" not in r[0].streams[0].asDict() and (r[0].streams[0].codec_long_name, r[0].streams[0].is_avc) == ("AAC", "false")
    pages = spark.createDataFrame([("s", 1, bytearray(b"img")), ("s", 2, bytearray(b""))], "source_id string, page_number long, content binary")
    assert [x.error for x in files.ocr_pages(pages, lambda c, p: c.decode()).orderBy("page_number").collect()] == [None, "ocr_empty"]
    assert files.ocr_pages(pages).where("text is not null").count() == 2
    assert files.engine_text({"pages": [{"markdown": " "}, {"text": "x"}, ["y", {"result": "z"}]]}) == "x\n\ny\n\nz"


def test_manifests_and_ledgers(spark, tmp_path):
    good = '{"project":"p","items":[{"id":"a","prompt":"x","metadata":{"k":"v"}}]}'
    df = spark.createDataFrame([(good,), ('{"items":[]}',), ("{",), ("null",)], "t string")
    assert [r.error for r in files.manifests(df, "t", files.RUN_MANIFEST, ("items",)).collect()] == [None, *["invalid_manifest"] * 3]
    for job, text in (("b", '{"job_id":"b","status":"running","updated_at":"2024-01-02","shards":[]}'), ("a", '{"job_id":"a","status":"completed","updated_at":"2024-01-03","shards":[]}'), ("x", "junk")):
        (tmp_path / job).mkdir()
        (tmp_path / job / "ledger.json").write_text(text)
    assert [r.job_id for r in files.running_jobs(spark, str(tmp_path)).collect()] == ["b"]
    assert [r.job_id for r in files.newest_jobs(spark, str(tmp_path)).collect()] == ["a", "b"]
    assert files.pinned_text(spark, [str(tmp_path / "a/ledger.json"), str(tmp_path / "none")]).startswith('{"job_id":"a"')


def test_paths():
    assert files.safe_path("/in/a/b.txt", "/in") and not files.safe_path("/in/../etc/x", "/in") and not files.safe_path("/in/.ssh/x", "/in") and not files.safe_path("/in/.env.local", "/in") and not files.safe_path("/other", "/in")


@pytest.mark.parametrize(
    "part",
    [".git/config", "secrets/a.txt", "tokens/a", "a/token/b", "certs/a", "x.pem", "x.KEY", "my.p12", ".ssh/a", ".gnupg/a", ".aws/a", ".kube/a", "Library/Keychains/a", ".config/opencode/auth.json", ".codex/auth", ".env", ".env.local", "id_rsa", "id_ed25519", "authorized_keys", "known_hosts", "my_token.txt", "api-secret.json", "auth.json", "db.password", "private_key", "Passwords/x", "Users/me/Documents/Obsidian/x.md", "private-workspace-state/x", ".npmrc", "a\0b"],
)
def test_sensitive_paths(spark, part):
    assert "\0" in part or spark.range(1).select(files.sensitive(F.lit(f"/in/{part}"))).first()[0]
    assert not files.safe_path(f"/in/{part}", "/in")


@pytest.mark.parametrize("part", ["a.txt", "environment.txt", "secretary.md", "tokenizer.json", "authors.txt", "keys/a.txt", "git/a", "etc/a"])
def test_other_paths(spark, part):
    assert not spark.range(1).select(files.sensitive(F.lit(f"/in/{part}"))).first()[0]
    assert files.safe_path(f"/in/{part}", "/in")
    assert not files.safe_path(f"/etc/{part}", "/etc") and not files.safe_path(f"/system/{part}", "/system")


def test_a_snapshot_pointer_is_replaced_in_one_step(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "CURRENT")
    sinks.write_text(spark, path, "one")
    sinks.write_text(spark, path, "two", overwrite=True)
    assert (tmp_path / "CURRENT").read_text() == "two" and not list(tmp_path.glob("*.tmp"))
    assert spark.read.text(path).first().value == "two"


def test_runs_are_stored_once(spark, tmp_path):
    root = str(tmp_path / "r")
    run = spark.createDataFrame([("r1", "{}")], "run_id string, manifest string")
    items = spark.createDataFrame([("r1", "a", "x"), ("r1", "b", "y")], "run_id string, item_id string, payload string")
    assert [sinks.create_run(spark, root, run, items) for _ in range(2)] == [2, 0]
    assert [spark.read.parquet(f"{root}/{t}").count() for t in ("items", "runs", "events")] == [2, 1, 1]
    with pytest.raises(sinks.ConflictError):
        sinks.create_run(spark, root, run.withColumn("manifest", F.lit("other")), items)


def test_a_lock_has_one_owner(spark, tmp_path):
    path = str(tmp_path / "lock")
    assert sinks.acquire_lock(spark, path, "a") and not sinks.acquire_lock(spark, path, "b")
    assert not sinks.release_lock(spark, path, "b") and sinks.release_lock(spark, path, "a")
    assert sinks.acquire_lock(spark, path, "b")
    os.utime(path, (1_000_000_000, 1_000_000_000))
    assert sinks.acquire_lock(spark, path, "c") and not sinks.acquire_lock(spark, path, "d")
    assert (tmp_path / "lock").read_text() == "c"


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as con:
        con.execute("create table runs (id integer primary key, name text)")
        con.executemany("insert into runs values (?, ?)", [(k, f"n{k}") for k in range(100)])
    spark.dataSource.register(files.SqliteSource)
    df = spark.read.format("sqlite").schema("id long, name string").option("table", "runs").load(path)
    assert df.count() == 100 and df.agg(F.sum("id")).first()[0] == 4950


def test_outputs_never_clobber(spark, tmp_path):
    root = str(tmp_path / "o")
    rows = spark.createDataFrame([("j", "a", "x", "v"), ("j", "b", "y", "v")], "job_id string, shard_id string, output string, processor_version string")
    assert sinks.commit_outputs(rows, root, ["processor_version"]) == 2
    assert sinks.commit_outputs(rows, root, ["processor_version"]) == 0
    with pytest.raises(sinks.ConflictError):
        sinks.commit_outputs(rows.withColumn("output", F.lit("other")), root, ["processor_version"])
    sinks.write_text(spark, f"{root}/r.txt", "one")
    sinks.write_text(spark, f"{root}/r.txt", "one")
    with pytest.raises(sinks.ConflictError):
        sinks.write_text(spark, f"{root}/r.txt", "two")
    sinks.write_snapshot(rows, f"{root}/t")
    sinks.write_snapshot(rows.limit(1), f"{root}/t")
    assert sinks.read_snapshot(spark, f"{root}/t").count() == 1
    report = sinks.report_json(rows.select("job_id").distinct(), {"shards": rows.select("job_id", "shard_id")}, "job_id").first()
    assert json.loads(report.report) == {"job_id": "j", "shards": [{"shard_id": "a"}, {"shard_id": "b"}]}


def chunk(**delta):
    return "data: " + json.dumps({"choices": [{"delta": delta}]})


LINES = [chunk(content="He"), ": ping", chunk(content="llo", tool_calls=[{"index": 0, "id": "c1", "function": {"name": "f", "arguments": "{"}}]), "data: junk", chunk(tool_calls=[{"index": 0, "function": {"arguments": "}"}}, {"index": 1, "id": "c2", "function": {"name": "g"}}]), 'data: {"choices":[],"usage":{"total_tokens":7}}', "data: [DONE]"]


def test_assembly(spark):
    df = spark.createDataFrame([("s", k, x) for k, x in enumerate(LINES)], "s string, k int, value string")
    r = deltas.assemble(deltas.deltas(df), "s", "k").first()
    assert (r.text, r.usage.total_tokens) == ("Hello", 7) and [tuple(c) for c in r.tool_calls] == [(0, "c1", "f", "{}"), (1, "c2", "g", "")]


def test_streams(spark, tmp_path):
    for k, x in enumerate(LINES):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{k}.json").write_text(json.dumps({"s": "s", "k": k, "value": x}))
        os.utime(tmp_path / f"in/{k}.json", (1_000_000_000 + k, 1_000_000_000 + k))  # files arrive in this order
    stream = spark.readStream.schema("s string, k int, value string").option("maxFilesPerTrigger", 2).json(str(tmp_path / "in"))
    out = []
    done = deltas.assemble_stream(deltas.deltas(stream), "s", "k")
    q = done.writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert (out[-1].text, out[-1].total_tokens, out[-1].parts) == ("Hello", 7, 4)
    got = []
    assert deltas.work_available(stream, lambda df, n: got.append(df.count()), str(tmp_path / "c2")) >= 3 and sum(got) == len(LINES)
    assert deltas.work_available(stream, lambda df, n: got.append(df.count()), str(tmp_path / "c2")) == 0


def test_event_windows(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert deltas.windowed_counts(events, "ts", "event_type").agg(F.sum("count")).first()[0] == events.count()


def test_supervisor(spark, tmp_path):
    jobs, worked = spark.createDataFrame([("a",), ("b",), ("c",)], "job_id string"), []

    def work(job):
        worked.append(job)
        if job == "b":
            raise RuntimeError("x")

    reports = deltas.supervise(spark, lambda: jobs, work, str(tmp_path), cycles=3, jobs=2, keep=2)
    assert worked == ["a", "b", "c", "a", "b", "c"] and len(reports) == 2 and reports[-1]["errors"] == {"b": "RuntimeError: x"}
    with pytest.raises(ValueError):
        deltas.supervise(spark, lambda: jobs, work, str(tmp_path), cycles=0)


def test_any_split_of_the_bytes_gives_the_same_responses(spark, tmp_path):
    chunk = lambda **delta: "data: " + json.dumps({"choices": [{"delta": delta}]}, ensure_ascii=False)
    call = lambda k, **f: {"index": k, "function": f} | ({"id": f.pop("id")} if "id" in f else {})
    lines = [
        chunk(content="hé🙂"), ": comment", "", "  " + chunk(reasoning_content="why　") + "\r", "data: {broken", chunk(content="llo", tool_calls=[call(1, id="b", name="se", arguments='{"q"')]), chunk(tool_calls=[call(0, id="a", name="list"), call(1, name="arch", arguments=':"é"}')]),
        "data: " + json.dumps({"choices": [], "usage": {"prompt_tokens": 3, "completion_tokens": 4, "total_tokens": 7}}), "data: [DONE]", chunk(content=" end"),
    ]
    body = "\n".join(lines).encode()
    whole = spark.createDataFrame([("r", k, line) for k, line in enumerate(lines)], "s string, k int, value string")
    want = deltas.assemble(deltas.deltas(whole), "s", "k").first()
    rng = random.Random(5)
    for r in range(4):
        cuts = sorted(rng.sample(range(1, len(body)), 25))
        pieces = [body[a:b] for a, b in zip([0, *cuts], [*cuts, len(body)], strict=True)]
        source, at = tmp_path / f"in{r}", 0
        for n, size in enumerate((1, 7, 2, 16)):
            rows = [(s, at + i, p) for s in ("r", "q") for i, p in enumerate(pieces[at : at + size])]
            spark.createDataFrame(rows, "s string, k int, data binary").coalesce(1).write.mode("append").parquet(str(source))
            at += size
            del n
        stream = spark.readStream.schema("s string, k int, data binary").option("maxFilesPerTrigger", 1).parquet(str(source))
        out = deltas.assemble_bytes(stream, "s", "k")
        q = out.writeStream.format("memory").queryName(f"bytes{r}").outputMode("update").option("checkpointLocation", str(tmp_path / f"at{r}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        rows = spark.table(f"bytes{r}").where(F.col("n_bytes") == len(body)).collect()
        assert len(rows) == 2
        for got in rows:
            assert (got.text, got.reasoning, got.prompt_tokens, got.completion_tokens, got.total_tokens) == (want.text, want.reasoning, 3, 4, 7) and got.text == "hé🙂llo end"
            assert [tuple(c) for c in got.tool_calls] == [tuple(c) for c in want.tool_calls] == [(0, "a", "list", ""), (1, "b", "search", '{"q":"é"}')]


def test_a_response_is_the_same_at_every_cut():
    line = b'data: {"choices":[{"delta":{"content":"\xc3\xa9\xf0\x9f\x99\x82"}}]}\n'
    for cut in range(len(line) * 2):
        r = deltas.Response()
        r.feed((line * 2)[:cut])
        r = deltas.Response(r.state())
        r.feed((line * 2)[cut:])
        assert r.state() == (b"", "é🙂é🙂", "", None, None, None, [], len(line) * 2)
