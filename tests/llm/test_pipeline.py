import struct
import sys
import zlib
from pathlib import Path

from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from millrace.llm import secrets
from millrace.llm.common import new_path
from millrace.llm.queries import vocabulary

from .test_mixing import size, water
from .test_ngram_join import brute
from .test_quality import plain_kept
from .test_secrets import brute_findings

SMALL = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, name)
        stage(spark, docs, SMALL).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept[name] = (before, docs)
        assert name == "sequence_packing" or docs.columns == columns
    before, after = kept["quality_rules"]
    rows = before.collect()
    want = [r for r, (kept, _) in zip(rows, plain_kept([r.text for r in rows]), strict=True) if kept]
    assert 0 < len(want) < len(rows) and sorted(map(tuple, after.collect())) == sorted(map(tuple, want))
    before, after = kept["near_duplicates"]
    classes = brute([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, c, _, _ in classes})
    before, after = kept["secret_scan"]
    assert sorted(r.doc_id for r in before.collect()) == sorted(r.doc_id for r in after.collect())
    assert after.where("text rlike 'token = \"[0-9a-f]{40}'").count() == 0
    before, after = kept["source_mix"]
    sizes, taken = {}, {}
    for r in before.collect():
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    for r in after.collect():
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
    want = water(sizes)
    # within a document of the source, which is taken whole or not
    most = {s: max(size(r.text) for r in before.collect() if r.source == s) for s in want}
    assert all(abs(taken.get(s, 0) - want[s]) <= most[s] / 2 + 2 for s in want)
    assert {r.text for r in after.collect()} <= {r.text for r in before.collect()}
    before, after = kept["sequence_packing"]
    plain = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = [[*plain.encode(r.text or "", add_special_tokens=False).ids, 1] for r in before.collect()]
    rows = after.collect()
    assert sum(r.length for r in rows) == sum(map(len, ids))
    whole = {zlib.crc32(struct.pack(f"<{len(x)}I", *x)) for x in ids if len(x) <= 128}
    assert {r.ids_crc32 for r in rows if r.length == r.doc_tokens and r.length <= 128} <= whole


def test_run_and_edge_rows(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, "short text", None, "a", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            stage(spark, rows, SMALL).collect()
