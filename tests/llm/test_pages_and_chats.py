import base64
import gzip
import hashlib
import random

import pytest

from millrace.llm import chat, piece_counts, warc
from millrace.llm.common import new_path
from millrace.llm.queries import CONTROL_TEXT, op2_chat, vocabulary


def archive(n=6, member=True):
    out = []
    for k in range(n):
        r = warc.record(k, f"http://h/{k}", f"<p>page {k}</p>\r\n\r\nWARC/1.1\r\nfake".encode() * 3, None, False, "d")
        out.append(gzip.compress(r, mtime=0) if member else r)
    return out


def ids(found):
    names = [f.fields["warc-record-id"].strip("<>").split(":")[-1] for f in found if f.fields]
    return [int(x) if x.isdigit() else x for x in names]


@pytest.mark.parametrize("member", [True, False])
def test_salvage_recovers_all_that_is_whole(member):
    parts = archive(member=member)
    whole = b"".join(parts)
    assert ids(warc.salvage(whole)) == list(range(6))
    rng = random.Random(1)
    for _ in range(60):
        hit = rng.randrange(6)
        at = sum(map(len, parts[:hit])) + rng.randrange(len(parts[hit]))
        broken = bytearray(whole)
        broken[at] ^= 1 << rng.randrange(8)
        found = list(warc.salvage(bytes(broken)))
        assert set(ids(found)) >= set(range(6)) - {hit}
        gaps = [f for f in found if f.fields is None]
        covered = sorted({(f.start, f.end) for f in found})
        assert covered[0][0] == 0 and covered[-1][1] == len(whole) and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))
        # A plain record's header has no check sum; elsewhere damage that matters shows.
        assert all(g.reason for g in gaps) and (gaps or hit in ids(found) or not member)
    cut = list(warc.salvage(whole[:-5]))
    assert ids(cut) == list(range(5)) and cut[-1].fields is None
    assert ids(warc.salvage(b"junk" + whole[:100] + b"\n" + parts[3])) [-1] == 3
    assert list(warc.salvage(b"")) == [] and ids(warc.salvage(warc.END_MEMBER)) == []


def test_salvage_of_many_records_in_one_member():
    rng = random.Random(4)
    records = [warc.record(k, f"http://h/{k}", rng.randbytes(3000).hex().encode(), None, False, "d") for k in range(30)]
    gaps = lambda found: [f for f in found if f.fields is None]
    broken = [r.replace(b"Content-Length: ", b"Content-Length: x", 1) if k in (0, 7, 8) else r for k, r in enumerate(records)]
    parts = archive(2)
    intact = gzip.compress(b"".join(broken), mtime=0)
    found = list(warc.salvage(parts[0] + intact + parts[1]))
    assert ids(found) == [0, *(k for k in range(30) if k not in (0, 7, 8)), 1]
    assert [(f.start, f.end) for f in gaps(found)] == [(len(parts[0]), len(parts[0] + intact))] * 2 and all(f.reason for f in gaps(found))
    whole = gzip.compress(b"".join(records), mtime=0)
    assert ids(warc.salvage(whole)) == list(range(30))
    # Truncated, at a place that isn't the end of a piece of 32768 bytes.
    found = list(warc.salvage(whole[: len(whole) * 2 // 3]))
    assert ids(found) == list(range(len(ids(found)))) and 18 <= len(ids(found)) <= 20 and len(gaps(found)) == 1
    # A check sum that differs, then an archive that goes on.
    bad = bytearray(whole)
    bad[-7] ^= 1
    found = list(warc.salvage(bytes(bad) + parts[1]))
    assert sorted(ids(found)) == sorted([*range(30), 1]) and len(gaps(found)) == 1 and gaps(found)[0].end == len(whole)
    # Stored blocks show the records' own bytes, which aren't read twice.
    bad = bytearray(gzip.compress(b"".join(records), 0, mtime=0))
    bad[-7] ^= 1
    assert ids(warc.salvage(bytes(bad) + parts[1])) == [*range(30), 1]
    # Damage inside: what comes before it is kept, nothing is invented.
    bad = bytearray(whole)
    for k in range(len(whole) // 2, len(whole) // 2 + 400):
        bad[k] ^= 0x5A
    found = list(warc.salvage(bytes(bad)))
    blocks = {r[r.index(b"\r\n\r\n") + 4 : -4] for r in records}
    assert set(range(13)) <= set(ids(found)) and len(gaps(found)) == 1 and all(f.block in blocks for f in found if f.fields)


def test_archives(spark):
    data = [(5, "http://a", "same"), (2, "http://b", "same"), (9, None, None), (4, "http://c\n x", ""), (7, "http://d", "é\r\n\r\nWARC/1.0\r\n"), (None, "http://n", "same"), (None, "http://n", "only null"), (2, "http://b", "same"), (11, "u", "x" * 300_000)]
    df = spark.createDataFrame([(*x, "clash") for x in data], "page_id long, url string, html string, first string")
    path = new_path(spark, "w")
    warc.write_archives(df, path)
    rows = warc.read_archives(spark, path, keep_html=True).collect()
    assert all(r.reason is None for r in rows)
    first = {}
    for i, _, h in data:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in data:
        p, f = (h or "").encode(), first.get(h or "")
        again = f is not None and i != f
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", f if again else None))
    key = lambda r: str(r)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows], key=key) == sorted(want, key=key)
    assert {r.html for r in rows if r.record_type == "response"} == {h or "" for _, _, h in data}
    path = new_path(spark, "w")
    warc.write_archives(df.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0
    path = new_path(spark, "w")
    warc.write_archives(df, path, min_bytes=5)
    assert {r.page_id for r in warc.read_archives(spark, path).where("record_type = 'revisit'").collect()} == set()


def brute_digest(turns):
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


NASTY = ["", None, CONTROL_TEXT, "\\", "\\\\", "####  ### x", "</turn></turn>\n### user: ", "<</turn>", "é🙂\n", "### ", "a\\### b", "\\</turn", "x" * 50_000]


def test_conversations(spark):
    rng = random.Random(8)
    data = []
    for c in [*range(40), None, -7]:
        for t in range(rng.choice([1, 2, 8])):
            data.append((c, t, rng.choice(["user", "assistant", "system", "to:ol", None]), rng.choice(NASTY)))
    data += [(500, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(700)]
    rng.shuffle(data)
    df = spark.createDataFrame([(*x, "clash") for x in data], "conv_id long, turn long, role string, text string, spans string")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.format_conversations(df)).collect()}
    want = {}
    for c, _, r, t in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        want.setdefault(c, []).append((r, t))
    assert got == {c: brute_digest(t) for c, t in want.items()}
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_windows_give_the_same_output():
    turns = [("user" if k % 2 else "assistant", NASTY[k % len(NASTY)] or "") for k in range(40)]
    whole, windowed = chat.Incremental(chat.marked_turns), chat.Incremental(chat.marked_turns, 3)
    for r, t in turns:
        whole.add(r, t)
        windowed.add(r, t)
    assert whole.text() == windowed.text() == chat.marked_turns(turns) and whole.spans == windowed.spans


def test_long_conversations_are_rendered_whole(spark):
    turns = [("user" if k % 2 else "assistant", f"text {k}") for k in range(150)]
    numbered = lambda turns: "".join(f"<{k} {turns[0][0]} {r}>{t}" for k, (r, t) in enumerate(turns))
    late = lambda turns: "".join(f"<{r}>{t if k or len(turns) <= 140 else t[:1]}" for k, (r, t) in enumerate(turns))
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(df, numbered).first()
    assert row.error is None and row.formatted == numbered(turns) and [row.formatted[s.text_start : s.text_end] for s in row.spans] == [t for _, t in turns]
    row = chat.format_conversations(df, late).first()
    assert row.formatted is None and row.error == "turn 140 rewrites what came before it"
    # A window that changes the output is an error, not another text.
    assert chat.format_conversations(df, numbered, window=32).first().error == "the parts differ from the whole conversation"


def test_rewriting_templates_are_detected(spark):
    strips = lambda turns: "".join(f"<{r}>{t if k == len(turns) - 1 else t[:3]}" for k, (r, t) in enumerate(turns))
    state = chat.Incremental(strips)
    state.add("user", "long text")
    with pytest.raises(chat.TemplateError, match="rewrites"):
        state.add("user", "b")
    with pytest.raises(chat.TemplateError, match="one place"):
        chat.Incremental(lambda turns: "".join(t[::-1] + "|" + t.upper() for _, t in turns)).add("user", "ab")
    df = spark.createDataFrame([(1, 0, "user", "long text"), (1, 1, "user", "b"), (2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.error is None for r in chat.format_conversations(df, strips).collect()} == {1: False, 2: True}


def test_control_strings_of_the_planted_conversation(spark):
    r = op2_chat(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    assert tuple(r)[1:5] == brute_digest([("user", CONTROL_TEXT), ("assistant", CONTROL_TEXT)])


def greedy(word, vocabulary):
    n, at = 0, 0
    while at < len(word):
        at = next(e for e in range(min(len(word), at + 80), at, -1) if word[at:e] in vocabulary)
        n += 1
    return n


def test_piece_counts(spark):
    path = vocabulary("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        vocab = {base64.b64decode(x.split()[0]) for x in f}
    texts = [None, "", " ", "hello world", "antidisestablishmentarianism\x0bé🙂\xa0x", "a" * 9000 + "b", "zq" * 3000, "the " * 500, "\x1c\x1f tail"]
    rng = random.Random(6)
    texts += ["".join(rng.choice("etaoin shrdlu\n.,E") for _ in range(300)) for _ in range(30)]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)] + [(None, "null id", 0)], "doc_id long, text string, n_words int")
    rows = {r.doc_id: r for r in piece_counts.count_pieces(df, path).collect()}
    for k, t in enumerate(texts):
        words = (t or "").encode().split()
        assert (rows[k].n_words, rows[k].n_pieces) == (len(words), sum(greedy(b" " + w, vocab) for w in words))
    assert piece_counts.count_pieces(df.limit(0), path).count() == 0


def test_small_automata_against_brute_force():
    rng, single = random.Random(2), [bytes((b,)) for b in range(256)]
    for _ in range(40):
        vocab = {bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 6))) for _ in range(12)} | set(single)
        a = piece_counts.Automaton(vocab)
        for _ in range(40):
            w = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30)))
            assert a.count(w) == greedy(w, vocab)
    with pytest.raises(ValueError, match="single bytes"):
        piece_counts.Automaton([b"a"])
