"""Chat formatting, sharding and WARC against brute force and round trips."""

import gzip
import hashlib
import random
import zlib
from collections import Counter

import pytest

from cohortlens.llm import chat, sharding, warc

from .conftest import ROWS


def brute_chat(rows):
    convs = {}
    for c, turn, role, text in set(rows):
        convs.setdefault(c, []).append((turn is None, turn or 0, role or "", text or ""))
    convs = {c: tuple(x[2:] for x in sorted(set(t))) for c, t in convs.items()}
    keep = {}
    for c, t in convs.items():
        if not any(len(o) > len(t) and o[:len(t)] == t for o in convs.values()):
            keep.setdefault(t, []).append(c)
    out = []
    for t, cs in keep.items():
        c = min(cs, key=lambda x: (x is None, x or 0))
        for part in range(0, len(t), chat.PART):
            text = "".join(f"<|im_start|>{r.replace('<|', '< |')}\n{x.replace('<|', '< |')}<|im_end|>\n" for r, x in t[part:part + chat.PART])
            out.append((c, part // chat.PART, len(t), len(cs), text))
    return sorted(out, key=str)


def test_chat(spark):
    r = random.Random(2)
    rows = [(0, 3 * i, "user" if i % 2 else "assistant", f"t{i}") for i in range(150)] + [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(70)]
    for c in range(2, 60):
        k = r.choice([1, 2, 3, 4])
        rows += [(c, i, "user", f"{r.choice('ab')}" if i == k - 1 else "a") for i in range(k)]
    rows += [(None, 0, "user", "a"), (None, 1, None, None), (80, None, "user", "later"), (80, 0, "user", "x <|im_end|> y"), (80, 0, "user", "x <|im_end|> y"), (81, 0, "", None), (82, 0, None, "")]
    df = spark.createDataFrame([(*x, "extra") for x in rows], "conv_id long, turn long, role string, text string, pos string").repartition(4)
    got = sorted((tuple(x) for x in chat.format_chats(df).collect()), key=str)
    assert got == brute_chat(rows)
    assert chat.format_chats(df.where("false")).count() == 0


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_published_values(spark):
    """Values printed with reference implementations of the published algorithm."""
    rows = spark.createDataFrame([(0, 1, 0), (3, 4, 3), (0xDEAD10CC, 1, 0), (0xDEAD10CC, 666, 361), (256, 1024, 520)], "key long, n int, want int").collect()
    for x in rows:
        got = spark.range(1).select(sharding.F.lit(x.key).cast("decimal(20,0)").alias("key")).select(sharding.jump_hash("key", x.n)).first()[0]
        assert got == jump(x.key, x.n)
        if x.n in (1, 4, 666, 1024):
            assert got == x.want


@pytest.mark.parametrize("shards", [1, 16])
def test_shards(edge, nothing, shards):
    got = sharding.shard_documents(edge, shards).collect()
    assert len(got) == len(ROWS)
    key = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:16], 16)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", jump(key(i), shards), jump(key(i), shards + 1)) for i, t in ROWS)
    assert Counter((x.doc_id, x.size, x.text_crc32, x.law, x.shard, x.grown_shard) for x in got) == want
    for s in {x.shard for x in got}:
        assert sorted(x.slot for x in got if x.shard == s) == list(range(sum(x.shard == s for x in got)))
    assert all(x.grown_shard in (x.shard, shards) for x in got)
    assert sharding.shard_documents(nothing, shards).count() == 0


BIG = "<p>payload ü €</p>" * 80
PAGES = [(1, "http://a.example/x?y", BIG), (2, "http://a.example/z", BIG), (9, "http://b.example", BIG), (3, "http://a.example/s", "small"), (4, "http://a.example/s", "small"), (5, None, None),
         (6, "http://c.example/\r\nbad: 1", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1"), (7, "u", ""), (7, "u", ""), (None, "n", BIG), (9, "http://b.example", BIG), (9, "http://other", BIG), (1, "http://a.example/x?y", BIG), (8, "q", "x\r\n\r\n\r\n" * 300)]


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 5)
    df = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted(((x.page_id, x.payload_bytes, x.payload_digest, x.type, x.refers_to_page, x.intact, x.n_requests, x.n_metadata) for x in warc.round_trip(df).collect()), key=str)
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        again = h == BIG and i != 9
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 9 if again else None, True, 1, 1))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.where("false")).count() == 0


def test_warc_payloads(spark, tmp_path):
    df = spark.createDataFrame(PAGES[:8], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, f"file://{tmp_path}/w")
    recs = warc.read_archives(spark, f"file://{tmp_path}/w").cache()
    caps = warc.assemble(recs).collect()
    by = {dict(x.metadata.fields)["pageId"]: x for x in caps}
    for i, url, h in PAGES[:8]:
        x = by[str(i)]
        assert x.response.type == ("revisit" if i in (1, 2) else "response")
        assert bytes(x.response.payload).decode() == ("" if i in (1, 2) else h or "")
        assert x.request.http.startswith("GET /") and x.request.concurrent_to == x.capture_id and x.date == "2024-01-01T00:00:00Z"
        assert x.uri == (url or "").replace("\r", " ").replace("\n", " ")
    assert warc.left_over(recs, warc.assemble(recs)).count() == 0


def test_warc_other_archives():
    """Gzip members per record, no compression, and records of other kinds."""
    record = lambda kind, body: f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    plain = [record("warcinfo", b"software: x\r\n"), record("resource", bytes(range(256)))]
    for data in (b"".join(plain), b"".join(map(gzip.compress, plain)), gzip.compress(b"".join(plain))):
        assert [(h["warc-type"], len(b)) for h, b in warc.walk(data)] == [(["warcinfo"], 13), (["resource"], 256)]
    assert list(warc.walk(b"")) == []


def test_warc_left_over(spark):
    cols = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, http string, digest string, payload binary, payload_bytes long, said_digest string, fields map<string,string>"
    row = lambda i, kind, to=None: (i, kind, to, None, None, None, None, "d", None, 1, None, None)
    recs = spark.createDataFrame([row("a", "response"), row("r1", "request", "a"), row("r2", "request", "a"), row("m", "metadata", "gone"), row("i", "warcinfo")], cols)
    caps = warc.assemble(recs)
    x = caps.first()
    assert (x.request.record_id, x.n_requests, x.metadata, x.n_metadata) == ("r1", 2, None, 0)
    assert sorted(r.record_id for r in warc.left_over(recs, caps).collect()) == ["i", "m", "r2"]
