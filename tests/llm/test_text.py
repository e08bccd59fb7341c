"""BPE, language ID, license scan and decontamination against other implementations, brute force or held-out rows."""

import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import bpe, decontaminate, langid, license_scan

from .conftest import ROWS

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_bpe_random(tokenizer):
    r = random.Random(1)
    parts = [*"ab  \n\n\t'sretvmld1 2½éß中😀\xa0 \x1c\x85​́ـA_-.,;", "<|endoftext|>", "the", "    ", " hello", "ing", "aaaa", "'ll", "zzzzzzzz"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(6000)]
    texts += ["".join(chr(r.choice([r.randint(1, 0x2FF), r.randint(0x300, 0xD7FF), r.randint(0x10000, 0x1FFFF)])) for _ in range(r.randint(0, 20))) for _ in range(2000)]
    v = bpe.Vocabulary(PATH)
    got = [memoryview(x).cast("i").tolist() for x in bpe.Encoder(v)(texts)]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert got == want
    assert [v.decode(x) for x in got] == [tokenizer.decode(x, skip_special_tokens=False) for x in want]


def test_bpe_rows(edge, nothing, tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "STEP", 50)
    got = bpe.encode(edge, PATH).collect()
    want = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in ROWS]
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={i}, ids={ids}, decoded={t!r})" for i, ids, t in want)
    assert bpe.encode(nothing, PATH).count() == 0


def test_language(spark, edge, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~out))
    assert model.languages == ["de", "en", "es", "fr"]
    got = langid.predict(docs.where(out), model).select((F.col("lang_pred") == F.col("row.lang")).cast("int").alias("ok"), "score")
    acc, lo, hi = got.agg(F.avg("ok"), F.min("score"), F.max("score")).first()
    assert acc > 0.98 and lo >= 0 and hi <= 1
    rows = langid.predict(edge, model).select("row.*", "lang_pred", "score").collect()
    assert len(rows) == len(ROWS)
    for x in rows:
        letters = any(map(str.isalpha, x.text or ""))
        assert (x.lang_pred != "und") == letters and (letters or x.score == 0)
    assert langid.predict(nothing, model).count() == 0
    unlabelled = langid.fit(nothing)
    assert {x.lang_pred for x in langid.predict(edge, unlabelled).collect()} == {"und"}


def test_language_chunks(monkeypatch):
    """Chunked texts have about the n-grams of whole ones."""
    letters = langid.letter_table()
    text = "Some plain text, with words 123 and more. " * 50
    whole = sum(map(len, langid.grams(text, letters)))
    monkeypatch.setattr(langid, "CHUNK", 64)
    assert abs(sum(map(len, langid.grams(text, letters))) - whole) <= 2 * len(text) // 64


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_license(t):
    w, hits, labels = words(t), [], set()
    for label, phrase in license_scan.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        hits += at
        labels |= {label} if at else set()
    return len(w), len(hits), min(hits, default=None), max(hits, default=None), ",".join(sorted(labels))


def test_license(spark, edge, nothing):
    mit = license_scan.TEMPLATES["mit"].upper()
    cut = mit.split()
    texts = ["Under the MIT License. under the mit license, CC-BY-NC 4.0", "under the under the mit license", "cc by nc by nc cc by nc", "apache license version 2",
             f"x {mit} y", "x " + " ".join(cut[:9] + ["really", "and"] + cut[9:]), " ".join(cut[:8]), "under the MIT licensK", "Kelvin K under the mit license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(edge.select("doc_id", "text"))
    got = license_scan.scan_licenses(df).collect()
    want = [(i, *brute_license(t)) for i, t in [*enumerate(texts), *ROWS]]
    assert sorted(str(tuple(x)[:6]) for x in got) == sorted(map(str, want))
    by = {x.doc_id: x for x in got if x.doc_id in (0, 4, 5) and x.n_words > 3}
    assert by[4].labels == "mit" and by[4].n_base == 0 and by[4].score == 1
    assert by[0].labels == "cc-by-nc,mit" and by[0].score == 1
    assert license_scan.scan_licenses(nothing).count() == 0


def test_license_inserted_words(spark):
    cut = license_scan.TEMPLATES["gpl"].split()
    df = spark.createDataFrame([(1, " ".join([*cut[:10], "indeed", *cut[10:]])), (2, " ".join(cut[:12])), (3, " ".join(cut[:15] + ["w"] * 200 + cut[15:]))], "doc_id long, text string")
    got = {x.doc_id: x for x in license_scan.scan_licenses(df).collect()}
    assert got[1].labels == "gpl" and 0.8 <= got[1].score < 1 and got[2].labels == "" and got[3].labels == "" and got[1].base_labels == ""


def shingles(t):
    w = words(t)
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def test_decontamination(spark, edge, nothing):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 5, 6, 12, 40, 90])))) for i in range(60)] + [(None, None), (61, LONG_ITEM), (5, "a second text of one item")]
    docs = []
    for d in range(150):
        it = r.choice(items)[1] or ""
        w = it.split()
        for _ in range(r.randint(0, 3)):
            if w:
                w[r.randrange(len(w))] = "changed"
        docs.append((d, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 300))) + " " + ", ".join(w).upper()))
    docs += ROWS
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string")
    of = {}
    for i, t in items:
        of[i] = of.get(i, set()) | shingles(t)
    want = {(d, i, len(s & shingles(t)), len(s)) for d, t in docs for i, s in of.items() if s and len(s & shingles(t)) >= (0.8 - 1e-9) * len(s)}
    got = [tuple(x)[:4] for x in decontaminate.find_items(df, it).drop("_t").collect()]
    assert len(want) > 40 and set(got) == want
    assert decontaminate.find_items(nothing, it).count() == 0
    assert decontaminate.find_items(edge, it.where("false")).count() == 0


LONG_ITEM = " ".join(f"wort{i % 977} und so" for i in range(400))


def brute_language(model, text):
    """The corrected shares from exact sets of the masks' n-grams, a gram at a time."""
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    if not any(map(str.isalpha, letters)):
        return "und", 0.0
    low = " " + re.sub(" +", " ", letters) + " "
    low += " " * (langid.N - len(low))
    hits, n = [0] * len(model.languages), len(low) - langid.N + 1
    for i in range(n):
        h = 0
        for c in low[i:i + langid.N]:
            h = (h * 0x100000001B3 + ord(c)) % (1 << 64)
        mask = -1
        for m in langid.HASHES:
            mask &= int(model.masks[(h * m % (1 << 64)) >> (64 - langid.SLOTS.bit_length() + 1)])
        hits = [x + (mask >> k & 1) for k, x in enumerate(hits)]
    v = [max((x / n - w) / (1 - w), 0) / o for x, w, o in zip(hits, model.wrong, model.own, strict=True)]
    return model.languages[v.index(max(v))], min(1.0, max(v))


def test_language_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    texts = ["a", "I", "é", "ab", "1 a 2", "a1", " a ", "abc", "The and of", "中", "x" * 9, "Straße über", "1", "", None, "a  b\tc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(docs.select("doc_id", "text").limit(40))
    for r in langid.predict(df, model).select("row.text", "lang_pred", "score").collect():
        lang, score = brute_language(model, r.text)
        assert (r.lang_pred, r.score) == (lang, pytest.approx(score)), r.text
