"""Phrase collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from cohortlens.llm import collocations

from .conftest import ROWS

SCHEMA = "lang string, text string, phrase string, a string, n string, prefix string, next string, m string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count, subsumed, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        longer = Counter()
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i:i + m]] = max(longer[p[i:i + m]], a)
        found = []
        for p, a in often.items():
            if 100 * longer[p] < subsumed * a:
                score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.fixture(scope="module")
def some():
    r = random.Random(4)
    words = ["a", "b", "c", "dd", "E", "ü", "中文", "f\x1cg", "\x85", "the", "The"]
    rows = []
    for _ in range(300):
        t = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", "!?"]) for _ in range(r.randint(0, 40)))
        rows.append((r.choice(["en", "de", None, "und"]), t))
    # Repeated rows, a passage that many rows share, empty texts and nulls, and a long text.
    rows += rows[:40] + [("en", "once upon a time there was")] * 60 + [("en", None), (None, ""), ("fr", None)]
    return rows + [("en", " ".join(r.choice(words) for _ in range(20_000)))]


@pytest.mark.parametrize("held", [(2_500_000, 48_000_000, 4_000_000, 500_000), (50, 48_000_000, 7, 3), (2_500_000, 300, 64, 10)])
def test_against_brute_force(spark, some, held, monkeypatch):
    for name, value in zip(("WORDS", "BYTES", "SEGMENT", "STEP"), held, strict=True):
        monkeypatch.setattr(collocations, name, value)
    df = spark.createDataFrame([(a, t, *"xxxxxx") for a, t in some], SCHEMA)
    for min_count, subsumed, top in ((30, 80, 2000), (3, 50, 25)):
        assert rows_of(collocations.collocations(df, min_count=min_count, subsumed=subsumed, top=top)) == brute(some, min_count, subsumed, top)


def test_a_full_table_of_parts_changes_nothing(spark, some, monkeypatch):
    for name in ("LEAST", "MOST"):
        monkeypatch.setattr(collocations, name, 64)
    df = spark.createDataFrame([(a, t, *"xxxxxx") for a, t in some], SCHEMA)
    assert rows_of(collocations.collocations(df)) == brute(some, 30, 80, 2000)


def test_edge_rows(edge, nothing):
    rows = [("en" if i else None, t) for i, t in ROWS]
    assert rows_of(collocations.collocations(edge)) == brute(rows, 30, 80, 2000)
    assert collocations.collocations(nothing).collect() == []
