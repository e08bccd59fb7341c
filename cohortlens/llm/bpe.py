"""BPE encoding and decoding: prefix-sharing trie traversal.

If a word's encoding is t1 … tn, then t1 … tk encodes the prefix that it covers, so each prefix has one last token, and the
encoding is read off by stepping back over last tokens. A token may follow another when no merge across their border would
have come first. The distinct words of a batch are put in order, which walks their trie depth first: the last tokens of the
path stay on a stack, and words that share a prefix share its work.

Texts are cut into pieces (blanks and what follows them), distinct pieces into words by the byte-level pattern; a text
with other white space than blanks and line ends is cut as a whole. Texts are whole, caches are bounded by bytes, and each task
encodes what it reads: nothing is shuffled.

Defined results: null text counts as empty (no tokens); special tokens in a text become their id; every input row gives
one row; an empty table gives none. Columns other than id and text are not read.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cohortlens.llm.frames import by_value, docs, few_texts, kept, release, slices

by_value(__name__)

#: Fixed value: Unicode white space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the pattern of byte-level BPE vocabularies.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
WORDS = regex.compile(PATTERN)
PIECES = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space but blanks and line ends.
ODD_SPACE = re.compile("[" + SPACE.replace(r"\t-\r ", r"\t\x0b-\r") + "]")
MARKS = ".,;:!?"
#: Bytes that a task remembers pieces in, pairs of tokens that a worker remembers, and bytes of text that are cut at once.
MEMORY, PAIRS, STEP = 112 << 20, 600_000, 2 << 20


def byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level ``tokenizer.json``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        ids = data["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: raw(s) for s, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for n, m in enumerate(data["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair, made = (ids[a], ids[b]), ids[a + b]
            if made in self.parts:
                raise ValueError(f"token {made} has two merges")
            self.rank[pair], self.parts[made] = n, (*pair, n)
        made = [i for i in self.bytes_of if i not in self.special.values()]
        # A token that merges cannot reach from its own bytes is never used.
        good = [i for i in made if i not in self.parts or self._stay_apart(*self.parts[i])]
        self.id_of = {self.bytes_of[i]: i for i in good}
        self.size = [len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of) + 1)]
        # Length of the longest token with these last three bytes: how far back a search for last tokens goes.
        self.longest: dict[bytes, int] = {}
        for t in self.id_of:
            if len(t) > 2:
                self.longest[t[-3:]] = max(self.longest.get(t[-3:], 0), len(t))
        self.apart: dict[int, bool] = {}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _stay_apart(self, a: int, b: int, before: int = 1 << 60) -> bool:
        """No merge across the border of ``a`` and ``b`` happens before step ``before``: for each token that ever ends at
        the border on the left and begins there on the right, their merge would have to come before either goes into a
        larger token (of equal merges the left one comes first)."""
        right, until = [], before
        while True:
            right.append((b, until))
            if b not in self.parts:
                break
            b, _, until = self.parts[b]
        until = before
        while True:
            for y, other in right:
                n = self.rank.get((a, y))
                if n is not None and n < until and n <= other and n < before:
                    return False
            if a not in self.parts:
                return True
            _, a, until = self.parts[a]

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Packed ids of distinct words, which are walked in order with one stack of last tokens."""
        out, last, before = {}, [-1], b""
        id_of, longest, apart, size = self.id_of.get, self.longest.get, self.apart, self.size
        if len(apart) > PAIRS:
            apart.clear()
        for w in sorted(words):
            keep, top = 0, min(len(w), len(before))
            while keep < top and w[keep] == before[keep]:
                keep += 1
            del last[keep + 1:]
            for i in range(keep + 1, len(w) + 1):
                far = longest(w[i - 3:i], 2) if i > 2 else 2
                for k in range(far if far < i else i, 0, -1):
                    t = id_of(w[i - k:i])
                    if t is None:
                        continue
                    if k == i:
                        break
                    pair = last[i - k] << 32 | t
                    ok = apart.get(pair)
                    if ok is None:
                        ok = apart[pair] = self._stay_apart(last[i - k], t)
                    if ok:
                        break
                last.append(t)
            ids, i = [], len(w)
            while i:
                ids.append(last[i])
                i -= size[last[i]]
            out[w], before = array("i", ids[::-1]).tobytes(), w
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def words(piece: str) -> list[str]:
    """Words of a piece as the pattern cuts them; letters with marks after them need no pattern."""
    core = piece.rstrip(MARKS)
    if (core[1:] if core[:1] == " " else core).isalpha():
        return [core, piece[len(core):]] if len(core) < len(piece) else [core]
    return WORDS.findall(piece)


class Encoder:
    """Encodes lists of texts; ids are packed as 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, bytes] = {}
        self.weight = 0

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        cut = {p: [w.encode() for w in words(p)] for p in pieces}
        ids = self.v.encode_words(list({w for ws in cut.values() for w in ws}))
        return {p: ids[ws[0]] if len(ws) == 1 else b"".join(map(ids.__getitem__, ws)) for p, ws in cut.items()}

    def _plain(self, texts: list[str]) -> list[bytes]:
        # A text with other white space than blanks and line ends is cut as a whole.
        whole = self._learn({t for t in texts if ODD_SPACE.search(t)})
        pieces = [[] if t in whole else PIECES.findall(t) for t in texts]
        wanted = set().union(*pieces)
        new = wanted.difference(self.known)
        # A piece takes its letters and ids (a few times over in letters outside Latin), and so much besides.
        weight = sum(map(len, new)) * 4 + 200 * len(new)
        if self.weight + weight > MEMORY:
            self.known.clear()
            new, self.weight = wanted, 0
            weight = sum(map(len, new)) * 4 + 200 * len(new)
        self.known |= self._learn(new)
        self.weight += weight
        return [whole[t] if t in whole else b"".join(map(self.known.__getitem__, ps)) for t, ps in zip(texts, pieces, strict=True)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = self.v.cut
        parts = [cut.split(t) if cut and any(s in t for s in self.v.special) else [t] for t in texts]
        plain = iter(self._plain([p for ps in parts for p in ps[::2]]))
        special = {s: array("i", [i]).tobytes() for s, i in self.v.special.items()}
        return [b"".join(special[p] if n % 2 else next(plain) for n, p in enumerate(ps)) for ps in parts]


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """``doc_id, ids array<int>, decoded``: token ids of every whole text, and the text decoded from them.

    ``vocabulary`` is the path of a byte-level ``tokenizer.json`` that every executor can read.
    """
    d = few_texts(docs(df, id_col, text_col))
    kind = pa.schema([("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = kept(f"bpe {vocabulary}", lambda: Vocabulary(vocabulary))
        encoder = Encoder(v)
        for part in (part for batch in batches for part in slices(batch, most=STEP)):
            ids = [np.frombuffer(x, dtype=np.int32) for x in encoder(part["text"].to_pylist())]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
            texts = pa.array([v.decode(x.tolist()) if decoded else None for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([part["doc_id"], lists, texts], schema=pa.schema([part.schema.field("doc_id"), *kind]))
        del encoder
        release()

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")
