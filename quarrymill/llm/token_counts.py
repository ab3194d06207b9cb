"""Token counts: greedy longest-match piece counts by a linear automaton, without building pieces.

The automaton is a trie of the vocabulary with, at every node, a failure link and the
number of pieces that following it pops; each byte of a word is read once. Nodes are
numbered breadth-first. A word that the vocabulary can't spell counts as one unknown
piece. With a continuation marker, pieces after a word's first are looked up behind
the marker; with none, one vocabulary serves both.

Words are the runs without ASCII white space ([^\\x20\\x09-\\x0D]+), each with the prefix
put before it. A null text counts as empty: 0 words, 0 tokens. Texts are read whole, in
time that grows with their length. Where two pieces fit, the longer one counts. Each row
stands for itself: repeated rows and null ids come out as they go in. Columns other than
doc_id and text, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import json
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a tokenizer file's byte-level vocabulary, as bytes; added tokens aside."""
    spec = json.load(open(path, encoding="utf-8"))
    letters = byte_letters()
    added = {t["content"] for t in spec.get("added_tokens", [])}
    return [bytes(letters[c] for c in t) for t in spec["model"]["vocab"] if t not in added and all(c in letters for c in t)]


class Automaton:
    """Counts the pieces of greedy longest-match-first segmentation in one pass over a word."""

    def __init__(self, pieces: list[bytes], marker: bytes = b"") -> None:
        go: list[dict[int, int]] = [{}]
        end = [False]

        def put(s: bytes) -> int:
            v = 0
            for b in s:
                nxt = go[v].get(b)
                if nxt is None:
                    nxt = go[v][b] = len(go)
                    go.append({})
                    end.append(False)
                v = nxt
            return v

        for p in pieces:
            if p:
                end[put(p)] = True
        inner = put(marker) if marker else 0
        fail: list[int] = [-1] * len(go)
        pops = [0] * len(go)
        queue = deque([0] if inner == 0 else [0, inner])
        reached = {0, inner}
        while queue:
            u = queue.popleft()
            for b, v in go[u].items():
                if v in reached:
                    continue
                reached.add(v)
                if end[v]:
                    fail[v], pops[v] = inner, 1
                else:
                    z, n = fail[u], pops[u]
                    while z >= 0 and b not in go[z]:
                        n += pops[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], pops[v] = go[z][b], n
                queue.append(v)
        self.go, self.fail, self.pops, self.inner = go, fail, pops, inner

    def count(self, word: bytes) -> int:
        """The number of pieces of a word, or -1 if it can't be spelled."""
        go, fail, pops, inner = self.go, self.fail, self.pops, self.inner
        v = n = 0
        for b in word:
            while (nxt := go[v].get(b)) is None:
                if fail[v] < 0:
                    return -1
                n += pops[v]
                v = fail[v]
            v = nxt
        while v != inner:
            if v == 0:
                return n
            if fail[v] < 0:
                return -1
            n += pops[v]
            v = fail[v]
        return n


class Counts(dict):
    """Piece counts of words seen; bounded: cleared when it holds most words."""

    def __init__(self, automaton: Automaton, prefix: bytes, most: int = 500_000) -> None:
        super().__init__()
        self.automaton, self.prefix, self.most = automaton, prefix, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self.automaton.count(self.prefix + word)
        if len(word) <= 64:
            self[word] = n
        return n


_LOADED: dict = {}


def _counts(path: str, marker: bytes, prefix: bytes) -> Counts:
    key = (path, marker, prefix)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Counts(Automaton(vocabulary(path), marker), prefix)
    return _LOADED[key]


def count_tokens(docs: DataFrame, path: str, marker: bytes = b"", prefix: bytes = b" ") -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_words, n_tokens, n_unknown); no shuffle. path: a tokenizer file with a byte-level vocabulary."""
    small_batches(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])

    def run(batches):
        counts = _counts(path, marker, prefix)
        for batch in batches:
            words, tokens, unknown = [], [], []
            for t in batch.column(1).to_pylist():
                w = (t or "").encode().split()
                c = [counts[x] for x in w]
                bad = c.count(-1)
                words.append(len(w))
                tokens.append(sum(c) + 2 * bad)
                unknown.append(bad)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))], schema=out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
