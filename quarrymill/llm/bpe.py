"""BPE encoding and decoding by traversal of a trie of distinct words.

Byte-pair encoding has a last-token property: the encoding of a word's prefix is the
encoding of a shorter prefix followed by one token, and that token is the only one
that ends there and whose joint with the token before survives the merges. So the
trie of the distinct words is walked depth-first, each node with the last token of its
path as its state, and what words share at their start is worked out once. The trie is
held as its words in order: the start that a word shares with the one before it is the
path that stays, the rest of it are new nodes. An automaton over the tokens gives those
that end at a node, the longest first.

Whether two neighbouring tokens stay apart follows from their merge trees: on the
facing sides, no pair of pieces that exist at one time may merge before either is taken
up into a larger one.

Texts are normalized and split into words by the library's normalizers and its classes
of letters and digits. Arrow numbers the words of a batch; only its distinct ones are
looked up, and a word's ids are worked out once in a worker, as long as it is kept.

Nulls and empty texts have no tokens. Texts are encoded whole, whatever their length.
Strings of added tokens in a text become those tokens, before normalization, as the
library does. Each row stands for itself: repeated rows, ties and null ids come out as
they go in. Columns other than doc_id and text, whatever their names, are not read. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Callable, Collection, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import small_batches, task_starts
from .token_counts import byte_letters

#: Fixed value: Unicode white space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def character_class(kind: str, most: int) -> str:
    """A character class, in brackets' inner form, of the code points up to most that the library has in kind, a Unicode category."""
    runs = pre_tokenizers.Split(Regex(f"[\\p{{{kind}}}]+"), "removed", invert=True)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(most + 1))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for _, (a, b) in runs.pre_tokenize_str(every))


class Worked(dict):
    """Keys to what function gives for them, worked out when first asked for."""

    def __init__(self, function: Callable[[int], object]) -> None:
        self.function = function

    def __missing__(self, key: int):
        value = self[key] = self.function(key)
        return value


class WordBpe:
    """A BPE tokenizer file whose last letter of a word carries a suffix; words split by a fixed pattern."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names = {k: t for t, k in self.vocab.items()} | {k: t for t, k in self.added.items()}
        self.letter = {b: c for c, b in byte_letters().items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # what a token was merged of, and at which rank
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair, whole = (self.vocab[a], self.vocab[b]), self.vocab[a.removesuffix(self.suffix) + b if self.suffix and a.endswith(self.suffix) else a + b]
            if pair not in self.rank:
                self.rank[pair] = r
                self.parts.setdefault(whole, (*pair, r))
        # tokens by their bytes, apart by whether they end a word
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        back = byte_letters()
        for t, k in self.vocab.items():
            ends = bool(self.suffix) and t.endswith(self.suffix) and len(t) > len(self.suffix)
            s = t.removesuffix(self.suffix) if ends else t
            if k in self.added.values() or not all(c in back for c in s):
                continue
            (self.final if ends else self.inner)[bytes(back[c] for c in s)] = k
        self.size = {k: len(s) for s, k in [*self.inner.items(), *self.final.items()]}
        if not self.suffix:
            self.final = self.inner
        self.four = {k: struct.pack("<I", k) for k in self.size}
        # the automaton's states: the starts of tokens, numbered; a path's state is its longest suffix among them
        self.starts = list(dict.fromkeys(t[:k] for t in (b"", *self.inner, *self.final) for k in range(len(t) + 1)))
        self.number = {s: k for k, s in enumerate(self.starts)}
        self.forget()
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        # Fixed value: the pattern that the file's Split pre-tokenizer keeps the matches of; letters and digits stand first, as no other branch starts with one. A class within the first plane is a table look-up, so texts with others have their own pattern.
        self.words = []
        for most in (0xFFFF, 0x10FFFF):
            letters, digits = character_class("L", most), character_class("N", most)
            self.words.append(re.compile(rf"[{letters}]+|[{digits}]|'s|'t|'re|'ve|'m|'ll|'d|[^{SPACE}{letters}{digits}]+"))
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def forget(self) -> None:
        """Begin with empty tables of what was worked out."""
        self.pairs = self.steps = 0
        self.apart: dict[int, Worked] = {}
        self.step = Worked(self._step)

    def _step(self, key: int) -> tuple[int, list, list]:
        """The state after a byte (key: state << 8 | byte), and the tokens that end there, inner and final ones."""
        path = self.starts[key >> 8] + bytes((key & 255,))
        while path not in self.number:
            path = path[1:]
        self.steps += 1
        return self.number[path], self._ending(path, self.inner), self._ending(path, self.final)

    def _ending(self, path: bytes, tokens: dict[bytes, int]) -> list[tuple[int, int, Worked]]:
        """The tokens at a path's end, the longest first: length, id, and whether it stays apart from a token before it."""
        out = []
        for k in range(len(path)):
            t = tokens.get(path[k:])
            if t is not None:
                if t not in self.apart:
                    self.apart[t] = Worked(lambda before, t=t: self.stay_apart(before, t))
                out.append((len(path) - k, t, self.apart[t]))
        return out

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether no merge joins the right side of a with the left side of b. Both are taken apart, what was merged last first."""
        self.pairs += 1
        taken_a = taken_b = float("inf")
        letter = (-1, -1, -1)
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < taken_a and r <= taken_b:
                return False
            _, right, made_a = self.parts.get(a, letter)
            left, _, made_b = self.parts.get(b, letter)
            if made_a > made_b:
                a, taken_a = right, made_a
            elif made_b >= 0:  # of equal tokens the right one was merged last
                b, taken_b = left, made_b
            else:
                return True

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """The ids (little-endian) of distinct words, by one depth-first walk over their trie."""
        if self.pairs > 1_000_000 or self.steps > 300_000:
            self.forget()
        out: dict[bytes, bytes] = {}
        step, size, four = self.step, self.size, self.four
        # of the current path's first d bytes: the last token and the automaton's state
        last, states = [-1], [0]
        before = b""
        for word in sorted(words):
            d, most = 0, min(len(before), len(last) - 1)
            while d < most and word[d] == before[d]:
                d += 1
            del last[d + 1 :], states[d + 1 :]
            state = states[d]
            for byte in word[d:-1]:
                d += 1
                state, ending, _ = step[state << 8 | byte]
                for n, t, apart in ending:
                    if n == d or apart[last[d - n]]:
                        break
                else:
                    raise ValueError(f"no token ends {word[:d]!r}")
                last.append(t)
                states.append(state)
            d = len(word)
            for n, t, apart in step[state << 8 | word[-1]][2]:
                if n == d or apart[last[d - n]]:
                    break
            else:
                raise ValueError(f"no token ends {word!r}")
            ids, d = [four[t]], d - n
            while d > 0:
                t = last[d]
                ids.append(four[t])
                d -= size[t]
            out[word] = b"".join(ids[::-1])
            before = word
        return out

    def words_of(self, text: str) -> list[str]:
        """The words of a text in order, normalized; added tokens as written behind a space, which no word holds."""
        if not any(t in text for t in self.added):
            return self._words(text)
        out: list[str] = []
        for k, part in enumerate(self.split_added.split(text)):
            out += [" " + part] if k % 2 else self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.words[0].findall(text.lower())
        text = self.normalizer.normalize_str(text)
        return self.words[bool(_BEYOND.search(text))].findall(text)


class Known:
    """Ids (little-endian bytes) of words seen. Bounded: cleared when it would hold over most words, or over letters code points of them, but for those of the texts at hand."""

    def __init__(self, path: str, most: int = 500_000, letters: int = 8_000_000) -> None:
        self.bpe, self.most, self.letters = WordBpe(path), most, letters
        names = self.bpe.names
        self.names = pa.array([names.get(k, "") for k in range(max(names, default=0) + 1)], pa.large_string())
        self.ids: dict[str, bytes] = {}
        self.held = 0

    def learn(self, words: Collection[str]) -> None:
        new = [w for w in words if w not in self.ids]
        more = sum(map(len, new))
        if len(self.ids) + len(new) > self.most or self.held + more > self.letters:
            self.ids.clear()
            new, self.held, more = list(words), 0, sum(map(len, words))
        self.held += more
        plain = [w.encode() for w in new]
        got = self.bpe.encode_words([w for w in plain if w[:1] != b" "])
        for w, p in zip(new, plain, strict=True):
            self.ids[w] = got[p] if p in got else struct.pack("<I", self.bpe.added[w[1:]])

    def encoded(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin (and the last one's end)."""
        words: list[str] = []
        ends = [0]
        for t in texts:
            if t:
                words += self.bpe.words_of(t)
            ends.append(len(words))
        numbered = pa.array(words, pa.large_string()).dictionary_encode()
        del words
        distinct = numbered.dictionary.to_pylist()
        self.learn(distinct)
        packed = [self.ids[w] for w in distinct]
        ids = np.frombuffer(b"".join(packed), "<u4")
        count = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        first = np.cumsum(count) - count
        word = numbered.indices.to_numpy()
        count = count[word]
        begins = np.concatenate([[0], np.cumsum(count)])
        # a word's ids stand together in ids, and so do its places in the result
        at = np.repeat(first[word] - begins[:-1], count)
        at += np.arange(begins[-1])
        return ids[at], begins[ends]

    def decoded(self, ids: np.ndarray, begins: np.ndarray) -> pa.Array:
        """The token strings of each text, joined by spaces."""
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(begins), self.names.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))


_KNOWN: dict[str, Known] = {}


def known(path: str) -> Known:
    if path not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[path] = Known(path)
    return _KNOWN[path]


def encode(docs: DataFrame, path: str, full: bool = False) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_tokens, ids_sha256, decoded_sha256), with full=True also ids (binary, little-endian unsigned 32-bit) and decoded.

    decoded joins the token strings by spaces, as the library does for a file without a decoder. No shuffle.
    """
    small_batches(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + ([("ids", pa.binary()), ("decoded", pa.string())] if full else []))

    def run(batches):
        task_starts("bpe", _KNOWN)
        k = known(path)
        for batch in batches:
            ids, begins = k.encoded(batch.column(1).to_pylist())
            text = k.decoded(ids, begins)
            each = [ids[a:b].tobytes() for a, b in zip(begins, begins[1:], strict=False)]
            columns = [np.diff(begins), [hashlib.sha256(x).hexdigest() for x in each], [hashlib.sha256(x).hexdigest() for x in text.cast(pa.large_binary()).to_pylist()]]
            if full:
                columns += [each, text.cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(out)[1:], strict=True))], schema=out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * full)
