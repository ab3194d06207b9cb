"""Phrase collocations per language: every n-gram a DataFrame row, counted by hash aggregation, scored in Decimal.

A text is lower-cased in A-Z and cut at [.,;:!?] and at line ends (\\x0A-\\x0D) into
pieces, and those at blanks and tabs into words; no phrase crosses a piece. All phrases
of 1 to max_words words become rows and are counted per language by hash aggregation;
a task counts them in blocks of texts first, so a row stands for all of a block, and
those of three words or more are rows only where their parts are frequent (see frequent()). A phrase of two words or more that occurs at least `least`
times is a candidate. Each of its cuts is joined
with the counts of both parts (heads that start many candidates are dealt out), its
score is the lowest over the cuts, of equal ones that of the first cut:
floor(1,000,000 * a * a / (l * r)), in Decimal, exact for counts under 10^16 (products of
at most 38 digits; beyond that Spark's ANSI mode raises). A candidate goes if a candidate
that is one word longer holds it and occurs at least half as often: what a still longer
one would rule out, the one-word extension between them rules out too. The first `top`
of each language are ranked in two steps, within buckets of phrases and then over the
buckets' firsts, so no task sorts a whole language.

Null texts and texts without words give no phrases, a null lang is `und`. Ties of score
go by count, then by phrase in the order of UTF-8 bytes. Repeated rows count each time, as
do rows of equal or null doc_id, which isn't read. Texts are read whole, whatever their
length. Columns other than text and lang are not read, whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, join_salted, picked, saved, small_batches, task_starts, together

#: A-Z to a-z, the characters that end a piece to line feeds, the tab to a blank.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CUTS = ".,;:!?\n\x0b\x0c\r"
PLAIN = str.maketrans(LETTERS + CUTS + "\t", LETTERS.lower() + "\n" * len(CUTS) + " ")
#: Characters of texts that are counted together before they become rows.
BLOCK = 4_000_000
#: Bits of the filter of frequent phrases, and of a part of it.
FILTER_BITS, CHUNK = 1 << 27, 1 << 17
#: Buckets of phrases of the first ranking.
BUCKETS = 256


def encoded(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The different words of the texts, and the words in order by number, -1 between pieces."""
    plain = "\n".join(t.translate(PLAIN) for t in texts).replace("\n", " \n ")
    # a list of one text would be under 2 GB by far, as blocks are
    words = pc.split_pattern(pa.array([plain]), " ").flatten().dictionary_encode()
    ids, vocabulary = words.indices.to_numpy(), words.dictionary
    number = np.arange(len(vocabulary))
    spare = {x: vocabulary.index(x).as_py() for x in ("", "\n")}
    number[[k for k in spare.values() if k >= 0]] = -1
    number[number >= 0] = np.arange((number >= 0).sum())
    keep = vocabulary.take(pa.array(np.flatnonzero(number >= 0)))
    return keep, number[ids[ids != spare[""]] if spare[""] >= 0 else ids]


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in words), np.uint64, len(words))


def longer_hash(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hashes of phrases that go on with a word."""
    return h * np.uint64(0x9E3779B97F4A7C15) + word


def slots(h: np.ndarray) -> np.ndarray:
    """The two bits of a phrase in the filter, as rows."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.stack([h, h * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(17)]) & np.uint64(FILTER_BITS - 1)


def ngrams(texts: list[str], least_words: int, most_words: int, lang: str = "", bits: np.ndarray | None = None):
    """(phrases, counts) for each number of words from least_words on: all phrases of the texts, overlapping ones too; with bits, of most_words words those both of whose parts that are one word shorter are in that filter."""
    vocabulary, ids = encoded(texts)
    n = max(1, len(vocabulary))
    phrases, at = vocabulary, ids
    words = h = None
    if bits is not None:
        words = word_hashes(vocabulary.to_pylist())
        h = longer_hash(word_hashes([lang] * len(words)), words)
    for m in range(1, most_words + 1):
        if m > 1:
            head, after = at[: max(0, len(at) - 1)], ids[m - 1 :]
            inside = (head >= 0) & (after >= 0)
            if bits is not None and m == most_words:
                one, other = slots(h).astype(np.int64)
                may = ((bits[one >> 3] >> (one & 7)) & (bits[other >> 3] >> (other & 7)) & 1).astype(bool)
                may = np.append(may, False)
                inside &= may[head] & may[at[1:]]
            found, pairs = pd.factorize(head[inside] * n + after[inside])
            before, last = pairs // n, pairs % n
            phrases = pc.binary_join_element_wise(phrases.take(pa.array(before)), vocabulary.take(pa.array(last)), " ")
            if h is not None:
                h = longer_hash(h[before], words[last])
            at = np.full(len(after), -1)
            at[inside] = found
        if m >= least_words:
            yield phrases, np.bincount(at[at >= 0], minlength=len(phrases))


def part_filter(phrases: DataFrame) -> Broadcast:
    """Two bits for each (lang, phrase), FILTER_BITS in all at any number of phrases, for every task."""

    def hashed(batches):
        for batch in batches:
            hs = [np.uint64(0)] * batch.num_rows
            for i, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                h = word_hashes([lang])
                for w in word_hashes(phrase.split(" ")):
                    h = longer_hash(h, w)
                hs[i] = h[0]
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(slots(np.array(hs, np.uint64)).astype(np.int64).ravel())], names=["slot"])

    def mark(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = batch.column(0).to_numpy()
            for c in np.unique(slot // CHUNK).tolist():
                held.setdefault(c, np.zeros(CHUNK, np.uint8))[slot[slot // CHUNK == c] % CHUNK] = 1
        for c, b in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([np.packbits(b, bitorder="little").tobytes()], pa.binary())], names=["chunk", "bits"])

    spark = phrases.sparkSession
    marks = phrases.select("lang", "phrase").mapInArrow(hashed, "slot long").repartition(64, F.floor(F.col("slot") / CHUNK)).mapInArrow(mark, "chunk long, bits binary").toArrow()
    whole = np.zeros(FILTER_BITS // 8, np.uint8)
    for c, b in zip(marks.column("chunk").to_pylist(), marks.column("bits").to_pylist(), strict=True):
        whole[c * CHUNK // 8 : (c + 1) * CHUNK // 8] |= np.frombuffer(b, np.uint8)
    return spark.sparkContext.broadcast(whole)


def counted(docs: DataFrame, least_words: int, most_words: int, least: int, bits: Broadcast | None = None) -> DataFrame:
    """(lang, phrase, f) of the phrases that occur at least so often; where words are among them, each language's number of words under the empty phrase. Rows come with their counts in a block of texts, so the shuffle carries sums and a phrase has a row a block at most."""
    small_batches(docs.sparkSession)

    def rows(lang, texts):
        n = None
        for phrases, counts in ngrams(texts, least_words, most_words, lang, None if bits is None else bits.value):
            yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(phrases), np.int64))), phrases, pa.array(counts)], names=["lang", "phrase", "f"])
            if n is None and least_words == 1:
                n = int(counts.sum())
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), pa.array([n])], names=["lang", "phrase", "f"])

    def run(batches):
        task_starts("collocations")
        held: dict[str, list[str]] = {}
        size: dict[str, int] = {}
        total = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                total += len(text)
                if total > BLOCK:
                    most = max(size, key=size.get)
                    yield from rows(most, held.pop(most))
                    total -= size.pop(most)
        for lang, texts in held.items():
            yield from rows(lang, texts)

    texts = docs.where("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    blocks = texts.mapInArrow(run, "lang string, phrase string, f long")
    return blocks.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == ""))


def frequent(docs: DataFrame, max_words: int, least: int) -> DataFrame:
    """counted() for 1 to max_words words, as a table. A phrase can't occur more often than its parts, so from three words on only phrases whose parts are frequent become rows (or pass for such in a filter of fixed size)."""
    found = saved(counted(docs, 1, 2, least), "phrases")
    last = found
    for m in range(3, max_words + 1):
        bits = part_filter(last.where(n_words(F.col("phrase")) == m - 1))
        last = saved(counted(docs, m, m, least, bits), "phrases")
        found = together(found, last)
        bits.unpersist()
    return found


def n_words(phrase: Column) -> Column:
    return F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1


def first_words(phrase: Column, k: Column | int) -> Column:
    return F.substring_index(phrase, " ", k) if isinstance(k, int) else F.call_function("substring_index", phrase, F.lit(" "), k)


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 * a * a / (left * right)), exact."""
    big = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", big(a) * big(a) * F.lit(1_000_000).cast("decimal(7,0)"), big(left) * big(right))


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, top: int = 2000) -> DataFrame:
    """The first phrases of each language: (lang, rank, phrase, a, l, r, n, score)."""
    if max_words < 2 or least < 1 or top < 1:
        raise ValueError("max_words must be 2 or more, least and top 1 or more")
    counts = frequent(picked(docs, "lang", "text"), max_words, least)
    part = F.struct("lang", "phrase").alias("part")
    parts = counts.where("phrase <> ''").select(part, "f")
    found = counts.withColumn("m", n_words(F.col("phrase"))).where(F.col("m") > 1)
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1))).select(
        "lang", "phrase", F.col("f").alias("a"), "k",
        F.struct("lang", first_words(F.col("phrase"), F.col("k")).alias("phrase")).alias("head"),
        F.struct("lang", first_words(F.col("phrase"), F.col("k") - F.col("m")).alias("phrase")).alias("tail"),
    )
    with_l = join_salted(cuts, parts.select(F.col("part").alias("head"), F.col("f").alias("l")), "head", "phrase", cuts.select("head"))
    with_r = join_salted(with_l, parts.select(F.col("part").alias("tail"), F.col("f").alias("r")), "tail", "phrase", cuts.select("tail"))
    scored = with_r.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # what a one-word extension rules out: both of its ends
    longer = found.where(F.col("m") > 2)
    inside = F.explode(F.array(first_words(F.col("phrase"), F.col("m") - 1), first_words(F.col("phrase"), F.lit(1) - F.col("m"))))
    held = longer.select("lang", "f", inside.alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    left = lowest.join(held, (lowest["lang"] == held["lang"]) & (lowest["phrase"] == held["phrase"]) & (100 * held["f"] >= 50 * lowest["a"]), "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)).alias("_bucket"))
    firsts = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_bucket").orderBy(*order))).where(F.col("rank") <= top)
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    sizes = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    out = ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    ready = saved(out, "collocations")
    dropped(docs.sparkSession, counts)
    return ready
