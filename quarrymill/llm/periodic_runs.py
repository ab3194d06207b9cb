"""Periodic runs of words: heavy/light lag counting, then island scans of the lags with enough matches.

A run is a stretch of consecutive words with smallest period q (words q apart are the
same) and a length of at least max(6, 4q) that no neighbouring word extends. A run shows
at lag q as an island of length - q consecutive matches, so only lags with that many
matches in all can hold one. Matches are counted exactly for all lags up to a quarter of
the text at once: words that occur often by the autocorrelation of their positions (one
transform each, their power spectra added, one transform back, rounded to integers),
the others by the differences of their positions. What a run of a smaller period adds to the
multiples of that period is taken off once the run is found (those matches are whole
islands of their own), so a text of one repeated word costs one scan and not one
for each lag.

The work is a map: each text is one row's work, in time of about n * sqrt(n log n) for n
words beside the scans, in memory that grows with n. Words are the runs without ASCII
white space ([^\\x20\\x09-\\x0D]+). A null or empty text has no words and no runs: nulls
for the longest run, hashes of the empty string. A tie of the largest length / period
goes to the smallest start, then period. Repeated rows come out as they go in, rows of
a null doc_id too (nothing is put in by `repeats` there). Columns other than doc_id and
text, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, task_starts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST_LENGTH, LEAST_PERIODS = 6, 4
Run = tuple[int, int, int]


def lag_matches(ids: np.ndarray, most: int, often: int | None = None) -> np.ndarray:
    """For each lag up to most, at how many places the word so many places on is the same. often: words that occur more often are counted by transforms; unset, where both ways cost about the same."""
    n = len(ids)
    if often is None:
        often = max(16, int(math.sqrt(n * math.log2(n + 2)) / 4))
    count = np.bincount(ids)
    out = np.zeros(most + 1, np.int64)
    heavy = np.flatnonzero(count > often)
    if len(heavy):
        size = 1 << (n + most).bit_length()
        power = np.zeros(size // 2 + 1)
        for w in heavy:
            f = np.fft.rfft(ids == w, size)
            power += f.real * f.real + f.imag * f.imag
        out += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    times = count[ids]
    place = np.flatnonzero((times <= often) & (times > 1))
    place = place[np.lexsort((place, ids[place]))]
    word = ids[place]
    # the k-th next place of the same word, for those that have one within reach
    at = np.arange(len(place))
    k = 1
    while len(at):
        at = at[: np.searchsorted(at, len(place) - k)]
        gap = place[at + k] - place[at]
        near = (word[at + k] == word[at]) & (gap <= most)
        at = at[near]
        out += np.bincount(gap[near], minlength=most + 1)
        k += 1
    return out


def islands(ids: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """(start, length) of the stretches of at least so many matches at lag q."""
    breaks = np.concatenate(([-1], np.flatnonzero(ids[q:] != ids[:-q]), [len(ids) - q]))
    size = np.diff(breaks) - 1
    long = np.flatnonzero(size >= least)
    return [(int(breaks[j]) + 1, int(size[j])) for j in long]


def runs(ids: np.ndarray, often: int | None = None) -> list[Run]:
    """All runs (start, length, period), by start, then period."""
    n = len(ids)
    if n < LEAST_LENGTH:
        return []
    most = n // LEAST_PERIODS
    lags = np.arange(most + 1)
    need = np.maximum(LEAST_LENGTH, LEAST_PERIODS * lags) - lags
    need[0] = n + 1
    matches = lag_matches(ids, most, often)
    found: dict[tuple[int, int], int] = {}
    for q in np.flatnonzero(matches >= need).tolist():
        if matches[q] < need[q]:
            continue  # what was left belongs to runs of smaller periods
        for start, size in islands(ids, q, int(need[q])):
            length = size + q
            if (start, length) in found:
                continue
            found[start, length] = q
            multiples = np.arange(2 * q, min(most, length - 1) + 1, q)
            matches[multiples] -= length - multiples
    return sorted((s, m, q) for (s, m), q in found.items())


def repeated(words: list[str], doc_id: int | None) -> list[str]:
    """The words with a repetition put in for a tenth of the documents, told by the CRC of the id."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def numbered(words: list[str]) -> np.ndarray:
    """Words as numbers, by first occurrence."""
    seen: dict[str, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def collapsed(words: list[str], found: list[Run]) -> list[str]:
    """The words that stand in no run after its first period."""
    step = np.zeros(len(words) + 1, np.int64)
    for s, m, q in found:
        step[s + q] += 1
        step[s + m] -= 1
    return list(compress(words, (np.cumsum(step)[:-1] == 0).tolist())) if found else words


def longest(found: list[Run]) -> Run | None:
    """The run with the most periods, compared exactly."""
    best = None
    for s, m, q in found:
        if best is None or m * best[2] > best[1] * q:
            best = (s, m, q)
    return best


#: One entry for each run, in order.
RUNS = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def find_runs(docs: DataFrame, repeats: bool = False) -> DataFrame:
    """(doc_id, runs, collapsed): every run of each text, and the text without their repetitions, words joined by single blanks. repeats: put repetitions in first, see repeated()."""
    small_batches(docs.sparkSession)
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        task_starts("periodic_runs")
        for batch in batches:
            every, texts = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = WORD.findall(text or "")
                words = repeated(words, doc_id) if repeats else words
                found = runs(numbered(words))
                every.append([{"start": s, "length": m, "period": q} for s, m, q in found])
                texts.append(" ".join(collapsed(words, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(every, pa.list_(item)), pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RUNS)


def digest(found: DataFrame) -> DataFrame:
    """Counts, the run with the most periods and hashes."""
    small_batches(found.sparkSession)
    names = ["start", "length", "period", "exponent_milli"]

    def run(batches):
        task_starts("periodic_runs")
        for batch in batches:
            rows = []
            for every, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                listed = [(r["start"], r["length"], r["period"]) for r in every]
                best = longest(listed)
                lines = "".join(f"{s},{m},{q}\n" for s, m, q in listed)
                four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                rows.append((len(listed), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            n, *four, by_runs, by_text = zip(*rows, strict=True) if rows else [()] * 7
            columns = [batch.column(0), pa.array(n, pa.int64()), *[pa.array(c, pa.int64()) for c in four], pa.array(by_runs, pa.string()), pa.array(by_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_runs", *names, "runs_sha256", "collapsed_sha256"])

    return found.mapInArrow(run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
