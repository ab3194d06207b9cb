"""Toxicity: a weighted lexicon in an Aho-Corasick automaton over folded text.

Texts are folded (lower case, look-alike letters of other scripts to Latin, digits
and signs that stand for letters inside words), the automaton finds word stems with
their weights, phrases of the exception list cancel the hits that they cover, and
the summed weight is normalised by the number of words. The stems and weights come
from labelled rows: log-odds of a stem's document frequency in toxic against other
training rows. Exceptions, besides a few given ones, are learned too: a hit with the
word before or after it, where that is common in other rows and not in toxic ones. A
logistic curve over the normalised sum gives the score.

Nulls: a null text counts as empty; rows without a label are scored, not learned
from; labels other than 0 and 1 are left out. Texts are read whole; the work grows with
their length (and its logarithm). Repeated rows are each scored; repeated texts are
learned from once. Where several stems start at one place, that of the greatest weight
counts, the longest of these first. Without toxic or without other training rows the
seed lexicon and its fixed curve are used. Columns other than those named, whatever
their names, pass through filter_toxic() and are not read by score(). An empty table
gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, picked, saved, small_batches, smallest_hashes, task_starts

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ѕ": "s", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "м": "m", "т": "t", "к": "k", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
HOMOGLYPHS |= {chr(0xFF41 + k): chr(97 + k) for k in range(26)} | {chr(0xFF10 + k): chr(48 + k) for k in range(10)}
#: Digits and signs that stand for letters inside words.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

_HOMO = str.maketrans(HOMOGLYPHS)
_HOMO_ANY = re.compile("[" + "".join(HOMOGLYPHS) + "]")
_SUB = str.maketrans(SUBSTITUTES)
_LEET = re.compile(r"[0-9@$]+(?=[^\W\d_])|(?<=[^\W\d_])[0-9]+")
_WORD = re.compile(r"[^\W_]+")

#: Words that are insults in any corpus; used with this weight where no labels say otherwise.
SEEDS = ("idiot", "moron", "stupid", "imbecile", "scumbag", "bastard", "bitch", "asshole", "retard")
SEED_WEIGHT = 3.0
EXCEPTIONS = ("scum line", "pond scum", "trash can", "trash bag", "trash collection", "clown fish", "moron test")


@dataclass(frozen=True)
class Lexicon:
    """stems: (stem, weight) pairs, matched from a word's start. exceptions: phrases whose hits don't count. curve: bias and slopes of the score over log1p(weight per 100 words) and log1p(weight)."""

    stems: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-3.0, 1.5, 2.0)
    stats: dict = field(default_factory=dict, compare=False, hash=False)


def fold(text: str) -> str:
    """Lower case, look-alikes to Latin, then digits and signs inside words to letters."""
    out = text.lower()
    if not out.isascii() and _HOMO_ANY.search(out):
        out = out.translate(_HOMO)
    return _LEET.sub(lambda m: m[0].translate(_SUB), out)


def _stems_of(folded: str, shortest: int, longest: int) -> set[str]:
    out = set()
    for w in set(_WORD.findall(folded)):
        if len(w) >= shortest:
            out.update(w[:k] for k in range(shortest, min(len(w), longest) + 1))
    return out


_AUTOMATA: dict = {}


def _automaton(lexicon: Lexicon):
    key = (lexicon.stems, lexicon.exceptions)
    if key not in _AUTOMATA:
        a = ahocorasick.Automaton()
        found: dict[str, list] = {}
        for stem, weight in lexicon.stems:
            if s := fold(stem):
                entry = found.setdefault(s, [0.0, False])
                entry[0] = max(weight, entry[0])
        for phrase in lexicon.exceptions:
            if s := fold(phrase):
                found.setdefault(s, [0.0, False])[1] = True
        for s, (weight, exempt) in found.items():
            a.add_word(s, (len(s), weight, exempt))
        a.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[key] = a
    return _AUTOMATA[key]


def places(folded: str, lexicon: Lexicon) -> list[tuple[int, int, float]]:
    """The hits (start, end, weight) in a folded text that no exception phrase covers, by start."""
    automaton = _automaton(lexicon)
    best: dict[int, tuple[float, int]] = {}
    exempt: list[tuple[int, int]] = []
    for last, (size, weight, is_exempt) in automaton.iter(folded) if len(automaton) else ():
        start, end = last - size + 1, last + 1
        if start and folded[start - 1].isalnum():
            continue
        if is_exempt and not folded[end : end + 1].isalnum():
            exempt.append((start, end))
        if weight > 0 and (weight, end) > best.get(start, (0.0, 0)):
            best[start] = (weight, end)
    found = [(s, e, w) for s, (w, e) in sorted(best.items())]
    if exempt and found:
        exempt.sort()
        # the furthest end of the phrases that start at or before each
        reach = list(accumulate((e for _, e in exempt), max))
        starts = [s for s, _ in exempt]
        found = [f for f in found if not (k := bisect_right(starts, f[0])) or reach[k - 1] < f[1]]
    return found


def hits(text: str | None, lexicon: Lexicon) -> tuple[float, int, int]:
    """Summed weight of the hits that no exception phrase covers, their number, and the number of words."""
    folded = fold(text or "")
    found = places(folded, lexicon)
    return sum(w for *_, w in found), len(found), len(folded.split())


def score_of(weight: float, words: int, curve: tuple[float, float, float]) -> float:
    z = curve[0] + curve[1] * math.log1p(100.0 * weight / max(words, 20)) + curve[2] * math.log1p(weight)
    return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def _fit_curve(rows: list[tuple[float, int, int]]) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps over the two features of score_of."""
    x = np.array([[1.0, math.log1p(100.0 * w / max(n, 20)), math.log1p(w)] for w, n, _ in rows])
    y = np.array([float(t) for *_, t in rows])
    b = np.array([-2.0, 1.0, 1.0])
    ridge = np.diag([1e-3, 0.05, 0.05])
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def _neighbours(folded: str, start: int, end: int) -> list[str]:
    """The word at a hit with the word before it, and with that after it, as they stand."""
    while end < len(folded) and folded[end].isalnum():
        end += 1
    before, after = re.search(r"[^\W_]+[^\w\n]{1,2}$", folded[max(0, start - 40) : start]), re.match(r"[^\w\n]{1,2}[^\W_]+", folded[end : end + 40])
    return ([before[0] + folded[start:end]] if before else []) + ([folded[start:end] + after[0]] if after else [])


def learn(training: DataFrame, *, bound: int = 20_000, shortest: int = 4, longest: int = 10, least_share: float = 0.01, least_lift: float = 12.0) -> Lexicon:
    """A lexicon from training (text, toxic).

    bound is the documented limit of labelled rows that are learned from: where more
    distinct texts are labelled, those with the smallest hashes are taken. All of the
    rest is a function of that sample: stems in at least least_share of the toxic
    texts, whose share there is least_lift times their share in the others, and as
    exceptions the phrases of three other texts that least_lift times fewer toxic ones hold.
    """
    spark = training.sparkSession
    small_batches(spark)
    rows = picked(training, "text", "toxic").where("text is not null and toxic in (0, 1)").withColumn("h", F.xxhash64("text"))
    most = smallest_hashes(rows.select("h").distinct(), "h", bound)
    rows = rows if most is None else rows.where(F.col("h") <= most)
    # dealt out evenly: the sample is small, reading its texts is not
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = saved(rows.groupBy("h").agg(F.first("text").alias("text"), F.min("toxic").cast("int").alias("toxic")).repartition(parts, "h").select("text", "toxic"), "toxic-sample")
    sizes = {int(r.toxic): int(r.n) for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        dropped(spark, sample)
        return Lexicon(tuple((s, SEED_WEIGHT) for s in SEEDS), stats={"toxic": n_pos, "other": n_neg})
    least = max(3, math.ceil(least_share * n_pos))

    def count(batches, only=None):
        for batch in batches:
            c: Counter = Counter()
            for t in batch.column(0).to_pylist():
                s = _stems_of(fold(t), shortest, longest)
                c.update(s if only is None else s & only)
            yield pa.RecordBatch.from_pydict({"stem": list(c), "n": list(c.values())}, schema=pa.schema([("stem", pa.string()), ("n", pa.int64())]))

    counted = sample.where("toxic = 1").select("text").mapInArrow(count, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))
    pos = {r.stem: r.n for r in counted.where(F.col("n") >= least).collect()}
    wanted = frozenset(pos)
    neg = {r.stem: r.n for r in sample.where("toxic = 0").select("text").mapInArrow(lambda b: count(b, wanted), "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n")).collect()}
    weights: dict[str, float] = {}
    for s in sorted(pos, key=lambda s: (len(s), s)):
        p, n = pos[s] / n_pos, neg.get(s, 0) / n_neg
        if p < least_lift * (n + 0.5 / n_neg):
            continue
        w = math.log((pos[s] + 0.5) / (n_pos + 1)) - math.log((neg.get(s, 0) + 0.5) / (n_neg + 1))
        # a longer stem only counts where it is clearly purer than the shorter one that it starts with
        if all(w > weights[s[:k]] + 1.0 for k in range(shortest, len(s)) if s[:k] in weights):
            weights[s] = round(w, 6)
    for s in SEEDS:
        if not any(s[:k] in weights for k in range(1, len(s) + 1)):
            weights[s] = SEED_WEIGHT
    draft = Lexicon(tuple(sorted(weights.items())))

    def around(batches):
        for batch in batches:
            c: Counter = Counter()
            for t, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = fold(t)
                c.update((p, toxic) for p in {p for s, e, _ in places(f, draft) for p in _neighbours(f, s, e)})
            yield pa.RecordBatch.from_pydict({"phrase": [k[0] for k in c], "toxic": [k[1] for k in c], "n": list(c.values())}, schema=pa.schema([("phrase", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())]))

    sides = sample.mapInArrow(around, "phrase string, toxic int, n long").groupBy("phrase").agg(*[F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)])
    harmless = sides.where((F.col("n0") >= 3) & (F.col("n0") >= least_lift * F.col("n1"))).select("phrase").collect()
    lexicon = Lexicon(draft.stems, tuple(sorted({*EXCEPTIONS, *(r.phrase for r in harmless)})))

    def feature(batches):
        for batch in batches:
            got = [hits(t, lexicon) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"w": [g[0] for g in got], "n": [g[2] for g in got], "toxic": batch.column(1)}, schema=pa.schema([("w", pa.float64()), ("n", pa.int64()), ("toxic", pa.int32())]))

    # at most bound rows of three numbers
    fitted = sorted((r.w, r.n, r.toxic) for r in sample.mapInArrow(feature, "w double, n long, toxic int").collect())
    dropped(spark, sample)
    return Lexicon(lexicon.stems, lexicon.exceptions, _fit_curve(fitted), {"toxic": n_pos, "other": n_neg})


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """docs (doc_id, text, ...) with toxicity_weight, toxicity_hits, score and predicted added; each row on its own, no shuffle."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, toxicity_weight double, toxicity_hits int, score double, predicted int"
    out = pa.schema([("doc_id", pa.int64()), ("toxicity_weight", pa.float64()), ("toxicity_hits", pa.int32()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        task_starts("toxicity", _AUTOMATA)
        for batch in batches:
            got = [hits(t, lexicon) for t in batch.column(1).to_pylist()]
            s = [score_of(w, n, lexicon.curve) for w, _, n in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int32()), pa.array(s, pa.float64()), pa.array([int(v >= threshold) for v in s], pa.int32())], schema=out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def filter_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whose score is below threshold."""
    small_batches(docs.sparkSession)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        task_starts("toxicity", _AUTOMATA)
        for batch in batches:
            keep = [score_of(w, n, lexicon.curve) < threshold for w, _, n in (hits(t, lexicon) for t in batch.column(at).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id):
    """Rows that are never learned from: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
