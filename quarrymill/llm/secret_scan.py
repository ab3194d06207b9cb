"""Secret scans: fixed patterns, and strings that look random to character Markov models.

Two first-order Markov models over character classes of ASCII (each letter, digit and
sign its own state) are trained from labelled samples, of random strings and of ordinary
identifiers and words: learned() counts them from a table, labelled_samples() makes some
by rule where none are given. Where a run of key
characters, or a part of it outside the spans of the fixed patterns, has a mean
log-likelihood ratio per character above a threshold that falls with its length, it is
a span of kind markov. Spans are in code points, end exclusive.

A null text counts as empty: no spans. Texts are scanned whole, in time that grows with
their length; each row on its own, so repeated rows give repeated results and null ids
null ids. Spans of one start come in the order of KINDS. An empty table gives no rows.
Of other columns, whatever their names, scan() reads none and redact() passes all on.
A labelled sample that is null or empty, or whose label is null, is left out; repeated
ones count as often as they come; an empty table of samples is refused.
"""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, task_starts

KINDS = ("assign", "access", "hex", "markov")
#: The patterns of the three base kinds. [0-9a-f]{24,} and AKIA[A-Z0-9]{16,} find the maximal runs that are long enough.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
#: A candidate of n characters is a span where its mean ratio is THRESHOLD + PER_LENGTH / n at least.
THRESHOLD, PER_LENGTH = 0.3, 8.0

#: Parts of ordinary identifiers, for the labelled sample of them.
PARTS = tuple(
    "get set load save read write open close user name file path data list item index count total value result error message request response client server session config option default "
    "parse format render update delete create insert select filter group order sort merge split join search match replace convert encode decode buffer stream thread process handler manager "
    "factory service controller model view table column row field type class method function variable constant number string array object token secret account balance transaction payment "
    "the and that with from this have which their there would about other people number water through before because international documentation information configuration "
    "und der die das nicht einheit keit schaft ung les des pour dans avec ment tion que para como con los las cion dad".split()
)

#: Beginnings, middles and ends of the syllables of made-up words, for the labelled sample of ordinary ones.
ONSETS = tuple(". . b c d f g h j l m n p qu r s t v w z bl br ch cr dr fl fr gl gr pl pr sc sch sh sl sp st str th tr".replace(".", "-").split())
MIDDLES = tuple("a a e e e i i o o u y ai au ae ea ee ei eu eau ia ie io iu oa oe oi oo ou ua ue ui aie oue aue".split())
ENDS = tuple("- - - - b c d f g k l m n p r s t x z ct ld ll lt mp nd ng ns nt nz ps rd rn rt sc sh ss st x".split())


def _states() -> dict[str, int]:
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
    return {c: k for k, c in enumerate(alphabet)}


STATES = _states()


def made_up_word(r: random.Random) -> str:
    """A word of two to five syllables, in lower, title or upper case."""
    word = "".join(r.choice(x) for _ in range(r.randint(2, 5)) for x in (ONSETS, MIDDLES, ENDS)).replace("-", "")
    return r.choice((word, word, word.title(), word.upper()))


def labelled_samples(each: int = 4000, seed: int = 11) -> tuple[list[str], list[str]]:
    """(random strings, ordinary identifiers and as many made-up words), made by rule from a seed: the labelled samples used where no others are given."""
    r = random.Random(seed)
    kinds = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"]
    noise = ["".join(r.choice(kinds[k % len(kinds)]) for _ in range(r.randint(20, 48))) for k in range(each)]
    plain = []
    for k in range(each):
        parts = [r.choice(PARTS) for _ in range(r.randint(2, 6))]
        plain.append(("_".join(parts), "".join(p.title() for p in parts), "-".join(parts), "".join(parts), "/".join(parts), "_".join(parts).upper())[k % 6] + ("" if r.random() < 0.8 else str(r.randint(0, 2030))))
    return noise, plain + [made_up_word(r) for _ in range(each)]


def train(noise: list[str], plain: list[str], smooth: float = 0.5) -> np.ndarray:
    """Log-likelihood ratio, random over ordinary, of each character after each other (the last row: at the start)."""
    n = len(STATES)
    counts = np.zeros((2, n + 1, n))
    for sample, c in zip((noise, plain), counts, strict=True):
        for s in sample:
            last = n
            for ch in s:
                k = STATES.get(ch)
                if k is None:
                    last = n
                    continue
                c[last, k] += 1
                last = k
    return _ratios(counts, smooth)


def _ratios(counts: np.ndarray, smooth: float) -> np.ndarray:
    c = counts + smooth
    logs = np.log(c / c.sum(axis=2, keepdims=True))
    return logs[0] - logs[1]


def learned(samples: DataFrame, smooth: float = 0.5) -> list[list[float]]:
    """The ratios of train() from a table of labelled samples (sample string, random boolean), for scan() and redact().

    Transitions are counted by Spark; what comes to the driver is a number for each two
    states and label, so 2 * 66 * 67 of them at most, whatever the number of samples.
    """
    rows = samples.select(F.col("sample").cast("string").alias("sample"), F.col("random").cast("boolean").alias("random")).where("random is not null and sample <> ''")
    known = F.lit("".join(STATES))
    # characters that are no state stand as a blank, and the start as another
    marked = F.concat(F.lit(" "), F.regexp_replace("sample", r"[^A-Za-z0-9+/_=-]", " "))
    pairs = rows.select("random", F.explode(F.sequence(F.lit(1), F.length(marked) - 1)).alias("k"), marked.alias("s")).select("random", F.expr("substring(s, k, 1)").alias("last"), F.expr("substring(s, k + 1, 1)").alias("next"))
    found = pairs.where("next <> ' '").groupBy("random", F.instr(known, F.col("last")).alias("last"), F.instr(known, F.col("next")).alias("next")).count().collect()
    if {x["random"] for x in found} != {True, False}:
        raise ValueError("samples of both labels are needed")
    n = len(STATES)
    counts = np.zeros((2, n + 1, n))
    for x in found:
        counts[0 if x["random"] else 1, (x["last"] or n + 1) - 1, x["next"] - 1] = x["count"]
    return _ratios(counts, smooth).tolist()


_DEFAULT: list[list[list[float]]] = []


def default_ratios() -> list[list[float]]:
    if not _DEFAULT:
        _DEFAULT.append(train(*labelled_samples()).tolist())
    return _DEFAULT[0]


def mean_ratio(s: str, ratios: list[list[float]]) -> float:
    total, last = 0.0, len(STATES)
    for ch in s:
        k = STATES[ch]
        total += ratios[last][k]
        last = k
    return total / len(s) if s else -math.inf


def _outside(start: int, end: int, taken: list[tuple[int, int]], at: int) -> tuple[list[tuple[int, int]], int]:
    """The parts of start to end outside taken (apart, rising), and the index in taken to go on from."""
    while at < len(taken) and taken[at][1] <= start:
        at += 1
    out, k = [], at
    while k < len(taken) and taken[k][0] < end:
        if taken[k][0] > start:
            out.append((start, taken[k][0]))
        start = taken[k][1]
        k += 1
    return (out + [(start, end)] if start < end else out), at


def spans(text: str | None, ratios: list[list[float]], threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text, by start, then by kind as listed."""
    t = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    if "AKIA" in t:
        found += [("access", *m.span()) for m in ACCESS.finditer(t)]
    found += [("hex", *m.span()) for m in HEX.finditer(t)]
    taken: list[tuple[int, int]] = []
    for a, b in sorted(x[1:] for x in found):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    at = 0
    for m in CANDIDATE.finditer(t):
        parts, at = _outside(*m.span(), taken, at)
        found += [("markov", a, b) for a, b in parts if b - a >= 12 and mean_ratio(t[a:b], ratios) >= threshold + PER_LENGTH / (b - a)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def as_text(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by [kind], the kind of the first."""
    out, at = [], 0
    k = 0
    while k < len(found):
        kind, a, b = found[k]
        while k + 1 < len(found) and found[k + 1][1] < b:
            k += 1
            b = max(b, found[k][2])
        out += [text[at:a], f"[{kind}]"]
        at = b
        k += 1
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, ratios: list[list[float]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) to (doc_id, found array<struct<kind,start,end>>): one row a document, no shuffle."""
    small_batches(docs.sparkSession)
    ratios = ratios or default_ratios()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    out = pa.schema([("doc_id", pa.int64()), ("found", pa.list_(item))])

    def run(batches):
        task_starts("secret_scan")
        for batch in batches:
            got = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t, ratios, threshold)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(item))], schema=out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the base spans' SHA-256 and all spans as text."""
    base = F.filter("found", lambda x: x["kind"] != "markov")
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    n = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), n("markov"))


def redact(docs: DataFrame, ratios: list[list[float]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, with the secrets in text replaced by [kind] and n_chars, where there is one, counted anew. Null texts stay null."""
    small_batches(docs.sparkSession)
    ratios = ratios or default_ratios()
    at = docs.columns.index("text")

    def run(batches):
        task_starts("secret_scan")
        for batch in batches:
            texts = [t and redacted(t, spans(t, ratios, threshold)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
