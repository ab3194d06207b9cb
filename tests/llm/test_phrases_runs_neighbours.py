"""Phrase collocations, periodic runs and the hash forest, each against a plain version."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import collocations, hash_forest, periodic_runs

SF = "/root/testdata/sf0.01"


# phrases


def plain_collocations(rows, max_words, least, top):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                for k in range(len(w) - m + 1):
                    f.setdefault(lang, Counter())[tuple(w[k : k + m])] += 1
    out = []
    for lang, c in f.items():
        good = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in good.items():
            inside = lambda x: any(x[k : k + len(p)] == p for k in range(len(x) - len(p) + 1))  # noqa: B023, E731
            if any(len(x) > len(p) and inside(x) and 100 * b >= 50 * a for x, b in good.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(("max_words", "least", "top"), [(3, 10, 2000), (3, 2, 7), (4, 2, 40), (2, 3, 5)])
def test_collocations(spark, max_words, least, top):
    rng = random.Random(5)
    words = ["aa", "Bb", "c", "É", "é", "日本", "x-y", "𝒳", "d e", "z"]
    sep = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "\r\n", "; ", "?"]
    rows = [("".join(rng.choice(words[: rng.choice([2, 4, 10])]) + rng.choice(sep) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "fr", None, "und"])) for _ in range(150)]
    rows += [(None, "en"), ("", "en"), (" \t\n.", "de"), ("one", "it"), ("aa bb c " * 3000, "en")] + [rows[0]] * 3
    df = spark.createDataFrame([(t, g, 1, 2, 3) for t, g in rows], "text string, lang string, a int, f int, phrase int").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(df, max_words, least, top).collect())
    assert got == plain_collocations(rows, max_words, least, top)


def test_collocations_odd(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(none).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(none, max_words=1)


def test_scores_past_64_bits(spark):
    """The same Decimal expressions on counts whose products pass 64 bits."""
    big = [(10**12 + 7, 10**12 + 9, 10**13), (3 * 10**9, 3 * 10**9 + 1, 7 * 10**9), (5, 5, 5)]
    df = spark.createDataFrame(big, "a long, l long, r long")
    rows = df.select("*", collocations.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(x.s == 10**6 * x.a**2 // (x.l * x.r) for x in rows)


# runs


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            m = j - i + q
            if m >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(i, i + m - p)) for p in range(1, q)):
                out.append((i, m, q))
            i = j
    return sorted(out)


def plain_digest(doc_id, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    n = len(w)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_at_any_split_of_frequent_words():
    rng = random.Random(2)
    for _ in range(1500):
        n, letters = rng.randrange(70), rng.choice([1, 2, 3, 6])
        w = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.6:
            i, p = rng.randrange(n), rng.randint(1, 9)
            w = [w[x] if x < i else w[min(n - 1, i + (x - i) % p)] for x in range(n)]
        ids = periodic_runs.numbered([str(x) for x in w])
        want = plain_runs(w)
        assert all(periodic_runs.runs(ids, often) == want for often in (None, 0, 3, 10**6))


def test_lag_counts_are_exact():
    ids = periodic_runs.numbered([str(x) for x in np.random.default_rng(1).zipf(1.3, 5000) % 400])
    want = [0] + [int((ids[q:] == ids[:-q]).sum()) for q in range(1, 1251)]
    for often in (0, 5, 50, 10**6):
        got = periodic_runs.lag_matches(ids, 1250, often)
        assert got[1:].tolist() == want[1:]


def test_runs_digest(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    rows = [(i, t if t is None else t[:6000]) for i, t in rows]
    odd = [None, "", " \n\t", "a", "a a a a a a", "x y " * 300, "b" * 20000, ("l " * 7 + "m ") * 9, "a b c d " * 4 + "z", "é é é é é é　é"]
    rows += [(k, t) for k in (None, 7, 19, 10**12) for t in odd]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, runs int, start string").repartition(3)
    got = sorted((tuple(r) for r in periodic_runs.digest(periodic_runs.find_runs(df, repeats=True)).collect()), key=str)
    assert got == sorted((plain_digest(i, t) for i, t in rows), key=str)
    assert periodic_runs.digest(periodic_runs.find_runs(df.limit(0))).count() == 0


def test_one_repeated_word_needs_one_scan(monkeypatch):
    seen = []
    real = periodic_runs.islands
    monkeypatch.setattr(periodic_runs, "islands", lambda *a: seen.append(a[1]) or real(*a))
    assert periodic_runs.runs(np.zeros(200_000, np.int32)) == [(0, 200_000, 1)]
    assert seen == [1]


# neighbours


def plain_nearest(rows, k, every):
    good = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and v.any()]
    out = {}
    for i, v in good:
        if i % every == 0:
            near = sorted((-sum(float(a) * float(b) for a, b in zip(v, x, strict=True)), j) for j, x in good if j != i and len(x) == len(v))[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def same(got, want):
    assert set(got) <= set(want)
    for i, near in want.items():
        assert [round(s, 9) for _, s in got.get(i, [])] == [round(s, 9) for _, s in near]
        assert [j for j, _ in got.get(i, [])] == [j for j, _ in near]


@pytest.fixture(scope="module")
def odd_vectors():
    rng = np.random.default_rng(3)
    one = [float(x) for x in np.float32(rng.standard_normal(12))]
    rows = [(i, one) for i in range(0, 600, 3)]  # a third are equal
    rows += [(i, [float(x) for x in np.float32(rng.standard_normal(12) * 2.0 ** rng.integers(-6, 6))]) for i in range(600) if i % 3]
    bad = [None, [], [0.0] * 12, [1.0, None], [float("nan")] * 12, [float("inf")] + [1.0] * 11]
    rows += [(1000 + 20 * k, v) for k, v in enumerate(bad)] + [(None, one), (2000, [1.0, 2.0]), (2001, [2.0, 1.0]), (2020, [5.0]), (0, one), (0, one)]
    return rows


def test_all_candidates_give_the_exact_lists(spark, odd_vectors):
    """With trees that hold everything in one array the search is exact: copies, lengths, bands, unusable rows."""
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in odd_vectors], "vec_id long, embedding array<double>, key int, band string").repartition(4)
    got = listed(hash_forest.nearest(df, F.col("vec_id") % 20 == 0, 20, trees=3, enough=10**9))
    same(got, plain_nearest(list({(i, tuple(v) if v is not None else None): (i, v) for i, v in odd_vectors}.values()), 20, 20))
    assert 2020 not in got and len(got[0]) == 20


def test_blocks_lose_nothing(spark, odd_vectors):
    """Arrays far over the average are dealt out in blocks; what a query sees stays the same."""
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(16)
    rows = [(i, [float(x) for x in centre + 1e-4 * rng.standard_normal(16)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = listed(hash_forest.nearest(df, F.col("vec_id") % 20 == 0, 10, trees=2, enough=10**9, array=64))
    want = plain_nearest(rows, 10, 20)
    found = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert found >= 0.98 * 10 * len(want)


def test_recall_and_levels(spark):
    """Random unit vectors, the hardest case: recall grows with `enough`, and deeper stops look at fewer rows."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    shares = []
    for enough in (2000, hash_forest.ENOUGH):
        got = listed(hash_forest.nearest(df, F.col("vec_id") % 60 == 0, enough=enough, array=1024))
        hit = 0
        for i in range(0, 6000, 60):
            s = x @ x[i]
            s[i] = -9
            hit += len({j for j, _ in got[i]} & set(np.argsort(-s)[:20].tolist()))
        shares.append(hit / 2000)
    assert shares[0] < shares[1] and shares[1] >= 0.95


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hash_forest.nearest(df, F.col("vec_id") % 20 == 0).count() == 0
