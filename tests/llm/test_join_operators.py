"""Operators over pairs and archives, each against a plain version."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quarrymill.llm import common, embedding_dedup, ngram_join, warc


def links_of(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(ngram_join.LOWER).split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i in sorted(sets):
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    for i in sorted(sets):
        for j, k in Counter(j for s in sets[i] for j in where[s] if j < i).items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def mutated(seed=3, n=700):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    base = [[r.choice(words) for _ in range(r.choice([1, 2, 3, 5, 6, 7, 9, 12, 20, 40, 90, 200]))] for _ in range(30)]
    common_part = [r.choice(words) for _ in range(60)]
    out = []
    for i in range(n):
        b = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            q = r.randrange(len(b) + 1)
            op = r.random()
            if op < 0.4 and q < len(b):
                b[q] = r.choice(words)
            elif op < 0.7 and q < len(b):
                del b[q]
            else:
                b.insert(q, r.choice(words))
        out.append((i, " ".join(b + common_part * (r.random() < 0.2))))
    return [*out, (5000, None), (5001, ""), (5002, "  \n"), (5003, "W1 w2"), (5004, "w1  W2")]


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (3, 30)])
def test_ngram_join_is_exact(spark, words, percent):
    rows = mutated()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, component int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_components(df, words, percent).collect()}
    assert got == links_of(rows, words, percent)


@pytest.mark.parametrize("percent", [1, 37, 99, 100])
def test_ngram_join_at_any_percent(spark, percent):
    rows = mutated(seed=percent, n=120)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2, percent).collect()}
    assert got == links_of(rows, 2, percent)


@pytest.mark.parametrize("percent", [0, 101])
def test_no_percentage(spark, percent):
    with pytest.raises(ValueError):
        ngram_join.near_components(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 2, percent)


def test_texts_of_one_id_are_one_document(spark):
    """What any text of an id links with, all do, whether or not the id is the smallest of a group."""
    a, b, c, d = ("one two three four five six " + x * 3 for x in ("a ", "b ", "c ", "d "))
    a, b, c, d = a * 2, b.upper() * 2 + "q r s t u v w x", c + "y " * 9, d + "z k " * 9
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (9, c), (9, d), (9, b), (7, d), (8, "alone in the world of words"), (None, a), (8, None)]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 85).collect())
    assert got == sorted([(1, 1), (2, 1), (2, 1), (3, 1), (4, 1), (9, 1), (9, 1), (9, 1), (7, 1), (8, 8), (0, 0), (8, 8)])
    left = sorted((r.doc_id or 0) for r in ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect())
    assert left == [0, 1, 8, 8]


def test_sketches_bound_the_difference():
    r = np.random.default_rng(5)
    for n in (1, 7, 50, 400):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[a[: n - n // 5], r.integers(0, 2**63, n // 6).astype(np.uint64)])
        w = ngram_join.folded([ngram_join.parity(a), ngram_join.parity(b)])
        assert np.bitwise_count(w[0] ^ w[1]).sum() <= len(np.setxor1d(a, b))


def test_join_edge_cases(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_components(none).count() == 0
    rows = [(None, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A B c d e f g")]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in ngram_join.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 4, -1), (1, 4, 1), (1, 4, 1), (2, 4, 1)]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 1]


def test_components(spark):
    edges = [(k + 1, k) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings_against_all_pairs(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(40, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = []
    for k in range(600):
        b, y = base[k % 40], r.normal(size=64)
        y -= y @ b * b
        c = r.uniform(0.9, 0.999)
        rows.append((k, [float(v) for v in (c * b + np.sqrt(1 - c * c) * y / np.linalg.norm(y)) * r.uniform(0.1, 9)], 1))
    odd = [(1000, None, 1), (1001, [0.0] * 64, 1), (1002, [float("nan")] * 64, 1), (1003, [1.0] * 3, 1), (1004, [None] * 64, 1), (5, rows[5][1], 1), (None, rows[3][1], 1)]
    got = {x.vec_id: x for x in embedding_dedup.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, near int")).collect()}
    v = np.array([x[1] for x in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T >= 0.9
    np.fill_diagonal(s, False)
    found = sum(got[k].n_links for k in range(600))
    assert 0.97 * s.sum() <= found <= s.sum() and len(got) == 605
    assert all(got[k].n_links <= s[k].sum() for k in range(600))
    assert all(got[k].n_links == 0 and got[k].kept for k in (1000, 1001, 1002, 1003, 1004))
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("lists", [(6, 2), (8, 3), (10, 4), (12, 5)])
def test_recall_of_every_list_size(spark, lists):
    """Clustered vectors, so that pivots come from clusters too; pairs spread over cosines from the threshold on."""
    r = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centres = unit(r.normal(size=(12, 48)))
    base = unit(centres[r.integers(0, 12, 250)] + 0.12 * r.normal(size=(250, 48)))
    noise = r.normal(size=base.shape)
    noise = unit(noise - (noise * base).sum(axis=1, keepdims=True) * base)
    c = r.uniform(0.9, 0.99, size=(250, 1))
    v = np.concatenate([base, c * base + np.sqrt(1 - c * c) * noise])
    s = v @ v.T >= 0.9
    np.fill_diagonal(s, False)
    rows = [(k, [float(x) for x in a]) for k, a in enumerate(v)] + [(1000 + k, [1.0, 2.0, 3.0 + k / 50]) for k in range(3)]
    got = {x.vec_id: x for x in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lists=lists).collect()}
    found = sum(got[k].n_links for k in range(500))
    print(lists, found / s.sum())
    assert 0.95 * s.sum() <= found <= s.sum()
    # vectors of another length link among themselves
    assert [got[k].n_links for k in (1000, 1001, 1002)] == [2, 2, 2] and got[1002].component_id == 1000


def test_long_lists_are_counted_once(spark):
    r = np.random.default_rng(2)
    b = r.normal(size=16)
    rows = [(k, [float(x) for x in b + 0.01 * r.normal(size=16)]) for k in range(300)]
    df = common.saved(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "v")
    pivots = embedding_dedup.choose_pivots(df, 16)
    d = common.saved(embedding_dedup.describe(df, pivots, 4, 2), "d")
    n = embedding_dedup.link(d, 300, 16, 4, 2, 0.9, block=40).where("kind = 0").groupBy("x").sum("y").collect()
    assert len(n) == 300 and all(x[1] == 299 for x in n)


@pytest.mark.parametrize("least", [0, 10])
def test_warc_round_trip(spark, least):
    pages = [(k, f"http://h/{k} é", f"<p>{k % 7}</p>" * 3) for k in range(30)]
    pages += [(None, None, None), (90, "", ""), (91, None, None), (92, "u", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n"), (93, "u", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n"), (93, "u", "é\r\n\r\n")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    best = {}
    for i, _, h in pages:
        if i is not None:
            best[h or ""] = max(best.get(h or "", -1), i)
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        first = best.get(h or "", i) if len(b) >= least else i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first == i else "revisit", None if first == i else first, True))
    got = warc.round_trip(spark, df, least_bytes=least)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_warc_empty_and_damaged(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(spark, none).count() == 0
    with pytest.raises(ValueError):
        list(warc.records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
    two = b"WARC/1.1\r\nWARC-Type: a\r\nContent-Length: 1\r\n\r\nx\r\n\r\n" * 2
    import gzip

    assert [h["warc-type"] for h, _ in warc.records(gzip.compress(two) + gzip.compress(two))] == ["a"] * 4


def test_orphans_keep_their_row(spark):
    found = spark.createDataFrame([("r1", "request", "gone"), ("m1", "metadata", "x1"), ("x1", "response", None)], "record_id string, type string, concurrent_to string")
    for c, t in (("refers_to", "string"), ("uri", "string"), ("date", "string"), ("digest", "string"), ("computed_digest", "string"), ("page_id", "long"), ("payload_bytes", "long"), ("payload", "binary")):
        from pyspark.sql import functions as F

        found = found.withColumn(c, F.lit(None).cast(t))
    got = {r.capture: r for r in warc.assemble(found).collect()}
    assert got["gone"].main is None and len(got["gone"].requests) == 1 and got["x1"].main.record_id == "x1" and len(got["x1"].metadata) == 1
