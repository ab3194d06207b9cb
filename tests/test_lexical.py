"""The stored index against scoring every document."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import lexical

WORDS = [f"w{i}" for i in range(60)] + ["가나", "나다", "é"]


def corpus(spark, seed=1, n=150):
    rng = random.Random(seed)
    rows = [(i * 70_001 - 3, [rng.choice(WORDS[: rng.choice([3, 12, 63])]) for _ in range(rng.randrange(40))]) for i in range(n)]
    rows += [(10**12, None), (10**12 + 1, []), (10**12 + 2, ["w0"] * 400), (10**12 + 3, ["w5", "w6"]), (10**12 + 4, ["w5", "w6"])]
    return rows, spark.createDataFrame(rows, "id long, t array<string>").repartition(3)


def plain(rows, queries, k, kind):
    n, avg = len(rows), sum(len(t or []) for _, t in rows) / len(rows)
    df = Counter(w for _, t in rows for w in set(t or []))
    out = []
    for qid, terms in queries.items():
        scores = []
        for i, t in rows:
            tf = Counter(t or [])
            s = 0.0
            for w in set(terms):
                if not tf[w]:
                    continue
                if kind == "bm25":
                    s += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg))
                else:
                    s += sum(1 / (j * j) for j in range(1, min(255, tf[w]) + 1)) * 0.1 / 1.64493406685 / math.log2(len(t) + 1) / len(set(terms))
            if s > 0:
                scores.append((-round(s, 9), i))
        out += [(qid, i, -s, r) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


QUERIES = {1: ["w0"], 2: ["w50", "w1", "w2"], 3: ["nothing"], 4: ["w5", "w6"], 5: WORDS, 6: ["가나", "é", "w3"], 7: ["w0", "w59"]}


@pytest.mark.parametrize("kind", ["bm25", "ts_rank"])
@pytest.mark.parametrize("k", [1, 4, 500])
def test_search_equals_full_scoring(spark, tmp_path, kind, k):
    rows, df = corpus(spark)
    index = lexical.build(df, F.col("t"), lexical.bm25_scoring() if kind == "bm25" else lexical.ts_rank_scoring(), str(tmp_path / "index"))
    q = spark.createDataFrame([(i, w) for i, t in QUERIES.items() for w in set(t)], "qid long, term string")
    got = sorted((r.qid, r.id, r.score, r.rank) for r in lexical.search(index, q, k).collect())
    want = plain(rows, QUERIES, k, kind)
    assert [(a[0], a[3], round(a[2], 7)) for a in got] == [(a[0], a[3], round(a[2], 7)) for a in want]
    assert len({(a[0], a[1]) for a in got} ^ {(a[0], a[1]) for a in want}) <= 2  # rounding may turn a tie at the ninth digit


def test_both_ways_of_scoring_agree_and_blocks_are_skipped(spark, tmp_path):
    _, df = corpus(spark, 2, 400)
    index = lexical.build(df, F.col("t"), lexical.bm25_scoring(), str(tmp_path / "index"))
    q = spark.createDataFrame([(i, w) for i, t in QUERIES.items() for w in set(t)], "qid long, term string")
    terms = lexical.asked(index, q).cache()
    bar = lexical.bars(index, terms, 3)
    blocks = lexical.read_blocks(index, terms, bar)
    assert blocks.where("not kept").count() > 0
    every = blocks.select("qid", F.explode("ids").alias("id")).distinct()
    by_document = {(r.qid, r.id): r.score for r in lexical.whole_scores(index, terms, every).collect()}
    by_block = {(r.qid, r.id): r.score for r in lexical.block_scores(blocks, every).collect()}
    assert by_document.keys() == by_block.keys() and all(abs(by_document[x] - by_block[x]) < 1e-8 for x in by_block)
    # what is found only in skipped blocks doesn't reach the bar
    kept = {(r.qid, r.id) for r in blocks.where("kept").select("qid", F.explode("ids").alias("id")).collect()}
    reach = {r.qid: r.bar for r in bar.collect()}
    assert all(s <= reach[x[0]] for x, s in by_block.items() if x not in kept)


def test_an_index_is_reused_until_its_files_change(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows, df = corpus(spark, 3, 20)
    df.write.parquet(path)
    first = lexical.stored(spark.read.parquet(path), F.col("t"), lexical.bm25_scoring(), "test")
    written = spark.read.parquet(f"{first.path}/postings").inputFiles()
    again = lexical.stored(spark.read.parquet(path), F.col("t"), lexical.bm25_scoring(), "test")
    assert again.path == first.path and spark.read.parquet(f"{again.path}/postings").inputFiles() == written
    spark.createDataFrame([(5, ["w0"])], "id long, t array<string>").write.mode("append").parquet(path)
    assert lexical.stored(spark.read.parquet(path), F.col("t"), lexical.bm25_scoring(), "test").path != first.path


def test_nothing_to_search(spark, tmp_path):
    none = spark.createDataFrame([], "id long, t array<string>")
    index = lexical.build(none, F.col("t"), lexical.bm25_scoring(), str(tmp_path / "index"))
    q = spark.createDataFrame([(1, "w0")], "qid long, term string")
    assert lexical.search(index, q, 5).count() == 0
    assert lexical.search(index, q.limit(0), 5).count() == 0


@pytest.mark.parametrize("kind", ["bm25", "ts_rank"])
@pytest.mark.parametrize("k", [1, 4, 500])
def test_documents_and_blocks_find_the_same(spark, tmp_path, monkeypatch, kind, k):
    monkeypatch.setattr(lexical, "QUERIES", 3)
    rows, df = corpus(spark, 5, 300)
    index = lexical.build(df, F.col("t"), lexical.bm25_scoring() if kind == "bm25" else lexical.ts_rank_scoring(), str(tmp_path / "index"))
    q = spark.createDataFrame([(i, w) for i, t in QUERIES.items() for w in set(t)], "qid long, term string")
    terms = lexical.asked(index, q).cache()
    found = [sorted((r.qid, r["rank"], round(r.score, 7)) for r in way(index, terms, k).collect()) for way in (lexical.by_documents, lexical.by_blocks)]
    assert found[0] == found[1] == [(a, r, round(s, 7)) for a, r, s in sorted((a, r, s) for a, _, s, r in plain(rows, QUERIES, k, kind))]


def test_ties_over_many_tasks_go_by_id(spark, tmp_path):
    df = spark.range(-500, 500).select("id", F.split(F.lit("w1 w2 w3"), " ").alias("t")).repartition(7)
    index = lexical.build(df, F.col("t"), lexical.ts_rank_scoring(), str(tmp_path / "index"))
    q = spark.createDataFrame([(7, "w3"), (7, "w1")], "qid long, term string")
    assert [(r.id, r["rank"]) for r in lexical.search(index, q, 3).orderBy("rank").collect()] == [(-500, 1), (-499, 2), (-498, 3)]


def test_what_is_written_and_shuffled_stays_near_the_text(spark, tmp_path):
    """Before, counts, postings and documents were shuffled one after another, and a row for each pair of query and document."""
    rng = random.Random(6)
    words = [f"word{i}" for i in range(400)]
    docs = [(i, [rng.choice(words) for _ in range(300)]) for i in range(400)]
    df = spark.createDataFrame(docs, "id long, t array<string>").repartition(4)
    index = lexical.build(df, F.col("t"), lexical.ts_rank_scoring(), str(tmp_path / "index"))
    q = spark.createDataFrame([(i, w) for i in range(30) for w in set(rng.choices(words, k=60))], "qid long, term string")
    plan = lexical.search(index, q, 5)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "SortMergeJoin" not in text
    size = sum(p.stat().st_size for p in (tmp_path / "index").rglob("*.parquet"))
    assert not (tmp_path / "index" / "counted").exists() and size < sum(len(w) + 1 for _, t in docs for w in t)
