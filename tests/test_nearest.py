"""The search in blocks against every pair, and against its own cost."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from quarrymill import catalog
from quarrymill.operators import retrieval as ir


def plain(queries, corpus, k):
    """SQL's cosine of every pair, in Python."""

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b:
            return 0.0
        d = m = n = 0.0
        for x, y in zip(a, b, strict=True):
            d, m, n = d + x * y, m + x * x, n + y * y
        norm = math.sqrt(m * n)
        return 0.0 if norm == 0 else math.nan if math.isnan(d) else max(-1.0, min(1.0, d / norm))

    out = []
    for q, a in queries:
        best = sorted((0 if math.isnan(s) else 1, -s, i, s) for i, b in corpus for s in [cosine(a, b)])
        out += [(q, i, repr(s), r) for r, (_, _, i, s) in enumerate(best[:k], 1)]
    return sorted(out)


def odd_rows():
    rng = random.Random(4)
    rows = [[rng.randrange(-8, 9) / 4 for _ in range(6)] for _ in range(260)]
    rows += [rows[0]] * 60 + [[3 * x for x in rows[1]]] * 5 + [[-x for x in rows[0]]]
    rows += [None, [], [0.0] * 6, [1.0, None, 1.0, 0.0, 0.0, 0.0], [1.0, 2.0], [0.0, 0.0], [math.nan, 1.0, 0.0, 0.0, 0.0, 0.0], [1e-3] * 6]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("k", [1, 7, 40, 500])
@pytest.mark.parametrize("bound", [1000, 9])
def test_the_search_in_blocks_equals_every_pair(spark, monkeypatch, kind, k, bound):
    monkeypatch.setattr(ir, "BLOCK", 32)
    rows = odd_rows()
    vec = [(i, None if x is None else [None if v is None else float(v) for v in x]) for i, x in rows]
    c = spark.createDataFrame(vec, "id long, vec array<double>").withColumn("vec", F.col("vec").cast(f"array<{kind}>")).repartition(3)
    exact = sorted((r.id, r.vec) for r in c.collect())
    asked = [x for x in exact if x[0] % 4 == 0 or x[1] is None or len(x[1]) < 6 or None in x[1] or any(math.isnan(v) for v in x[1])]
    q = c.join(spark.createDataFrame([(i,) for i, _ in asked], "id long"), "id").select(F.col("id").alias("qid"), "vec")
    got = sorted((r.qid, r.id, repr(r.score), r["rank"]) for r in ir.nearest(q, c, k, bound).collect())
    assert got == plain(asked, exact, k)


def test_names_of_any_kind_and_nothing_to_search(spark):
    c = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), (None, [1.0, 0.0]), ("é", [0.0, 1.0])], "id string, vec array<double>")
    q = spark.createDataFrame([("x", [1.0, 0.0])], "qid string, vec array<double>")
    assert [(r.qid, r.id, r.score, r["rank"]) for r in ir.nearest(q, c, 3).orderBy("rank").collect()] == [("x", None, 1.0, 1), ("x", "a", 1.0, 2), ("x", "b", 1.0, 3)]
    assert ir.nearest(q.limit(0), c, 3).count() == 0 and ir.nearest(q, c.limit(0), 3).count() == 0 and ir.nearest(q, c, 0).count() == 0


SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["ir06_multi_query", "ir12_votes", "ir09_rerank", "vec03_nearest", "ir11_vote_sweep", "ir05_weighted", "ir04_rrf", "ir13_metrics", "ir14_alpha_grid", "ir09_reranked"])
def test_no_row_for_each_pair(spark, name):
    """Before, each query met each row in a join, and expressions summed up the components of every pair."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "zip_with" not in plan
