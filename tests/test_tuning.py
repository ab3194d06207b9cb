"""Guided search against trying everything."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from quarrymill.functions import arrow, text
from quarrymill.operators import tuning


def test_guided_search_finds_the_best_of_a_grid_in_a_third_of_its_trials(spark):
    rows = spark.range(40).select((F.col("id") / 40.0).alias("x"))
    space = {"a": tuning.Range(0.0, 1.0, 0.1), "b": tuning.Range(0.0, 1.0, 0.1), "c": tuning.Choice((True, False))}
    value = lambda a, b, c: -((a - 0.7) ** 2) - (b - 0.2) ** 2 - (0.0 if c else 0.3)
    passes = []

    def evaluate(tried):
        passes.append(1)
        score = -F.pow(F.col("a") - 0.7, 2) - F.pow(F.col("b") - 0.2, 2) - F.when(F.col("c"), 0.0).otherwise(0.3)
        return tried.groupBy("trial").agg(F.max(score).alias("objective"))

    steps = [round(0.1 * k, 12) for k in range(11)]
    top = max(value(a, b, c) for a, b, c in itertools.product(steps, steps, (True, False)))
    trials = tuning.tune(rows, space, evaluate, trials=80, batch=10, seed=42)
    found, reached = tuning.best(trials)
    assert len(trials) == 80 and len(passes) <= 8
    assert abs(reached - top) < 1e-9 and (found["a"], found["b"], found["c"]) == (0.7, 0.2, True)
    assert tuning.tune(rows, space, evaluate, trials=20, seed=3) == tuning.tune(rows, space, evaluate, trials=20, seed=3)


def test_densities_are_densities():
    r = tuning.Range(0.0, 2.0)
    for at in ([], [0.1], [0.0, 2.0, 1.0, 1.0]):
        assert abs(sum(r.density(2.0 * (k + 0.5) / 4000, at) for k in range(4000)) / 2000 - 1.0) < 1e-3
    c = tuning.Choice(("x", "y", "z"))
    assert abs(sum(c.density(v, ["x", "x", "y"]) for v in c.values) - 1.0) < 1e-12


def test_embeddings_keep_case_and_take_empty_texts():
    assert arrow.embedding("Ab", 64) != arrow.embedding("ab", 64)
    assert arrow.embedding("", 64) == arrow.embedding(None, 64) and sum(x * x for x in arrow.embedding("", 64)) == 1.0
    # blake2b of the token, its first four bytes for the place and the fifth for the sign
    v = arrow.embedding("가나", 64)
    assert sorted(map(abs, v))[-1] == 1.0 and sum(map(abs, v)) == 1.0


def test_keys_and_masks_know_other_scripts(spark):
    df = spark.createDataFrame([("a b\u3000c\xa0",), ("abc",), ("\u2028a\x1fbc",)], "t string")
    assert len({r[0] for r in df.select(text.text_key("t")).collect()}) == 1
    masked = text.mask_pii(spark.createDataFrame([("１２３４５６-１２３４５６７",), ("no digits",), (None,)], "t string"), "t")
    assert sorted(r.masked for r in masked.collect()) == ["", "[CORPNO]", "no digits"]
