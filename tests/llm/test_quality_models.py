"""Models of quality rules: every source with least_rows rows has its own at every size of the table, and each has settled."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import quality

SOURCES, EACH, LARGE = 1100, 205, 100_000


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """One large source, and more than a thousand sources of under a thousandth of the rows, each about its own centre."""
    total = SOURCES * EACH + LARGE
    grp = F.when(F.col("id") < LARGE, "large").otherwise(F.concat(F.lit("s"), (F.col("id") % SOURCES).cast("string")))
    shift = F.when(F.col("id") < LARGE, 0.0).otherwise((F.col("id") % SOURCES) % 7)
    noise = [(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) + F.pmod(F.xxhash64("id", F.lit(10 + k)), F.lit(1000))) / 1000.0 for k in range(len(quality.STATS))]
    path = str(tmp_path_factory.mktemp("stats"))
    spark.range(total).select("id", grp.alias("grp"), F.lit("en").alias("lng"), *[(shift + n).alias(s) for s, n in zip(quality.STATS, noise, strict=True)]).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def fitted(rows):
    return quality.fit(rows)


def test_each_source_has_its_own_model(fitted):
    _, keyed, _ = fitted
    assert keyed.where("model <> concat('g', grp)").count() == 0
    assert keyed.count() == SOURCES * EACH + LARGE


def test_a_model_is_the_same_in_a_table_of_any_size(rows, fitted):
    few = ["s3", "s500"]
    alone, _, _ = quality.fit(rows.where(F.col("grp").isin(few)))
    a, b = ({r.model: r for r in m.where(F.col("model").isin(["gs3", "gs500"])).collect()} for m in (alone, fitted[0]))
    assert len(a) == len(b) == 2
    assert {r.hot for r in a.values()} == {True} and {r.hot for r in b.values()} == {False}
    for k in a:
        assert np.allclose(a[k].centre, b[k].centre, rtol=1e-6) and np.allclose(a[k].inverse, b[k].inverse, rtol=1e-6)


def test_models_have_settled(rows, fitted):
    """One further step, by sorting and without bins, lowers no determinant by much."""
    models, _, _ = fitted
    assert models.where("not settled").count() == 0
    keep, p = 0.75, len(quality.STATS)
    scale = keep / quality.chi2_cdf(quality.chi2_quantile(keep, p), p + 2)
    for name in ("large", "s3", "s500"):
        m = models.where(F.col("model") == "g" + name).first()
        x = np.array(rows.where(F.col("grp") == name).select(*quality.STATS).collect())
        off = x - np.array(m.centre)
        far = np.einsum("ij,jk,ik->i", off, np.array(m.inverse).reshape(p, p), off)
        near = x[np.argsort(far, kind="stable")[: int(np.ceil(keep * len(x)))]]
        step = np.linalg.slogdet(np.cov(near.T, bias=True) * scale + np.diag(np.square(quality.FLOORS)))[1]
        print(name, step - m.log_det)
        assert step > m.log_det - 0.05


def test_rows_of_small_sources_take_their_languages_model(spark):
    rows = spark.range(500).select(F.when(F.col("id") < 300, "a").when(F.col("id") < 450, "b").otherwise("c").alias("grp"), F.when(F.col("id") < 450, "en").otherwise("de").alias("lng"), *[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(100)) / 100.0).alias(s) for k, s in enumerate(quality.STATS)])
    models, keyed, _ = quality.fit(rows, least_rows=200)
    assert {(r.grp, r.model) for r in keyed.select("grp", "model").distinct().collect()} == {("a", "ga"), ("b", "len"), ("c", "a")}
    assert {r.model for r in models.collect()} == {"ga", "len", "a"}


def test_small_sources_have_models_of_their_own(spark):
    """A source of 60 rows about a centre of its own, against the formula; its language has 1,000 rows about another."""
    r = np.random.default_rng(4)
    big, few = 0.5 + 0.1 * r.normal(size=(1000, 6)), 2.0 + 0.1 * r.normal(size=(60, 6))
    data = [("b", "en", *map(float, x)) for x in big] + [("f", "en", *map(float, x)) for x in few] + [("g", "de", *map(float, big[0]))]
    rows = spark.createDataFrame(data, "grp string, lng string, " + ", ".join(f"{s} double" for s in quality.STATS))
    models, keyed, starts = quality.fit(rows)
    m = {x.model: x for x in models.collect()}
    assert set(m) == {"gb", "gf", "a"}
    wide = np.linalg.inv(np.array({x.model: x for x in starts.collect()}["len"].inverse).reshape(6, 6))
    got = {x.grp: x for x in quality.group_models(keyed, models, starts).collect()}
    assert set(got) == {"b", "f", "g"}
    for g, n in (("b", 1000), ("f", 60)):
        assert np.allclose(got[g].centre, m["g" + g].centre)
        share = quality.STRENGTH / (n + quality.STRENGTH)
        scatter = share * wide + (1 - share) * np.linalg.inv(np.array(m["g" + g].inverse).reshape(6, 6))
        assert np.allclose(np.linalg.inv(np.array(got[g].inverse).reshape(6, 6)), scatter)
    assert abs(got["f"].centre[0] - 2.0) < 0.1
    assert np.allclose(got["g"].centre, m["a"].centre)


def test_no_size_is_a_cliff(spark):
    """A source about a centre of its own, within a language about another: what is rejected doesn't turn on its number of rows."""
    r = np.random.default_rng(8)
    big = 0.5 + 0.05 * r.normal(size=(2000, 6))
    shares = {}
    for n in (8, 20, 100, 199, 200, 400):
        few = 1.5 + 0.05 * r.normal(size=(n, 6))
        few[: n // 10] += 3.0
        data = [("b", "en", *map(float, x)) for x in big] + [("f", "en", *map(float, x)) for x in few]
        rows = spark.createDataFrame(data, "grp string, lng string, " + ", ".join(f"{s} double" for s in quality.STATS))
        models, keyed, starts = quality.fit(rows)
        m = {x.grp: x for x in quality.group_models(keyed, models, starts).collect()}["f"]
        off = few - np.array(m.centre)
        far = np.einsum("ij,jk,ik->i", off, np.array(m.inverse).reshape(6, 6), off) > quality.chi2_quantile(1 - 1e-6, 6)
        shares[n] = far[n // 10 :].mean()
        assert far[: n // 10].all()
    # 8 rows have no tenth of outliers, so ordinary rows are compared
    assert max(shares.values()) < 0.05
