"""Confusion grids, directional error rates, intervals, calibration, reviewers, drift and gates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.functions import grades, stats
from quarrymill.functions.grades import GRADES


def grid(spark: SparkSession) -> DataFrame:
    """All pairs of grades: 16 rows."""
    return spark.createDataFrame([(t, p) for t in GRADES for p in GRADES], "truth string, pred string")


def confusion(df: DataFrame, truth: str = "label", pred: str = "pred") -> DataFrame:
    """(truth, pred, n) for every pair of grades; other labels are left out."""
    n = df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return grid(df.sparkSession).join(n, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def alarms(cells: DataFrame, least_count: int = 1, least_rate: float = 0.05) -> DataFrame:
    """Cells in which the prediction is less secret than the truth: severity by how many grades, fired by count and rate."""
    gap = grades.order("pred") - grades.order("truth")
    total = F.sum("n").over(Window.partitionBy("truth"))
    rate = stats.ratio(F.col("n"), total)
    out = cells.withColumn("rate", rate).withColumn("gap", gap).where("gap > 0").withColumn("severity", F.when(F.col("gap") >= 3, "critical").when(F.col("gap") == 2, "high").otherwise("medium"))
    fires = F.when(F.col("severity").isin("critical", "high"), F.col("n") >= 1).otherwise((F.col("n") >= least_count) & (F.col("rate") >= least_rate))
    return out.withColumn("fired", fires).drop("gap")


def per_class(cells: DataFrame) -> DataFrame:
    """precision, recall, f1, fnr (directional: only less secret predictions) and support of each grade; 0 where undefined."""
    tp = F.sum(F.when(F.col("truth") == F.col("g"), F.when(F.col("pred") == F.col("g"), F.col("n"))))
    g = cells.select(F.explode(F.array(*[F.lit(x) for x in GRADES])).alias("g"), "truth", "pred", "n")
    sums = g.groupBy("g").agg(
        F.coalesce(tp, F.lit(0)).alias("tp"),
        F.sum(F.when(F.col("truth") == F.col("g"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("pred") == F.col("g"), F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when((F.col("truth") == F.col("g")) & (grades.order("pred") > grades.order("truth")), F.col("n")).otherwise(0)).alias("under"),
    )
    p, r = stats.ratio(F.col("tp"), F.col("predicted")), stats.ratio(F.col("tp"), F.col("support"))
    return sums.select(F.col("g").alias("grade"), "support", p.alias("precision"), r.alias("recall"), stats.ratio(2 * p * r, p + r).alias("f1"), stats.ratio(F.col("under"), F.col("support")).alias("fnr"), "tp", "under")


def overall(classes: DataFrame) -> DataFrame:
    """accuracy, macro precision, recall and f1, mean fnr of the high grades."""
    high = F.col("grade").isin(*grades.HIGH)
    return classes.agg(stats.ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), F.avg(F.when(high, F.col("fnr"))).alias("high_fnr"))


def verdict(n: Column, bad: Column, target: float = 0.05, least_n: int = 30, widest: float = 0.30) -> Column:
    """INCONCLUSIVE for few rows, a wide interval or one astride the target; PASS at or under it; FAIL above."""
    low, high = stats.wilson(bad, n)
    return F.when((n < least_n) | (high - low > widest), "INCONCLUSIVE").when(high <= target, "PASS").when(low > target, "FAIL").otherwise("INCONCLUSIVE")


def cards(df: DataFrame, slice_by: str, truth: str = "label", pred: str = "pred") -> DataFrame:
    """For each slice and true grade: n, under-classed and correct predictions, the Wilson interval of the under-class rate and a verdict (N/A for the least secret grade)."""
    t, p = grades.order(truth), grades.order(pred)
    out = df.groupBy(F.coalesce(F.col(slice_by), F.lit("?")).alias("slice"), F.col(truth).alias("truth")).agg(F.count("*").alias("n"), F.count_if(p > t).alias("under"), F.count_if(p == t).alias("correct"))
    low, high = stats.wilson(F.col("under"), F.col("n"))
    return out.withColumn("low", low).withColumn("high", high).withColumn("verdict", F.when(F.col("truth") == GRADES[-1], "N/A").otherwise(verdict(F.col("n"), F.col("under"))))


def reliability(df: DataFrame, confidence: str, correct: Column, bins: int = 10) -> DataFrame:
    """(bin, n, mean_confidence, accuracy), rounded to four places, half to even; the last bin is closed. Confidences outside [0, 1] are left out."""
    c = F.col(confidence)
    at = F.least(F.lit(bins - 1), F.aggregate(F.sequence(F.lit(1), F.lit(bins - 1)), F.lit(0), lambda s, k: s + F.when(c >= k / F.lit(float(bins)), 1).otherwise(0)))
    return df.where(c.between(0, 1)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.bround(F.avg(c), 4).alias("mean_confidence"), F.bround(F.avg(correct.cast("double")), 4).alias("accuracy"))


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg(stats.ratio(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))), F.sum("n")).alias("ece"))


def reviewer_reliability(k: DataFrame, least_comparable: int = 1) -> DataFrame:
    """k (item, at, tie, level, reviewer): of each reviewer's corrections, how many another reviewer's choice can confirm, and how many agree with the item's last level.

    A correction is comparable if a reviewer other than its author chose the item's final
    level too; reviewers with fewer than least_comparable of these are left out. The
    reliability is rounded to four places.
    """
    final = k.groupBy("item").agg(F.max(F.struct("at", "tie", "level")).alias("f")).select("item", F.col("f.level").alias("final"))
    who = k.join(final, "item")
    backers = who.where("level = final").groupBy("item").agg(F.min("reviewer").alias("b1"), F.max("reviewer").alias("b2"))
    out = who.join(backers, "item", "left")
    comparable = F.coalesce((F.col("b1") != F.col("reviewer")) | (F.col("b2") != F.col("reviewer")), F.lit(False))
    agreed = comparable & (F.col("level") == F.col("final"))
    n = out.groupBy("reviewer").agg(F.count("*").alias("total"), F.count_if(comparable).alias("comparable"), F.count_if(agreed).alias("agreed"))
    return n.withColumn("overturned", F.col("comparable") - F.col("agreed")).withColumn("reliability", F.bround(stats.ratio(F.col("agreed"), F.col("comparable")), 4)).where(F.col("comparable") >= least_comparable)


def drift(spark: SparkSession, base: DataFrame, now: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """One row: KL divergence (nats) of two histograms of values in [-1, 1], shares of 1e-9 at least, and whether it reaches .5; 0 and no alert where either is empty."""
    at = F.floor((F.least(F.lit(0.9999), F.greatest(F.lit(-1.0), F.col(column))) + 1) / 2 * bins).cast("int")
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    count = lambda df, name: df.groupBy(at.alias("bin")).agg(F.count("*").alias(name))
    h = every.join(count(base, "q"), "bin", "left").join(count(now, "p"), "bin", "left").na.fill(0)
    sums = h.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    p, q = (F.greatest(F.col(c) / F.col("t" + c), F.lit(1e-9)) for c in "pq")
    out = h.crossJoin(F.broadcast(sums)).where("tp > 0 and tq > 0").agg(F.greatest(F.coalesce(F.sum(p * F.ln(p / q)), F.lit(0.0)), F.lit(0.0)).alias("kl"))
    return out.withColumn("alert", F.col("kl") >= 0.5)


def bootstrap_interval(df: DataFrame, value: Column, rounds: int = 200) -> DataFrame:
    """The mean of value (nulls aside) with its 2.5 and 97.5 percentiles over Poisson resamples of df (id, ...): (n, mean, low, high).

    A row's weight in a round comes from a hash of its id and the round. Each Arrow batch
    gives one sum a round, so no row is repeated for the rounds.
    """
    cdf = np.array([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183])

    def sums(batches):
        for batch in batches:
            h, v = batch.column(0).to_numpy().view(np.uint64)[:, None], batch.column(1).to_numpy()
            z = h + (np.arange(rounds, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            w = np.searchsorted(cdf, ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53))
            yield pa.RecordBatch.from_pydict({"r": np.arange(rounds), "w": w.sum(axis=0).astype(float), "wv": (w * v[:, None]).sum(axis=0), "n": np.full(rounds, len(v)), "total": np.full(rounds, v.sum())})

    rows = df.select(F.xxhash64("id").alias("h"), value.cast("double").alias("v")).where("v is not null")
    means = rows.mapInArrow(sums, "r long, w double, wv double, n long, total double").groupBy("r").agg(F.try_divide(F.sum("wv"), F.sum("w")).alias("m"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    one = means.agg(F.first("n").alias("n"), F.first("total").alias("total"), F.sort_array(F.collect_list("m")).alias("s"))
    return one.select(F.coalesce("n", F.lit(0)).alias("n"), F.try_divide("total", "n").alias("mean"), F.get("s", F.lit(int(0.025 * rounds))).alias("low"), F.get("s", F.lit(int(0.975 * rounds))).alias("high"))


def kill_gate(high_misses: Column, daily: Column, overturn_rate: Column, capacity: int, multiplier: float = 1.5, least_misses: int = 1, most_overturned: float = 0.30) -> Column:
    """struct<tripped, reasons>: whether automatic confirmation stops, for missed high grades, more corrections a day than reviewers can bear, or too many overturned. A limit of 0 or less turns its test off."""
    tests = (("high_grade_miss", (high_misses >= least_misses) & F.lit(least_misses > 0)), ("fatigue", (daily >= capacity * multiplier) & F.lit(capacity > 0)), ("overturn_rate", (overturn_rate >= most_overturned) & F.lit(most_overturned > 0)))
    reasons = F.array_compact(F.array(*[F.when(t, n) for n, t in tests]))
    return F.struct((F.size(reasons) > 0).alias("tripped"), reasons.alias("reasons"))


def deploy_gate(high_fnr: Column, f1: Column, top_share: Column, base_high_fnr: Column, base_f1: Column, anchor_fails: Column | None = None, fnr_tolerance: float = 0.02, f1_tolerance: float = 0.05, first_high_fnr: float | None = None) -> Column:
    """struct<passed, failed>: whether a candidate goes out. Fails where one prediction takes nearly all rows, where the high grades' miss rate is unknown, where it or f1 is worse than the base's by more than is tolerated, where a first model (no base) misses more than first_high_fnr, and where the anchor rows' cards of high grades fail. Unknown shares and bases skip their tests."""
    known = base_high_fnr.isNotNull() | base_f1.isNotNull()
    tests = [
        ("degenerate", top_share >= 0.99),
        ("fnr_high_present", high_fnr.isNull()),
        ("fnr_high_regression", high_fnr > base_high_fnr + fnr_tolerance),
        ("f1_regression", f1 < base_f1 - f1_tolerance),
    ]
    if first_high_fnr is not None:
        tests.append(("first_deploy_fnr_floor", ~known & (high_fnr > first_high_fnr)))
    if anchor_fails is not None:
        tests.append(("anchor_high_grade_miss", anchor_fails > 0))
    failed = F.array_compact(F.array(*[F.when(t, n) for n, t in tests]))
    return F.struct((F.size(failed) == 0).alias("passed"), failed.alias("failed"))


def rollback_need(base_high_fnr: Column, live_high_fnr: Column, samples: Column, least_samples: int = 20, tolerance: float = 0.10) -> Column:
    """struct<rollback, reason>: an active model whose live miss rate of high grades exceeds its own at registration by more than tolerance goes back; without a base or enough rows nothing happens."""
    reason = F.when(base_high_fnr.isNull(), "no_baseline").when(samples.isNull() | (samples < least_samples), "insufficient_live_data").when(live_high_fnr > base_high_fnr + tolerance, "regressed").otherwise("within_tolerance")
    return F.struct((reason == "regressed").alias("rollback"), reason.alias("reason"))


def centroid(vectors: DataFrame, column: str) -> DataFrame:
    """One row, centroid: the mean vector, place by place."""
    places = vectors.select(F.posexplode(column).alias("k", "x")).groupBy("k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return places.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda v: v["m"]).alias("centroid"))


def readiness(checks: DataFrame, by: str) -> DataFrame:
    """checks (by, name, status) to (by, verdict, released, open): FAIL where a check fails, CONDITIONALLY_READY where one is blocked, else PASS; only what passes throughout is released."""
    n = checks.groupBy(by).agg(F.count_if(F.col("status") == "FAIL").alias("failed"), F.count_if(F.col("status") == "BLOCKED").alias("blocked"), F.array_sort(F.collect_list(F.when(F.col("status") != "PASS", F.col("name")))).alias("open"))
    verdict = F.when(F.col("failed") > 0, "FAIL").when(F.col("blocked") > 0, "CONDITIONALLY_READY").otherwise("PASS")
    return n.select(by, verdict.alias("verdict"), ((verdict == "PASS") & (F.size("open") == 0)).alias("released"), "open")


def shares(rows: DataFrame, by: list[str], value: str, bins: int) -> DataFrame:
    """(by..., histogram): the shares of value, from -1 to 1, in so many bins. Only counts by bin are gathered."""
    at = F.floor((F.least(F.lit(0.9999), F.greatest(F.lit(-1.0), F.col(value))) + 1) / 2 * bins).cast("int")
    n = rows.where(F.col(value).isNotNull()).groupBy(*by, at.alias("_bin")).agg(F.count("*").alias("_n"))
    g = n.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_n"))).alias("_m"), F.sum("_n").alias("_t"))
    return g.select(*by, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at(F.col("_m"), b), F.lit(0)) / F.col("_t")).alias("histogram"))


def stored_drift(stored: DataFrame, cosines: DataFrame, value: str, bins: int = 20, limit: float = 0.5, shift_limit: float = 0.0) -> DataFrame:
    """stored (..., histogram) with kl, mean, shift, status and alert of the cosines at hand: a stored histogram of other bins is resampled; one that holds nothing gives the status unknown and leaves the alert to the shift of the mean. No cosines: kl, mean and shift 0."""
    now = shares(cosines, [], value, bins).crossJoin(cosines.agg(F.avg(value).alias("mean")))
    base = stored.select("*", stats.resampled(F.col("histogram"), bins).alias("_p"))
    met = base.join(F.broadcast(now.withColumnRenamed("histogram", "_q")), how="left")
    empty = F.col("histogram").isNull() | (F.aggregate("histogram", F.lit(0.0), lambda s, x: s + x) <= 0)
    kl = F.when(empty | F.col("_q").isNull(), 0.0).otherwise(stats.divergence(F.col("_p"), F.col("_q")))
    out = met.withColumn("kl", kl).withColumn("shift", F.coalesce(1 - F.col("mean"), F.lit(0.0))).withColumn("mean", F.coalesce("mean", F.lit(0.0)))
    moved = (F.lit(shift_limit) > 0) & (F.abs("shift") >= shift_limit)
    bad = (F.col("kl") >= limit) | moved
    return out.withColumn("status", F.when(empty, "unknown").when(bad, "alert").otherwise("ok")).withColumn("alert", F.when(empty, moved).otherwise(bad)).drop("_p", "_q")
