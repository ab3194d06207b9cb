"""De-duplication, leakage and reproducible splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import stats

from .relational import ranked_by_bins


def first_of_key(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Rows with is_first: whether a row is the smallest of its key. Keys are aggregated before the join back, so copies don't meet in one window."""
    keyed = df.withColumn("_key", key)
    first = keyed.groupBy("_key").agg(F.min(order).alias("_first"))
    return keyed.join(first, "_key").withColumn("is_first", F.col(order) == F.col("_first")).drop("_key", "_first")


def stratified_holdout(df: DataFrame, key: str, stratum: str, share: float, at_least_one: bool = False) -> DataFrame:
    """(key, stratum, held): of each stratum's keys in sorted order, the first round(n share), half to even, are held out.

    With at_least_one a stratum of two and more gives one at least, and a smaller one none.
    """
    keys = df.groupBy(key).agg(F.min(stratum).alias(stratum))
    ranks = ranked_by_bins(keys, stratum, [key], F.substring(key, 1, 3))
    n = F.col("n")
    held = F.bround(n * F.lit(share), 0)
    if at_least_one:
        held = F.when(n < 2, 0).otherwise(F.greatest(F.lit(1), held))
    return ranks.select(key, stratum, (F.col("rn") <= held).alias("held"))


def three_way(df: DataFrame, key: str, stratum: str, cuts: tuple[float, float] = (0.7, 0.85)) -> DataFrame:
    """split of each key: train, dev or test by its place in its stratum, ordered by a hash in place of a seeded shuffle."""
    hashed = df.withColumn("_h", F.md5(F.col(key).cast("string")))
    ranks = ranked_by_bins(hashed, stratum, ["_h", key], F.substring("_h", 1, 3))
    at, n = F.col("rn"), F.col("n")
    return ranks.withColumn("split", F.when(at <= F.floor(n * F.lit(cuts[0])), "train").when(at <= F.floor(n * F.lit(cuts[1])), "dev").otherwise("test")).drop("_h", "rn", "n")


def leakage_of(df: DataFrame, group: str, label: str) -> DataFrame:
    """One row: entropy of the label, its entropy given the group (bits), Theil's U, the majority baseline and the rows in pure groups."""
    cells = df.groupBy(group, label).agg(F.count("*").alias("n"))
    cells = cells.withColumn("g", F.sum("n").over(Window.partitionBy(group))).withColumn("top", F.max("n").over(Window.partitionBy(group)))
    labels = cells.groupBy(label).agg(F.sum("n").alias("l"))
    total = labels.agg(F.sum("l").alias("t"))
    h = labels.crossJoin(F.broadcast(total)).agg(F.sum(stats.entropy_term(F.col("l") / F.col("t"))).alias("h"), F.max("t").alias("t"))
    given = cells.agg(F.sum(F.col("n") * -F.log2(F.col("n") / F.col("g"))).alias("s"), F.sum(F.when(F.col("n") == F.col("top"), F.col("n"))).alias("_m"), F.coalesce(F.sum(F.when(F.col("n") == F.col("g"), F.col("n"))), F.lit(0)).alias("pure_rows"))
    best = cells.groupBy(group).agg(F.max("n").alias("b")).agg(F.sum("b").alias("majority"))
    out = h.crossJoin(given).crossJoin(best)
    cond = F.col("s") / F.col("t")
    return out.select(F.col("h").alias("entropy"), cond.alias("conditional"), F.when(F.col("h") == 0, 1.0).otherwise((F.col("h") - cond) / F.col("h")).alias("theils_u"), (F.col("majority") / F.col("t")).alias("majority"), "pure_rows")


def round_robin(df: DataFrame, stratum: str, order: str, cap: int, n: int) -> DataFrame:
    """n rows taken in turn from the sorted strata, at most cap of each, with a running number seq."""
    w = Window.partitionBy(stratum).orderBy(order)
    picked = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).orderBy("_rn", stratum).limit(n)
    return picked.withColumn("seq", F.row_number().over(Window.orderBy("_rn", stratum))).drop("_rn")
