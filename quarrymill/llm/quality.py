"""Quality rules: fixed limits, and robust multivariate outliers.

Every document gets counts of its whole text and a vector of transformed statistics.
For each language and source location and scatter are estimated by the minimum
covariance determinant: from the medians and quartiles, concentration steps, each one
aggregation over all rows, keep the fraction of rows nearest by Mahalanobis distance
until the determinant falls no more. A document far from its group's estimate is rejected.

Every group of LEAST_ROWS rows (one more than there are statistics, as a scatter takes)
has an estimate of its own, whatever the size of the table and the number of groups. Its
centre is its own; its scatter is averaged with its language's spread by quartiles, which counts as STRENGTH rows, so that the weight
of the wider one falls smoothly with the group's size. Only a group of fewer rows has its
language's estimate, or that of all. The
models are a table. Those
with over 1/HOT_KEYS of the rows (so fewer than HOT_KEYS groups, as many languages,
and all) are broadcast; rows of the others are shuffled to theirs. This doesn't touch
the results. Rows are aggregated in partial sums by group and distance, so a group with
a third of all rows is no burden.

Null texts count as empty (no words: rejected by the limits); null lang or source is
a group of its own. Texts are read whole, in time that grows with their length but for
a sort of their words' numbers. Repeated rows, those of one doc_id or of none too, are
each judged by themselves, and each counts for the estimates. Ties of distance fall in
one bin, of which a share counts. Other columns, whatever their names, are not read by
judge() and passed on by kept(). An empty table gives no rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import HOT_KEYS, dropped, join_hot, saved, small_batches, task_starts

_SYMBOLS = b"#*$%&|<>"
_PUNCT = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _SYMBOLS)
_UPPER = re.compile(r"[A-ZÀ-ÖØ-ÞŒŸ]")
STATS = ("s_length", "s_symbols", "s_lines", "s_repeats", "s_upper", "s_punct")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts_of(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    b = (text or "").encode()
    words = b.split()
    n = len(words)
    # white space is ASCII here, and continuation bytes are not code points
    chars = len(text or "") - sum(map(b.count, b" \t\n\r\x0b\x0c"))
    symbols = sum(map(b.count, _SYMBOLS))
    lines = [x for x in b.split(b"\n") if x and not x.isspace()]
    repeats = 0
    if n >= 6:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
        if len(number) < n:
            # windows are numbered exactly, two at a time, so that equal numbers are equal windows
            two = _numbered(ids[:-1], ids[1:])
            four = _numbered(two[:-2], two[2:])
            five = _numbered(four[:-1], ids[4:])
            twice = np.bincount(five)[five] > 1
            if twice.any():
                covered = np.zeros(n + 1, dtype=np.int64)
                at = np.flatnonzero(twice)
                np.add.at(covered, at, 1)
                np.add.at(covered, at + 5, -1)
                repeats = int((np.cumsum(covered[:n]) > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeats


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)


def stats_of(text: str | None, counts: tuple[int, int, int, int, int]) -> tuple[float, ...]:
    """The transformed statistics. Shares are drawn towards usual values by pseudo-counts, so that short texts vary no more than long ones, then square-rooted."""
    n, chars, symbols, dup_lines, repeats = counts
    t = text or ""
    b = t.encode()
    lines = t.count("\n") + 1
    upper = len(_UPPER.findall(t))
    punct = len(b) - len(b.translate(None, _PUNCT))
    return (
        math.log((chars + 120.0) / (n + 20.0)),
        math.sqrt(symbols / (chars + 60.0)),
        math.sqrt(dup_lines / (lines + 8.0)),
        math.sqrt(repeats / (n + 30.0)),
        math.sqrt((upper + 4.0) / (chars + 100.0)),
        math.sqrt((punct + 4.0) / (chars + 100.0)),
    )


_NUMBERS = [*((c, pa.int64()) for c in COUNTS), *((s, pa.float64()) for s in STATS)]


def measure(rows: DataFrame, text: str, texts: bool = False) -> DataFrame:
    """rows with counts and statistics of the column text, which stays only with texts=True; no shuffle."""
    small_batches(rows.sparkSession)
    at = rows.columns.index(text)
    through = [k for k in range(len(rows.columns)) if texts or k != at]

    def run(batches):
        task_starts("quality")
        for batch in batches:
            counted, stats = [], []
            for t in batch.column(at).to_pylist():
                counted.append(c := counts_of(t))
                stats.append(stats_of(t, c))
            numbers = [pa.array([c[k] for c in counted], pa.int64()) for k in range(len(COUNTS))]
            numbers += [pa.array([s[k] for s in stats], pa.float64()) for k in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in through), *numbers], schema=pa.schema([*(batch.schema.field(k) for k in through), *_NUMBERS]))

    schema = StructType([*(rows.schema[k] for k in through), *(StructField(c, LongType()) for c in COUNTS), *(StructField(s, DoubleType()) for s in STATS)])
    return rows.mapInArrow(run, schema)


def chi2_cdf(x: float, k: float) -> float:
    """Chi-square distribution function, by the series of the lower incomplete gamma function."""
    a, z = k / 2.0, x / 2.0
    if z <= 0:
        return 0.0
    term = total = 1.0 / a
    n = 0
    while term > total * 1e-15 and n < 10_000:
        n += 1
        term *= z / (a + n)
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, k: float) -> float:
    low, high = 0.0, 10.0 * k + 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return (low + high) / 2


#: Least standard deviation of each statistic: below it, spread is noise of the transform.
FLOORS = (0.05, 0.04, 0.10, 0.12, 0.03, 0.03)


#: A scatter of so many statistics takes one row more at least; smaller groups have no estimate.
LEAST_ROWS = len(STATS) + 1
#: The wider spread counts as so many rows of a group.
STRENGTH = 50.0

#: An estimate has settled once a step lowers the logarithm of its determinant by less than this.
SETTLED = 1e-4

_MODEL = pa.schema([("model", pa.string()), ("hot", pa.bool_()), ("centre", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64())), ("log_det", pa.float64()), ("settled", pa.bool_())])
_MODEL_SQL = "model string, hot boolean, centre array<double>, inverse array<double>, log_det double, settled boolean"


def _inverted(scatter: np.ndarray) -> tuple[list[float], float]:
    """The inverse of a scatter matrix with its floors, and the logarithm of its determinant."""
    whole = scatter + np.diag(np.square(FLOORS))
    return np.linalg.inv(whole).reshape(-1).tolist(), float(np.linalg.slogdet(whole)[1])


def _first(batches):
    """Rows (model, hot, quartiles of each statistic) to the models that the steps start from; their determinants count for nothing."""
    for batch in batches:
        out = []
        for model, hot, *q in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            inverse, _ = _inverted(np.diag([((x[2] - x[0]) / 1.349) ** 2 for x in q]))
            out.append((model, hot, [x[1] for x in q], inverse, math.inf, False))
        yield _models_batch(out)


def _stepped(scale: float):
    """Rows (model, hot, centre, inverse, log_det, sums) to the models after the step: of those before and after, the one with the smaller determinant."""
    p = len(STATS)

    def run(batches):
        for batch in batches:
            out = []
            for model, hot, centre, inverse, log_det, sums in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                n, first, second = sums[0], np.array(sums[1 : p + 1]), np.zeros((p, p))
                second[np.triu_indices(p)] = sums[p + 1 :]
                mean = first / n
                scatter = (second + np.triu(second, 1).T) / n - np.outer(mean, mean)
                new, new_det = _inverted(scatter * scale)
                settled = not new_det <= log_det - SETTLED
                if new_det < log_det:
                    centre, inverse, log_det = mean.tolist(), new, new_det
                out.append((model, hot, centre, inverse, log_det, settled))
            yield _models_batch(out)

    return run


def _models_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_MODEL)], schema=_MODEL)


def _distance():
    """Squared Mahalanobis distance of the statistics from the model columns centre and inverse."""
    p = len(STATS)
    off = [F.col(s) - F.col("centre")[k] for k, s in enumerate(STATS)]
    total = None
    for i in range(p):
        for j in range(i, p):
            term = off[i] * off[j] * F.col("inverse")[i * p + j] * (1.0 if i == j else 2.0)
            total = term if total is None else total + term
    return F.greatest(total, F.lit(0.0))


def _keyed(rows: DataFrame, total: int, least_rows: int) -> DataFrame:
    """rows with by_grp and by_lng, the models that they count for besides that of all, whether those are hot, and model and hot of the one that is theirs."""
    for c in ("grp", "lng"):
        n = F.col("count")
        own = F.when(n >= least_rows, F.concat(F.lit(c[0]), c))
        counts = saved(rows.groupBy(c).count().select(c, own.alias(f"by_{c}"), (n > max(1, total // HOT_KEYS)).alias(f"hot_{c}"), n.alias("_n")), "quality-counts")
        rows = join_hot(rows, counts, c, "_n", total)
    theirs = F.when(F.col("by_grp").isNotNull(), F.col("hot_grp")).when(F.col("by_lng").isNotNull(), F.col("hot_lng")).otherwise(True)
    return rows.withColumn("model", F.coalesce("by_grp", "by_lng", F.lit("a"))).withColumn("hot", theirs)


def with_models(rows: DataFrame, models: DataFrame) -> DataFrame:
    """rows (model, hot, ...) with centre and inverse of the models that are there."""
    names = ["model", "centre", "inverse"]
    near = rows.where("hot").join(F.broadcast(models.where("hot").select(names)), "model")
    return near.unionByName(rows.where("not hot").join(models.where("not hot").select(names), "model"))


def _sums() -> list:
    """Aggregates that mean and scatter follow from: the number of rows, the sums of the statistics, and those of their products."""
    return [F.count("*").cast("double"), *[F.sum(s) for s in STATS], *[F.sum(F.col(a) * F.col(b)) for k, a in enumerate(STATS) for b in STATS[k:]]]


def fit(rows: DataFrame, *, keep: float = 0.75, least_rows: int = LEAST_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables: the models by group, language and all, as far as rows take them; rows with model and hot of the one that is theirs; and what all of these models start from (medians and spreads by quartiles).

    rows should be a table. Each concentration step reads the statistics once or twice;
    steps end when every estimate has settled, which they do: each step but the last
    of a model lowers the logarithm of its determinant by SETTLED at least, and that
    is bounded below by the floors.
    """
    spark = rows.sparkSession
    small_batches(spark)
    p = len(STATS)
    total = rows.count()
    keyed = saved(_keyed(rows, total, least_rows), "quality-keyed")
    # every row counts for its group's model, its language's and that of all: at most three
    key = lambda by, hot: F.when(F.col(by).isNotNull(), F.struct(F.col(by).alias("model"), F.col(hot).alias("hot")))
    used = keyed.select(F.explode(F.array_compact(F.array(key("by_grp", "hot_grp"), key("by_lng", "hot_lng"), F.struct(F.lit("a").alias("model"), F.lit(True).alias("hot"))))).alias("m"), *STATS).select("m.*", *STATS)

    share = chi2_cdf(chi2_quantile(keep, p), p + 2)
    sums = [c.alias(f"s{k}") for k, c in enumerate(_sums())]
    names = [f"s{k}" for k in range(len(sums))]
    quartiles = used.groupBy("model", "hot").agg(*[F.percentile_approx(s, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 2000).alias(s) for s in STATS])
    needed = keyed.select("model").distinct()
    starts = saved(quartiles.mapInArrow(_first, _MODEL_SQL), "quality-starts")
    models = saved(starts.join(needed, "model", "left_semi"), "quality-models")
    while (active := models.where("not settled")).limit(1).count():
        binned = with_models(used, active).withColumn("bin", F.floor(F.log(_distance() + 1e-6) * 12).cast("int")).groupBy("model", "bin").agg(*sums)
        by_bin, whole = Window.partitionBy("model").orderBy("bin"), Window.partitionBy("model")
        upto = binned.select("model", "bin", *names, *[F.sum(c).over(by_bin).alias(f"t{c}") for c in names], (F.sum("s0").over(whole) * keep).alias("most"))
        # of the last bin only the part that makes up the kept fraction counts
        over = (F.col("ts0") - F.col("most")) / F.col("s0")
        nearest = upto.where("ts0 >= most").groupBy("model").agg(F.min_by(F.array(*[F.col(f"t{c}") - over * F.col(c) for c in names]), "bin").alias("sums"))
        step = active.join(nearest, "model").select("model", "hot", "centre", "inverse", "log_det", "sums").mapInArrow(_stepped(keep / share), _MODEL_SQL)
        before, models = models, saved(step.union(models.where("settled")), "quality-models")
        dropped(spark, before)
    return models, keyed, starts


def limits_failed():
    """The fixed limits: fewer than 10 words, or over a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def _shrunk(strength: float):
    """Rows (grp, _n, centre, inverse, own, wide) with the scatter of groups' own models drawn towards the wider spread, which counts as strength rows; centres stay."""
    p = len(STATS)
    square = lambda x: np.linalg.inv(np.array(x).reshape(p, p))

    def run(batches):
        for batch in batches:
            grp, n, centres, inverses, own, wide = (c.to_pylist() for c in batch.columns)
            for k in range(len(grp)):
                if own[k]:
                    share = strength / (n[k] + strength)
                    inverses[k] = np.linalg.inv(share * square(wide[k]) + (1 - share) * square(inverses[k])).reshape(-1).tolist()
            lists = [pa.array(x, pa.list_(pa.float64())) for x in (centres, inverses)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["grp", "_n", "centre", "inverse"])

    return run


def group_models(keyed: DataFrame, models: DataFrame, starts: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """(grp, _n, centre, inverse) of every group: its own estimate, the scatter drawn towards its language's spread (or that of all) by its number of rows; of the few rows that can't have one, the language's estimate (or that of all)."""
    groups = keyed.groupBy("grp").agg(*[F.first(c).alias(c) for c in ("model", "hot", "by_lng", "hot_lng")], F.count("*").alias("_n"))
    own = with_models(groups.drop("by_lng", "hot_lng"), models).select("grp", "_n", "centre", "inverse", (F.col("model") == F.concat(F.lit("g"), "grp")).alias("own"))
    theirs = groups.select("grp", F.coalesce("by_lng", F.lit("a")).alias("model"), (F.col("by_lng").isNull() | F.col("hot_lng")).alias("hot"))
    wide = with_models(theirs, starts).select("grp", F.col("inverse").alias("wide"))
    return own.join(wide, "grp").mapInArrow(_shrunk(strength), "grp string, _n long, centre array<double>, inverse array<double>")


def _grouped(docs: DataFrame) -> DataFrame:
    """The columns of docs under the names c0, c1, ..., and grp and lng, the group and language that models are keyed by."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    named = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    return docs.select(*named, F.concat_ws("\x1f", part("lang"), part("source")).alias("grp"), part("lang").alias("lng"))


def _fitted(measured: DataFrame, keep: float) -> DataFrame:
    """A table (grp, _n, centre, inverse) of every group of measured rows, a table."""
    spark = measured.sparkSession
    models, keyed, starts = fit(measured.select("grp", "lng", *STATS), keep=keep)
    out = saved(group_models(keyed, models, starts), "quality-groups")
    for table in (keyed, models, starts):
        dropped(spark, table)
    return out


def _verdicts(rows: DataFrame, tail: float) -> DataFrame:
    """Measured rows with centre and inverse, to these with base_failed, distance and kept."""
    limit = chi2_quantile(1.0 - tail, len(STATS))
    far = rows.withColumn("distance", _distance()).withColumn("base_failed", limits_failed())
    return far.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True)))


def judge(docs: DataFrame, *, tail: float = 1e-6, keep: float = 0.75) -> DataFrame:
    """docs (doc_id, text, lang, source) with counts, base_failed, distance (squared Mahalanobis) and kept.

    tail: the share of ordinary rows, were they normal, that the distance limit rejects.
    Rows of groups with over 1/HOT_KEYS of the rows stay where they are, those of others
    are shuffled to their model.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang", "source")
    whole = saved(measure(_grouped(rows), "c1"), "quality")
    out = _verdicts(join_hot(whole, _fitted(whole, keep), "grp", "_n", whole.count()), tail)
    return out.select(F.col("c0").alias("doc_id"), *COUNTS, "base_failed", "kept", "distance", *STATS)


def kept(docs: DataFrame, *, tail: float = 1e-6, keep: float = 0.75) -> DataFrame:
    """The rows of docs, all columns, that judge() keeps. Texts are read and measured twice, once for the models and once beside them, rather than stored again or shuffled; only those of groups with at most 1/HOT_KEYS of the rows are shuffled to their model."""
    rows = _grouped(docs)
    text = f"c{docs.columns.index('text')}"
    whole = saved(measure(rows.select(text, "grp", "lng"), text), "quality")
    models = join_hot(rows, _fitted(whole, keep), "grp", "_n", whole.count())
    dropped(docs.sparkSession, whole)
    out = _verdicts(measure(models, text, texts=True), tail).where("kept")
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
