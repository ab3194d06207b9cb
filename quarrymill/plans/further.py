"""Queries: the remaining small operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymill.functions import grades, stats
from quarrymill.operators import labeling as lb
from quarrymill.operators import tuning
from quarrymill.streaming.jobs import Hysteresis

from .projections import CORRECTIONS, GOLD, PRED, corrections, gold, predictions, read
from .relational import ORDER_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT conv_id, bool_or(length(text) < 60) AS real_evidence, count(*) FILTER (WHERE length(text) < 60) AS n_real FROM conversations GROUP BY conv_id")
def prj08_real_evidence(spark, d):
    """PRJ-08: any piece of evidence that isn't a fallback."""
    m = F.collect_list(F.struct(F.when(F.length("text") >= 60, F.length("text")).alias("start")))
    c = read(spark, d, "conversations").groupBy("conv_id").agg(m.alias("m"))
    return c.select("conv_id", F.exists("m", lambda x: x["start"].isNull()).alias("real_evidence"), F.size(F.filter("m", lambda x: x["start"].isNull())).cast("long").alias("n_real"))


@query(f"SELECT CASE WHEN source IN ('src1', 'src2') THEN 'locked_gold_eval' WHEN source IN ('src3', 'src4') THEN 'legal_floor' WHEN source = 'src5' THEN 'gold_candidate' ELSE 'silver_train' END AS tier, count(*) AS n, count(*) FILTER (WHERE source NOT IN ('src1', 'src2')) AS n_train FROM ({GOLD}) GROUP BY 1")
def spl05_tiers(spark, d):
    """SPL-05: rows by tier; all but the locked ones train."""
    source = F.when(F.col("source").isin("src1", "src2"), "human_review").when(F.col("source").isin("src3", "src4"), "public_definitive").when(F.col("source") == "src5", "rule_llm_agreement").otherwise("llm_judge_a")
    t = gold(spark, d).select(grades.tier(source, F.lit("kim"), F.lit("needs_review")).alias("tier"))
    return t.groupBy("tier").agg(F.count("*").alias("n"), F.count_if(F.col("tier") != "locked_gold_eval").alias("n_train"))


@query("SELECT conv_id, round(0.5 + 0.5 * avg(least(1.0::DOUBLE, abs(length(text) / 500.0::DOUBLE - 1))), 9) AS confidence FROM conversations GROUP BY conv_id")
def lab07_confidence_fallback(spark, d):
    """LAB-07."""
    v = F.length("text") / F.lit(500.0)
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.round(0.5 + 0.5 * F.avg(F.least(F.lit(1.0), F.abs(v - 1))), 9).alias("confidence"))


_SCORES = "SELECT doc_id, pred, confidence AS c, (1 - confidence) * 0.6 AS a, (1 - confidence) * 0.4 AS b FROM ({})"


@query(f"WITH s AS ({_SCORES.format(PRED)}), r AS (SELECT *, greatest(c, 0.5::DOUBLE, greatest(a, b) + 1e-6) AS raised FROM s) SELECT doc_id, round(raised / (raised + a + b), 9) AS p_label, round(a / (raised + a + b), 9) AS p_a, round(b / (raised + a + b), 9) AS p_b FROM r")
def inf03_label_consistency(spark, d):
    """INF-03: the label's probability is raised over the others' and a floor, then all are scaled to one."""
    c = F.col("confidence")
    s = predictions(spark, d).select("doc_id", c.alias("c"), ((1 - c) * 0.6).alias("a"), ((1 - c) * 0.4).alias("b"))
    s = s.withColumn("r", F.greatest("c", F.lit(0.5), F.greatest("a", "b") + 1e-6)).withColumn("t", F.col("r") + F.col("a") + F.col("b"))
    return s.select("doc_id", *[F.round(F.col(x) / F.col("t"), 9).alias(n) for x, n in (("r", "p_label"), ("a", "p_a"), ("b", "p_b"))])


@query("""WITH d AS (SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, avg((value > 10)::INT) AS v, 'f' || (day(ts) // 10) AS fp FROM events GROUP BY 1, 2, 4),
g AS (SELECT *, sum((v < 0.4)::INT) OVER (PARTITION BY event_type, fp ORDER BY day) AS g FROM d), s AS (SELECT *, sum((v >= 0.4)::INT) OVER (PARTITION BY event_type, fp, g ORDER BY day) AS streak FROM g)
SELECT event_type, day, CAST(streak AS BIGINT) AS streak, streak >= 3 AS alert FROM s""")
def gat11_hysteresis(spark, d):
    """GAT-11: an alert after three checks in a row; a new fingerprint starts anew."""
    e = read(spark, d, "events").withColumn("fp", F.concat(F.lit("f"), F.floor(F.dayofmonth("ts") / 10).cast("string")))
    v = e.groupBy("event_type", F.date_trunc("day", "ts").cast("date").alias("day"), "fp").agg(F.avg((F.col("value") > 10).cast("double")).alias("v"))
    return Hysteresis(3)(v, "event_type", "day", "v", "fp", 0.4).select("event_type", "day", F.col("streak").cast("long").alias("streak"), "alert")


@query("""WITH h AS (SELECT floor(value / 10) AS bin, count(*) AS n FROM events GROUP BY 1), c AS (SELECT bin, n, sum(n) OVER (ORDER BY bin) / (sum(n) OVER ())::DOUBLE AS hi, (sum(n) OVER (ORDER BY bin) - n) / (sum(n) OVER ())::DOUBLE AS lo FROM h)
SELECT q, round((bin + (q - lo) / (hi - lo)) * 10, 6) AS value FROM c JOIN (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9])::DOUBLE AS q) ON q > lo AND q <= hi""")
def gat10_histogram_quantiles(spark, d):
    """GAT-10, STR-02: values at given shares from a stored histogram, linear within a bin. The histogram is an aggregate; the window runs over its bins."""
    h = read(spark, d, "events").groupBy(F.floor(F.col("value") / 10).alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    up = F.sum("n").over(Window.orderBy("bin"))
    c = h.select("bin", (up / total).alias("hi"), ((up - F.col("n")) / total).alias("lo"))
    c = c.select("bin", "hi", "lo", F.explode(F.array(*[F.lit(q) for q in (0.1, 0.25, 0.5, 0.75, 0.9)])).alias("q"))
    return c.where("q > lo and q <= hi").select("q", F.round((F.col("bin") + (F.col("q") - F.col("lo")) / (F.col("hi") - F.col("lo"))) * 10, 6).alias("value"))


@query("SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rn FROM embeddings) WHERE rn <= 20")
def vec05_recent_vectors(spark, d):
    """VEC-05: the twenty newest vectors of each class (a sampling operator)."""
    w = Window.partitionBy("label").orderBy(F.desc("vec_id"))
    return read(spark, d, "embeddings").withColumn("rn", F.row_number().over(w)).where("rn <= 20").select("vec_id", "label")


_KNOBS = [(a / 10, b / 10) for a in range(1, 10, 2) for b in range(1, 10, 2)]
_T, _P = ORDER_SQL.format("label"), ORDER_SQL.format("pred")


@query(f"""WITH k AS (SELECT unnest([{', '.join(str(a) for a, _ in _KNOBS)}])::DOUBLE AS a, unnest([{', '.join(str(b) for _, b in _KNOBS)}])::DOUBLE AS b), s AS (SELECT k.a, k.b, label IN ('TS', 'S1') AS t, confidence >= CASE WHEN domain = 'en' THEN k.a ELSE k.b END AS p FROM ({PRED}), k),
x AS (SELECT a, b, count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE t <> p) AS off, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE t) AS n FROM s GROUP BY a, b)
SELECT a, b, round(CASE WHEN 2 * tp + off = 0 THEN 0.0::DOUBLE ELSE 2 * tp / (2 * tp + off)::DOUBLE END - 10 * CASE WHEN n > 0 AND fn / n::DOUBLE > 0.8 THEN 1 ELSE 0 END, 9) AS objective FROM x""")
def evl18_knob_grid(spark, d):
    """EVL-18: F1 less ten for a violated target, over a fixed grid in place of a guided search."""
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _KNOBS]))
    s = predictions(spark, d).select(grades.is_high("label").alias("t"), "confidence", "domain", grid.alias("k")).select("t", "k.a", "k.b", (F.col("confidence") >= F.when(F.col("domain") == "en", F.col("k.a")).otherwise(F.col("k.b"))).alias("p"))
    t, p = F.col("t"), F.col("p")
    x = s.groupBy("a", "b").agg(F.count_if(t & p).alias("tp"), F.count_if(t != p).alias("off"), F.count_if(t & ~p).alias("fn"), F.count_if(t).alias("n"))
    f1 = stats.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("off"))
    return x.select("a", "b", F.round(f1 - 10 * F.when(stats.ratio(F.col("fn"), F.col("n")) > 0.8, 1).otherwise(0), 9).alias("objective"))


@query(f"""WITH k AS (SELECT a.i * 0.05::DOUBLE AS a, b.i * 0.05::DOUBLE AS b FROM range(0, 21) a(i), range(0, 21) b(i)), s AS (SELECT k.a, k.b, label IN ('TS', 'S1') AS t, confidence >= round(CASE WHEN domain = 'en' THEN k.a ELSE k.b END, 12) AS p FROM ({PRED}), k),
x AS (SELECT a, b, count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE t <> p) AS off, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE t) AS n FROM s GROUP BY a, b)
SELECT round(max(CASE WHEN 2 * tp + off = 0 THEN 0.0::DOUBLE ELSE 2 * tp / (2 * tp + off)::DOUBLE END - 10 * greatest(0.0::DOUBLE, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE fn / n::DOUBLE END - 0.6)), 9) AS objective, CAST(140 AS BIGINT) AS trials FROM x""")
def evl18_guided_search(spark, d):
    """EVL-18: the best objective of a guided search in 140 trials; its SQL tries all 441 settings. F1 less ten times what the share of missed high grades exceeds its target by."""
    rows = predictions(spark, d).select(grades.is_high("label").alias("t"), "confidence", "domain")
    t, p = F.col("t"), F.col("confidence") >= F.when(F.col("domain") == "en", F.col("a")).otherwise(F.col("b"))

    def evaluate(tried):
        x = tried.groupBy("trial").agg(F.count_if(t & p).alias("tp"), F.count_if(t != p).alias("off"), F.count_if(t & ~p).alias("fn"), F.count_if(t).alias("n"))
        missed = F.greatest(F.lit(0.0), stats.ratio(F.col("fn"), F.col("n")) - 0.6)
        return x.select("trial", (stats.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("off")) - 10 * missed).alias("objective"))

    trials = tuning.tune(rows, {"a": tuning.Range(0.0, 1.0, 0.05), "b": tuning.Range(0.0, 1.0, 0.05)}, evaluate, trials=140, batch=20)
    return spark.createDataFrame([(round(tuning.best(trials)[1], 9), len(trials))], "objective double, trials long")


@query(f"SELECT label, pred, count(*) AS n, count(*) FILTER (WHERE {_P} > {_T} AND contains(text, 'License')) AS silent_cap, count(*) FILTER (WHERE source = 'src1' AND {_P} > 2) AS floor_violations FROM ({PRED}) GROUP BY 1, 2")
def evl14_invariants(spark, d):
    """EVL-14: predictions that a cap lowered unseen, and ones under their source's floor."""
    low = grades.order("pred") > grades.order("label")
    return predictions(spark, d).groupBy("label", "pred").agg(F.count("*").alias("n"), F.count_if(low & F.contains("text", F.lit("License"))).alias("silent_cap"), F.count_if((F.col("source") == "src1") & (grades.order("pred") > 2)).alias("floor_violations"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[a-z]{6,}')) AS INT) AS n_evidence, round(CASE WHEN len(regexp_extract_all(text, '[a-z]{6,}')) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(regexp_extract_all(text, '[a-z]{6,}'), lambda e: contains(lower(text), e))) / len(regexp_extract_all(text, '[a-z]{6,}'))::DOUBLE END, 9) AS grounded FROM documents")
def msc13_groundedness(spark, d):
    """MSC-13: the share of evidence strings that occur in the text."""
    e = F.regexp_extract_all("text", F.lit("([a-z]{6,})"), F.lit(1))
    return read(spark, d, "documents").select("doc_id", "text", e.alias("e")).select("doc_id", F.size("e").alias("n_evidence"), F.round(stats.ratio(F.size(F.filter("e", lambda x: F.contains(F.lower(F.col("text")), x))), F.size("e")), 9).alias("grounded"))


@query(f"SELECT corrected_by, string_agg(correction_id::VARCHAR, ',' ORDER BY corrected_at, correction_id) AS trail FROM ({CORRECTIONS}) WHERE consumed GROUP BY corrected_by")
def str11_consumed_trail(spark, d):
    """STR-11: each reviewer's consumed corrections in order."""
    k = corrections(spark, d).where("consumed").groupBy("corrected_by").agg(F.sort_array(F.collect_list(F.struct("corrected_at", "correction_id"))).alias("c"))
    return k.select("corrected_by", F.array_join(F.transform("c", lambda x: x["correction_id"].cast("string")), ",").alias("trail"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'SECRECY' WHEN 1 THEN 'VALUE' WHEN 2 THEN 'MANAGEMENT' ELSE 'OTHER' END AS factor, CASE WHEN doc_id % 7 = 0 THEN 0.0::DOUBLE ELSE round_even(least(5.0::DOUBLE, (n_chars % 100) / (doc_id % 7)::DOUBLE * 5), 2) END AS score FROM documents""")
def lab02_factors(spark, d):
    """LAB-02: older factor codes stand for the new ones; scores on a scale of five."""
    i = F.col("doc_id") % 4
    code = F.when(i == 0, "NON_PUBLICITY").when(i == 1, F.when(F.col("doc_id") % 8 == 1, "LEAK_IMPACT").otherwise("ECONOMIC_VALUE")).when(i == 2, "MANAGEMENT_LEVEL").otherwise("OTHER")
    return read(spark, d, "documents").select("doc_id", grades.folded_factor(code).alias("factor"), lb.scaled(F.col("n_chars") % 100, F.col("doc_id") % 7).alias("score"))
