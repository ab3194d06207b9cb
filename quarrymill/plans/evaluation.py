"""Queries: hygiene and splits, evaluation, gates and monitors; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymill.functions import grades, stats, text
from quarrymill.operators import evaluation as ev
from quarrymill.operators import hygiene as hy
from quarrymill.operators import relational as op

from .projections import CLASSIFICATIONS, CORRECTIONS, GOLD, PRED, USAGE, classifications, corrections, gold, predictions, read, usage
from .relational import KEY_SQL, ORDER_SQL, WHITE_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df, *columns: str, places: int = 9):
    return df.withColumns({c: F.round(c, places) for c in columns})


_T, _P = ORDER_SQL.format("label"), ORDER_SQL.format("pred")
_KEY = KEY_SQL.format("text")


@query(f"WITH k AS (SELECT doc_id, row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id) AS rn FROM documents) SELECT doc_id, rn = 1 AS is_first FROM k")
def ded01_exact_dedup(spark, d):
    """DED-01: the first of each text key stays."""
    t = read(spark, d, "documents").select("doc_id", text.text_key("text").alias("k"))
    return hy.first_of_key(t, F.col("k"), "doc_id").select("doc_id", "is_first")


@query(f"SELECT count(*) FILTER (WHERE leaked) AS n_leaked, count(*) FILTER (WHERE NOT leaked) AS n_kept FROM (SELECT {_KEY} IN (SELECT {_KEY} FROM documents WHERE source = 'src0') AS leaked FROM documents WHERE source <> 'src0')")
def ded02_leak_drop(spark, d):
    """DED-02."""
    t = read(spark, d, "documents").select("source", text.text_key("text").alias("k"))
    known = t.where("source = 'src0'").select("k").distinct().withColumn("leaked", F.lit(True))
    return t.where("source <> 'src0'").join(known, "k", "left").agg(F.count_if(F.col("leaked")).alias("n_leaked"), F.count_if(F.col("leaked").isNull()).alias("n_kept"))


@query(f"""SELECT count(DISTINCT substr(regexp_replace(text, '{WHITE_SQL}', '', 'g'), 1, 100)) AS keys_100, count(DISTINCT substr(regexp_replace(text, '{WHITE_SQL}', '', 'g'), 1, 300)) AS keys_300 FROM documents""")
def ded03_prefix_keys(spark, d):
    """DED-03: keys of the first 100 and 300 characters without white space (the reference's own near-copy keys)."""
    bare = F.regexp_replace("text", text.WHITE, "")
    return read(spark, d, "documents").agg(F.countDistinct(F.substring(bare, 1, 100)).alias("keys_100"), F.countDistinct(F.substring(bare, 1, 300)).alias("keys_300"))


_STRATA = f"""SELECT key, label, row_number() OVER (PARTITION BY label ORDER BY key) AS rn, count(*) OVER (PARTITION BY label) AS n FROM (SELECT {_KEY} AS key, min(label) AS label FROM ({GOLD}) GROUP BY 1)"""


@query(f"SELECT key, label, rn <= round_even(n * 0.2::DOUBLE, 0) AS held FROM ({_STRATA})")
def spl01_stratified_holdout(spark, d):
    """SPL-01."""
    return hy.stratified_holdout(gold(spark, d).select(text.text_key("text").alias("key"), "label"), "key", "label", 0.2)


@query(f"SELECT key, label, rn <= CASE WHEN n < 2 THEN 0 ELSE greatest(1, round_even(n * 0.25::DOUBLE, 0)) END AS held FROM ({_STRATA})")
def spl02_hash_split(spark, d):
    """SPL-02, MSC-08."""
    return hy.stratified_holdout(gold(spark, d).select(text.text_key("text").alias("key"), "label"), "key", "label", 0.25, at_least_one=True)


@query(f"""SELECT doc_id, label, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.85::DOUBLE) THEN 'dev' ELSE 'test' END AS split
FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id::VARCHAR), doc_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM ({GOLD}))""")
def spl03_three_way(spark, d):
    """SPL-03, MSC-07: hash order in place of a seeded shuffle."""
    return hy.three_way(gold(spark, d).select("doc_id", "label"), "doc_id", "label")


@query(f"""WITH h AS (SELECT {_KEY} AS key FROM documents WHERE source = 'src3'), t AS (SELECT doc_id, label, {_KEY} AS key FROM ({GOLD}) WHERE source <> 'src3')
SELECT doc_id, copy FROM t, unnest(CASE WHEN label = 'TS' THEN [1, 2, 3] ELSE [1] END) AS u(copy) WHERE key NOT IN (SELECT key FROM h)""")
def spl04_train_build(spark, d):
    """SPL-04: training rows without holdout texts, rare ones three times."""
    h = read(spark, d, "documents").where("source = 'src3'").select(text.text_key("text").alias("key"))
    t = gold(spark, d).where("source <> 'src3'").withColumn("key", text.text_key("text")).join(h.distinct(), "key", "left_anti")
    return t.select("doc_id", F.explode(F.when(F.col("label") == "TS", F.sequence(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1)))).alias("copy"))


@query(f"SELECT bool_and(n >= 5) AS ready, min(n) AS smallest FROM (SELECT g.grade, count(label) AS n FROM (SELECT unnest(['TS', 'S1', 'S2', 'S3']) AS grade) g LEFT JOIN ({GOLD}) ON label = g.grade GROUP BY g.grade)")
def spl06_eval_readiness(spark, d):
    """SPL-06: five rows of every grade, also of those without any."""
    g = spark.createDataFrame([(x,) for x in grades.GRADES], "label string")
    n = gold(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    return g.join(n, "label", "left").agg(F.bool_and(F.coalesce("n", F.lit(0)) >= 5).alias("ready"), F.min(F.coalesce("n", F.lit(0))).alias("smallest"))


@query(f"""WITH h AS (SELECT DISTINCT {_KEY} AS key FROM documents WHERE source = 'src3'), c AS (SELECT doc_id, label, confidence, {_KEY} AS key FROM ({PRED}) WHERE source <> 'src3'),
r AS (SELECT c.doc_id, CASE WHEN confidence < 0.3 THEN 'not_gold' WHEN doc_id <> min(CASE WHEN confidence >= 0.3 THEN doc_id END) OVER (PARTITION BY c.key) THEN 'duplicate' WHEN h.key IS NOT NULL THEN 'leaked' ELSE 'promoted' END AS reason FROM c LEFT JOIN h ON c.key = h.key)
SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def spl07_promotion(spark, d):
    """SPL-07: the first reason that keeps a candidate out; counters by reason."""
    h = read(spark, d, "documents").where("source = 'src3'").select(text.text_key("text").alias("key")).distinct().withColumn("leaked", F.lit(True))
    c = predictions(spark, d).where("source <> 'src3'").withColumn("key", text.text_key("text"))
    first = c.where("confidence >= 0.3").groupBy("key").agg(F.min("doc_id").alias("first_id"))
    r = c.join(first, "key", "left").join(h, "key", "left")
    reason = F.when(F.col("confidence") < 0.3, "not_gold").when(F.col("doc_id") != F.col("first_id"), "duplicate").when(F.col("leaked"), "leaked").otherwise("promoted")
    return r.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"""SELECT classification_id AS doc_id, CAST(corrected_at AS DATE) AS day, min(corrected_level) AS level, count(DISTINCT corrected_by) AS reviewers FROM ({CORRECTIONS}) GROUP BY 1, 2 HAVING count(DISTINCT corrected_level) = 1 AND count(DISTINCT corrected_by) >= 2""")
def spl08_signoff_promotion(spark, d):
    """SPL-08: one grade, signed by enough people on a day."""
    k = corrections(spark, d).groupBy(F.col("classification_id").alias("doc_id"), F.col("corrected_at").cast("date").alias("day"))
    return k.agg(F.min("corrected_level").alias("level"), F.countDistinct("corrected_by").alias("reviewers"), F.countDistinct("corrected_level").alias("_l")).where("_l = 1 and reviewers >= 2").drop("_l")


_LATEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY classification_id ORDER BY corrected_at DESC, correction_id DESC) AS rn FROM ({CORRECTIONS}) WHERE NOT consumed) WHERE rn = 1"


@query(f"""WITH n AS (SELECT classification_id, count(*) AS n_consumed FROM ({CORRECTIONS}) WHERE NOT consumed GROUP BY 1)
SELECT d.doc_id, k.corrected_level AS level, n.n_consumed FROM ({_LATEST}) k JOIN n ON k.classification_id = n.classification_id JOIN documents d ON d.doc_id = k.classification_id WHERE length(trim(d.text)) >= 10""")
def spl09_corrections_to_rows(spark, d):
    """SPL-09, STR-11: the latest open correction of each document with enough text; all its corrections are consumed."""
    k = corrections(spark, d).where(~F.col("consumed"))
    rows = k.groupBy("classification_id").agg(F.max_by("corrected_level", F.struct("corrected_at", "correction_id")).alias("level"), F.count("*").alias("n_consumed"))
    docs = read(spark, d, "documents").where(F.length(F.trim("text")) >= 10).select("doc_id")
    return rows.join(docs, rows["classification_id"] == docs["doc_id"]).select("doc_id", "level", "n_consumed")


@query(f"""WITH k AS (SELECT classification_id, corrected_level, row_number() OVER (PARTITION BY corrected_level ORDER BY corrected_at, correction_id) AS rn FROM ({_LATEST}))
SELECT classification_id, corrected_level FROM k WHERE rn <= 20 AND classification_id NOT IN (SELECT item_id FROM benchmark)""")
def spl10_merge_with_cap(spark, d):
    """SPL-10, WIN-07: twenty corrections a level in their order (the operator's cap), then without holdout ids and without documents whose lower-case, space-collapsed text is a holdout passage; the SQL compares ids only."""
    k = op.latest(corrections(spark, d).where(~F.col("consumed")), "classification_id", "corrected_at", "correction_id")
    capped = op.top_per_key(k, ["corrected_level"], [F.col("corrected_at"), F.col("correction_id")], 20)
    held = read(spark, d, "benchmark").select(F.col("item_id").alias("classification_id"))
    key = F.lower(F.trim(F.regexp_replace("text", r"(?U)[\s\x1C-\x1F]+", " "))).alias("key")
    passages = read(spark, d, "benchmark").select(key)
    mine = F.broadcast(capped.select(F.col("classification_id").alias("doc_id")))
    copies = read(spark, d, "documents").join(mine, "doc_id", "left_semi").select(F.col("doc_id").alias("classification_id"), key).join(passages, "key", "left_semi").select("classification_id")
    return capped.join(held.union(copies), "classification_id", "left_anti").select("classification_id", "corrected_level")


@query(f"""WITH c AS (SELECT source, label, count(*) AS n FROM ({GOLD}) GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY source) AS g, max(n) OVER (PARTITION BY source) AS top, sum(n) OVER () AS t FROM c),
l AS (SELECT sum(-(p) * log2(p)) AS h FROM (SELECT sum(n) / max(t)::DOUBLE AS p FROM s GROUP BY label)), x AS (SELECT sum(n * -log2(n / g::DOUBLE)) / max(t) AS cond, CAST(coalesce(sum(n) FILTER (WHERE n = g), 0) AS BIGINT) AS pure_rows FROM s),
m AS (SELECT sum(b) / max(t)::DOUBLE AS majority FROM (SELECT max(n) AS b, max(t) AS t FROM s GROUP BY source))
SELECT round(h, 9) AS entropy, round(cond, 9) AS conditional, round((h - cond) / h, 9) AS theils_u, round(majority, 9) AS majority, pure_rows FROM l, x, m""")
def spl11_domain_leakage(spark, d):
    """SPL-11."""
    return rounded(hy.leakage_of(gold(spark, d), "source", "label"), "entropy", "conditional", "theils_u", "majority")


@query(f"SELECT doc_id, CASE WHEN contains(text, 'License') THEN 'S3' ELSE label END AS label FROM ({GOLD})")
def spl12_relabel(spark, d):
    """SPL-12, MSC-01."""
    return gold(spark, d).select("doc_id", F.when(F.contains("text", F.lit("License")), "S3").otherwise(F.col("label")).alias("label"))


_CELLS = f"SELECT g.truth, g.pred, count(p.doc_id) AS n FROM (SELECT a.x AS truth, b.x AS pred FROM (SELECT unnest(['TS', 'S1', 'S2', 'S3']) AS x) a, (SELECT unnest(['TS', 'S1', 'S2', 'S3']) AS x) b) g LEFT JOIN ({PRED}) p ON p.label = g.truth AND p.pred = g.pred GROUP BY 1, 2"
_CT, _CP = ORDER_SQL.format("truth"), ORDER_SQL.format("pred")


@query(_CELLS)
def evl01_confusion(spark, d):
    """EVL-01: all sixteen cells."""
    return ev.confusion(predictions(spark, d))


@query(f"""WITH c AS (SELECT *, sum(n) OVER (PARTITION BY truth) AS t, {_CP} - {_CT} AS gap FROM ({_CELLS}))
SELECT truth, pred, n, round(CASE WHEN t = 0 THEN 0.0::DOUBLE ELSE n / t::DOUBLE END, 9) AS rate, CASE WHEN gap >= 3 THEN 'critical' WHEN gap = 2 THEN 'high' ELSE 'medium' END AS severity,
CASE WHEN gap >= 2 THEN n >= 1 ELSE n >= 1 AND CASE WHEN t = 0 THEN 0 ELSE n / t::DOUBLE END >= 0.05 END AS fired FROM c WHERE gap > 0""")
def evl02_alarms(spark, d):
    """EVL-02, SRT-03."""
    return rounded(ev.alarms(ev.confusion(predictions(spark, d))), "rate")


_CLASSES = f"""SELECT g AS grade, CAST(sum(n) FILTER (WHERE truth = g) AS BIGINT) AS support, CAST(sum(n) FILTER (WHERE pred = g) AS BIGINT) AS predicted, CAST(sum(n) FILTER (WHERE truth = g AND pred = g) AS BIGINT) AS tp,
CAST(coalesce(sum(n) FILTER (WHERE truth = g AND {_CP} > {_CT}), 0) AS BIGINT) AS under FROM (SELECT unnest(['TS', 'S1', 'S2', 'S3']) AS g), ({_CELLS}) GROUP BY g"""
_DIV = "CASE WHEN {1} = 0 THEN 0.0::DOUBLE ELSE {0}::DOUBLE / {1} END"
_PRF = f"SELECT *, {_DIV.format('tp', 'predicted')} AS p, {_DIV.format('tp', 'support')} AS r, {_DIV.format('under', 'support')} AS f FROM ({_CLASSES})"


@query(f"SELECT grade, support, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS f1, round(f, 9) AS fnr, tp, under FROM ({_PRF})")
def evl03_per_class(spark, d):
    """EVL-03, EVL-04."""
    return rounded(ev.per_class(ev.confusion(predictions(spark, d))), "precision", "recall", "f1", "fnr")


@query(f"""SELECT round(sum(tp) / sum(support)::DOUBLE, 9) AS accuracy, round(avg(p), 9) AS macro_precision, round(avg(r), 9) AS macro_recall, round(avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END), 9) AS macro_f1,
round(avg(f) FILTER (WHERE grade IN ('TS', 'S1')), 9) AS high_fnr FROM ({_PRF})""")
def evl03_overall(spark, d):
    """EVL-03."""
    return rounded(ev.overall(ev.per_class(ev.confusion(predictions(spark, d)))), "accuracy", "macro_precision", "macro_recall", "macro_f1", "high_fnr")


@query(f"""SELECT round({_DIV.format("count(*) FILTER (WHERE label IN ('TS', 'S1') AND pred NOT IN ('TS', 'S1'))", "count(*) FILTER (WHERE label IN ('TS', 'S1'))")}, 9) AS high_fnr,
count(*) FILTER (WHERE label IN ('TS', 'S1') AND pred = 'S3') AS high_to_lowest, count(*) FILTER (WHERE label = 'S3' AND pred <> 'S3') AS over_lowest, round(count(*) FILTER (WHERE confidence < 0.7) / count(*)::DOUBLE, 9) AS review_burden FROM ({PRED})""")
def evl05_high_risk(spark, d):
    """EVL-05, MSC-05, MSC-09."""
    high = grades.is_high("label")
    return rounded(predictions(spark, d).agg(stats.ratio(F.count_if(high & ~grades.is_high("pred")), F.count_if(high)).alias("high_fnr"), F.count_if(high & (F.col("pred") == "S3")).alias("high_to_lowest"), F.count_if((F.col("label") == "S3") & (F.col("pred") != "S3")).alias("over_lowest"), stats.ratio(F.count_if(F.col("confidence") < 0.7), F.count("*")).alias("review_burden")), "high_fnr", "review_burden")


_TAUS = [k / 20 for k in range(2, 19)]


@query(f"""WITH s AS (SELECT tau, label IN ('TS', 'S1') AS t, confidence >= tau AS p FROM ({PRED}), (SELECT unnest({_TAUS})::DOUBLE AS tau)),
x AS (SELECT tau, count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn FROM s GROUP BY tau),
y AS (SELECT tau, {_DIV.format('fn', '(tp + fn)')} AS fnr, {_DIV.format('2.0::DOUBLE * tp', '(2 * tp + fp + fn)')} AS f1 FROM x)
SELECT tau, round(fnr, 9) AS fnr, round(f1, 9) AS f1, coalesce(tau = (SELECT tau FROM y WHERE fnr <= 0.5 ORDER BY f1 DESC, tau LIMIT 1), FALSE) AS recommended FROM y""")
def evl06_threshold_sweep(spark, d):
    """EVL-06: a sweep over a fixed list of thresholds, and the best F1 whose miss rate is within the target."""
    s = predictions(spark, d).select(grades.is_high("label").alias("t"), "confidence", F.explode(F.array(*[F.lit(x) for x in _TAUS])).alias("tau")).withColumn("p", F.col("confidence") >= F.col("tau"))
    x = s.groupBy("tau").agg(F.count_if(F.col("t") & F.col("p")).alias("tp"), F.count_if(~F.col("t") & F.col("p")).alias("fp"), F.count_if(F.col("t") & ~F.col("p")).alias("fn"))
    y = x.select("tau", stats.ratio(F.col("fn"), F.col("tp") + F.col("fn")).alias("fnr"), stats.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))
    best = F.max_by(F.when(F.col("fnr") <= 0.5, F.col("tau")), F.when(F.col("fnr") <= 0.5, F.struct(F.col("f1"), -F.col("tau")))).over(Window.partitionBy())
    return rounded(y.select("tau", "fnr", "f1", F.coalesce(F.col("tau") == best, F.lit(False)).alias("recommended")), "fnr", "f1")


_LOW, _HIGH = stats.wilson_sql("under", "n")
_CARDS = f"SELECT source AS slice, label AS truth, count(*) AS n, count(*) FILTER (WHERE {_P} > {_T}) AS under, count(*) FILTER (WHERE {_P} = {_T}) AS correct FROM ({PRED}) GROUP BY 1, 2"


@query(f"""SELECT slice, truth, n, under, correct, round(low, 9) AS low, round(high, 9) AS high, CASE WHEN truth = 'S3' THEN 'N/A' WHEN n < 30 OR high - low > 0.30 THEN 'INCONCLUSIVE' WHEN high <= 0.05 THEN 'PASS' WHEN low > 0.05 THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS verdict
FROM (SELECT *, {_LOW} AS low, {_HIGH} AS high FROM ({_CARDS}))""")
def evl08_eval_cards(spark, d):
    """EVL-07, EVL-08."""
    return rounded(ev.cards(predictions(spark, d), "source"), "low", "high")


_BIN = " + ".join(f"(confidence >= {k}/10.0::DOUBLE)::INT" for k in range(1, 10))
_REL = f"SELECT {_BIN} AS bin, count(*) AS n, round_even(avg(confidence), 4) AS mean_confidence, round_even(avg((label = pred)::INT), 4) AS accuracy FROM ({PRED}) WHERE confidence BETWEEN 0 AND 1 GROUP BY 1"


@query(_REL)
def evl09_reliability(spark, d):
    """EVL-09: reliability bins."""
    return ev.reliability(predictions(spark, d), "confidence", F.col("label") == F.col("pred"))


@query(f"WITH b AS (SELECT round(avg(power(confidence - (label = pred)::INT, 2)), 9) AS brier FROM ({PRED})) SELECT round(sum(n * abs(accuracy - mean_confidence)) / sum(n), 9) AS ece, any_value(brier) AS brier FROM ({_REL}), b")
def evl09_calibration(spark, d):
    """EVL-09: expected calibration error over the rounded bins, and the Brier score."""
    p = predictions(spark, d)
    hit = (F.col("label") == F.col("pred")).cast("double")
    e = ev.calibration_error(ev.reliability(p, "confidence", F.col("label") == F.col("pred")))
    return rounded(e.crossJoin(p.agg(F.avg(F.pow(F.col("confidence") - hit, F.lit(2.0))).alias("brier"))), "ece", "brier")


@query()
def evl10_bootstrap(spark, d):
    """EVL-10: percentile bootstrap of accuracy; resampled by hash, so no SQL twin."""
    p = predictions(spark, d).select(F.col("doc_id").alias("id"), (F.col("label") == F.col("pred")).alias("hit"))
    return ev.bootstrap_interval(p, F.col("hit"))


_STRATA_J = f"SELECT unnest(['overall', 'source:' || source, 'domain:' || domain]) AS stratum, {_T} AS t, {_P} AS p FROM ({PRED})"
_LOW_J, _HIGH_J = stats.wilson_sql("agreed", "n")


@query(f"""SELECT stratum, n, round(agreed / n::DOUBLE, 9) AS agreement, round(down / n::DOUBLE, 9) AS down_rate, round(up / n::DOUBLE, 9) AS up_rate, round({_LOW_J}, 9) AS low, round({_HIGH_J}, 9) AS high,
CASE WHEN n < 10 THEN 'low_n' WHEN down / n::DOUBLE >= 0.5 OR up / n::DOUBLE >= 0.5 THEN 'systematic' WHEN agreed / n::DOUBLE < 0.5 THEN 'disagreement' ELSE 'ok' END AS flag
FROM (SELECT stratum, count(*) AS n, count(*) FILTER (WHERE t = p) AS agreed, count(*) FILTER (WHERE p > t) AS down, count(*) FILTER (WHERE p < t) AS up FROM ({_STRATA_J}) GROUP BY stratum)""")
def evl11_judge_reliability(spark, d):
    """EVL-11: agreement overall, by source and by domain, in one pass."""
    t, p = grades.order("label"), grades.order("pred")
    s = predictions(spark, d).select(F.explode(F.array(F.lit("overall"), F.concat(F.lit("source:"), "source"), F.concat(F.lit("domain:"), "domain"))).alias("stratum"), t.alias("t"), p.alias("p"))
    n = s.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if(F.col("t") == F.col("p")).alias("a"), F.count_if(F.col("p") > F.col("t")).alias("dn"), F.count_if(F.col("p") < F.col("t")).alias("up"))
    low, high = stats.wilson(F.col("a"), F.col("n"))
    r = {k: stats.ratio(F.col(c), F.col("n")) for k, c in (("agreement", "a"), ("down_rate", "dn"), ("up_rate", "up"))}
    flag = F.when(F.col("n") < 10, "low_n").when((r["down_rate"] >= 0.5) | (r["up_rate"] >= 0.5), "systematic").when(r["agreement"] < 0.5, "disagreement").otherwise("ok")
    return rounded(n.select("stratum", "n", *[v.alias(k) for k, v in r.items()], low.alias("low"), high.alias("high"), flag.alias("flag")), "agreement", "down_rate", "up_rate", "low", "high")


@query(f"""WITH k AS ({CORRECTIONS}), f AS (SELECT classification_id, corrected_level AS final FROM (SELECT *, row_number() OVER (PARTITION BY classification_id ORDER BY corrected_at DESC, correction_id DESC) AS rn FROM k) WHERE rn = 1),
x AS (SELECT k.*, f.final, EXISTS (SELECT 1 FROM k o WHERE o.classification_id = k.classification_id AND o.corrected_level = f.final AND o.corrected_by <> k.corrected_by) AS comparable FROM k JOIN f ON k.classification_id = f.classification_id)
SELECT corrected_by AS reviewer, count(*) AS total, count(*) FILTER (WHERE comparable) AS comparable, count(*) FILTER (WHERE comparable AND corrected_level = final) AS agreed, count(*) FILTER (WHERE comparable AND corrected_level <> final) AS overturned,
round_even(count(*) FILTER (WHERE comparable AND corrected_level = final) / count(*) FILTER (WHERE comparable)::DOUBLE, 4) AS reliability FROM x GROUP BY corrected_by HAVING count(*) FILTER (WHERE comparable) >= 1""")
def evl12_reviewer_reliability(spark, d):
    """EVL-12, SRT-05."""
    k = corrections(spark, d).select(F.col("classification_id").alias("item"), F.col("corrected_at").alias("at"), F.col("correction_id").alias("tie"), F.col("corrected_level").alias("level"), F.col("corrected_by").alias("reviewer"))
    return ev.reviewer_reliability(k)


_PAIRS = f"SELECT domain, source, {_T} AS a, {_P} AS b FROM ({PRED})"
_LOW_M, _HIGH_M = stats.wilson_sql("forward", "n")


@query(f"""SELECT domain, n, forward, reverse, round({_LOW_M}, 9) AS low, round({_HIGH_M}, 9) AS high, round(reverse / n::DOUBLE, 9) AS reverse_rate
FROM (SELECT domain, count(*) AS n, count(*) FILTER (WHERE b > a) AS forward, count(*) FILTER (WHERE b < a) AS reverse FROM ({_PAIRS}) GROUP BY domain)""")
def evl13_metamorphic(spark, d):
    """EVL-13, EVL-14: violations of an invariance in either direction."""
    a, b = grades.order("label"), grades.order("pred")
    n = predictions(spark, d).groupBy("domain").agg(F.count("*").alias("n"), F.count_if(b > a).alias("forward"), F.count_if(b < a).alias("reverse"))
    low, high = stats.wilson(F.col("forward"), F.col("n"))
    return rounded(n.withColumn("low", low).withColumn("high", high).withColumn("reverse_rate", stats.ratio(F.col("reverse"), F.col("n"))), "low", "high", "reverse_rate")


@query(f"SELECT source, round(avg((CASE WHEN confidence < 0.05 THEN 'S3' ELSE pred END = label)::INT), 9) AS accuracy, count(*) FILTER (WHERE confidence < 0.05) AS failed FROM ({PRED}) GROUP BY source")
def evl15_serving(spark, d):
    """EVL-15, EVL-16: a failed prediction counts as the least secret grade; accuracy by source."""
    served = F.coalesce(F.when(F.col("confidence") >= 0.05, F.col("pred")), F.lit("S3"))
    return rounded(predictions(spark, d).groupBy("source").agg(F.avg((served == F.col("label")).cast("double")).alias("accuracy"), F.count_if(F.col("confidence") < 0.05).alias("failed")), "accuracy")


@query(f"""SELECT CASE WHEN source IN ('src1', 'src2') THEN 'legal' WHEN source IN ('src3', 'src4') THEN 'llm_judge' ELSE 'other' END AS trust, count(*) AS n, round(avg((label = pred)::INT), 9) AS agreement, round(avg(confidence), 9) AS confidence FROM ({PRED}) GROUP BY 1""")
def evl17_trust_tiers(spark, d):
    """EVL-17."""
    trust = F.when(F.col("source").isin("src1", "src2"), "legal").when(F.col("source").isin("src3", "src4"), "llm_judge").otherwise("other")
    return rounded(predictions(spark, d).groupBy(trust.alias("trust")).agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("pred")).cast("double")).alias("agreement"), F.avg("confidence").alias("confidence")), "agreement", "confidence")


_GATE = f"""WITH c AS (SELECT doc_id % 3 AS part, label, pred FROM ({PRED})), g AS (SELECT part, grade FROM (SELECT DISTINCT part FROM c), (SELECT unnest(['TS', 'S1', 'S2', 'S3']) AS grade)),
k AS (SELECT g.part, g.grade, count(*) FILTER (WHERE label = g.grade) AS support, count(*) FILTER (WHERE pred = g.grade) AS predicted, count(*) FILTER (WHERE label = g.grade AND pred = g.grade) AS tp, count(*) FILTER (WHERE label = g.grade AND {ORDER_SQL.format('pred')} > {ORDER_SQL.format('label')}) AS under FROM g JOIN c ON g.part = c.part GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN support = 0 THEN 0 ELSE under / support::DOUBLE END AS fnr, CASE WHEN predicted + support = 0 OR tp = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (predicted + support) END AS f1 FROM k),
m AS (SELECT part, avg(fnr) FILTER (WHERE grade IN ('TS', 'S1')) AS fnr, avg(f1) AS f1, max(predicted) / sum(predicted)::DOUBLE AS top, sum(support) AS n FROM f GROUP BY part)"""


def _parts(spark, d):
    """The high grades' miss rate, f1 and commonest prediction of three parts of the predictions, as three models' measurements."""
    p = predictions(spark, d).withColumn("part", F.col("doc_id") % 3)
    t, q = grades.order("label"), grades.order("pred")
    g = p.select("part", t.alias("t"), q.alias("q"), F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4)])).alias("g")).groupBy("part", "g").agg(F.count_if(F.col("t") == F.col("g")).alias("support"), F.count_if(F.col("q") == F.col("g")).alias("predicted"), F.count_if((F.col("t") == F.col("g")) & (F.col("q") == F.col("g"))).alias("tp"), F.count_if((F.col("t") == F.col("g")) & (F.col("q") > F.col("t"))).alias("under"))
    f1 = stats.ratio(2.0 * F.col("tp"), F.col("predicted") + F.col("support"))
    return g.groupBy("part").agg(F.avg(F.when(F.col("g") <= 2, stats.ratio(F.col("under"), F.col("support")))).alias("fnr"), F.avg(f1).alias("f1"), stats.ratio(F.max("predicted"), F.sum("predicted")).alias("top"), F.sum("support").alias("n"))


@query(_GATE + """, x AS (SELECT m.part, m.fnr, m.f1, m.top, b.fnr AS bfnr, b.f1 AS bf1 FROM m LEFT JOIN m b ON b.part = m.part - 1)
SELECT part, round(fnr, 9) AS fnr, round(f1, 9) AS f1, array_to_string(list_filter([CASE WHEN top >= 0.99 THEN 'degenerate' END, CASE WHEN fnr IS NULL THEN 'fnr_high_present' END, CASE WHEN fnr > bfnr + 0.02 THEN 'fnr_high_regression' END, CASE WHEN f1 < bf1 - 0.05 THEN 'f1_regression' END, CASE WHEN bfnr IS NULL AND fnr > 0.1 THEN 'first_deploy_fnr_floor' END, CASE WHEN part = 2 THEN 'anchor_high_grade_miss' END], lambda v: v IS NOT NULL), ',') AS failed FROM x""")
def gat01_deploy_gate(spark, d):
    """GAT-01: each part against the one before it as its base; the first has none, the last fails on its anchor rows."""
    m = _parts(spark, d)
    base = m.select((F.col("part") + 1).alias("part"), F.col("fnr").alias("bfnr"), F.col("f1").alias("bf1"))
    g = ev.deploy_gate(F.col("fnr"), F.col("f1"), F.col("top"), F.col("bfnr"), F.col("bf1"), F.when(F.col("part") == 2, 1).otherwise(0), first_high_fnr=0.1)
    return rounded(m.join(base, "part", "left").select("part", "fnr", "f1", F.array_join(g["failed"], ",").alias("failed")), "fnr", "f1")


@query(_GATE + """ SELECT part, CASE WHEN part = 0 THEN 'no_baseline' WHEN n < 20 THEN 'insufficient_live_data' WHEN fnr > 0.2 / part + 0.1 THEN 'regressed' ELSE 'within_tolerance' END AS reason, part <> 0 AND n >= 20 AND fnr > 0.2 / part + 0.1 AS rollback FROM m""")
def gat02_rollback_need(spark, d):
    """GAT-02: live miss rates of the high grades against those at registration; the first part has none."""
    base = F.when(F.col("part") > 0, F.lit(0.2) / F.col("part"))
    r = ev.rollback_need(base, F.col("fnr"), F.col("n"))
    return _parts(spark, d).select("part", r.alias("r")).select("part", "r.reason", "r.rollback")


@query(f"""SELECT CAST(date_trunc('day', corrected_at) AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE k.corrected_level <= 2 AND k.corrected_level < c.level) AS missed,
array_to_string(list_filter([CASE WHEN count(*) FILTER (WHERE k.corrected_level <= 2 AND k.corrected_level < c.level) >= 1 THEN 'high_grade_miss' END, CASE WHEN count(*) >= 20 * 1.5 THEN 'fatigue' END, CASE WHEN count(*) FILTER (WHERE k.corrected_level <> c.level) / count(*)::DOUBLE >= 0.30 THEN 'overturn_rate' END], lambda v: v IS NOT NULL), ',') AS reasons
FROM ({CORRECTIONS}) k JOIN ({CLASSIFICATIONS}) c ON k.classification_id = c.classification_id GROUP BY 1""")
def gat04_kill_gate(spark, d):
    """GAT-04: by day, what stops automatic confirmation: missed high grades, more corrections than reviewers can bear, too many overturned."""
    k = corrections(spark, d).join(classifications(spark, d).select("classification_id", "level"), "classification_id")
    missed = F.count_if((F.col("corrected_level") <= 2) & (F.col("corrected_level") < F.col("level")))
    g = k.groupBy(F.date_trunc("day", "corrected_at").cast("date").alias("day")).agg(F.count("*").alias("n"), missed.alias("missed"), F.count_if(F.col("corrected_level") != F.col("level")).alias("turned"))
    gate = ev.kill_gate(F.col("missed"), F.col("n"), stats.ratio(F.col("turned"), F.col("n")), 20)
    return g.select("day", "n", "missed", F.array_join(gate["reasons"], ",").alias("reasons"))


@query()
def msc16_public_false_positives(spark, d):
    """MSC-16: of public documents that no training text equals, the share predicted secret, with its bootstrap interval."""
    p = predictions(spark, d)
    train = p.where("not source in ('src7', 'src12')").select(text.text_key("text").alias("key")).distinct()
    clean = p.where("source in ('src7', 'src12')").withColumn("key", text.text_key("text")).join(train, "key", "left_anti")
    return ev.bootstrap_interval(clean.select(F.col("doc_id").alias("id"), "pred"), (F.col("pred") != "S3"))


@query()
def msc17_high_grade_recall(spark, d):
    """MSC-17: the share of documents of high grades that are predicted to have one, with its bootstrap interval."""
    p = predictions(spark, d).where(grades.is_high("label"))
    return ev.bootstrap_interval(p.select(F.col("doc_id").alias("id"), "pred"), grades.is_high("pred"))


_KPIS = [("latency", "le", 60.0), ("cost", "lt", 12.0), ("success", "ge", 0.85), ("calls", "gt", 100.0), ("missing", "ge", 1.0)]
_KPI_VALUES = ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in _KPIS)


@query(f"""WITH m AS (SELECT provider, unnest(['latency', 'cost', 'success', 'calls']) AS kpi, unnest([avg(latency_ms), avg(cost_usd), avg(success::INT), count(*)::DOUBLE]) AS v FROM ({USAGE}) GROUP BY provider),
k AS (SELECT p.provider, kpi, op, threshold FROM (VALUES {_KPI_VALUES}) t(kpi, op, threshold), (SELECT DISTINCT provider FROM m) p)
SELECT k.provider, k.kpi, round(v, 9) AS measured, CASE WHEN v IS NULL THEN 'SKIP' WHEN (op = 'le' AND v <= threshold) OR (op = 'lt' AND v < threshold) OR (op = 'ge' AND v >= threshold) OR (op = 'gt' AND v > threshold) THEN 'PASS' ELSE 'FAIL' END AS status
FROM k LEFT JOIN m ON k.provider = m.provider AND k.kpi = m.kpi""")
def gat07_kpis(spark, d):
    """GAT-07, AGG-10: measurements against a fixed table of thresholds; SKIP where there is none."""
    u = usage(spark, d).groupBy("provider").agg(F.avg("latency_ms").alias("latency"), F.avg("cost_usd").alias("cost"), F.avg(F.col("success").cast("double")).alias("success"), F.count("*").cast("double").alias("calls"))
    table = F.array(*[F.struct(F.lit(a).alias("kpi"), F.lit(b).alias("op"), F.lit(c).alias("threshold")) for a, b, c in _KPIS])
    rows = u.select("provider", F.create_map(*[x for k in ("latency", "cost", "success", "calls") for x in (F.lit(k), F.col(k))]).alias("m"), F.explode(table).alias("k"))
    v, t, o = F.try_element_at("m", F.col("k.kpi")), F.col("k.threshold"), F.col("k.op")
    met = ((o == "le") & (v <= t)) | ((o == "lt") & (v < t)) | ((o == "ge") & (v >= t)) | ((o == "gt") & (v > t))
    return rounded(rows.select("provider", F.col("k.kpi").alias("kpi"), v.alias("measured"), F.when(v.isNull(), "SKIP").when(met, "PASS").otherwise("FAIL").alias("status")), "measured")


@query(f"""WITH r AS (SELECT provider, CAST(date_trunc('week', called_at) AS DATE) AS run, avg(latency_ms) AS v FROM ({USAGE}) GROUP BY 1, 2), x AS (SELECT *, lag(v) OVER (PARTITION BY provider ORDER BY run) AS before FROM r)
SELECT provider, run, round(v - before, 9) AS delta, coalesce(v > before * 1.2, FALSE) AS regressed, CASE WHEN before IS NULL THEN 'first' WHEN v > before THEN 'worse' WHEN v < before THEN 'better' ELSE 'same' END AS trend FROM x""")
def gat08_regression(spark, d):
    """GAT-08, JN-13, WIN-09: each run against the one before it; a fifth worse is a regression."""
    r = usage(spark, d).groupBy("provider", F.date_trunc("week", "called_at").cast("date").alias("run")).agg(F.avg("latency_ms").alias("v"))
    r = r.withColumn("before", F.lag("v").over(Window.partitionBy("provider").orderBy("run")))
    trend = F.when(F.col("before").isNull(), "first").when(F.col("v") > F.col("before"), "worse").when(F.col("v") < F.col("before"), "better").otherwise("same")
    return r.select("provider", "run", F.round(F.col("v") - F.col("before"), 9).alias("delta"), F.coalesce(F.col("v") > F.col("before") * 1.2, F.lit(False)).alias("regressed"), trend.alias("trend"))


_COS = """SELECT label, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), m) AS c FROM embeddings, (SELECT list(v ORDER BY k) AS m FROM (SELECT k, avg(x) AS v FROM (SELECT unnest(list_transform(embedding, lambda x: x::DOUBLE)) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings WHERE label < 5) GROUP BY k))"""
_HIST = "SELECT b.bin, (SELECT count(*) FROM s WHERE s.bin = b.bin AND label < 5) AS q, (SELECT count(*) FROM s WHERE s.bin = b.bin AND label >= 5) AS p FROM (SELECT unnest(range(20)) AS bin) b"


@query(f"""WITH s AS (SELECT label, CAST(floor((least(0.9999::DOUBLE, greatest(-1.0::DOUBLE, c)) + 1) / 2 * 20) AS INT) AS bin FROM ({_COS})), h AS ({_HIST}), t AS (SELECT sum(p) AS tp, sum(q) AS tq FROM h),
k AS (SELECT greatest(0, sum(greatest(p / tp::DOUBLE, 1e-9) * ln(greatest(p / tp::DOUBLE, 1e-9) / greatest(q / tq::DOUBLE, 1e-9)))) AS kl FROM h, t) SELECT round(kl, 9) AS kl, kl >= 0.5 AS alert FROM k""")
def gat09_drift(spark, d):
    """GAT-09, GAT-10: divergence of two parts' histograms of cosines to the first part's centroid."""
    e = read(spark, d, "embeddings")
    middle = ev.centroid(e.where("label < 5"), "embedding")
    c = e.crossJoin(F.broadcast(middle)).select("label", stats.cosine(F.transform("embedding", lambda x: x.cast("double")), F.col("centroid")).alias("c"))
    return rounded(ev.drift(spark, c.where("label < 5"), c.where("label >= 5"), "c"), "kl")


@query(f"""WITH s AS MATERIALIZED (SELECT label, c FROM ({_COS})), m AS (SELECT unnest([10, 20, 30]) AS m),
b AS (SELECT m, unnest(range(m)) AS bin FROM m), n AS (SELECT m, CAST(floor((least(0.9999::DOUBLE, greatest(-1.0::DOUBLE, c)) + 1) / 2 * m) AS INT) AS bin, count(*) AS n FROM s, m WHERE label < 5 GROUP BY 1, 2),
h AS (SELECT b.m, list(coalesce(n, 0) / (SELECT count(*) FROM s WHERE label < 5)::DOUBLE ORDER BY b.bin) AS h FROM b LEFT JOIN n USING (m, bin) GROUP BY b.m),
e AS (SELECT m, k, coalesce(list_sum(h[1:CAST(floor(k * m / 20.0::DOUBLE) AS INT)]), 0) + (k * m / 20.0::DOUBLE - floor(k * m / 20.0::DOUBLE)) * coalesce(h[CAST(floor(k * m / 20.0::DOUBLE) AS INT) + 1], 0) AS c FROM h, (SELECT unnest(range(21)) AS k)),
p AS (SELECT a.m, b.k - 1 AS bin, greatest(0.0::DOUBLE, b.c - a.c) AS p FROM e a JOIN e b ON a.m = b.m AND b.k = a.k + 1),
q AS (SELECT bin, (SELECT count(*) FROM s WHERE label >= 5 AND CAST(floor((least(0.9999::DOUBLE, greatest(-1.0::DOUBLE, c)) + 1) / 2 * 20) AS INT) = bin) / (SELECT count(*) FROM s WHERE label >= 5)::DOUBLE AS q FROM (SELECT unnest(range(20)) AS bin)),
t AS (SELECT m, sum(p) AS t FROM p GROUP BY m),
k AS (SELECT m, greatest(0.0::DOUBLE, sum(greatest(p / t, 1e-9) * ln(greatest(p / t, 1e-9) / greatest(q, 1e-9)))) AS kl FROM p JOIN t USING (m) JOIN q USING (bin) GROUP BY m UNION ALL SELECT 0, 0.0::DOUBLE),
a AS (SELECT avg(c) AS mean FROM s WHERE label >= 5)
SELECT m AS stored_bins, round(kl, 9) AS kl, round(mean, 9) AS mean, round(1 - mean, 9) AS shift, CASE WHEN m = 0 THEN 'unknown' WHEN kl >= 0.5 OR abs(1 - mean) >= 0.9 THEN 'alert' ELSE 'ok' END AS status, CASE WHEN m = 0 THEN abs(1 - mean) >= 0.9 ELSE kl >= 0.5 OR abs(1 - mean) >= 0.9 END AS alert FROM k, a""")
def gat10_stored_drift(spark, d):
    """GAT-10: drift from a stored histogram of 10, 20 or 30 bins, or of none, against one of 20 bins, and the shift of the mean cosine."""
    e = read(spark, d, "embeddings")
    middle = ev.centroid(e.where("label < 5"), "embedding")
    c = e.crossJoin(F.broadcast(middle)).select("label", stats.cosine(F.transform("embedding", lambda x: x.cast("double")), F.col("centroid")).alias("c"))
    train = c.where("label < 5")
    stored = None
    for bins in (10, 20, 30):
        part = ev.shares(train, [], "c", bins).select(F.lit(bins).alias("stored_bins"), "histogram")
        stored = part if stored is None else stored.unionByName(part)
    stored = stored.unionByName(spark.range(1).select(F.lit(0).alias("stored_bins"), F.array().cast("array<double>").alias("histogram")))
    out = ev.stored_drift(stored, c.where("label >= 5"), "c", 20, 0.5, 0.9)
    return rounded(out.select("stored_bins", "kl", "mean", "shift", "status", "alert"), "kl", "mean", "shift")


@query(f"""WITH c AS (SELECT source AS part, unnest(['rows', 'agreement', 'parity']) AS name, unnest([CASE WHEN count(*) >= 10 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN avg((label = pred)::INT) >= 0.6 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN source LIKE '%3' THEN 'BLOCKED' ELSE 'PASS' END]) AS status FROM ({PRED}) GROUP BY source)
SELECT part, CASE WHEN count(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE status = 'BLOCKED') > 0 THEN 'CONDITIONALLY_READY' ELSE 'PASS' END AS verdict, count(*) FILTER (WHERE status <> 'PASS') = 0 AS released, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE status <> 'PASS'), '') AS open FROM c GROUP BY part""")
def gat06_readiness(spark, d):
    """GAT-06: checks of each source rolled up to a verdict, and whether it is released."""
    g = predictions(spark, d).groupBy(F.col("source").alias("part")).agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("pred")).cast("double")).alias("a"))
    status = (("rows", F.when(F.col("n") >= 10, "PASS").otherwise("FAIL")), ("agreement", F.when(F.col("a") >= 0.6, "PASS").otherwise("FAIL")), ("parity", F.when(F.col("part").endswith("3"), "BLOCKED").otherwise("PASS")))
    checks = g.select("part", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), s.alias("status")) for n, s in status])).alias("c")).select("part", "c.*")
    return ev.readiness(checks, "part").withColumn("open", F.array_join("open", ","))


@query("""WITH a AS (SELECT event_id, ts, user_id, md5(event_id::VARCHAR) AS own, substr(lag(md5(event_id::VARCHAR)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 1, 16) AS before FROM events)
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE CASE WHEN event_id % 97 = 0 THEN 'broken' ELSE before END <> before) AS breaks FROM a GROUP BY user_id""")
def gat13_audit_chain(spark, d):
    """GAT-13, WIN-08: links of hash chains, one chain a user: each row names the first sixteen digits of the hash before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    a = read(spark, d, "events").select("user_id", "ts", "event_id", F.md5(F.col("event_id").cast("string")).alias("own"))
    a = a.withColumn("told", F.when(F.col("event_id") % 97 == 0, "broken").otherwise(F.substring(F.lag("own").over(w), 1, 16)))
    seen = F.substring(F.last("own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), 1, 16)
    return a.withColumn("bad", F.coalesce(F.col("told") != seen, F.lit(False))).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("bad")).alias("breaks"))


@query("SELECT doc_id, CASE WHEN m >= 4 AND pred = 'S3' THEN 'AUTO-CONFIRM' WHEN m >= 2 THEN 'QUICK-CHECK' ELSE 'REVIEW' END AS queue, CASE WHEN m >= 2 THEN 'S3' WHEN " + _T + " <= " + _P + f" THEN label ELSE pred END AS proposed FROM (SELECT *, contains(text, ' the ')::INT + contains(text, ' and ')::INT + contains(text, ' of ')::INT + contains(text, ' que ')::INT AS m FROM ({PRED}))")
def msc03_triage(spark, d):
    """MSC-03, MSC-04."""
    m = sum((F.contains("text", F.lit(x)).cast("int") for x in (" the ", " and ", " of ", " que ")), F.lit(0))
    return predictions(spark, d).withColumn("m", m).select("doc_id", F.when((F.col("m") >= 4) & (F.col("pred") == "S3"), "AUTO-CONFIRM").when(F.col("m") >= 2, "QUICK-CHECK").otherwise("REVIEW").alias("queue"), F.when(F.col("m") >= 2, "S3").otherwise(grades.more_secret(F.col("label"), F.col("pred"))).alias("proposed"))


@query(f"""WITH p AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS rn FROM ({GOLD})) SELECT doc_id, label, CAST(row_number() OVER (ORDER BY rn, label) AS INT) AS seq FROM p WHERE rn <= 30 ORDER BY rn, label LIMIT 60""")
def msc06_round_robin(spark, d):
    """MSC-06: sixty rows in turn from the grades, thirty of a grade at most (a sampling operator)."""
    return hy.round_robin(gold(spark, d).select("doc_id", "label"), "label", "doc_id", 30, 60)


@query(f"SELECT provider, purpose, round(avg(cost_usd), 9) AS mean, round(coalesce(stddev_samp(cost_usd), 0), 9) AS sd FROM ({USAGE}) GROUP BY 1, 2")
def msc10_arms(spark, d):
    """MSC-10."""
    return rounded(usage(spark, d).groupBy("provider", "purpose").agg(F.avg("cost_usd").alias("mean"), F.coalesce(F.stddev_samp("cost_usd"), F.lit(0.0)).alias("sd")), "mean", "sd")


@query("""WITH v AS (SELECT conv_id, turn, role, length(text) AS n, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS f FROM conversations) SELECT conv_id, round(avg((role = f)::INT), 9) AS consistency, round(stddev_pop(n), 9) AS spread FROM v GROUP BY conv_id""")
def msc12_variants(spark, d):
    """MSC-12: how many variants agree with the first, and the population standard deviation."""
    first = F.first("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    v = read(spark, d, "conversations").select("conv_id", (F.col("role") == first).cast("double").alias("same"), F.length("text").alias("n"))
    return rounded(v.groupBy("conv_id").agg(F.avg("same").alias("consistency"), F.stddev_pop("n").alias("spread")), "consistency", "spread")


@query(f"""WITH r AS (SELECT date_trunc('week', called_at) AS w, count(*) / 7.0::DOUBLE AS rate, count(DISTINCT purpose || provider) AS workers FROM ({USAGE}) GROUP BY 1), x AS (SELECT arg_min(rate, w) AS r0, arg_max(rate, w) AS r1, arg_min(workers, w) AS w0, arg_max(workers, w) AS w1 FROM r)
SELECT round((r1 / r0) / (w1 / w0::DOUBLE), 9) AS efficiency FROM x""")
def msc14_scaling(spark, d):
    """MSC-14."""
    r = usage(spark, d).groupBy(F.date_trunc("week", "called_at").alias("w")).agg((F.count("*") / F.lit(7.0)).alias("rate"), F.countDistinct(F.concat("purpose", "provider")).alias("workers"))
    x = r.agg(F.min_by("rate", "w").alias("r0"), F.max_by("rate", "w").alias("r1"), F.min_by("workers", "w").alias("w0"), F.max_by("workers", "w").alias("w1"))
    return x.select(F.round((F.col("r1") / F.col("r0")) / (F.col("w1") / F.col("w0")), 9).alias("efficiency"))


@query("SELECT k, min(doc_id) AS doc_id FROM (SELECT coalesce(CASE WHEN n_chars > 2000 THEN doc_id::VARCHAR END, substr(text, 1, 60)) AS k, doc_id FROM documents) GROUP BY k")
def msc15_page_dedup(spark, d):
    """MSC-15: one row of each key, the id or else the text's first sixty characters (the reference's own key)."""
    k = F.coalesce(F.when(F.col("n_chars") > 2000, F.col("doc_id").cast("string")), F.substring("text", 1, 60))
    return read(spark, d, "documents").select(k.alias("k"), "doc_id").groupBy("k").agg(F.min("doc_id").alias("doc_id"))
