"""Queries over projections: scans, projections, joins, aggregations, windows, sorts, sets; each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymill.functions import grades, stats, text
from quarrymill.operators import relational as op

from .projections import CLASSIFICATIONS, CORRECTIONS, GOLD, PRED, USAGE, classifications, corrections, gold, predictions, read, usage

QUERIES: dict = {}
SQL: dict[str, str] = {}

MICROS = "CAST(round({} * 1000000) AS BIGINT)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ORDER_SQL = "CASE {} WHEN 'TS' THEN 1 WHEN 'S1' THEN 2 WHEN 'S2' THEN 3 WHEN 'S3' THEN 4 ELSE 99 END"
#: White space of any script.
WHITE_SQL = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
KEY_SQL = "sha1(regexp_replace(coalesce({}, ''), '" + WHITE_SQL.replace("{", "{{").replace("}", "}}") + "', '', 'g'))"


@query(f"""WITH k AS (SELECT doc_id, source, text, {KEY_SQL.format('text')} AS key, row_number() OVER (PARTITION BY {KEY_SQL.format('text')} ORDER BY doc_id) AS rn FROM documents)
SELECT source, count(*) AS n, count(*) FILTER (WHERE length(text) < 50) AS n_short, CAST(sum(length(text)) AS BIGINT) AS chars FROM k WHERE rn = 1 GROUP BY source""")
def flagship_source_profile(spark, d):
    """Exact de-duplication by text key, then a profile of each source."""
    t = read(spark, d, "documents").select("doc_id", "source", "text")
    one = t.withColumn("key", text.text_key("text")).groupBy("key").agg(F.min_by(F.struct("source", F.length("text").alias("len")), "doc_id").alias("r"))
    return one.groupBy(F.col("r.source").alias("source")).agg(F.count("*").alias("n"), F.count_if(F.col("r.len") < 50).alias("n_short"), F.sum("r.len").cast("long").alias("chars"))


_ENT = "regexp_replace(regexp_replace(html, '<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'gs')"
for _a, _b in text.ENTITIES:
    _ENT = f"replace({_ENT}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"


@query(f"SELECT page_id, sha1(trim(regexp_replace({_ENT}, '[ \\t\\r\\n\\f]+', ' ', 'g'), ' ')) AS text_sha1 FROM pages")
def src08_html_text(spark, d):
    """SRC-08."""
    return read(spark, d, "pages").select("page_id", F.sha1(text.strip_html("html")).alias("text_sha1"))


@query("""SELECT user_id, arg_min(event_type, event_id) AS first_type, string_agg(event_type, ',' ORDER BY event_id) FILTER (WHERE event_type <> 'view') AS codes FROM events GROUP BY user_id""")
def src12_keyed_tables(spark, d):
    """SRC-12: the first value of each key, and its codes in order."""
    e = read(spark, d, "events")
    codes = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("event_type") != "view", F.struct("event_id", "event_type")))), lambda x: x["event_type"]), ",")
    return e.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.nullif(codes, F.lit("")).alias("codes"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('signup', 'purchase') AND value > 5 ORDER BY ts DESC, event_id DESC LIMIT 100")
def src13_recent_scan(spark, d):
    """SRC-13, SRT-07: a filtered scan, newest first, with the report's limit."""
    e = read(spark, d, "events")
    return e.where(F.col("event_type").isin("signup", "purchase") & (F.col("value") > 5)).orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "user_id", "event_type")


@query("""WITH u AS (SELECT 'd' || doc_id AS anchor_id, text, 1 AS pri FROM documents UNION ALL SELECT 'd' || item_id, text, 2 FROM benchmark)
SELECT anchor_id, arg_min(length(text), pri) AS n_chars, min(pri) AS pri FROM u WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY anchor_id""")
def src15_anchor_union(spark, d):
    """SRC-15: sources under one schema; the first source that has an id wins."""
    a = read(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("anchor_id"), "text", F.lit(1).alias("pri"))
    b = read(spark, d, "benchmark").select(F.concat(F.lit("d"), "item_id").alias("anchor_id"), "text", F.lit(2).alias("pri"))
    return a.unionByName(b).where("text is not null and trim(text) <> ''").groupBy("anchor_id").agg(F.min_by(F.length("text"), "pri").alias("n_chars"), F.min("pri").alias("pri"))


_OLD_NEW = "old AS (SELECT doc_id, source, n_chars FROM documents WHERE lang <> 'es'), new AS (SELECT doc_id, upper(source) AS source, n_chars + 1 AS n_chars FROM documents WHERE lang IN ('es', 'fr'))"


def _old_new(spark, d):
    t = read(spark, d, "documents")
    return t.where("lang <> 'es'").select("doc_id", "source", "n_chars"), t.where("lang in ('es', 'fr')").select("doc_id", F.upper("source").alias("source"), (F.col("n_chars") + 1).alias("n_chars"))


@query(f"WITH {_OLD_NEW} SELECT * FROM new UNION ALL SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)")
def snk02_upsert(spark, d):
    """SNK-02."""
    return op.upsert(*_old_new(spark, d), ["doc_id"])


@query("""WITH c AS (SELECT conv_id, turn, length(text) AS n FROM conversations), new AS (SELECT conv_id, turn * 10 AS turn, n FROM c WHERE conv_id IN (SELECT conv_id FROM c WHERE turn >= 4))
SELECT * FROM new UNION ALL SELECT * FROM c WHERE conv_id NOT IN (SELECT conv_id FROM new)""")
def snk03_replace_children(spark, d):
    """SNK-03: a parent's children are replaced together."""
    c = read(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return op.replace_children(c, c.join(c.where("turn >= 4").select("conv_id"), "conv_id", "left_semi").withColumn("turn", F.col("turn") * 10), "conv_id")


@query(f"WITH {_OLD_NEW} SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.source, o.source) AS source, coalesce(n.n_chars, o.n_chars) AS n_chars FROM old o FULL JOIN new n ON o.doc_id = n.doc_id")
def snk04_promote_or_append(spark, d):
    """SNK-04."""
    return op.promote_or_append(*_old_new(spark, d), "doc_id")


@query(f"SELECT doc_id, {ORDER_SQL.format('label')} AS label_order, {ORDER_SQL.format('pred')} AS pred_order FROM ({PRED})")
def prj01_grade_order(spark, d):
    """PRJ-01."""
    return predictions(spark, d).select("doc_id", grades.order("label").alias("label_order"), grades.order("pred").alias("pred_order"))


@query("SELECT event_id FROM events WHERE event_type = 'click' AND json_extract_string(props, '$.k') = '7'")
def prj02_metadata_filter(spark, d):
    """PRJ-02: a typed column and a key of a JSON column, compared as text."""
    return read(spark, d, "events").where((F.col("event_type") == "click") & (F.get_json_object("props", "$.k") == "7")).select("event_id")


def _reviewed(spark, d):
    sources = F.array(*[F.lit(x) for x in ("human_review", "public_definitive", "koipa_case_based", "nkt_designated", "codex_review", "rule_llm_agreement", "llm_judge_a")])
    names = F.array(*[F.lit(x) for x in ("LLM_judge_1", " ", "AI-2", "codex_1", " Claude", "kim", "lee", "n/a", "reviewer", "Model x", "aiden", "review_assist")])
    r = F.element_at(names, (F.col("user_id") % 12 + 1).cast("int"))
    status = F.when(F.col("event_type") == "signup", "confirmed").when(F.col("event_type") == "purchase", "corrected").otherwise("open")
    return read(spark, d, "events").select("event_id", r.alias("reviewer"), status.alias("status"), F.element_at(sources, (F.col("event_id") % 7 + 1).cast("int")).alias("label_source"), F.when(F.col("event_id") % 11 == 0, "gold_candidate").otherwise("needs_review").alias("review_status"))


_REVIEWED = """SELECT event_id, ['LLM_judge_1', ' ', 'AI-2', 'codex_1', ' Claude', 'kim', 'lee', 'n/a', 'reviewer', 'Model x', 'aiden', 'review_assist'][user_id % 12 + 1] AS reviewer, CASE event_type WHEN 'signup' THEN 'confirmed' WHEN 'purchase' THEN 'corrected' ELSE 'open' END AS status,
['human_review', 'public_definitive', 'koipa_case_based', 'nkt_designated', 'codex_review', 'rule_llm_agreement', 'llm_judge_a'][event_id % 7 + 1] AS label_source, CASE WHEN event_id % 11 = 0 THEN 'gold_candidate' ELSE 'needs_review' END AS review_status FROM events"""
_HUMAN = "(trim(reviewer) <> '' AND NOT regexp_matches(lower(trim(reviewer)), '^(llm_judge|ai_assist|codex|model|machine|public_gold|auto)'))"
_STRICT = "(lower(trim(reviewer)) IN ('', 'human', 'reviewer', 'tbd', '-', 'n/a', 'na', 'system', 'ai', 'ai_assist', 'claude', 'unknown', 'none', 'auto', 'bot', 'llm') OR contains(lower(reviewer), 'assist') OR regexp_matches(lower(trim(reviewer)), '^(ai|llm|gpt|claude|bot|auto)[_-]'))"
_TIER = f"CASE WHEN label_source = 'human_review' AND {_HUMAN} THEN 'locked_gold_eval' WHEN label_source IN ('public_definitive', 'koipa_case_based', 'nkt_designated', 'codex_review') THEN 'legal_floor' WHEN label_source = 'rule_llm_agreement' OR review_status = 'gold_candidate' THEN 'gold_candidate' ELSE 'silver_train' END"


@query(f"""SELECT event_id, {_HUMAN} AS human, {_STRICT} AS machine, {_HUMAN} AND status IN ('confirmed', 'corrected') AS admitted, {_TIER} AS tier FROM ({_REVIEWED})""")
def prj03_reviewers_and_tiers(spark, d):
    """PRJ-03, 04, 05, 06."""
    return _reviewed(spark, d).select("event_id", grades.is_human("reviewer").alias("human"), grades.is_machine_strict("reviewer").alias("machine"), grades.admissible("reviewer", "status").alias("admitted"), grades.tier("label_source", "reviewer", "review_status").alias("tier"))


@query(f"""WITH t AS (SELECT event_id, {_TIER} AS tier FROM ({_REVIEWED})),
u AS (SELECT CASE WHEN count(*) FILTER (WHERE tier = 'locked_gold_eval') > 0 THEN 'locked_gold_eval' ELSE 'legal_floor' END AS used FROM t) SELECT event_id, tier AS tier_used FROM t, u WHERE tier = used""")
def prj07_eval_fallback(spark, d):
    """PRJ-07: locked rows if there are any, else the legal floor."""
    t = _reviewed(spark, d).select("event_id", grades.tier("label_source", "reviewer", "review_status").alias("tier"))
    used = t.agg(F.when(F.count_if(F.col("tier") == "locked_gold_eval") > 0, "locked_gold_eval").otherwise("legal_floor").alias("used"))
    return t.join(F.broadcast(used), t["tier"] == used["used"]).select("event_id", F.col("tier").alias("tier_used"))


@query("""SELECT doc_id, (contains(text, 'the ')::INT + contains(text, ' les ')::INT + contains(text, ' der ')::INT + contains(text, ' que ')::INT) >= 2 OR starts_with(source, 'src1') AS marked,
contains(source, '7') OR contains(source, '12') AS public_source FROM documents""")
def prj09_markers(spark, d):
    """PRJ-09, 10."""
    n = sum((F.contains("text", F.lit(m)).cast("int") for m in ("the ", " les ", " der ", " que ")), F.lit(0))
    return read(spark, d, "documents").select("doc_id", ((n >= 2) | F.startswith("source", F.lit("src1"))).alias("marked"), F.exists(F.array(F.lit("7"), F.lit("12")), lambda t: F.contains(F.col("source"), t)).alias("public_source"))


@query(f"SELECT k.correction_id, c.doc_id, c.status FROM ({CORRECTIONS}) k JOIN ({CLASSIFICATIONS}) c ON k.classification_id = c.classification_id")
def jn01_corrections(spark, d):
    """JN-01."""
    return corrections(spark, d).join(classifications(spark, d), "classification_id").select("correction_id", "doc_id", "status")


_LATEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY classification_id ORDER BY corrected_at DESC, correction_id DESC) AS rn FROM ({CORRECTIONS})) WHERE rn = 1"


@query(f"""SELECT c.classification_id, ['TS', 'S1', 'S2', 'S3'][coalesce(k.corrected_level, c.level)] AS final_grade, k.correction_id,
CASE WHEN k.correction_id IS NULL THEN NULL WHEN k.corrected_level < c.level THEN 'underclass' WHEN k.corrected_level > c.level THEN 'overclass' ELSE 'confirm' END AS direction
FROM ({CLASSIFICATIONS}) c LEFT JOIN ({_LATEST}) k ON c.classification_id = k.classification_id""")
def jn02_latest_correction(spark, d):
    """JN-02, JN-03, WIN-03, WIN-04, direction: a classification's final grade by its latest correction."""
    k = op.latest(corrections(spark, d), "classification_id", "corrected_at", "correction_id").select("classification_id", "correction_id", "corrected_level")
    out = classifications(spark, d).join(k, "classification_id", "left")
    return out.select("classification_id", grades.grade_of(F.coalesce("corrected_level", "level")).alias("final_grade"), "correction_id", F.when(F.col("correction_id").isNotNull(), grades.direction(F.col("level"), F.col("corrected_level"))).alias("direction"))


def _splits(spark, d):
    t = read(spark, d, "documents").select("doc_id", "source", "text", text.text_key("text").alias("key"))
    return t.where("source in ('src0', 'src1', 'src2')"), t.where("source not in ('src0', 'src1', 'src2')")


_KEYED = f"SELECT doc_id, source, text, {KEY_SQL.format('text')} AS key FROM documents"
_EVAL, _TRAIN = f"SELECT * FROM ({_KEYED}) WHERE source IN ('src0', 'src1', 'src2')", f"SELECT * FROM ({_KEYED}) WHERE source NOT IN ('src0', 'src1', 'src2')"


@query(f"SELECT doc_id FROM ({_EVAL}) WHERE key IN (SELECT key FROM ({_TRAIN}))")
def jn06_leakage(spark, d):
    """JN-06: rows of the evaluation split whose text is in the training split."""
    ev, tr = _splits(spark, d)
    return ev.join(tr, "key", "left_semi").select("doc_id")


@query(f"SELECT doc_id FROM ({_TRAIN}) WHERE key NOT IN (SELECT key FROM ({_EVAL})) AND doc_id NOT IN (SELECT item_id FROM benchmark)")
def jn07_decontaminated(spark, d):
    """JN-07: rows that share neither a text nor an id with the holdout."""
    ev, tr = _splits(spark, d)
    bench = read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    return op.not_in_either(op.not_in_either(tr, ev, ["key"]), bench, ["doc_id"]).select("doc_id")


@query(f"SELECT doc_id FROM ({_EVAL}) WHERE key NOT IN (SELECT key FROM ({_TRAIN}))")
def jn08_clean_holdout(spark, d):
    """JN-08, SPL-04."""
    ev, tr = _splits(spark, d)
    return ev.join(tr, "key", "left_anti").select("doc_id")


@query(f"""WITH k AS (SELECT DISTINCT source, key FROM ({_KEYED})) SELECT a.source AS split_a, b.source AS split_b, count(*) AS n_shared FROM k a JOIN k b ON a.key = b.key AND a.source < b.source GROUP BY a.source, b.source""")
def jn09_split_overlaps(spark, d):
    """JN-09: shared texts for each pair of sources."""
    return op.overlaps(read(spark, d, "documents").select("source", text.text_key("text").alias("key")), "source", "key")


@query(f"""WITH s AS (SELECT classification_id AS doc_id, count(DISTINCT corrected_by) AS n_reviewers, count(DISTINCT corrected_level) AS n_levels FROM ({CORRECTIONS}) GROUP BY 1)
SELECT d.doc_id, coalesce(n_reviewers, 0) AS n_reviewers, coalesce(n_levels, 0) AS n_levels FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id""")
def jn10_signoffs(spark, d):
    """JN-10: candidates with their sign-offs, aggregated before the join."""
    s = corrections(spark, d).groupBy(F.col("classification_id").alias("doc_id")).agg(F.countDistinct("corrected_by").alias("n_reviewers"), F.countDistinct("corrected_level").alias("n_levels"))
    return read(spark, d, "documents").select("doc_id").join(s, "doc_id", "left").select("doc_id", F.coalesce("n_reviewers", F.lit(0)).alias("n_reviewers"), F.coalesce("n_levels", F.lit(0)).alias("n_levels"))


@query(f"""WITH g AS (SELECT doc_id, label, {KEY_SQL.format('text')} AS key FROM ({GOLD})), k AS (SELECT doc_id, {KEY_SQL.format('text')} AS key FROM documents)
SELECT k.doc_id, min(g.doc_id) AS verified_by FROM k JOIN g ON k.key = g.key AND k.doc_id <> g.doc_id GROUP BY k.doc_id""")
def jn11_same_file(spark, d):
    """JN-11, INF-09: another labelled document with the same content. The two smallest labelled ids of each content are all that is joined."""
    g = gold(spark, d).select(text.text_key("text").alias("key"), "doc_id").groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count("*").alias("n"))
    second = gold(spark, d).select(text.text_key("text").alias("key"), "doc_id").join(g.where("n > 1"), "key").where("doc_id <> a").groupBy("key").agg(F.min("doc_id").alias("b"))
    met = read(spark, d, "documents").select("doc_id", text.text_key("text").alias("key")).join(g.select("key", "a"), "key").join(second, "key", "left")
    return met.select("doc_id", F.when(F.col("doc_id") != F.col("a"), F.col("a")).otherwise(F.col("b")).alias("verified_by")).where("verified_by is not null")


@query("""SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def jn12_keyed_chain(spark, d):
    """JN-12: a chain of left joins on keys; the two fixed dimensions (25 and 5 rows) are broadcast."""
    o, c, n, r = (read(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").join(F.broadcast(n), F.col("c_nationkey") == n["n_nationkey"], "left").join(F.broadcast(r), F.col("n_regionkey") == r["r_regionkey"], "left").select("o_orderkey", "c_name", "n_name", "r_name")


_TERMS = ("the ", "and ", "que ", "der ", "les ")


@query("SELECT t.term, count(*) AS n_docs FROM documents d JOIN (SELECT unnest(['the ', 'and ', 'que ', 'der ', 'les ']) AS term) t ON contains(d.text, t.term) GROUP BY t.term")
def jn14_seed_containment(spark, d):
    """JN-14: which of a fixed list of seeds a text holds: an array expression in the scan, not a join."""
    found = F.filter(F.array(*[F.lit(t) for t in _TERMS]), lambda t: F.contains(F.col("text"), t))
    return read(spark, d, "documents").select(F.explode(found).alias("term")).groupBy("term").agg(F.count("*").alias("n_docs"))


@query("SELECT e.event_id, coalesce(CASE WHEN e.event_id % 3 = 0 THEN 'req' END, d.source, 'none') AS source FROM events e LEFT JOIN documents d ON e.user_id = d.doc_id")
def jn15_hydration(spark, d):
    """JN-15: the request's value, else the document's."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("user_id"), "source")
    return read(spark, d, "events").select("event_id", "user_id").join(docs, "user_id", "left").select("event_id", F.coalesce(F.when(F.col("event_id") % 3 == 0, "req"), "source", F.lit("none")).alias("source"))


@query(f"""SELECT CAST(date_trunc('month', called_at) AS DATE) AS month, provider, purpose, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, {MICROS.format('sum(cost_usd)')} AS cost_micro,
CAST(round(avg(latency_ms)) AS BIGINT) AS avg_latency, count(*) FILTER (WHERE NOT success) AS failures FROM ({USAGE}) GROUP BY 1, 2, 3""")
def agg01_monthly_cost(spark, d):
    """AGG-01."""
    u = usage(spark, d).groupBy(F.date_trunc("month", "called_at").cast("date").alias("month"), "provider", "purpose")
    return u.agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost_usd") * 1000000).cast("long").alias("cost_micro"), F.round(F.avg("latency_ms")).cast("long").alias("avg_latency"), F.count_if(~F.col("success")).alias("failures"))


@query(f"""SELECT c.model_version, count(*) AS n_rows, count(*) FILTER (WHERE c.status = 'confirmed') AS confirmed, count(*) FILTER (WHERE k.corrected_level < c.level) AS underclass, count(*) FILTER (WHERE k.corrected_level > c.level) AS overclass,
round(avg(c.confidence), 6) AS avg_confidence, round(avg(c.inference_ms), 6) AS avg_ms FROM ({CLASSIFICATIONS}) c LEFT JOIN ({CORRECTIONS}) k ON c.classification_id = k.classification_id GROUP BY c.model_version""")
def agg02_model_performance(spark, d):
    """AGG-02; a classification counts once for each of its corrections, as the view does."""
    k = corrections(spark, d).select("classification_id", "corrected_level")
    return classifications(spark, d).join(k, "classification_id", "left").groupBy("model_version").agg(F.count("*").alias("n_rows"), F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.count_if(F.col("corrected_level") < F.col("level")).alias("underclass"), F.count_if(F.col("corrected_level") > F.col("level")).alias("overclass"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.round(F.avg("inference_ms"), 6).alias("avg_ms"))


@query(f"""WITH k AS (SELECT count(*) FILTER (WHERE k.corrected_level < c.level) AS n_under, count(*) FILTER (WHERE k.corrected_level <> c.level) AS n_total FROM ({CORRECTIONS}) k JOIN ({CLASSIFICATIONS}) c ON k.classification_id = c.classification_id WHERE NOT consumed)
SELECT n_under, n_total, CASE WHEN n_under >= 10 THEN 'URGENT' WHEN n_total >= 50 THEN 'RECOMMENDED' ELSE 'OK' END AS status FROM k""")
def agg03_retrain_status(spark, d):
    """AGG-03, GAT-05."""
    k = corrections(spark, d).where(~F.col("consumed")).join(classifications(spark, d), "classification_id")
    k = k.agg(F.count_if(F.col("corrected_level") < F.col("level")).alias("n_under"), F.count_if(F.col("corrected_level") != F.col("level")).alias("n_total"))
    return k.withColumn("status", F.when(F.col("n_under") >= 10, "URGENT").when(F.col("n_total") >= 50, "RECOMMENDED").otherwise("OK"))


@query(f"SELECT coalesce({MICROS.format('sum(cost_usd)')}, 0) AS cost_micro, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens FROM ({USAGE}) WHERE provider = 'click'")
def agg04_totals(spark, d):
    """AGG-04."""
    return usage(spark, d).where("provider = 'click'").agg(F.coalesce(F.round(F.sum("cost_usd") * 1000000).cast("long"), F.lit(0)).alias("cost_micro"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


@query(f"SELECT level, count(*) AS n FROM ({CLASSIFICATIONS}) WHERE status IN ('needs_review', 'needs_second_review') GROUP BY level")
def agg05_hold_queue(spark, d):
    """AGG-05."""
    return classifications(spark, d).where(F.col("status").isin("needs_review", "needs_second_review")).groupBy("level").agg(F.count("*").alias("n"))


@query(f"SELECT classification_id, corrected_level, count(DISTINCT corrected_by) AS reviewers, count(DISTINCT corrected_by) >= 2 AS quorum FROM ({CORRECTIONS}) GROUP BY 1, 2")
def agg06_quorum(spark, d):
    """AGG-06."""
    n = F.countDistinct("corrected_by")
    return corrections(spark, d).groupBy("classification_id", "corrected_level").agg(n.alias("reviewers"), (n >= 2).alias("quorum"))


@query(f"SELECT label, domain, source, count(*) AS n FROM ({GOLD}) GROUP BY 1, 2, 3")
def agg07_distributions(spark, d):
    """AGG-07."""
    return op.cross_tab(gold(spark, d), ["label", "domain", "source"])


@query("""SELECT source, count(*) AS n, round(avg(length(text)), 6) AS mean_len, median(length(text)) AS median_len, round(coalesce(stddev_samp(length(text)), 0), 6) AS sd_len, min(length(text)) AS min_len, max(length(text)) AS max_len,
round(coalesce(stddev_samp(length(text)) / nullif(avg(length(text)), 0), 0), 6) AS cv, coalesce(stddev_samp(length(text)) / nullif(avg(length(text)), 0), 0) < 0.1 AS balanced FROM documents GROUP BY source""")
def agg08_length_statistics(spark, d):
    """AGG-08, AGG-11."""
    n = F.length("text")
    cv = F.coalesce(F.try_divide(F.stddev_samp(n), F.avg(n)), F.lit(0.0))
    return read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean_len"), F.median(n).alias("median_len"), F.round(F.coalesce(F.stddev_samp(n), F.lit(0.0)), 6).alias("sd_len"), F.min(n).cast("long").alias("min_len"), F.max(n).cast("long").alias("max_len"), F.round(cv, 6).alias("cv"), (cv < 0.1).alias("balanced"))


@query("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events),
c AS (SELECT *, greatest(1, least(n - 1, ((n + 1) * 19) // 20)) AS j FROM s)
SELECT event_type, round(CASE WHEN max(n) < 20 THEN 0.0::DOUBLE ELSE max(CASE WHEN rn = j THEN value END) * (1 - ((max(n) + 1) * 19 - max(j) * 20) / 20.0) + max(CASE WHEN rn = j + 1 THEN value END) * (((max(n) + 1) * 19 - max(j) * 20) / 20.0) END, 6) AS p95_exclusive,
round(max(CASE WHEN rn = CAST(round_even(0.95::DOUBLE * (n - 1), 0) AS BIGINT) + 1 THEN value END), 6) AS p95_nearest FROM c GROUP BY event_type""")
def agg09_percentiles(spark, d):
    """AGG-09, AGG-10: p95 by the exclusive method, and by nearest rank. Ranks come from binned windows, so no group meets in one task."""
    s = op.ranked_by_bins(read(spark, d, "events").select("event_type", "value"), "event_type", ["value"], F.floor("value"))
    s = s.withColumn("j", F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor((F.col("n") + 1) * 19 / 20))))
    part = ((F.max("n") + 1) * 19 - F.max("j") * 20) / F.lit(20.0)
    at = lambda k: F.max(F.when(F.col("rn") == k, F.col("value")))
    return s.groupBy("event_type").agg(F.round(F.when(F.max("n") < 20, 0.0).otherwise(at(F.col("j")) * (1 - part) + at(F.col("j") + 1) * part), 6).alias("p95_exclusive"), F.round(at(F.bround(F.lit(0.95) * (F.col("n") - 1), 0) + 1), 6).alias("p95_nearest"))


@query("""WITH t AS (SELECT d.doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '([a-z]{5,})', 1))) AS token FROM documents d),
w AS (SELECT doc_id, token, length(token) AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY length(token) DESC, token) AS rn FROM t)
SELECT doc_id, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight, coalesce(string_agg(token, ',' ORDER BY rn) FILTER (WHERE rn <= 5), '') AS top FROM w GROUP BY doc_id""")
def agg12_evidence(spark, d):
    """AGG-12: a document's evidence (here its long words): number, weight, the five heaviest. Array functions, no explode."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), F.lit(1)))
    ranked = F.sort_array(F.transform(tokens, lambda t: F.struct((-F.length(t)).alias("w"), t.alias("t"))))
    out = read(spark, d, "documents").select("doc_id", ranked.alias("r")).where(F.size("r") > 0)
    return out.select("doc_id", F.size("r").cast("long").alias("n"), F.aggregate("r", F.lit(0).cast("long"), lambda s, x: s - x["w"]).alias("weight"), F.array_join(F.transform(F.slice("r", 1, 5), lambda x: x["t"]), ",").alias("top"))


_MARKED = {
    "bracket_ratio": r"\[특급기밀\]|\[1급\s*비밀\]|\[2급\s*비밀\]|\[3급\s*공개\]|\[TS\]|\[S1\]|\[S2\]|\[S3\]|특급기밀\s*관련\s*사항|비밀\s*관련\s*사항",
    "mojibake_ratio": r"[愿蹂諛以]|\\ufffd|\?{3,}",
    "synthetic_ratio": r"\[가상기업[A-Z가-힣]\]|\[홍길동\(가명\)\]|\[등급분류\]|\[기밀자료\]|\[내부자료\]|\[등급코드\]|Noop fallback",
}
#: Texts of each pattern that one of these must be in; looking for them is much cheaper.
_LITERALS = {"bracket_ratio": ("[", "관련"), "mojibake_ratio": ("???", "\\ufffd", "愿", "蹂", "諛", "以"), "synthetic_ratio": ("[", "Noop fallback")}


@query(f"""WITH d AS (SELECT source, CASE WHEN doc_id % 4 = 0 OR (length(source) = 4 AND doc_id % 3 < 2) THEN NULL ELSE 'review' END AS label_source,
CASE WHEN doc_id % 50 = 0 THEN '[TS] ' ELSE '' END || CASE WHEN doc_id % 61 = 0 THEN ' ??? ' ELSE '' END || text || CASE WHEN doc_id % 97 = 0 THEN ' [내부자료]' ELSE '' END || CASE WHEN doc_id % 43 = 0 THEN chr(12288) ELSE '' END AS text FROM documents),
p AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS n_empty, count(DISTINCT {KEY_SQL.format('text')}) / count(*)::DOUBLE AS unique_ratio, {', '.join(f"count(*) FILTER (WHERE regexp_matches(text, '{p}')) / count(*)::DOUBLE AS {k}" for k, p in _MARKED.items())},
count(*) FILTER (WHERE label_source IS NULL) / count(*)::DOUBLE AS no_source_ratio FROM d GROUP BY source)
SELECT source, n, n_empty, round(unique_ratio, 6) AS unique_ratio, round(bracket_ratio, 6) AS bracket_ratio, round(mojibake_ratio, 6) AS mojibake_ratio, round(synthetic_ratio, 6) AS synthetic_ratio, round(no_source_ratio, 6) AS no_source_ratio,
CASE WHEN n_empty > 0 OR unique_ratio < 0.95 OR bracket_ratio > 0.05 THEN 'FAIL' WHEN mojibake_ratio > 0.01 OR no_source_ratio > 0.5 THEN 'WARN' ELSE 'PASS' END AS verdict FROM p""")
def agg13_split_quality(spark, d):
    """AGG-13, TXT-21: shares of a source's texts with written-in grades, broken encodings, marks of made-up texts (some put in here, as the tables have none) and without a source of their label."""
    i, t = F.col("doc_id"), F.col("text")
    put = lambda n, mark: F.when(i % n == 0, mark).otherwise("")
    unknown = (i % 4 == 0) | ((F.length("source") == 4) & (i % 3 < 2))
    rows = read(spark, d, "documents").select("source", F.when(~unknown, "review").alias("label_source"), F.concat(put(50, "[TS] "), put(61, " ??? "), t, put(97, " [내부자료]"), put(43, "\u3000")).alias("text"))
    shares = {"bracket_ratio": text.BRACKET_GRADES, "mojibake_ratio": text.MOJIBAKE, "synthetic_ratio": text.SYNTHETIC}
    has = lambda k: reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in _LITERALS[k]])
    marked = [(F.count_if(has(k) & t.rlike(p)) / F.count("*")).alias(k) for k, p in shares.items()]
    out = rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(t.isNull() | (F.trim(t) == "")).alias("n_empty"), (F.countDistinct(text.text_key("text")) / F.count("*")).alias("unique_ratio"), *marked, (F.count_if(F.col("label_source").isNull()) / F.count("*")).alias("no_source_ratio"))
    fails = (F.col("n_empty") > 0) | (F.col("unique_ratio") < 0.95) | (F.col("bracket_ratio") > 0.05)
    verdict = F.when(fails, "FAIL").when((F.col("mojibake_ratio") > 0.01) | (F.col("no_source_ratio") > 0.5), "WARN").otherwise("PASS")
    return out.select("source", "n", "n_empty", *[F.round(c, 6).alias(c) for c in ("unique_ratio", *shares, "no_source_ratio")], verdict.alias("verdict"))


@query(f"""SELECT count(*) AS n, count(*) FILTER (WHERE trim(coalesce(text, '')) = '') AS n_empty, count(*) FILTER (WHERE length(text) < 20) AS n_short, count(*) FILTER (WHERE label NOT IN ('TS', 'S1', 'S2', 'S3')) AS n_bad_label,
count(*) FILTER (WHERE source IS NULL) AS n_no_source, count(*) - count(DISTINCT {KEY_SQL.format('text')}) AS n_duplicate FROM ({GOLD})""")
def agg14_gold_profile(spark, d):
    """AGG-14."""
    t = F.col("text")
    return gold(spark, d).agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce(t, F.lit(""))) == "").alias("n_empty"), F.count_if(F.length(t) < 20).alias("n_short"), F.count_if(~F.col("label").isin(*grades.GRADES)).alias("n_bad_label"), F.count_if(F.col("source").isNull()).alias("n_no_source"), (F.count("*") - F.countDistinct(text.text_key("text"))).alias("n_duplicate"))


@query(f"""SELECT source, round(coalesce(count(*) FILTER (WHERE m AND label <> 'S3') / nullif(count(*) FILTER (WHERE m), 0)::DOUBLE, 0), 6) AS noise FROM (SELECT source, label, contains(text, 'License') OR contains(text, 'rights') AS m FROM ({GOLD}) WHERE source <> 'src0') GROUP BY source""")
def agg15_noise_rate(spark, d):
    """AGG-15."""
    m = F.contains("text", F.lit("License")) | F.contains("text", F.lit("rights"))
    return gold(spark, d).where("source <> 'src0'").groupBy("source").agg(F.round(stats.ratio(F.count_if(m & (F.col("label") != "S3")), F.count_if(m)), 6).alias("noise"))


@query(f"""SELECT source, label || '>' || pred AS pattern, CASE WHEN length(text) < 256 THEN '<256' WHEN length(text) < 512 THEN '256-512' WHEN length(text) < 1024 THEN '512-1024' ELSE '>1024' END AS bucket, count(*) AS n
FROM ({PRED}) WHERE label <> pred GROUP BY 1, 2, 3""")
def agg16_misclassifications(spark, d):
    """AGG-16."""
    n = F.length("text")
    bucket = F.when(n < 256, "<256").when(n < 512, "256-512").when(n < 1024, "512-1024").otherwise(">1024")
    return predictions(spark, d).where("label <> pred").groupBy("source", F.concat("label", F.lit(">"), "pred").alias("pattern"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN event_type = 'error' AND value > 10 THEN 'timeout' WHEN event_type = 'error' THEN 'failure' WHEN value < 1 THEN 'empty' ELSE 'other' END AS reason, count(*) AS n FROM events GROUP BY 1""")
def agg18_skip_reasons(spark, d):
    """AGG-18: the first of the ordered cases."""
    reason = F.when((F.col("event_type") == "error") & (F.col("value") > 10), "timeout").when(F.col("event_type") == "error", "failure").when(F.col("value") < 1, "empty").otherwise("other")
    return read(spark, d, "events").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, rn FROM (SELECT doc_id, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM ({GOLD})) WHERE rn <= round_even(n * 0.15::DOUBLE, 0)")
def win05_rank_cut(spark, d):
    """WIN-05: the first share of each stratum by sorted key."""
    ranks = op.ranked_by_bins(gold(spark, d).select("doc_id", "label"), "label", ["doc_id"], F.floor(F.col("doc_id") / 100_000))
    return ranks.where(F.col("rn") <= F.bround(F.col("n") * F.lit(0.15), 0)).select("doc_id", "rn")


@query(f"SELECT label, source, least(count(*), 3) AS kept, greatest(count(*) - 3, 0) AS dropped FROM ({GOLD}) GROUP BY label, source")
def win06_cell_cap(spark, d):
    """WIN-06, WIN-07: at most three rows of a cell, and how many that drops (the report is the feature)."""
    g = gold(spark, d)
    kept = op.top_per_key(g, ["label", "source"], [F.col("doc_id")], 3).groupBy("label", "source").agg(F.count("*").alias("kept"))
    return g.groupBy("label", "source").agg(F.count("*").alias("n")).join(kept, ["label", "source"]).select("label", "source", "kept", (F.col("n") - F.col("kept")).alias("dropped"))


@query("""SELECT user_id, event_id, value > lag(value) OVER w AS rose, ts >= lag(ts) OVER w AS monotone FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def win10_deltas(spark, d):
    """WIN-09, WIN-10: changes to the row before, and whether time stamps rise."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return read(spark, d, "events").select("user_id", "event_id", (F.col("value") > F.lag("value").over(w)).alias("rose"), (F.col("ts") >= F.lag("ts").over(w)).alias("monotone"))


@query("""WITH f AS (SELECT user_id, event_id, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events)
SELECT user_id, CAST(max(s) AS BIGINT) AS longest FROM (SELECT user_id, sum(bad::INT) OVER (PARTITION BY user_id, g ORDER BY event_id) AS s FROM f) GROUP BY user_id""")
def win09_longest_streak(spark, d):
    """WIN-09: the longest run of failures."""
    e = read(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("bad"))
    return op.runs_of(e, "user_id", "event_id", "bad").groupBy("user_id").agg(F.max("streak").cast("long").alias("longest"))


@query("""SELECT conv_id, turn, coalesce(right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 20), '') AS tail FROM conversations""")
def win12_previous_tail(spark, d):
    """WIN-12: the end of the piece before."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return read(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.right(before, F.lit(20)), F.lit("")).alias("tail"))


@query("""WITH b AS (SELECT floor(value) AS bin, count(*) AS n FROM events GROUP BY 1) SELECT CAST(bin AS BIGINT) AS bin, round(sum(n) OVER (ORDER BY bin) / (SELECT count(*) FROM events)::DOUBLE, 9) AS cdf FROM b""")
def win14_cumulative(spark, d):
    """WIN-14: the cumulative share by bin; the window runs over the bins."""
    b = read(spark, d, "events").groupBy(F.floor("value").alias("bin")).agg(F.count("*").alias("n"))
    every = Window.orderBy("bin")
    return b.select("bin", F.round(F.sum("n").over(every) / F.sum("n").over(Window.partitionBy()), 9).alias("cdf"))


@query(f"SELECT model_version, deactivated_at FROM (SELECT model_version, max(inference_ms) AS deactivated_at FROM ({CLASSIFICATIONS}) GROUP BY 1) WHERE model_version <> 'm0' ORDER BY deactivated_at DESC, model_version DESC LIMIT 1")
def win15_previous_active(spark, d):
    """WIN-15: the model that was last before the current one."""
    c = classifications(spark, d).groupBy("model_version").agg(F.max("inference_ms").alias("deactivated_at")).where("model_version <> 'm0'")
    return c.orderBy(F.desc("deactivated_at"), F.desc("model_version")).limit(1)


@query(f"SELECT doc_id, confidence, pred FROM ({PRED}) ORDER BY confidence, doc_id LIMIT 50")
def srt06_review_queue(spark, d):
    """SRT-04, SRT-06: the queue's first fifty, least confident first (a top-k report)."""
    return predictions(spark, d).select("doc_id", "confidence", "pred").orderBy("confidence", "doc_id").limit(50)


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def srt08_most_common(spark, d):
    """SRT-08, SRT-09."""
    return read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("SELECT doc_id, k FROM documents, unnest(CASE WHEN lang = 'es' THEN [1, 2, 3] ELSE [1] END) AS u(k)")
def set01_repeat(spark, d):
    """SET-01: a part three times over."""
    return read(spark, d, "documents").select("doc_id", F.explode(F.when(F.col("lang") == "es", F.sequence(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1)))).alias("k"))


@query("""WITH a AS (SELECT DISTINCT source FROM documents WHERE lang = 'es'), b AS (SELECT DISTINCT source FROM documents WHERE lang = 'de')
SELECT source, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT source, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT source, 'kept' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def set02_schema_diff(spark, d):
    """SET-02, SET-03, MSC-11: codes added, removed and kept."""
    t = read(spark, d, "documents")
    a, b = (t.where(F.col("lang") == x).select("source").distinct() for x in ("es", "de"))
    mark = lambda df, m: df.select("source", F.lit(m).alias("change"))
    return mark(b.subtract(a), "added").unionByName(mark(a.subtract(b), "removed")).unionByName(mark(a.intersect(b), "kept"))


@query("""WITH a AS (SELECT source AS code, row_number() OVER (ORDER BY count(*) DESC, source) AS place FROM documents WHERE lang = 'es' GROUP BY source), b AS (SELECT source AS code, row_number() OVER (ORDER BY count(*) DESC, source) AS place FROM documents WHERE lang = 'de' GROUP BY source)
SELECT code, CASE WHEN a.place IS NULL THEN 'added' WHEN b.place IS NULL THEN 'removed' WHEN a.place <> b.place THEN 'reordered' ELSE 'kept' END AS change, coalesce(a.place = b.place, FALSE) = FALSE AS retrain FROM a FULL JOIN b USING (code)""")
def gat12_schema_change(spark, d):
    """GAT-12: two ordered lists of codes; the window runs over the codes, not the rows."""
    t = read(spark, d, "documents").groupBy("lang", F.col("source").alias("code")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    old, new = (t.where(F.col("lang") == x).select("code", place.alias("place")) for x in ("es", "de"))
    return op.schema_changes(old, new)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), r AS (
SELECT user_id, event_id, k, repeat('0', 16) AS p, substr(sha256(repeat('0', 16) || '|' || event_id), 1, 32) AS f FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.event_id, e.k, substr(r.f, 1, 16), substr(sha256(r.f || '|' || e.event_id), 1, 32) FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) SELECT user_id, event_id, p || ':' || f AS link FROM r""")
def gat13_chain_build(spark, d):
    """GAT-13: links of hash chains, one chain a user."""
    e = read(spark, d, "events").select("user_id", "ts", "event_id", F.col("event_id").cast("string").alias("payload"))
    return op.chain_links(e, "user_id", ["ts", "event_id"], "payload").select("user_id", "event_id", "link")


@query(f"""WITH v AS (SELECT model_version, max(inference_ms) AS gone FROM ({CLASSIFICATIONS}) GROUP BY 1), p AS (SELECT model_version FROM v WHERE model_version <> 'm0' ORDER BY gone DESC, model_version DESC LIMIT 1)
SELECT model_version, model_version = (SELECT model_version FROM p) AS active_after, model_version = 'm0' AS deactivated FROM v""")
def gat03_rollback(spark, d):
    """GAT-03: m0 is active and goes back: the version deactivated last becomes the active one, all others are not."""
    v = classifications(spark, d).groupBy("model_version").agg(F.max("inference_ms").alias("at"))
    return op.rolled_back(v, "model_version", "m0", "at")


@query("SELECT event_id FROM events WHERE event_type = 'error' OR ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def set06_backlog_or_recent(spark, d):
    """SET-06, STR-04: the backlog and the last 24 hours, each row once."""
    e = read(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    return e.join(F.broadcast(now)).where((F.col("event_type") == "error") | (F.col("ts") >= F.col("now") - F.expr("interval 24 hours"))).select("event_id")
