"""Queries: sources and sinks, over files that the query writes to the shared folder first; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import arrow, text
from quarrymill.operators import retrieval as ir
from quarrymill.session import scratch, shipped
from quarrymill.sources import readers, versions, writers

from .projections import PRED, predictions, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT 'text' AS method, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS n_bytes, 0::BIGINT AS failed FROM documents")
def src01_text_files(spark, d):
    """SRC-01, SRC-02: the documents as text files of bounded size, read by suffix; of each file the whole text."""
    path = scratch(spark, "text-files")
    writers.text_files(read(spark, d, "documents").select("text"), path)
    return readers.documents(spark, path).where("path like '%.txt'").groupBy("method").agg(F.sum(F.octet_length("text")).alias("n_bytes"), F.count_if(F.col("error").isNotNull()).alias("failed"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def src09_json_lines(spark, d):
    """SRC-09, SNK-01: written as JSON lines and read back."""
    t = read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    path = scratch(spark, "lines")
    writers.jsonl(t, path)
    return readers.jsonl(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.schema))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src10_json_files(spark, d):
    """SRC-10: one JSON document a file."""
    path = scratch(spark, "json-files")
    t = read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    t.select(F.to_json(F.struct("*")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return readers.json_dir(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.schema))


_REVIEWER = "['kim', 'AI-2', '', 'lee', 'tbd'][doc_id % 5 + 1]"


@query(f"""WITH r AS (SELECT doc_id, pred AS model_label, CASE WHEN doc_id % 7 = 0 THEN 'XX' ELSE label END AS human_label, {_REVIEWER} AS reviewer FROM ({PRED}))
SELECT doc_id, CASE WHEN human_label = 'XX' OR reviewer NOT IN ('kim', 'lee') THEN NULL WHEN model_label = human_label THEN 'correct' ELSE 'corrected' END AS decision,
array_to_string(list_filter([CASE WHEN human_label = 'XX' THEN 'bad_label' END, CASE WHEN reviewer NOT IN ('kim', 'lee') THEN 'machine_reviewer' END], lambda x: x IS NOT NULL), ',') AS reasons FROM r""")
def src11_review_import(spark, d):
    """SRC-11: reviews written as CSV and read back, valid and invalid ones."""
    i = F.col("doc_id")
    who = F.element_at(F.array(*[F.lit(x) for x in ("kim", "AI-2", "", "lee", "tbd")]), (i % 5 + 1).cast("int"))
    rows = predictions(spark, d).select("doc_id", F.col("pred").alias("model_label"), F.when(i % 7 == 0, "XX").otherwise(F.col("label")).alias("human_label"), F.lit("").alias("review_decision"), who.alias("reviewer_id"))
    path = scratch(spark, "reviews")
    rows.write.option("header", True).csv(path)
    good, bad = readers.review_csv(spark, path)
    out = good.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("review_decision").alias("decision"), F.lit("").alias("reasons"))
    return out.unionByName(bad.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("decision"), F.array_join("reasons", ",").alias("reasons")))


@query("SELECT page_id, url FROM pages")
def src14_sealed_store(spark, d):
    """SRC-14: a column sealed, stored and opened again."""
    key = F.lit("0123456789abcdef")
    path = scratch(spark, "sealed")
    read(spark, d, "pages").select("page_id", writers.sealed(F.col("url"), key).alias("sealed")).write.parquet(path)
    return spark.read.parquet(path).select("page_id", writers.opened(F.col("sealed"), key).alias("url"))


@query("SELECT vec_id, label FROM embeddings")
def chk07_alias_swap(spark, d):
    """CHK-07: two versions written side by side; readers go through the alias."""
    base, alias = scratch(spark, "versions"), scratch(spark, "alias")
    t = read(spark, d, "embeddings").select("vec_id", "label")
    writers.swap(spark, t.where("vec_id < 0"), base, "1", alias, "now")
    writers.swap(spark, t, base, "2", alias, "now")
    return writers.through_alias(spark, alias, "now").select("vec_id", "label")


@query("""WITH i AS (SELECT conv_id AS doc, conv_id || ':c' || turn AS id, text AS content FROM conversations), p AS (SELECT conv_id AS doc, turn AS n, k, substr(text, k * 180 + 1, 200) AS content FROM (SELECT conv_id, turn, text, unnest(range(0, CAST(ceil(greatest(length(text) - 200, 0) / 180.0::DOUBLE) AS BIGINT) + 1)) AS k FROM conversations WHERE conv_id % 2 = 0))
SELECT doc, id, sha1(content) AS content_sha1 FROM i WHERE doc % 2 = 1 UNION ALL SELECT doc, doc || ':c' || (row_number() OVER (PARTITION BY doc ORDER BY n, k) - 1), sha1(content) FROM p""")
def chk06_reindex(spark, d):
    """CHK-06: every second document's chunks are cut again; its old rows go."""
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("n"), F.col("text").alias("content"))
    index = c.select("doc", F.concat(F.col("doc").cast("string"), F.lit(":c"), F.col("n").cast("string")).alias("id"), "content")
    cut = F.transform(text.windows("content", 200, 20), lambda w: w["content"])
    return ir.reindexed(index, c.where("doc % 2 = 0"), cut).select("doc", "id", F.sha1("content").alias("content_sha1"))


@query("SELECT count(DISTINCT text) AS n_keys, count(DISTINCT text) AS n_cached FROM documents WHERE text IS NOT NULL")
def ir16_embedding_cache(spark, d):
    """IR-16: half of the texts are embedded first; of all of them then only the others."""
    shipped(spark)
    path = scratch(spark, "embeddings")
    t = read(spark, d, "documents").select("doc_id", "text")
    ir.cached_embeddings(t.where("doc_id % 2 = 0"), arrow.hash_embedding(16), "hash16", path)
    found = ir.cached_embeddings(t, arrow.hash_embedding(16), "hash16", path)
    return found.agg(F.countDistinct("key").alias("n_keys"), F.count("*").alias("n_cached"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN value + 1 ELSE value END AS value, event_id % 7 = 0 AS fresh FROM events) SELECT event_id, round(value, 6) AS value, fresh FROM e
UNION ALL SELECT event_id + 100000000, round(value, 6), TRUE FROM events WHERE event_id % 1000 = 1""")
def snk02_versions(spark, d):
    """SNK-02: a first version of a keyed table, then an upsert of some of its rows and some new ones, older ones aside, into the buckets that they fall into; read through the manifest."""
    e = read(spark, d, "events").select("event_id", "ts", "value").withColumn("fresh", F.lit(False))
    base = scratch(spark, "versions")
    versions.upsert(e, base, "event_id", "ts")
    changed = e.where("event_id % 7 = 0").withColumn("value", F.col("value") + 1).withColumn("fresh", F.lit(True))
    added = e.where("event_id % 1000 = 1").withColumn("event_id", F.col("event_id") + 100_000_000).withColumn("fresh", F.lit(True))
    stale = e.where("event_id % 7 = 1").withColumn("ts", F.col("ts") - F.expr("interval 1 day")).withColumn("value", F.lit(-1.0))
    versions.upsert(changed.unionByName(added).unionByName(stale), base, "event_id", "ts")
    return versions.current(spark, base, e.schema).select("event_id", F.round("value", 6).alias("value"), "fresh")


@query("""WITH e AS (SELECT event_id, ts + to_months(CAST(event_id % 3 AS INT)) AS ts, value FROM events), r AS (SELECT strftime(ts, '%Y-%m') AS month, CASE WHEN strftime(ts, '%Y-%m') = '2024-02' THEN 2 * value ELSE value END AS value FROM e)
SELECT month, count(*) AS n, round(sum(value), 3) AS total FROM r GROUP BY month""")
def str10_roll_over(spark, d):
    """STR-10: rows written by month, then one month written again by itself."""
    e = read(spark, d, "events").select("event_id", F.timestamp_add("MONTH", (F.col("event_id") % 3).cast("int"), F.col("ts")).alias("ts"), "value")
    path = scratch(spark, "months")
    versions.replace_months(e, "ts", path)
    versions.replace_months(e.where(F.date_format("ts", "yyyy-MM") == "2024-02").withColumn("value", 2 * F.col("value")), "ts", path)
    return spark.read.schema("event_id long, ts timestamp_ntz, value double, month string").parquet(path).groupBy("month").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
