"""The reference's concepts as projections of the generated tables: for each, a DataFrame and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.grades import GRADES


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: doc_id, text, source, domain, label (one of four grades)."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "source", F.col("lang").alias("domain"), "n_chars")
    lab = read(spark, sf_dir, "labels")
    label = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "TS").when((F.col("toxic") == 1) & (F.col("quality") == 1), "S1").when((F.col("toxic") == 0) & (F.col("quality") == 0), "S2").otherwise("S3")
    return d.join(lab.select("doc_id", label.alias("label")), "doc_id")


GOLD = """SELECT d.doc_id, d.text, d.source, d.lang AS domain, d.n_chars,
  CASE WHEN toxic = 1 AND quality = 0 THEN 'TS' WHEN toxic = 1 AND quality = 1 THEN 'S1' WHEN toxic = 0 AND quality = 0 THEN 'S2' ELSE 'S3' END AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gold with pred (a grade) and confidence."""
    g = gold(spark, sf_dir)
    grades = F.array(*[F.lit(x) for x in GRADES])
    pred = F.when(F.col("doc_id") % 5 < 3, F.col("label")).otherwise(F.element_at(grades, ((F.col("doc_id") * 7 + 3) % 4 + 1).cast("int")))
    return g.withColumn("pred", pred).withColumn("confidence", ((F.col("doc_id") * 37) % 101) / F.lit(100.0))


PRED = f"""SELECT g.*, CASE WHEN doc_id % 5 < 3 THEN label ELSE ['TS', 'S1', 'S2', 'S3'][(doc_id * 7 + 3) % 4 + 1] END AS pred,
  ((doc_id * 37) % 101) / 100.0::DOUBLE AS confidence FROM ({GOLD}) g"""


def classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """classification_id, doc_id, model_version, level (1 the most secret), confidence, status, inference_ms."""
    d = read(spark, sf_dir, "documents")
    status = F.element_at(F.array(*[F.lit(s) for s in ("staging", "confirmed", "corrected", "needs_review", "needs_second_review")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select(F.col("doc_id").alias("classification_id"), "doc_id", F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("model_version"), ((F.col("doc_id") * 7 + 3) % 4 + 1).alias("level"), (((F.col("doc_id") * 37) % 101) / F.lit(100.0)).alias("confidence"), status.alias("status"), (F.col("n_chars") % 900 + 20).alias("inference_ms"))


CLASSIFICATIONS = """SELECT doc_id AS classification_id, doc_id, 'm' || (doc_id % 3) AS model_version, (doc_id * 7 + 3) % 4 + 1 AS level,
  ((doc_id * 37) % 101) / 100.0::DOUBLE AS confidence, ['staging', 'confirmed', 'corrected', 'needs_review', 'needs_second_review'][doc_id % 5 + 1] AS status,
  n_chars % 900 + 20 AS inference_ms FROM documents"""


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """correction_id, classification_id, corrected_level, corrected_by, corrected_at, consumed."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("correction_id"), (F.col("event_id") % 200).alias("classification_id"), (F.get_json_object("props", "$.k").cast("long") % 4 + 1).alias("corrected_level"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("corrected_by"), F.col("ts").alias("corrected_at"), (F.col("event_type") == "signup").alias("consumed"))


CORRECTIONS = """SELECT event_id AS correction_id, event_id % 200 AS classification_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 + 1 AS corrected_level,
  'u' || user_id AS corrected_by, ts AS corrected_at, event_type = 'signup' AS consumed FROM events"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """called_at, provider, purpose, cost_usd, latency_ms, success, tokens."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").alias("called_at"), F.col("event_type").alias("provider"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("purpose"), F.col("value").alias("cost_usd"), F.get_json_object("props", "$.k").cast("long").alias("latency_ms"), (F.col("event_id") % 7 != 0).alias("success"), (F.col("event_id") % 1000).alias("tokens"))


USAGE = """SELECT event_id, ts AS called_at, event_type AS provider, 'p' || (user_id % 3) AS purpose, value AS cost_usd,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS latency_ms, event_id % 7 <> 0 AS success, event_id % 1000 AS tokens FROM events"""
