"""The queries that apply the corpus operators, with production parameters, to their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, embedding_dedup, hash_forest, licenses, ngram_join, packing, periodic_runs, quality, secret_scan, token_counts, toxicity, warc
from .common import smallest_hashes


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file; the files are installed, not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The most labelled rows that the toxicity lexicon is learned from: those with the smallest hashes of doc_id.
TRAINING_BOUND = 20_000


def labelled_lexicon(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Lexicon:
    """Learned from labelled rows of docs, held-out ones aside. The sample's ids, TRAINING_BOUND at most, are broadcast, so no text but theirs leaves the scan."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), F.xxhash64(F.col("doc_id").cast("long")).alias("_h"))
    usable = labels.where(~toxicity.held_out("doc_id") & F.col("toxic").isin(0, 1)).groupBy("_h", "doc_id").agg(F.min("toxic").alias("toxic"))
    most = smallest_hashes(usable.select("_h").distinct(), "_h", TRAINING_BOUND)
    sample = (usable if most is None else usable.where(F.col("_h") <= most)).select("doc_id", "toxic")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return toxicity.learn(texts.join(F.broadcast(sample), "doc_id").select("text", "toxic"), bound=TRAINING_BOUND)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, labelled_lexicon(spark, docs, sf_dir))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted", "toxicity_weight", "toxicity_hits")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", *quality.COUNTS, "base_failed", "kept", "distance")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find_runs(table(spark, sf_dir, "documents"), repeats=True))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_warc": op2_warc,
    "op3_secret_scan": op3_secret_scan,
    "op4_license_scan": op4_license_scan,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_token_counts": op7_token_counts,
    "op8_ngram_join": op8_ngram_join,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_bpe": op10_bpe,
    "op11_collocations": op11_collocations,
    "op12_hash_forest": op12_hash_forest,
    "op13_periodic_runs": op13_periodic_runs,
}

#: One row per page: SQL of what the archives must give back.
WARC_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload) AS first_id, sha1(payload) AS hex FROM p
), d AS (
  SELECT *, list_aggregate(list_transform(range(0, 40, 5), lambda k: list_aggregate(list_transform(range(0, 20, 5), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, CAST(k + 1 AS INT), 5) AS BIGINT) >> (15 - j)) & 31)::INT, 1)), 'string_agg', '')), 'string_agg', '') AS b32 FROM m
)
SELECT page_id, strlen(payload) AS payload_bytes, b32 AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to, TRUE AS digest_ok
FROM d
"""

#: Exact similarity join by shared shingles, and components by reachability.
JOIN_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda k: array_to_string(list_slice(w, k, k + 3), ' ')) END) AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(least(min(r.b), s.doc_id), s.doc_id) AS component_id
FROM s LEFT JOIN r ON s.doc_id = r.a GROUP BY s.doc_id, s.s
"""

#: Every phrase of one to three words as a row; products in 128-bit integers.
PHRASE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), g AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda k: array_to_string(w[k:CAST(k + m - 1 AS INT)], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) AS sizes(m)
), f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
cuts AS (
  SELECT lang, phrase, m, f AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:m], ' ') AS tail FROM c, (VALUES (1), (2)) AS ks(k) WHERE k < m
), scored AS (
  SELECT t.lang, t.phrase, t.m, t.a, t.k, l.f AS l, r.f AS r, (1000000 * t.a * t.a) // (l.f * r.f) AS score
  FROM cuts t JOIN f l ON l.lang = t.lang AND l.phrase = t.head JOIN f r ON r.lang = t.lang AND r.phrase = t.tail
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM lowest x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = x.lang AND c.m > x.m AND contains(' ' || c.phrase || ' ', ' ' || x.phrase || ' ') AND 100 * c.f >= 50 * x.a)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {"op11_collocations": PHRASE_SQL, "op2_warc": WARC_SQL, "op8_ngram_join": JOIN_SQL}
