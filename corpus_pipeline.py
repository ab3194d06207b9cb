"""A corpus pipeline: quality rules, toxicity, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents, and any further ones of their docs, whatever their names.

Null texts and texts without words fail the quality rules; the other stages would keep
them. A null lang or source is a group of its own. A null doc_id links with nothing and
stays. Of rows that share a doc_id each is judged by itself by the first two stages;
the third takes them for one document, keeps or drops them together. Of a group, the
smallest doc_id stays. Texts are read whole, whatever their length. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm import ngram_join, packing, quality, queries, secret_scan, toxicity
from quarrymill.llm.common import dropped, saved


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the fixed limits, or lie far from their language's and source's others, go."""
    return quality.kept(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon calls toxic go."""
    return toxicity.filter_toxic(docs, queries.labelled_lexicon(spark, docs, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that near-duplicate links connect, the document with the smallest doc_id stays."""
    return ngram_join.keep_one(docs, words=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kind in brackets."""
    return secret_scan.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token pieces in sequences of 1024."""
    return packing.pack_documents(docs.select("doc_id", "text"), queries.tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", redact_secrets),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the robust estimates nor the learned lexicon; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        dropped(spark, before)
    return docs
