"""Sinks: JSON lines, partition swaps with an alias table, encrypted columns, metric lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.session import shipped

#: Upper edges of the latency histogram, in seconds.
LATENCY_EDGES = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)


def jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line; characters above ASCII stay as they are."""
    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value")).write.mode("overwrite").text(path)


def text_files(values: DataFrame, path: str, most: int = 1 << 23) -> None:
    """Text files under path, a value (the one column; null: empty) a line and no line cut. A file begins at each multiple of most bytes of a task's values, so it holds fewer than most bytes and one value, however large the task is."""
    shipped(values.sparkSession)

    @F.pandas_udf("long")
    def at(sizes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        done = 0
        for s in sizes:
            ends = s.astype("int64").cumsum() + done
            yield (ends - s) // most
            done = int(ends.iloc[-1]) if len(ends) else done

    value = F.coalesce(F.col(f"`{values.columns[0]}`"), F.lit(""))
    # only the lengths go to Python
    values.select(value.alias("value")).withColumn("_part", at(F.octet_length("value").cast("long") + 1)).write.partitionBy("_part").text(path)


def swap(spark: SparkSession, df: DataFrame, base: str, version: str, alias_path: str, alias: str) -> DataFrame:
    """Write a new version beside the old ones, then point the alias at it: readers see the old version or the new one, never a part."""
    path = f"{base}/version={version}"
    df.write.mode("overwrite").parquet(path)
    pointer = spark.createDataFrame([(alias, path)], "alias string, path string")
    pointer.coalesce(1).write.mode("overwrite").parquet(f"{alias_path}/{alias}")
    return spark.read.parquet(path)


def through_alias(spark: SparkSession, alias_path: str, alias: str) -> DataFrame:
    return spark.read.parquet(spark.read.parquet(f"{alias_path}/{alias}").first()["path"])


def sealed(value: Column, key: Column) -> Column:
    """AES-GCM, as base64."""
    return F.base64(F.aes_encrypt(value, key, F.lit("GCM")))


def opened(value: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(value), key, F.lit("GCM")).cast("string")


def histogram(df: DataFrame, value: str, by: str) -> DataFrame:
    """(by, le, n): cumulative counts under each edge of the latency histogram and in all."""
    edges = F.array(*[F.lit(e) for e in LATENCY_EDGES], F.lit(float("inf")))
    rows = df.select(by, F.explode(F.filter(edges, lambda e: F.col(value) <= e)).alias("le"))
    return rows.groupBy(by, "le").agg(F.count("*").alias("n"))


def exposition(df: DataFrame, metric: str, value: str, label: str, name: str | None = None) -> DataFrame:
    """Metric lines in text form: the value of each row under its label, called name."""
    return df.select(F.concat(F.lit(f'{metric}{{{name or label}="'), F.col(label).cast("string"), F.lit('"} '), F.col(value).cast("string")).alias("value"))
